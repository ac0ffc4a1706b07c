"""Suffix arrays, substring and line dedup, SimHash: what is found between documents."""

import hashlib
import random
import zlib
from collections import Counter

import brute
import odd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from windrow.llm import components, lines, repeats, simhash
from windrow.llm.queries import op4_suffix_array, op8_lines
from windrow.llm.suffix_array import suffix_array


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array(text):
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_suffix_array_of_repeats():
    for text in (b"a" * 300, b"ab" * 200, b"aab" * 100 + b"b", bytes(range(256)) * 2, b"banana\0banana\0bananas"):
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def ordered(rows):
    """Distinct documents in the order that decides which copy is first."""
    key = lambda r: (-1 if r[0] is None else r[0], zlib.crc32((r[1] or "").encode()))
    return sorted({(r[0], r[1]) for r in rows}, key=key)


def digests(frame):
    from pyspark.sql import functions as F

    length = F.aggregate("runs", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["begin"])
    found = frame.select("doc_id", "n_bytes", length, F.size("runs"), F.sha2("kept", 256))
    return Counter(map(tuple, found.collect()))


def expected(rows):
    one = {(d, t): r for (d, t), r in zip(ordered(rows), brute.repeats([((d, t), (t or "").encode()) for d, t in ordered(rows)]), strict=True)}
    return Counter((r[0], *one[(r[0], r[1])][1:]) for r in rows)


PERIODIC = [
    (40, "ab" * 300, None, None),
    (41, "b" + "ab" * 120 + "tail of its own that is long enough to matter here" * 3, None, None),
    (42, odd.prose(8, 50) + odd.LONG[5000:5400] + odd.prose(9, 50), None, None),
    (43, odd.LONG[5100:5199], None, None),
    (44, "é" * 120, None, None),
    (45, "x" + "é" * 80, None, None),
]


def test_repeats_of_odd_documents(spark):
    rows = odd.TEXTS + PERIODIC
    assert digests(repeats.deduplicated(odd.documents(spark, rows))) == expected(rows)


def test_repeats_without_arrays_are_the_same(spark):
    rows = odd.TEXTS + PERIODIC
    assert digests(repeats.deduplicated(odd.documents(spark, rows), most=1)) == expected(rows)


def test_repeats_in_small_segments(monkeypatch):
    import numpy as np

    data = (odd.LONG + "ab" * 500).encode()
    whole = repeats.contexts(np.frombuffer(data, np.uint8), np.zeros(len(data), np.int32))
    monkeypatch.setattr(repeats, "SEGMENT", 700)
    starts = set()
    for pieces, _, offsets in repeats.segments([data]):
        for piece, offset in zip(pieces, offsets, strict=True):
            _, _, first, last = repeats.contexts(np.frombuffer(piece, np.uint8), np.zeros(len(piece), np.int32))
            for a, b in zip(first, last, strict=True):
                assert not starts & set(range(offset + a, offset + b + 1))
                starts |= set(range(offset + a, offset + b + 1))
    assert starts == {i for a, b in zip(whole[2], whole[3], strict=True) for i in range(a, b + 1)}
    assert starts == set(range(len(data) - repeats.LENGTH + 1))


def test_repeats_of_supplied_documents(spark, small, no_docs):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = Counter(brute.repeats([(d, (t or "").encode()) for d, t in sorted(docs)]))
    assert Counter(map(tuple, op4_suffix_array(spark, small).collect())) == want
    assert any(r[2] for r in want)
    assert repeats.deduplicated(no_docs).isEmpty()


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10_000))
def test_windows_of_random_contexts(seed):
    draw = random.Random(seed)
    source = [bytes(draw.choice(b"abc") for _ in range(400)) for _ in range(3)]
    group = []
    for i in range(8):
        text = draw.choice(source)
        at = draw.randrange(200)
        piece = bytearray(text[at : at + 160])
        if draw.random() < 0.5:
            piece[draw.randrange(160)] = 0x7A
        group.append((i, 0, 0, bytes(piece)))
    marks = {(d, p) for d, _, a, b in repeats.repeated_windows(group) for p in range(a, b)}
    seen, want = set(), set()
    for d, _, _, data in group:
        for i in range(len(data) - 99):
            if data[i : i + 100] in seen:
                want |= {(d, p) for p in range(i, i + 100)}
            seen.add(data[i : i + 100])
    assert marks == want


def line_rows(frame):
    return Counter(map(tuple, frame.select("doc_id", "kept_text", "n_lines", "n_removed", "n_runs").collect()))


MORE_LINES = [
    (50, "p\nq\nr\ns\nt", None, None),
    (51, "x\np\nq\nr\ny\nq\nr\ns\nt", None, None),
    (52, "a\nb\nc\nb\nc\na\nb\nc", None, None),
    (53, "\n\n\n\n\n\nq", None, None),
    (54, "p\nq", None, None),
]


@pytest.mark.parametrize("depth", [1, 2, 3, 5])
def test_lines_of_odd_documents(spark, depth):
    rows = odd.TEXTS + MORE_LINES
    # Documents of one text and id are one; the order of others with one id is that of the text's hash.
    docs = sorted({(r[0], r[1]) for r in rows}, key=lambda r: -1 if r[0] is None else r[0])
    empty_first = sorted(docs, key=lambda r: (-1 if r[0] is None else r[0], r[1] or ""))
    one = {k: r for k, *r in brute.line_runs([((d, t), t) for d, t in empty_first], depth)}
    got = line_rows(lines.deduplicated(odd.documents(spark, rows), depth))
    assert got == Counter((r[0], *one[(r[0], r[1])]) for r in rows)


def test_lines_of_supplied_documents(spark, no_docs):
    folder = "/root/testdata/sf0.01"
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    want = Counter(
        (d, n, gone, runs, hashlib.sha256(kept.encode()).hexdigest())
        for d, kept, n, gone, runs in brute.line_runs(docs, 3)
    )
    got = op8_lines(spark, folder).select("doc_id", "n_lines", "n_removed", "n_runs", "kept_sha256")
    assert Counter(map(tuple, got.collect())) == want
    assert any(r[2] for r in want)
    assert lines.deduplicated(no_docs).isEmpty()


def test_long_runs_of_one_and_two_lines_count(spark):
    one, other, few = odd.prose(31, 60), odd.prose(32, 30), odd.prose(33, 18)
    rows = [(1, f"{one}\n{few}", None, None), (2, one, None, None), (3, f"x\n{other}\n{few}x{few}\ny", None, None)]
    rows += [(4, f"{other}\n{few}x{few}", None, None), (5, few, None, None), (6, few, None, None), (7, other, None, None)]
    rows += [(8, "  ".join(odd.prose(34, 60).split(" ")) + " \t", None, None), (9, rows[3][1], None, None)]
    found = {r.doc_id: r.n_removed for r in lines.deduplicated(odd.documents(spark, rows)).collect()}
    assert found == {1: 0, 2: 1, 3: 0, 4: 2, 5: 0, 6: 0, 7: 0, 8: 0, 9: 2}


def test_no_long_passage_of_lines_repeats(spark):
    """Of exact copies only the first keeps anything, and no line of fifty words stays twice."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = lines.deduplicated(docs).join(docs.select("doc_id", "text"), "doc_id")
    kept = found.select(F.explode(F.split("kept_text", "\n")).alias("line"))
    assert kept.filter("size(split(trim(line), ' +')) >= 50").groupBy("line").count().filter("count > 1").isEmpty()
    long = found.filter("size(split(text, ' +')) >= 60")
    later = long.join(long.groupBy("text").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1"), "text")
    later = later.filter("doc_id > first")
    assert later.count() > 300
    assert later.filter("n_removed < n_lines").isEmpty()


def test_line_ranks_are_those_of_a_suffix_array(spark):
    rows = [(1, "a\nb\nc\na\nb\nc\na\nb", None, None), (2, "b\nc\na\nz\nb\nc\na", None, None)]
    found = dict(lines.levels(odd.documents(spark, rows), 3))[3].collect()
    text = {d: t.split("\n") for d, t, *_ in rows}
    runs = {}
    for r in found:
        runs.setdefault(r.rank, set()).add(tuple(text[r.id][r.line : r.line + 3]))
    assert all(len(x) == 1 for x in runs.values()) and len({x for s in runs.values() for x in s}) == len(runs)
    # A rank is the number of suffixes before, so it leaves room for those that share it.
    count = Counter(r.rank for r in found)
    for a, b in zip(sorted(count), sorted(count)[1:], strict=False):
        assert b >= a + count[a]


def test_line_dedup_runs_no_python(docs):
    plan = lines.deduplicated(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_bk_tree_finds_all_within_the_radius():
    draw = random.Random(5)
    items = [draw.getrandbits(12) for _ in range(400)]
    tree = simhash.BKTree()
    for x in items:
        tree.add(x, x)
    for x in range(0, 4096, 37):
        assert set(tree.near(x, 2)) == {y for y in items if (x ^ y).bit_count() <= 2}


def test_fingerprints(spark, docs, small):
    for frame in (docs, spark.read.parquet(f"{small}/documents.parquet")):
        got = simhash.fingerprints(frame).collect()
        want = [(r.doc_id, brute.fingerprint(r.text)) for r in frame.collect()]
        assert Counter((r.doc_id, int.from_bytes(r.fingerprint, "big")) for r in got) == Counter(want)


def test_bit_counts_of_long_runs():
    import numpy as np

    draw = np.random.default_rng(3)
    hashes = draw.integers(0, 1 << 64, 2000, dtype=np.uint64)
    begins = np.array([0, 1, 256, 511, 1800])
    got = simhash.bit_counts(hashes, begins)
    for run, a, b in zip(got, begins, [*begins[1:], 2000], strict=True):
        assert run.tolist() == [int(sum(int(h) >> k & 1 for h in hashes[a:b])) for k in range(64)]


def test_near_duplicates(spark, docs, small, no_docs):
    for frame in (docs, spark.read.parquet(f"{small}/documents.parquet")):
        texts = {r.doc_id: brute.fingerprint(r.text) for r in frame.collect() if r.doc_id is not None}
        want = brute.groups(texts)
        got = [r for r in simhash.near_duplicates(frame).collect() if r.doc_id is not None]
        assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {d: (f"{texts[d]:016x}", want[d]) for d in texts}
    assert simhash.near_duplicates(no_docs).isEmpty()


@pytest.mark.parametrize("most", [1, 3, 4096])
def test_links_of_fingerprints(spark, most):
    draw = random.Random(9)
    prints = {}
    for i in range(40):
        base = draw.getrandbits(64)
        for k in range(5):
            x = base
            for _ in range(draw.choice([0, 1, 1, 2, 3])):
                x ^= 1 << draw.randrange(64)
            prints[10 * i + k] = x
    prints |= {1000 + k: (1 << k) | (1 << 63) for k in range(12)} | {2000: 0, 2001: (1 << 64) - 1, 2002: 3}
    want = brute.groups(prints)
    rows = spark.createDataFrame([(v.to_bytes(8, "big"), k) for k, v in prints.items()], "fingerprint binary, doc_id long")
    entries = simhash.entries_of(rows, ["fingerprint"])
    found = components.components(simhash.block_links(entries, most))
    named = entries.join(found, "node", "left").selectExpr("fingerprint", "coalesce(component, node) AS c").collect()
    group = {int.from_bytes(r.fingerprint, "big"): r.c for r in named}
    assert {d: group[x] for d, x in prints.items()} == want


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(60)] + [(200, 100), (100, 150), (7, 7), (300, 301), (None, 5)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {150: 100, 200: 100, 301: 300}


def edited(text, n, seed):
    draw = random.Random(seed)
    words = text.split(" ")
    for _ in range(n):
        words[draw.randrange(len(words))] = f"w{draw.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("most", [3, 4096])
def test_copies_of_similar_texts(spark, most, monkeypatch):
    monkeypatch.setattr(simhash.band_links, "__defaults__", (most,))
    rows = []
    for i in range(12):
        base = odd.prose(100 + i, 200 + 30 * i)
        rows.append((100 * i, base))
        rows += [(100 * i + k, edited(base, k % 4, 1000 * i + k)) for k in range(1, 8)]
        rows.append((100 * i + 50, odd.prose(900 + i, 300)))
    rows += [(None, rows[0][1]), (5000, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    dropped = {r.doc_id for r in simhash.copies(frame).collect()}
    assert dropped == {100 * i + k for i in range(12) for k in range(1, 8)}


def test_copies_of_supplied_documents(spark):
    """Against all pairs of the supplied texts: hardly a copy at 0.8 stays, and nothing goes that is far below."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    shingles = {r.doc_id: brute.word_shingles(r.text, 5) for r in table.collect()}
    like = brute.similarities(shingles)
    copies = {b for (_, b), x in like.items() if x >= 0.8}
    dropped = {r.doc_id for r in simhash.copies(table).collect()}
    assert len(copies) > 50 and len(copies & dropped) >= 0.99 * len(copies)
    blank = {d for d, s in shingles.items() if not s}
    best = {d: max((x for (a, b), x in like.items() if d in (a, b)), default=0.0) for d in dropped - copies - blank}
    assert all(x > 0.6 for x in best.values()) and len(best) <= 0.1 * len(copies)


def test_one_document_of_a_group_stays(spark, docs, no_docs):
    kept = simhash.without_copies(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[6] == 1 and not {7, 8, 9, 5} & set(ids) and ids[None] == 2 and ids[4] == 1
    assert simhash.without_copies(no_docs).isEmpty()


def test_copies_in_a_band_of_thousands(spark):
    """Different documents that share a passage, and chains of copies of which only the first are near the pivot."""
    draw = random.Random(11)
    shared = 77
    prints = {}
    for i in range(1500):
        prints[10 * i] = base = draw.getrandbits(1024)
        if i % 10 == 0:
            for k in range(1, 5):
                for b in draw.sample(range(1024), 150):
                    base ^= 1 << b
                prints[10 * i + k] = base
    # A large group of its own, as a pivot's, with chains that lead away from it.
    middle = draw.getrandbits(1024)
    for i in range(600):
        x = middle
        for k in range(3):
            for b in draw.sample(range(1024), 60 if k == 0 else 150):
                x ^= 1 << b
            if k == 0 or i % 20 == 0:
                prints[100_000 + 10 * i + k] = x
    want = brute.groups(prints, simhash.WIDE_RADIUS)
    assert len(set(want.values())) < len(want)
    rows = [(v.to_bytes(128, "big"), k, [shared, *(1000 + 14 * k + b for b in range(1, 14))]) for k, v in prints.items()]
    entries = spark.createDataFrame(rows, "fingerprint binary, node long, bands array<long>")
    for most in (64, 700):
        found = components.components(simhash.band_links(entries, simhash.WIDE_RADIUS, most)).collect()
        group = {r.node: r.component for r in found}
        assert {d: group.get(d, d) for d in prints} == want


def test_texts_of_one_id_are_documents_of_their_own(spark):
    other, third = odd.prose(31, 200), odd.prose(32, 200)
    rows = [(1, odd.BASE, "en", "a"), (2, odd.BASE, "en", "a"), (2, other, "en", "a"), (2, third, "en", "b"), (2, third, "en", "a")]
    rows += [(3, third, "en", "a"), (4, other, "en", "a"), (5, odd.PASSAGE, "en", "a")]
    found = [simhash.without_copies(odd.documents(spark, r)).collect() for r in (rows, rows[::-1])]
    want = Counter({(1, odd.BASE): 1, (2, other): 1, (2, third): 1, (5, odd.PASSAGE): 1})
    assert all(Counter((r.doc_id, r.text) for r in x) == want for x in found)
    assert set(found[0]) == set(found[1])
