"""Mixing, token records, WARC archives and the pipeline: what is written and read back."""

import base64
import gzip
import hashlib
import struct
import zlib
from collections import Counter, defaultdict

import brute
import corpus_pipeline
import numpy as np
import odd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from windrow.llm import decontaminate, fertility, mix, records, simhash, warc
from windrow.llm.queries import op3_mix, op7_records, tokenizer_file

TOKENIZER = tokenizer_file("word_bpe_49k.json")


@pytest.fixture
def folder():
    path = odd.folder()
    yield f"file://{path}"
    odd.drop(path)


def sizes(rows):
    return {(r[0], r[1], r[3]): len(brute.BLANK.findall(r[1] or "")) for r in rows}


def check_mix(rows, docs):
    """rows: (doc_id, source, size, source_size, target, copies, taken); docs: (source, size)."""
    total = defaultdict(int)
    for source, size in docs:
        total[source] += size
    want = brute.targets(total) if any(total.values()) else dict.fromkeys(total, 0.0)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.source_size == total[r.source] and r.target == pytest.approx(want[r.source], rel=1e-12)
        ratio = r.target / r.source_size if r.source_size else 0
        assert r.taken == r.size * r.copies and int(ratio + 1e-9) <= r.copies <= -int(-ratio // 1)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for source in total:
        assert abs(taken[source] - want[source]) <= 2 * largest[source]


def test_mix_of_odd_documents(docs, no_docs):
    rows = mix.mixed(docs, block_rows=3).collect()
    assert Counter((r.doc_id, r.source, r["size"]) for r in rows) == Counter(
        (r[0], r[3], len(brute.BLANK.findall(r[1] or ""))) for r in odd.TEXTS
    )

    class Row:
        def __init__(self, r):
            self.source, self.size, self.source_size = r.source, r["size"], r.source_size
            self.target, self.copies, self.taken = r.target, r.copies, r.taken

    check_mix([Row(r) for r in rows], [(r[3], len(brute.BLANK.findall(r[1] or ""))) for r in odd.TEXTS])
    assert mix.mixed(no_docs).isEmpty()


def test_mix_of_supplied_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: (r.source, len(brute.BLANK.findall(r.text))) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    total = defaultdict(int)
    for source, size in docs.values():
        total[source] += size
    want = brute.targets(total)
    first, again = (Counter(map(tuple, op3_mix(spark, folder).collect())) for _ in range(2))
    assert first == again
    taken, counted, expected = defaultdict(int), defaultdict(int), defaultdict(float)
    for doc, size, source_size, target, words, copies in first:
        source = docs[doc][0]
        assert (size, source_size) == (docs[doc][1], total[source]) and target == pytest.approx(want[source], rel=1e-12)
        taken[source] += words
        counted[source] += copies
        expected[source] += target / source_size
    for source in total:
        # The landing decides two documents; both totals are kept up to these.
        largest = max(s for o, s in docs.values() if o == source)
        assert abs(taken[source] - want[source]) <= largest and abs(counted[source] - expected[source]) <= 2


def test_blocks_do_not_lose_the_balance(spark, docs):
    rows = [(i, odd.prose(i, 5 + i % 37), "en", "s" if i % 3 else "t") for i in range(600)]
    found = mix.mixed(odd.documents(spark, rows), block_rows=16).collect()
    for source in "st":
        own = [r for r in found if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 2 * max(r["size"] for r in own)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.floats(0.01, 0.99)), min_size=1, max_size=40), st.integers(0, 1000))
def test_flight_keeps_both_totals(units, seed):
    size = np.array([u[0] for u in units])
    chance = np.array([u[1] for u in units])
    draws = np.random.default_rng(seed).random((3, len(units)))
    out = mix.flight(size, chance, draws[0])
    assert out.sum() == pytest.approx(chance.sum(), abs=1e-6) and (size * out).sum() == pytest.approx((size * chance).sum(), abs=1e-4)
    assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 2
    assert set(mix.landing(size, out, draws[1:])) <= {0.0, 1.0}


def test_chances_are_kept_on_average():
    size, chance = np.array([3, 10, 4, 7, 1, 9, 2]), np.full(7, 0.3)
    draws = np.random.default_rng(1)
    total = sum(mix.landing(size, mix.flight(size, chance, draws.random(7)), draws.random((2, 7))) for _ in range(6000))
    assert np.abs(total / 6000 - 0.3).max() < 0.03


def test_resampled_rows(spark, docs, no_docs):
    repeated = docs.unionByName(docs.limit(3))
    out = mix.resampled(repeated)
    assert out.columns == docs.columns
    drawn = mix.drawn(
        mix.sizes(repeated.selectExpr("doc_id", "text", "source", "xxhash64(text) AS tie", "0L AS tie2")).drop("text"), 4096
    )
    assert out.count() > 0 and mix.resampled(no_docs).isEmpty()
    most = Counter(r.doc_id for r in repeated.collect())
    assert all(n <= 2 * most[d] for d, n in Counter(r.doc_id for r in out.collect()).items())
    assert {r.doc_id for r in out.collect()} <= {r.doc_id for r in drawn.collect()}


ODD_TEXTS = [
    "it's İstanbul’s DON'T ﬁ é ²x x² <|endoftext|>a b<|startoftext|>c ΑΣ ΑΣ' naïve ́x ŉ 'll we'LL don't. a b \x1c ¼½",
    "中文字 한국어 ß ẞ ﷺ ǅ K Å 'S a'b'c é ́ Å ÀÉ× ÷ ɏɐ Straße!!! 12ab ab12 a1b2 --x-- ____ ▁ \x00 \x7f \x85",
]


def expected_tokens(rows):
    model, start, out = Tokenizer.from_file(TOKENIZER), 0, []
    for doc, text in rows:
        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_records(spark, folder):
    rows = [*odd.TEXTS, *((60 + i, t, None, None) for i, t in enumerate(ODD_TEXTS))]
    manifest = records.write_records(odd.documents(spark, rows), TOKENIZER, f"{folder}/records")
    got = [tuple(r) for r in records.read_records(spark, manifest).collect()]
    order = sorted(((r[0], r[1]) for r in rows), key=lambda r: (-1 if r[0] is None else r[0], r[1] is not None, r[1] or ""))
    assert sorted(got, key=lambda r: r[1]) == expected_tokens(order)
    # Any record can be reached by the index alone.
    for file in manifest.collect():
        entries = records.read_index(file.path)
        assert len(entries) == file.n_docs and entries[:, 2].sum() == file.n_tokens
        for doc, offset, n in entries[::-1].tolist():
            found, ids = records.read_at(file.path, offset)
            assert (found or 0, len(ids)) == (doc, n)


def test_token_records_of_supplied_documents(spark, small):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    assert sorted(map(tuple, op7_records(spark, small).collect())) == expected_tokens(rows)


def test_no_records(spark, no_docs, folder):
    manifest = records.write_records(no_docs, TOKENIZER, f"{folder}/records")
    assert manifest.isEmpty() and records.read_records(spark, manifest).isEmpty()


def test_damage_is_found():
    data = bytearray(records.frame(records.pack(5, np.array([1, 70000, 3]))))
    payload, end = records.unframe(memoryview(bytes(data)), 0)
    assert end == len(data) and records.unpack(payload)[0] == 5 and records.unpack(payload)[1].tolist() == [1, 70000, 3]
    assert records.unframe(memoryview(bytes(data[:-1])), 0) is None
    for at in range(len(data)):
        bad = data.copy()
        bad[at] ^= 1
        with pytest.raises(ValueError):
            assert records.unframe(memoryview(bytes(bad)), 0) is None
            raise ValueError
    assert struct.unpack_from("<Q", data)[0] == len(payload)


def test_words_with_a_full_memory(monkeypatch):
    monkeypatch.setattr(records, "CACHE_WORDS", 5)
    texts = [odd.LONG, *ODD_TEXTS, None, odd.BASE]
    encoder, model = records.WordEncoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    for text in texts:
        ids, counts = encoder.encode(pa.array([text, text], pa.string()))
        want = model.encode(text or "", add_special_tokens=False).ids
        assert ids.tolist() == want * 2 and counts.tolist() == [len(want)] * 2


PAGES = [
    ("10", "http://a/ä b", "<p>one</p>"),
    ("9", "http://b", "<p>one</p>"),
    ("x y\r\nz", None, "<p>one</p>"),
    ("1", "http://c", None),
    ("2", "http://d", ""),
    ("3", "http://e", "é" * 3_000_000),
    ("4", "http://f", "\r\n\r\nWARC/1.1\r\n\r\n" * 50),
    (None, "http://g", "alone"),
    (None, "http://g", "alone"),
    (None, "http://h", "<p>one</p>"),
    ("5", "http://i", "repeated row"),
    ("5", "http://i", "repeated row"),
]


def expected_pages(pages, least=0):
    first = {}
    for page, _, html in pages:
        if page is not None and len((html or "").encode()) >= least:
            first[html or ""] = min(first.get(html or "", page), page)
    out = Counter()
    for page, _, html in pages:
        data, head = (html or "").encode(), first.get(html or "")
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        again = head is not None and head != page
        out[page, len(data), digest, "revisit" if again else "response", head if again else None] += 1
    return out


@pytest.mark.parametrize("least", [0, 8])
def test_archives(spark, folder, least):
    pages = spark.createDataFrame([(*p, "clash", "clash") for p in PAGES], "page_id string, url string, html string, payload string, first string")
    manifest = warc.write_archives(pages, f"{folder}/archives", least)
    found = warc.records(warc.chunk_table(spark, manifest, data=False))
    assert Counter(map(tuple, found.collect())) == expected_pages(PAGES, least)
    assert manifest.groupBy().sum("n_records").first()[0] == len(PAGES)


def test_chunks_make_up_the_payload(spark, folder):
    pages = spark.createDataFrame(PAGES, "page_id string, url string, html string")
    manifest = warc.write_archives(pages, f"{folder}/archives")
    chunks = warc.chunk_table(spark, manifest, 1000).collect()
    assert max(len(c.data) for c in chunks) <= 1000
    by_record = defaultdict(list)
    for c in sorted(chunks, key=lambda c: c.chunk_no):
        by_record[c.path, c.record_no].append(c)
    urls = {(p, u) for p, u, _ in PAGES}
    for parts in by_record.values():
        assert [c.chunk_no for c in parts] == list(range(len(parts))) and [c.last for c in parts].index(True) == len(parts) - 1
        assert (parts[0].page_id, parts[0].url) in urls
        data = b""
        for c in parts:
            data += c.data
            if parts[0].record_type == "response":
                assert c.bytes_so_far == len(data)
                assert c.digest_so_far == base64.b32encode(hashlib.sha1(data).digest()).decode()
    # Each record is a compressed member of its own, and gzip reads the file as a whole.
    path = manifest.first().path.removeprefix("file://")
    assert gzip.open(path).read().startswith(b"WARC/1.1\r\nWARC-Type: ")


def test_a_damaged_archive_is_found(spark, folder):
    pages = spark.createDataFrame(PAGES[:2], "page_id string, url string, html string")
    path = warc.write_archives(pages, f"{folder}/archives").first().path
    raw = gzip.open(path.removeprefix("file://")).read()
    for bad in (raw.replace(b"one", b"two", 1), raw[:-3]):
        with gzip.open(f"{path.removeprefix('file://')}.bad", "wb") as file:
            file.write(bad)
        with pytest.raises((ValueError, KeyError)):
            list(warc.record_chunks(f"{path}.bad"))


def test_no_archives(spark, folder):
    pages = spark.createDataFrame([], "page_id string, url string, html string")
    manifest = warc.write_archives(pages, f"{folder}/archives")
    assert manifest.isEmpty() and warc.records(warc.chunk_table(spark, manifest)).isEmpty()


def marks(spark, folder):
    spark.createDataFrame([(1, odd.PASSAGE)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_pipeline_stage_by_stage(spark, folder):
    """Each stage against the plain statement of what it keeps of its own input."""
    sf_dir = marks(spark, folder)
    more = [(100 + i, odd.prose(50 + i, 120 + i), "en", f"s{i % 4}") for i in range(40)]
    frame = odd.documents(spark, odd.TEXTS + more)
    (_, quality), (_, near), (_, clean), (_, mixing), (_, output) = corpus_pipeline.STAGES
    names = [k for k, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "near-dedup", "decontamination", "mixing", "token records"]

    good = quality(spark, frame, sf_dir).cache()
    want = Counter(r.doc_id for r in fertility.measure(frame, tokenizer_file("piece_bpe_32k.model")).filter("kept").collect())
    assert Counter(r.doc_id for r in good.collect()) == want and set(range(100, 140)) <= set(want)
    single = near(spark, good, sf_dir).cache()
    ids = {r.doc_id for r in single.collect()}
    assert {4, 6, 10} | {100 + i for i in range(40)} <= ids and not {5, 7, 8, 9} & ids
    unseen = clean(spark, single, sf_dir).cache()
    hit = {r[0] for r in brute.contamination([(r.doc_id, r.text) for r in single.collect()], [(1, odd.PASSAGE)]) if r[-1]}
    assert hit and {r.doc_id for r in unseen.collect()} == ids - hit
    drawn = mixing(spark, unseen, sf_dir).cache()
    copies = {(r.doc_id, r.source): r.copies for r in mix.mixed(unseen).collect()}
    for f in (good, single, unseen, drawn):
        assert f.columns == frame.columns
    rows = drawn.collect()
    assert len(rows) == sum(copies.values()) and set(Counter(r.doc_id for r in rows).values()) <= {1, 2}
    order = sorted(((r.doc_id, r.text) for r in rows), key=lambda r: (-1 if r[0] is None else r[0], r[1] or ""))
    assert sorted(map(tuple, output(spark, drawn, sf_dir).collect()), key=lambda r: r[1]) == expected_tokens(order)


def test_pipeline_of_nothing(spark, folder, no_docs):
    sf_dir = marks(spark, folder)
    no_docs.write.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, sf_dir).isEmpty()


def test_pipeline_agrees_with_itself(spark, small):
    first, again = (Counter(map(tuple, corpus_pipeline.run(spark, small).collect())) for _ in range(2))
    assert first == again and len(first) > 50


def test_near_copies_of_one_row_each(spark):
    rows = [(1, odd.BASE, "en", "a"), (1, odd.BASE, "en", "a"), (2, odd.BASE, "en", "a"), (None, odd.BASE, None, None)]
    kept = Counter(r.doc_id for r in simhash.without_copies(odd.documents(spark, rows)).collect())
    assert kept == {1: 1, None: 1}


def test_patterns_of_a_null_item(spark):
    items = spark.createDataFrame([(None, None)], "item_id long, text string")
    assert decontaminate.windows(items).isEmpty()


def test_equal_rows_are_dealt_into_many_blocks(spark, monkeypatch):
    """No block grows with the copies of one row, and the draws of equal rows come near their source's target."""
    largest = []
    plain = mix.drawn
    rows = spark.range(3000).selectExpr("7L AS doc_id", "'five words of plain text' AS text", "'a' AS source", "map('k', 1) AS extra")
    rows = rows.unionByName(spark.range(500).selectExpr("id + 10 AS doc_id", "repeat('w ', 1 + int(id % 9)) AS text", "'b' AS source", "map('k', int(id)) AS extra"))

    def seen(frame, block_rows):
        out = plain(frame, block_rows)
        largest.append(out.groupBy("doc_id", "nth").count().agg({"count": "max"}).first()[0])
        return out

    monkeypatch.setattr(mix, "drawn", seen)
    once = mix.resampled(rows, 200)
    assert once.columns == rows.columns and largest == [1]
    counts = {r.doc_id: r["count"] for r in once.groupBy("doc_id").count().collect()}
    drawn = {(r.doc_id): r.taken for r in mix.mixed(rows, 200).groupBy("doc_id").agg(F.sum("copies").alias("taken")).collect()}
    # The same rows are drawn as often by either; here the rows' own columns break ties, so totals are compared.
    target = mix.mixed(rows, 200).select("source", "target").distinct().collect()
    words = {r.source: r.words for r in once.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("words")).collect()}
    for r in target:
        assert abs(words[r.source] - r.target) <= max(20, 0.01 * r.target)
    assert abs(counts[7] - drawn[7]) <= 3
    balanced = []
    monkeypatch.setattr(mix, "drawn", plain)
    monkeypatch.setattr(mix, "stored", lambda frame, name, f=mix.stored: balanced.append(f(frame, name)) or balanced[-1])
    mix.mixed(rows, 200)
    first = next(b for b in balanced if "block" in b.columns)
    assert first.groupBy("rank", "block").count().agg({"count": "max"}).first()[0] < 400
