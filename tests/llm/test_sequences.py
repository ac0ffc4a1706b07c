"""Periodic runs, the prefix trie of conversations, and toxicity."""

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import brute
import duckdb
import numpy as np
import odd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from windrow.llm import conversations, periodic, toxicity
from windrow.llm.oracle import llm_sql
from windrow.llm.queries import op11_periodic, op12_conversations, op13_toxicity


def plain_runs(s, words=24, periods=3):
    """Stretches of every period, by comparing all words that far apart."""
    n, out = len(s), []
    for q in range(1, n // periods + 1):
        i = 0
        while i < n - q:
            begin = i
            while i < n - q and s[i] == s[i + q]:
                i += 1
            size = i - begin + q
            shorter = (all(s[begin + k] == s[begin + k + r] for k in range(size - r)) for r in range(1, q))
            if i > begin and size >= max(words, periods * q) and not any(shorter):
                out.append((begin, size, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_periodic(doc, text, least=24):
    words = brute.BLANK.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words, least)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = None
    for s, size, q in runs:
        if best is None or size * best[2] > best[1] * q:
            best = (s, size, q)
    shown = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    digests = [hashlib.sha256(x.encode()).hexdigest() for x in (shown, kept)]
    return (doc, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *digests)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=70), st.sampled_from([(24, 3), (2, 2), (6, 3)]))
def test_runs(symbols, least):
    assert periodic.runs_in(symbols, *least) == plain_runs(symbols, *least)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=40), st.integers(0, 39), st.integers(0, 39))
def test_extensions(symbols, i, j):
    i, j = i % len(symbols), j % len(symbols)
    if i == j:
        return
    agree = 0
    while max(i, j) + agree < len(symbols) and symbols[i + agree] == symbols[j + agree]:
        agree += 1
    found = periodic.SuffixTree(symbols).extensions().of(np.array([i]), np.array([j]))
    assert found.tolist() == [agree]


def test_runs_of_many_texts():
    """Skipping what cannot hold a run loses none, next to one and at the ends of a text."""
    draw = random.Random(3)
    texts = []
    for _ in range(200):
        words = [draw.choice("abcdefgh") for _ in range(draw.randrange(60))]
        unit = [draw.choice("abcdefghijkl") for _ in range(draw.randrange(1, 12))]
        words += unit * draw.randrange(6) + unit[: draw.randrange(len(unit))] + words[: draw.randrange(20)]
        texts.append(" ".join(words) if draw.random() < 0.9 else None)
    sizes, runs, kept = (x.to_pylist() for x in periodic.collapsed_slice(pa.array(texts, pa.string())))
    for text, n, found in zip(texts, sizes, runs, strict=True):
        words = (text or "").split()
        assert n == len(words)
        assert [(r["start"], r["length"], r["period"]) for r in found] == plain_runs(words)


TAILS = [(i, odd.prose(i, 90), "en", "a") for i in range(100, 220)]
LONG_LINE = (500, "one two three " * 40_000 + odd.prose(9, 50), "en", "a")


def periodic_rows(spark, rows, folder):
    odd.documents(spark, rows).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return Counter(map(tuple, op11_periodic(spark, folder).collect()))


def test_periodic_query(spark):
    folder = odd.folder()
    rows = odd.TEXTS + TAILS
    found = periodic_rows(spark, rows, folder)
    assert found == Counter(plain_periodic(r[0], r[1]) for r in rows)
    assert sum(n for r, n in found.items() if r[1]) > 10
    odd.drop(folder)


def test_periodic_long_text_and_none(spark, no_docs):
    found = periodic.collapsed(odd.documents(spark, [LONG_LINE])).first()
    assert found["n_words"] == 120_050
    assert [tuple(r) for r in found["runs"]] == [(0, 120_000, 3)]
    assert found["row"]["two words"] == found["row"]["n_words"] == "clash"
    assert found["collapsed"].split()[:5] == ["one", "two", "three", *odd.prose(9, 50).split()[:2]]
    assert periodic.collapsed(no_docs).count() == 0


def plain_trie(members):
    """Nodes of whole conversations, given as ``{id: [(role, text), ...]}``."""
    nodes = defaultdict(list)
    for c, turns in members.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    below = defaultdict(list)
    for key in nodes:
        for d in range(len(key) + 1):
            below[key[:d]].append(key)
    children = Counter(k[:-1] for k in nodes if k)
    out = []
    for key, ids in nodes.items():
        ends = sorted(c for c in ids if len(members[c]) == len(key))
        out.append(
            (
                min(ids),
                len(key),
                min(nodes[key[:-1]]) if key else None,
                len(ids),
                children[key],
                sum(not children[k] for k in below[key]),
                sum((len(nodes[k]) - 1) * len(k[-1][1]) for k in below[key] if k),
                hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        )
    return Counter(out)


def rebuilt(members):
    out = {}
    for c, turns in members.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = members.get(int(c / 100) * 100, [])
        out[c] = base[:h] + turns[h:]
    return out


CONV_SCHEMA = "conv_id long, turn long, role string, text string, depth string, block string, `two words` string"


def conv_rows(members):
    rows = [(c, i, *t, "x", "y", "z") for c, turns in members.items() for i, t in enumerate(turns)]
    random.Random(5).shuffle(rows)
    return rows


def drawn_conversations():
    draw = random.Random(11)
    stem = [("user", f"turn {i}") for i in range(40)]
    members = {}
    for c in [*range(0, 60), 100, 101, 150, 199, -3, 305]:
        n = draw.randrange(1, 14)
        members[c] = stem[:n] + [(draw.choice(["user", "tool"]), draw.choice(["yes", "no", "", "é中"])) for _ in range(draw.randrange(4))]
    # Ever longer copies of one conversation, and one that is many blocks long.
    for c in range(400, 430):
        members[c] = stem[: c - 399]
    members[700] = [("a", str(i % 3)) for i in range(300)]
    members[701] = members[700][:257] + [("a", "other")]
    return members


def test_trie(spark, monkeypatch):
    monkeypatch.setattr(conversations, "SEGMENT", 7)
    monkeypatch.setattr(conversations, "CHUNK_IDS", 2)
    members = drawn_conversations()
    frame = spark.createDataFrame(conv_rows(members), CONV_SCHEMA)
    assert Counter(map(tuple, conversations.prefix_trie(frame).collect())) == plain_trie(members)


def test_trie_query_and_sql(spark):
    members = drawn_conversations()
    rows = conv_rows(members) + [(None, 1, "user", "nobody's", "", "", ""), (9000, None, None, None, "", "", "")]
    folder = odd.folder()
    spark.createDataFrame(rows, CONV_SCHEMA).coalesce(1).write.parquet(f"{folder}/conversations.parquet")
    members[9000] = [("", "")]
    found = Counter(map(tuple, op12_conversations(spark, folder).collect()))
    assert found == plain_trie(rebuilt(members))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet/*.parquet'")
    assert Counter(duck.execute(llm_sql()["op12_conversations"]).fetchall()) == found
    odd.drop(folder)


def test_trie_of_nothing(spark):
    assert conversations.prefix_trie(spark.createDataFrame([], CONV_SCHEMA)).count() == 0


def test_trie_of_supplied_conversations(spark):
    folder = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.01")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    found = Counter(map(tuple, op12_conversations(spark, folder).collect()))
    assert found == Counter(duck.execute(llm_sql()["op12_conversations"]).fetchall())


def plain_kernel(s, t):
    """Weights of all common subsequences of three letters, by enumerating them."""

    def weights(word):
        out = Counter()
        for i in range(len(word)):
            for j in range(i + 1, len(word)):
                for k in range(j + 1, min(len(word), i + toxicity.SPAN)):
                    out[word[i] + word[j] + word[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    a, b = weights(s), weights(t)
    scale = toxicity.norms(np.array([len(s), len(t)]))
    return sum(a[u] * b[u] for u in a) / scale.prod()


@settings(max_examples=100, deadline=None)
@given(st.text("abcdé", min_size=3, max_size=12), st.lists(st.text("abcdé", min_size=3, max_size=12), min_size=1, max_size=4))
def test_kernel(word, marks):
    alphabet = toxicity.Alphabet(marks)
    triples, of_marks = toxicity.features(marks, alphabet)
    found = toxicity.kernel([word], alphabet, triples, of_marks)[0]
    assert np.allclose(found, [plain_kernel(word, m) for m in marks])


def test_machine_separates_and_folds():
    """Words of either side are told apart, long words are scored by their pieces, unknown letters count for nothing."""
    toxic, clean = {"stupid": 9, "moron": 5, "scum": 4}, {"table": 3, "river": 1, "stone": 30, "order": 2}
    machine = toxicity.fitted(toxic, clean)
    assert machine.margins([*toxic, "stuupid", "mor\u00e9on"]).min() > 0 > machine.margins(list(clean)).max()
    pieces = ["stupid" + "x" * 18, "x" * 24]
    assert np.allclose(machine.margins(["stupid" + "x" * 60])[0], machine.margins(pieces).max())
    assert machine.margins(["\u4e2d\u6587\u5b57", "qqq"]).tolist() == [machine.offset] * 2


def test_words_of_letters():
    words, rows = toxicity.own_words(pa.array(["You I-D.I*O_T! a b c d, x", None, "", "éa 12 ab", "s c u m"]))
    assert list(zip(words.to_pylist(), rows.tolist(), strict=True)) == [("you", 0), ("idiot", 0), ("abcdx", 0), ("scum", 4)]


@pytest.fixture(scope="module")
def large():
    return "/root/testdata/sf0.1"


def test_toxicity_of_held_out_rows(spark, large):
    labels = spark.read.parquet(f"{large}/labels.parquet")
    found = op13_toxicity(spark, large)
    rows = found.join(labels, "doc_id").filter("held_out").toPandas()
    clean, toxic = rows[rows.toxic == 0], rows[rows.toxic == 1]
    # Some eight in a hundred labels of either kind are not to be seen in the text.
    assert (clean.predicted == 0).mean() > 0.97
    assert (toxic.predicted == 1).mean() > 0.85
    assert rows.score.between(0, 1).all()
    assert rows.predicted.equals((rows.score >= 0.3).astype("int32"))
    assert all(h == (zlib.crc32(str(d).encode()) % 4 == 2) for d, h in zip(rows.doc_id, rows.held_out, strict=True))


def test_insults_with_gaps_are_found(spark, large):
    docs = spark.read.parquet(f"{large}/documents.parquet").select("doc_id", "text")
    marks = spark.read.parquet(f"{large}/labels.parquet").selectExpr("doc_id", "toxic = 1 AS toxic")
    clean = docs.join(marks, "doc_id").filter("NOT toxic AND length(text) BETWEEN 300 AND 900 AND crc32(cast(doc_id AS string)) % 4 = 2")
    texts = [r.text for r in clean.orderBy("doc_id").limit(40).collect()]
    insults = ["idiot", "i d i o t", "id-iot", "i.d.i.o.t", "idxiot", "MORON", "mo*ron", "stuupid", "worthlless", "disgusxting"]
    rows = [(10_000_000 + i, t) for i, t in enumerate(texts)]
    rows += [(20_000_000 + i, f"{insults[i % len(insults)]} {t} {insults[i % len(insults)]}") for i, t in enumerate(texts)]
    more = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.read.parquet(f"{large}/labels.parquet")
    found = toxicity.toxicity(docs.unionByName(more), labels).filter("doc_id >= 10000000").toPandas()
    assert (found[found.doc_id < 20_000_000].predicted == 0).mean() > 0.9
    assert (found[found.doc_id >= 20_000_000].predicted == 1).mean() >= 0.9


def test_toxicity_of_odd_documents(spark, docs, no_docs):
    marks = "doc_id long, toxic int, text string"
    labels = spark.createDataFrame([(4, 1, ""), (6, 0, ""), (None, 1, ""), (7, None, ""), (6, 0, "")], marks)
    for rows, known in ((docs, labels), (no_docs, labels), (docs, labels.limit(0))):
        found = toxicity.toxicity(rows, known).toPandas()
        assert len(found) == rows.count()
        assert found.score.between(0, 1).all()
