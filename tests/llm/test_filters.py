"""Decontamination, quality rules, licenses, language: what is said of each document alone."""

import hashlib
import math
from collections import Counter

import brute
import odd
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from windrow.llm import decontaminate, fertility, language, licenses
from windrow.llm.queries import op5_language, tokenizer_file

ITEMS = [
    (1, odd.PASSAGE),
    (2, "one"),
    (3, None),
    (4, ""),
    (None, "release under the mit"),
    (5, odd.PASSAGE),
    (5, odd.PASSAGE),
    (6, "Été"),
]


def items(spark, rows=ITEMS):
    return spark.createDataFrame(rows, "item_id long, text string")


def rows(frame, *columns):
    return Counter(tuple(r) for r in frame.select(*columns).collect()) if columns else Counter(map(tuple, frame.collect()))


def test_contamination_of_odd_documents(spark, docs):
    want = Counter(brute.contamination([(r[0], r[1]) for r in odd.TEXTS], ITEMS))
    assert rows(decontaminate.contamination(docs, items(spark))) == want


def test_contamination_in_blocks_of_windows(spark, docs):
    narrow = docs.select("doc_id", "text")
    one = decontaminate.hits(narrow, items(spark)).select("doc_id", "text", "n_words", "spans", "items")
    many = decontaminate.hits(narrow, items(spark), most=7).select(one.columns)
    as_text = lambda f: Counter(str(r) for r in f.collect())
    assert as_text(one) == as_text(many)


def test_contamination_of_supplied_documents(spark, small):
    docs, marks = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute.contamination([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in marks.collect()])
    assert rows(decontaminate.contamination(docs, marks)) == Counter(want)
    assert any(x[-1] for x in want)


def test_clean_documents_keep_their_columns(spark, docs, no_docs):
    clean = decontaminate.clean(docs, items(spark))
    assert clean.columns == docs.columns and clean.filter("size != 'clash'").isEmpty()
    bad = {r[0] for r in brute.contamination([(r[0], r[1]) for r in odd.TEXTS], ITEMS) if r[-1]}
    assert {r.doc_id for r in clean.collect()} == {r[0] for r in odd.TEXTS} - bad
    assert decontaminate.clean(no_docs, items(spark)).isEmpty()
    assert decontaminate.clean(docs, items(spark, [])).count() == len(odd.TEXTS)


@settings(max_examples=200, deadline=None)
@given(
    st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=6), min_size=1, max_size=6),
    st.lists(st.sampled_from("abcd"), max_size=40),
)
def test_search_finds_every_occurrence(patterns, words):
    search = decontaminate.Search([(p, [str(i)]) for i, p in enumerate({tuple(p): p for p in patterns}.values())])
    spans, _ = search.find([w.encode() for w in words])
    hit = {i + k for p in patterns for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p for k in range(len(p))}
    assert {i for a, b in spans for i in range(a, b)} == hit


def test_base_counts(spark, docs, small):
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    for frame in (docs, spark.read.parquet(f"{small}/documents.parquet")):
        got = rows(fertility.measure(frame, tokenizer_file("piece_bpe_32k.model")), "doc_id", *columns)
        assert got == Counter((r.doc_id, *brute.base_counts(r.text)) for r in frame.collect())


def test_token_measures(spark, docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    found = fertility.measure(docs.filter("doc_id is not null"), model_path()).collect()
    text = {r[0]: r[1] for r in odd.TEXTS}
    for r in found:
        words = brute.BLANK.findall(text[r.doc_id] or "")
        tokens = [t for w in words for t in model.encode(w)]
        assert r.n_tokens == len(tokens)
        share = sum(map(model.is_byte, tokens)) / max(len(tokens), 1)
        entropy = -sum(n / len(tokens) * math.log2(n / len(tokens)) for n in Counter(tokens).values())
        assert (r.byte_share, r.token_entropy) == (pytest.approx(share), pytest.approx(entropy, abs=1e-9))
        assert r.chars_per_token == pytest.approx(sum(map(len, words)) / max(len(tokens), 1))


def model_path():
    return tokenizer_file("piece_bpe_32k.model")


def test_words_with_the_start_mark_are_told_apart():
    vocab = fertility.vocabulary(model_path())
    words = ["a", "▁", "b▁c", "中", "d"]
    flat, sizes = vocab.encode(words)
    assert [list(x) for x in zip(flat, strict=True)] and list(flat) == [t for w in words for t in vocab.model.encode(w)]
    assert list(sizes) == [len(vocab.model.encode(w)) for w in words]


def test_bands_reject(spark):
    rows = [(1, "中文" * 100 + " x" * 60, "en"), (2, "ab " * 100, "en"), (3, odd.BASE, "en"), (4, odd.BASE, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    strict = {**fertility.BANDS, "en": (1.0, 9.0, 0.05, 3.0)}
    kept = {r.doc_id: r.kept for r in fertility.measure(docs, model_path(), strict).collect()}
    assert kept == {1: False, 2: False, 3: True, 4: True}


def test_second_vocabulary(spark, docs):
    from windrow.llm.queries import second_vocabulary

    file = second_vocabulary()
    coder = fertility.vocabulary(file).coder
    found = fertility.measure(docs.filter("doc_id is not null"), model_path(), second=file).collect()
    text = {r[0]: r[1] for r in odd.TEXTS}
    for r in found:
        words = brute.BLANK.findall(text[r.doc_id] or "")
        tokens = coder.encode_ordinary("".join(" " + w for w in words))
        assert r.chars_per_token_2 == pytest.approx(sum(map(len, words)) / max(len(tokens), 1))


def test_floors_keep_clean_and_reject_junk(spark):
    """Fitted to two thirds of the labelled documents, judged on the others."""
    from windrow.llm.queries import second_vocabulary

    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    second = second_vocabulary()
    floors = fertility.fitted_floors(docs, labels.filter("crc32(string(doc_id)) % 3 != 1"), model_path(), second)
    assert set(floors) == {"en", "de", "es", "fr"}
    others = docs.join(labels.filter("crc32(string(doc_id)) % 3 = 1"), "doc_id", "left_semi")
    judged = fertility.measure(others, model_path(), second=second, floors=floors).filter("not base_failed").join(labels, "doc_id")
    share = judged.groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept"))
    kept = {r.quality: r.kept for r in share.collect()}
    assert kept[1] >= 0.98 and kept[0] <= 0.05


def test_verdicts_by_floors(spark, docs, no_docs):
    """Each floor alone, against the same rule in plain Python; bands without floors keep the wide ones."""
    from windrow.llm.queries import second_vocabulary

    second = second_vocabulary()
    plain = fertility.measure(docs, model_path(), second=second)
    some = [r for r in plain.collect() if not r.base_failed and r.band in ("en", "de")]
    for at in range(3):
        middle = sorted((r.chars_per_token, r.chars_per_token_2, r.token_entropy - 5 / r.n_tokens**0.5)[at] for r in some)[len(some) // 2]
        low = fertility.Floors(*(middle if i == at else -100.0 for i in range(3)), 5.0)
        got = fertility.measure(docs, model_path(), second=second, floors={"en": low, "de": low})

        def kept(r, low=low):
            reached = r.chars_per_token >= low[0] and r.chars_per_token_2 >= low[1] and r.token_entropy >= low[2] + 5 / max(r.n_tokens, 1) ** 0.5
            return r.kept and (reached or r.band not in ("en", "de"))

        assert rows(got, "doc_id", "kept") == Counter((r.doc_id, kept(r)) for r in plain.collect())
    labels = spark.createDataFrame([(1, 1), (None, 1), (4, None), (4, 0)], "doc_id long, quality int")
    assert fertility.fitted_floors(docs, labels, model_path(), second) == {}
    assert fertility.fitted_floors(no_docs, labels, model_path(), second) == {}
    five = spark.createDataFrame([(4, 1), (5, 1), (14, 1), (18, 1), (19, 1)], "doc_id long, quality int")
    floors = fertility.fitted_floors(docs, five, model_path(), second, least=3)
    assert set(floors) == {"en"}
    assert rows(fertility.measure(docs, model_path(), second=second, floors=floors).filter("kept and band = 'en'"), "doc_id")


def test_floors_of_all_labelled_documents(spark, docs):
    """More labelled documents than a bounded sample of them would hold."""
    from windrow.llm.queries import second_vocabulary

    n, second = 20_100, second_vocabulary()
    many = spark.range(n).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 60), i -> concat('word', hash(id, i) % 99))) AS text", "'en' AS lang")
    labels = many.selectExpr("doc_id", "1 AS quality")
    assert set(fertility.fitted_floors(many, labels, model_path(), second, least=n)) == {"en"}
    five = spark.createDataFrame([(4, 1), (5, 1), (14, 1), (18, 1), (19, 1)], "doc_id long, quality int")
    for marks in (five, labels):
        floors = fertility.fitted_floors(docs, marks, model_path(), second)
        want = rows(fertility.measure(docs, model_path(), second=second, floors=floors), "doc_id", "kept")
        assert rows(fertility.measure(docs, model_path(), second=second, labels=marks), "doc_id", "kept") == want
        kept = fertility.passed(docs, model_path(), second=second, labels=marks)
        assert kept.columns == docs.columns
        assert rows(kept, "doc_id") == _kept(want)


def _kept(judged):
    """How many rows of each id are kept."""
    found = Counter()
    for (doc_id, kept), n in judged.items():
        found[(doc_id,)] += n if kept else 0
    return +found


def test_passed_keeps_columns(spark, docs, no_docs):
    kept = fertility.passed(docs, model_path())
    verdict = rows(fertility.measure(docs, model_path()).filter("kept"), "doc_id")
    assert kept.columns == docs.columns and rows(kept, "doc_id") == verdict
    assert fertility.passed(no_docs, model_path()).isEmpty()
    assert fertility.measure(no_docs, model_path()).isEmpty()


def expected_license(doc_id, text):
    n, count, first, last, base = brute.phrases(text, licenses.PHRASES)
    more, best = brute.templates(text, licenses.template_sets(), licenses.STEP, *licenses.CONTAINMENT)
    return (doc_id, n, count, first, last, ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if count else best)


def test_every_notice_gets_its_own_label_alone(spark):
    """Also those that share nearly all of their words, in any neighbourhood of other text."""
    texts = [
        (2 * i + side, (odd.prose(i, 40) + " ") * side + text + " " + odd.prose(i + 50, 30), None, None)
        for i, (_, text) in enumerate(licenses.TEMPLATES)
        for side in (0, 1)
    ]
    found = {r.doc_id: r.labels for r in licenses.scan(odd.documents(spark, texts)).collect()}
    want = {2 * i + side: label for i, (label, _) in enumerate(licenses.TEMPLATES) for side in (0, 1)}
    assert found == want


def test_licenses(spark, docs, no_docs, small):
    extra = [
        (30 + i, odd.prose(i, 30 * i) + " " + text.upper() + " " + odd.prose(i, 20), None, None)
        for i, (_, text) in enumerate(licenses.TEMPLATES)
    ]
    gapped = " ".join(w for i, w in enumerate(licenses.TEMPLATES[0][1].split()) if i % 8)
    extra += [(50, gapped, None, None), (50, gapped, None, None), (51, gapped[: len(gapped) // 2], None, None)]
    all_rows = odd.TEXTS + extra
    got = rows(licenses.scan(odd.documents(spark, all_rows)))
    assert got == Counter(expected_license(r[0], r[1]) for r in all_rows)
    assert {"mit", "gpl", "bsd", "mpl-2"} <= {x for r in got for x in r[6].split(",")}
    assert licenses.scan(no_docs).isEmpty()
    supplied = spark.read.parquet(f"{small}/documents.parquet")
    assert rows(licenses.scan(supplied)) == Counter(expected_license(r.doc_id, r.text) for r in supplied.collect())


def test_license_scan_runs_no_python(docs):
    plan = licenses.scan(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_language_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    found = op5_language(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id")
    pairs = [(r.lang, r.lang_pred) for r in found.filter("held_out").collect()]
    assert len(pairs) > 200 and sum(a == b for a, b in pairs) / len(pairs) > 0.97


def test_language_of_odd_documents(spark, docs, no_docs):
    found = language.identify(docs).collect()
    assert len(found) == len(odd.TEXTS)
    by_text = {(r.doc_id, r.lang_pred, r.score) for r in found if r.doc_id in (1, 2, 3, 13)}
    assert by_text == {(i, "und", 0.0) for i in (1, 2, 3, 13)}
    assert all(0 <= r.score <= 1 and r.held_out is not None for r in found)
    assert {r.lang_pred for r in found} <= {"und", "en", "de", "fr", "xx"}
    assert language.identify(no_docs).isEmpty()
    silent = odd.documents(spark, [(2, "some text", None, None)])
    assert [(r.lang_pred, r.score) for r in language.identify(silent).collect()] == [("und", 0.0)]


def test_limits_of_all_training_texts(spark):
    """Every training text counts for the limit of its language, by exact rank."""
    bits = [float((i * 7919) % 25_013) for i in range(25_013)]
    rows = [("en", "en", b) for b in bits] + [("de", "de", b) for b in (3.0, 1.0, 2.0)] + [("de", "en", 9e9), (None, "en", 9e9)]
    found = spark.createDataFrame(rows, "lang string, lang_pred string, bits_per_char double")
    assert language.accepted_bits(found) == {"en": float(math.ceil(0.999 * 25_013) - 1), "de": 3.0}
    assert language.accepted_bits(found.limit(0)) == {}


def test_accepted_documents(spark):
    """Of thousands of texts of a language, one in a thousand costs more than its limit: no more, and no fewer."""
    text = "concat_ws(' ', transform(sequence(1, 8), i -> substring(md5(concat(id, ' ', i)), 1, 5)))"
    docs = spark.range(4500).selectExpr("id AS doc_id", f"{text} AS text", "'en' AS lang")
    found = language.identify(docs).cache()
    training = found.filter("not held_out")
    n = training.count()
    assert n > 2500 and training.filter("not accepted").count() == n - math.ceil(0.999 * n)


def kneser_ney(texts, order):
    """Probability of the last character of any run, as the definition has it."""
    grams = [Counter() for _ in range(order + 1)]
    for text in texts:
        line = " " * (order - 1) + text + " "
        grams[order].update(line[i : i + order] for i in range(len(line) - order + 1))
    for n in range(order - 1, 0, -1):
        grams[n] = Counter(g[1:] for g in grams[n + 1])
    discount = [0.75] * (order + 1)
    for n in range(1, order + 1):
        once, twice = (sum(v == k for v in grams[n].values()) for k in (1, 2))
        discount[n] = once / (once + 2 * twice) if once and twice else 0.75

    def p(run):
        if not run:
            return 1 / (len(grams[1]) + 1)
        own = {g: v for g, v in grams[len(run)].items() if g[:-1] == run[:-1]}
        total = sum(own.values())
        if not total:
            return p(run[1:])
        left = sum(min(discount[len(run)], v) for v in own.values()) / total
        return max(own.get(run, 0) - discount[len(run)], 0) / total + left * p(run[1:])

    return p


def test_model_is_interpolated_kneser_ney(spark):
    import numpy as np

    texts = ["abba cab", "abc abc abd", "bad cab", "dada"]
    frame = spark.createDataFrame([(t, "en") for t in texts] + [("xyz xyz", "fr")], "text string, lang string")
    models = language.Models.of(language.probabilities(language.run_counts(frame)))
    p = kneser_ney(texts, language.ORDER)
    for run in ("   ab", "abc a", "zzzzz", "cab a", "d da ", "bbbba"):
        chars = np.array([[ord(c) for c in run]], np.uint32)
        assert 2 ** -models.bits(chars)[0, models.langs.index("en")] == pytest.approx(p(run), rel=1e-4)


def test_a_smaller_model_still_adds_up(spark):
    import numpy as np

    frame = spark.createDataFrame([(odd.LONG, "en")], "text string, lang string")
    counts = language.run_counts(frame)
    whole = language.probabilities(counts).count()
    models = language.Models.of(language.probabilities(counts, most=whole // 2))
    assert sum(len(t[0]) for t in models.runs) <= whole // 2
    letters = sorted({c for c in odd.LONG.lower() if c.isalpha()} | {" "})
    for context in ("the ", "rive", "zzzz"):
        chars = np.array([[ord(c) for c in context + x] for x in letters], np.uint32)
        total = (2 ** -models.bits(chars)).sum()
        assert 0.9 < total <= 1.0001


def test_a_model_in_parts_keeps_every_run(spark, monkeypatch):
    import numpy as np

    odd_letters = "".join(chr(0x4E00 + i % 900) + chr(0x4E00 + i * 7 % 900) for i in range(1000))
    frame = spark.createDataFrame(
        [(1, odd.LONG, "en"), (2, "un été à la mer", "fr"), (3, odd_letters, "zh"), (4, odd.prose(8, 300), "en")],
        "doc_id long, text string, lang string",
    )
    p = language.probabilities(language.run_counts(frame))
    whole, parts = language.Models.of(p), language.Parts.of(p, size=500)
    assert len(parts.low) > 2 and len(parts.high) > 2 and whole.langs == parts.langs
    starts, _, _, chars, _ = language.runs_of([odd.LONG, odd_letters, "été unknown"])
    runs = chars[starts[:, None] + np.arange(language.ORDER)]
    assert np.allclose(parts.bits(runs), whole.bits(runs), rtol=1e-12)
    # A rare language's runs are all there, however many a table's others are: its own text is as cheap as alone.
    language.prepared(spark)
    monkeypatch.setattr(language.Parts.of, "__defaults__", (500,))
    alone = language.Models.of(language.probabilities(language.run_counts(frame.filter("lang = 'fr'"))))
    model, _ = language.fit(frame)
    first, _, _, own, _ = language.runs_of(["un été à la mer"])
    runs = own[first[:, None] + np.arange(language.ORDER)]
    fr = model.langs.index("fr")
    assert len(model.high) > 2 and np.allclose(model.bits(runs)[:, fr], alone.bits(runs)[:, 0], rtol=1e-6)


def test_digest_of_no_items_is_that_of_nothing():
    assert brute.contamination([(1, "a")], [])[0][4] == hashlib.sha256(b"").hexdigest()


def test_slices_hold_all_rows():
    from windrow.llm.common import slices

    texts = ["x" * n for n in (5, 0, 100, 3, 3, 3, 50, 1)] + [None]
    batch = pa.RecordBatch.from_pandas(pd.DataFrame({"text": texts, "n": range(len(texts))}), preserve_index=False)
    parts = list(slices(iter([batch, batch]), "text", 10))
    assert [n for p in parts for n in p["n"].to_pylist()] == [*range(len(texts))] * 2
    assert max(sum(len(t or "") for t in p["text"].to_pylist()) for p in parts if p.num_rows > 1) <= 10
