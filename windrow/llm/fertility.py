"""Quality rules by tokeniser fertility.

A public vocabulary with byte fallback is laid over every whole text. Three measures come out: characters per token,
share of tokens that are single fallback bytes, and entropy of the text's own token distribution in bits. A second
vocabulary, if given, adds its characters per token. A document is rejected if a measure leaves the band of its language;
a language without bands takes those of its script. Plain counts of words, symbols, repeated lines and repeated word
windows reject the rest.

The wide bands below hold for any corpus. Where enough documents are labelled as good, floors narrow their lower ends to what
all but a small share of these reach; as a longer text has more entropy, its floor is a line over the length. Floors come
from all labelled documents: every text is measured once, the floors from the measures of the labelled ones.

A text is encoded word by word with the word-start mark before each, which is how the vocabulary's pieces are laid
out: none spans white space. Each distinct word of a slice is encoded once.

Defined results: null and blank texts have no words, all counts 0 and measures 0, and fail the base rule. Repeated
rows are judged one by one. Extra columns are left out by ``measure`` and kept by ``passed``, whatever their names. A text
longer than a slice is measured alone and whole, with all of its words in memory. Empty or missing labels, and languages
with few of them, leave the wide bands as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.llm.common import column, per_row, prepared, schema_with, slices, split_words, stored, whole_row
from windrow.operators.ranks import quantiles

# Fixed values: (least and most characters per token, most byte-fallback share, least bits of entropy).
# Scripts that the vocabulary spells in bytes have few characters per token and many bytes by nature.
BANDS = {
    "en": (1.7, 9.0, 0.05, 4.5),
    "de": (1.7, 9.0, 0.05, 4.5),
    "es": (1.7, 9.0, 0.05, 4.5),
    "fr": (1.7, 9.0, 0.05, 4.5),
    "Latin": (1.3, 10.0, 0.15, 4.5),
    "Cyrillic": (1.0, 8.0, 0.25, 4.0),
    "Greek": (0.5, 6.0, 0.50, 3.5),
    "other": (0.25, 6.0, 1.00, 3.0),
}
# First code point, one past the last, script.
SCRIPTS = [(0x41, 0x250, "Latin"), (0x370, 0x400, "Greek"), (0x400, 0x530, "Cyrillic")]

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_tokens long, chars_per_token double, byte_share double, token_entropy double, chars_per_token_2 double, band string"
)
SYMBOLS = "[#*$%&|<>]"
WORD_MARK = "\u2581"
GROUP_WORDS = 500
CACHE_WORDS = 300_000
# Texts measured at a time in a task; a longer text is measured alone.
SLICE_BYTES = 2 << 20
# An odd multiplier that spreads bits.
MIX = np.uint64(0x9E3779B97F4A7C15)

# The fit: least labelled documents of a band that gets floors of its own, and the share of good documents below each floor.
LEAST_LABELLED = 100
TAIL = 0.002


class RankFile(NamedTuple):
    """A second vocabulary: a file of ranks, and the pattern that splits texts before its merges."""

    path: str
    pattern: str


class Floors(NamedTuple):
    """Lower ends of a band; the least entropy of a text of n tokens is ``entropy + slope / sqrt(n)``."""

    chars_per_token: float
    chars_per_token_2: float
    entropy: float
    slope: float


class Vocabulary:
    """A vocabulary, and the tokens of a bounded number of words seen before."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.size)])
        self.starts = np.array([self.model.id_to_piece(i).startswith(WORD_MARK) for i in range(self.size)])
        self.forget()

    def forget(self) -> None:
        self.places: dict[str, int] = {}
        self.flat, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words one after another, and how many each word has.

        Words go in together and are told apart by the pieces that start a word. Where these don't add up, as in words
        that hold the mark themselves, the group is encoded word by word.
        """
        flat, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), GROUP_WORDS):
            group = words[at : at + GROUP_WORDS]
            ids = np.array(self.model.encode(" ".join(group), num_threads=1), np.int64)
            begins = np.flatnonzero(self.starts[ids])
            if len(begins) == len(group) and begins[0] == 0:
                flat.append(ids)
                sizes.append(np.diff(np.append(begins, len(ids))))
            else:
                each = self.model.encode(group, num_threads=1)
                flat.append(np.array([i for ids in each for i in ids], np.int64))
                sizes.append(np.fromiter(map(len, each), np.int64, len(each)))
        return np.concatenate(flat), np.concatenate(sizes)

    def look_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A store of tokens, and where in it the tokens of each word begin and how many they are."""
        if len(self.places) > CACHE_WORDS:
            self.forget()
        fresh = [w for w in words if w not in self.places]
        if fresh:
            self.places.update(zip(fresh, range(len(self.places), len(self.places) + len(fresh)), strict=True))
            flat, sizes = self.encode(fresh)
            self.flat, self.sizes = np.append(self.flat, flat), np.append(self.sizes, sizes)
            self.begins = np.cumsum(self.sizes) - self.sizes
        at = np.fromiter((self.places[w] for w in words), np.int64, len(words))
        return self.flat, self.begins[at], self.sizes[at]


class RankVocabulary:
    """How many tokens of a rank file words have, each after a space; those of a bounded number of words are kept."""

    def __init__(self, file: RankFile):
        import base64

        import tiktoken

        with open(file.path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.coder = tiktoken.Encoding(file.path, pat_str=file.pattern, mergeable_ranks=ranks, special_tokens={})
        self.forget()

    def forget(self) -> None:
        self.sizes: dict[str, int] = {}

    def count(self, words: list[str]) -> np.ndarray:
        if len(self.sizes) > CACHE_WORDS:
            self.forget()
        for word in words:
            if word not in self.sizes:
                self.sizes[word] = len(self.coder.encode_ordinary(" " + word))
        return np.fromiter((self.sizes[w] for w in words), np.int64, len(words))


VOCABULARIES: dict[str | RankFile, Vocabulary | RankVocabulary] = {}


def vocabulary(file: str | RankFile) -> Vocabulary | RankVocabulary:
    """One of a worker process, kept between its tasks."""
    if file not in VOCABULARIES:
        VOCABULARIES[file] = RankVocabulary(file) if isinstance(file, RankFile) else Vocabulary(file)
    return VOCABULARIES[file]


def repeated_words(word_ids: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Words of each row inside windows of three that the row holds twice or more."""
    if len(word_ids) < 3:
        return np.zeros(n, np.int64)
    starts = np.flatnonzero(rows[2:] == rows[:-2])
    # A mixed key finds the windows that may repeat; only these are compared word by word.
    key = rows[starts].astype(np.uint64)
    for step in range(3):
        key = (key + word_ids[starts + step].astype(np.uint64)) * MIX
        key ^= key >> np.uint64(29)
    ordered = np.sort(key)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(n, np.int64)
    at = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    starts = starts[twice[at] == key]
    exact = np.stack([rows[starts], word_ids[starts], word_ids[starts + 1], word_ids[starts + 2]])
    order = np.lexsort(exact)
    same = (exact[:, order][:, 1:] == exact[:, order][:, :-1]).all(axis=0)
    often = starts[order[np.append(same, False) | np.append(False, same)]]
    hit = np.zeros(len(word_ids), bool)
    for step in range(3):
        hit[often + step] = True
    return per_row(rows[hit], n)


def repeated_lines(text: str | None) -> int:
    """Lines with a word that equal an earlier line."""
    if text is None or "\n" not in text:
        return 0
    seen, again = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\v\f\r"):
            again += line in seen
            seen.add(line)
    return again


def token_measures(
    vocab: Vocabulary, words: list[str], ids: np.ndarray, rows: np.ndarray, n: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, fallback-byte tokens and token entropy of each row."""
    if not len(ids):
        return np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    flat, begins, sizes = vocab.look_up(words)
    begins, sizes = begins[ids], sizes[ids]
    place = np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    token = flat[place]
    row = np.repeat(rows, sizes)
    tokens = per_row(row, n)
    fallback = per_row(row[vocab.is_byte[token]], n)

    ordered = np.sort(row * vocab.size + token)
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    share = np.diff(np.append(first, len(ordered)))
    owner = ordered[first] // vocab.size
    share = share / tokens[owner]
    entropy = np.bincount(owner, -share * np.log2(share), n)
    return tokens, fallback, entropy


def script_of(text: str | None) -> str:
    """Script of most letters, by the ranges above; ties and texts without letters are Latin."""
    counts = {"Latin": 0}
    for char in text or "":
        if char.isalpha():
            name = next((s for a, b, s in SCRIPTS if a <= ord(char) < b), "other")
            counts[name] = counts.get(name, 0) + 1
    return max(counts, key=lambda s: (counts[s], s == "Latin"))


def measured(
    batches: Iterator[pa.RecordBatch], path: str, bands: dict, second: RankFile | None = None
) -> Iterator[pa.RecordBatch]:
    """A row of measures for each row, behind the other columns of the batch."""
    vocab = vocabulary(path)
    ranks = vocabulary(second) if second else None
    for part in slices(batches, "text", SLICE_BYTES):
        texts, n = column(part, "text"), part.num_rows
        words, rows = split_words(texts)
        coded = words.dictionary_encode()
        ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        distinct = coded.dictionary.to_pylist()
        tokens, fallback, entropy = token_measures(vocab, distinct, ids, rows, n)
        chars = per_row(rows, n, pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False)[ids])
        some = np.maximum(tokens, 1)
        if ranks:
            others = per_row(rows, n, ranks.count(distinct)[ids])
            second_measure = pa.array(chars / np.maximum(others, 1))
        else:
            second_measure = pa.nulls(n, pa.float64())
        strings = texts.to_pylist()
        langs = column(part, "lang").to_pylist()
        measures = [
            pa.array(per_row(rows, n)),
            pa.array(chars),
            pc.cast(pc.fill_null(pc.count_substring_regex(texts, SYMBOLS), 0), pa.int64()),
            pa.array([repeated_lines(t) for t in strings], pa.int64()),
            pa.array(repeated_words(ids, rows, n)),
            pa.array(tokens),
            pa.array(chars / some),
            pa.array(fallback / some),
            pa.array(entropy),
            second_measure,
            pa.array([x if x in bands else script_of(t) for x, t in zip(langs, strings, strict=True)], pa.string()),
        ]
        carried = [c for c in part.column_names if c not in ("text", "lang")]
        yield pa.RecordBatch.from_arrays(
            [*(column(part, c) for c in carried), *measures],
            names=[*carried, *(x.split(" ")[0] for x in MEASURES.split(", "))],
        )
    # The worker goes on to other operators' tasks, which need not find its words there.
    for used in (vocab, ranks):
        if used:
            used.forget()
    pa.default_memory_pool().release_unused()


def measures(docs: DataFrame, vocabulary_path: str, bands: dict = BANDS, second: RankFile | None = None) -> DataFrame:
    """All counts and measures of every row of ``docs(doc_id, text, lang)``."""
    prepared(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    return rows.mapInArrow(lambda batches: measured(batches, vocabulary_path, bands, second), f"doc_id long, {MEASURES}")


def measure(
    docs: DataFrame,
    vocabulary_path: str,
    bands: dict = BANDS,
    second: RankFile | None = None,
    floors: dict[str, Floors] | None = None,
    labels: DataFrame | None = None,
) -> DataFrame:
    """All counts, measures and the two verdicts of every row of ``docs(doc_id, text, lang)``.

    With ``labels``, by the floors that fit these.
    """
    found = measures(docs, vocabulary_path, bands, second)
    if labels is not None:
        found = stored(found, "measures")
        floors = floors_of(found, labels)
    return verdicts(found, bands, floors)


def passed(
    docs: DataFrame,
    vocabulary_path: str,
    bands: dict = BANDS,
    second: RankFile | None = None,
    floors: dict[str, Floors] | None = None,
    labels: DataFrame | None = None,
) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns, whatever these are called.

    The row travels beside its text and language, so nothing is shuffled. With ``labels``, rows wait with their measures
    for the floors that fit these.
    """
    prepared(docs.sparkSession)
    rows = docs.select(whole_row(docs), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    schema = schema_with([rows.schema["row"]], MEASURES)
    found = rows.mapInArrow(lambda batches: measured(batches, vocabulary_path, bands, second), schema)
    if labels is not None:
        found = stored(found, "measures")
        floors = floors_of(found.select(F.col("row.doc_id").cast("long").alias("doc_id"), "*"), labels)
    return verdicts(found, bands, floors).filter("kept").select("row.*")


def good_ids(labels: DataFrame) -> DataFrame:
    """``doc_id`` of the documents which ``labels(doc_id, quality)`` calls good."""
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"))
    return good.distinct().hint("merge")


def fitted_floors(
    docs: DataFrame,
    labels: DataFrame,
    vocabulary_path: str,
    second: RankFile,
    bands: dict = BANDS,
    least: int = LEAST_LABELLED,
    tail: float = TAIL,
) -> dict[str, Floors]:
    """Floors of each band, from all documents that ``labels(doc_id, quality)`` calls good; no other is measured."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    chosen = chosen.join(good_ids(labels), "doc_id", "left_semi")
    return floors_of(measures(chosen, vocabulary_path, bands, second), labels, least, tail)


def floors_of(
    found: DataFrame, labels: DataFrame, least: int = LEAST_LABELLED, tail: float = TAIL
) -> dict[str, Floors]:
    """Floors of each band that holds at least ``least`` documents which ``labels(doc_id, quality)`` calls good.

    ``found`` has the measures of documents. Of each good id one row counts that passes the base rules. The driver gets a row
    a band. Floors are cut to few digits, so that a sum made in another order does not move them.
    """
    names = ["band", "chars_per_token", "chars_per_token_2", "token_entropy", "n_tokens"]
    rows = found.filter(~base_failed() & (F.col("n_tokens") > 0) & F.col("doc_id").isNotNull())
    rows = rows.select("doc_id", F.struct(*names).alias("m")).join(good_ids(labels), "doc_id", "left_semi")
    each = rows.groupBy("doc_id").agg(F.max("m").alias("m")).select("m.*")
    each = stored(each.withColumn("x", 1 / F.sqrt("n_tokens")), "fertility-good")
    lines = (
        each.groupBy("band")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.round(F.coalesce(F.regr_slope("token_entropy", "x"), F.lit(0.0)), 4).alias("slope"),
            F.round(F.coalesce(F.regr_intercept("token_entropy", "x"), F.avg("token_entropy")), 4).alias("level"),
        )
        .filter(F.col("n") >= least)
        .collect()
    )
    if not lines:
        return {}
    slope, level = (F.create_map(*[x for r in lines for x in (F.lit(r.band), F.lit(r[c]))])[F.col("band")] for c in ("slope", "level"))
    above = F.col("token_entropy") - level - slope * F.col("x")
    kinds = {"one": F.col("chars_per_token"), "two": F.col("chars_per_token_2"), "gap": above}
    values = F.array(*[F.struct(F.concat("band", F.lit(f" {k}")).alias("kind"), v.alias("value")) for k, v in kinds.items()])
    each = each.filter(F.col("band").isin([r.band for r in lines])).select(F.inline(values))
    low = {
        r.kind: r.low
        for r in quantiles(each, [tail], "kind", "value").select("kind", (F.floor(F.col("quantile") * 10_000) / 10_000).alias("low")).collect()
    }
    return {r.band: Floors(low[f"{r.band} one"], low[f"{r.band} two"], r.level + low[f"{r.band} gap"], r.slope) for r in lines}


def base_failed() -> Column:
    """Whether the plain counts reject a row of measures."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def verdicts(rows: DataFrame, bands: dict = BANDS, floors: dict[str, Floors] | None = None) -> DataFrame:
    """``base_failed`` by the plain counts, ``kept`` by these, the bands and, where a band has them, its floors."""

    def by_band(table: dict) -> Column:
        return F.create_map(*[x for k, v in sorted(table.items()) for x in (F.lit(k), F.array(*map(F.lit, v)))])[F.col("band")]

    limits = F.col("limits")
    inside = (
        F.col("chars_per_token").between(limits[0], limits[1])
        & (F.col("byte_share") <= limits[2])
        & (F.col("token_entropy") >= limits[3])
    )
    if floors:
        low = F.col("floors")
        rows = rows.withColumn("floors", by_band(floors))
        reached = (
            (F.col("chars_per_token") >= low[0])
            & F.coalesce(F.col("chars_per_token_2") >= low[1], F.lit(True))
            & (F.col("token_entropy") >= low[2] + low[3] / F.sqrt(F.greatest("n_tokens", F.lit(1))))
        )
        inside = inside & F.coalesce(reached, F.lit(True))
    return (
        rows.withColumn("limits", by_band(bands))
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & inside)
        .drop("limits", "floors")
    )
