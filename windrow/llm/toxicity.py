"""Toxicity by a support vector machine over a subsequence string kernel, with Nyström landmarks.

Strings are compared by the subsequences of three letters that they share, also with gaps: each occurrence that spans m
letters weighs ``DECAY`` to the power m, up to ``SPAN`` letters, and a string is scaled by the norm of one of its length
without repeats. So letters put into a word leave most of its subsequences, and signs between letters are dropped
before. What is compared are the words of sentences, and single letters in a row as one word.

Training. Every sentence of a labelled training row carries the row's label. Words are counted in toxic and clean
sentences, over all rows. A sentence counts as toxic by its witness: a word that, itself or by its first letters, is in
toxic sentences far oftener than chance lets any of all words be. Words of clean sentences are the other class:
some by hash and, in each round, those that the model so far takes for toxic. What is fitted is bounded by ``WITNESSES``
and ``CLEAN``, whatever the number of rows. Landmarks are words of both classes; kernel values against them, made
orthonormal by the landmarks' own kernel, are the features of a linear machine with squared hinge loss, solved by Newton
steps. The machine is a sum over landmarks, thus over the subsequences of three letters, and is folded into one weight for
each of these; a word costs fifteen look-ups a letter, and nothing grows with the landmarks.

A text scores by its most toxic word and by how many words are on the toxic side, through a logistic curve fitted on at most ``CURVE_ROWS`` training rows of each label. So a word that clean texts hold by chance weighs less.
Texts are scored whole, slice by slice, each distinct word of a slice once; nothing is shuffled.

Defined results: texts without a word of three letters, null and empty ones among them, score what a word without any
known subsequence does. Rows without text or label train nothing; labels other than 1 are clean; a doc_id with several labels is
toxic if one of them is 1. Rows without doc_id score like others and train nothing. Without rows of both labels every score is the share of
toxic ones (0 without any). Repeated rows are counted and scored one by one. Words of more than ``LONG_WORD`` letters are
scored in overlapping pieces. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.llm.common import column, prepared, slices, split_words, stored

DECAY = 0.6
SPAN = 7
LONG_WORD = 24
STEMS = (4, 5, 6)
CHANCE = 0.01
# Bounds of what is fitted.
WITNESSES = 3000
CLEAN = 6000
LANDMARKS = 300
CURVE_ROWS = 2000
ROUNDS = 3
COST = 4.0
MOST_WEIGHT = 50.0
# Strings with one more letter that are made of each witness, and of all at most.
VARIANTS, MOST_VARIANTS = 8, 6000
GAPS = [(i, j) for j in range(2, SPAN) for i in range(1, j)]
MEASURED = ("margin", "n_toxic")
LEAST_SCORE = 0.3


def own_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of letters, lower-cased, and the row of each: what signs interrupt is one, and single letters in a row are."""
    words, rows = split_words(pc.utf8_lower(pc.fill_null(texts, "")))
    coded = words.dictionary_encode()
    bare = pc.replace_substring_regex(coded.dictionary, r"[^\pL]+", "")
    words = bare.take(coded.indices)
    sizes = pc.utf8_length(bare).to_numpy(zero_copy_only=False)[coded.indices.to_numpy(zero_copy_only=False)] if len(bare) else np.zeros(0, int)
    filled = np.flatnonzero(sizes)
    words, rows, sizes = words.take(pa.array(filled)), rows[filled], sizes[filled]
    single = sizes == 1
    goes_on = single[1:] & single[:-1] & (rows[1:] == rows[:-1])
    begins = np.flatnonzero(single & ~np.append(False, goes_on))
    ends = np.flatnonzero(single & ~np.append(goes_on, False)) + 1
    spelled = [(int(a), int(b)) for a, b in zip(begins, ends, strict=True) if b - a >= 3]
    long = np.flatnonzero(sizes > 2)
    joined = ["".join(words[a:b].to_pylist()) for a, b in spelled]
    all_words = pa.concat_arrays([words.take(pa.array(long)), pa.array(joined, words.type)])
    return all_words, np.append(rows[long], rows[[a for a, _ in spelled]].astype(rows.dtype))


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words one after another, and the word of each; longer words in overlapping pieces."""
    pieces, owner = [], []
    step = LONG_WORD - SPAN + 1
    for i, word in enumerate(words):
        if len(word) <= LONG_WORD:
            pieces.append(word)
            owner.append(i)
        else:
            cut = [word[at : at + LONG_WORD] for at in range(0, len(word) - SPAN + 1, step)]
            pieces += cut
            owner += [i] * len(cut)
    codes = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    return codes, np.repeat(np.arange(len(pieces)), sizes), np.array(owner, np.int64), sizes


def norms(sizes: np.ndarray) -> np.ndarray:
    """Norm of a string without repeated subsequences, by its length."""
    square = np.zeros(len(sizes))
    for _, j in GAPS:
        square += np.maximum(sizes - j, 0) * DECAY ** (2 * (j + 1))
    return np.sqrt(np.maximum(square, 1e-12))


class Alphabet:
    """Small numbers for the letters that landmarks have; 0 for all else."""

    def __init__(self, words: list[str]):
        self.codes = np.array(sorted({ord(c) for w in words for c in w}), np.uint32)
        self.size = len(self.codes) + 1

    def numbers(self, codes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.codes, codes).clip(max=len(self.codes) - 1)
        return np.where(self.codes[at] == codes, at + 1, 0).astype(np.int64)

    def triples(self, numbers: np.ndarray, piece: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """For each pair of gaps: the pieces and subsequences at every place that holds known letters, and the weight."""
        n = len(numbers)
        for i, j in GAPS:
            if n <= j:
                continue
            a, b, c = numbers[: n - j], numbers[i : n - j + i], numbers[j:]
            own = np.flatnonzero((piece[: n - j] == piece[j:]) & (a > 0) & (b > 0) & (c > 0))
            yield piece[own], (a[own] * self.size + b[own]) * self.size + c[own], DECAY ** (j + 1)


class Machine:
    """Folded machine: a weight for each subsequence of three letters, the offset, and the curve to a score."""

    def __init__(self, alphabet: Alphabet, weights: dict | np.ndarray, offset: float):
        self.alphabet, self.offset = alphabet, offset
        self.triples, self.values = weights
        self.curve = np.array([1.0, 0.0, 0.0, 0.0])

    def margins(self, words: list[str]) -> np.ndarray:
        """Distance of each word from the boundary, above 0 on the toxic side."""
        if not words:
            return np.zeros(0)
        codes, piece, owner, sizes = letters(words)
        total = np.zeros(len(sizes))
        for where, triple, weight in self.alphabet.triples(self.alphabet.numbers(codes), piece):
            at = np.searchsorted(self.triples, triple).clip(max=len(self.triples) - 1)
            known = self.triples[at] == triple
            total += np.bincount(where[known], self.values[at[known]], len(sizes)) * weight
        margin = total / norms(sizes) + self.offset
        out = np.full(len(words), -np.inf)
        np.maximum.at(out, owner, margin)
        return out


def kernel(words: list[str], alphabet: Alphabet, triples: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Kernel values of each word with each landmark; ``landmarks`` has their features by rows of ``triples``."""
    out = np.zeros((len(words), landmarks.shape[1]))
    for at in range(0, len(words), 500):
        codes, piece, owner, sizes = letters(words[at : at + 500])
        found = np.zeros((len(sizes), len(triples)))
        for where, triple, weight in alphabet.triples(alphabet.numbers(codes), piece):
            place = np.searchsorted(triples, triple).clip(max=len(triples) - 1)
            known = triples[place] == triple
            np.add.at(found, (where[known], place[known]), weight)
        values = found @ landmarks / norms(sizes)[:, None]
        np.maximum.at(out[at : at + 500], owner, values)
    return out


def features(words: list[str], alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray]:
    """Subsequences of the words in order, and the scaled weight of each (rows) in each word (columns)."""
    codes, piece, owner, sizes = letters(words)
    parts = [(w, t, np.full(len(w), g)) for w, t, g in alphabet.triples(alphabet.numbers(codes), piece)]
    where, triple, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
    triples, place = np.unique(triple, return_inverse=True)
    out = np.zeros((len(triples), len(words)))
    np.add.at(out, (place, owner[where]), weight / norms(sizes)[where])
    return triples, out


def separated(points: np.ndarray, sign: np.ndarray, weight: np.ndarray, cost: float = COST) -> np.ndarray:
    """Linear machine with squared hinge loss by Newton steps; the last number is the offset."""
    x = np.hstack([points, np.ones((len(points), 1))])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(50):
        slack = 1 - sign * (x @ w)
        inside = slack > 0
        near, c = x[inside], cost * weight[inside]
        gradient = ridge @ w - near.T @ (c * sign[inside] * slack[inside])
        step = np.linalg.solve(ridge + (near * c[:, None]).T @ near, gradient)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def varied(words: list[str], seed: int = 7) -> list[str]:
    """Words with a letter of another one put in, or with one doubled, at drawn places."""
    draw = np.random.default_rng(seed)
    out = []
    for i in range(min(VARIANTS * len(words), MOST_VARIANTS)):
        word = words[i % len(words)]
        at = int(draw.integers(1, len(word)))
        other = words[int(draw.integers(len(words)))]
        put = word[at - 1] if i // len(words) % 4 == 0 else other[int(draw.integers(len(other)))]
        out.append(word[:at] + put + word[at:])
    return out


def fitted(toxic: dict[str, int], clean: dict[str, int], landmarks: int = LANDMARKS) -> Machine:
    """The machine that tells these words apart, each by how many sentences hold it; both classes weigh the same."""
    more = varied(list(toxic))
    heavy = np.append(np.minimum(list(toxic.values()), MOST_WEIGHT), np.full(len(more), 1.0))
    light = np.minimum(list(clean.values()), MOST_WEIGHT)
    weight = np.append(heavy * (light.sum() / heavy.sum()), light)
    toxic, clean = [*toxic, *more], list(clean)
    words = toxic + clean
    sign = np.append(np.ones(len(toxic)), -np.ones(len(clean)))
    half = landmarks // 2
    marks = sorted({*toxic[:: max(1, len(toxic) // half)][:half], *clean[:: max(1, len(clean) // half)][:half]})
    alphabet = Alphabet(marks)
    triples, of_marks = features(marks, alphabet)
    values, vectors = np.linalg.eigh(of_marks.T @ of_marks)
    own = values > 1e-6 * values.max()
    root = vectors[:, own] / np.sqrt(values[own])
    w = separated(kernel(words, alphabet, triples, of_marks) @ root, sign, weight)
    folded = of_marks @ (root @ w[:-1])
    return Machine(alphabet, (triples, folded), float(w[-1]))


def counted(rows: DataFrame) -> DataFrame:
    """``rows(text, toxic boolean)`` to ``(word, toxic, clean)``: in how many sentences of either label each word is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            lists = pc.split_pattern_regex(column(part, "text"), r"[.!?]+\s+|\n+")
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            label = np.repeat(column(part, "toxic").to_numpy(zero_copy_only=False).astype(bool), sizes)
            words, sentence = own_words(pc.list_flatten(lists))
            coded = words.dictionary_encode()
            pairs = np.unique(sentence.astype(np.int64) * max(len(coded.dictionary), 1) + coded.indices.to_numpy(zero_copy_only=False))
            sentence, word = np.divmod(pairs, max(len(coded.dictionary), 1))
            n = len(coded.dictionary)
            toxic = np.bincount(word[label[sentence]], minlength=n)
            clean = np.bincount(word[~label[sentence]], minlength=n)
            yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(toxic), pa.array(clean)], names=["word", "toxic", "clean"])

    parts = rows.mapInArrow(run, "word string, toxic long, clean long")
    return parts.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def chance(toxic: Column, clean: Column, share: float) -> Column:
    """Logarithm of a bound on the chance that so many of the sentences with a word are toxic, at the whole share of them."""
    n, k = toxic + clean, toxic
    # Chernoff: n times the divergence of the word's share from the whole one.
    p = k / n
    rest = F.when(k < n, (1 - p) * F.log((1 - p) / F.lit(1 - share))).otherwise(0.0)
    return F.when(p > share, -n * (p * F.log(p / F.lit(share)) + rest)).otherwise(0.0)


def witnesses(words: DataFrame, most: int = WITNESSES) -> dict[str, int]:
    """Words of toxic sentences that are no chance, by themselves or by their first letters, the most frequent first."""
    total = words.agg(F.sum("toxic"), F.sum("clean"), F.count(F.lit(1))).first()
    if not total[0] or not total[1]:
        return {}
    share = total[0] / (total[0] + total[1])
    least = float(np.log(CHANCE / (total[2] * (1 + len(STEMS)))))
    names = F.array(F.col("word"), *(F.when(F.length("word") > n, F.substring("word", 1, n)) for n in STEMS))
    named = words.withColumn("name", F.explode(F.array_distinct(F.array_compact(names))))
    sums = named.groupBy("name").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # A name of a few clean sentences may have lost them to a wrong label; one of many is common.
    sure = sums.filter((chance(F.col("toxic"), F.col("clean"), share) < least) & (F.col("clean") * 10 <= F.col("toxic")))
    sure = sure.orderBy(F.desc("toxic"), "name").limit(most).select("name")
    mine = named.join(sure, "name").filter(F.col("toxic") > F.col("clean")).select("word", "toxic").distinct()
    return {r.word: r.toxic for r in mine.orderBy(F.desc("toxic"), "word").limit(most).collect()}


def hardest(words: DataFrame, machine: Machine, known: dict[str, int], most: int) -> dict[str, int]:
    """Clean words that the machine puts furthest on the toxic side."""
    shared = words.sparkSession.sparkContext.broadcast((machine, frozenset(known)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, known = shared.value
        for batch in batches:
            own = batch.filter(pa.array([w not in known for w in batch.column("word").to_pylist()], pa.bool_()))
            margin = machine.margins(own.column("word").to_pylist())
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(margin)], names=["word", "clean", "margin"])

    found = words.filter("clean > 0").select("word", "clean").mapInArrow(run, "word string, clean long, margin double")
    return {r.word: r.clean for r in found.orderBy(F.desc("margin"), "word").limit(most).collect()}


def curve(measured: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Factors of the logistic curve over the columns measured, and its shift, by damped Newton steps on smoothed labels."""
    n1, n0 = toxic.sum(), (~toxic).sum()
    target = np.where(toxic, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.hstack([measured, np.ones((len(measured), 1))])
    w = np.append(1.0, np.zeros(x.shape[1] - 1))
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - target) + 1e-2 * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, gradient)
        w = w - step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-6:
            break
    return w


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def measured(docs: DataFrame, machine: Machine) -> DataFrame:
    """``docs(text, ...)``, text replaced by the margin of its most toxic word and the logarithm of how many are toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    carried = [f for f in docs.schema.fields if f.name != "text"]
    names = [f.name for f in carried]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in carried) + ", margin double, n_toxic double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for part in slices(batches, "text"):
            texts = column(part, "text")
            words, rows = own_words(texts)
            coded = words.dictionary_encode()
            margin = machine.margins(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
            most = np.full(len(texts), machine.offset)
            np.maximum.at(most, rows, margin)
            found = map(pa.array, (most, np.log1p(np.bincount(rows[margin > 0], minlength=len(texts)))))
            yield pa.RecordBatch.from_arrays([*(column(part, n) for n in names), *found], names=[*names, *MEASURED])

    return docs.mapInArrow(run, schema)


def fit(rows: DataFrame, marks: DataFrame) -> Machine | float:
    """``rows(doc_id, text)`` and ``marks(doc_id, toxic boolean)`` to a machine, or the share of toxic rows if no word tells.

    Texts meet their labels once, by the same join at every size, as labels grow with the rows.
    """
    ids = stored(rows.select("doc_id").join(marks.hint("merge"), "doc_id"), "labelled")
    sizes = ids.agg(F.count_if("toxic"), F.count_if(~F.col("toxic"))).first()
    share = sizes[0] / max(1, sizes[0] + sizes[1])
    words = stored(counted(rows.join(marks.hint("merge"), "doc_id").select("text", "toxic")), "words")
    toxic = witnesses(words)
    if not toxic:
        return share
    drawn = words.filter("clean > 0").orderBy(F.xxhash64("word"), "word").limit(CLEAN).collect()
    clean = {r.word: r.clean for r in drawn if r.word not in toxic}
    if not clean:
        return share
    machine = fitted(toxic, clean)
    for _ in range(ROUNDS - 1):
        clean |= hardest(words, machine, toxic, CLEAN // 4)
        machine = fitted(toxic, clean)
    drawn = ids.distinct().withColumn("draw", F.xxhash64("doc_id"))
    sample = [drawn.filter(label).orderBy("draw", "doc_id").limit(CURVE_ROWS) for label in (F.col("toxic"), ~F.col("toxic"))]
    sample = stored(sample[0].unionByName(sample[1]).select("doc_id", "toxic"), "sample")
    seen = measured(rows.join(F.broadcast(sample), "doc_id").select("toxic", "text"), machine).toPandas()
    machine.curve = curve(seen[list(MEASURED)].to_numpy(), seen["toxic"].to_numpy().astype(bool))
    return machine


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: whether it was held out, its score, and whether that is ``LEAST_SCORE`` or more.

    Learns from ``labels(doc_id, toxic)`` of rows that are not held out.
    """
    prepared(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    marks = labels.select(F.col("doc_id").cast("long"), (F.col("toxic") == 1).alias("toxic")).dropna()
    marks = marks.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = rows.filter(F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    machine = fit(known, marks)
    rows = rows.withColumn("held_out", held_out(F.col("doc_id")))
    if isinstance(machine, float):
        found = rows.select("doc_id", "held_out", F.lit(machine).alias("score"))
    else:
        *factors, shift = machine.curve.tolist()
        height = sum((F.lit(f) * F.col(c) for f, c in zip(factors, MEASURED, strict=True)), F.lit(shift))
        found = measured(rows, machine).select("doc_id", "held_out", (1 / (1 + F.exp(-height))).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= LEAST_SCORE).cast("int"))
