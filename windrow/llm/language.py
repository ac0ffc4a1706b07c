"""Language identification by interpolated Kneser-Ney models of characters.

A text becomes its letters in lower case, with a blank for everything between them. Each language's model has runs of
up to five characters. The highest order is counted; a lower order counts in how many ways a run is preceded, as
Kneser-Ney asks. Each order gives up a discount, estimated from how many runs are seen once and twice, to the next.

Counting covers all training rows: tasks count their texts' runs, sums are aggregated before and after one shuffle. The
model is two sorted arrays of 64-bit hashes for all languages, runs with their discounted probabilities and contexts
with what they pass on. Every counted run is in it, so it grows with the training rows. It is dealt into parts of about
``PART_RUNS`` runs by the characters just before the last, which a run of five shares with all shorter runs and contexts
that its probability asks for: one character for the orders up to two, two for those above. Parts are files in the
shared folder; a task reads one after the other for each of its slices, or holds them if the model is no larger than
one, so neither the driver nor a task ever holds a larger model.

A text's language is the one whose model spends the fewest bits per character on it. Texts that cost more bits than
nearly all training texts of that language are marked as not accepted; all texts are scored once, and the limits come from
the training ones among them.

Defined results: null texts and texts without letters are ``und`` with score 0. Rows without language or text train
nothing; rows without ``doc_id`` count as training rows. Equal costs go to the first language by name. Repeated
rows are counted and judged one by one. Without any training row everything is ``und``.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrow.llm.common import column, prepared, schema_with, scratch, slices, stored

ORDER = 5
# Orders whose runs are dealt by one character, and those above by two.
LOW, HIGH = (1, 2), (3, 4, 5)
PART_RUNS = 1_500_000
ACCEPTED_SHARE = 0.999
UNKNOWN = "und"
BLANK = 0x20
FACTOR = np.uint64(0x100000001B3)
SPREAD = np.uint64(0x9E3779B97F4A7C15)
BLOCK_RUNS = 50_000
# Texts worked on at a time in a task, of which each character takes some eighty bytes meanwhile, and runs held there.
SLICE_BYTES = 2 << 20
HELD_RUNS = 400_000
TABLES: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Lower-case form of every letter by code point, a blank for all else."""
    if not TABLES:
        out = np.full(0x110000, BLANK, np.uint32)
        for code in range(0x110000):
            char = chr(code)
            if char.isalpha():
                low = char.lower()
                out[code] = ord(low) if len(low) == 1 else code
        TABLES.append(out)
    return TABLES[0]


def normal(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all texts, each behind ``ORDER - 1`` blanks and before one, the row of each, and letters per row."""
    joined = "".join(texts_or_empty := [t or "" for t in texts])
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, texts_or_empty), np.int64, len(texts))
    rows = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    chars = letters()[raw]
    blank = chars == BLANK
    count = np.bincount(rows[~blank], minlength=len(texts))
    # A blank stays where it ends a run of letters of the same text.
    stays = ~blank
    stays[1:] |= ~blank[:-1] & (rows[1:] == rows[:-1])
    chars, rows = chars[stays], rows[stays]
    own = np.bincount(rows, minlength=len(texts))
    open_end = np.zeros(len(texts), bool)
    ends = np.cumsum(own)
    some = own > 0
    open_end[some] = chars[ends[some] - 1] != BLANK
    total = np.where(some, ORDER - 1 + own + open_end, 0)
    out = np.full(int(total.sum()), BLANK, np.uint32)
    shift = (np.cumsum(total) - total + ORDER - 1) - (ends - own)
    out[np.arange(len(chars)) + shift[rows]] = chars
    return out, np.repeat(np.arange(len(texts), dtype=np.int32), total), count


def run_hashes(chars: np.ndarray, order: int) -> np.ndarray:
    """A 64-bit hash of each run of ``order`` characters."""
    n = max(len(chars) - order + 1, 0)
    out = np.full(n, order, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(order):
            out *= FACTOR
            out += chars[k : k + n]
            out ^= out >> np.uint64(29)
            out *= SPREAD
    return out


def runs_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all full runs, their rows and hashes, the characters, and the letters of each row."""
    chars, rows, count = normal(texts)
    hashes = run_hashes(chars, ORDER)
    starts = np.flatnonzero(rows[ORDER - 1 :] == rows[: len(hashes)]) if len(hashes) else np.zeros(0, np.int64)
    return starts, rows[starts], hashes[starts], chars, count


class RunCounts:
    """Counts of runs by language, kept for a task's texts up to a bounded number of them."""

    def __init__(self):
        self.langs: dict[str, int] = {}
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, texts: list[str | None], langs: list[str]) -> None:
        starts, rows, hashes, chars, _ = runs_of(texts)
        if not len(starts):
            return
        code = np.array([self.langs.setdefault(x, len(self.langs)) for x in langs], np.int64)
        lang = code[rows]
        with np.errstate(over="ignore"):
            codes, keys = pd.factorize(hashes ^ (lang.astype(np.uint64) * SPREAD))
        first = np.empty(len(keys), np.int64)
        first[codes] = np.arange(len(codes))
        block = chars[starts[first][:, None] + np.arange(ORDER)]
        self.parts.append((keys, np.bincount(codes), lang[first], block))
        self.held += len(keys)
        if self.held > HELD_RUNS:
            self.merge()

    def merge(self) -> None:
        """Equal runs become one entry."""
        keys, n, lang, block = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1]))
        own = order[first]
        self.parts = [(keys[own], np.add.reduceat(n[order], first), lang[own], block[own])]
        self.held = len(own)

    def take(self) -> pa.RecordBatch | None:
        """All counts as rows; begins anew."""
        if not self.parts:
            return None
        self.merge()
        ((_, n, lang, block),) = self.parts
        self.parts, self.held = [], 0
        text = block.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        runs = [text[i : i + ORDER] for i in range(0, len(text), ORDER)]
        names = pa.array(list(self.langs), pa.string()).take(pa.array(lang))
        return pa.RecordBatch.from_arrays([names, pa.array(runs, pa.string()), pa.array(n)], names=["lang", "run", "n"])


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = RunCounts()
    for part in slices(batches, "text", SLICE_BYTES):
        counts.add(column(part, "text").to_pylist(), column(part, "lang").to_pylist())
        if counts.held > HELD_RUNS // 2:
            yield counts.take()
    rest = counts.take()
    if rest is not None:
        yield rest


def run_counts(training: DataFrame) -> DataFrame:
    """How often each language's texts hold each run: ``(lang, run, n)``."""
    rows = training.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    parts = rows.mapInArrow(counted, "lang string, run string, n long")
    return parts.groupBy("lang", "run").agg(F.sum("n").alias("n"))


def probabilities(counts: DataFrame, most: int | None = None) -> DataFrame:
    """``(order, lang, run, p)``: discounted probability of the run's last character behind the others.

    All of them, unless ``most`` asks for a smaller model: then the orders above two lose their least counted runs.
    """
    orders = [counts.withColumn("order", F.lit(ORDER))]
    for order in range(ORDER - 1, 0, -1):
        shorter = orders[-1].select("lang", F.substring("run", 2, order).alias("run"))
        lower = shorter.groupBy("lang", "run").agg(F.count(F.lit(1)).alias("n")).withColumn("order", F.lit(order))
        orders.append(stored(lower, "runs"))
    runs = reduce(DataFrame.unionByName, orders)
    once, twice = F.count(F.when(F.col("n") == 1, 1)), F.count(F.when(F.col("n") == 2, 1))
    discounts = runs.groupBy("lang", "order").agg(
        F.when((once > 0) & (twice > 0), once / (once + 2 * twice)).otherwise(0.75).alias("discount")
    )
    context = F.substring("run", F.lit(1), F.col("order") - 1)
    runs = runs.withColumn("context", context)
    totals = runs.groupBy("lang", "order", "context").agg(F.sum("n").alias("total"))
    if most is not None:
        runs = most_counted(runs, most)
    return (
        runs.join(totals, ["lang", "order", "context"])
        .join(discounts, ["lang", "order"])
        .select("order", "lang", "run", (F.greatest(F.col("n") - F.col("discount"), F.lit(0.0)) / F.col("total")).alias("p"))
    )


def most_counted(runs: DataFrame, most: int) -> DataFrame:
    """At most ``most`` runs, those of the first two orders among them."""
    size = F.floor(F.log2("n") * 8).cast("int")
    sized = runs.groupBy("order", size.alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()
    short = sum(r.n for r in sized if r.order <= 2)
    least, room = 0, most - short
    for r in sorted((r for r in sized if r.order > 2), key=lambda r: -r["size"]):
        room -= r.n
        if room < 0:
            least = r["size"] + 1
            break
    return runs.filter((F.col("order") <= 2) | (size >= least))


def hashed(rows: DataFrame, langs: list[str]) -> DataFrame:
    """``(order, lang, run, context, deal, p)`` with languages by number, runs and contexts by hash, and what deals them."""
    number = {x: i for i, x in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            orders = batch.column("order").to_numpy(zero_copy_only=False)
            lang = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int16)
            text = batch.column("run")
            p = batch.column("p").to_numpy(zero_copy_only=False).astype(np.float32)
            for order in np.unique(orders).tolist():
                own = np.flatnonzero(orders == order)
                block = "".join(text.take(pa.array(own)).to_pylist()).encode("utf-32-le", "surrogatepass")
                chars = np.frombuffer(block, np.uint32).reshape(-1, order)
                columns = [
                    np.full(len(own), order, np.int16),
                    lang[own],
                    hash_columns(chars).view(np.int64),
                    hash_columns(chars[:, :-1]).view(np.int64),
                    dealing(chars, order).view(np.int64),
                    p[own],
                ]
                names = ["order", "lang", "run", "context", "deal", "p"]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=names)

    return rows.mapInArrow(run, "order short, lang short, run long, context long, deal long, p float")


def dealing(chars: np.ndarray, order: int) -> np.ndarray:
    """What deals the runs given as rows: a hash of the one or two characters before the last, 0 for the first order."""
    width = 0 if order == 1 else 1 if order in LOW else 2
    hashes = hash_columns(chars[:, chars.shape[1] - 1 - width : chars.shape[1] - 1])
    return hashes >> np.uint64(1) if width else np.zeros(len(chars), np.uint64)


class Models:
    """All languages' models: sorted hashes of runs and of contexts, each with language and value."""

    def __init__(self, langs: list[str], rows: pa.Table):
        self.langs = langs
        self.runs, self.contexts = [], []
        orders = rows.column("order").to_numpy()
        for order in range(1, ORDER + 1):
            own = np.flatnonzero(orders == order)
            lang, p = (rows.column(c).to_numpy()[own] for c in ("lang", "p"))
            run, context = (rows.column(c).to_numpy()[own].view(np.uint64) for c in ("run", "context"))
            self.runs.append(self.sorted(run, lang, p))
            # What a context doesn't spend on its known runs goes to the next order.
            by = np.lexsort((lang, context))
            context, spender = context[by], lang[by]
            first = np.flatnonzero(np.append(True, (context[1:] != context[:-1]) | (spender[1:] != spender[:-1])))[: len(by)]
            spent = np.add.reduceat(p[by].astype(float), first) if len(by) else np.zeros(0)
            self.contexts.append((context[first], spender[first], (1 - spent).astype(np.float32)))
            if order == 1:
                self.alphabet = np.bincount(lang, minlength=len(langs)) + 1.0

    @staticmethod
    def of(probabilities: DataFrame) -> Models:
        """The whole model in the driver; for one that is small."""
        langs = sorted(r.lang for r in probabilities.filter("order = 1").select("lang").distinct().collect())
        return Models(langs, hashed(probabilities, langs).toArrow())

    @staticmethod
    def sorted(hashes: np.ndarray, lang: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(hashes, kind="stable")
        return hashes[order], lang[order], value[order]

    def spread(self, table: tuple, hashes: np.ndarray, missing: float) -> np.ndarray:
        """A row per hash and a column per language."""
        keys, lang, value = table
        begin, end = np.searchsorted(keys, hashes, "left"), np.searchsorted(keys, hashes, "right")
        out = np.full((len(hashes), len(self.langs)), missing, np.float64)
        sizes = end - begin
        at = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        out[np.repeat(np.arange(len(hashes)), sizes), lang[at]] = value[at]
        return out

    def bits(self, chars: np.ndarray) -> np.ndarray:
        """Cost of the last character of each run (a row of ``chars``) in each language."""
        return -np.log2(np.maximum(self.raised(self.raised(None, chars, LOW), chars, HIGH), 1e-30))

    def raised(self, p: np.ndarray | None, chars: np.ndarray, orders: tuple[int, ...]) -> np.ndarray:
        """Probabilities of the last characters by these orders, from those of the orders below."""
        if p is None:
            p = np.broadcast_to(1 / self.alphabet, (len(chars), len(self.langs)))
        for order in orders:
            run = chars[:, ORDER - order :]
            passed = self.spread(self.contexts[order - 1], hash_columns(run[:, :-1]), 1.0)
            p = self.spread(self.runs[order - 1], hash_columns(run), 0.0) + passed * p
        return p


class Parts:
    """A model of any size: the files of its parts, those of the low orders and those of the high ones."""

    def __init__(self, langs: list[str], low: list[str | None], high: list[str | None], small: bool):
        self.langs, self.low, self.high, self.small = langs, low, high, small
        self.held: dict[str, Models] = {}

    @staticmethod
    def of(probabilities: DataFrame, size: int = PART_RUNS) -> Parts:
        """Deals the model's rows and writes a file for each part; the driver sees their names only."""
        spark = probabilities.sparkSession
        counts = {r.order: r.n for r in probabilities.groupBy("order").agg(F.count(F.lit(1)).alias("n")).collect()}
        langs = sorted(r.lang for r in probabilities.filter("order = 1").select("lang").distinct().collect())
        n_low, n_high = -(-counts.get(2, 0) // size) or 1, -(-sum(counts.get(o, 0) for o in HIGH) // size) or 1
        folder = scratch(spark, "parts")
        low = F.col("order") <= LOW[-1]
        # The first order goes to each low part.
        several = F.when(F.col("order") == 1, F.sequence(F.lit(0), F.lit(n_low - 1))).otherwise(
            F.array(F.when(low, F.col("deal") % n_low).otherwise(F.col("deal") % n_high).cast("int"))
        )
        rows = hashed(probabilities, langs).withColumn("low", low).withColumn("part", F.explode(several))

        def write(rows: pa.Table) -> pa.Table:
            path = f"{folder}/{uuid.uuid4().hex}"
            system, place = fs.FileSystem.from_uri(path)
            system.create_dir(place.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(place) as out:
                out.write(pickle.dumps(Models(langs, rows), protocol=5))
            return pa.table({"low": rows["low"][:1], "part": rows["part"][:1], "path": [path]})

        written = rows.groupBy("low", "part").applyInArrow(write, "low boolean, part int, path string").collect()
        paths = {(r.low, r.part): r.path for r in written}
        return Parts(
            langs,
            [paths.get((True, i)) for i in range(n_low)],
            [paths.get((False, i)) for i in range(n_high)],
            sum(counts.values()) <= size,
        )

    def part(self, path: str) -> Models:
        """A part read from its file; those of a small model stay in the task, of others the last one."""
        if path not in self.held:
            if not self.small:
                self.held.clear()
            system, place = fs.FileSystem.from_uri(path)
            with system.open_input_stream(place) as data:
                self.held[path] = pickle.loads(data.read())
        return self.held[path]

    def bits(self, chars: np.ndarray) -> np.ndarray:
        """Cost of the last character of each run (a row of ``chars``) in each language."""
        p = np.empty((len(chars), len(self.langs)))
        for paths, orders in ((self.low, LOW), (self.high, HIGH)):
            which = dealing(chars, orders[-1]) % np.uint64(len(paths))
            for number, path in enumerate(paths):
                if path is None:
                    continue
                own = np.flatnonzero(which == number)
                for at in range(0, len(own), BLOCK_RUNS):
                    block = own[at : at + BLOCK_RUNS]
                    below = None if orders is LOW else p[block]
                    p[block] = self.part(path).raised(below, chars[block], orders)
        for at in range(0, len(p), BLOCK_RUNS):
            p[at : at + BLOCK_RUNS] = -np.log2(np.maximum(p[at : at + BLOCK_RUNS], 1e-30))
        return p


def hash_columns(chars: np.ndarray) -> np.ndarray:
    """The hash of ``run_hashes`` for runs given as rows."""
    out = np.full(len(chars), chars.shape[1], np.uint64)
    with np.errstate(over="ignore"):
        for k in range(chars.shape[1]):
            out *= FACTOR
            out += chars[:, k]
            out ^= out >> np.uint64(29)
            out *= SPREAD
    return out


def costs(models: Parts, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits per character of each text in each language, characters that count, and letters."""
    starts, rows, hashes, chars, count = runs_of(texts)
    n = np.bincount(rows, minlength=len(texts))
    total = np.zeros((len(texts), len(models.langs)))
    if len(starts):
        codes, distinct = pd.factorize(hashes)
        first = np.empty(len(distinct), np.int64)
        first[codes] = np.arange(len(codes))
        bits = models.bits(chars[starts[first][:, None] + np.arange(ORDER)]).astype(np.float32)
        for lang in range(len(models.langs)):
            total[:, lang] = np.bincount(rows, np.ascontiguousarray(bits[:, lang])[codes], len(texts))
    return total / np.maximum(n, 1)[:, None], n, count


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(3)) == 1


def scored(docs: DataFrame, model: Parts, most_bits: dict[str, float] | None = None) -> DataFrame:
    """``docs(doc_id, text, ...)`` with prediction, score, cost and whether the cost is accepted."""
    carried = [f for f in docs.schema.fields if f.name != "text"]
    limits = most_bits or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            texts = column(part, "text").to_pylist()
            if model.langs:
                cost, n, count = costs(model, texts)
                best = cost.argmin(axis=1)
                least = cost[np.arange(len(texts)), best]
                odds = np.exp2(-np.minimum((cost - least[:, None]) * n[:, None], 1000)).sum(axis=1)
                clear = count > 0
                names = [model.langs[b] if c else UNKNOWN for b, c in zip(best, clear, strict=True)]
                score = np.where(clear, 1 / odds, 0.0)
            else:
                names, score, least = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            accepted = [x != UNKNOWN and c <= limits.get(x, np.inf) for x, c in zip(names, least, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    *(column(part, f.name) for f in carried),
                    pa.array(names, pa.string()),
                    pa.array(score, pa.float64()),
                    pa.array(least, pa.float64()),
                    pa.array(accepted, pa.bool_()),
                ],
                names=[*(f.name for f in carried), "lang_pred", "score", "bits_per_char", "accepted"],
            )

    found = "lang_pred string, score double, bits_per_char double, accepted boolean"
    return docs.mapInArrow(run, schema_with(carried, found))


def trained(training: DataFrame) -> Parts:
    """Models of ``training(doc_id, text, lang)``."""
    counts = stored(run_counts(training), "runs")
    return Parts.of(stored(probabilities(counts), "model"))


def accepted_bits(found: DataFrame) -> dict[str, float]:
    """The bits per character that ``ACCEPTED_SHARE`` of each language's texts stay within, by exact rank.

    Of ``found(lang, lang_pred, bits_per_char)``, texts predicted as what they are count. A sketch tells which ones are
    among the highest, twice as many as lie above the limit, and only these are ranked.
    """
    own = found.filter(F.col("lang") == F.col("lang_pred")).select("lang", "bits_per_char")
    low = F.percentile_approx("bits_per_char", 2 * ACCEPTED_SHARE - 1)
    n = F.count(F.lit(1))
    sizes = own.groupBy("lang").agg(low.alias("low"), (n - F.ceil(F.lit(ACCEPTED_SHARE) * n) + 1).alias("from_top"))
    high = own.join(F.broadcast(sizes), "lang").filter(F.col("bits_per_char") >= F.col("low"))
    high = high.groupBy("lang", "from_top", "bits_per_char").agg(F.count(F.lit(1)).alias("n"))
    down = F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("bits_per_char")))
    reached = high.withColumn("down", down).filter(F.col("down") >= F.col("from_top"))
    return {r.lang: r.bits for r in reached.groupBy("lang").agg(F.max("bits_per_char").alias("bits")).collect()}


def fit(training: DataFrame) -> tuple[Parts, dict[str, float]]:
    """Models of ``training(doc_id, text, lang)``, and the most bits per character that each language accepts."""
    models = trained(training)
    if not models.langs:
        return models, {}
    rows = training.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    return models, accepted_bits(stored(scored(rows, models).drop("doc_id"), "scored"))


def identify(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text, lang)``: whether it was held out, and what its text alone says."""
    prepared(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")
    ).withColumn("held_out", held_out(F.col("doc_id")))
    models = trained(rows.filter(~F.col("held_out")).select("doc_id", "text", "lang"))
    found = stored(scored(rows.select("doc_id", "held_out", "lang", "text"), models), "scored")
    limits = accepted_bits(found.filter(~F.col("held_out")))
    known = F.col("lang_pred") != UNKNOWN
    for lang, bits in sorted(limits.items()):
        known = known & ((F.col("lang_pred") != lang) | (F.col("bits_per_char") <= bits))
    return found.drop("lang").withColumn("accepted", known)
