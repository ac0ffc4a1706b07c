"""Raw events in and out: stream and history readers, JSON parsing and encoding, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.functions.time import bound
from windrow.schema import (
    DEVICE_TYPES,
    EVENT_SCHEMA,
    EVENT_TYPES,
    EVENTS_TOPIC,
    REQUIRED_EVENT_FIELDS,
    SCHEMA_VERSION,
)


def read_event_stream(
    spark: SparkSession,
    *,
    servers: str | None = None,
    folder: str | None = None,
    topic: str = EVENTS_TOPIC,
    starting: str = "latest",
    max_offsets: int | None = None,
    max_files: int | None = None,
) -> DataFrame:
    """Unbounded raw events in a ``value`` column, from a topic or from a folder of JSON lines.

    A trigger takes all there is, unless ``max_offsets`` of a topic or ``max_files`` of a folder bound it. Lost
    offsets are skipped.
    """
    if servers is not None:
        reader = (
            spark.readStream.format("kafka")
            .option("kafka.bootstrap.servers", servers)
            .option("subscribe", topic)
            .option("startingOffsets", starting)
            .option("failOnDataLoss", "false")
        )
        return (reader if max_offsets is None else reader.option("maxOffsetsPerTrigger", max_offsets)).load()
    reader = spark.readStream.format("text")
    return (reader if max_files is None else reader.option("maxFilesPerTrigger", max_files)).load(folder)


def read_event_history(
    spark: SparkSession,
    start,
    end,
    *,
    servers: str | None = None,
    folder: str | None = None,
    topic: str = EVENTS_TOPIC,
    starting_offsets: str = "earliest",
) -> DataFrame:
    """Parsed events with ``start <= timestamp <= end`` of all retained ones."""
    if servers is not None:
        raw = (
            spark.read.format("kafka")
            .option("kafka.bootstrap.servers", servers)
            .option("subscribe", topic)
            .option("startingOffsets", starting_offsets)
            .option("endingOffsets", "latest")
            .load()
        )
    else:
        raw = spark.read.format("text").load(folder)
    return in_range(parse_events(raw), start, end)


def in_range(events: DataFrame, start, end) -> DataFrame:
    """Events of ``[start, end]``, both inclusive, in UTC."""
    return events.filter(F.col("timestamp").between(bound(start), bound(end)))


def parse_events(raw: DataFrame) -> DataFrame:
    """Event columns of the JSON in ``value``; rows that are no event or have no user are dropped."""
    parsed = F.from_json(F.col("value").cast("string"), EVENT_SCHEMA)
    return raw.select(parsed.alias("event")).select("event.*").filter(F.col("user_id").isNotNull())


# Fields of an event record and the types they are read as; the two of ``location`` are inside it.
TYPED_FIELDS = {
    "event_id": "string",
    "user_id": "string",
    "session_id": "string",
    "event_type": "string",
    "timestamp": "timestamp",
    "transaction_amount": "double",
    "product_id": "string",
    "category": "string",
    "device_type": "string",
    "schema_version": "string",
}
LOCATION_FIELDS = {"country": "string", "city": "string"}


def parse_events_rescued(raw: DataFrame) -> DataFrame:
    """Event columns of the JSON in ``value`` beside ``rescued``, what does not fit them, by path and as JSON text.

    The record is read as a variant, and each field is taken out of it by its type. Fields that the model doesn't have,
    and those of another type than it asks for, are kept in ``rescued`` under their path and read as null in their
    column, so that a change of the producers' schema is seen and nothing is lost. What is no JSON object is kept whole
    under ``$``. ``rescued`` is null where everything fits.
    """
    text = F.col("value").cast("string")
    # A variant that is no object has no fields.
    whole = raw.select(text.alias("value"), F.try_parse_json(text).alias("record"))
    rows = whole.withColumn("fields", _fields_of(F.col("record"), "$"))
    rows = rows.withColumn("places", _fields_of(F.col("record"), "$.location"))
    typed = {n: F.try_variant_get("record", f"$.{n}", t) for n, t in TYPED_FIELDS.items()}
    inner = {n: F.try_variant_get("record", f"$.location.{n}", t) for n, t in LOCATION_FIELDS.items()}
    misfits = [
        *(_misfits("fields", {n: typed[n] for n in TYPED_FIELDS} | {"location": F.col("places")}, "")),
        *(_misfits("places", inner, "location.")),
    ]
    known = F.map_concat(
        _unknown("fields", [*TYPED_FIELDS, "location"], ""), _unknown("places", [*LOCATION_FIELDS], "location.")
    )
    wrong = F.map_from_entries(F.array_compact(F.array(*misfits)))
    unread = F.create_map(F.lit("$"), F.col("value"))
    rescued = F.when(F.col("fields").isNull(), unread).otherwise(F.map_concat(known, wrong))
    columns = [*(c.alias(n) for n, c in typed.items()), F.when(F.col("places").isNotNull(), F.struct(*(c.alias(n) for n, c in inner.items()))).alias("location")]
    found = rows.select(*columns, rescued.alias("rescued"))
    return found.withColumn("rescued", F.when(F.size("rescued") > 0, F.col("rescued")))


def _fields_of(record: Column, path: str) -> Column:
    """An object's fields by name; null if there is none at the path."""
    return F.try_variant_get(record, path, "map<string,variant>")


def _unknown(fields: str, names: list[str], prefix: str) -> Column:
    held = F.map_filter(F.coalesce(F.col(fields), F.create_map().cast("map<string,variant>")), lambda k, v: ~k.isin(names))
    texts = F.transform_values(held, lambda k, v: F.coalesce(F.to_json(v), F.lit("null")))
    return F.transform_keys(texts, lambda k, v: F.concat(F.lit(prefix), k))


def _misfits(fields: str, typed: dict[str, Column], prefix: str) -> list[Column]:
    """An entry of path and text for each field that is there, is not null, and could not be read by its type."""
    out = []
    for name, value in typed.items():
        held = F.try_element_at(F.col(fields), F.lit(name))
        wrong = held.isNotNull() & ~F.is_variant_null(held) & value.isNull()
        out.append(F.when(wrong, F.struct(F.lit(f"{prefix}{name}").alias("key"), F.to_json(held).alias("value"))))
    return out


def encode_events(events: DataFrame) -> DataFrame:
    """``(key, value)`` rows as the topic carries them: the user's id and the record as JSON bytes."""
    record = F.to_json(F.struct(*events.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    return events.select(F.col("user_id").cast("binary").alias("key"), record.cast("binary").alias("value"))


def _reasons(events: DataFrame) -> Column:
    missing = [F.when(F.col(f).isNull(), F.lit(f"{f} is missing")) for f in REQUIRED_EVENT_FIELDS]
    domains = {"event_type": EVENT_TYPES, "device_type": DEVICE_TYPES}
    unknown = [F.when(~F.col(f).isin(*values), F.lit(f"{f} is unknown")) for f, values in domains.items()]
    return F.array_compact(F.array(*missing, *unknown))


def validate_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(valid, rejected)``; rejected rows carry all ``reject_reasons``, valid ones have their defaults filled.

    A missing event id is derived from the record, so a retried task fills in the same one.
    """
    checked = events.withColumn("reject_reasons", _reasons(events))
    failed = F.size("reject_reasons") > 0
    derived_id = F.md5(F.to_json(F.struct(*events.columns)))
    valid = (
        checked.filter(~failed)
        .drop("reject_reasons")
        .withColumn("event_id", F.coalesce("event_id", derived_id))
        .withColumn("schema_version", F.coalesce("schema_version", F.lit(SCHEMA_VERSION)))
    )
    return valid, checked.filter(failed)


def dedup_events(events: DataFrame) -> DataFrame:
    """One event of each ``event_id``: producers send an event again when they miss its acknowledgement.

    In a table the first by time stays, then the smallest record. In a stream, which needs a watermark on
    ``timestamp``, the first to arrive stays and ids are remembered for as long as the watermark waits. Events without
    an id can't be told apart and all stay.
    """
    if events.isStreaming:
        # Without an id, a key of its own for each record keeps different events apart.
        own = F.coalesce("event_id", F.md5(F.to_json(F.struct(*events.columns))))
        return events.withColumn("_id", own).dropDuplicatesWithinWatermark(["_id"]).drop("_id")
    named = events.filter(F.col("event_id").isNotNull())
    others = [c for c in events.columns if c != "event_id"]
    order = F.struct("timestamp", F.to_json(F.struct(*others)))
    first = named.groupBy("event_id").agg(F.min_by(F.struct(*others), order).alias("_event"))
    kept = first.select("event_id", "_event.*").select(*events.columns)
    return kept.unionByName(events.filter(F.col("event_id").isNull()))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Stretches of a user's events without a pause of ``gap`` or more, with their events and purchases.

    Works on tables and, with a watermark, on streams; sessions merge map-side before they meet.
    """
    return (
        events.groupBy("user_id", F.session_window("timestamp", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("event_type") == "purchase").alias("n_purchases"))
        .select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events", "n_purchases")
    )
