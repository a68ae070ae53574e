"""Sensor records: text lines, JSON messages, the archive, result files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.shared import null_safe_join

#: The range of valid sensor numbers.
FIRST_MOTE, LAST_MOTE = 1, 54
MEASURES = ("temperature", "humidity", "light", "voltage")

RECORD = T.StructType([
    T.StructField("event_ts", T.TimestampType()), T.StructField("epoch", T.LongType()), T.StructField("mote_id", T.ShortType()),
    *[T.StructField(m, T.DoubleType()) for m in MEASURES],
])
MESSAGE = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("event_ts", T.StringType()), T.StructField("epoch", T.LongType()), T.StructField("mote_id", T.ShortType()),
    *[T.StructField(m, T.DoubleType()) for m in MEASURES], T.StructField("sent_at", T.DoubleType()),
])
ARCHIVE = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("event_ts", T.TimestampType()), T.StructField("epoch", T.LongType()), T.StructField("mote_id", T.ShortType()),
    *[T.StructField(m, T.DoubleType()) for m in MEASURES], T.StructField("sent_at", T.DoubleType()), T.StructField("ingested_at", T.DoubleType()),
    T.StructField("kafka_partition", T.IntegerType()), T.StructField("kafka_offset", T.LongType()),
])


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines (value); gzip files are read as they are, one task for each."""
    return spark.read.text(path)


def parsed_time(date: Column, time: Column) -> Column:
    """A timestamp from a date and a time with up to any number of fractional digits, cut to microseconds; or null."""
    return F.try_to_timestamp(F.concat_ws(" ", date, time))


def _fields(line: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")


def parse_lines(df: DataFrame, with_time: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Records of lines of exactly eight fields: date, time, epoch, sensor, and four measures; others are left out.

    The sensor's number must be valid, and so must the time unless ``with_time`` is false.
    """
    parts = df.select(*keep, _fields(F.col("value")).alias("f")).where(F.size("f") == 8)
    number = lambda i, kind: F.expr(f"try_cast(f[{i}] as {kind})")
    out = parts.select(
        *keep, parsed_time(F.col("f")[0], F.col("f")[1]).alias("event_ts"), number(2, "bigint").alias("epoch"), number(3, "smallint").alias("mote_id"),
        *[number(4 + i, "double").alias(m) for i, m in enumerate(MEASURES)],
    )
    good = F.col("mote_id").between(FIRST_MOTE, LAST_MOTE) & F.col("epoch").isNotNull()
    for m in MEASURES:
        good = good & F.col(m).isNotNull()
    return out.where(good & F.col("event_ts").isNotNull() if with_time else good)


def parse_messages(df: DataFrame, value: str = "value", required: tuple[str, ...] = ("mote_id", "temperature", "event_ts")) -> tuple[DataFrame, DataFrame]:
    """Good records of JSON texts, and the texts that are malformed or lack a required field."""
    both = df.withColumn("__r", F.from_json(F.col(value).cast("string"), MESSAGE, {"mode": "PERMISSIVE"}))
    good = F.col("__r").isNotNull()
    for c in required:
        good = good & F.col("__r")[c].isNotNull()
    good = F.coalesce(good, F.lit(False))
    records = both.where(good).select("__r.*", *[c for c in df.columns if c != value]).withColumn("event_ts", F.to_timestamp("event_ts"))
    return records, both.where(~good).drop("__r")


def parse_flexible(df: DataFrame, value: str = "value") -> DataFrame:
    """stratum and value of JSON texts that name them mote_id or sensor_id, and temperature or value."""
    text = F.col(value).cast("string")
    stratum = F.coalesce(F.get_json_object(text, "$.mote_id"), F.get_json_object(text, "$.sensor_id"))
    number = F.coalesce(F.get_json_object(text, "$.temperature"), F.get_json_object(text, "$.value"))
    return df.select(stratum.alias("stratum"), number.try_cast("double").alias("value")).where("stratum is not null and value is not null")


def extracted(df: DataFrame, value: str | Column | None = None, stratum: str | Column | None = None) -> DataFrame:
    """df with stratum and value: by name, by expression, or from the usual names (sensor_id; value, then val)."""
    names = set(df.columns)

    def pick(given, usual):
        if isinstance(given, Column):
            return given
        name = given or next((c for c in usual if c in names), None)
        if name not in names:
            raise KeyError(f"no column {name or usual[0]!r}")
        return F.col(name)

    return df.withColumns({"stratum": pick(stratum, ["sensor_id"]).cast("string"), "value": pick(value, ["value", "val"]).cast("double")})


def write_archive(df: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by day (snappy); Spark's commit protocol publishes whole files only."""
    df.withColumn("date", F.date_format("event_ts", "yyyy-MM-dd")).write.mode(mode).option("compression", "snappy").partitionBy("date").parquet(path)


def read_archive(spark: SparkSession, path: str, day: str | None = None) -> DataFrame:
    """The archive; of one day, only that day's folder is read."""
    df = spark.read.schema(T.StructType([*ARCHIVE, T.StructField("date", T.StringType())])).parquet(path)
    return df if day is None else df.where(F.col("date") == day)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def write_results(df: DataFrame, path: str, form: str = "csv") -> None:
    """Result tables as CSV with a header, or JSON lines."""
    writer = df.coalesce(1).write.mode("overwrite")
    writer.option("header", True).csv(path) if form == "csv" else writer.json(path)


def to_messages(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """key and value (JSON) of each row, as a Kafka sink takes them."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*(columns or df.columns))).alias("value"))


def window_messages(windows: DataFrame, strata: DataFrame, samples: DataFrame) -> DataFrame:
    """key ("start:end") and value: a window's results with, for each stratum, its counts, weight and sampled rows.

    windows and strata have window_start and window_end, strata and samples also stratum; samples has values. The null
    stratum goes by the name "null".
    """
    keys = ["window_start", "window_end"]
    rows = samples.groupBy(*keys, "stratum").agg(F.collect_list(F.struct(*[c for c in samples.columns if c not in (*keys, "stratum")])).alias("samples"))
    parts = null_safe_join(strata, rows, [*keys, "stratum"], "left").withColumn("stratum", F.coalesce("stratum", F.lit("null")))
    entry = F.struct("stratum", F.struct(*[c for c in parts.columns if c not in (*keys, "stratum")]))
    nested = parts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("strata"))
    both = windows.join(nested, keys, "left")
    return both.select(F.concat_ws(":", *keys).alias("key"), F.to_json(F.struct(*both.columns)).alias("value"))


def kafka_reader(spark: SparkSession, servers: str, topic: str, batch: int = 1000):
    """The stream of a topic from its start; offsets are kept by the query's checkpoint. Needs Spark's Kafka package."""
    return (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
        .option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", batch).load()
    )


def kafka_writer(df: DataFrame, servers: str, topic: str, checkpoint: str):
    return df.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint)
