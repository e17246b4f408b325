"""Sources. Every reader takes a path and gives a static DataFrame; posts, logs
and machine usage can be read as streams of arriving files too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch import schemas
from tidewatch.functions import from_micros, split_nonempty, to_micros
from tidewatch.operators.access_log import parse_access_log


def _reader(spark: SparkSession, stream: bool, files_per_trigger: int | None):
    if not stream:
        return spark.read
    reader = spark.readStream
    return reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader


def read_posts(spark: SparkSession, path: str, *, stream: bool = False,
               files_per_trigger: int | None = None) -> DataFrame:
    """JSON-lines records; only the text is read, records without one are dropped."""
    posts = _reader(spark, stream, files_per_trigger).schema(schemas.POST_JSON).json(path)
    return posts.select(F.col("data.text").alias("text")).filter("text is not null")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated ``word, score``; of repeated words the last line counts."""
    lines = spark.read.text(path).select(
        split_nonempty(F.col("value"), "\t").alias("f"),
        F.struct("_metadata.file_path", "_metadata.file_block_start",
                 F.monotonically_increasing_id()).alias("at"))
    return (lines.filter(F.size("f") >= 2)
            .select(F.col("f")[0].alias("word"),
                    F.element_at("f", -1).try_cast("int").alias("score"), "at")
            .groupBy("word").agg(F.max_by("score", "at").alias("score")))


def access_log_lines(spark: SparkSession, path: str, *, stream: bool = False,
                     files_per_trigger: int | None = None) -> DataFrame:
    return _reader(spark, stream, files_per_trigger).text(path)


def read_access_log(spark: SparkSession, path: str, **kw) -> DataFrame:
    """Parsed access log; lines that do not match are dropped."""
    return parse_access_log(access_log_lines(spark, path, **kw))


# Field numbers and factors of the two machine-usage layouts.
LAYOUTS = {
    "seven": {"size": 7, "id": 0, "ts": 1, "cpu": 2, "memory": 3,
              "ts_factor": 1000, "factor": 1.0},
    "nineteen": {"size": 19, "id": 4, "ts": 0, "cpu": 5, "memory": 6,
                 "ts_factor": 1, "factor": 10.0},
}


def machine_usage(lines: DataFrame, layout: str, line: str = "value") -> DataFrame:
    """Replace CSV lines by ``(machine_id, ts, cpu, memory)``.

    Empty fields do not count, so a line with one has the wrong number of fields
    and is dropped, as is one whose numbers do not parse.
    """
    spec = LAYOUTS[layout]
    kept = [c for c in lines.columns if c != line]
    f = F.col("_f")

    def number(name: str):
        return f[spec[name]].try_cast("double") * spec["factor"]

    return (lines.select(*kept, split_nonempty(F.col(line), ",").alias("_f"))
            .filter(F.size("_f") == spec["size"])
            .select(*kept, f[spec["id"]].alias("machine_id"),
                    (f[spec["ts"]].try_cast("long") * spec["ts_factor"]).alias("ts"),
                    number("cpu").alias("cpu"), number("memory").alias("memory"))
            .filter("ts is not null and cpu is not null and memory is not null"))


def read_machine_usage(spark: SparkSession, path: str, layout: str, *, stream: bool = False,
                       files_per_trigger: int | None = None) -> DataFrame:
    return machine_usage(_reader(spark, stream, files_per_trigger).text(path), layout)


def read_geo(spark: SparkSession, path: str) -> DataFrame:
    """Network ranges as parquet."""
    return spark.read.schema(schemas.GEO).parquet(path)


def read_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Metric documents, one JSON object per file."""
    return (spark.read.schema(schemas.METRIC).option("multiLine", True)
            .option("pathGlobFilter", "*.json").json(folder))


def read_metric_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Metric documents of any fields as one ``doc`` column, a row per file; files that
    hold no JSON are left out."""
    files = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    return files.select(F.try_parse_json("value").alias("doc")).filter(F.col("doc").isNotNull())


def metric_fields(documents: DataFrame, fields: T.StructType = schemas.METRIC) -> DataFrame:
    """Columns of ``fields`` out of ``doc``. What a document lacks, or has in another type,
    is null, so runs of different programs share a table."""
    def path(name: str) -> str:
        return "$['" + name.replace("'", "\\'") + "']"

    return documents.select(*[
        F.try_variant_get("doc", path(f.name), f.dataType.simpleString()).alias(f.name) for f in fields])


def replay(df: DataFrame, ts: str, order: list[str], n: int) -> DataFrame:
    """The table ``n`` times; each round is shifted by the time of its last row.

    ``ts`` may be a timestamp or a whole number; adds ``round``.
    """
    last = df.agg(F.max_by(ts, F.struct(*order)).alias("t"))
    rounds = df.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    kind = df.schema[ts].dataType.typeName()
    if kind.startswith("timestamp"):
        span = last.select(to_micros(F.col("t"))).scalar()
        shifted = from_micros(to_micros(F.col(ts)) + F.col("round") * span)
        return rounds.withColumn(ts, shifted)
    return rounds.withColumn(ts, F.col(ts) + F.col("round") * last.scalar())
