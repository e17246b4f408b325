"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Java regular expression of a word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: ASCII white space, the same characters.
BLANK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def uniform(*parts: Column | int | str) -> Column:
    """Repeatable number strictly between 0 and 1, drawn from a hash of the parts."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + 0.5) / float(1 << 53)


def numbered(df: DataFrame, group: list[str], keys: list[str], name: str, n_rows: int,
             chunk_rows: int = 50_000, least: int = 256) -> DataFrame:
    """Add a gapless number from 0 within each group, whatever the groups' sizes.

    Rows are numbered inside chunks that a hash of ``keys`` deals out, and shifted
    by the sizes of the chunks before; so a group with all rows is spread as well.
    Groups must not be null. Rows with equal keys come in any order.
    """
    chunks = max(least, n_rows // chunk_rows + 1)
    chunk = f"_{name}_chunk"
    dealt = df.withColumn(chunk, F.pmod(F.xxhash64(F.lit("chunk"), *keys), F.lit(chunks)))
    sizes = dealt.groupBy(*group, chunk).agg(F.count(F.lit(1)).alias("_size"))
    before = (Window.partitionBy(*group).orderBy(chunk)
              .rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*group, chunk,
                          F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*group, chunk).orderBy(*keys)
    return (dealt.withColumn(name, F.row_number().over(inside).cast("long") - 1)
            .join(starts, [*group, chunk])
            .withColumn(name, F.col(name) + F.col("_start"))
            .drop(chunk, "_start"))
