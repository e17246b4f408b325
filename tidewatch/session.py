"""Session helpers: lineage cuts with a lifetime, and size checks."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows one window group may hold before its work is split over many tasks.
HOT_ROWS = 4_000_000

#: Bytes a lookup table may have as a file to be broadcast.
BROADCAST_BYTES = 32 << 20

#: Rows a written table may have to be broadcast. Its file does not tell: runs of equal
#: values take no room in it, but each row does in memory.
BROADCAST_ROWS = 200_000

#: Folders of the tables written by ``cut`` and not yet removed.
_written: list[str] = []


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts.

    The cluster names it in ``spark.checkpoint.dir``. A local session, whose driver and
    tasks are one process, may leave it unset and gets a folder in its warehouse; on a
    cluster that could be a folder of one machine, so there it is an error.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def _remove(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
        if p in _written:
            _written.remove(p)


def sweep(spark: SparkSession, since: int = 0) -> None:
    """Remove the tables written by ``cut``, or those after the first ``since``."""
    _remove(spark, _written[since:])


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Lineage cuts made inside are removed on leaving.

    For jobs that write their result inside the block, such as a micro-batch.
    A frame that is still to be read must not be made in such a block.
    """
    before = len(_written)
    try:
        yield
    finally:
        sweep(spark, before)


@atexit.register
def _sweep_at_exit() -> None:
    """Frames are lazy, so tables outside of ``scratch`` live as long as the session."""
    spark = SparkSession.getActiveSession() if _written else None
    if spark is not None:
        try:
            sweep(spark)
        except Exception:  # the session may have ended already
            _written.clear()


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to a table in the checkpoint folder and read them back.

    The rows survive executors and are never recomputed, so values that depend
    on how rows were partitioned stay fixed; readers fetch only the columns they
    use. ``scratch`` and ``sweep`` remove the tables.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/tidewatch-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null, null meeting null; the keys come once."""
    a, b = left.alias("_tw_l"), right.alias("_tw_r")
    cond = [F.col(f"_tw_l.{k}").eqNullSafe(F.col(f"_tw_r.{k}")) for k in keys]
    joined = a.join(b, cond, how)
    if how in ("left_semi", "left_anti"):
        return joined
    return joined.select("_tw_l.*", *[F.col(f"_tw_r.{c}") for c in right.columns if c not in keys])


def is_small(df: DataFrame, limit: int) -> bool:
    """True if ``df`` has at most ``limit`` rows; the count reads no columns."""
    return df.count() <= limit


def lookup_side(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Lookup table for a join: computed once into a table, whose measured bytes say
    whether it is broadcast."""
    table = cut(df)
    size = int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(table) if size <= limit else table


def join_side(table: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Written table as one side of a join. Spark broadcasts it if its compressed file is
    small, and the driver then holds all rows; one of more rows is shuffled and merged."""
    return table if is_small(table, limit) else table.hint("merge")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for a table stored in fewer pieces than there are cores.

    Large tables have many pieces and are left as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def hot_or_unknown(source: DataFrame, limit: int = HOT_ROWS) -> bool | None:
    """Answer for ``hot`` from the size of a cheap source of the rows: False if all
    of it is within the limit, else None, which has the largest key measured."""
    return False if is_small(source, limit) else None
