"""Local session for tests."""

import tempfile

from pyspark.sql import SparkSession


def make_session(cores: int = 8) -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cores}]").appName("tidewatch-tests")
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
             .config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "8g")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tidewatch-tests-"))
             .config("spark.sql.session.timeZone", "UTC")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
