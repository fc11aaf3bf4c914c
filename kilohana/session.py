"""Session and table access shared by every operator.

Nothing here depends on table size: shuffle partitions, AQE and the broadcast limit stay with the cluster's own settings when they are set.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

#: Settings given only where the session has none of its own.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def get_spark(master: str = "local[8]", app: str = "kilohana", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark. On a cluster the caller brings its own."""
    b = SparkSession.builder.master(master).appName(app)
    base = DEFAULTS | {
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table; timestamps without zone stay TIMESTAMP_NTZ."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the session names in spark.checkpoint.dir. Unset, a folder of our own serves a local session; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN:
        import tempfile

        _OWN.append(tempfile.mkdtemp(prefix="kilohana-"))
    return _OWN[0]


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """checkpoint() into the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager)
