"""Incremental work: the batch form by anti-join, and the streaming form with a checkpoint and foreachBatch.

A stream's checkpoint folder says which input is done, so a stopped or lost run goes on where it was; a batch's output lies under the batch's number, so a
batch that is done again writes over its own and nothing counts twice.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def missing(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key no output holds yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def stream_parquet(spark: SparkSession, path: str, schema: str, work: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None, files: int | None = None):
    """Start a query that hands each batch of new files to ``work``; with ``every`` it runs on, else it takes what is there and ends. ``files`` bounds a batch."""
    r = spark.readStream.schema(schema)
    if files:
        r = r.option("maxFilesPerTrigger", files)
    w = r.parquet(path).writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


class Stopper:
    """Runs a stream's work batch by batch and asks it to end after a batch, when ``enough`` says so; a batch is never broken off."""

    def __init__(self, work: Callable[[DataFrame, int], None], enough: Callable[[int], bool]) -> None:
        self.work, self.enough, self.done, self.asked = work, enough, 0, False

    def __call__(self, batch: DataFrame, n: int) -> None:
        self.work(batch, n)
        self.done += 1
        self.asked = self.asked or self.enough(self.done)

    def wait(self, query, poll: float = 0.05) -> int:
        """Wait until the stream has nothing to do or is asked to end, then stop it between batches; batches done."""
        while query.isActive and not self.asked:
            if query.lastProgress is not None and not query.status["isDataAvailable"] and not query.status["isTriggerActive"]:
                break
            time.sleep(poll)
        while query.isActive and query.status["isTriggerActive"] and not self.asked:
            time.sleep(poll)
        query.stop()
        return self.done


def flushed(spark: SparkSession, rows: DataFrame, base: str, size: int = 1000, every: str = "60 seconds") -> DataFrame:
    """A write-through cache: rows are handed in as files of at most ``size`` rows and flushed one file a batch, at the latest ``every`` so often; (rows..., batch)."""
    rows.write.option("maxRecordsPerFile", size).mode("append").parquet(f"{base}/in")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    q = stream_parquet(spark, f"{base}/in", schema, lambda b, n: b.write.mode("overwrite").parquet(f"{base}/out/batch={n}"), f"{base}/done", every=every, files=1)
    q.processAllAvailable()
    q.stop()
    return spark.read.parquet(f"{base}/out")


def refresh(df: DataFrame, path: str) -> DataFrame:
    """A materialised table: computed anew beside the old state, then given out; readers of the old state keep it until then."""
    spark = df.sparkSession
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    last = max([int(s.getPath().getName()[1:]) for s in files.listStatus(root)], default=0) if files.exists(root) else 0
    committed(df, f"{path}/v{last + 1}")
    if last > 1:  # the state before stays for its readers, older ones go
        files.delete(fs.Path(f"{path}/v{last - 1}"), True)
    return spark.read.parquet(f"{path}/v{last + 1}")


def with_retries(call: Callable, tries: int = 3, wait: float = 1.0, factor: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """``call`` tried again after growing pauses; the last failure is raised."""

    def run(*args):
        for k in range(tries):
            try:
                return call(*args)
            except Exception:
                if k == tries - 1:
                    raise
                sleep(wait * factor**k)

    return run


def committed(df: DataFrame, path: str) -> DataFrame:
    """Write, read back and compare row counts; a mismatch raises and nothing is given out."""
    from pyspark.sql.observation import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.parquet(path)
    if out.count() != seen.get["n"]:
        raise RuntimeError(f"{path}: written {seen.get['n']} rows, found {out.count()}")
    return out
