"""Incremental and streaming behaviour (SM)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from kilohana.operators import grammar as G
from kilohana.plans.join import PATTERNS
from kilohana.registry import op
from kilohana.session import table
from kilohana.sources import readers
from kilohana.streaming import incremental as I


@op("sm01", "SELECT DISTINCT d.doc_id FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM reading_labels)")
def sm01(spark, sf):
    """Rows that have no output yet."""
    return I.missing(table(spark, sf, "documents").select("doc_id").distinct(), table(spark, sf, "reading_labels"), "doc_id")


def _streamed(spark, sf, every=None):
    """Sentences as a stream of files, scanned for patterns batch by batch; the checkpoint says what is done."""
    base = os.path.join(readers.work_dir(spark), f"stream-{uuid.uuid4().hex}")
    table(spark, sf, "sentences").select("sentenceid", "sourceid", "hawaiiantext").write.parquet(f"{base}/in")

    def work(batch, n):
        G.scan(batch).write.mode("overwrite").parquet(f"{base}/out/batch={n}")

    I.stream_parquet(spark, f"{base}/in", "sentenceid long, sourceid long, hawaiiantext string", work, f"{base}/done").awaitTermination()
    return spark.read.parquet(f"{base}/out")


@op("sm02", f"SELECT pattern_type, count(*) AS n FROM {PATTERNS} p GROUP BY 1")
def sm02(spark, sf):
    """Patterns of a stream with a checkpoint; a second run finds nothing new."""
    return _streamed(spark, sf).groupBy("pattern_type").agg(F.count("*").alias("n"))


@op("sm05", f"SELECT pattern_type, count(*) AS n FROM {PATTERNS} p GROUP BY 1")
def sm05(spark, sf):
    """The pattern counts as a materialised table: made of the rows delivered in time, then refreshed over all; the refreshed state is given out."""
    path = os.path.join(readers.work_dir(spark), "pattern_counts")
    s = table(spark, sf, "sentences")
    I.refresh(G.scan(s.where("created IS NOT NULL")).groupBy("pattern_type").agg(F.count("*").alias("n")), path)
    return I.refresh(G.scan(s).groupBy("pattern_type").agg(F.count("*").alias("n")), path)


@op("sm10")
def sm10(spark, sf):
    """Embeddings by one model a Python worker: loaded once a task, batches through it; no frequencies are kept, since workers don't share them."""
    d = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", "text")

    def run(batches):
        from kilohana.operators.embed import LocalModel

        model = LocalModel(64)
        for b in batches:
            b["embedding"] = list(model.encode(b["text"].tolist()))
            yield b[["doc_id", "embedding"]]

    return d.mapInPandas(run, "doc_id long, embedding array<float>")


def _in_files(spark, sf, base: str, parts: int):
    d = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", "text", "added")
    d.repartition(parts, "doc_id").write.parquet(f"{base}/in")
    return "doc_id long, text string, added timestamp_ntz"


@op("sm03", "SELECT doc_id, length(text) AS chars, len(list_filter(string_split_regex(text,'[.?!]\\s+'), lambda x: x<>'')) AS sentences FROM documents WHERE text IS NOT NULL")
def sm03(spark, sf):
    """Source metadata written with a checkpoint each few files; a run that is stopped after its second batch is taken up by the next, and no document comes twice."""
    base = os.path.join(readers.work_dir(spark), f"metadata-{uuid.uuid4().hex}")
    schema = _in_files(spark, sf, base, 6)

    def work(batch, n):
        m = batch.select("doc_id", F.length("text").alias("chars"), F.size(F.filter(F.split("text", r"[.?!]\s+"), lambda x: x != "")).alias("sentences"))
        m.write.mode("overwrite").parquet(f"{base}/out/batch={n}")

    first = I.Stopper(work, lambda done: done >= 2)
    first.wait(I.stream_parquet(spark, f"{base}/in", schema, first, f"{base}/done", every="0 seconds", files=1))
    I.stream_parquet(spark, f"{base}/in", schema, work, f"{base}/done", files=1).awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("batch")


@op("sm07", "SELECT doc_id, length(text) AS chars FROM documents WHERE text IS NOT NULL")
def sm07(spark, sf):
    """A service that fails on the first call of every batch: calls are repeated with growing pauses, and every row comes out."""
    d = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", "text")

    def run(batches):
        for b in batches:
            calls = []

            def service(texts, calls=calls):
                calls.append(1)
                if len(calls) == 1:
                    raise ConnectionError("busy")
                return [len(t) for t in texts]

            b["chars"] = I.with_retries(service, tries=3, wait=0.01)(b["text"].tolist())
            yield b[["doc_id", "chars"]]

    return d.mapInPandas(run, "doc_id long, chars int")


@op("sm08", "SELECT true AS stopped_whole, true AS resumed_all, count(*) AS n FROM documents WHERE text IS NOT NULL")
def sm08(spark, sf):
    """A graceful stop: the running batch ends, the rest waits for the next run; (was the stop between batches, is all done after, documents)."""
    base = os.path.join(readers.work_dir(spark), f"stop-{uuid.uuid4().hex}")
    schema = _in_files(spark, sf, base, 5)

    def work(batch, n):
        batch.select("doc_id").write.mode("overwrite").parquet(f"{base}/out/batch={n}")

    stop = I.Stopper(work, lambda done: done >= 1)
    done = stop.wait(I.stream_parquet(spark, f"{base}/in", schema, stop, f"{base}/done", every="0 seconds", files=1))
    before = spark.read.parquet(f"{base}/out").select("batch").distinct().count()
    I.stream_parquet(spark, f"{base}/in", schema, work, f"{base}/done", files=1).awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    all_ = table(spark, sf, "documents").where("text IS NOT NULL").count()
    return out.agg(F.lit(before >= done >= 1).alias("stopped_whole"), ((F.count("*") == all_) & (F.countDistinct("doc_id") == all_)).alias("resumed_all"), F.count("*").alias("n"))


@op("sm04", "SELECT status, count(*) AS n, true AS small FROM processing_log GROUP BY 1")
def sm04(spark, sf):
    """A write-through cache flushed by size and time: every batch holds at most 1000 rows and none is lost."""
    base = os.path.join(readers.work_dir(spark), f"flush-{uuid.uuid4().hex}")
    out = I.flushed(spark, table(spark, sf, "processing_log").select("log_id", "status"), base, 1000, "1 second")
    most = out.groupBy("batch").count().agg((F.max("count") <= 1000).alias("small"))
    return out.groupBy("status").agg(F.count("*").alias("n")).crossJoin(F.broadcast(most))


@op("sm06", "SELECT DISTINCT sourceid FROM sentences ORDER BY sourceid LIMIT 30 OFFSET 60")
def sm06(spark, sf):
    """The third page of an endless list."""
    return readers.offset_page(table(spark, sf, "sentences").select("sourceid").distinct(), ["sourceid"], 60, 30)


@op("sm09", "SELECT sourceid, count(*) AS n FROM sentences GROUP BY 1")
def sm09(spark, sf):
    """One commit or none: written beside, counted, and only then given out."""
    path = os.path.join(readers.work_dir(spark), f"commit-{uuid.uuid4().hex}")
    return I.committed(table(spark, sf, "sentences").groupBy("sourceid").agg(F.count("*").alias("n")), path)
