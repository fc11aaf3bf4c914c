from kilohana.operators import grammar as G
from kilohana.streaming import incremental as I


def test_missing(spark):
    a = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    assert {r["k"] for r in I.missing(a, a.where("k = 1"), "k").collect()} == {2, None}


def test_checkpoint_takes_new_files_once(spark, tmp_path):
    src, out, done = (str(tmp_path / x) for x in ("in", "out", "done"))
    schema = "sentenceid long, sourceid long, hawaiiantext string"

    def work(batch, n):
        G.scan(batch).write.mode("append").parquet(out)

    for k in (1, 2):
        spark.createDataFrame([(k, 1, "He hale nani.")], schema).write.mode("append").parquet(src)
        I.stream_parquet(spark, src, schema, work, done).awaitTermination()
    I.stream_parquet(spark, src, schema, work, done).awaitTermination()
    rows = spark.read.parquet(out).where("pattern_type = 'pepeke_aike_he'")
    assert sorted(r["sentenceid"] for r in rows.collect()) == [1, 2]


def test_committed(spark, tmp_path):
    assert I.committed(spark.range(10).toDF("n"), str(tmp_path / "t")).count() == 10


def test_retries_wait_longer_each_time():
    waits, calls = [], []

    def busy():
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError
        return "ok"

    assert I.with_retries(busy, tries=3, wait=1.0, sleep=waits.append)() == "ok" and waits == [1.0, 2.0]
    calls.clear()
    try:
        I.with_retries(busy, tries=2, sleep=waits.append)()
        raise AssertionError
    except ConnectionError:
        pass


def test_stop_between_batches_and_resume(spark, tmp_path):
    src, out, done = (str(tmp_path / x) for x in ("in", "out", "done"))
    spark.range(100).withColumnRenamed("id", "k").repartition(4).write.parquet(src)
    work = lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")
    stop = I.Stopper(work, lambda n: n >= 1)
    assert stop.wait(I.stream_parquet(spark, src, "k long", stop, done, every="0 seconds", files=1)) >= 1
    I.stream_parquet(spark, src, "k long", work, done, files=1).awaitTermination()
    assert sorted(r["k"] for r in spark.read.parquet(out).collect()) == list(range(100))


def test_refresh_and_flush(spark, tmp_path):
    a = I.refresh(spark.range(3).toDF("k"), str(tmp_path / "m"))
    b = I.refresh(spark.range(5).toDF("k"), str(tmp_path / "m"))
    assert a.count() == 3 and b.count() == 5
    f = I.flushed(spark, spark.range(2500).toDF("k").coalesce(1), str(tmp_path / "f"), 1000, "1 second")
    assert f.count() == 2500 and f.groupBy("batch").count().where("count > 1000").isEmpty()
