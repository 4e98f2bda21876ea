"""The driver's contract and the streaming forms."""

from concurrent.futures import ThreadPoolExecutor

import __spark_entry__ as entry
from pyspark.sql import functions as F
from talentmill import registry
from talentmill.plans.views import table
from talentmill.streaming import streams


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())


def test_every_query_runs(spark, sf_dir):
    """Every query is written to the end, some at a time; what they give is compared elsewhere."""

    def run(name):
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    with ThreadPoolExecutor(6) as pool:
        failed = {name: f.exception() for name, f in {n: pool.submit(run, n) for n in registry.QUERIES}.items() if f.exception()}
    assert not failed


def drain(df, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


def events(spark, sf_dir, tmp_path):
    """The events as three landed files."""
    e = table(spark, sf_dir, "events")
    path = str(tmp_path / "landing")
    for i in range(3):
        e.where(F.pmod("event_id", F.lit(3)) == i).coalesce(1).write.mode("append").parquet(path)
    return e, streams.read_landing(spark, path, e.schema)


def test_ingest_equals_batch(spark, sf_dir, tmp_path):
    e, landed = events(spark, sf_dir, tmp_path)
    query = streams.stream_ingest(landed.select("user_id", "event_id"), str(tmp_path / "out"), str(tmp_path / "cp"), ["user_id"])
    query.awaitTermination()
    users = sorted(r.user_id for r in e.select("user_id").distinct().collect())
    kept = lambda: streams.read_ingested(spark, str(tmp_path / "out"))
    assert sorted(r.user_id for r in kept().collect()) == users
    more = spark.createDataFrame([(users[0], -1), (10**9, -2)], "user_id long, event_id long").withColumn("user_id", F.col("user_id").cast(e.schema["user_id"].dataType)).withColumn("event_id", F.col("event_id").cast(e.schema["event_id"].dataType))
    more.coalesce(1).write.parquet(str(tmp_path / "more"))
    next_ = spark.readStream.schema(more.schema).parquet(str(tmp_path / "more"))
    streams.stream_ingest(next_, str(tmp_path / "out"), str(tmp_path / "cp2"), ["user_id"]).awaitTermination()  # a new checkpoint keeps what is there
    assert sorted(r.user_id for r in kept().collect()) == [*users, 10**9]
    assert kept().where(F.col("user_id") == users[0]).first().event_id == -1


def test_dedupe_and_daily(spark, sf_dir, tmp_path):
    e, landed = events(spark, sf_dir, tmp_path)
    drain(streams.stream_dedupe(landed, "event_id", "ts", "60 days"), "deduped", "append")
    assert spark.table("deduped").count() == e.select("event_id").distinct().count()
    drain(landed.transform(lambda s: streams.stream_daily(s, "ts", "60 days")), "daily", "update")
    got = spark.table("daily").groupBy("day").agg(F.max("n").alias("n"))
    assert rows(got) == rows(e.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n")))


def test_health_equals_batch_however_it_is_dealt(spark, sf_dir, tmp_path):
    """Rows come in files in any order within the lateness; a source of its own moves the watermark past the last of them."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    log = registry.health_log(spark, sf_dir)
    path = str(tmp_path / "log")
    end = spark.createDataFrame([(-1, "2030-01-01", 0, True, "none")], "source long, ts string, seq long, ok boolean, reason string").select(*(F.col(f.name).cast(f.dataType) for f in log.schema))
    for seed in (1, 2, 3):
        log.where(F.pmod(F.xxhash64("seq", F.lit(11)), F.lit(3)) + 1 == seed).orderBy(F.rand(seed)).coalesce(1).write.mode("append").parquet(path)
    end.coalesce(1).write.mode("append").parquet(path)
    landed = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got: dict[int, tuple] = {}

    def keep(batch, _):
        got.update({int(r.source): (r.fail_count, r.last_reason, r.is_active) for r in batch.collect()})

    query = streams.stream_health(landed, lateness="60 days").writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    want = {r.source: (r.fail_count, r.last_reason, r.is_active) for r in registry.QUERIES["hlt01_source_health"](spark, sf_dir).collect()}
    got.pop(-1, None)
    assert got == want
