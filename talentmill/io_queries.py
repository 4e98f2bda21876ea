"""Queries that write the given tables to the shared folder and read them back through sources, sinks and streams, with their DuckDB SQL."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentmill.operators import merge
from talentmill.plans.views import table
from talentmill.registry import HEALTH, health_log, query
from talentmill.sources import rates, tables, versions
from talentmill.sources.shared import scratch
from talentmill.streaming import streams

ORDERS = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_totalprice", T.DoubleType()), T.StructField("o_orderpriority", T.StringType())])


def landed_orders(spark: SparkSession, d: str, root: str, parts: int = 3) -> list[str]:
    """Orders as CSV files of several runs of a day; the note spans two lines and has quotes."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice"), F.concat(F.lit('a "note"\nof '), "o_orderpriority").alias("o_orderpriority"))
    for run in range(parts):
        o.where(F.pmod("o_orderkey", F.lit(parts)) == run).coalesce(1).write.option("header", True).option("escape", '"').csv(f"{root}/raw/2024-01-01/run{run}")
    return tables.resolve_inputs(spark, root, "2024-01-01")


NOTED = "SELECT o_orderkey, o_totalprice, 'a \"note\"' || chr(10) || 'of ' || o_orderpriority AS o_orderpriority FROM orders"


@query(NOTED)
def src01_read_snapshot(spark, d):
    root = scratch(spark, "landing")
    return tables.read_snapshot(spark, landed_orders(spark, d, root), ORDERS)


@query("SELECT run, count(*) AS n FROM (SELECT 'run' || CAST(o_orderkey % 3 AS VARCHAR) AS run FROM orders) WHERE run <> 'run1' GROUP BY 1")
def src03_resolve_inputs(spark, d):
    """Given keys come before all of a date's runs."""
    root = scratch(spark, "landing")
    keys = [p.removeprefix(f"{root}/") for p in landed_orders(spark, d, root) if "/run1/" not in p]
    read = tables.read_snapshot(spark, tables.resolve_inputs(spark, root, "2024-01-01", keys), ORDERS)
    return read.select(F.regexp_extract(F.input_file_name(), "/(run[0-9])/", 1).alias("run")).groupBy("run").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN o_orderkey % 50 = 0 THEN 'type: o_totalprice' WHEN o_orderkey % 49 = 0 THEN 'columns' ELSE 'good' END AS reason, count(*) AS n, CAST(sum(CASE WHEN o_orderkey % 50 <> 0 AND o_orderkey % 49 <> 0 THEN o_orderkey END) AS BIGINT) AS keys FROM orders GROUP BY 1 UNION ALL SELECT 'header', 1, NULL")
def src04_read_tolerant(spark, d):
    """Values that are no numbers, rows with too many columns, and a file with another header are set aside with their reason."""
    root, key = scratch(spark, "landing"), F.col("o_orderkey")
    o = table(spark, d, "orders")
    price = F.when(key % 50 == 0, "much").otherwise(F.col("o_totalprice").cast("string"))
    line = F.concat_ws(",", key.cast("string"), price, F.col("o_orderpriority"), F.when((key % 49 == 0) & (key % 50 != 0), "more"))
    head = spark.createDataFrame([(0, ",".join(ORDERS.names))], "at int, value string")
    lines = head.unionByName(o.select(F.lit(1).alias("at"), line.alias("value"))).repartition(1).sortWithinPartitions("at").select("value")
    lines.write.text(f"{root}/a")
    lines.where("value like '%URGENT'").coalesce(1).write.text(f"{root}/b")  # no header: its first record is taken for one
    paths = [f"{root}/{x}/{f}" for x in "ab" for f in tables.children(spark, f"{root}/{x}") if f.startswith("part-")]
    good, damaged = tables.read_tolerant(spark, [*paths, f"{root}/a/missing.csv"], ORDERS)
    counts = damaged.where("reason <> 'missing'").groupBy("reason").agg(F.count("*").alias("n"), F.lit(None).cast("long").alias("keys"))
    return good.agg(F.lit("good").alias("reason"), F.count("*").alias("n"), F.sum("o_orderkey").alias("keys")).unionByName(counts)


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey % 2 = 1")
def src05_resolve_clean(spark, d):
    """The newest date's newest run, where there is no pointer."""
    root, o = scratch(spark, "clean"), table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    for date, run, part in (("2024-01-01", "r9", 0), ("2024-01-02", "r1", 0), ("2024-01-02", "r2", 1)):
        tables.write_snapshot(o.where(F.pmod("o_orderkey", F.lit(2)) == part), root, date, run)
    return spark.read.parquet(tables.resolve_clean(spark, root))


@query("SELECT run_date, run_id, count(*) AS n FROM (SELECT DATE '2024-01-01' + CAST(o_orderkey % 2 AS INT) AS run_date, 'r' || CAST(o_orderkey % 2 AS VARCHAR) AS run_id FROM orders) GROUP BY 1, 2")
def snk01_write_snapshot(spark, d):
    root, o = scratch(spark, "clean"), table(spark, d, "orders").select("o_orderkey")
    for part in (0, 1):
        tables.write_snapshot(o.where(F.pmod("o_orderkey", F.lit(2)) == part), root, f"2024-01-0{part + 1}", f"r{part}")
    return spark.read.parquet(f"{root}/clean").groupBy("run_date", "run_id").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_totalprice + 2 AS o_totalprice FROM orders")
def snk02_versions(spark, d):
    """Each version replaces the one before; old ones expire."""
    root, o = scratch(spark, "versions"), table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    versions.append(o, root)
    for _ in range(2):
        versions.update(spark, root, lambda old: old.withColumn("o_totalprice", F.col("o_totalprice") + 1))
    versions.expire(spark, root, keep=1, unused_seconds=0)
    return versions.read(spark, root)


@query("SELECT o_orderpriority, 2 * count(*) AS n FROM orders GROUP BY 1")
def snk03_append_table(spark, d):
    name = scratch(spark, "orders").rsplit("/", 1)[1].replace("-", "_")
    for _ in range(2):
        tables.append_table(table(spark, d, "orders").select("o_orderpriority"), name)
    return spark.table(name).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT DATE '2024-01-02' AS rate_date, 'C' || CAST(n_nationkey AS VARCHAR) AS base_currency, 'RUB' AS target_currency, round((n_nationkey + 10.25) / 10, 6)::DOUBLE AS rate FROM nation")
def xml01_central_bank(spark, d):
    """A file with a record a nation: values with decimal commas for ten units each."""
    root, key = scratch(spark, "xml"), F.col("n_nationkey").cast("string")
    record = F.concat(F.lit("<Valute><CharCode>c"), key, F.lit("</CharCode><Nominal>10</Nominal><Value> "), (F.col("n_nationkey") + 10).cast("string"), F.lit(",25</Value></Valute>"))
    table(spark, d, "nation").agg(F.concat(F.lit("<ValCurs>"), F.array_join(F.collect_list(record), "\n"), F.lit("</ValCurs>")).alias("value")).write.text(root)
    return rates.read_cbr(spark, root, "2024-01-02").withColumn("rate", F.col("rate").cast("double"))


# ---- streams --------------------------------------------------------------------------------


def landed_events(spark: SparkSession, df: DataFrame, files: int = 4, last: DataFrame | None = None) -> DataFrame:
    """Rows dealt to files by a hash, so that none comes in order, as a stream of one file a batch; ``last`` comes behind all of them."""
    path = scratch(spark, "stream")
    for i in range(files):
        df.where(F.pmod(F.xxhash64(*df.columns), F.lit(files)) == i).coalesce(1).write.mode("append").parquet(path)
    if last is not None:
        time.sleep(1.1)  # files are taken in the order of their seconds
        last.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """All that a stream gives out, as a table, with the number of the batch."""
    out = scratch(spark, "out")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.parquet(f"{out}/_batch_of={number}")

    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", scratch(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(T.StructType([*stream.schema, T.StructField("_batch", T.IntegerType())])).parquet(f"{out}/*")


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def stm01_ingest(spark, d):
    """The newest row of each user, whatever file it came in: a batch keeps its newest, and its merge what is newer than before."""
    landed = landed_events(spark, table(spark, d, "events").select("user_id", "event_id"))
    target = scratch(spark, "target")
    streams.stream_ingest(landed, target, scratch(spark, "checkpoint"), ["user_id"], newest="event_id").awaitTermination()
    return streams.read_ingested(spark, target)


@query("SELECT user_id, event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1, 2")
def stm02_dedupe(spark, d):
    """Every event comes twice and counts once."""
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    twice = e.withColumn("again", F.explode(F.array(F.lit(0), F.lit(1))))
    found = drained(spark, streams.stream_dedupe(landed_events(spark, twice), "event_id", "ts", "60 days"), "append")
    return found.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def stm03_daily(spark, d):
    daily = drained(spark, streams.stream_daily(landed_events(spark, table(spark, d, "events").select("ts", "event_id")), "ts", "60 days"), "update")
    return daily.groupBy("day").agg(F.max_by("n", "_batch").alias("n"))


@query(HEALTH)
def stm04_health(spark, d):
    """Consecutive failures in the order of event time, from files in any order; a row of its own moves the watermark past all others."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    log = health_log(spark, d)
    end = log.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast(log.schema["source"].dataType).alias("source"), (F.col("ts") + F.expr("interval 400 days")).cast(log.schema["ts"].dataType).alias("ts"), F.lit(0).cast(log.schema["seq"].dataType).alias("seq"), F.lit(True).alias("ok"), F.lit("other").alias("reason"))
    states = drained(spark, streams.stream_health(landed_events(spark, log, last=end), lateness="60 days"), "update").where("source >= 0")
    return merge.keep_one(states, ["source"], [F.desc("_batch")]).drop("_batch")
