"""The given tables as vacancies, exchange rates and skills."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentmill.operators.skills import small

CURRENCY_BY_REGION = ["USD", "EUR", "RUB", "GBP", "PLN"]
RATE_BASES = {"USD": 90, "EUR": 99, "GBP": 110, "PLN": 22}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a vacancy: segment as role family, nation as country, priority as seniority, price as pay."""
    orders, customer, nation = (table(spark, sf_dir, n) for n in ("orders", "customer", "nation"))
    key = F.col("o_orderkey")
    currency = F.element_at(F.array(*(F.lit(c) for c in CURRENCY_BY_REGION)), F.col("n_regionkey") + 1)
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(small(nation, 10_000), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(
        key.alias("job_id"), F.col("c_mktsegment").alias("role_family"), F.col("n_name").alias("country"), F.col("o_orderpriority").alias("seniority"), (F.col("o_orderstatus") == "F").alias("remote"),
        F.when(key % 5 != 0, F.floor(F.col("o_totalprice") * 0.8)).cast("long").alias("salary_from"), F.when(key % 7 != 0, F.floor("o_totalprice")).cast("long").alias("salary_to"),
        currency.alias("currency"), F.to_date("o_orderdate").alias("published_at"), (key % 4 != 0).alias("is_active"), F.concat_ws(" ", "o_orderpriority", "c_mktsegment").alias("title"), (key % 16).cast("int").alias("years_min"),
    )


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly rates to RUB from the third quarter of 1995."""
    days = table(spark, sf_dir, "orders").where("o_orderdate >= timestamp'1995-07-01 00:00:00'").select(F.trunc("o_orderdate", "quarter").alias("rate_date")).distinct()
    bases = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.lit(k).alias("k")) for c, k in RATE_BASES.items())))
    return days.withColumn("b", bases).select("rate_date", F.col("b.c").alias("base_currency"), F.lit("RUB").alias("target_currency"), (F.col("b.k") + F.month("rate_date")).cast("decimal(18,6)").alias("rate"))


def job_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands of an order's parts are its skills; the line decides the source."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    line = F.col("l_linenumber") % 3
    kind = F.when(line == 0, "normalized_array").when(line == 1, "text_extract").otherwise("key_skill")
    return rows.select(F.col("l_orderkey").alias("job_id"), F.substring("p_brand", 7, 10).cast("int").alias("skill_id"), kind.alias("source_type")).distinct()


def skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_type").alias("category")).select(F.substring("p_brand", 7, 10).cast("int").alias("skill_id"), F.col("p_brand").alias("canonical_name"), "category")


#: The same views for DuckDB.
SQL = """
v_jobs AS (
  SELECT o_orderkey AS job_id, c_mktsegment AS role_family, n_name AS country, o_orderpriority AS seniority, (o_orderstatus = 'F') AS remote,
    CASE WHEN o_orderkey % 5 <> 0 THEN CAST(floor(o_totalprice * 0.8) AS BIGINT) END AS salary_from,
    CASE WHEN o_orderkey % 7 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS salary_to,
    CASE n_regionkey WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'RUB' WHEN 3 THEN 'GBP' ELSE 'PLN' END AS currency,
    CAST(o_orderdate AS DATE) AS published_at, (o_orderkey % 4 <> 0) AS is_active, o_orderpriority || ' ' || c_mktsegment AS title, CAST(o_orderkey % 16 AS INT) AS years_min
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
v_rates AS (
  SELECT d.rate_date, c.base_currency, 'RUB' AS target_currency, CAST(c.k + extract(month FROM d.rate_date) AS DECIMAL(18,6)) AS rate
  FROM (SELECT DISTINCT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS rate_date FROM orders WHERE o_orderdate >= TIMESTAMP '1995-07-01 00:00:00') d
  CROSS JOIN (SELECT 'USD' AS base_currency, 90 AS k UNION ALL SELECT 'EUR', 99 UNION ALL SELECT 'GBP', 110 UNION ALL SELECT 'PLN', 22) c),
v_job_skills AS (
  SELECT DISTINCT l_orderkey AS job_id, CAST(substring(p_brand, 7) AS INT) AS skill_id,
    CASE l_linenumber % 3 WHEN 0 THEN 'normalized_array' WHEN 1 THEN 'text_extract' ELSE 'key_skill' END AS source_type
  FROM lineitem JOIN part ON l_partkey = p_partkey),
v_skills AS (SELECT CAST(substring(p_brand, 7) AS INT) AS skill_id, p_brand AS canonical_name, min(p_type) AS category FROM part GROUP BY p_brand),
v_int AS (SELECT base_currency, rate_date, rate, lead(rate_date) OVER (PARTITION BY base_currency ORDER BY rate_date) AS until FROM v_rates),
v_conv AS (
  SELECT j.*, CASE WHEN currency = 'RUB' THEN 1 ELSE CAST(r.rate AS DOUBLE) END AS r
  FROM v_jobs j LEFT JOIN v_int r ON r.base_currency = j.currency AND j.published_at >= r.rate_date AND (r.until IS NULL OR j.published_at < r.until)),
v_mid AS (
  SELECT *, round(salary_from * r, 2) AS low, round(salary_to * r, 2) AS high,
    CASE WHEN salary_from IS NOT NULL AND salary_to IS NOT NULL THEN (round(salary_from * r, 2) + round(salary_to * r, 2)) / 2 WHEN salary_from IS NOT NULL THEN round(salary_from * r, 2) ELSE round(salary_to * r, 2) END AS salary_mid
  FROM v_conv),
v_base AS (SELECT job_id, role_family AS role, country, seniority, remote AS is_remote, salary_mid, years_min, published_at FROM v_mid WHERE is_active)
"""
