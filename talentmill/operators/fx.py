"""Currency conversion: as-of joins, latest rates, cross rates and repricing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentmill.operators.skills import small

#: Days of rates, over all pairs, up to which they are broadcast; beyond, facts and rates are sorted together.
BROADCAST_ROWS = 2_000_000
#: Facts of a currency and month that one task sorts.
TASK_ROWS = 1_000_000


def rate_intervals(rates: DataFrame) -> DataFrame:
    """Each rate with the date from which the next one of its pair holds; of several of a day the greatest counts."""
    pair = Window.partitionBy("base_currency", "target_currency").orderBy("rate_date", "rate")
    return rates.select("base_currency", "target_currency", "rate_date", "rate", F.lead("rate_date").over(pair).alias("until"))


def rates_by_day(rates: DataFrame, target: str) -> DataFrame:
    """(_from, _first, _days): for each currency its rates to ``target`` of every day from the first date to the last."""
    own = rate_intervals(rates.where((F.col("target_currency") == target) & F.col("rate_date").isNotNull()))
    held = F.struct("rate_date", F.coalesce(F.datediff("until", "rate_date"), F.lit(1)).alias("n"), "rate")
    listed = own.groupBy("base_currency").agg(F.min("rate_date").alias("_first"), F.sort_array(F.collect_list(held)).alias("held"))  # as many as a currency has dates
    return listed.select(F.col("base_currency").alias("_from"), "_first", F.flatten(F.transform("held", lambda h: F.array_repeat(h["rate"], h["n"]))).alias("_days"))


def as_of_rate(facts: DataFrame, rates: DataFrame, target: str, currency: str = "currency", date: str = "date", name: str = "rate", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``facts`` with the latest rate to ``target`` on or before each row's date; 1 for the target itself, null where none is known.

    A rate table of a bounded number of days is broadcast as one array a currency, in which a row's date is a place: what
    a row costs does not depend on how many dates there are. A larger one is sorted together with the facts (``as_of_by_sort``)."""
    quoted = rates.where(F.col("target_currency") == target).agg(F.datediff(F.max("rate_date"), F.min("rate_date")).alias("span"), F.approx_count_distinct("base_currency", 0.01).alias("n")).first()
    days = (quoted["span"] or 0) * quoted["n"] * 1.05  # at most, with what the count may be off
    if days > broadcast_rows:
        return as_of_by_sort(facts, rates, target, currency, date, name)
    cur, day = F.upper(F.trim(F.col(currency))), F.col(date)
    joined = facts.join(F.broadcast(rates_by_day(rates, target)), cur == F.col("_from"), "left")
    found = F.when(day.isNotNull(), F.get("_days", F.least(F.datediff(day, F.col("_first")), F.size("_days") - 1)))
    return joined.withColumn(name, F.when(cur == target, F.lit(1).cast("decimal(18,6)")).otherwise(found)).drop("_from", "_first", "_days")


def as_of_by_sort(facts: DataFrame, rates: DataFrame, target: str, currency: str = "currency", date: str = "date", name: str = "rate", task_rows: int = TASK_ROWS) -> DataFrame:
    """The same by one sort: facts and rates of a currency and month go to a task together, in order of date, and each fact takes the last rate before it.

    A month's first facts take the rate carried over from earlier months, which a pass over (currency, month) finds. Months with more facts
    than ``task_rows`` are split by a hash of the row, each part with the month's rates, so that one currency with most of the
    rows is spread. Facts of ``target`` itself, and those without currency or date, are not moved."""
    cur = F.upper(F.trim(F.col(currency)))
    bound = F.coalesce((cur != target) & F.col(date).isNotNull(), F.lit(False))
    rest = facts.where(~bound).withColumn(name, F.when(cur == target, F.lit(1)).cast("decimal(18,6)"))
    month = lambda c: F.trunc(F.col(c), "month")
    own = rates.where((F.col("target_currency") == target) & F.col("rate_date").isNotNull()).select(F.col("base_currency").alias("_from"), month("rate_date").alias("_month"), F.col("rate_date").alias("_at"), F.col("rate").alias("_rate"))
    asked = facts.where(bound).select(cur.alias("_from"), month(date).alias("_month"), F.struct(*(F.col(c) for c in facts.columns)).alias("_row"), F.xxhash64(*(c for c, t in facts.dtypes if "map<" not in t)).alias("_hash"))
    counts = asked.groupBy("_from", "_month").agg(F.ceil(F.count("*") / task_rows).cast("int").alias("_parts"))
    ends = own.groupBy("_from", "_month").agg(F.max_by("_rate", F.struct("_at", "_rate")).alias("_end"))
    before = Window.partitionBy("_from").orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as a currency has months
    months = counts.join(ends, ["_from", "_month"], "full").select("_from", "_month", "_parts", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    wanted = small(months.where("_parts is not null"))
    part = F.pmod("_hash", F.col("_parts")).cast("int")
    left = asked.join(wanted, ["_from", "_month"]).select("_from", "_month", part.alias("_part"), F.col(f"_row.{date}").cast("date").alias("_at"), F.lit(1).alias("_late"), F.lit(None).cast(own.schema["_rate"].dataType).alias("_rate"), "_carried", "_row")
    right = own.join(wanted, ["_from", "_month"]).select("_from", "_month", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), F.col("_at").cast("date").alias("_at"), F.lit(0).alias("_late"), "_rate", F.lit(None).cast(months.schema["_carried"].dataType).alias("_carried"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"))
    upto = Window.partitionBy("_from", "_month", "_part").orderBy("_at", "_late", "_rate").rowsBetween(Window.unboundedPreceding, 0)
    found = left.unionByName(right).withColumn("_found", F.last("_rate", ignorenulls=True).over(upto)).where("_late = 1")
    return found.select("_row.*", F.coalesce("_found", "_carried").cast("decimal(18,6)").alias(name)).unionByName(rest)


def convert(amount: Column, rate: Column) -> Column:
    """Rounded half-up to two places; null without a rate."""
    return F.round(amount.cast("decimal(18,2)") * rate, 2).cast("double")


def midpoint(low: Column, high: Column) -> Column:
    """Mean of both bounds, else the one present."""
    return F.coalesce((low + high) / 2, low, high)


def with_mid(jobs: DataFrame, rates: DataFrame, target: str, date: str = "published_at", name: str = "salary_mid", keep_raw: bool = False) -> DataFrame:
    """``jobs`` with the converted midpoint; one rate serves both bounds. ``keep_raw`` uses the raw amount where no rate is known."""
    rated = as_of_rate(jobs, rates, target, date=date, name="_r")
    low, high = convert(F.col("salary_from"), F.col("_r")), convert(F.col("salary_to"), F.col("_r"))
    if keep_raw:
        low, high = F.coalesce(low, F.col("salary_from").cast("double")), F.coalesce(high, F.col("salary_to").cast("double"))
    return rated.withColumn(name, midpoint(low, high)).drop("_r")


def latest_rates(rates: DataFrame) -> DataFrame:
    """Newest rate of each pair."""
    return rates.groupBy("base_currency", "target_currency").agg(F.max_by("rate", "rate_date").alias("rate"), F.max("rate_date").alias("rate_date"))


def cross_rates(rates: DataFrame, hub: str = "RUB") -> DataFrame:
    """All rates between currencies quoted against ``hub`` on a day, including the hub; equal pairs have rate 1."""
    quoted = rates.where(F.col("target_currency") == hub).select("rate_date", F.col("base_currency").alias("c"), F.col("rate").cast("double").alias("v"))
    quoted = quoted.unionByName(quoted.select("rate_date").distinct().select("rate_date", F.lit(hub).alias("c"), F.lit(1.0).alias("v")))
    a = quoted.select("rate_date", F.col("c").alias("base_currency"), F.col("v").alias("x"))
    b = quoted.select("rate_date", F.col("c").alias("target_currency"), F.col("v").alias("y"))
    return a.join(b, "rate_date").select("rate_date", "base_currency", "target_currency", F.round(F.col("x") / F.col("y"), 6).alias("rate"))


def currency_views(jobs: DataFrame, rates: DataFrame, hub: str = "RUB", targets: tuple[str, ...] = ("USD", "EUR", "RUB")) -> DataFrame:
    """Midpoints in several currencies at once, through the hub: one as-of join for the job's rate and one for each target."""
    out = with_mid(jobs, rates, hub, name=f"mid_{hub.lower()}")
    for t in targets:
        if t != hub:
            rated = as_of_rate(out.withColumn("_t", F.lit(t)), rates, hub, currency="_t", date="published_at", name="_rt").drop("_t")
            out = rated.withColumn(f"mid_{t.lower()}", F.round(F.col(f"mid_{hub.lower()}") / F.col("_rt").cast("double"), 2)).drop("_rt")
    return out


def reprice(jobs: DataFrame, rates: DataFrame, fallback: Column, target: str = "RUB") -> DataFrame:
    """Bounds in ``target`` by official rates; the fallback rate where none is known."""
    rated = as_of_rate(jobs, rates, target, date="published_at", name="_r").withColumn("_r", F.coalesce(F.col("_r").cast("double"), fallback))
    return rated.withColumn("salary_from_rub", F.bround(F.col("salary_from") * F.col("_r")).cast("long")).withColumn("salary_to_rub", F.bround(F.col("salary_to") * F.col("_r")).cast("long")).withColumn("official", F.lit(True)).drop("_r", "official")


def complete_dates(rates: DataFrame, currencies: list[str]) -> DataFrame:
    """Rates of days on which all the currencies are quoted."""
    own = rates.where(F.col("base_currency").isin(currencies))
    full = own.groupBy("rate_date").agg(F.countDistinct("base_currency").alias("n")).where(F.col("n") == len(currencies)).select("rate_date")
    return own.join(full, "rate_date", "left_semi")


def resolve_rates(days: DataFrame, primary: DataFrame, secondary: DataFrame, hub: str = "RUB", link: str = "EUR", lookback: int = 10) -> DataFrame:
    """For each day the last date within ``lookback`` days that both sources have; currencies that the
    primary one (against ``link``) lacks are filled in by the secondary one (against ``hub``) over the link's hub rate."""
    common = primary.select("rate_date").distinct().join(secondary.select("rate_date").distinct(), "rate_date")
    at = days.join(common, (F.col("rate_date") <= F.col("day")) & (F.col("rate_date") >= F.date_sub("day", lookback)), "left").groupBy("day").agg(F.max("rate_date").alias("rate_date"))
    linked = secondary.where(F.col("base_currency") == link).select("rate_date", F.col("rate").cast("double").alias("link_rate"))
    extra = secondary.join(linked, "rate_date").where(F.col("base_currency") != link).select("rate_date", F.col("base_currency").alias("currency"), (F.col("link_rate") / F.col("rate").cast("double")).alias("b"))
    extra = extra.unionByName(linked.select("rate_date", F.lit(hub).alias("currency"), F.col("link_rate").alias("b")))
    own = primary.select("rate_date", F.col("base_currency").alias("currency"), F.col("rate").cast("double").alias("a"))
    both = own.join(extra, ["rate_date", "currency"], "full").select("rate_date", "currency", F.round(F.coalesce("a", "b"), 6).alias("rate"))
    return at.join(both, "rate_date").select("day", "rate_date", "currency", "rate")


def days_between(spark, first: str, last: str) -> DataFrame:
    return spark.sql(f"SELECT explode(sequence(date'{first}', date'{last}')) AS day")
