"""Deduplication, upserts, change classification, registry, history and source health."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentmill.operators.rivals import key_hash, may_have_rivals
from talentmill.sources.shared import remove, stored


def key_part(name: str) -> Column:
    """Trimmed text; blank for missing values and their usual spellings."""
    c = F.trim(F.col(name).cast("string"))
    return F.when(c.isNull() | F.lower(c).isin("", "nan", "none", "null"), "").otherwise(c)


def dedupe_key() -> Column:
    """First of: source and its id; source and URL; job id; source, company and title."""
    source, own, url = key_part("source"), key_part("source_job_id"), F.lower(key_part("url"))
    company, title = F.lower(key_part("company_name")), F.lower(key_part("title"))
    return (
        F.when((source != "") & (own != ""), F.concat_ws("::", F.lit("srcid"), source, own))
        .when((source != "") & (url != ""), F.concat_ws("::", F.lit("url"), source, url))
        .when(key_part("job_id") != "", F.concat_ws("::", F.lit("job"), key_part("job_id")))
        .otherwise(F.concat_ws("::", F.lit("title"), source, company, title))
    )


def any_order(df: DataFrame) -> list[Column]:
    """What orders rows that are equal in all else, the same in every run; rows that it leaves together are equal throughout."""
    return [F.xxhash64(*(F.col(c) for c, t in df.dtypes if "map<" not in t and "variant" not in t))]


def keep_one(df: DataFrame, keys: list[str | Column], order: list[Column]) -> DataFrame:
    """First row of each key by an explicit order; ties go by a hash of the row, so that runs repeat."""
    return df.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order, *any_order(df)))).where("_at = 1").drop("_at")


def keep_rank(df: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """First k rows of each key."""
    return df.withColumn("_at", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_at") <= k).drop("_at")


def dedupe(df: DataFrame, order: str) -> DataFrame:
    """Keep-first by the cascading key; ``order`` is the column that says which comes first."""
    return keep_one(df, [dedupe_key()], [F.col(order).asc_nulls_last()])


def merge_latest(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Union in which the new row of a key wins."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return keep_one(both, keys, [F.desc("_new")]).drop("_new")


upsert = merge_latest


def dedupe_multi(df: DataFrame, order: str, keys: list[list[str]]) -> DataFrame:
    """Keep-last on several unique keys at once: a row stays if no newer row that stays shares one of its keys.

    This is the result of going through the rows from the newest to the oldest, reached in rounds of local decisions: a row that is the newest
    of the undecided rows on each of its keys stays, its rivals go, and what is left is decided in the next round.
    Rows that share no key with another stay at once: they are told by hashes of their keys and are neither stored nor shuffled, nor are rows
    without any key; a key of which a part is blank binds nothing. Of the others, rounds move row numbers and keys only, and what they decide is a stored table.
    Rows of equal order go by a hash of the row, equal rows by their number; a null order is the oldest. ``df`` is read more than once;
    one that may change in between is written first."""
    if not df._jdf.queryExecution().analyzed().deterministic():
        df = stored(df, "rows")
    whole = lambda key: reduce(lambda a, b: a & b, (key_part(k) != "" for k in key))
    doubt = may_have_rivals(df, [F.when(whole(key), key_hash(F.lit(i), *(F.col(k).cast("string") for k in key))) for i, key in enumerate(keys)])
    number = F.struct(F.col(order), *any_order(df), F.monotonically_increasing_id())
    rows = stored(df.where(doubt).withColumn("_age", number), "rows")  # written, so that numbers last
    bound = [F.when(whole(key), F.array(F.lit(str(i)), *(F.col(k).cast("string") for k in key))) for i, key in enumerate(keys)]
    undecided = rows.select("_age", F.array_compact(F.array(*bound)).alias("_keys")).where(F.size("_keys") > 0)
    stays, old = [], None
    while True:
        each = undecided.select("_age", F.size("_keys").alias("_n"), F.explode("_keys").alias("_key"))
        newest = each.groupBy("_key").agg(F.max("_age").alias("_age"))  # one row a key: long groups are summed up in their tasks
        kept = stored(newest.groupBy("_age").agg(F.collect_list("_key").alias("_won")).join(undecided, "_age").where(F.size("_won") == F.size("_keys")).select("_age", "_keys"), "kept")
        stays.append(kept.select("_age"))
        taken = kept.select(F.explode("_keys").alias("_key"))
        gone = each.join(taken, "_key", "left_semi").select("_age").distinct()
        left = stored(undecided.join(gone, "_age", "left_anti"), "undecided")
        if old is not None:
            remove(old)
        undecided = old = left
        if undecided.isEmpty():
            break
    decided = reduce(DataFrame.unionByName, stays)
    return df.where(~doubt).unionByName(rows.join(decided, "_age", "left_semi").drop("_age"))


def url_key(url: Column) -> Column:
    return F.substring_index(url, "?", 1)


def dedupe_url(df: DataFrame, order: str, url: str = "url") -> DataFrame:
    """Keep-last by URL without its query string."""
    return keep_one(df, [url_key(F.col(url))], [F.desc(order)])


def dup_report(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def append_new(target: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows whose key the target lacks."""
    return new.join(target.select(key), key, "left_anti")


def merge_sources(parts: list[DataFrame], key: str, newest: str) -> DataFrame:
    """Concatenation of sources, one row an id: the most recently published."""
    return keep_one(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), [key], [F.col(newest).desc_nulls_last()])


def content_hash(columns: list[str], arrays: tuple[str, ...] = ()) -> Column:
    """sha1 of the JSON of the named columns in order of name; arrays sorted, nulls as blanks."""
    values = [(F.array_join(F.array_sort(F.col(c)), "\u001f") if c in arrays else F.col(c).cast("string")) for c in sorted(columns)]
    return F.sha1(F.concat_ws("\u001e", *(F.coalesce(v, F.lit("")) for v in values)).cast("binary"))


def classify_changes(old: DataFrame, new: DataFrame, key: str = "job_id", content: str = "content_hash") -> DataFrame:
    """``new`` with action: inserted, updated or unchanged."""
    before = old.select(key, F.col(content).alias("_old"), F.lit(True).alias("_known"))
    action = F.when(F.col("_known").isNull(), "inserted").when(F.col(content).eqNullSafe(F.col("_old")), "unchanged").otherwise("updated")
    return new.join(before, key, "left").withColumn("action", action).drop("_old", "_known")


def upsert_coalesce(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Upsert that keeps the old value wherever the new one is null."""
    names = [c for c in old.columns if c != key]
    right = new.select(key, *(F.col(c).alias(f"_n_{c}") for c in names))
    return old.join(right, key, "full").select(key, *(F.coalesce(f"_n_{c}", c).alias(c) for c in names))


def merge_registry(registry: DataFrame, seen: DataFrame, run_id: str) -> DataFrame:
    """Registry after a run: first_seen kept, last_seen replaced, seen jobs active again."""
    now = seen.select("job_id", F.col("source").alias("_s"), F.lit(run_id).alias("_run"))
    both = registry.join(now, "job_id", "full")
    return both.select("job_id", F.coalesce("_s", "source").alias("source"), F.coalesce("first_seen_run_id", "_run").alias("first_seen_run_id"), F.coalesce("_run", "last_seen_run_id").alias("last_seen_run_id"), F.when(F.col("_run").isNotNull(), True).otherwise(F.col("is_active")).alias("is_active"))


def deactivate_missing(registry: DataFrame, run_id: str) -> DataFrame:
    """Jobs of sources that took part in the run but were not seen in it become inactive."""
    took_part = registry.where(F.col("last_seen_run_id") == run_id).select("source").distinct().withColumn("_in", F.lit(True))
    gone = F.col("_in").isNotNull() & (F.col("last_seen_run_id") != run_id)
    return registry.join(F.broadcast(took_part) if took_part.limit(10_001).count() <= 10_000 else took_part, "source", "left").withColumn("is_active", F.when(gone, False).otherwise(F.col("is_active"))).drop("_in").select(registry.columns)


def embedding_status(old: DataFrame, new: DataFrame) -> DataFrame:
    """pending where the content changed, else the status before."""
    before = old.select("job_id", F.col("content_hash").alias("_h"), F.col("embedding_status").alias("_e"))
    same = F.col("content_hash").eqNullSafe(F.col("_h"))
    return new.join(before, "job_id", "left").withColumn("embedding_status", F.when(same, F.coalesce("_e", F.lit("pending"))).otherwise("pending")).drop("_h", "_e")


def embed_queue(jobs: DataFrame, n: int) -> DataFrame:
    """Oldest pending jobs with a title and skills."""
    return jobs.where("embedding_status = 'pending' AND trim(title) <> '' AND size(skills) > 0").orderBy(F.col("updated_at").asc_nulls_first(), "job_id").limit(n)


def evict_queue(jobs: DataFrame, registry: DataFrame) -> DataFrame:
    return jobs.where("embedding_status = 'embedded'").join(registry.where("NOT is_active"), "job_id", "left_semi")


# Defaults of a curated record, and statuses that count.
RECORD_DEFAULTS = {"seniority": "unknown", "role_family": "other", "embedding_status": "pending", "relocation": False}
EMBEDDING_STATUSES = ["pending", "created", "failed", "skipped"]


def normalize_record(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejected): reversed bounds of pay and years swapped, defaults for enums and flags, rows without required keys rejected."""
    changes: dict[str, Column] = {}
    for low, high in (("salary_from", "salary_to"), ("years_min", "years_max")):
        if low in df.columns and high in df.columns:
            swap = F.col(low) > F.col(high)
            changes |= {low: F.when(swap, F.col(high)).otherwise(F.col(low)), high: F.when(swap, F.col(low)).otherwise(F.col(high))}
    for name, default in RECORD_DEFAULTS.items():
        if name in df.columns:
            given = F.nullif(F.trim(name), F.lit("")) if isinstance(default, str) else F.col(name)
            changes[name] = F.coalesce(F.when(given.isin(EMBEDDING_STATUSES), given) if name == "embedding_status" else given, F.lit(default))
    filled = df.withColumns(changes)
    if "relocation" not in df.columns:
        filled = filled.withColumn("relocation", F.lit(RECORD_DEFAULTS["relocation"]))
    ok = (key_part("job_id") != "") & (key_part("source") != "") & (key_part("title") != "")
    return filled.where(ok), filled.where(~ok)


def merge_status(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """State with the higher fail count of either side."""
    both = a.unionByName(b)
    rest = [c for c in a.columns if c != key]
    first = F.struct("fail_count", *any_order(both))  # ties go by a hash, so that runs repeat
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), first).alias("s")).select(key, "s.*")


def source_health(log: DataFrame, limits: dict[str, int] | None = None, default: int = 3) -> DataFrame:
    """Consecutive failures of each source since its last success, and whether it is still active.

    ``log``: source, ts, seq, ok, reason. Thresholds by the last failure's reason: permanent 2, temporary 5, other 3."""
    limits = limits or {"permanent": 2, "temporary": 5}
    at = F.struct("ts", "seq")
    won = log.groupBy("source").agg(F.max(F.when(F.col("ok"), at)).alias("won"), F.max(F.when(~F.col("ok"), F.struct("ts", "seq", "reason"))).alias("lost"))
    since = log.join(won, "source").where(~F.col("ok") & (F.col("won").isNull() | (at > F.col("won")))).groupBy("source").agg(F.count("*").alias("fails"))
    limit = reduce(lambda rest, k: F.when(F.col("lost.reason") == k, limits[k]).otherwise(rest), limits, F.lit(default))
    return won.join(since, "source", "left").select("source", F.coalesce("fails", F.lit(0)).cast("long").alias("fail_count"), F.col("lost.reason").alias("last_reason"), (F.coalesce("fails", F.lit(0)) < limit).alias("is_active"))


def change_points(history: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Rows of a history at which any of the columns differs from the row before."""
    before = Window.partitionBy(key).orderBy(order)
    now = F.struct(*columns)
    return history.withColumn("_b", F.lag(now).over(before)).withColumn("_first", F.row_number().over(before) == 1).where(F.col("_first") | ~now.eqNullSafe(F.col("_b"))).drop("_b", "_first")


def content_snapshots(history: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Change points of a text, by its hash."""
    hashed = history.withColumn("description_hash", F.sha1(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    return change_points(hashed, key, order, ["description_hash"])
