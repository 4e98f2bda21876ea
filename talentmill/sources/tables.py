"""Snapshots: schemas, tolerant reads, latest pointers and versioned writes."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Raw record, in order. Lists are JSON text.
_TYPES = {"double": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType()}
_NUMBERS = ("salary_from", "salary_to", "years_experience_min", "years_experience_max")
_FLAGS = ("remote", "visa_sponsorship", "relocation")
_NAMES = """job_id source_job_id title description company_name department salary_from salary_to currency salary_period location country remote remote_type
employment_type published_at source url search_query parsed_at requirements responsibilities nice_to_have experience_level seniority_normalized years_experience_min
years_experience_max key_skills skills_extracted skills_normalized tech_stack_tags tools methodologies visa_sponsorship relocation benefits industry company_size
education certifications spoken_languages equity_bonus security_clearance"""
RAW = T.StructType([T.StructField(n, _TYPES["double" if n in _NUMBERS else "boolean" if n in _FLAGS else "string"]) for n in _NAMES.split()])
JUNK = ["experience_level", "industry", "company_size", "education", "certifications", "benefits", "equity_bonus", "security_clearance", "search_query"]


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names below a path, sorted; none if it is not there."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_snapshot(spark: SparkSession, paths: str | list[str], schema: T.StructType = RAW) -> DataFrame:
    """CSV with a declared schema; a byte order mark, quotes and line breaks inside fields are taken."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").option("enforceSchema", False).csv(paths)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType = RAW) -> DataFrame:
    return read_snapshot(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def resolve_inputs(spark: SparkSession, root: str, date: str, keys: list[str] | None = None) -> list[str]:
    """Given keys, else every .csv of the date's runs."""
    if keys:
        return [f"{root}/{k}" for k in keys]
    return [f"{root}/raw/{date}/{run}/{f}" for run in children(spark, f"{root}/raw/{date}") for f in children(spark, f"{root}/raw/{date}/{run}") if f.endswith(".csv")]


def read_many(spark: SparkSession, paths: list[str], schema: T.StructType = RAW) -> DataFrame:
    """Rows of all files that can be read; fails only if none of them is there. A file that is missing or empty, or whose header does not
    name the schema's columns, and rows that do not fit the schema are left out (``read_tolerant`` tells which)."""
    return read_tolerant(spark, paths, schema)[0]


def read_tolerant(spark: SparkSession, paths: list[str], schema: T.StructType = RAW) -> tuple[DataFrame, DataFrame]:
    """(rows, damaged): what fits the schema, and a table (file, reason, record) of what does not.

    All files are read by one job, first lines and records alike; a file's first record is its header. Reasons: ``missing`` and ``empty`` (no
    record), ``header`` (the file's first record; none of its others is read), ``columns`` (too few or many), ``type: name`` (a value
    that is not of its column's type). What exists is asked by one listing a folder."""
    folders: dict[str, set[str]] = {}
    for path in paths:
        folder = path.rsplit("/", 1)[0]
        folders.setdefault(folder, set(children(spark, folder)))
    found = [p for p in paths if p.rsplit("/", 1)[1] in folders[p.rsplit("/", 1)[0]]]
    if not found:
        raise FileNotFoundError(f"none of {len(paths)} files is there")
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema] + [T.StructField("_record", T.StringType())])
    reader = spark.read.schema(text).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").option("columnNameOfCorruptRecord", "_record").option("mode", "PERMISSIVE")
    # a file is read by one task from its start, so the least number in it is that of its first record
    raw = reader.csv(found).select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at"))
    first = raw.groupBy("_file").agg(F.min_by(F.struct("_at", "_record", *schema.names), "_at").alias("_head"))
    names = [F.trim(F.ltrim(F.coalesce(F.col(f"_head.{n}"), F.lit("")), F.lit("\ufeff"))) == n for n in schema.names]
    heads = first.select("_file", F.col("_head._at").alias("_first"), F.concat_ws(",", *(f"_head.{n}" for n in schema.names)).alias("_line"), (reduce(lambda a, b: a & b, names) & F.col("_head._record").isNull()).alias("_good"))
    rows = raw.join(heads, "_file").where("_good AND _at > _first")
    wrong = reduce(lambda rest, f: F.when(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull(), F.lit(f"type: {f.name}")).otherwise(rest), reversed([f for f in schema if f.dataType != T.StringType()]), F.lit(None).cast("string"))
    judged = rows.withColumn("_reason", F.when(F.col("_record").isNotNull(), "columns").otherwise(wrong))
    good = judged.where("_reason is null").select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema))
    record = F.coalesce("_record", F.concat_ws(",", *(F.coalesce(n, F.lit("")) for n in schema.names)))
    name = F.substring_index("_file", "/", -1)
    bad = judged.where("_reason is not null").select(name.alias("file"), F.col("_reason").alias("reason"), record.alias("record"))
    bad = bad.unionByName(heads.where("NOT _good").select(name.alias("file"), F.lit("header").alias("reason"), F.col("_line").alias("record")))
    asked = spark.createDataFrame([(p.rsplit("/", 1)[1], p in set(found)) for p in paths], "file string, there boolean")
    without = asked.join(heads.select(name.alias("file")), "file", "left_anti")
    return good, bad.unionByName(without.select("file", F.when(F.col("there"), "empty").otherwise("missing").alias("reason"), F.lit(None).cast("string").alias("record")))


def resolve_clean(spark: SparkSession, root: str, key: str | None = None) -> str | None:
    """Given snapshot, else the latest pointer, else the newest date and run."""
    if key:
        return f"{root}/{key}"
    latest = read_pointer(spark, f"{root}/clean/latest")
    if latest:
        return f"{root}/clean/{latest}"
    dates = [d for d in children(spark, f"{root}/clean") if d.startswith("run_date=")]
    runs = children(spark, f"{root}/clean/{dates[-1]}") if dates else []
    return f"{root}/clean/{dates[-1]}/{runs[-1]}" if runs else None


def write_snapshot(df: DataFrame, root: str, date: str, run: str) -> str:
    """Append-only Parquet partition of a run."""
    path = f"{root}/clean/run_date={date}/run_id={run}"
    df.write.mode("errorifexists").parquet(path)
    return path


def write_latest(df: DataFrame, root: str, keep: int = 10) -> str:
    """Write a new version beside the others, then point to it. The pointer is the greatest-numbered file of a folder, written
    whole before it gets its name, so that readers see the version before or the new one, also if the writer dies. Versions and
    pointers older than the newest ``keep`` are deleted."""
    spark, version = df.sparkSession, f"version={uuid.uuid4().hex}"
    df.write.parquet(f"{root}/clean/{version}")
    write_pointer(spark, f"{root}/clean/latest", version)
    pointers = [n for n in children(spark, f"{root}/clean/latest") if n.isdigit()]
    named = {n: spark.read.text(f"{root}/clean/latest/{n}").first()[0] for n in pointers[:-keep]}
    kept = {spark.read.text(f"{root}/clean/latest/{n}").first()[0] for n in pointers[-keep:]} if named else set()
    for pointer, old in named.items():
        for path in [f"{root}/clean/latest/{pointer}", *([f"{root}/clean/{old}"] if old not in kept else [])]:
            fs, place = _fs(spark, path)
            fs.delete(place, True)
    return f"{root}/clean/{version}"


def read_pointer(spark: SparkSession, folder: str) -> str | None:
    """Content of the newest pointer of a folder."""
    names = [n for n in children(spark, folder) if n.isdigit()]
    return spark.read.text(f"{folder}/{names[-1]}").first()[0] if names else None


def write_pointer(spark: SparkSession, folder: str, value: str) -> None:
    """Add a pointer after the newest one; fails if another writer has taken its number."""
    names = [n for n in children(spark, folder) if n.isdigit()]
    number = int(names[-1]) + 1 if names else 0
    if not write_numbered(spark, folder, number, value):
        raise RuntimeError(f"pointer {number} of {folder} is taken")


def write_numbered(spark: SparkSession, folder: str, number: int, value: str) -> bool:
    """Whether the file of this number is ours now: written whole under a hidden name, then renamed, which fails where the number is taken."""
    fs, hidden = _fs(spark, f"{folder}/.{uuid.uuid4().hex}")
    place = _fs(spark, f"{folder}/{number:012d}")[1]
    out = fs.create(hidden, False)
    out.write(bytearray(value.encode()))
    out.close()
    if not fs.exists(place) and fs.rename(hidden, place):
        return True
    fs.delete(hidden, False)
    return False


def append_table(df: DataFrame, name: str) -> None:
    df.write.mode("append").saveAsTable(name)


def ensure_columns(df: DataFrame, schema: T.StructType = RAW) -> DataFrame:
    """Missing columns as nulls, declared ones first and in order, the rest kept."""
    have = set(df.columns)
    out = df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in have})
    return out.select(*schema.names, *(c for c in df.columns if c not in schema.names))


def drop_junk(df: DataFrame, junk: list[str] = JUNK) -> DataFrame:
    return df.drop(*junk, *(c for c in df.columns if c.startswith("Unnamed")))
