"""Sources and sinks: registry files, seed data, title lists, exports, SQL tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from masthead.catalogue import GUIDELINES
from masthead.operators.registry import build_registry, map_columns, numbered
from masthead.vocab import SEED_TITLES

#: Fixed schemas of the tables that are kept.
REGISTERED_TITLES = "id BIGINT, title STRING, cleaned_title STRING, anchor_words STRING, registration_no STRING, language STRING, state STRING, periodicity STRING, publisher STRING, phonetic_metaphone STRING, indic_soundex STRING, created_at TIMESTAMP"
APPLICATIONS = "id BIGINT, application_no STRING, title STRING, applicant_id STRING, applicant_name STRING, applicant_email STRING, language STRING, state STRING, periodicity STRING, verification_probability DOUBLE, status STRING, decision_code STRING, diagnostics_json STRING, execution_time_ms DOUBLE, submitted_at TIMESTAMP"
GUIDELINE_TABLE = "guideline_ref STRING, category STRING, title STRING, description STRING, examples ARRAY<STRING>"


def read_raw(spark: SparkSession, path: str, kind: str | None = None, max_rows: int | None = None) -> DataFrame:
    """A registry file of any kind, all columns as strings; kind is taken from the name if not given.

    Spreadsheets are read through the optional ``openpyxl`` and pandas, and only
    then through the driver: a spreadsheet holds a million rows at most.
    """
    kind = kind or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "parquet":
        raw = spark.read.parquet(path)
    elif kind in ("csv", "tsv"):
        raw = spark.read.option("header", True).option("sep", "\t" if kind == "tsv" else ",").option("escape", '"').option("multiLine", True).csv(path)
    elif kind in ("json", "jsonl"):
        raw = spark.read.option("multiLine", kind == "json").json(path)
    elif kind == "orc":
        raw = spark.read.orc(path)
    elif kind in ("xlsx", "xls"):
        try:
            import openpyxl  # noqa: F401
        except ImportError as e:
            raise ImportError("reading spreadsheets needs openpyxl; write the sheet as CSV or Parquet") from e
        import pandas as pd

        raw = spark.createDataFrame(pd.read_excel(path, dtype=str, nrows=max_rows).astype(object).where(lambda d: d.notna(), None))
    else:
        raise ValueError(f"unknown kind of registry file: {kind}")
    raw = raw.limit(max_rows) if max_rows else raw
    return raw.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in raw.columns])


def seed_registry(spark: SparkSession) -> DataFrame:
    rows = [(i, *r, "Daily") for i, r in enumerate(SEED_TITLES)]
    return spark.createDataFrame(rows, "entry_id long, title string, language string, state string, periodicity string")


def load_registry(spark: SparkSession, path: str | None = None, cache: str | None = None, max_rows: int | None = None) -> DataFrame:
    """The registry from its Parquet cache, else from a file, else from the seeds.

    A file that isn't Parquet is written through to the cache.
    """
    if cache and _exists(spark, cache):
        raw = read_raw(spark, cache, "parquet", max_rows)
    elif path:
        raw = read_raw(spark, path, max_rows=max_rows)
        if cache and not path.endswith(".parquet"):
            raw.write.parquet(cache)
    else:
        raw = seed_registry(spark).drop("entry_id").withColumn("registration_no", F.lit(None).cast("string"))
    return build_registry(numbered(map_columns(raw), ["title", "registration_no"]))


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    """(title) from a text file: one a line, trimmed, blank lines dropped."""
    return spark.read.text(path).select(F.trim("value").alias("title")).filter("title <> ''")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Labelled pairs from a JSON list."""
    return spark.read.option("multiLine", True).schema("title_a string, title_b string, expected_relation string, reason string, language string").json(path)


def guidelines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(g) for g in GUIDELINES], GUIDELINE_TABLE)


def find_guidelines(table: DataFrame, query: str) -> DataFrame:
    """Rows whose reference, title, description, category or examples hold the text."""
    q = query.lower()
    here = F.lit(False)
    for c in ("guideline_ref", "title", "description", "category"):
        here = here | F.coalesce(F.lower(c).contains(q), F.lit(False))
    return table.filter(here | F.exists("examples", lambda e: F.lower(e).contains(q)))


def create_tables(spark: SparkSession, database: str = "default") -> None:
    """Empty managed tables where they don't exist."""
    for name, schema in (("registered_titles", REGISTERED_TITLES), ("title_applications", APPLICATIONS), ("guidelines", GUIDELINE_TABLE)):
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({schema}) USING parquet")


def append_new(rows: DataFrame, table: str, key: str) -> None:
    """Append rows whose key the table lacks; rows that are there already change nothing."""
    spark = rows.sparkSession
    rows.join(spark.table(table).select(key), key, "left_anti").select(*spark.table(table).columns).write.mode("append").insertInto(table)


def registered_rows(registry: DataFrame) -> DataFrame:
    """The registry in the shape of its table; ids are entry ids plus one."""
    nothing = F.lit(None).cast("string")
    return registry.select((F.col("entry_id") + 1).alias("id"), "title", "cleaned_title", "anchor_words", "registration_no", "language", "state", "periodicity", "publisher", nothing.alias("phonetic_metaphone"), nothing.alias("indic_soundex"), F.current_timestamp().alias("created_at"))


def write_jdbc(rows: DataFrame, url: str, table: str, batch: int = 5_000, **options: str) -> None:
    rows.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", batch).options(**options).mode("append").save()


def repeated_numbers(registry: DataFrame) -> DataFrame:
    """Registration numbers that stand more than once; the table can't enforce it."""
    return registry.groupBy("registration_no").count().filter("count > 1")


def export_rows(screened: DataFrame, order: str = "query_id") -> DataFrame:
    """The columns of the batch export; the first reason only."""
    return screened.select(F.col(order).alias("no"), "title", F.concat(F.col("verification_probability").cast("string"), F.lit("%")).alias("probability"), "status", "decision", F.coalesce(F.get("reasons", F.lit(0)), F.lit("Passed")).alias("primary_reason"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).mode("overwrite").csv(path)


def application_rows(accepted: DataFrame) -> DataFrame:
    """Accepted applications as rows of their table, with random application numbers."""
    number = F.concat(F.lit("APP-"), F.upper(F.substring(F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")), 1, 8)))
    return accepted.withColumn("application_no", number).withColumn("submitted_at", F.current_timestamp())
