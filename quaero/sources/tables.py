"""Readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quaero import schemas


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Scan one of the given parquet tables under its declared schema."""
    return spark.read.schema(schemas.TABLES[name]).parquet(f"{folder}/{name}.parquet")


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables as a stream of its files, be it a file or a folder of files."""
    # Written as a pattern: for a plain path Spark takes the table for the folder of its partitions.
    return spark.readStream.schema(schemas.TABLES[name]).parquet(f"{folder}/{name}.parque[t]")


SPREAD_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small table out evenly for a CPU-bound step.

    A small file is one split.  Beyond ``SPREAD_BYTES``, by Spark's own estimate, the table stays
    as it is: its splits are what ``spark.sql.files.maxPartitionBytes`` makes them, and smaller
    ones are to be had there without a shuffle.
    """
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(size) > SPREAD_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def unescape_newlines(col: Column | str) -> Column:
    """Turn the two characters backslash and n into a line break."""
    return F.replace(F.col(col) if isinstance(col, str) else col, F.lit("\\n"), F.lit("\n"))


REJECTED = "_rejected"


def _csv(spark: SparkSession, path: str, multiline: bool) -> DataFrame:
    """All columns by the names in the header, and the raw text of rows that do not fit it."""
    reader = (spark.read.option("header", True).option("multiLine", multiline).option("escape", '"')
              .option("enforceSchema", False).option("columnPruning", False))
    names = reader.option("inferSchema", False).csv(path).columns
    schema = ", ".join(f"`{n}` string" for n in [*names, REJECTED])
    return reader.schema(schema).option("columnNameOfCorruptRecord", REJECTED).csv(path)


def _read_csv(spark: SparkSession, path: str, schema, multiline: bool) -> DataFrame:
    rows = _csv(spark, path, multiline)
    absent = [n for n in schema.names if n not in rows.columns]
    if absent:
        raise ValueError(f"no column {absent} in {path}; its header has {rows.columns[:-1]}")
    return rows.where(F.col(REJECTED).isNull()).select(schema.names)


def rejected_rows(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """``record``: the rows of a CSV file that have more or fewer fields than its header."""
    rows = _csv(spark, path, multiline)
    # Spark only tells the raw text along with some other column: the first, none of it shown.
    other = F.coalesce(F.left(F.col(f"`{rows.columns[0]}`"), F.lit(0)), F.lit(""))
    return rows.where(F.col(REJECTED).isNotNull()).select(F.concat(F.col(REJECTED), other).alias("record"))


def read_custom_passages(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Hand-written passages ``url, page_contents, content``; empty fields become ''.

    Columns go by the header, which all files of a folder share; rows that do not fit it are in
    `rejected_rows`.  ``multiline`` allows line breaks inside quoted fields; a file is then one task.
    """
    return _read_csv(spark, path, schemas.CUSTOM_PASSAGES, multiline).na.fill("")


def read_eval_set(spark: SparkSession, path: str, unescape: bool = True,
                  multiline: bool = False) -> DataFrame:
    """Question-answer pairs with string ids; a literal backslash-n becomes a line break."""
    df = _read_csv(spark, path, schemas.EVAL_SET, multiline)
    if unescape:
        df = df.withColumn("expected_response", unescape_newlines("expected_response"))
    return df


def use_namespace(spark: SparkSession, database: str, catalog: str | None = None,
                  location: str | None = None) -> str:
    """Switch to a database, creating it on first use; returns the current catalog."""
    if catalog:
        known = {c.name for c in spark.catalog.listCatalogs()}
        if catalog not in known:
            raise ValueError(f"catalog {catalog!r} is not configured; known: {sorted(known)}")
        spark.catalog.setCurrentCatalog(catalog)
    place = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`{place}")
    spark.catalog.setCurrentDatabase(database)
    return spark.catalog.currentCatalog()


def overwrite_table(df: DataFrame, table: str) -> DataFrame:
    """Replace a managed table.  The input must not read from the same table."""
    df.write.mode("overwrite").saveAsTable(table)
    return df.sparkSession.table(table)


def recreate_table(df: DataFrame, table: str) -> DataFrame:
    """Drop the table if it is there, then create it."""
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
    df.write.saveAsTable(table)
    return df.sparkSession.table(table)


def snapshot_table(spark: SparkSession, table: str, suffix: str = "_original") -> DataFrame:
    """Copy a stage before the next one changes it."""
    return overwrite_table(spark.table(table), f"{table}{suffix}")


def append_log(log: DataFrame, path: str) -> DataFrame:
    """Add one run's rows to the retrieval log, one folder per run; a retry replaces its own rows."""
    (log.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id").parquet(path))
    names = schemas.RETRIEVAL_LOG.names
    return log.sparkSession.read.schema(schemas.RETRIEVAL_LOG).parquet(path).select(names)
