"""Scans and record sources (K1, K2, K6).

Every reader takes an explicit schema: no inference pass over the data, and
the same column types whatever the file says.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import RAW_REQUEST, RESPONSE, TRANSACTION


def has_files(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds a file that Spark's readers would see."""
    return bool(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path").take(1))


def csv_columns(spark: SparkSession, path: str) -> list[str]:
    """The header of the first file: Spark's own reading of the names, without a pass over the data."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path).columns


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table by the names of its header, every field as text: any column order, extra columns allowed.

    Files of one folder share a header; a file whose header differs fails the read (``enforceSchema`` off).
    """
    text = T.StructType([T.StructField(c, T.StringType()) for c in csv_columns(spark, path)])
    return spark.read.schema(text).option("header", True).option("enforceSchema", False).csv(path)


def read_transactions(spark: SparkSession, path: str, fmt: str = "csv", schema=TRANSACTION) -> DataFrame:
    """K1: a table of transactions, columns selected by name and cast to ``schema``.

    A value that is no number of its column's type becomes null, so that
    ``validate`` or a fit reports it and one bad row does not fail the scan.
    Parquet (or any other format Spark reads) is cast the same way, so
    projections and filters still reach the scan.
    """
    df = read_csv_text(spark, path) if fmt == "csv" else spark.read.format(fmt).load(path)
    lacking = [f.name for f in schema.fields if f.name not in df.columns]
    if lacking and fmt == "csv":
        raise ValueError(f"{path} has no column {', '.join(lacking)}")
    return df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields if f.name in df.columns])


def from_records(spark: SparkSession, records: Iterable[Mapping], schema=RAW_REQUEST) -> DataFrame:
    """K2: typed records (request bodies) as a table; fields missing from a record are null.

    With the default text schema every value is kept as written, so that
    ``validate`` can tell a bad value from a missing one.
    """
    names = [f.name for f in schema.fields]
    rows = [tuple(None if r.get(n) is None else (str(r[n]) if schema is RAW_REQUEST else r[n]) for n in names) for r in records]
    return spark.createDataFrame(rows, schema)


def once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """``df`` and new columns that are computed once a row.

    The optimiser copies an expression to wherever its column is read, into filters and
    below conditions too; the one row a generator gives is a value that it does not take apart.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def parse_json_requests(df: DataFrame, text_col: str = "value") -> DataFrame:
    """K2 for JSON text: one request body per row, every field kept as text.

    Adds ``_present``, the array of keys the body carries, so a missing field
    and an explicit null stay distinguishable, and ``_malformed`` with the raw
    text for bodies that are no JSON object (``validate`` reads both). A body
    is parsed once, however many fields and checks read it (``once``).
    """
    keys = F.json_object_keys("_raw")  # null unless the body is a JSON object
    parsed = once(df.select(F.col(text_col).alias("_raw")), {"_request": F.from_json("_raw", RAW_REQUEST), "_present": keys})
    return parsed.select(
        *[F.col(f"_request.{f.name}").alias(f.name) for f in RAW_REQUEST.fields],
        "_present",
        F.col("_present").isNull().alias("_malformed"),
        "_raw",
    )


def response_to_json(df: DataFrame, col_name: str = "response") -> DataFrame:
    """K5: the nested response record as one JSON text per row."""
    return df.select(F.to_json(F.struct(*[F.col(f.name) for f in RESPONSE.fields])).alias(col_name))


def response_from_json(text: Column | str) -> Column:
    """K6: JSON text back to the typed response struct."""
    return F.from_json(F.col(text) if isinstance(text, str) else text, RESPONSE)


def write_responses(responses: DataFrame, path: str, fmt: str = "json", mode: str = "errorifexists") -> None:
    """K5 sink: response records as JSON lines (nested map kept) or Parquet."""
    responses.write.mode(mode).format(fmt).save(path)


def baseline_row(df: DataFrame, features) -> list[float]:
    """K8 with a custom background: the first row of a one-row table as the baseline."""
    rows = df.select(*[F.col(f).cast("double") for f in features]).take(2)
    if len(rows) != 1:
        raise ValueError("the baseline table must hold exactly one row")
    return [float(v) for v in rows[0]]


def select_features(df: DataFrame, features) -> DataFrame:
    """The model inputs in their fixed order, as doubles."""
    return df.select(*[F.col(f).cast("double").alias(f) for f in features])
