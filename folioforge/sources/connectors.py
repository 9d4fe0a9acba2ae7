"""Sources and sinks beside Parquet tables."""

from __future__ import annotations

import gzip
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FINDINGS = "id string, severity string, track string, skill string, confidence string, page_id long, host string, page_url string"
MOST_BYTES = 20_000_000


def read_html_files(spark: SparkSession, path: str) -> DataFrame:
    """``page_url, html`` of whole files, one page each."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("page_url"), F.col("value").alias("html"))


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """Findings written as JSON lines; a line that can't be read is one row with
    ``id`` ``*``, so that it stays visible."""
    schema = T._parse_datatype_string(FINDINGS + ", broken string")
    df = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").json(path)
    return df.withColumn("id", F.when(F.col("broken").isNotNull(), "*").otherwise(F.col("id")))


def write_findings(findings: DataFrame, path: str) -> None:
    findings.select(F.to_json(F.struct(*findings.columns)).alias("value")).write.mode("overwrite").text(path)


def decode_body(body: bytes | None, encoding: str | None, charset: str | None) -> str | None:
    """Text of a fetched body: content codings from the last to the first, then
    the declared charset, UTF-8 or windows-1252.  Null for unknown codings,
    broken data and bodies beyond ``MOST_BYTES``."""
    if body is None:
        return None
    for coding in reversed([c.strip().lower() for c in (encoding or "").split(",") if c.strip()]):
        try:
            if coding in ("gzip", "x-gzip"):
                body = gzip.decompress(body)
            elif coding == "deflate":
                try:
                    body = zlib.decompress(body)
                except zlib.error:
                    body = zlib.decompress(body, -zlib.MAX_WBITS)
            elif coding != "identity":
                return None
        except (OSError, EOFError, zlib.error):
            return None
        if len(body) > MOST_BYTES:
            return None
    for name in (charset, "utf-8"):
        try:
            return body.decode(name) if name else body.decode("utf-8")
        except (LookupError, UnicodeDecodeError):
            continue
    return body.decode("windows-1252", "replace")


def decoded(body: Column, encoding: Column, charset: Column) -> Column:
    """:func:`decode_body` of columns, in Arrow batches."""
    import pandas as pd

    @F.pandas_udf("string")
    def run(b: pd.Series, e: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([decode_body(None if x is None else bytes(x), y, z) for x, y, z in zip(b, e, c)])

    return run(body, encoding, charset)


def is_public_host(host: Column) -> Column:
    """False for hosts of private, loopback, link-local, multicast and reserved addresses and for bare names."""
    private = r"^(?:10\.|127\.|0\.|169\.254\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|22[4-9]\.|23[0-9]\.|24[0-9]\.|25[0-5]\.)|^localhost$|^\[(?:::1?|f[cde])|^[^.\[]+$"
    return ~F.lower(host).rlike(private) & (host != "")
