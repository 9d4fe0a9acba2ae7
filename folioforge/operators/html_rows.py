"""Tables extracted from html, one row for each thing found, in page order.

Pages may be delivered more than once: rows are made once after extraction, so
the html itself is never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions import markup
from folioforge.functions.html_blocks import extract_blocks
from folioforge.functions.urls import resolve

HEADING = r"(?is)<h([1-6])(?:[ \t\r\n][^>]*)?>(.*?)</h[1-6][ \t\r\n]*>"
ANCHOR = r"""(?is)<a[ \t\r\n][^>]*?href=["']([^"'>]*)["'][^>]*>(.*?)</a[ \t\r\n]*>"""
TITLE = r"(?is)<title(?:[ \t\r\n][^>]*)?>(.*?)</title[ \t\r\n]*>"
JSON_LD = r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script[ \t\r\n]*>"""
PARAGRAPH = r"(?is)<p(?:[ \t\r\n][^>]*)?>(.*?)</p[ \t\r\n]*>"
META = r"(?is)<meta[ \t\r\n][^>]*>"
IMAGE = r"(?is)<img[ \t\r\n][^>]*>"


def all_of(html: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(group))


def blocks(pages: DataFrame) -> DataFrame:
    """``page_id, block_ord, text`` of visible-text blocks (a Python table function: nesting matters)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ords, texts = [], [], []
            for i, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for b in extract_blocks(h):
                    ids.append(i)
                    ords.append(b.ord)
                    texts.append(b.text)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ords, pa.int32()), pa.array(texts, pa.string())], names=["page_id", "block_ord", "text"])

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, block_ord int, text string").dropDuplicates(["page_id", "block_ord"])


def headings(pages: DataFrame) -> DataFrame:
    """``page_id, ord, level, text``; comments and hidden elements are no headings."""
    own = pages.select("page_id", markup.without_hidden(F.col("html")).alias("h"))
    both = F.arrays_zip(all_of(F.col("h"), HEADING, 1).alias("level"), all_of(F.col("h"), HEADING, 2).alias("inner"))
    rows = own.select("page_id", F.posexplode(both).alias("ord", "x"))
    rows = rows.select("page_id", "ord", F.col("x.level").cast("int").alias("level"), markup.plain(F.col("x.inner")).alias("text"))
    return rows.dropDuplicates(["page_id", "ord"])


def first_h1(pages: DataFrame) -> DataFrame:
    """``page_id, h1`` of the pages that have one."""
    return headings(pages).where("level = 1").groupBy("page_id").agg(F.min_by("text", "ord").alias("h1"))


def paragraphs(pages: DataFrame) -> DataFrame:
    own = pages.select("page_id", markup.without_hidden(F.col("html")).alias("h"))
    rows = own.select("page_id", F.posexplode(all_of(F.col("h"), PARAGRAPH, 1)).alias("ord", "inner"))
    return rows.select("page_id", "ord", markup.plain(F.col("inner")).alias("text")).where("text <> ''").dropDuplicates(["page_id", "ord"])


def links(pages: DataFrame) -> DataFrame:
    """``page_id, page_url, ord, href, url, anchor`` of http(s) links."""
    own = pages.select("page_id", "page_url", markup.without_hidden(F.col("html")).alias("h"))
    both = F.arrays_zip(all_of(F.col("h"), ANCHOR, 1).alias("href"), all_of(F.col("h"), ANCHOR, 2).alias("inner"))
    rows = own.select("page_id", "page_url", F.posexplode(both).alias("ord", "x"))
    rows = rows.select("page_id", "page_url", "ord", F.col("x.href").alias("href"), markup.plain(F.col("x.inner")).alias("anchor"))
    return rows.withColumn("url", resolve(F.col("href"), F.col("page_url"))).where("url is not null").dropDuplicates(["page_id", "ord"])


def title(html: Column) -> Column:
    return markup.plain(F.regexp_extract(html, TITLE, 1))


def json_ld(pages: DataFrame) -> DataFrame:
    """``page_id, ord, body`` of structured-data blocks."""
    return pages.select("page_id", F.posexplode(all_of(F.col("html"), JSON_LD, 1)).alias("ord", "body")).dropDuplicates(["page_id", "ord"])


def json_ld_nodes(pages: DataFrame) -> DataFrame:
    """``page_id, ord, type, name, id`` of each parsed block; broken JSON gives no row."""
    v = F.try_parse_json("body")
    rows = json_ld(pages).withColumn("v", v).where("v is not null")
    return rows.select(
        "page_id", "ord",
        *(F.try_variant_get("v", f'$["{k}"]', "string").alias(a) for k, a in (("@type", "type"), ("name", "name"), ("@id", "id"))),
    )
