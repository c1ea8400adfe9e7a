"""The engine's record types, read from the driver's tables; each with the SQL that gives DuckDB the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive members: (page_id, item, member, bytes); the url's host is the item, its path the member's name."""
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.regexp_extract("url", r"://([^/?#]*)", 1).alias("item"),
        F.regexp_extract("url", r"://[^/?#]*/?([^?#]*)", 1).alias("member"),
        F.octet_length("html").cast("long").alias("bytes"),
    )


MEMBERS = r"""members as (select page_id, regexp_extract(url, '://([^/?#]*)', 1) as item, regexp_extract(url, '://[^/?#]*/?([^?#]*)', 1) as member, cast(strlen(html) as bigint) as bytes from pages)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected boxes: (page, id, x0, y0, x1, y1), whole numbers; ids count up within a page."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as page",
        "cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) as bigint) as id",
        "(l_partkey * 37) % 400 as x0",
        "(l_suppkey * 53) % 400 as y0",
        "(l_partkey * 37) % 400 + 20 + cast(l_quantity as int) * 2 as x1",
        "(l_suppkey * 53) % 400 + 20 + (l_linenumber * 17) % 60 as y1",
    )


BOXES = """boxes as (select l_orderkey as page,
  row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) as id,
  (l_partkey * 37) % 400 as x0, (l_suppkey * 53) % 400 as y0, (l_partkey * 37) % 400 + 20 + cast(trunc(l_quantity) as int) * 2 as x1,
  (l_suppkey * 53) % 400 + 20 + (l_linenumber * 17) % 60 as y1 from lineitem)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lines: (doc_id, line, text)."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))


LINES = "lines as (select doc_id, unnest(range(len(s)))::int as line, unnest(s) as text from (select doc_id, string_split(text, chr(10)) as s from documents))"
