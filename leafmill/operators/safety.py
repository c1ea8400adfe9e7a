"""Safety budget of archives as window sums and first-match rules.

Fixed values: the caps.  ``enforce=False`` keeps the reasons and refuses nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_MEMBERS, MAX_RATIO, MAX_FILE, MAX_TOTAL, RATIO_FLOOR = 5000, 200, 128 * 1024 * 1024, 8 * 1024 * 1024 * 1024, 64 * 1024


def depth_escapes(name: Column) -> Column:
    """Whether the normalised path leaves its root: the depth goes below zero on the way, or the path is no relative one."""
    path = F.replace(name, F.lit("\\"), F.lit("/"))
    steps = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    walk = F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")), lambda a, s: F.struct((a["at"] + F.when(s == "..", -1).otherwise(1)).alias("at"), F.least(a["low"], a["at"] + F.when(s == "..", -1).otherwise(1)).alias("low")))
    return path.startswith("/") | (F.substring(path, 2, 1) == ":") | (walk["low"] < 0)


def member_reason(name: Column, position: Column, is_link: Column, max_members: int = MAX_MEMBERS) -> Column:
    """Why a member is refused, the first rule that applies; null if none does."""
    path = F.replace(name, F.lit("\\"), F.lit("/"))
    return (
        F.when(position > max_members, "member-count")
        .when(is_link, "link-entry")
        .when(path.startswith("/"), "absolute-path")
        .when((F.length(path) > 1) & (F.substring(path, 2, 1) == ":"), "drive-letter")
        .when(F.array_contains(F.split(path, "/"), ".."), "parent-traversal")
        .when(depth_escapes(name), "commonpath-escape")
    )


def byte_reason(members: DataFrame, max_file: int = MAX_FILE, max_total: int = MAX_TOTAL, max_ratio: int = MAX_RATIO, floor: int = RATIO_FLOOR) -> DataFrame:
    """``members`` (item, position, bytes, compressed) with the running total of their item and a byte rule's reason."""
    total = F.sum("bytes").over(Window.partitionBy("item").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = members.withColumn("total", total)
    ratio = (F.col("compressed") > 0) & (F.col("bytes") >= floor) & (F.col("bytes") / F.col("compressed") > max_ratio)
    return out.withColumn("reason", F.when(F.col("bytes") > max_file, "file-size-cap").when(F.col("total") > max_total, "total-size-cap").when(ratio, "ratio-cap"))


def refuse(members: DataFrame, enforce: bool = True) -> DataFrame:
    """Per item: its first reason in member order, and whether it is refused."""
    first = F.min_by(F.when(F.col("reason").isNotNull(), F.col("reason")), F.when(F.col("reason").isNotNull(), F.col("position")))
    return members.groupBy("item").agg(first.alias("reason")).withColumn("refused", F.lit(enforce) & F.col("reason").isNotNull())
