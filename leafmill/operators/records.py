"""Region records: stored translations and edits, placement, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text


def apply_translations(regions: DataFrame, stored: DataFrame, on: list[str]) -> DataFrame:
    """Regions with their stored decision.

    ``stored`` has ``on``, text (null: the model saw no text there) and edited.
    State: punctuation (set aside before any model), missing (nothing stored),
    vision (stored null), edited or translated.
    """
    known = stored.withColumn("found", F.lit(True)).withColumnRenamed("text", "stored_text")
    joined = regions.join(known, on, "left")
    state = (
        F.when(text.punctuation_only(F.col("text")), "punctuation")
        .when(F.col("found").isNull(), "missing")
        .when(F.col("stored_text").isNull(), "vision")
        .when(F.col("edited"), "edited")
        .otherwise("translated")
    )
    return joined.withColumn("state", state).drop("found")


def upsert(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """Translations after new replies: an edited entry stays, what the reply leaves out stays, a null reply is a value."""
    o = old.withColumn("was", F.lit(True)).alias("o")
    n = new.withColumn("now", F.lit(True)).alias("n")
    joined = o.join(n, on, "full_outer")
    take = F.col("now").isNotNull() & ~F.coalesce(F.col("o.edited"), F.lit(False))
    pick = lambda c: F.when(take, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return joined.select(*on, pick("text").alias("text"), F.coalesce(F.when(~take, F.col("o.edited")), F.lit(False)).alias("edited"), (take & F.col("n.text").isNull()).alias("boxed"))


def evict(entries: DataFrame, target: int, buckets: int = 1024) -> DataFrame:
    """Entries (key, bytes, used, pinned) to remove, oldest first, until the total is at most ``target``; pinned ones stay.

    The running sum over all entries is taken in two steps: per bucket of equal
    shares of the order (by a bounded quantile sketch), then inside a bucket on top of the sum
    of those before, so that no task sees all entries.
    """
    total = entries.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    free = entries.where("not pinned")
    cuts = free.stat.approxQuantile("used", [i / buckets for i in range(1, buckets)], 0.001) if total > target else []
    cuts = sorted(set(cuts))
    bucket = F.aggregate(F.array(*map(F.lit, cuts)), F.lit(0), lambda a, c: a + F.when(F.col("used") > c, 1).otherwise(0)) if cuts else F.lit(0)
    from pyspark.sql import Window

    dealt = free.withColumn("b", bucket)
    sums = dealt.groupBy("b").agg(F.sum("bytes").alias("s"))
    before = sums.withColumn("before", F.coalesce(F.sum("s").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("b", "before")
    inside = Window.partitionBy("b").orderBy("used", "key").rowsBetween(Window.unboundedPreceding, -1)
    freed = dealt.join(F.broadcast(before), "b").withColumn("freed", F.col("before") + F.coalesce(F.sum("bytes").over(inside), F.lit(0)))
    return freed.where(F.lit(total) - F.col("freed") > target).select("key", "bytes")


def running_excess(entries: DataFrame, partition: str, order: list, value: str, cap: int) -> Column:
    """Whether a running sum within ``partition`` is over a cap."""
    from pyspark.sql import Window

    return F.sum(value).over(Window.partitionBy(partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) > cap
