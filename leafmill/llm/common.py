"""What the operators share: table access, lineage cuts, bounded broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space as the contracts use it: everything else is part of a word.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: A side is broadcast when it has at most so many rows and bytes; beyond that
#: Spark shuffles both sides and AQE splits skewed partitions.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
#: Nodes of a graph that may be broadcast for their many links.
HUBS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or in local mode (tests) a folder of our own where it is unset."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="leafmill-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: written once to the shared folder, so a lost executor costs a re-read and no recomputation."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def _bytes(field: T.StructField):
    """About the bytes of a column's value."""
    size = {T.StringType: lambda c: F.octet_length(c), T.BinaryType: lambda c: F.octet_length(c), T.ArrayType: lambda c: 24 * F.size(c)}.get(type(field.dataType))
    return F.coalesce(size(F.col(field.name)), F.lit(0)) + 24 if size else F.lit(24)


def is_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` (already cut, so that counting it is cheap) has at most ``limit`` rows and BROADCAST_BYTES bytes."""
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(sum((_bytes(f) for f in df.schema), F.lit(0))), F.lit(0))).first()
    return rows <= limit and size <= BROADCAST_BYTES


def lookup_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join ``small`` (already cut) by broadcast if it is small, else by shuffle."""
    return big.join(F.broadcast(small) if is_small(small, limit) else small, on, how)


def row_join(big: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows of ``big`` whose ``_row`` is (left_semi) or is not (left_anti) among ``ids`` (_row, each once, already cut).

    Ids travel as bitmaps of 32 768 rows, a bit a row, so ``big`` with its texts is not shuffled
    up to about 8 000 bitmaps (BROADCAST_BYTES); beyond that both sides are.
    """
    bucket = F.bitmap_bucket_number("_row")
    # dealt by bucket first, or every task would hand on a bitmap of every bucket
    maps = cut(ids.select(bucket.alias("_at"), "_row").repartition("_at").groupBy("_at").agg(F.bitmap_construct_agg(F.bitmap_bit_position("_row")).alias("_bits")))
    if not is_small(maps):
        return big.join(ids.select("_row"), "_row", how)
    place = F.bitmap_bit_position("_row")
    byte = F.conv(F.hex(F.substring("_bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    held = F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))
    rows = big.withColumn("_at", bucket).join(F.broadcast(maps), "_at", "left")
    return rows.where(held if how == "left_semi" else ~held).select(*big.columns)


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Bound the bytes of a batch that goes to Python: 10 000 long texts at once do not fit a small executor."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def let(value, body):
    """Bind ``value`` once for ``body``: a lambda variable is evaluated once, an inlined column expression on every use."""
    return F.transform(F.array(value), body)[0]


#: Plan nodes that give the same rows in the same partitions whenever they run: reads of files and of what was cut, and what passes rows on.
_STEADY = ("Project", "Filter", "Relation", "LogicalRelation", "LocalRelation", "LogicalRDD", "SubqueryAlias", "View")


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """A unique id for each row, repeated rows included.

    Ids follow from the input's splits.  An input that is more than a read of files
    (after a shuffle, say) is cut first, for its rows could change places from one run to the next.
    """
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    nodes = [line.lstrip(" :+-").split(" ")[0].split("[")[0].rstrip(",") for line in plan.splitlines() if line.strip()]
    steady = all(n in _STEADY for n in nodes)
    return (df if steady else cut(df)).withColumn(name, F.monotonically_increasing_id())


def wrapped(docs: DataFrame, *names: str) -> DataFrame:
    """(_row, _in, *names) of ``docs``: all its columns are in the struct ``_in``, so that none meets a name of ours.

    A name that ``docs`` lacks is null; ``unwrapped`` gives the columns back.
    """
    rows = with_row_id(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_in")), "_row")
    have = {f.name: f.dataType for f in docs.schema}
    return rows.select("_row", "_in", *[(F.col(f"_in.`{n}`") if n in have else F.lit(None).cast("long" if n.endswith("_id") else "string")).alias(n) for n in names])


def unwrapped(rows: DataFrame, docs: DataFrame, **new) -> DataFrame:
    """The columns of ``docs`` from ``_in``; ``new`` columns take the place of those that ``docs`` has, cast to their type."""
    types = dict(docs.dtypes)
    return rows.select(*[(new[c].cast(types[c]) if c in new else F.col(f"_in.`{c}`")).alias(c) for c in docs.columns])


def _to_least(links: DataFrame, of: DataFrame, hub: int) -> DataFrame:
    """``links`` (a, b) with ``m``, the least of a's links in ``of`` and of a itself.

    A node with over ``hub`` links would be one task of the join; such nodes, which are
    few, are broadcast.
    """
    least = cut(of.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")))
    if is_small(least):
        return links.join(F.broadcast(least.drop("n")), "a")
    hubs = least.where(F.col("n") > hub).drop("n")
    near = links.join(F.broadcast(hubs.select("a")), "a", "left_anti").join(least.where(F.col("n") <= hub).drop("n"), "a")
    return near.unionByName(links.join(F.broadcast(hubs), "a"))


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``links(a, b)``: returns (node, root), root the smallest node reachable.

    Alternating large-star and small-star steps (Kiveris et al., 2014) by
    DataFrame aggregations; each round is cut to the shared folder.  A round
    moves at most one row per edge, and a hub's neighbours are aggregated
    map-side, so no node's list is gathered in a task.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    # at most HUBS nodes have more links than this
    hub = max(1000, 2 * edges.count() // HUBS)
    last = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of a node is linked to the node's smallest neighbour
        near = both(edges)
        large = cut(_to_least(near.where("b > a"), near, hub).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        # small star: a node and its smaller neighbours are linked to the smallest of them
        edges = _to_least(large, large, hub).select("b", "m", "a")
        edges = cut(edges.select(F.col("b").alias("a"), F.col("m").alias("b")).union(edges.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
