"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints: 64 majority bits over the XXH64 (seed 42) of word shingles of the
whole text.  Documents fall into classes of equal fingerprint first, so that
copies cost nothing later.  Distinct fingerprints are dealt out by pigeonhole:
two within ``bits`` differing bits agree on one of ``bits + 1`` blocks, so each
fingerprint goes to the groups of its blocks.  Inside a group the index does
the search: fingerprints are sorted by Gray rank, runs of FAN neighbours become
nodes that hold the bits all their members share (mask and value), level upon
level up to one root.  A node's bits already settled by its parent are left out
of its mask; a query carries the differences accumulated on its way down and
drops a whole subtree once they exceed ``bits``.

A fingerprint has at most 2 080 others within two bits, so links are bounded by
the number of distinct fingerprints.  Groups of over HOT fingerprints are dealt
out again by blocks of their remaining bits, until they fit, which is exact for the same reason.

Texts: null, empty and blank ones have fingerprint zero and link like any other.
Equal or null doc_ids and repeated rows are kept as rows; component_id is the
smallest non-null doc_id reachable (null if there is none).  Other columns pass
through the stage under any name.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import components, cut, lookup_join, row_join, small_batches, table, unwrapped, wrapped

BITS, SHINGLE = 2, 3
#: Members of an index node.
FAN = 16
#: Distinct fingerprints of a group that are searched in one task.
HOT = 200_000
#: Fingerprints searched at a time, which bounds the memory of the frontier.
BATCH = 8192


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 majority bits of the text, as a signed number."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    parts = words[0:1] if len(words) == 1 else [b" ".join(words)] if len(words) < shingle else list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
    total = np.zeros(64, np.int64)
    for i in range(0, len(parts), 1 << 18):
        some = parts[i : i + (1 << 18)]
        h = np.fromiter((xxhash.xxh64_intdigest(p, 42) for p in some), np.uint64, len(some))
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * total > len(parts), bitorder="little")
    return int(bits.view(np.int64)[0])


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence: the prefix XOR of its bits."""
    out = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    return out


class GrayIndex:
    """Levels of nodes over fingerprints sorted by (group, Gray rank)."""

    def __init__(self, groups: np.ndarray, codes: np.ndarray):
        order = np.lexsort((gray_rank(codes), groups))
        self.codes, groups = codes[order], groups[order]
        self.levels = []  # from the leaves up: first child of each node (and an end), mask, value
        low = high = self.codes
        while True:
            new = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
            if self.levels and len(new) == len(groups):
                break
            size = np.diff(np.r_[new, len(groups)])
            within = np.arange(len(groups)) - np.repeat(new, size)
            first = np.flatnonzero(within % FAN == 0)
            low, high = np.bitwise_and.reduceat(low, first), np.bitwise_or.reduceat(high, first)
            self.levels.append((np.r_[first, len(groups)], ~(low ^ high), low))
            groups = groups[first]
        # the last level has one node for each group: the roots
        counts = np.zeros(len(self.codes), np.int64)
        at = np.arange(len(groups))
        ends = self._leaves(at + 1) if len(at) else np.zeros(0, np.int64)
        counts[ends[:-1][ends[:-1] < len(counts)]] = 1
        self.root = np.cumsum(counts)

    def _leaves(self, nodes: np.ndarray) -> np.ndarray:
        for first, _, _ in reversed(self.levels):
            nodes = first[nodes]
        return nodes

    def links(self, bits: int):
        """Pairs of positions (i < j) of one group whose codes differ in at most ``bits`` bits."""
        for at in range(0, len(self.codes), BATCH):
            query = np.arange(at, min(at + BATCH, len(self.codes)))
            node, gone = self.root[query], np.zeros(len(query), np.int64)
            above = np.zeros(len(query), np.uint64)
            for first, mask, value in reversed(self.levels):
                own = mask[node] & ~above
                gone = gone + np.bitwise_count((self.codes[query] ^ value[node]) & own)
                ok = gone <= bits
                query, node, gone = query[ok], node[ok], gone[ok]
                above = mask[node]
                n = first[node + 1] - first[node]
                start = np.repeat(first[node], n)
                query, gone, above = np.repeat(query, n), np.repeat(gone, n), np.repeat(above, n)
                node = start + np.arange(len(start)) - np.repeat(np.cumsum(n) - n, n)
            gone = gone + np.bitwise_count((self.codes[query] ^ self.codes[node]) & ~above)
            ok = (gone <= bits) & (query < node)
            yield query[ok], node[ok]


def _dealt(groups: DataFrame, bits: int) -> DataFrame:
    """Groups (fp, key, rest, left) dealt out by the ``bits`` + 1 blocks of their ``left`` open bits, which ``rest`` holds packed.

    Codes of one group within ``bits`` differing bits agree on one of the blocks, so they meet again; a
    block's bits are settled from then on and leave ``rest``.
    """
    width = F.expr("high - low")
    block = F.expr("shiftrightunsigned(rest, low)").bitwiseAND(F.expr("shiftleft(1L, high - low) - 1"))
    above = F.when(F.col("high") < F.col("left"), F.expr("shiftleft(shiftrightunsigned(rest, high), low)")).otherwise(F.lit(0))
    below = F.col("rest").bitwiseAND(F.expr("shiftleft(1L, low) - 1"))
    edges = [F.struct(F.lit(s).alias("s"), F.expr(f"left * {s} div {bits + 1}").cast("int").alias("low"), F.expr(f"left * {s + 1} div {bits + 1}").cast("int").alias("high")) for s in range(bits + 1)]
    each = groups.select("*", F.inline(F.array(*edges)))
    return each.select("fp", F.xxhash64("key", "s", block).alias("key"), above.bitwiseOR(below).alias("rest"), (F.col("left") - width).alias("left"))


def near_links(fps: DataFrame, bits: int = BITS, hot: int = HOT) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints ``fp`` that differ in at most ``bits`` bits; ``fps`` holds each once.

    A group is dealt out again until it has at most ``hot`` fingerprints.  It has no more than two to the
    power of its open bits, and a third of these is settled each time, so four times do for HOT.
    """
    groups = _dealt(fps.select("fp", F.lit(0).cast("long").alias("key"), F.col("fp").alias("rest"), F.lit(64).alias("left")), bits)
    keyed = []
    while True:
        large = cut(groups.where(F.col("left") > bits).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("key"))
        if large.isEmpty():
            break
        keyed.append(lookup_join(groups, large, ["key"], "left_anti").select("fp", "key"))
        groups = cut(_dealt(lookup_join(groups, large, ["key"], "left_semi"), bits))
    keyed = reduce(DataFrame.union, keyed, groups.select("fp", "key"))

    def search(frames):
        held, n = [], 0

        def found(frame: pd.DataFrame):
            group = frame.groupby("key", sort=False).ngroup().to_numpy()
            many = np.bincount(group)[group] > 1
            if many.any():
                index = GrayIndex(group[many], frame["fp"].to_numpy()[many].astype(np.int64).view(np.uint64))
                codes = index.codes.view(np.int64)
                for i, j in index.links(bits):
                    yield pd.DataFrame({"a": np.maximum(codes[i], codes[j]), "b": np.minimum(codes[i], codes[j])})

        for frame in frames:
            held.append(frame)
            n += len(frame)
            if n >= hot:  # all but the last group are complete, for rows come sorted by group
                whole = pd.concat(held)
                last = whole["key"] == whole["key"].iloc[-1]
                yield from found(whole[~last])
                held, n = [whole[last]], int(last.sum())
        if held:
            yield from found(pd.concat(held))

    return keyed.repartition("key").sortWithinPartitions("key").mapInPandas(search, "a long, b long").distinct()


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with ``fp``, the fingerprint of ``text`` as a signed long."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fingerprint(t, shingle), na_action=None).astype("int64")

    return docs.withColumn("fp", fp("text"))


def near_duplicates(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """(_row, doc_id, fp, root, component_id) of every row of ``docs`` (_row, doc_id, text); ``root`` is one fingerprint for each group."""
    small_batches(docs.sparkSession)
    rows = cut(fingerprints(docs.select("_row", "doc_id", "text"), shingle).select("_row", "doc_id", "fp"))
    fps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(near_links(fps.select("fp"), bits))
    named = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    return lookup_join(rows, cut(named.select("fp", "root", "component_id")), ["fp"]).select("_row", "doc_id", "fp", "root", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(wrapped(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str | None = None) -> DataFrame:
    """Pipeline stage: of each group of near-duplicates the row with the smallest doc_id stays (of repeated rows the first)."""
    rows = wrapped(docs, "doc_id", "text")
    found = near_duplicates(rows)
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_row"))
    stay = cut(found.groupBy("root").agg(F.min(order).getField("_row").alias("_row")).select("_row"))
    return unwrapped(row_join(rows.select("_row", "_in"), stay, "left_semi"), docs)


QUERIES = {"op7_simhash": op7_simhash}
ORACLES: dict[str, str] = {}
