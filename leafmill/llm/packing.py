"""Best-fit packing of tokenised documents by a plan over lengths.

The planner sees a histogram of piece lengths, never documents: best-fit
decreasing runs over (length, count) pairs and returns a table of slots "ranks
a to b of length n go to sequences s, s+1, ... at offset o".  Pieces get a
dense rank within their length and take their slots by a join on length and
rank block.  The histogram has at most ``size`` rows and the plan is bounded by
the number of lengths and of residual rooms, not by the corpus.

Documents: null and empty texts hold the end id alone.  Repeated rows and equal
or null doc_ids are packed as rows of their own.  Longer documents are cut so
that the first piece may be shorter and all others are full; a full piece is a
sequence by itself.  The result has the named columns only: the pieces replace the documents.
"""

from __future__ import annotations

import functools
import json
import zlib
from array import array
from collections import defaultdict

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm.bpe import WordIds, pack_ids
from leafmill.llm.common import cut, small_batches, table, with_row_id

TOKENIZER = "byte_bpe_50k.json"
SIZE, END = 2048, 0
#: Words whose ids a worker remembers.
CACHE = 300_000
#: Ranks within a length are dealt over so many groups, each ranked by itself; a length with a third of all pieces is no single task.
DEAL = 64
#: Ranks of a length that share a block key in the join with the plan.
BLOCK = 4096


@functools.cache
def _words(path: str) -> WordIds:
    """Ids by word, as the tokenizers library gives them for the file.

    A byte-level BPE file whose merges make its ids in order can be read as
    ranks, which one word is encoded by in a tenth of the time; any other file,
    and words that hold an added token, go to the library itself.
    """
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    plain = lambda s: library.encode(s, add_special_tokens=False).ids
    with open(path) as f:
        spec = json.load(f)
    vocab, added = spec["model"]["vocab"], [x["content"] for x in spec["added_tokens"]]
    merged = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in spec["model"]["merges"]]
    before = spec["pre_tokenizer"]
    level = before["type"] == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and spec["normalizer"] is None
    if not level or any(spec["model"].get(k) for k in ("dropout", "byte_fallback", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")) or merged != list(range(256, 256 + len(merged))):
        return WordIds(plain, CACHE)
    import tiktoken

    # the byte of each visible stand-in: printable Latin-1 stands for itself, the others are counted up from 256
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*seen}))}
    ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in added}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return WordIds(lambda s: plain(s) if any(x in s for x in added) else fast(s), CACHE)


def cut_pieces(ids: bytes, size: int = SIZE) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of each piece of packed ids; all but the first are full."""
    n = len(ids) // 4
    first = (n - 1) % size + 1
    starts = [0, *range(first, n, size)]
    return [(a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for a, b in zip(starts, [*starts[1:], n], strict=True)]


def tokenised(docs: DataFrame, path: str | None = None, size: int = SIZE, end: int = END) -> DataFrame:
    """``docs`` (doc_id, text) as pieces: doc_id, piece, start, length, ids_crc32."""
    path = path or public_tokenizers.path(TOKENIZER)
    tail = array("I", [end]).tobytes()

    @F.pandas_udf("array<struct<start long, length long, ids_crc32 long>>")
    def pieces(texts: pd.Series) -> pd.Series:
        words = _words(path)
        return pd.Series([[{"start": a, "length": n, "ids_crc32": c} for a, n, c in cut_pieces(pack_ids(t or "", words) + tail, size)] for t in texts], dtype=object)

    rows = docs.select("doc_id", F.posexplode(pieces("text")).alias("piece", "p"))
    return rows.select("doc_id", "piece", "p.start", "p.length", "p.ids_crc32")


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, count, first sequence, offset).

    Rank ``first + k`` of the length goes to sequence ``first sequence + k``.
    Open sequences are kept as runs of equal room; a step fills one run or uses
    up a length, so there are few steps however many pieces there are.
    """
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> runs (first sequence, count)
    out, made = [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        for free in [r for r in sorted(room) if r >= length]:
            runs, room[free] = room[free], []
            most = free // length  # the room that a piece leaves is the smallest that fits as long as it fits
            while runs and left:
                at, n = runs.pop()
                held = min(most, left)
                take = min(n, left // held)
                for k in range(held):
                    out.append((length, rank + k * take, take, at, size - free + k * length))
                rank, left = rank + held * take, left - held * take
                if n > take:
                    runs.append((at + take, n - take))
                if free > held * length:
                    room[free - held * length].append((at, take))
            room[free] += runs
            if not room[free]:
                del room[free]
            if not left:
                break
        # what doesn't fit opens sequences, each with as many pieces of this length as go in
        each = size // length
        while left:
            full = max(left // each, 1)
            held = min(each, left)
            for k in range(held):
                out.append((length, rank + k * full, full, made, k * length))
            rank, left = rank + held * full, left - held * full
            if size > held * length:
                room[size - held * length].append((made, full))
            made += full
    return out


def ranked(pieces: DataFrame, by: list[str]) -> DataFrame:
    """A dense rank from 0 within each length, counted in DEAL groups whose offsets come from the groups' counts."""
    dealt = pieces.withColumn("_deal", F.pmod(F.xxhash64(*by), F.lit(DEAL)))
    counts = dealt.groupBy("length", "_deal").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_deal").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "_deal", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_deal").orderBy(*by)
    # at most DEAL rows for each of the lengths, of which there are at most SIZE
    return dealt.withColumn("_rank", F.row_number().over(within) - 1).join(F.broadcast(offsets), ["length", "_deal"]).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_deal", "_before")


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """``pieces`` (any columns, ``length`` between 1 and ``size``) with sequence_id and offset."""
    spark = pieces.sparkSession
    pieces = cut(with_row_id(pieces, "_row"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    full = histogram.pop(size, 0)
    slots = plan(histogram, size)
    made = max((s + n for _, _, n, s, _ in slots), default=0)
    if full:
        slots.append((size, 0, full, made, 0))
    rows = spark.createDataFrame(slots or [(0, 0, 0, 0, 0)], "length long, first long, n long, sequence long, offset long")
    rows = rows.withColumn("_block", F.explode(F.sequence((F.col("first") / BLOCK).cast("long"), ((F.col("first") + F.greatest("n", F.lit(1)) - 1) / BLOCK).cast("long"))))
    placed = ranked(pieces, ["_row"]).withColumn("_block", (F.col("_rank") / BLOCK).cast("long"))
    at = (F.col("_rank") >= F.col("first")) & (F.col("_rank") < F.col("first") + F.col("n"))
    rows = rows.withColumnRenamed("length", "_length")
    # the plan's rows grow with the pieces over BLOCK at most
    joined = placed.join(F.broadcast(rows) if len(slots) <= 50_000 and sum(histogram.values()) + full <= 50_000 * BLOCK else rows, (F.col("length") == F.col("_length")) & (placed["_block"] == rows["_block"]) & at)
    keep = [c for c in pieces.columns if c != "_row"]
    return joined.select(*keep, (F.col("sequence") + F.col("_rank") - F.col("first")).alias("sequence_id"), "offset")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pack(tokenised(table(spark, sf_dir, "documents").select("doc_id", "text")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str | None = None) -> DataFrame:
    """Pipeline stage: the documents' pieces with their places in sequences."""
    small_batches(spark)
    return pack(tokenised(docs.select("doc_id", "text")))


QUERIES = {"op9_packing": op9_packing}
ORACLES: dict[str, str] = {}
