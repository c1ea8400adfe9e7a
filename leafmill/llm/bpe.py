"""Byte-level BPE encoding and decoding by overlapping chunks.

A long text is cut into chunks that overlap.  Every chunk is pre-tokenised by
itself.  Chunks of texts with over SPREAD chunks are rows of their own and are dealt out over the tasks; other texts'
chunks stay in the task that read the text, so that most texts are never moved.  The pattern looks ahead but
never back, so from a position where two readings both have a boundary they
agree for good: neighbouring chunks are stitched at the first boundary they share inside the
overlap.  The pieces between stitches are then encoded on their own, and the ids
of a text are the ids of its pieces in order.  Where two chunks share no
boundary (a run longer than the overlap), the text is encoded in one piece, so the result is exact.

Texts: null and empty give no ids.  Repeated rows, equal or null doc_ids are
kept apart by a row id.  Other columns are carried along under any name; one
that has the name of the result gives way to it.
"""

from __future__ import annotations

import base64
import functools
import re
from array import array

import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import cut, lookup_join, small_batches, table, with_row_id

RANKS = "byte_bpe_50k.tiktoken"
#: Code points a chunk holds, and code points it reads on into the next.
CHUNK, OVERLAP = 4096, 512
#: Chunks of a text that one task takes.
SPREAD = 16
#: Words whose ids a worker remembers.
CACHE = 100_000
#: White_Space of Unicode, as \s of the pattern has it (fixed values).
WS = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@functools.cache
def coder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def _bytes_of(path: str) -> list[bytes]:
    with open(path, "rb") as f:
        rank = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    return [rank[i] for i in range(len(rank))]


def packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class WordIds(dict):
    """Packed ids by word, for a word that a blank stands before, or with the newline it starts with."""

    def __init__(self, encode, limit: int = CACHE):
        super().__init__()
        self.encode, self.limit = encode, limit

    def __missing__(self, word: str) -> bytes:
        got = packed(self.encode(word if word[:1] == "\n" else " " + word))
        if len(self) < self.limit:
            self[word] = got
        return got


@functools.cache
def _alone():
    """Before a blank or newline that stands alone between two characters which are no white space."""
    return regex.compile(f"(?<=[^{WS}])(?=[ \n][^{WS}])")


@functools.cache
def _others() -> tuple[str, str]:
    """White space other than blank and newline: ASCII, the rest."""
    found = "".join(chr(c) for c in range(0x3001) if re.fullmatch(f"[{WS}]", chr(c)) and chr(c) not in " \n")
    return "".join(c for c in found if c.isascii()), "".join(c for c in found if not c.isascii())


def words_of(text: str) -> tuple[str, list[str]]:
    """A text as its start and the words after it; the pattern never reads across from one to the next.

    Where all white space is single blanks and newlines, plain splitting finds
    the words; else longer runs stay inside the word before.
    """
    head, *rest = text.replace("\n", " \n").split(" ")
    plain, wide = _others()
    if "" in rest or "\n" in rest or any(c in text for c in plain) or not text.isascii() and any(c in text for c in wide):
        head, *rest = _alone().split(text)
        rest = [w[1:] if w[0] == " " else w for w in rest]
    return head, rest


def pack_ids(text: str, words: WordIds) -> bytes:
    """Little-endian 32-bit ids of a text."""
    head, rest = words_of(text)
    return packed(words.encode(head)) + b"".join(map(words.__getitem__, rest)) if text else b""


@functools.cache
def _words(path: str) -> WordIds:
    return WordIds(coder(path).encode_ordinary)


def edges_of(part: str, chunk: int, overlap: int) -> tuple[list[int], list[int]]:
    """Boundaries of a chunk's pre-tokens in its first ``overlap`` code points, and in those after ``chunk`` (from there).

    Only those after a character that is no white space, for a piece may end
    there; and none in the last four code points, where the text that is cut
    off could tell.  Every reading has a boundary before a lone blank, so where
    both stretches hold one, those are enough; else the whole chunk is read.
    """
    stop = len(part) - 4
    first, last = ([m.start() for m in _alone().finditer(part, a, max(b + 2, a)) if m.start() < b] for a, b in ((0, min(overlap, stop + 1)), (chunk, stop + 1)))
    if first and (last or stop < chunk):
        return first, [p - chunk for p in last]
    first, last = [], []
    for m in _pattern().finditer(part):
        p = m.end()
        if p > stop:
            break
        if p < overlap or p >= chunk:
            if not part[p - 1].isspace():
                (first if p < overlap else last).append(p if p < overlap else p - chunk)
    return first, last


@functools.cache
def _pattern():
    return regex.compile(public_tokenizers.PATTERN)


def cut_up(text: str, chunk: int, overlap: int) -> list[str]:
    return [text[i : i + chunk + overlap] for i in range(0, len(text), chunk)]


def pieces_of(text: str, chunk: int, overlap: int) -> list[str] | None:
    """The pieces between stitches of a text's chunks; None where two chunks share no boundary."""
    parts = cut_up(text, chunk, overlap)
    edges = [edges_of(p, chunk, overlap) for p in parts]
    cuts = [min(set(last).intersection(edges[k + 1][0]), default=None) for k, (_, last) in enumerate(edges[:-1])]
    if None in cuts:
        return None
    return [p[a : len(p) if b is None else chunk + b] for p, a, b in zip(parts, [0, *cuts], [*cuts, None], strict=True)]


def chunked(long: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(_row, _chunk, _part) of texts (_row, _text): chunks that read on into the next, dealt out."""

    @F.pandas_udf("array<string>")
    def parts(texts: pd.Series) -> pd.Series:
        return pd.Series([cut_up(t, chunk, overlap) for t in texts], dtype=object)

    return long.select("_row", F.posexplode(parts("_text")).alias("_chunk", "_part")).repartition("_row", "_chunk")


def stitches(chunks: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(_row, _cut): for each chunk but the last the first boundary it has in common with the next, null where there is none."""

    @F.pandas_udf("first array<int>, last array<int>")
    def edges(parts: pd.Series) -> pd.DataFrame:
        got = [edges_of(t, chunk, overlap) for t in parts]
        return pd.DataFrame({"first": [a for a, _ in got], "last": [b for _, b in got]}, dtype=object)

    seen = chunks.select("_row", "_chunk", edges("_part").alias("_e")).groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_chunk", "_e.first", "_e.last"))).alias("_e"))
    common = F.transform(F.slice("_e", F.lit(1), F.size("_e") - 1), lambda x, i: F.array_min(F.array_intersect(x["last"], F.get(F.col("_e"), i + 1)["first"])))
    return seen.select("_row", common.alias("_cut"))


def encode(docs: DataFrame, text: str = "text", path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, spread: int = SPREAD) -> DataFrame:
    """``docs`` without its text, with ``ids`` (binary, little-endian unsigned 32-bit ids of the whole text); null texts as empty ones."""
    path = path or public_tokenizers.path(RANKS)

    @F.pandas_udf("binary")
    def whole(texts: pd.Series) -> pd.Series:
        words = _words(path)
        return pd.Series([pack_ids(t, words) for t in texts], dtype=object)

    @F.pandas_udf("binary")
    def stitched_here(texts: pd.Series) -> pd.Series:
        words = _words(path)

        def ids(text):
            pieces = pieces_of(text, chunk, overlap) if len(text) > chunk + overlap else None
            return pack_ids(text, words) if pieces is None else b"".join(pack_ids(p, words) for p in pieces)

        return pd.Series([ids(t) for t in texts], dtype=object)

    @F.pandas_udf("binary")
    def joined(parts: pd.Series) -> pd.Series:
        return pd.Series([b"".join(x) for x in parts], dtype=object)

    keep = [c for c in docs.columns if c not in (text, "ids")]
    inner = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(0))
    rows = with_row_id(docs.select(inner.alias("_in"), F.coalesce(F.col(text), F.lit("")).alias("_text")), "_row").withColumn("_long", F.length("_text") > spread * chunk)
    short = rows.where(~F.col("_long")).select("_in", stitched_here("_text").alias("ids"))
    long = rows.where("_long")
    chunks = chunked(long, chunk, overlap)
    stitched = cut(stitches(chunks, chunk, overlap))
    broken = F.exists("_cut", lambda x: x.isNull())
    # pieces: from a chunk's stitch with the one before to its stitch with the next, within the chunk
    pieces = stitched.where(~broken).select("_row", F.posexplode(F.concat(F.array(F.lit(0)), "_cut")).alias("_chunk", "_from"), "_cut")
    pieces = pieces.select("_row", "_chunk", "_from", (F.get("_cut", F.col("_chunk")) + chunk).alias("_to"))
    pieces = chunks.join(pieces, ["_row", "_chunk"]).select("_row", "_chunk", F.substring("_part", F.col("_from") + 1, F.coalesce(F.col("_to"), F.length("_part")) - F.col("_from")).alias("_piece"))
    parts = pieces.select("_row", "_chunk", whole("_piece").alias("ids")).groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_chunk", "ids"))).alias("_p"))
    unbroken = long.select("_row", "_in").join(parts.select("_row", joined(F.col("_p.ids")).alias("ids")), "_row")
    rest = lookup_join(long, stitched.where(broken).select("_row"), ["_row"], "left_semi").select("_in", whole("_text").alias("ids"))
    out = short.union(unbroken.select("_in", "ids")).union(rest)
    return out.select(*[F.col(f"_in.`{c}`").alias(c) for c in keep], "ids")


def decode(docs: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """``docs`` with ``decoded`` (binary): the bytes of the ids, concatenated."""
    path = path or public_tokenizers.path(RANKS)

    @F.pandas_udf("binary")
    def back(packed: pd.Series) -> pd.Series:
        get = _bytes_of(path).__getitem__
        return pd.Series([b"".join(map(get, memoryview(x).cast("I"))) for x in packed], dtype=object)

    return docs.withColumn("decoded", back(ids))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return docs.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op3_bpe": op3_bpe}
ORACLES: dict[str, str] = {}
