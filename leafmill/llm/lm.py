"""Language-model scoring: a causal self-attention model trained in numpy on subword ids.

From the training texts come: the count of every word (the base model, all of
it), the count of every subword (the model's shared units and its start), and
the model's units of every text, which training and scoring both read.  Training windows, cut as for scoring, travel in blocks of RUN that are dealt by
hash to ROUNDS rounds and to shards of about SHARD windows: training is one pass over every unit of
every training text.  In a round every shard is trained on by itself from the same
weights, and the weights are averaged by windows, so work and what is gathered grow with the corpus while
the model does not.  Scoring reads each text once: overlapping windows score each unit once.

Counts of the most frequent words (HOT at most) travel with the tasks; what is left of a text is
joined with the whole table of words, so that every count is exact.

Texts: null, empty and blank ones are one end token.  A null doc_id is not held
out.  Without training texts all counts are zero and the model is the untrained one.
Repeated rows and ids are scored row by row.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import attention
from leafmill.llm.bpe import WS, _bytes_of, coder
from leafmill.llm.common import cut, small_batches, table, with_row_id

RANKS = "byte_bpe_multi_50k.tiktoken"
HOT = 150_000
RUN, SHARD, ROUNDS, RATES = 64, 131_072, 3, (0.03, 0.015, 0.005)
#: Words a task counts before it hands them on; floats of the model that travel together.
FLUSH, CHUNK = 400_000, 8192
#: Words whose subwords a task remembers, the frequent ones always; words that are encoded together.
CACHE, TOGETHER = 250_000, 4096


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def words_in(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """``words_of`` for a column: how many words each text has, and the words of all in order."""
    texts = pc.ascii_trim_whitespace(pc.ascii_lower(texts))
    # a blank text would be split into one empty word
    lists = pc.ascii_split_whitespace(pc.if_else(pc.equal(pc.binary_length(texts), 0), None, texts))
    return np.diff(lists.offsets.to_numpy()), lists.flatten()


def _subwords(path: str):
    """Subword ids of a word as it stands after a blank."""
    encode = coder(path).encode_ordinary
    return lambda word: encode(" " + word.decode("utf-8", "replace"))


@functools.cache
def _blank_first(path: str) -> np.ndarray:
    """By subword id: whether it starts with a blank."""
    return np.array([b[:1] == b" " for b in _bytes_of(path)])


@functools.cache
def _spaced():
    """White space of the coder's pattern, which a word can hold where it is not ASCII."""
    return regex.compile(f"[{WS}]")


def encoded(words: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids of ``words`` in order, as ``_subwords`` has them, and how many each word has.

    Words are encoded TOGETHER with a blank before each.  The pattern never goes on over a lone blank and looks
    ahead for white space alone, so only words that hold other white space are encoded by themselves.
    """
    one, encode, first = _subwords(path), coder(path).encode_ordinary, _blank_first(path)
    ids, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(0, len(words), TOGETHER):
        some = words[i : i + TOGETHER]
        text = " " + b" ".join(some).decode("utf-8", "replace")
        if _spaced().search(text.replace(" ", "")):
            found = [one(w) for w in some]
            ids.append(np.fromiter(itertools.chain.from_iterable(found), np.int64))
            sizes.append(np.array(list(map(len, found)), np.int64))
            continue
        got = np.array(encode(text), np.int64)
        ids.append(got)
        sizes.append(np.diff(np.flatnonzero(first[got]), append=len(got)))
    return np.concatenate(ids), np.concatenate(sizes)


class _Words(dict):
    """Places of words in tables of log10 of their count plus one (NaN: not a hot word), log probability within units, packed units.

    A word that is looked up for the first time has its place at once; ``learn`` then fills the tables for all such words together.
    """

    def __init__(self, path: str, hot: dict[bytes, float], u: attention.Units, ids: tuple[np.ndarray, np.ndarray] | None = None):
        """``ids``: the hot words as ``encoded`` has them, if known."""
        super().__init__(zip(hot, range(len(hot)), strict=True))
        self.path, self.u, self.new = path, u, list(hot)
        self.log, self.inner, self.units, self.rare = np.array(list(hot.values())), np.zeros(0), [], []
        self.learn(ids)
        self.hot, self.rare = len(hot), []
        self.often = pa.array(hot, pa.binary())

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        self.new.append(word)
        return at

    def places(self, words: pa.Array) -> np.ndarray:
        """Places of ``words``; only those that are not hot become objects of Python."""
        at = pc.index_in(words, value_set=self.often.cast(words.type))
        rare = at.is_null()
        out = at.fill_null(0).to_numpy().astype(np.intp)
        out[rare.to_numpy(zero_copy_only=False)] = list(map(self.__getitem__, words.filter(rare).cast(pa.binary()).to_pylist()))
        return out

    def learn(self, ids: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        words, self.new = self.new, []
        if not words:
            return
        ids, sizes = ids or encoded(words, self.path)
        ends = np.cumsum(sizes)
        packed = self.u.unit[ids].tobytes()
        self.units += [packed[2 * a : 2 * b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
        self.inner = np.concatenate([self.inner, np.add.reduceat(self.u.inner[ids], ends - sizes)])
        self.log = np.concatenate([self.log, np.full(len(self) - len(self.log), np.nan)])
        self.rare += words

    def forget(self) -> None:
        """Words that are not hot go once there are too many."""
        if len(self) > CACHE:
            for w in self.rare:
                del self[w]
            del self.units[self.hot :]
            self.inner, self.log, self.rare = self.inner[: self.hot], self.log[: self.hot], []


def text_units(words: pa.Array, sizes: np.ndarray, end: int) -> pa.Array:
    """Units of texts, an end after each, from the packed units of all their words and how many words each has."""
    ends = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1)[np.cumsum(sizes)] // 2 if len(words) else np.zeros(len(sizes), np.int32)
    packed = np.frombuffer(words.buffers()[2], np.uint16, ends[-1]) if len(words) else np.zeros(0, np.uint16)
    offsets = np.concatenate([[0], 2 * (ends + np.arange(1, len(sizes) + 1))]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.insert(packed, ends, end))])


def _end(path: str) -> int:
    return coder(path).n_vocab


def counted(columns, most: int = FLUSH):
    """Batches (word, c) over columns of texts; a word comes again where over ``most`` words were held."""
    held, size = [], 0

    def added():
        return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum")]).rename_columns(["word", "c"])

    for texts in columns:
        got = words_in(texts)[1].value_counts()
        held.append(pa.table({"word": got.field("values").cast(pa.string()), "c": got.field("counts")}))
        size += len(got)
        if size > 2 * most:
            held = [added()]
            size = len(held[0])
            if size > most:
                yield from held[0].to_batches()
                held, size = [], 0
    if size:
        yield from added().to_batches()


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) over all ``docs`` (text)."""

    def count(batches):
        yield from counted(batch.column("text") for batch in batches)

    return docs.select("text").mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def count_subwords(words: DataFrame, path: str) -> np.ndarray:
    """Counts of all subword ids in the words' texts, without the end; its size is the vocabulary's."""
    size = _end(path) + 1

    def count(frames):
        total = np.zeros(size, np.int64)
        for frame in frames:
            found, sizes = encoded([w.encode() for w in frame["word"]], path)
            np.add.at(total, found, np.repeat(frame["c"].to_numpy(), sizes))
        ids = np.flatnonzero(total)
        yield pd.DataFrame({"id": ids, "c": total[ids]})

    got = words.mapInPandas(count, "id long, c long").groupBy("id").agg(F.sum("c").alias("c")).toPandas()
    out = np.zeros(size, np.int64)
    out[got["id"].to_numpy(np.int64)] = got["c"].to_numpy(np.int64)
    return out


def training_blocks(texts: DataFrame) -> DataFrame:
    """(at, units) blocks of ``texts`` (_row, units), each the inputs of up to RUN windows and the last target; ``at`` deals them out.

    All windows of a text are in its blocks.  A text's first block begins with START, the others with OVERLAP inputs of context.
    """
    begin, size = np.array([attention.START], np.uint16).tobytes(), RUN * attention.STEP

    def cut_out(frames):
        import xxhash

        for frame in frames:
            at, out = [], []
            for row, units in zip(frame["_row"], frame["units"], strict=True):
                whole = begin + units
                for first in range(0, len(units) // 2, size):
                    at.append(xxhash.xxh64_intdigest(f"{row}:{first}", 42) >> 1)
                    out.append(whole[2 * max(first - attention.OVERLAP, 0) : 2 * (first + size + 1)])
            yield pd.DataFrame({"at": at, "units": out})

    return texts.select("_row", "units").mapInPandas(cut_out, "at long, units binary")


def training_arrays(blocks: list[bytes]):
    """Training arrays (x, begins, unit, keep) of the windows of blocks, in a fixed order that mixes them."""
    parts = [np.frombuffer(b, np.uint16) for b in blocks]
    size = np.array([len(p) for p in parts])
    context = np.where(np.array([p[0] == attention.START for p in parts]), 0, attention.OVERLAP)
    block, first = attention.cut_windows(size - 1 - context)
    mixed = np.random.default_rng(6).permutation(len(block))
    block, first = block[mixed], first[mixed]
    ends = np.cumsum(size)
    return attention.inputs(np.concatenate(parts), (ends - size + context)[block], first, ends[block], (first == 0) & (context[block] == 0))


def fit(texts: DataFrame, u: attention.Units, total: int, count: int, rounds: int = ROUNDS) -> attention.Model:
    """Model from ``texts`` (_row, units), ``count`` of them with ``total`` units in all."""
    spark = texts.sparkSession
    model = attention.start(u)
    if not count:
        return model
    # a text has at most one window more than its units over the step
    shards = -(-(total // attention.STEP + count) // (SHARD * rounds))
    deal = F.pmod(F.xxhash64("at"), F.lit(shards * rounds))
    blocks = training_blocks(texts).select("at", "units", (deal % rounds).cast("int").alias("turn"), F.floor(deal / rounds).cast("int").alias("shard"))
    names, shapes = list(model), {k: w.shape for k, w in model.items()}
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast(model)
        rate = RATES[min(turn, len(RATES) - 1)]

        def trained(frame: pd.DataFrame, sent, rate: float) -> pd.DataFrame:
            model = sent.value
            frame = frame.sort_values("at", kind="stable")
            attention.one_thread()
            windows = training_arrays(list(frame["units"]))
            n = len(windows[0])
            got = attention.train(model, windows, rate, attention.TRAIN)
            flat = np.concatenate([got[k].ravel() for k in names])
            parts = [flat[i : i + CHUNK] for i in range(0, len(flat), CHUNK)]
            return pd.DataFrame({"part": range(len(parts)), "shard": int(frame["shard"].iloc[0]), "n": n, "w": [(p.astype(np.float64) * n).tobytes() for p in parts]})

        def shard(sent, rate: float):
            return lambda frame: trained(frame, sent, rate)

        def summed(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("shard", kind="stable")
            total = functools.reduce(np.add, (np.frombuffer(w, np.float64) for w in frame["w"]))
            return pd.DataFrame({"part": [int(frame["part"].iloc[0])], "shard": [int(frame["shard"].iloc[0])], "n": [int(frame["n"].sum())], "w": [total.tobytes()]})

        schema = "part int, shard int, n long, w binary"
        made = blocks.where(F.col("turn") == turn).groupBy("shard").applyInPandas(shard(sent, rate), schema)
        # averaged in two steps, so no task gets more than the square root of all shards or so
        some = made.groupBy("part", F.pmod("shard", F.lit(max(1, math.isqrt(shards)))).alias("g")).applyInPandas(summed, schema)
        parts = some.groupBy("part").applyInPandas(summed, schema).orderBy("part").collect()
        if not parts:  # so small a corpus that no block was dealt to this round
            continue
        flat = np.concatenate([np.frombuffer(r["w"], np.float64) / r["n"] for r in parts]).astype(np.float32)
        at = 0
        model = {}
        for k in names:
            size = math.prod(shapes[k])
            model[k] = flat[at : at + size].reshape(shapes[k])
            at += size
    return model


def hot_count(words: DataFrame, most: int = HOT) -> int:
    """A count that at most ``most`` words reach, from a histogram of counts in eighths of octaves."""
    octave = F.floor(8 * F.log2("c")).cast("int")
    sizes = {r["o"]: r["n"] for r in words.groupBy(octave.alias("o")).agg(F.count("*").alias("n")).collect()}
    held, least = 0, max(sizes, default=0) + 1
    for o in sorted(sizes, reverse=True):
        held += sizes[o]
        if held > most:
            break
        least = o
    return math.ceil(2 ** (least / 8) - 1e-9)


def score(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Scores of ``docs`` (doc_id, text, held_out): see op6_lm; texts that are not held out are learnt from."""
    spark = docs.sparkSession
    path = path or public_tokenizers.path(RANKS)
    small_batches(spark)
    rows = with_row_id(docs.select("doc_id", "text", "held_out"), "_row")
    seen = rows.where("not held_out")
    words = cut(count_words(seen))
    ends = seen.select("_row").count()
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    train, vocabulary = total + ends, distinct + (ends > 0)
    counts = count_subwords(words, path)
    counts[_end(path)] += ends
    u = attention.units(counts)
    hot = words.where(F.col("c") >= hot_count(words)).toPandas()
    hot_words = [w.encode() for w in hot["word"]]
    sent = spark.sparkContext.broadcast((dict(zip(hot_words, np.log10(hot["c"].to_numpy(np.float64) + 1).tolist(), strict=True)), u, encoded(hot_words, path)))
    end = u.unit[_end(path)]
    end_inner = float(u.inner[_end(path)])

    def read(batches):
        known = _Words(path, *sent.value)
        for batch in batches:
            known.forget()
            sizes, words = words_in(batch.column("text"))
            coded = words.dictionary_encode()  # each word of the batch is looked up once
            words, code = coded.dictionary, coded.indices
            at = known.places(words)
            known.learn()
            units = text_units(pa.array(map(known.units.__getitem__, at.tolist()), pa.binary()).take(code), sizes, end)
            code, n = code.to_numpy(), len(sizes)
            of, logs = np.repeat(np.arange(n), sizes), known.log[at][code]
            missed = np.flatnonzero(np.isnan(logs))
            logs[missed] = 0
            left, times = np.unique(of[missed] * len(words) + code[missed], return_counts=True)
            left_of, left = np.divmod(left, max(len(words), 1))
            lists = np.searchsorted(left_of, np.arange(n + 1)).astype(np.int32)
            out = {
                "_row": batch.column("_row"),
                "doc_id": batch.column("doc_id"),
                "held_out": batch.column("held_out"),
                "n_tokens": pa.array(sizes.astype(np.int64) + 1),
                "known": pa.array(sizes - np.bincount(of[missed], minlength=n)),
                "base": pa.array(np.bincount(of, logs, n)),
                "rest": pa.ListArray.from_arrays(lists, words.take(pa.array(left)).cast(pa.string())),
                "times": pa.ListArray.from_arrays(lists, pa.array(times)),
                "units": units,
                "inner": pa.array(np.bincount(of, known.inner[at][code], n) + end_inner),
            }
            yield pa.RecordBatch.from_pydict(out)

    schema = "_row long, doc_id long, held_out boolean, n_tokens long, known long, base double, rest array<string>, times array<long>, units binary, inner double"
    texts = cut(rows.mapInArrow(read, schema))
    model = spark.sparkContext.broadcast(fit(texts.where("not held_out"), u, int(counts.sum()), ends))

    @F.pandas_udf("double")
    def by_model(units: pd.Series) -> pd.Series:
        return pd.Series(attention.score(model.value, [np.frombuffer(x, np.uint16) for x in units]))

    scored = cut(texts.select("_row", "doc_id", "held_out", "n_tokens", "known", "base", "rest", "times", ((by_model("units") + F.col("inner")) / math.log(10)).alias("score")))
    # what the frequent words leave over
    left = scored.select("_row", F.inline(F.arrays_zip(F.col("rest").alias("word"), F.col("times").alias("t"))))
    # each word is once in its table, so a partition of it is small; sorting both sides by word cost most of this join
    left = left.join(words.hint("shuffle_hash"), "word", "left").groupBy("_row").agg(F.sum(F.col("t") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("t")).otherwise(0)).alias("also"))
    out = scored.drop("rest", "times").join(left, "_row", "left")
    last = math.log10(ends + 1)
    each_log = math.log10(train + vocabulary + 1)
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("also", F.lit(0)) + int(ends > 0)).cast("long").alias("n_known"),
        F.lit(train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) + last - F.col("n_tokens") * each_log).alias("base_score"),
        "score",
    )


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    return score(docs.withColumn("held_out", held))


QUERIES = {"op6_lm": op6_lm}
ORACLES: dict[str, str] = {}
