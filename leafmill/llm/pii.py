"""Personal data: fixed patterns, then identifiers found by bootstrapped context.

Base spans (email, ip, card, phone) come from the regular expressions below, with
positions from the gaps between matches.  They are seeds of the second part, with
tokens that are secrets by their shape alone (SECRET digits and letters of a hexadecimal number).
The words around a seed, one or two on either side, are lexical patterns.  Patterns and the identifier-like
tokens that stand in them form a graph, and scores go to and fro for ROUNDS
rounds: a pattern's score is what its instances score, by the number of all its occurrences in the
corpus, whatever stands there, so a frequent word is no pattern however many seeds it has beside it; a token's score is
that of its best pattern with SEEDS different seeds.  A token that scores TRUST is a seed of the next round with that score.
Identifier-like tokens in patterns that score TRUST, and tokens that became
seeds wherever they stand, are spans of kind "id".

All is DataFrame expressions; texts are read once for spans and once to count the occurrences of the
patterns that could be trusted; the graph is aggregated by shuffles,
and sums are whole numbers, so that no result depends on the order of rows.
Expressions are written to run in linear time and without recursion: an atom
never gives back what it took, and a run of characters is tried from its start
or from the end of the match before only.

Null and empty texts have no spans.  Repeated rows and ids are kept apart by a row
id; a text's spans may overlap across kinds.  Other columns pass through the stage under any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import cut, let, lookup_join, table, unwrapped, wrapped

KINDS = ["email", "ip", "card", "phone", "id"]
#: The base patterns, each with what a text must hold to be searched (fixed values, in the form that never backtracks far).
PATTERNS = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "instr({t}, '@') > 0"),
    "ip": (r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", "digits"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", "digits"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "instr({t}, '+') > 0"),
    "id": (r"(?<![A-Za-z0-9_-])[A-Za-z_-]*+[0-9][A-Za-z0-9_-]*+", "digits"),
}
#: Identifier-like tokens: code points, and digits at least.
ID_LEAST, ID_MOST, ID_DIGITS = 8, 128, 3
#: Letters and digits that a hexadecimal number has at least to be a secret by its shape.
SECRET = 32
#: Code points of context that a pattern's word is looked for in.
CONTEXT = 80
#: Scores are millionths.
ONE = 1_000_000
ROUNDS = 3
TRUST, SEEDS = 600_000, 5


def _valid(kind: str, m):
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.try_to_number(F.concat(F.lit("0"), F.ltrim(p, F.lit("0"))), F.lit("9999")), F.lit(999)) <= 255))
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "id":
        return F.length(m).between(ID_LEAST, ID_MOST) & (F.length(digits) >= ID_DIGITS)
    return F.lit(True)


SPAN = "array<struct<start:int,kind:int,end:int>>"


def _spans(text, digits, kind: str):
    """Spans of a kind in a text: matches and the gaps between them are walked once."""
    pattern, needs = PATTERNS[kind]
    none = F.array().cast(SPAN)
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def step(a, x):
        start = a["at"] + F.length(x["gap"])
        end = start + F.length(x["m"])
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(_valid(kind, x["m"]), F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

    def walk(m):
        zipped = F.zip_with(m, F.slice(gaps, F.lit(1), F.size(m)), lambda a, b: F.struct(a.alias("m"), b.alias("gap")))
        return F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("out")), step)["out"]

    holds = digits if needs == "digits" else F.instr(text, "@" if kind == "email" else "+") > 0
    return F.when(holds, let(matches, lambda m: F.when(F.size(m) > 0, walk(m)).otherwise(none))).otherwise(none)


WORD = r"[\p{L}\p{N}]++"
GAP = r"[^\p{L}\p{N}]"


def _contexts(text, start, end):
    """Lexical patterns of a span: the nearest word, and the nearest two, on either side."""
    left = F.lower(F.substring(text, F.greatest(start - CONTEXT, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT))))
    right = F.lower(F.substring(text, end + 1, F.lit(CONTEXT)))
    before = F.split(F.regexp_replace(F.regexp_extract(left, f"(?:{WORD}{GAP}++)?{WORD}{GAP}*+$", 0), f"{GAP}++", " "), " ")
    after = F.split(F.regexp_replace(F.regexp_extract(right, f"^{GAP}*+{WORD}(?:{GAP}++{WORD})?", 0), f"{GAP}++", " "), " ")

    def sides(before, after):
        b, a = (F.filter(x, lambda w: w != "") for x in (before, after))
        one = lambda mark, w: F.when(w.isNotNull(), F.concat(F.lit(mark), w))
        two = lambda mark, w: F.when(F.size(w) > 1, F.concat(F.lit(mark), F.array_join(w, " ")))
        return F.filter(F.array(one("L:", F.get(b, F.size(b) - 1)), two("L:", b), one("R:", F.get(a, F.lit(0))), two("R:", a)), lambda p: p.isNotNull())

    return let(F.struct(before.alias("b"), after.alias("a")), lambda x: sides(x["b"], x["a"]))


def _words_of(pattern):
    """Key of a pattern's words, without its side."""
    return F.xxhash64(F.substring(pattern, 3, 2 * CONTEXT))


def occurrences(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """(words, total): how often the words of each of ``patterns`` (words) stand in the texts of ``rows``, next to each other if they are two."""
    found = F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))
    keys = lambda w: F.concat(F.transform(w, lambda x: F.xxhash64(x)), F.transform(F.slice(w, F.lit(1), F.size(w) - 1), lambda x, i: F.xxhash64(F.concat_ws(" ", x, F.get(w, i + 1)))))
    each = rows.select(F.explode(F.when(F.col("text").rlike(WORD), let(found, keys))).alias("words"))
    return lookup_join(each, patterns, ["words"], "inner").groupBy("words").agg(F.count("*").alias("total"))


def marked(rows: DataFrame) -> DataFrame:
    """``rows`` (_row, text, ...) with ``base`` spans in order and ``seen``: every base span and identifier-like token with its patterns."""
    text = F.coalesce("text", F.lit(""))
    rows = rows.withColumn("_t", text).withColumn("_d", F.col("_t").rlike("[0-9]"))
    rows = rows.withColumn("base", F.array_sort(F.concat(*[_spans(F.col("_t"), F.col("_d"), k) for k in KINDS[:4]])))
    tokens = F.filter(_spans(F.col("_t"), F.col("_d"), "id"), lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    rows = rows.withColumn("_all", F.concat("base", tokens))
    seen = F.transform("_all", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.substring(F.col("_t"), s["start"] + 1, s["end"] - s["start"]).alias("instance"), _contexts(F.col("_t"), s["start"], s["end"]).alias("patterns")))
    return rows.withColumn("seen", seen).drop("_t", "_d", "_all")


def trusted(seen: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Patterns and instances to trust, from ``seen`` (instance, kind, patterns) in ``rows`` (text), by scores that go round the pattern-instance graph."""
    secret = F.col("instance").rlike(f"^(?:[0-9a-f]{{{SECRET},}}|[0-9A-F]{{{SECRET},}})$") & F.col("instance").rlike("(?i)[a-f]")
    edges = seen.select("instance", ((F.col("kind") < 4) | secret).alias("seed"), F.explode("patterns").alias("pattern"))
    edges = edges.groupBy("pattern", "instance").agg(F.count("*").alias("n"), F.max("seed").alias("seed"))
    # only patterns with so many instances can have so many seeds
    edges = cut(edges)
    wide = cut(edges.groupBy("pattern").agg(F.count("*").alias("instances")).where(F.col("instances") >= SEEDS).select("pattern", _words_of(F.col("pattern")).alias("words")))
    totals = cut(occurrences(rows, cut(wide.select("words").distinct())))
    wide = cut(lookup_join(wide, totals, ["words"]).select("pattern", F.coalesce("total", F.lit(0)).alias("total")))
    edges = cut(lookup_join(edges, wide, ["pattern"], "inner"))
    known = edges.select("pattern", "instance", "n", "total", F.when(F.col("seed"), ONE).otherwise(0).cast("long").alias("s"))
    for turn in range(ROUNDS):
        score = known.groupBy("pattern").agg(F.expr("sum(cast(n as decimal(38,0)) * s) div greatest(sum(n), max(total))").cast("long").alias("p"), F.count_if(F.col("s") > 0).alias("seeds"))
        good = cut(score.where((F.col("p") >= TRUST) & (F.col("seeds") >= SEEDS)).select("pattern", "p"))
        value = cut(lookup_join(edges.select("pattern", "instance"), good, ["pattern"], "inner").groupBy("instance").agg(F.max("p").alias("v")))
        if turn < ROUNDS - 1:
            known = lookup_join(edges, value, ["instance"])
            known = cut(known.select("pattern", "instance", "n", "total", F.when(F.col("seed"), ONE).otherwise(F.coalesce("v", F.lit(0))).cast("long").alias("s")))
    return good.select("pattern"), value.select("instance")


def find(docs: DataFrame) -> DataFrame:
    """(_row, the columns of ``docs`` but text, base, spans) for ``docs`` (_row, text, ...); spans holds base ones and those found by context."""
    keep = [c for c in docs.columns if c != "text"]
    slim = cut(marked(docs).select(*keep, "base", "seen"))
    each = slim.where(F.size("seen") > 0).select("_row", F.explode("seen").alias("s")).select("_row", "s.*")
    good, ids = trusted(each, docs)
    tokens = each.where(F.col("kind") == 4)
    span = F.struct("start", "kind", "end").alias("s")
    more = lookup_join(tokens.withColumn("pattern", F.explode("patterns")), good, ["pattern"], "left_semi").select("_row", span)
    more = more.union(lookup_join(tokens, ids, ["instance"], "left_semi").select("_row", span))
    more = more.groupBy("_row").agg(F.collect_set("s").alias("more"))
    spans = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(SPAN))))
    return slim.drop("seen").join(more, "_row", "left").withColumn("spans", spans).drop("more")


def _joined(spans: str):
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(wrapped(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text").drop("_in"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{KINDS[k]}") for k in range(4)]
    return found.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str | None = None) -> DataFrame:
    """Pipeline stage: every span becomes its kind in angle brackets; n_chars follows the text."""
    rows = wrapped(docs, "text", "n_chars")
    spans = cut(find(rows.select("_row", "text")).where(F.size("spans") > 0).select("_row", "spans"))
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def step(a, s):
        new = s["start"] >= a["at"]  # a span that begins inside the one before only lengthens it
        text = F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"]), F.get(names, s["kind"]))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(new, text).otherwise(a["out"]).alias("out"))

    walked = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    new = lookup_join(rows, spans, ["_row"]).withColumn("new", F.when(F.col("spans").isNotNull(), walked))
    length = F.when(F.col("new").isNotNull(), F.length("new")).otherwise(F.col("n_chars"))
    return unwrapped(new, docs, text=F.coalesce("new", "text"), n_chars=length)


QUERIES = {"op8_pii": op8_pii}
ORACLES: dict[str, str] = {}
