"""Quality rules: base rules, then robust multivariate outliers per language and source.

Five statistics of a text (length, mean word length, symbols and repeated words per word,
repeated lines per line, on a log scale) are held as whole thousandths, so all
sums are exact.  For each group a minimum-covariance-determinant estimate is
found by concentration steps: keep the half with the smallest distances, take its
mean and covariance, repeat.  The steps start from two sets of distances, both from medians and median deviations: the
sum of squares, and the largest one; of the two halves they end in, that with the smaller determinant is taken,
then reweighted with what lies inside the 97.5 % ellipse.  A text whose squared
Mahalanobis distance to its group is over CUTOFF is rejected.

Everything is DataFrame expressions.  Texts are read once for their statistics;
the steps run over that narrow table.  Per group only sums and counts of at most
BINS distance classes are gathered, so a group with a third of all rows is aggregated map-side like
any other.  Repeated windows of words are found by 64-bit hashes within a text.

Null and empty texts have no words and fail the base rules.  Null language or
source is a value of its own.  A text is judged by its language and source if they
have LEAST texts that pass the base rules, else by all texts of the language, or by the whole corpus where those are
fewer than LEAST; a corpus of fewer rejects nothing more.  Repeated rows and ids
are judged row by row; other columns are carried along by the stage under any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import SPACE, cut, is_small, let, lookup_join, table, unwrapped, with_row_id, wrapped

#: Statistics in thousandths, as SQL both engines read: floor(1000 * ln(1 + x) + 0.5).
STATISTICS = [
    "floor(1000 * ln(cast(n_words as double)) + 0.5)",
    "floor(1000 * ln(cast(word_chars as double) / n_words) + 0.5)",
    "floor(1000 * ln(1 + cast(n_symbols as double) / n_words) + 0.5)",
    "floor(1000 * ln(1 + cast(n_dup_lines as double) / text_lines) + 0.5)",
    "floor(1000 * ln(1 + cast(n_repeat_words as double) / n_words) + 0.5)",
]
#: A least standard deviation of each, in thousandths: most texts have no symbols at all.
LEAST_SD = [50, 15, 50, 50, 50]
P = len(STATISTICS)
LEAST = 40
STEPS = 4
#: Squared distances are counted in classes of 1/16; all from BINS on are one.
BINS = 4095
#: Of chi-square with 5 degrees: the median's consistency factor, the 97.5 % point, and the point that one of 10^9 exceeds.
RAW, INNER, CUTOFF = 1.92, 12.83, 50.7

BLANKS = " \t\n\x0b\x0c\r"


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, text_lines (long) and base_failed."""
    long = lambda x: x.cast("long")
    whole = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(whole, F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))

    def covered(windows):
        """Words in windows whose hash comes twice: sort, mark neighbours that are equal, add up what each adds on the right."""
        order = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def marked(s):
            twice = lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])
            at = F.sort_array(F.transform(F.filter(s, lambda x, k: F.coalesce(twice(x, k), F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))), lambda x: x["i"]))
            return let(at, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(5), F.coalesce(F.get(p, k + 1) - x, F.lit(5)))), F.lit(0), lambda a, x: a + x))

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(order, marked))

    def of(w):
        hashes = F.transform(w, lambda x: F.xxhash64(x))
        windows = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - 5), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(5)]))
        repeats = F.when(F.size(w) >= 6, let(hashes, lambda h: let(windows(h), covered))).otherwise(F.lit(0))
        return F.struct(long(F.size(w)).alias("n_words"), long(F.length(F.array_join(w, ""))).alias("word_chars"), long(repeats).alias("n_repeat_words"))

    lines = F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    out = docs.withColumn("_s", let(words, of)).withColumn("n_symbols", long(F.regexp_count(whole, F.lit("[#*$%&|<>]"))))
    out = out.withColumn("_l", let(lines, lambda x: F.struct(long(F.size(x)).alias("text_lines"), long(F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))))
    out = out.select("*", "_s.*", "_l.*").drop("_s", "_l")
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _pairs():
    return [(i, j) for i in range(P) for j in range(i + 1)]


def _sums(sums: str) -> list[str]:
    """Exact sums over a half; ``sums`` is the engine's wide integer type."""
    return ["count(*) as m", *[f"sum(cast(x{i} as {sums})) as s{i}" for i in range(P)], *[f"sum(cast(x{i} * x{j} as {sums})) as q{i}{j}" for i, j in _pairs()]]


def _estimate(factor: float) -> list[str]:
    """Mean and covariance from the sums; variances have a floor, and a hundredth of it on top keeps the matrix regular."""
    raw = lambda i, j: f"(cast(m * q{i}{j} - s{i} * s{j} as double) / (cast(m as double) * m)) * {factor}"
    cov = lambda i, j: raw(i, j) if i != j else f"greatest({raw(i, j)}, {float(LEAST_SD[i] ** 2)}) + {LEAST_SD[i] ** 2 / 100}"
    return [*[f"cast(s{i} as double) / m as u{i}" for i in range(P)], *[f"{cov(i, j)} as c{i}{j}" for i, j in _pairs()]]


def _cholesky(row: int) -> list[str]:
    """Row of the lower triangle, from the rows before."""
    i, out = row, []
    for j in range(i):
        out.append(f"(c{i}{j}{''.join(f' - l{i}{k} * l{j}{k}' for k in range(j))}) / l{j}{j} as l{i}{j}")
    return out


def _diagonal(i: int) -> str:
    return f"sqrt(c{i}{i}{''.join(f' - l{i}{k} * l{i}{k}' for k in range(i))}) as l{i}{i}"


def _lower() -> list[list[str]]:
    """Projections, one after the other, that add the Cholesky factor's columns: an entry may use those before it."""
    steps = []
    for i in range(P):
        steps += [[x] for x in _cholesky(i)]
        steps.append([_diagonal(i)])
    return steps


PARAMETERS = [f"u{i}" for i in range(P)] + [f"l{i}{j}" for i, j in _pairs()]


def _distance() -> list[list[str]]:
    """Projections that add z0.. by forward substitution, then d2."""
    steps = [[f"(x{i} - u{i}{''.join(f' - l{i}{k} * z{k}' for k in range(i))}) / l{i}{i} as z{i}"] for i in range(P)]
    return [*steps, [" + ".join(f"z{i} * z{i}" for i in range(P)) + " as d2"]]


BIN = f"cast(least(floor(d2 * 16), {BINS}) as int) as bin"


#: Log of the square root of the determinant, rounded so that equal halves tie.
VOLUME = "round(" + " + ".join(f"ln(l{i}{i})" for i in range(P)) + ", 9) as volume"
XS = [f"x{i}" for i in range(P)]
FIRST = {0: " + ".join(f"((x{i} - u{i}) / v{i}) * ((x{i} - u{i}) / v{i})" for i in range(P)), 1: "greatest(" + ", ".join(f"abs(x{i} - u{i}) / v{i}" for i in range(P)) + ")"}


def groups(seen: DataFrame) -> DataFrame:
    """By lang and source: the group its texts are judged by, and all groups they are members of (grp, judged); cut."""
    sizes = cut(seen.groupBy("lang", "source").agg(F.count("*").alias("n")))
    langs = sizes.groupBy(F.col("lang").alias("_l")).agg(F.sum("n").alias("n_lang"), F.min("n").alias("least"))
    corpus = sizes.agg(F.sum("n")).first()[0] or 0
    sizes = cut(sizes.join(langs, sizes["lang"].eqNullSafe(langs["_l"])).drop("_l"))
    rare = F.lit(not sizes.where(F.col("n_lang") < LEAST).isEmpty())
    own, lang = F.col("n") >= LEAST, (F.col("n") < LEAST) & (F.col("n_lang") >= LEAST)
    key = lambda level, *of: F.xxhash64(F.to_json(F.struct(F.lit(level).alias("level"), *of)))
    none = F.lit(None)
    member = F.array(
        F.struct(F.when(own, key(0, "lang", "source")).alias("grp"), own.alias("judged")),
        F.struct(F.when((F.col("least") < LEAST) & (F.col("n_lang") >= LEAST), key(1, "lang")).alias("grp"), lang.alias("judged")),
        F.struct(F.when(rare & F.lit(corpus >= LEAST), key(2)).otherwise(none).alias("grp"), (F.col("n_lang") < LEAST).alias("judged")),
    )
    return cut(sizes.select("lang", "source", F.explode(F.filter(member, lambda g: g["grp"].isNotNull())).alias("g")).select(F.col("lang").alias("_l"), F.col("source").alias("_s"), "g.grp", "g.judged"))


def verdicts(stats: DataFrame, steps: int = STEPS, cutoff: float = CUTOFF) -> DataFrame:
    """``stats`` (from statistics(), with lang and source; cut) with ``d2`` (null: not judged) and ``kept``."""
    stats = with_row_id(stats, "_id")
    seen = stats.where("not base_failed")
    group = groups(seen)
    same = seen["lang"].eqNullSafe(group["_l"]) & seen["source"].eqNullSafe(group["_s"])
    x = seen.join(F.broadcast(group) if is_small(group) else group, same).selectExpr("_id", "grp", "judged", *[f"cast({s} as bigint) as x{i}" for i, s in enumerate(STATISTICS)])
    x = cut(x)
    of = lambda df, table, on=("grp", "start"): lookup_join(df, cut(table), list(on), "inner")

    def distances(rows, model):
        near = of(rows, model.select("grp", *(["start"] if "start" in rows.columns else []), *PARAMETERS), ("grp", "start") if "start" in rows.columns else ("grp",))
        for e in _distance():
            near = near.selectExpr("*", *e)
        return near.drop(*PARAMETERS, *[f"z{i}" for i in range(P)])

    def estimated(rows, factor, *by):
        model = rows.groupBy(*by).agg(*[F.expr(e) for e in _sums("decimal(38,0)")]).selectExpr(*by, *_estimate(factor))
        for e in _lower():
            model = model.selectExpr("*", *e)
        return model

    centre = of(x, x.groupBy("grp").agg(*[F.expr(f"percentile(x{i}, 0.5) as u{i}") for i in range(P)]), ["grp"])
    spread = of(centre, centre.groupBy("grp").agg(*[F.expr(f"greatest(1.4826 * percentile(abs(x{i} - u{i}), 0.5), {float(LEAST_SD[i])}) as v{i}") for i in range(P)]), ["grp"])
    starts = F.explode(F.array(*[F.struct(F.lit(k).alias("start"), F.expr(e).alias("d2")) for k, e in FIRST.items()])).alias("d")
    near = spread.select("grp", *XS, starts).select("grp", *XS, "d.*")
    both = x.select("grp", *XS, F.explode(F.array(*map(F.lit, FIRST))).alias("start"))
    for step in range(steps + 1):
        near = near.selectExpr("*", BIN)
        half = of(near, near.groupBy("grp", "start").agg(F.expr("percentile(bin, 0.5) as most"))).where("bin <= most")
        model = cut(estimated(half, RAW, "grp", "start"))
        if step < steps:
            near = distances(both, model)
    best = model.selectExpr("grp", "start", VOLUME).groupBy("grp").agg(F.min(F.struct("volume", "start")).getField("start").alias("start"))
    model = model.join(best, ["grp", "start"], "left_semi").drop("start")
    near = distances(x, model).where(f"d2 <= {INNER}")
    near = distances(x.where("judged"), estimated(near, 1.0, "grp"))
    judged = stats.join(near.select("_id", "d2"), "_id", "left").drop("_id")
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("d2").isNull() | (F.col("d2") <= cutoff)))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = verdicts(cut(statistics(docs).drop("text")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str | None = None) -> DataFrame:
    """Pipeline stage: documents that the rules reject go; the columns stay as they are."""
    rows = wrapped(docs, "text", "lang", "source")
    stats = cut(statistics(rows.drop("_in")).drop("text"))
    gone = cut(verdicts(stats).where("not kept").select("_row"))
    return unwrapped(lookup_join(rows.select("_row", "_in"), gone, ["_row"], "left_anti"), docs)


def oracle(docs: str = "documents") -> str:
    """DuckDB twin of op1_quality."""
    base = f"""
    t as (select row_number() over () as _id, doc_id, lang, source, coalesce(text, '') as text from {docs}),
    w as (select _id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from t),
    win as (select _id, i, w[i:i+4] as v from (select _id, w, unnest(range(1, len(w) - 3)) as i from w)),
    twice as (select _id, i from win qualify count(*) over (partition by _id, v) > 1),
    rep as (select _id, count(*) as n from (select distinct _id, unnest(range(i, i + 5)) as j from twice) group by _id),
    stats as (
      select t._id, doc_id, lang, source, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
        cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols, cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines,
        cast(coalesce(rep.n, 0) as bigint) as n_repeat_words, len(l) as text_lines
      from t join w using (_id) left join rep using (_id)),
    judged as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from stats),
    sizes as (select *, sum(n) over (partition by lang) as n_lang, min(n) over (partition by lang) as least, sum(n) over () as corpus
      from (select lang, source, count(*) as n from judged where not base_failed group by lang, source)),
    members as (select lang, source, 0 as level, true as judged from sizes where n >= {LEAST}
      union all select lang, source, 1, n < {LEAST} from sizes where least < {LEAST} and n_lang >= {LEAST}
      union all select lang, source, 2, n_lang < {LEAST} from sizes where corpus >= {LEAST} and (select min(n_lang) from sizes) < {LEAST}),
    x as (select _id, m.judged, concat_ws('|', level, case when level < 2 then coalesce('=' || j.lang, '') end, case when level < 1 then coalesce('=' || j.source, '') end) as grp,
      {', '.join(f'cast({s} as bigint) as x{i}' for i, s in enumerate(STATISTICS))}
      from judged j join members m on j.lang is not distinct from m.lang and j.source is not distinct from m.source where not base_failed)"""
    xs = ", ".join(XS)
    ctes = [base.strip()]
    ctes.append("med as (select grp, " + ", ".join(f"quantile_cont(x{i}, 0.5) as u{i}" for i in range(P)) + " from x group by grp)")
    ctes.append("mad as (select grp, " + ", ".join(f"greatest(1.4826::double * quantile_cont(abs(x{i} - u{i}), 0.5), {float(LEAST_SD[i])}) as v{i}" for i in range(P)) + " from x join med using (grp) group by grp)")
    ctes.append("n0 as (" + " union all ".join(f"select grp, {k} as start, {xs}, {e} as d2 from x join med using (grp) join mad using (grp)" for k, e in FIRST.items()) + ")")

    def estimated(name: str, rows: str, factor: float, by: str) -> str:
        ctes.append(f"{name}_0 as (select {by}, {', '.join(_estimate(factor))} from (select {by}, {', '.join(_sums('hugeint'))} from {rows} group by {by}))")
        for k, e in enumerate(_lower()):
            ctes.append(f"{name}_{k + 1} as (select *, {e[0]} from {name}_{k})")
        return f"{name}_{len(_lower())}"

    def distances(name: str, model: str, more: str) -> str:
        ctes.append(f"{name}_0 as (select _id, judged, x.grp, {more} {xs}, {', '.join(PARAMETERS)} from x join {model} using (grp))")
        for k, e in enumerate(_distance()):
            ctes.append(f"{name}_{k + 1} as (select *, {e[0]} from {name}_{k})")
        return f"{name}_{len(_distance())}"

    near = "n0"
    for step in range(STEPS + 1):
        ctes.append(f"b{step} as (select *, {BIN} from {near})")
        half = f"(select * from b{step} join (select grp, start, quantile_cont(bin, 0.5) as most from b{step} group by grp, start) using (grp, start) where bin <= most)"
        model = estimated(f"m{step}", half, RAW, "grp, start")
        if step < STEPS:
            near = distances(f"d{step}", model, "start,")
    ctes.append(f"best as (select * from {model} qualify row_number() over (partition by grp order by {VOLUME.removesuffix(' as volume')}, start) = 1)")
    inner = distances("di", "best", "")
    last = distances("dl", estimated("ml", f"(select * from {inner} where d2 <= {INNER})", 1.0, "grp"), "")
    return f"""with {', '.join(ctes)}
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and (d2 is null or d2 <= {CUTOFF}) as kept
    from judged left join (select _id, d2 from {last} where judged) using (_id)"""


QUERIES = {"op1_quality": op1_quality}
ORACLES = {"op1_quality": oracle()}
