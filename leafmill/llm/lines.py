"""Line dedup by a log-template tree.

A line is parsed to a leaf of a tree of fixed depth: its token count, then its
first DEPTH tokens, where tokens with digits are variable.  In a leaf, a token that stands at its
position in fewer than DOCS lines is generalised to a variable field; what
remains constant is the line's template.  A template that DOCS documents hold, and of which at least
CONSTANT of the tokens are constant, recurs.  A line without variable fields is
a template of its own: equal lines recur from DOCS documents on, whatever their
tokens, and from two on if they have LONG tokens.  Recurring lines are dropped from every
document but the first (smallest doc_id, nulls last, then first row), so a group of copies
keeps one whole text.

Texts are parsed once for keys of lines; tokens are parsed again only where a line
of at least TOKENS tokens lies in a leaf with DOCS documents.
Equal lines of a leaf are one row with a count from then on, so a line that a third of all
documents hold costs no more than another; counts are pre-aggregated.  All is DataFrame expressions.

Blank lines stay.  Null texts stay null, empty ones empty.  Repeated rows count as documents of
their own.  Within a document repeats of a line share its fate.  Other columns
pass through the stage under any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import SPACE, cut, is_small, lookup_join, row_join, table, unwrapped, wrapped

DEPTH, TOKENS, DOCS, CONSTANT, LONG = 3, 3, 3, 0.7, 50
BLANKS = " \t\n\x0b\x0c\r"
FIELD = "<*>"


def _lines(rows: DataFrame) -> DataFrame:
    """(_row, doc_id, line, _l, _m, n, leaf) of each line with a word: its text, its masked tokens with a blank between, their number, and its leaf.

    Most lines have neither digits nor other white space than lone blanks: they are their own masked tokens, and no
    token is cut out of them.
    """
    lines = rows.select("_row", "doc_id", F.posexplode(F.split("text", "\n")).alias("line", "_l"))
    lines = lines.withColumn("_l", F.btrim("_l", F.lit(BLANKS))).where("_l <> ''")
    plain = ~(F.col("_l").contains("  ") | F.col("_l").rlike(r"[0-9\x09-\x0D]"))
    masked = F.transform(F.split("_l", SPACE), lambda t: F.when(t.rlike("[0-9]"), FIELD).otherwise(t))
    lines = lines.withColumn("_m", F.when(plain, F.col("_l")).otherwise(F.array_join(masked, " ")))
    lines = lines.withColumn("n", F.octet_length("_m") - F.octet_length(F.replace("_m", F.lit(" "), F.lit(""))) + 1)
    return lines.withColumn("leaf", F.xxhash64("n", F.substring_index("_m", " ", DEPTH)))


def _documents(lines: DataFrame, *key: str) -> DataFrame:
    """How many documents hold each key, and which is the first."""
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_row"))
    return lines.groupBy(*key, "_row").agg(F.min(order).alias("o")).groupBy(*key).agg(F.count("*").alias("docs"), F.min("o").getField("_row").alias("first"))


def dropped(rows: DataFrame) -> DataFrame:
    """(_row, lines) for ``rows`` (_row, doc_id, text): numbers of the lines to drop, for rows that have any."""
    keys = _lines(rows).select("_row", "doc_id", "line", "n", F.xxhash64("_l").alias("exact"), "leaf", F.xxhash64("_m").alias("same"))
    keys = cut(keys)
    equal = _documents(keys, "exact", "n").where((F.col("docs") >= DOCS) | (F.col("docs") >= 2) & (F.col("n") >= LONG))
    gone = [lookup_join(keys, cut(equal.select("exact", "first")), ["exact"], "inner")]

    inner = keys.where(F.col("n") >= TOKENS)
    leaves = cut(_documents(inner, "leaf").where(F.col("docs") >= DOCS).select("leaf"))
    inner = lookup_join(inner, leaves, ["leaf"], "left_semi")
    # equal lines become one: its tokens, and in how many documents it is
    parsed = lookup_join(_lines(rows).where(F.col("n") >= TOKENS), leaves, ["leaf"], "left_semi")
    distinct = parsed.groupBy("leaf", F.xxhash64("_m").alias("same")).agg(F.first("_m").alias("tokens"))
    distinct = cut(distinct.join(_documents(inner, "leaf", "same").select("leaf", "same", F.col("docs").alias("n")), ["leaf", "same"]))
    token = distinct.select("leaf", "same", "n", F.posexplode(F.split("tokens", " ")).alias("at", "token"))
    constant = token.where(F.col("token") != FIELD).groupBy("leaf", "at", "token").agg(F.sum("n").alias("docs")).where(F.col("docs") >= DOCS).select("leaf", "at", "token", F.lit(True).alias("constant"))
    known = token.join(constant, ["leaf", "at", "token"], "left")
    part = F.struct("at", F.when(F.col("constant"), F.col("token")).otherwise(FIELD).alias("token"))
    template = known.groupBy("leaf", "same").agg(F.sort_array(F.collect_list(part)).alias("t"), F.count("constant").alias("held"))
    template = template.where(F.col("held") >= CONSTANT * F.size("t"))
    template = cut(template.select("leaf", "same", F.xxhash64(F.array_join(F.col("t.token"), " ")).alias("template")))
    held = lookup_join(inner, template, ["leaf", "same"], "inner")
    recurring = _documents(held, "leaf", "template").where(F.col("docs") >= DOCS).select("leaf", "template", "first")
    gone.append(lookup_join(held, cut(recurring), ["leaf", "template"], "inner"))
    each = [g.where("_row <> first").select("_row", "line") for g in gone]
    return each[0].union(each[1]).groupBy("_row").agg(F.collect_set("line").alias("lines"))


def dedup(rows: DataFrame) -> DataFrame:
    """``rows`` (_row, doc_id, text, ...) with recurring lines out of ``text``, and ``n_lines`` and ``n_dropped`` (long)."""
    gone = cut(dropped(rows.select("_row", "doc_id", "text")))
    if is_small(gone):
        rows = rows.join(F.broadcast(gone), "_row", "left")
    else:  # only texts that lose lines are shuffled
        ids = gone.select("_row")
        rest = row_join(rows, ids, "left_anti").withColumn("lines", F.lit(None).cast("array<int>"))
        rows = row_join(rows, ids, "left_semi").join(gone, "_row").unionByName(rest)
    lines = F.split("text", "\n")
    text = F.when(F.col("lines").isNull(), F.col("text")).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("lines", i)), "\n"))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    dropped_ = F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long")
    return rows.withColumns({"n_lines": n, "n_dropped": dropped_, "text": text}).drop("lines")


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(wrapped(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text").drop("_in"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str | None = None) -> DataFrame:
    """Pipeline stage: recurring lines go; n_chars follows the text."""
    out = dedup(wrapped(docs, "doc_id", "text", "n_chars"))
    return unwrapped(out, docs, text=F.col("text"), n_chars=F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")))


QUERIES = {"op4_lines": op4_lines}
ORACLES = {
    "op4_lines": f"""
    with d as (select row_number() over () as r, doc_id, text, string_split(text, chr(10)) as ls from documents),
    l as (select r, doc_id, unnest(range(len(ls))) as line, unnest(ls) as s from d),
    t as (select r, doc_id, line, list_transform(regexp_extract_all(s, '[^\\x20\\x09-\\x0D]+'), lambda x: case when regexp_matches(x, '[0-9]') then '{FIELD}' else x end) as t from l),
    m as (select r, doc_id, line, t, len(t) as n, t[1:{DEPTH}] as lead from t where len(t) >= {TOKENS}),
    f as (select n, lead from m group by n, lead having count(distinct r) >= {DOCS}),
    a as (select m.* from m join f using (n, lead)),
    u as (select n, lead, t, count(distinct r) as docs from a group by n, lead, t),
    k as (select n, lead, t, docs, unnest(range(len(t))) as pos, unnest(t) as token from u),
    c as (select n, lead, pos, token from k where token <> '{FIELD}' group by n, lead, pos, token having sum(docs) >= {DOCS}),
    p as (select n, lead, t, list(case when c.pos is not null then token else '{FIELD}' end order by pos) as template, count(c.pos) as held
      from k left join c using (n, lead, pos, token) group by n, lead, t),
    q as (select a.r, a.doc_id, a.line, n, lead, template from a join p using (n, lead, t) where held >= {CONSTANT} * len(template)),
    g as (select n, lead, template, min(struct_pack(a := doc_id is null, b := doc_id, c := r)).c as first from q group by n, lead, template having count(distinct r) >= {DOCS}),
    e as (select r, doc_id, line, trim(s, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) as s, len(regexp_extract_all(s, '[^\\x20\\x09-\\x0D]+')) as n from l),
    h as (select s, min(struct_pack(a := doc_id is null, b := doc_id, c := r)).c as first from e where s <> '' group by s, n having count(distinct r) >= {DOCS} or count(distinct r) >= 2 and n >= {LONG}),
    o as (select r, line from q join g using (n, lead, template) where r <> first union select r, line from e join h using (s) where r <> first),
    x as (select r, list(distinct line) as lines from o group by r)
    select doc_id, cast(coalesce(len(ls), 0) as bigint) as n_lines, cast(coalesce(len(lines), 0) as bigint) as n_dropped,
      sha256(coalesce(case when lines is null then text else array_to_string(list_filter(ls, lambda s, i: not list_contains(lines, i - 1)), chr(10)) end, '')) as text_sha256
    from d left join x using (r)
    """
}
