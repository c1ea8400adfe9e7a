"""Queries of SURVEY section 2.3: filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import geometry, text
from leafmill.plans.registry import query
from leafmill.plans.standins import BOXES, LINES, boxes, lines, table

_CLASS = r"\s\x{2026}\x{2025}\x{30fb}\x{3002}\x{3001}\x{ff0c},.\x{2022}!?\x{ff01}\x{ff1f}\x{30fc}\x{2014}\x{2015}\x{2500}~\x{ff5e}\x{301c}\-\x{2212}\x{300c}\x{300d}\x{300e}\x{300f}()\x{ff08}\x{ff09}:;\x{ff1a}\x{ff1b}\x{3000}''" + '"' + r"\x{201c}\x{201d}\x{2018}\x{2019}*\x{ff0a}"
def _punct(t: str) -> str:
    return f"({t} <> '' and regexp_matches({t}, '^[" + _CLASS + "]+$'))"


_TEXT = "case doc_id % 5 when 0 then text when 1 then '……！' when 2 then '' when 3 then '(?!)' end"
TEXTS = f"texts as (select doc_id, lang, source, {_TEXT} as text from documents)"


def texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.expr(_TEXT).alias("text"))


@query("flt01_punctuation_only", f"with {TEXTS} select doc_id, coalesce({_punct('text')}, false) as not_text, case when {_punct('text')} then 'punctuation only' end as reason from texts")
def punctuation_only(spark, sf_dir):
    hit = text.punctuation_only(F.col("text"))
    return texts(spark, sf_dir).select("doc_id", hit.alias("not_text"), F.when(hit, "punctuation only").alias("reason"))


@query("flt02_null_word", """select conv_id, turn, coalesce(lower(trim(trim(t, ' ' || chr(9) || chr(10)), '"''')) = 'null', false) as is_null from (select conv_id, turn, case turn % 4 when 0 then ' "Null" ' when 1 then 'null' when 2 then role end as t from conversations)""")
def null_word(spark, sf_dir):
    t = F.expr("""case turn % 4 when 0 then ' "Null" ' when 1 then 'null' when 2 then role end""")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.is_null_word(t).alias("is_null"))


@query("flt03_language_tag", "select doc_id, regexp_full_match(case when doc_id % 3 = 0 then lang when doc_id % 3 = 1 then lang || '-Latn' else lang || '<x' end, '[A-Za-z]{2,3}(-[A-Za-z0-9]{1,8})*') as ok from documents")
def language_tag(spark, sf_dir):
    tag = F.when(F.col("doc_id") % 3 == 0, F.col("lang")).when(F.col("doc_id") % 3 == 1, F.concat("lang", F.lit("-Latn"))).otherwise(F.concat("lang", F.lit("<x")))
    return table(spark, sf_dir, "documents").select("doc_id", text.is_language_tag(tag).alias("ok"))


@query("flt04_dismiss_split", "select doc_id, case when toxic = 1 then 'dismissed' else 'kept' end as side, case when toxic = 1 then case when doc_id % 2 = 0 then 'vision' else 'punctuation only' end end as reason, case when toxic = 1 then doc_id % 2 = 0 end as editable from labels")
def dismiss_split(spark, sf_dir):
    """Kept and set-aside regions in one pass; only what the vision model set aside can be edited."""
    gone = F.col("toxic") == 1
    vision = F.col("doc_id") % 2 == 0
    return table(spark, sf_dir, "labels").select("doc_id", F.when(gone, "dismissed").otherwise("kept").alias("side"), F.when(gone, F.when(vision, "vision").otherwise("punctuation only")).alias("reason"), F.when(gone, vision).alias("editable"))


_STATUS = "cast(list_extract([0, 200, 400, 401, 408, 429, 500, 503], cast(event_id % 8 as int) + 1) as int)"


@query("flt05_transient", f"select event_id, {_STATUS} as status, {_STATUS} in (0, 200, 408, 429) or {_STATUS} >= 500 as transient from events")
def transient(spark, sf_dir):
    status = F.get(F.array(*map(F.lit, [0, 200, 400, 401, 408, 429, 500, 503])), F.col("event_id") % 8)
    return table(spark, sf_dir, "events").select("event_id", status.alias("status")).withColumn("transient", text.is_transient(F.col("status")))


@query("flt06_blank_gate", "select user_id, not coalesce(round(stddev_pop(case when value > 1000 then null else floor(value) end), 6) >= 8, false) as blank from events group by user_id")
def blank_gate(spark, sf_dir):
    """Blank unless the gray values spread by 8 at least; no values, or a spread that is no number, are blank."""
    std = F.round(F.stddev_pop(F.when(F.col("value") <= 1000, F.floor("value").cast("double"))), 6)
    return table(spark, sf_dir, "events").groupBy("user_id").agg((~F.coalesce((std >= 8) & ~F.isnan(std), F.lit(False))).alias("blank"))


@query("flt07_min_side", f"with {BOXES} select page, id from boxes where x1 - x0 >= 44 and y1 - y0 >= 44")
def min_side(spark, sf_dir):
    """Quads with both sides long enough (the engine's floor is 4 px; the stand-in boxes start at 20)."""
    return boxes(spark, sf_dir).where(geometry.min_side(44)).select("page", "id")


@query("flt08_confidence_floor", f"with {LINES} select doc_id, string_agg(trim(text), '|' order by line) as text from lines where trim(text) <> '' and (doc_id * 7 + line * 3) % 10 >= 5 group by doc_id")
def confidence_floor(spark, sf_dir):
    """Recognised lines that hold text and reach half confidence, in order."""
    kept = lines(spark, sf_dir).where((F.trim("text") != "") & ((F.col("doc_id") * 7 + F.col("line") * 3) % 10 / 10 >= 0.5))
    parts = F.array_sort(F.collect_list(F.struct("line", F.trim("text").alias("text"))))
    return kept.groupBy("doc_id").agg(parts.alias("p")).select("doc_id", F.array_join(F.col("p.text"), "|").alias("text"))


@query("flt09_model_filter", "select p_partkey, p_name from part where contains(lower(p_name), 'a') or contains(lower(coalesce(p_brand, '')), 'brand#1')")
def model_filter(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.lower("p_name").contains("a") | F.lower(F.coalesce("p_brand", F.lit(""))).contains("brand#1")).select("p_partkey", "p_name")


@query("flt10_edge_adjacent", f"with {BOXES} select page, id, x0 < 0.08 * (x1 - x0) or 560 - x1 < 0.08 * (x1 - x0) as edge from boxes")
def edge_adjacent(spark, sf_dir):
    return boxes(spark, sf_dir).select("page", "id", geometry.edge_adjacent(F.lit(560)).alias("edge"))


@query("flt11_orphan_line", "select doc_id, len(ls) >= 2 and len(list_filter(ls, lambda x: x not like '% %' and length(x) < 4)) > 0 as orphan from (select doc_id, string_split(text, chr(10)) as ls from documents)")
def orphan_line(spark, sf_dir):
    ls = F.split("text", "\n")
    return table(spark, sf_dir, "documents").select("doc_id", ((F.size(ls) >= 2) & F.exists(ls, lambda x: ~x.contains(" ") & (F.length(x) < 4))).alias("orphan"))


_FIT = "case when l_linenumber < 6 then l_linenumber end as rung, 10 + l_quantity % 30 as font, l_partkey % 9 = 0 as failed, l_suppkey % 7 = 0 as compromised, l_returnflag = 'R' as cut"


@query("flt12_fit_acceptance", f"with f as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, {_FIT} from lineitem) select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, font >= 12 and coalesce(rung, 9) <= 3 and not failed and not compromised and not cut as ok from f")
def fit_acceptance(spark, sf_dir):
    """A region passes at a font of the floor, a rung of 3 at most (9 if unknown), no flag, and its whole text."""
    f = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", *_FIT.split(", "))
    ok = (F.col("font") >= 12) & (F.coalesce("rung", F.lit(9)) <= 3) & ~F.col("failed") & ~F.col("compromised") & ~F.col("cut")
    return f.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", ok.alias("ok"))
