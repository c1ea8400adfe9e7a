"""Queries of SURVEY sections 2.7 and 2.10: joins and set operations on records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafmill.operators import records
from leafmill.plans.filters import TEXTS, _punct, texts
from leafmill.plans.registry import query
from leafmill.plans.standins import table

STORED = "stored as (select doc_id, case when toxic = 1 then null else 'tr-' || doc_id end as text, quality = 1 as edited from labels)"


def stored(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, None).otherwise(F.concat(F.lit("tr-"), F.col("doc_id").cast("string"))).alias("text"), (F.col("quality") == 1).alias("edited"))


_STATE = f"case when coalesce({_punct('t.text')}, false) then 'punctuation' when s.doc_id is null then 'missing' when s.text is null then 'vision' when s.edited then 'edited' else 'translated' end"
_APPLIED = f"{TEXTS}, {STORED}, applied as (select t.doc_id, t.lang, t.source, s.text as stored_text, {_STATE} as state from texts t left join stored s on t.doc_id = s.doc_id)"


def _applied(spark, sf_dir):
    return records.apply_translations(texts(spark, sf_dir), stored(spark, sf_dir), ["doc_id"])


@query("join02_apply_translations", f"""with {_APPLIED} select lang, source, count(*) as regions, count(*) filter (state in ('missing', 'edited', 'translated')) as kept, count(*) filter (state = 'punctuation') as punctuation,
  count(*) filter (state = 'vision') as vision, count(*) filter (state = 'missing') as missing, count(*) filter (state = 'edited') as edited from applied group by lang, source""")
def apply_translations(spark, sf_dir):
    """Per page: what is kept, what is set aside and why, what is still to be translated."""
    n = lambda *s: F.count_if(F.col("state").isin(*s))
    return _applied(spark, sf_dir).groupBy("lang", "source").agg(
        F.count("*").alias("regions"), n("missing", "edited", "translated").alias("kept"), n("punctuation").alias("punctuation"), n("vision").alias("vision"), n("missing").alias("missing"), n("edited").alias("edited")
    )


@query("join01_fit_results", """select o_orderkey, o_orderstatus, f.font, coalesce(f.failed, false) as failed from orders left join (select l_orderkey, min(l_quantity) as font, bool_or(l_returnflag = 'R') as failed from lineitem where l_linenumber < 3 group by 1) f on o_orderkey = l_orderkey""")
def fit_results(spark, sf_dir):
    fits = table(spark, sf_dir, "lineitem").where("l_linenumber < 3").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_quantity").alias("font"), F.bool_or(F.col("l_returnflag") == "R").alias("failed"))
    return table(spark, sf_dir, "orders").join(fits, "o_orderkey", "left").select("o_orderkey", "o_orderstatus", "font", F.coalesce("failed", F.lit(False)).alias("failed"))


@query("join04_pair_decisions", "select d.doc_id, coalesce(l.quality, -1) as decision, l.doc_id is null as dismissed from documents d left join labels l on d.doc_id = l.doc_id")
def pair_decisions(spark, sf_dir):
    """Regions without an entry for this language and model are dismissed."""
    known = table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(True).alias("found"))
    return table(spark, sf_dir, "documents").select("doc_id").join(known, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("decision"), F.col("found").isNull().alias("dismissed"))


@query("join05_coverage", """with r as (select d.source, d.doc_id, l.doc_id is not null as stored, coalesce(l.quality = 1, false) as edited from documents d left join labels l on d.doc_id = l.doc_id)
  select source, count(*) filter (not stored and not edited) as uncovered, case when count(*) filter (stored) = 0 and count(*) filter (not edited) > 0 then 'translation' end as miss from r group by source""")
def coverage(spark, sf_dir):
    """A page whose store holds nothing for regions that need it is a miss of kind translation."""
    known = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("edited"), F.lit(True).alias("stored"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(known, "doc_id", "left").fillna(False, ["edited", "stored"])
    need = F.count_if(~F.col("edited"))
    return rows.groupBy("source").agg(F.count_if(~F.col("stored") & ~F.col("edited")).alias("uncovered"), F.when((F.count_if("stored") == 0) & (need > 0), "translation").alias("miss"))


@query("join06_legacy_reproduce", """with a as (select user_id as page, event_id as id, value::bigint as p from events), b as (select user_id as page, event_id as id, case when event_id % 50 = 3 then null when event_id % 70 = 1 then -1 else value::bigint end as p from events where event_id % 90 <> 7)
  select page, bool_and(a.p is not distinct from b.p) as same from a left join b using (page, id) group by page""")
def legacy_reproduce(spark, sf_dir):
    """A cached page is taken over only if detection gives every polygon again (null-safe)."""
    a = table(spark, sf_dir, "events").select(F.col("user_id").alias("page"), F.col("event_id").alias("id"), F.round("value").cast("bigint").alias("p"))
    b = a.where("id % 90 <> 7").select("page", "id", F.expr("case when id % 50 = 3 then null when id % 70 = 1 then -1 else p end").alias("p2"))
    return a.join(b, ["page", "id"], "left").groupBy("page").agg(F.bool_and(F.col("p").eqNullSafe(F.col("p2"))).alias("same"))


@query("join07_placement_content", "select d.source as item, row_number() over (partition by d.source order by d.doc_id) as ordinal, h.page_hash, h.copies from documents d join (select text, sha256(text) as page_hash, count(*) as copies from documents group by text) h on d.text = h.text")
def placement_content(spark, sf_dir):
    """Placement to content: many ordinals share a page's hash."""
    pages = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("page_hash"))
    content = pages.groupBy("page_hash").agg(F.count("*").alias("copies"))
    placed = pages.select(F.col("source").alias("item"), F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("long").alias("ordinal"), "page_hash")
    return placed.join(content, "page_hash").select("item", "ordinal", "page_hash", "copies")


_REFS = "refs as (select sha256(text) as page, source as job from documents), live as (select distinct source as job from documents where doc_id % 40 < 10)"


@query("join08_live_references", f"with {_REFS} select page, count(*) filter (job in (select job from live)) as kept, count(*) filter (job not in (select job from live)) as removed from (select distinct page, job from refs) group by page")
def live_references(spark, sf_dir):
    refs = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("page"), F.col("source").alias("job")).distinct()
    live = table(spark, sf_dir, "documents").where("doc_id % 40 < 10").select(F.col("source").alias("job")).distinct().withColumn("live", F.lit(True))
    return refs.join(live, "job", "left").groupBy("page").agg(F.count("live").alias("kept"), F.count_if(F.col("live").isNull()).alias("removed"))


@query("join09_edit_elsewhere", "select distinct a.conv_id, a.role as model from conversations a where exists (select 1 from conversations b where a.conv_id = b.conv_id and b.role <> a.role and b.turn % 2 = 1)")
def edit_elsewhere(spark, sf_dir):
    """Pages with an edit under another language or model."""
    c = table(spark, sf_dir, "conversations")
    edits = c.where("turn % 2 = 1").select(F.col("conv_id").alias("k"), F.col("role").alias("other"))
    return c.join(edits, (F.col("conv_id") == F.col("k")) & (F.col("role") != F.col("other")), "left_semi").select("conv_id", F.col("role").alias("model")).distinct()


@query("set01_batch_union", """with b as (select l_orderkey % 500 as id, l_quantity as text, row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) as n from lineitem)
  select id, max(cast((n + 39) // 40 as bigint)) as batch, arg_max(text, n) as text from b group by id""")
def batch_union(spark, sf_dir):
    """Replies of batches of 40 regions: the later batch wins per id.

    The global number comes from counts per order range on top of a rank inside it, so no task numbers all rows.
    """
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    rows = table(spark, sf_dir, "lineitem").select(*order).withColumn("part", F.floor(F.col("l_orderkey") / 64))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("part").agg(F.count("*").alias("c")).select("part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"))
    numbered = rows.join(counts, "part").withColumn("n", F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    return numbered.groupBy((F.col("l_orderkey") % 500).alias("id")).agg(F.max(F.floor((F.col("n") + 39) / 40)).alias("batch"), F.max_by("l_quantity", "n").alias("text"))


_UP = f"{STORED}, fresh as (select doc_id, case when doc_id % 4 = 0 then null else lang end as text from documents where doc_id % 3 <> 0)"


@query("set02_translation_upsert", f"""with {_UP} select doc_id, case when n.doc_id is not null and not coalesce(o.edited, false) then n.text else o.text end as text, coalesce(case when not (n.doc_id is not null and not coalesce(o.edited, false)) then o.edited end, false) as edited,
  n.doc_id is not null and not coalesce(o.edited, false) and n.text is null as boxed from stored o full outer join fresh n using (doc_id)""")
def translation_upsert(spark, sf_dir):
    fresh = table(spark, sf_dir, "documents").where("doc_id % 3 <> 0").select("doc_id", F.when(F.col("doc_id") % 4 == 0, None).otherwise(F.col("lang")).alias("text"))
    return records.upsert(stored(spark, sf_dir), fresh, ["doc_id"])


@query("set03_missing_ids", "with d as (select source, list(doc_id order by doc_id) as ids from documents group by source), l as (select source, list(d.doc_id order by d.doc_id) as have from documents d join labels l on d.doc_id = l.doc_id group by source) select d.source, list_filter(ids, lambda x: not list_contains(coalesce(have, []), x)) as missing from d left join l using (source)")
def missing_ids(spark, sf_dir):
    """Ids of a page that its store lacks."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    have = table(spark, sf_dir, "labels").select("doc_id").distinct()
    missing = d.join(have, "doc_id", "left_anti").groupBy("source").agg(F.sort_array(F.collect_list("doc_id")).alias("missing"))
    return d.select("source").distinct().join(missing, "source", "left").select("source", F.coalesce("missing", F.array().cast("array<bigint>")).alias("missing"))


@query("set04_placed_hashes", "select distinct source as job, sha256(text) as page_hash from documents")
def placed_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("source").alias("job"), F.sha2("text", 256).alias("page_hash")).distinct()


@query("set05_delete_job", "with r as (select distinct sha256(text) as page, source as job from documents) select page, count(*) filter (job = 'src3') > 0 as touched, count(*) filter (job <> 'src3') = 0 as removed from r group by page")
def delete_job(spark, sf_dir):
    """A job's references go; pages left without any go as well."""
    refs = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("page"), F.col("source").alias("job")).distinct()
    return refs.groupBy("page").agg((F.count_if(F.col("job") == "src3") > 0).alias("touched"), (F.count_if(F.col("job") != "src3") == 0).alias("removed"))


@query("set06_null_presence", f"with {STORED} select d.source, bool_or(s.doc_id is not null and s.text is null and not s.edited) as holds from documents d left join stored s on d.doc_id = s.doc_id group by d.source")
def null_presence(spark, sf_dir):
    s = stored(spark, sf_dir).select("doc_id", (F.col("text").isNull() & ~F.col("edited")).alias("blank"))
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(s, "doc_id", "left").groupBy("source").agg(F.bool_or(F.coalesce("blank", F.lit(False))).alias("holds"))


@query("set07_clear_cache", "with p as (select sha256(text) as page, bool_or(source in ('src1', 'src2')) as held from documents group by 1) select held, count(*) as pages from p group by held")
def clear_cache(spark, sf_dir):
    """Everything goes but the pages that a running job holds."""
    pages = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("page")).agg(F.bool_or(F.col("source").isin("src1", "src2")).alias("held"))
    return pages.groupBy("held").agg(F.count("*").alias("pages"))


@query("pix01_content_key", "select doc_id, sha256('RGB|' || n_chars || 'x' || strlen(text) || '|' || text) as key from documents")
def content_key(spark, sf_dir):
    """Digest of mode, size and pixels."""
    prefix = F.concat(F.lit("RGB|"), F.col("n_chars").cast("string"), F.lit("x"), F.octet_length("text").cast("string"), F.lit("|"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.concat(F.encode(prefix, "utf-8"), F.encode("text", "utf-8")), 256).alias("key"))
