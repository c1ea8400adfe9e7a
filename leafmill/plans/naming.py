"""Queries of SURVEY section 2.2: output names, order of delivery, encode policy."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafmill.functions import names, text
from leafmill.plans.registry import query
from leafmill.plans.scans import BASE, EXT, NAMED, NAT, named
from leafmill.plans.standins import MEMBERS, members, table

_ODD = "case when page_id % 3 = 0 then replace(member, 'e', '<') when page_id % 3 = 1 then member || '. .png' else '../' || member || '.jpg' end"
_ODDS = f"{MEMBERS}, odd as (select page_id, item, {_ODD} as name from members)"
UNS = r"""[<>:"\\|?*\x00-\x1f]"""


def _safe(s: str) -> str:
    ext = EXT.format(n=s)
    stem = f"substr({s}, 1, length({s}) - length({ext}))"
    clean = lambda c: f"rtrim(regexp_replace({c}, '{UNS}', '_', 'g'), '. ')"
    return f"case when {clean(stem)} = {stem} and {clean(ext)} = {ext} and {clean(stem)} <> '' then {s} else (case when {clean(stem)} = '' then '_' else {clean(stem)} end) || '-' || substr(sha256({s}), 1, 8) || {clean(ext)} end"


def odd(spark, sf_dir):
    return members(spark, sf_dir).select("page_id", "item", F.expr(_ODD).alias("name"))


@query("snk03_encode_policy", """select ext, case when ext in ('jpg', 'jpeg') then 95 end as quality, case when ext in ('jpg', 'jpeg') then '4:4:4' end as sampling, ext = 'webp' and page_id % 2 = 0 as lossless, page_id % 5 <> 0 as keeps_profile, false as keeps_gps, page_id
  from (select page_id, list_extract(['jpg','png','webp','jpeg','bmp'], cast(page_id % 5 as int) + 1) as ext from pages)""")
def encode_policy(spark, sf_dir):
    """How a page is encoded again: the source's format, JPEG at 95 without subsampling, lossless stays lossless, no place data."""
    ext = F.get(F.array(*map(F.lit, ["jpg", "png", "webp", "jpeg", "bmp"])), F.col("page_id") % 5)
    jpeg = F.col("ext").isin("jpg", "jpeg")
    return table(spark, sf_dir, "pages").select("page_id", ext.alias("ext")).select(
        "ext", F.when(jpeg, 95).alias("quality"), F.when(jpeg, "4:4:4").alias("sampling"), ((F.col("ext") == "webp") & (F.col("page_id") % 2 == 0)).alias("lossless"), (F.col("page_id") % 5 != 0).alias("keeps_profile"), F.lit(False).alias("keeps_gps"), "page_id"
    )


@query("snk04_output_names", f"""with {NAMED}, f as (select page_id, {BASE.format(p='name')} as base from named), e as (select *, {EXT.format(n='base')} as ext from f),
  s as (select *, substr(base, 1, length(base) - length(ext)) as stem from e)
  select page_id, stem || '_translated' || ext as image, stem || '_translated' || case when lower(ext) in ('.cbr', '.rar') then '.cbz' when lower(ext) = '.pdf' then '.pdf' else ext end as container, 'p' || lpad(cast(page_id % 10000 as varchar), 4, '0') || case when page_id % 2 = 0 then '.jpg' else '.png' end as pdf_page from s""")
def output_names(spark, sf_dir):
    base = names.basename(F.col("name"))
    pdf_page = F.concat(F.lit("p"), F.lpad((F.col("page_id") % 10000).cast("string"), 4, "0"), F.when(F.col("page_id") % 2 == 0, ".jpg").otherwise(".png"))
    return named(spark, sf_dir).select("page_id", names.translated(base).alias("image"), names.delivered_container(base).alias("container"), pdf_page.alias("pdf_page"))


@query("snk05_safe_segment", f"with {_ODDS}, s as (select page_id, {BASE.format(p='name')} as seg from odd) select page_id, seg, {_safe('seg')} as safe from s")
def safe_segment(spark, sf_dir):
    return odd(spark, sf_dir).select("page_id", names.basename(F.col("name")).alias("seg")).withColumn("safe", names.safe_segment(F.col("seg")))


@query("snk06_member_destination", f"""with {_ODDS}, s as (select page_id, list_transform(list_filter(string_split(name, '/'), lambda x: x not in ('', '.', '..')), lambda x: {_safe('x')}) as segs from odd),
  l as (select page_id, segs, list_extract(segs, -1) as base from s), e as (select *, {EXT.format(n='base')} as ext from l)
  select page_id, case when len(segs) = 0 then 'page_translated.png' else array_to_string(list_append(segs[:-2], substr(base, 1, length(base) - length(ext)) || '_translated' || ext), '/') end as destination from e""")
def member_destination(spark, sf_dir):
    return odd(spark, sf_dir).select("page_id", names.member_destination(F.col("name")).alias("destination"))


@query("snk07_archive_order", f"""with {NAMED}, k as (select *, case when page_id % 7 = 0 then 0 when lower({EXT.format(n=BASE.format(p='name'))}) in {tuple(names.PAGE_SUFFIXES)} then 1 else 2 end as part from named)
  select item, page_id, row_number() over (partition by item order by part, {NAT.format(p='name')}, name, page_id) as place from k""")
def archive_order(spark, sf_dir):
    """Entries as written: the info file, pages in page order, then the rest."""
    part = F.when(F.col("page_id") % 7 == 0, 0).when(names.is_page(F.col("name")), 1).otherwise(2)
    order = Window.partitionBy("item").orderBy(part, names.natural_key(F.col("name")), "name", "page_id")
    return named(spark, sf_dir).select("item", "page_id", F.row_number().over(order).cast("long").alias("place"))


_XML = "case page_id % 4 when 0 then '<ComicInfo><LanguageISO>ja</LanguageISO><A/><LanguageISO>x</LanguageISO></ComicInfo>' when 1 then '<ComicInfo><LanguageISO /></ComicInfo>' when 2 then '<ComicInfo><Title>' || url || '</Title></ComicInfo>' else '<Other/>' end"


@query("snk08_language_rewrite", f"""with x as (select page_id, {_XML} as xml from pages) select page_id, case when regexp_matches(xml, '<LanguageISO(\\s[^>]*)?>[^<]*</LanguageISO\\s*>') then regexp_replace(xml, '(<LanguageISO(?:\\s[^>]*)?>)[^<]*(</LanguageISO\\s*>)', '\\1id\\2')
  when regexp_matches(xml, '<LanguageISO(\\s[^>]*)?/>') then regexp_replace(xml, '<LanguageISO(?:\\s[^>]*)?/>', '<LanguageISO>id</LanguageISO>')
  when regexp_matches(xml, '</ComicInfo\\s*>') then regexp_replace(xml, '(</ComicInfo\\s*>)', '  <LanguageISO>id</LanguageISO>' || chr(10) || '\\1') else xml end as xml from x""")
def language_rewrite(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.expr(_XML).alias("xml")).select("page_id", text.rewrite_language(F.col("xml"), F.lit("id")).alias("xml"))


@query("snk10_repack_join", f"""with {MEMBERS}, p as (select item, page_id, row_number() over (partition by item order by {NAT.format(p='member')}, page_id) as ordinal from members),
  o as (select page_id, 'out/' || page_id as output from pages where page_id % 6 <> 0)
  select item, count(*) as pages, count(o.output) as delivered, min(ordinal) filter (o.output is null) as missing, case when count(o.output) = count(*) then 'ok' else 'missing page' end as outcome from p left join o using (page_id) group by item""")
def repack_join(spark, sf_dir):
    """Placement joined with what was delivered: an item is rebuilt only from all its pages, else the first one missing is named."""
    order = Window.partitionBy("item").orderBy(names.natural_key(F.col("member")), "page_id")
    placement = members(spark, sf_dir).select("item", "page_id", F.row_number().over(order).cast("long").alias("ordinal"))
    outputs = table(spark, sf_dir, "pages").where("page_id % 6 <> 0").select("page_id", F.concat(F.lit("out/"), F.col("page_id").cast("string")).alias("output"))
    joined = placement.join(outputs, "page_id", "left").groupBy("item").agg(F.count("*").alias("pages"), F.count("output").alias("delivered"), F.min(F.when(F.col("output").isNull(), F.col("ordinal"))).alias("missing"))
    return joined.withColumn("outcome", F.when(F.col("delivered") == F.col("pages"), "ok").otherwise("missing page"))
