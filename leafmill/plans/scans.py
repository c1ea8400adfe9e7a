"""Queries of SURVEY section 2.1: scans, classification, container facts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafmill.functions import names
from leafmill.plans.registry import query
from leafmill.plans.standins import MEMBERS, members, table

#: DuckDB macros of the name functions, for the twins.
NAT = r"""list_transform(string_split(replace({p}, '\', '/'), '/'), lambda seg: list_transform(regexp_extract_all(seg, '[0-9]+|[^0-9]+'), lambda t:
  case when regexp_matches(t, '^[0-9]') then struct_pack(k := 0, n := coalesce(try_cast(t as hugeint), 0::hugeint), s := '') else struct_pack(k := 1, n := 0::hugeint, s := lower(t)) end))"""
EXT = r"regexp_extract({n}, '^\.*[^.].*?(\.[^.]*)$', 1)"
BASE = r"list_extract(string_split(replace({p}, '\', '/'), '/'), -1)"
#: Names of several kinds, made of the members' own.
NAMES = ".cbz .PDF .png .cb7 .txt .Tar .jpeg .rar .gif".split()


def named(spark, sf_dir):
    """Members with an ending that depends on the id, and a folder that depends on it as well."""
    ends = F.array(*map(F.lit, NAMES))
    return members(spark, sf_dir).withColumn("name", F.concat("member", F.get(ends, F.col("page_id") % len(NAMES))))


NAMED = f"{MEMBERS}, named as (select *, member || list_extract({NAMES!r}, cast(page_id % {len(NAMES)} as int) + 1) as name from members)"


@query("src01_directory_scan", f"""with {NAMED}, f as (select page_id, item, {BASE.format(p='name')} as file from named)
  select page_id, item, file, row_number() over (partition by item order by {NAT.format(p='file')}, file, page_id) as place
  from f where file not like '.%' and file not like '%.tmp'""")
def directory_scan(spark, sf_dir):
    files = named(spark, sf_dir).select("page_id", "item", names.basename(F.col("name")).alias("file"))
    files = files.where(~F.col("file").startswith(".") & ~F.col("file").endswith(".tmp"))
    order = Window.partitionBy("item").orderBy(names.natural_key(F.col("file")), "file", "page_id")
    return files.withColumn("place", F.row_number().over(order).cast("long"))


@query("src02_classify", f"""with {NAMED}, f as (select page_id, name, lower({EXT.format(n=BASE.format(p='name'))}) as ext from named),
  k as (select *, case when ext in {tuple(names.ARCHIVE_SUFFIXES)} then 'archive' when ext = '.pdf' then 'pdf' when ext in {tuple(names.IMAGE_SUFFIXES)} then 'image' else 'unsupported' end as kind from f)
  select page_id, kind, case when kind = 'unsupported' then 'skipped' else 'pending' end as status, case when kind = 'unsupported' then 'unsupported file type ' || case ext when '' then '(none)' else ext end end as reason from k""")
def classify(spark, sf_dir):
    base = names.basename(F.col("name"))
    kind = names.kind(base)
    return named(spark, sf_dir).select("page_id", kind.alias("kind"), F.when(kind == "unsupported", "skipped").otherwise("pending").alias("status"), names.unsupported_reason(base).alias("reason"))


@query("src03_extension_tests", f"""with {NAMED}, f as (select page_id, name, {BASE.format(p='name')} as base from named)
  select page_id, case lower({EXT.format(n='base')}) {' '.join(f"when '{k}' then '{v}'" for k, v in names.FAMILIES.items())} end as family, lower({EXT.format(n='base')}) = '.pdf' as pdf,
  not (name like '%/' or name like '\\_\\_MACOSX/%' escape '\\' or base like '.\\_%' escape '\\' or base = 'Thumbs.db') and lower({EXT.format(n='base')}) in {tuple(names.PAGE_SUFFIXES)} as page from f""")
def extension_tests(spark, sf_dir):
    base = names.basename(F.col("name"))
    return named(spark, sf_dir).select("page_id", names.family(base).alias("family"), (F.lower(names.extension(base)) == ".pdf").alias("pdf"), names.is_page(F.col("name")).alias("page"))


@query("src12_page_stream", f"""with {NAMED} select page_id, item, name, row_number() over (partition by item order by {NAT.format(p='name')}, name, page_id) as ordinal
  from named where lower({EXT.format(n=BASE.format(p='name'))}) in {tuple(names.PAGE_SUFFIXES)} and bytes % 3 <> 0""")
def page_stream(spark, sf_dir):
    """Ordinals count the pages that decode, without holes."""
    pages = named(spark, sf_dir).where(names.is_page(F.col("name")) & (F.col("bytes") % 3 != 0))
    order = Window.partitionBy("item").orderBy(names.natural_key(F.col("name")), "name", "page_id")
    return pages.select("page_id", "item", "name", F.row_number().over(order).cast("long").alias("ordinal"))


@query("src13_readonly_stream", f"""with {NAMED} select page_id, item, name, row_number() over (partition by item order by {NAT.format(p='name')}, name, page_id) as ordinal
  from named where lower({EXT.format(n=BASE.format(p='name'))}) in {tuple(names.PAGE_SUFFIXES)}""")
def readonly_stream(spark, sf_dir):
    """The same without budget and decoding: every candidate."""
    order = Window.partitionBy("item").orderBy(names.natural_key(F.col("name")), "name", "page_id")
    return named(spark, sf_dir).where(names.is_page(F.col("name"))).select("page_id", "item", "name", F.row_number().over(order).cast("long").alias("ordinal"))


@query("src14_expected_pages", f"""with {NAMED} select item, case when count(*) % 5 <> 4 then count(*) filter (lower({EXT.format(n=BASE.format(p='name'))}) in {tuple(names.PAGE_SUFFIXES)}) end as expected from named group by item""")
def expected_pages(spark, sf_dir):
    """Candidates of an item; unknown (null) where the listing would need the whole stream."""
    return named(spark, sf_dir).groupBy("item").agg(F.when(F.count("*") % 5 != 4, F.count_if(names.is_page(F.col("name")))).alias("expected"))


_PDF = "l_orderkey % 100 as chars, l_linenumber % 3 as images, l_discount * 10 as cover, l_partkey % 4 as turn, l_suppkey % 3 as filter"


@query("src15_pdf_scan_rule", f"""with p as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, {_PDF} from lineitem)
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when chars < 50 and images = 1 and cover > 0.5 then 'xobject' else 'render' end as source from p""")
def pdf_scan_rule(spark, sf_dir):
    facts = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *_PDF.split(", "))
    return facts.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when((F.col("chars") < 50) & (F.col("images") == 1) & (F.col("cover") > 0.5), "xobject").otherwise("render").alias("source"))


@query("src16_pdf_tiers", f"""with p as (select {_PDF} from lineitem) select case when turn = 3 then 'render' when filter = 0 then 'jpeg' else 'bitmap' end as tier, count(*) as pages from p group by 1""")
def pdf_tiers(spark, sf_dir):
    """Rotated images are rendered; aligned ones keep their JPEG stream or their bitmap."""
    facts = table(spark, sf_dir, "lineitem").selectExpr(*_PDF.split(", "))
    return facts.groupBy(F.when(F.col("turn") == 3, "render").when(F.col("filter") == 0, "jpeg").otherwise("bitmap").alias("tier")).agg(F.count("*").alias("pages"))


@query("src17_pdf_layout", """select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_partkey % 4 in (1, 3) then 842 else 595 end as width, case when l_partkey % 4 in (1, 3) then 595 else 842 end as height,
  case when l_partkey % 4 in (1, 3) then l_linenumber * 40 else l_linenumber * 30 end as image_width from lineitem""")
def pdf_layout(spark, sf_dir):
    """Displayed boxes in points: width and height change places for a quarter turn."""
    turned = (F.col("l_partkey") % 4).isin(1, 3)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(turned, 842).otherwise(595).alias("width"), F.when(turned, 595).otherwise(842).alias("height"), F.when(turned, F.col("l_linenumber") * 40).otherwise(F.col("l_linenumber") * 30).alias("image_width")
    )


_INFO = "case when page_id % 4 = 0 then 'x/' || 'ComicInfo.XML' when page_id % 4 = 1 then 'credits.txt' else member || '.png' end"


@query("src18_comicinfo_pick", f"""with {MEMBERS}, m as (select page_id, substr(item, 1, 5) as item, {_INFO} as member from members)
  select item, member, page_id from m where lower({BASE.format(p='member')}) = 'comicinfo.xml' qualify row_number() over (partition by item order by {NAT.format(p='member')}, member, page_id) = 1""")
def comicinfo_pick(spark, sf_dir):
    found = members(spark, sf_dir).select("page_id", F.substring("item", 1, 5).alias("item"), F.expr(_INFO).alias("member")).where(names.is_comicinfo(F.col("member")))
    first = F.struct(names.natural_key(F.col("member")).alias("k"), "member", "page_id")
    return found.groupBy("item").agg(F.min(first).alias("f")).select("item", "f.member", "f.page_id")


@query("src19_repack_extras", f"""with {MEMBERS}, m as (select page_id, substr(item, 1, 5) as item, {_INFO} as member from members),
  p as (select item, page_id from m where lower({BASE.format(p='member')}) = 'comicinfo.xml' qualify row_number() over (partition by item order by {NAT.format(p='member')}, member, page_id) = 1)
  select m.item, m.page_id, member, p.page_id is not null as info from m left join p on m.item = p.item and m.page_id = p.page_id
  where lower({EXT.format(n=BASE.format(p='member'))}) not in {tuple(names.PAGE_SUFFIXES)} and (p.page_id is not null or lower({BASE.format(p='member')}) <> 'comicinfo.xml')""")
def repack_extras(spark, sf_dir):
    """The chosen info file and every other member that is no page, admitted in one pass."""
    found = members(spark, sf_dir).select("page_id", F.substring("item", 1, 5).alias("item"), F.expr(_INFO).alias("member"))
    order = Window.partitionBy("item", names.is_comicinfo(F.col("member"))).orderBy(names.natural_key(F.col("member")), "member", "page_id")
    found = found.withColumn("info", names.is_comicinfo(F.col("member")) & (F.row_number().over(order) == 1))
    return found.where(~names.is_page(F.col("member")) & (F.col("info") | ~names.is_comicinfo(F.col("member")))).select("item", "page_id", "member", "info")


@query("src20_model_list", """with e as (select event_id, '[{"id":"' || event_type || '","owned_by":"' || user_id || '"},{"owned_by":"x"},{"id":"k","owned_by":' || json_extract_string(props, '$.k') || '}]' as body from events)
  select event_id, 0::int as place, event_type as id, cast(user_id as varchar) as owned_by from events union all select event_id, 2, 'k', '' from events""")
def model_list(spark, sf_dir):
    """Rows of a provider's list: entries without a name go, an owner that is no text is empty, the order stays."""
    body = F.concat(F.lit('[{"id":"'), "event_type", F.lit('","owned_by":"'), F.col("user_id").cast("string"), F.lit('"},{"owned_by":"x"},{"id":"k","owned_by":'), F.get_json_object("props", "$.k"), F.lit("}]"))
    rows = table(spark, sf_dir, "events").select("event_id", F.posexplode(F.from_json(body, "array<struct<id:string,owned_by:variant>>")).alias("place", "m"))
    owner = F.when(F.schema_of_variant("m.owned_by") == "STRING", F.try_variant_get("m.owned_by", "$", "string"))
    return rows.where("m.id is not null").select("event_id", "place", "m.id", F.coalesce(owner, F.lit("")).alias("owned_by"))


@query("src21_event_lines", """select event_id, case when event_id % 3 = 0 then 'log' else 'progress' end as kind, case when event_id % 3 <> 0 then event_type end as stage, case when event_id % 3 <> 0 then cast(event_id % 8 as int) end as page from events where event_id % 5 <> 0""")
def event_lines(spark, sf_dir):
    """A line is a progress event if it parses as one, else a log line; blank ones go."""
    good = F.to_json(F.struct(F.col("event_type").alias("stage"), (F.col("event_id") % 8).alias("page")))
    line = F.when(F.col("event_id") % 5 == 0, " ").when(F.col("event_id") % 3 == 0, "loading model").otherwise(good)
    lines = table(spark, sf_dir, "events").select("event_id", line.alias("line")).where(F.trim("line") != "")
    parsed = lines.withColumn("e", F.from_json("line", "stage string, page int", {"mode": "PERMISSIVE"}))
    return parsed.select("event_id", F.when(F.col("e.stage").isNotNull(), "progress").otherwise("log").alias("kind"), "e.stage", "e.page")
