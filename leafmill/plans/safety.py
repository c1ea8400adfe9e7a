"""Queries of SURVEY section 2.11: the archive safety budget."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafmill.operators import safety
from leafmill.plans.registry import query
from leafmill.plans.standins import MEMBERS, members, table

_NAME = r"case page_id % 9 when 0 then '../' || member when 1 then '/' || member when 2 then 'C:' || member when 3 then 'a/../' || member when 4 then '..\x' else member end"
_M = rf"{MEMBERS}, m as (select substr(item, 1, 4) as item, page_id, {_NAME} as name, page_id % 11 = 5 as link, bytes from members), p as (select *, replace(name, '\', '/') as path, row_number() over (partition by item order by page_id) as position from m)"
_RULE = "case when position > 8 then 'member-count' when link then 'link-entry' when path like '/%' then 'absolute-path' when length(path) > 1 and substr(path, 2, 1) = ':' then 'drive-letter' when list_contains(string_split(path, '/'), '..') then 'parent-traversal' end"


def named(spark, sf_dir):
    name = F.expr(_NAME.replace("\\x", "\\\\x"))
    m = members(spark, sf_dir).select(F.substring("item", 1, 4).alias("item"), "page_id", name.alias("name"), (F.col("page_id") % 11 == 5).alias("link"), "bytes")
    return m.withColumn("position", F.row_number().over(Window.partitionBy("item").orderBy("page_id")))


def _reasons(spark, sf_dir):
    return named(spark, sf_dir).withColumn("reason", safety.member_reason(F.col("name"), F.col("position"), F.col("link"), 8))


@query("saf01_member_rules", f"with {_M}, r as (select item, position, {_RULE} as reason from p) select item, arg_min(reason, position) filter (reason is not null) as reason, count(*) filter (reason is not null) > 0 as refused from r group by item")
def member_rules(spark, sf_dir):
    """An item is refused for the first member that a rule refuses."""
    return safety.refuse(_reasons(spark, sf_dir))


_B = f"{MEMBERS}, b as (select substr(item, 1, 4) as item, page_id as position, bytes, bytes // (page_id % 6 * 40) as compressed from members), t as (select *, sum(bytes) over (partition by item order by position) as total from b)"


def _bytes(spark, sf_dir):
    return members(spark, sf_dir).select(F.substring("item", 1, 4).alias("item"), F.col("page_id").alias("position"), "bytes", F.expr("bytes div nullif(page_id % 6 * 40, 0)").alias("compressed"))


@query("saf02_byte_caps", f"with {_B.replace('(page_id % 6 * 40)', 'nullif(page_id % 6 * 40, 0)')} select item, position, total::bigint as total, case when bytes > 6000 then 'file-size-cap' when total > 60000 then 'total-size-cap' end as reason from t")
def byte_caps(spark, sf_dir):
    return safety.byte_reason(_bytes(spark, sf_dir), 6000, 60_000, 1 << 60).select("item", "position", "total", "reason")


@query("saf03_ratio_rule", f"with {_B.replace('(page_id % 6 * 40)', 'nullif(page_id % 6 * 40, 0)')} select item, position, compressed > 0 and bytes >= 2000 and bytes::double / compressed > 100 as refused from t")
def ratio_rule(spark, sf_dir):
    """A member of some size that was compressed too well."""
    r = safety.byte_reason(_bytes(spark, sf_dir), 1 << 60, 1 << 60, 100, 2000)
    return r.select("item", "position", F.when(F.col("compressed").isNotNull() | (F.col("bytes") < 2000), F.col("reason").isNotNull()).alias("refused"))


@query("saf04_container_ratio", f"with {MEMBERS}, c as (select substr(item, 1, 4) as item, page_id, sum(bytes) over (partition by substr(item, 1, 4) order by page_id) as total from members) select item, min(page_id) filter (total > 5000 and total / 40.0 > 200) as stopped_at from c group by item")
def container_ratio(spark, sf_dir):
    """The first chunk at which a container's stream is too large for its file."""
    total = F.sum("bytes").over(Window.partitionBy("item").orderBy("page_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    c = members(spark, sf_dir).select(F.substring("item", 1, 4).alias("item"), "page_id", "bytes").withColumn("total", total)
    return c.groupBy("item").agg(F.min(F.when((F.col("total") > 5000) & (F.col("total") / 40 > 200), F.col("page_id"))).alias("stopped_at"))


@query("saf05_decoded_size", "select p_partkey, (p_size * 1000)::bigint * (p_partkey % 100 * 100) * 4 > 134217728 as refused from part")
def decoded_size(spark, sf_dir):
    """Width by height by four against the cap, before anything is decoded."""
    return table(spark, sf_dir, "part").select("p_partkey", ((F.col("p_size") * 1000).cast("bigint") * (F.col("p_partkey") % 100 * 100) * 4 > safety.MAX_FILE).alias("refused"))


@query("saf06_escape", f"with {_M} select item, page_id, path like '/%' or substr(path, 2, 1) = ':' or (path like '../%') as escapes from p")
def escape(spark, sf_dir):
    return named(spark, sf_dir).select("item", "page_id", safety.depth_escapes(F.col("name")).alias("escapes"))


@query("saf07_not_enforced", f"with {_M}, r as (select item, position, {_RULE} as reason from p) select item, arg_min(reason, position) filter (reason is not null) as reason, false as refused from r group by item")
def not_enforced(spark, sf_dir):
    return safety.refuse(_reasons(spark, sf_dir), enforce=False)


@query("saf08_discard_refused", f"with {_M}, r as (select item, count(*) filter ({_RULE} is not null) > 0 as refused from p group by item) select page_id from p join r using (item) where not refused")
def discard_refused(spark, sf_dir):
    """Outputs of refused items go."""
    bad = safety.refuse(_reasons(spark, sf_dir)).where("refused").select("item")
    return named(spark, sf_dir).join(bad, "item", "left_anti").select("page_id")
