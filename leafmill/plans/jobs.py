"""Queries of SURVEY section 2.13: pipeline, cache policy, job control."""

from __future__ import annotations


from pyspark.sql import functions as F

from leafmill.functions import text
from leafmill.plans.filters import _STATUS
from leafmill.plans.records import _APPLIED, _applied
from leafmill.plans.registry import query
from leafmill.plans.standins import table

# The stages and the share of a page that each completes.
STAGES = {"detect": 10, "ocr": 25, "translate": 50, "inpaint": 65, "render": 80, "encode": 90, "write": 100}
_STAGE_LIST = "[" + ", ".join(f"'{s}'" for s in STAGES) + "]"
_PCT_LIST = "[" + ", ".join(str(p) for p in STAGES.values()) + "]"


@query("pip01_stage_events", f"select doc_id, unnest(range(1, 8))::int as place, unnest({_STAGE_LIST}) as stage, unnest({_PCT_LIST})::int as pct from documents")
def stage_events(spark, sf_dir):
    """One event per stage of a page, in order, with rising shares."""
    events = F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(p).alias("pct")) for s, p in STAGES.items()])
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(events).alias("p", "e")).select("doc_id", (F.col("p") + 1).alias("place"), "e.stage", "e.pct")


@query("pip02_ocr_routing")
def ocr_routing(spark, sf_dir):
    """Japanese regions are read whole, others line by line and joined; the recogniser is a function given by the caller (here: upper case)."""
    from leafmill.engine import Engine

    regions = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "ja").when(F.col("doc_id") % 3 == 1, "zh").otherwise("ko").alias("source"), F.split("text", "\n").alias("parts"))
    return Engine(spark, recognise=F.upper).read_regions(regions)


@query("pip03_translate_offline", f"with {_APPLIED} select doc_id, state, case when state = 'missing' then 'HELLO' when state in ('translated', 'edited') then stored_text end as translation from applied")
def translate_offline(spark, sf_dir):
    """Only what is missing and not set aside is sent; the offline client answers HELLO."""
    a = _applied(spark, sf_dir)
    return a.select("doc_id", "state", F.when(F.col("state") == "missing", "HELLO").when(F.col("state").isin("translated", "edited"), F.col("stored_text")).alias("translation"))


@query("pip04_retry_once", f"with s as (select event_id, {_STATUS} as status from events) select event_id, case when status in (0, 408, 429) or status >= 500 then 2 else 1 end::int as tries, case when status = 200 or ((status in (0, 408, 429) or status >= 500) and event_id % 2 = 0) then 'ok' else 'failed' end as outcome from s")
def retry_once(spark, sf_dir):
    """A transient outcome is tried once more; what a try gives is a column here (even ids recover)."""
    status = F.get(F.array(*map(F.lit, [0, 200, 400, 401, 408, 429, 500, 503])), F.col("event_id") % 8)
    s = table(spark, sf_dir, "events").select("event_id", status.alias("status"))
    again = text.is_transient(F.col("status")) & (F.col("status") != 200)
    return s.select("event_id", F.when(again, 2).otherwise(1).alias("tries"), F.when((F.col("status") == 200) | (again & (F.col("event_id") % 2 == 0)), "ok").otherwise("failed").alias("outcome"))


@query("pip05_cache_hit", "select d.doc_id, case when l.doc_id is null then 'miss' when l.quality = 0 then 'recheck' when d.lang <> 'en' then 'miss' else 'hit' end as decision from documents d left join labels l on d.doc_id = l.doc_id")
def cache_hit(spark, sf_dir):
    """A hit needs record and raster of the same source language; a legacy record is checked again."""
    known = table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(True).alias("found"))
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(known, "doc_id", "left")
    return d.select("doc_id", F.when(F.col("found").isNull(), "miss").when(F.col("quality") == 0, "recheck").when(F.col("lang") != "en", "miss").otherwise("hit").alias("decision"))


@query("pip06_content_projection", "select d.doc_id, lang as source, case when toxic = 1 and quality = 0 then null else text end as text from documents d left join labels l on d.doc_id = l.doc_id")
def content_projection(spark, sf_dir):
    """Only content is kept of a record, and no null that the vision model gave."""
    known = table(spark, sf_dir, "labels").select("doc_id", "toxic", "quality")
    gone = F.coalesce((F.col("toxic") == 1) & (F.col("quality") == 0), F.lit(False))
    return table(spark, sf_dir, "documents").join(known, "doc_id", "left").select("doc_id", F.col("lang").alias("source"), F.when(~gone, F.col("text")).alias("text"))


@query("pip07_bounded_concurrency")
def bounded_concurrency(spark, sf_dir):
    """Provider calls run in three tasks at most, however large the input: a rate cap is a number of partitions."""
    calls = table(spark, sf_dir, "events").select("event_id").repartition(3, "event_id")
    return calls.select("event_id", F.spark_partition_id().alias("slot"))


@query("pip08_error_boundary", "select o_orderkey, case o_orderkey % 4 when 0 then 'ok' when 1 then 'failed' when 2 then 'skipped' else 'cancelled' end as status, case o_orderkey % 4 when 0 then null when 1 then 'detect: ' || o_orderpriority when 2 then 'unsupported file type' else 'cancelled by user' end as reason from orders")
def error_boundary(spark, sf_dir):
    """Every item ends with a status, and with a reason unless it is ok."""
    k = F.col("o_orderkey") % 4
    status = F.get(F.array(*map(F.lit, ["ok", "failed", "skipped", "cancelled"])), k)
    reason = F.when(k == 1, F.concat(F.lit("detect: "), "o_orderpriority")).when(k == 2, "unsupported file type").when(k == 3, "cancelled by user")
    return table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"), reason.alias("reason"))


@query("pip09_cancel_boundary", "with e as (select user_id, count(*) filter (event_id < 600) as delivered, min(event_id % 8) filter (event_type = 'error') as first_error from events group by user_id) select user_id, delivered, case when first_error is not null then 'failed on page ' || first_error else 'cancelled' end as outcome from e")
def cancel_boundary(spark, sf_dir):
    """Pages delivered before a cancel count; the earliest page's error names the outcome."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_id") < 600).alias("delivered"), F.min(F.when(F.col("event_type") == "error", F.col("event_id") % 8)).alias("first_error"))
    return e.select("user_id", "delivered", F.when(F.col("first_error").isNotNull(), F.concat(F.lit("failed on page "), F.col("first_error").cast("string"))).otherwise("cancelled").alias("outcome"))


@query("pip11_debounce", """with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 30 minute then 0 else 1 end as new from events), g as (select user_id, ts, sum(new) over (partition by user_id order by ts rows between unbounded preceding and current row) as run from e)
  select user_id, count(*) as edits, epoch_us(max(ts))::bigint as last_us from g group by user_id, run""")
def debounce(spark, sf_dir):
    """Edits that follow each other closely make one rebuild (a session window; gap of 30 minutes in the stand-in data)."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return e.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("edits"), F.max("ts").alias("m")).select("user_id", "edits", F.unix_micros("m").alias("last_us"))


@query("pip12_running_refs", "select user_id as job, sum(case when event_id % 2 = 0 then 1 else -1 end)::bigint as running, sum(case when event_id % 2 = 0 then 1 else -1 end) < 0 as stale from events group by user_id")
def running_refs(spark, sf_dir):
    running = F.sum(F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1))
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("job")).agg(running.alias("running"), (running < 0).alias("stale"))


@query("pip13_vision_latch", f"""with s as (select user_id as client, event_id, {_STATUS} as status, event_id % 5 = 0 as wrong from events), v as (select client, event_id, case when status = 200 and not wrong then 'vision' when status in (400, 413, 415, 422) or (status = 200 and wrong) then 'text only' end as latch from s)
  select client, arg_min(latch, event_id) filter (latch is not null) as latch from v group by client""")
def vision_latch(spark, sf_dir):
    """The first answer that settles it is latched: a right token, a refusal of the image, or a wrong token; others are not."""
    status = F.get(F.array(*map(F.lit, [0, 200, 400, 401, 408, 429, 500, 503])), F.col("event_id") % 8)
    wrong = F.col("event_id") % 5 == 0
    latch = F.when((status == 200) & ~wrong, "vision").when(status.isin(400, 413, 415, 422) | ((status == 200) & wrong), "text only")
    v = table(spark, sf_dir, "events").select(F.col("user_id").alias("client"), "event_id", latch.alias("latch"))
    return v.groupBy("client").agg(F.min_by("latch", F.when(F.col("latch").isNotNull(), F.col("event_id"))).alias("latch"))


@query("pip16_null_recheck", "select d.doc_id, coalesce(l.toxic = 1 and l.quality = 0 and d.lang = 'en', false) as recheck from documents d left join labels l on d.doc_id = l.doc_id")
def null_recheck(spark, sf_dir):
    """A blind null is asked again once the client sees the page, unless it was boxed or set aside before."""
    known = table(spark, sf_dir, "labels").select("doc_id", "toxic", "quality")
    again = (F.col("toxic") == 1) & (F.col("quality") == 0) & (F.col("lang") == "en")
    return table(spark, sf_dir, "documents").join(known, "doc_id", "left").select("doc_id", F.coalesce(again, F.lit(False)).alias("recheck"))


@query("pip18_access_log", "select event_id % 100 as page, epoch_us(max(ts))::bigint as last_us, count(*) filter (try_cast(json_extract_string(props, '$.k') as int) is null) as unreadable from events group by 1")
def access_log(spark, sf_dir):
    """Last use of each record from an append-only log; a record that does not parse is absent."""
    ok = F.from_json("props", "k int")["k"]
    return table(spark, sf_dir, "events").groupBy((F.col("event_id") % 100).alias("page")).agg(F.unix_micros(F.max(F.col("ts").cast("timestamp"))).alias("last_us"), F.count_if(ok.isNull()).alias("unreadable"))


@query("pip19_references", "select sha256(text) as page, list(distinct source order by source) as jobs from documents group by 1")
def references(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("page")).agg(F.sort_array(F.collect_set("source")).alias("jobs"))


@query("pip20_raster_write", "with n as (select source, 'clean-' || (doc_id % 3) || '.png' as name from documents) select source, list(distinct name order by name) filter (name <> 'clean-1.png') as retired from n group by source")
def raster_write(spark, sf_dir):
    """Names that a newly written raster retires: the others of its page."""
    n = table(spark, sf_dir, "documents").select("source", F.concat(F.lit("clean-"), (F.col("doc_id") % 3).cast("string"), F.lit(".png")).alias("name"))
    names = F.sort_array(F.collect_set(F.when(F.col("name") != "clean-1.png", F.col("name"))))
    return n.groupBy("source").agg(names.alias("retired")).withColumn("retired", F.when(F.size("retired") > 0, F.col("retired")))


@query("pip21_placement_key", "select page_id, url || chr(31) || page_id as key, url as item, page_id::int as ordinal from pages")
def placement_key(spark, sf_dir):
    """Key of item and ordinal, parsed back from the right."""
    key = F.concat("url", F.lit("\x1f"), F.col("page_id").cast("string"))
    k = table(spark, sf_dir, "pages").select("page_id", key.alias("key"))
    ordinal = F.substring_index("key", "\x1f", -1)
    return k.select("page_id", "key", F.substring(F.col("key"), F.lit(1), F.length("key") - F.length(ordinal) - 1).alias("item"), ordinal.cast("int").alias("ordinal"))


@query("pip22_transport_errors", "select event_id, case event_type when 'click' then 0 when 'view' then 0 when 'error' then 500 else 200 end::int as status, case when event_type in ('click', 'view') then 'transport' when event_type = 'error' then props else 'settings' end as body from events")
def transport_errors(spark, sf_dir):
    """Timeouts and resets are status 0; an HTTP error keeps its status and body; a malformed address is a settings error."""
    t = F.col("event_type")
    return table(spark, sf_dir, "events").select("event_id", F.when(t.isin("click", "view"), 0).when(t == "error", 500).otherwise(200).alias("status"), F.when(t.isin("click", "view"), "transport").when(t == "error", F.col("props")).otherwise("settings").alias("body"))


@query("pip23_model_id", "select p_partkey, coalesce(nullif(case when p_partkey % 2 = 0 then p_brand else '' end, ''), 'offline') as model from part")
def model_id(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(F.nullif(F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(""), F.lit("")), F.lit("offline")).alias("model"))


@query("pip10_rerender")
def rerender(spark, sf_dir):
    """One region's edit is laid over the stored translations, and its page is set again without detection."""
    from leafmill.engine import Engine

    return Engine(spark).rerender(_applied(spark, sf_dir).withColumnRenamed("source", "page"), "src3", 3, "edited text")


@query("pip24_item_driver")
def item_driver(spark, sf_dir):
    """A whole offline run: classify, budget, pages, regions, translation, fit and status, per item."""
    from leafmill.engine import Engine

    return Engine(spark).run_job(sf_dir)
