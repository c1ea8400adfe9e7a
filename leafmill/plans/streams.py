"""Queries of SURVEY section 2.14: streams run to their end over the events' file."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.plans.registry import query
from leafmill.streaming import progress


@query("str01_progress_stream", "select user_id as item, event_id % 8 as page, event_type as stage, event_id from events")
def progress_stream(spark, sf_dir):
    return progress.drain(progress.events(spark, sf_dir).drop("ts"), "append").select("item", "page", "stage", "event_id")


@query("str02_debounce_stream", """with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 30 minute then 0 else 1 end as new from events), g as (select user_id, ts, sum(new) over (partition by user_id order by ts rows between unbounded preceding and current row) as run from e)
  select user_id as item, count(*) as edits, epoch_us(max(ts))::bigint as last_us from g group by user_id, run""")
def debounce_stream(spark, sf_dir):
    """In complete mode, so that the newest sessions are not held back by the watermark."""
    return progress.drain(progress.debounced(progress.events(spark, sf_dir)), "complete").select("item", "edits", F.unix_micros("last").alias("last_us"))


@query("str03_front_page_state", """with l as (select user_id as item, event_id % 8 as page, event_type as stage from events qualify row_number() over (partition by user_id, event_id % 8 order by event_id desc) = 1),
  o as (select * from l where stage <> 'purchase' qualify row_number() over (partition by item order by page) = 1)
  select item, coalesce(page, -1) as page, coalesce(stage, '') as stage from (select distinct item from l) left join o using (item)""")
def front_page_state(spark, sf_dir):
    return progress.drain(progress.front_pages(progress.events(spark, sf_dir)), "update")


@query("str04_running_items", "select user_id as item, sum(case when event_id % 2 = 0 then 1 else -1 end)::bigint as running from events group by 1")
def running_items(spark, sf_dir):
    return progress.drain(progress.running(progress.events(spark, sf_dir)), "complete")


@query("str05_page_counter", "select user_id as item, count(*) as written from events where event_type = 'purchase' group by 1")
def page_counter(spark, sf_dir):
    return progress.drain(progress.counted(progress.events(spark, sf_dir)), "complete")
