"""Queries of SURVEY sections 2.8 and 2.9: rollups, orders, eviction."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from leafmill.functions import names, text
from leafmill.llm.common import small_batches
from leafmill.operators import records
from leafmill.plans.registry import query
from leafmill.plans.scans import BASE, EXT, NAT
from leafmill.plans.standins import MEMBERS, members, table
from leafmill.plans.texts import CHRF_WORDS

_FLAGS = "l_returnflag = 'A' as compromised, l_returnflag = 'R' as failed, l_linestatus = 'F' and l_linenumber = 1 as again"


@query("agg01_fit_summary", f"""with f as (select l_orderkey, l_linenumber, l_quantity, l_suppkey, {_FLAGS} from lineitem)
  select l_orderkey, list_sort(list(l_linenumber) filter (compromised)) as compromised, list_sort(list(l_linenumber) filter (failed)) as failed, count(*) filter (compromised) as n_compromised, count(*) filter (failed) as n_failed, count(*) filter (again) as n_again, min(l_quantity) as min_font, sum(l_suppkey % 4)::bigint as clipped from f group by l_orderkey""")
def fit_summary(spark, sf_dir):
    """Ids of what was compromised and what failed, counts, the smallest font, clipped glyphs."""
    f = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_quantity", "l_suppkey", *_FLAGS.split(", "))
    ids = lambda c: F.sort_array(F.collect_list(F.when(F.col(c), F.col("l_linenumber"))))
    some = lambda a: F.when(F.size(a) > 0, a)
    out = f.groupBy("l_orderkey").agg(ids("compromised").alias("compromised"), ids("failed").alias("failed"), F.count_if("compromised").alias("n_compromised"), F.count_if("failed").alias("n_failed"), F.count_if("again").alias("n_again"), F.min("l_quantity").alias("min_font"), F.sum(F.col("l_suppkey") % 4).alias("clipped"))
    return out.withColumns({c: some(F.col(c)) for c in ("compromised", "failed")})


@query("agg02_job_status", "select o_custkey % 50 as job, count(*) as items, count(*) filter (o_orderstatus = 'F') as ok, count(*) filter (o_orderstatus = 'P') as failed, greatest(0, count(*) filter (o_orderstatus = 'O') - 4) as pending from orders group by 1")
def job_status(spark, sf_dir):
    n = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 50).alias("job")).agg(F.count("*").alias("items"), n("F").alias("ok"), n("P").alias("failed"), F.greatest(F.lit(0), n("O") - 4).alias("pending"))


@query("agg03_disambiguate", f"""with {MEMBERS}, n as (select page_id, item || '/' || member as path, substr({BASE.format(p='member')}, 1, 2) || '.png' as id from members), c as (select *, count(*) over (partition by id) as k from n)
  select page_id, case when k > 1 then substr(id, 1, length(id) - length({EXT.format(n='id')})) || '-' || substr(sha256(path), 1, 8) || {EXT.format(n='id')} else id end as item_id from c""")
def disambiguate(spark, sf_dir):
    """All items that share a name get a digest of their path: counts by name, joined back, so a very common name is not one window."""
    n = members(spark, sf_dir).select("page_id", F.concat("item", F.lit("/"), "member").alias("path"), F.concat(F.substring(names.basename(F.col("member")), 1, 2), F.lit(".png")).alias("id"))
    k = n.groupBy("id").agg(F.count("*").alias("k"))
    renamed = F.concat(names.stem(F.col("id")), F.lit("-"), F.substring(F.sha2("path", 256), 1, 8), names.extension(F.col("id")))
    return n.join(k, "id").select("page_id", F.when(F.col("k") > 1, renamed).otherwise(F.col("id")).alias("item_id"))


def _gram(kind: str, n: int, side: str) -> str:
    items = f"list_filter(string_split(replace({side}, ' ', ''), ''), lambda c: c <> '')" if kind == "c" else CHRF_WORDS.format(t=side)
    return f"select '{kind}{n}' as o, conv_id, unnest(list_transform(range(1, greatest(len(x) - {n} + 2, 1)), lambda i: array_to_string(x[i:i + {n} - 1], chr(31)))) as g from (select conv_id, {items} as x from s)"


_ORDERS = [("c", n) for n in range(1, 7)] + [("w", n) for n in (1, 2)]
_CHRF = f"""with s as (select a.conv_id, a.text as hyp, b.text as ref from conversations a join conversations b on a.conv_id = b.conv_id and a.turn = 0 and b.turn = 1),
  h as (select o, conv_id, g, count(*) as n from ({' union all '.join(_gram(k, n, 'hyp') for k, n in _ORDERS)}) group by all), r as (select o, conv_id, g, count(*) as n from ({' union all '.join(_gram(k, n, 'ref') for k, n in _ORDERS)}) group by all),
  m as (select o, sum(least(h.n, r.n)) as match from h join r using (o, conv_id, g) group by o), ht as (select o, sum(n) as n from h group by o), rt as (select o, sum(n) as n from r group by o),
  p as (select avg(coalesce(match, 0)::double / ht.n) as p, avg(coalesce(match, 0)::double / rt.n) as r from ht join rt using (o) left join m using (o))
  select round(case when p = 0 or r = 0 then 0 else 5 * p * r / (4 * p + r) end, 9) as chrf from p"""


@query("agg08_chrf", _CHRF)
def chrf(spark, sf_dir):
    """Corpus chrF++: clipped matches of character 1- to 6-grams and word 1- and 2-grams, F with beta 2.

    A conversation with one text on each side is counted in its row.  Of others each text pairs with
    all of the other side, so a gram counts once for each of them; their grams are exploded and counted over all tasks.
    """
    c = table(spark, sf_dir, "conversations").where("conv_id is not null and turn in (0, 1)").select("conv_id", (F.col("turn") == 0).alias("hyp"), F.col("text").alias("t"))
    of = lambda hyp: F.max(F.when(F.col("hyp") == hyp, F.col("t")))
    pair = c.groupBy("conv_id").agg(F.count_if("hyp").alias("nh"), F.count_if(~F.col("hyp")).alias("nr"), of(True).alias("h"), of(False).alias("r")).where("nh > 0 and nr > 0")
    small_batches(spark)
    alone = pair.where("nh = 1 and nr = 1").select("h", "r").mapInPandas(_chrf_counts, "o string, m long, h long, r long")

    # dealt out before they are exploded: a conversation of very many texts is no single task
    more = c.join(pair.where("nh > 1 or nr > 1").select("conv_id", "nh", "nr"), "conv_id").repartition(spark.sparkContext.defaultParallelism)
    every = F.concat(*[_named(k, n) for k, n in _ORDERS])
    counted = more.select("conv_id", "nh", "nr", "hyp", F.explode(every).alias("x")).groupBy("conv_id", "x.o", "x.g").agg((F.count_if("hyp") * F.max("nr")).alias("h"), (F.count_if(~F.col("hyp")) * F.max("nh")).alias("r"))
    both = alone.unionByName(counted.select("o", F.least("h", "r").alias("m"), "h", "r")).groupBy("o").agg(F.sum("m").alias("m"), F.sum("h").alias("h"), F.sum("r").alias("r"))
    live = both.where("h > 0 and r > 0").agg(F.avg(F.col("m") / F.col("h")).alias("p"), F.avg(F.col("m") / F.col("r")).alias("r"))
    return live.select(F.round(F.when((F.col("p") == 0) | (F.col("r") == 0), 0.0).otherwise(5 * F.col("p") * F.col("r") / (4 * F.col("p") + F.col("r"))), 9).alias("chrf"))


def _named(k: str, n: int):
    items = text.chars(F.col("t")) if k == "c" else text.chrf_words(F.col("t"))
    return F.transform(text.ngrams(items, n), lambda g: F.struct(F.lit(f"{k}{n}").alias("o"), F.xxhash64(g).alias("g")))


def _chrf_counts(frames):
    """Clipped matches and numbers of grams by order, over the rows (h, r) of a task."""
    total = {f"{k}{n}": [0, 0, 0] for k, n in _ORDERS}
    for frame in frames:
        for h, r in zip(frame["h"], frame["r"], strict=True):
            sides = [{"c": x.replace(" ", ""), "w": text.chrf_words_of(x)} for x in (h or "", r or "")]
            for k, n in _ORDERS:
                a, b = (text.ngram_counts(side[k], n) for side in sides)
                sums = total[f"{k}{n}"]
                sums[0] += sum(min(v, b[g]) for g, v in a.items() if g in b)
                sums[1] += a.total()
                sums[2] += b.total()
    yield pd.DataFrame([(o, *sums) for o, sums in total.items()], columns=["o", "m", "h", "r"])


_ASCII = "regexp_replace({c}.text, '[^ -~]', '', 'g')"


@query("agg09_set_cer", f"select round(avg(levenshtein(g, w)::double / length(w)), 9) as mean_cer, avg((g = w)::int) as exact from (select {_ASCII.format(c='d')} as g, {_ASCII.format(c='b')} as w from documents d join benchmark b on doc_id = item_id) where w <> ''")
def set_cer(spark, sf_dir):
    a = lambda c: F.regexp_replace(c, "[^ -~]", "")
    got = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("i"), a("text").alias("g"))
    want = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("i"), a("text").alias("w")).where("w <> ''")
    return got.join(want, "i").agg(F.round(F.avg(text.cer(F.col("g"), F.col("w"))), 9).alias("mean_cer"), F.avg((F.col("g") == F.col("w")).cast("int")).alias("exact"))


@query("agg10_cache_stats", "select count(*) as pages, sum(strlen(text))::bigint as bytes, count(*) filter (doc_id in (select doc_id from labels where quality = 1)) as edited from documents")
def cache_stats(spark, sf_dir):
    edits = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id", F.lit(1).alias("e")).distinct()
    return table(spark, sf_dir, "documents").join(edits, "doc_id", "left").agg(F.count("*").alias("pages"), F.sum(F.octet_length("text")).alias("bytes"), F.count("e").alias("edited"))


@query("agg11_metric_ratchet", """with v as (select event_type as metric, user_id % 2 = 0 as lower, arg_max(value, event_id) filter (event_id % 2 = 0) as prior, arg_max(value, event_id) filter (event_id % 2 = 1) as now from events group by 1, 2)
  select metric, lower, case when prior is null or now is null then 'skip' when (lower and now > prior + 1e-9) or (not lower and now < prior - 1e-9) then 'worse' else 'ok' end as verdict from v""")
def metric_ratchet(spark, sf_dir):
    """The last value of a metric against the one before: no worse, in the metric's direction."""
    last = lambda p: F.max_by(F.when(F.col("event_id") % 2 == p, F.col("value")), F.when(F.col("event_id") % 2 == p, F.col("event_id")))
    v = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("metric"), (F.col("user_id") % 2 == 0).alias("lower")).agg(last(0).alias("prior"), last(1).alias("now"))
    worse = (F.col("lower") & (F.col("now") > F.col("prior") + 1e-9)) | (~F.col("lower") & (F.col("now") < F.col("prior") - 1e-9))
    return v.select("metric", "lower", F.when(F.col("prior").isNull() | F.col("now").isNull(), "skip").when(worse, "worse").otherwise("ok").alias("verdict"))


_RANK = {"FAIL": 3, "INCONCLUSIVE": 2, "SKIP": 1, "PASS": 0}
_ST = "list_extract(['PASS', 'SKIP', 'INCONCLUSIVE', 'FAIL'], cast(o_orderkey % 4 as int) + 1)"


@query("agg12_worst_status", f"select o_custkey, arg_max(s, case s when 'FAIL' then 3 when 'INCONCLUSIVE' then 2 when 'SKIP' then 1 else 0 end) as worst from (select o_custkey, {_ST} as s from orders) group by o_custkey")
def worst_status(spark, sf_dir):
    s = F.get(F.array(*map(F.lit, ["PASS", "SKIP", "INCONCLUSIVE", "FAIL"])), F.col("o_orderkey") % 4)
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in _RANK.items() for x in kv]), F.col("s"))
    return table(spark, sf_dir, "orders").select("o_custkey", s.alias("s")).groupBy("o_custkey").agg(F.max_by("s", rank).alias("worst"))


@query("agg13_metric_harvest", "select user_id, arg_max(json_extract_string(props, '$.k')::int, event_id) as k from events where event_id % 3 = 0 group by user_id")
def metric_harvest(spark, sf_dir):
    """The last METRICS line of each run's output."""
    line = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("METRICS "), "props")).otherwise("noise")
    lines = table(spark, sf_dir, "events").select("user_id", "event_id", line.alias("line")).where(F.col("line").startswith("METRICS "))
    k = F.from_json(F.substring("line", 9, 10_000), "k int")["k"]
    return lines.groupBy("user_id").agg(F.max_by(k, F.col("event_id")).alias("k"))


@query("agg14_warn_once", "select distinct user_id as job, event_type as warning from events where event_id % 2 = 0")
def warn_once(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_id % 2 = 0").select(F.col("user_id").alias("job"), F.col("event_type").alias("warning")).dropDuplicates(["job", "warning"])


@query("agg15_raster_set_name", "select source, substr(sha1(string_agg(doc_id::varchar, ',' order by doc_id)), 1, 12) as name from documents group by source")
def raster_set_name(spark, sf_dir):
    """Digest of a page's kept ids, sorted as numbers."""
    ids = F.transform(F.sort_array(F.collect_list("doc_id")), lambda i: i.cast("string"))
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.substring(F.sha1(F.array_join(ids, ",").cast("binary")), 1, 12).alias("name"))


@query("win01_severity_order", "select doc_id, row_number() over (order by case when toxic = 1 then 0 when quality = 0 then 1 else 2 end, doc_id) as place from labels")
def severity_order(spark, sf_dir):
    """Failed first, then compromised, then the rest, by id: ranks inside a class on top of the classes before."""
    s = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2).alias("s"), F.floor(F.col("doc_id") / 256).alias("part"))
    counts = s.groupBy("s", "part").agg(F.count("*").alias("n"))
    before = counts.select("s", "part", F.coalesce(F.sum("n").over(Window.orderBy("s", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = s.withColumn("r", F.row_number().over(Window.partitionBy("s", "part").orderBy("doc_id")))
    return ranked.join(before, ["s", "part"]).select("doc_id", (F.col("before") + F.col("r")).alias("place"))


@query("win02_member_order", f"with {MEMBERS} select item, list(member order by {NAT.format(p='member')}, member, page_id) as members from members group by item")
def member_order(spark, sf_dir):
    """Members of an item in natural order."""
    rows = members(spark, sf_dir).groupBy("item").agg(F.array_sort(F.collect_list(F.struct(names.natural_key(F.col("member")).alias("k"), "member", "page_id"))).alias("m"))
    return rows.select("item", F.col("m.member").alias("members"))


_ENTRIES = "e as (select doc_id as key, strlen(text) as bytes, (doc_id * 7919) % 100003 as used, doc_id in (select doc_id from labels where quality = 1) as pinned from documents)"


@query("win03_evict", f"""with {_ENTRIES}, t as (select sum(bytes) as total from e), r as (select key, bytes, coalesce(sum(bytes) over (order by used, key rows between unbounded preceding and 1 preceding), 0) as freed from e where not pinned)
  select key, bytes::bigint as bytes from r, t where total - freed > 200000""")
def evict(spark, sf_dir):
    pins = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id", F.lit(True).alias("p")).distinct()
    entries = table(spark, sf_dir, "documents").join(pins, "doc_id", "left").select(F.col("doc_id").alias("key"), F.octet_length("text").cast("long").alias("bytes"), ((F.col("doc_id") * 7919) % 100003).alias("used"), F.coalesce("p", F.lit(False)).alias("pinned"))
    return records.evict(entries, 200_000, 32)


@query("win04_memory_tier", """with e as (select user_id, event_id * 7 % 5 as page, row_number() over (partition by user_id order by event_id) as k from events), p as (select *, lag(k) over (partition by user_id, page order by k) as pk from e),
  h as (select p.user_id, p.k, count(distinct b.page) as d from p join e b on b.user_id = p.user_id and b.k > p.pk and b.k < p.k group by 1, 2)
  select user_id, count(*) filter (pk is not null and coalesce(d, 0) <= 2) as hits from p left join h using (user_id, k) group by user_id""")
def memory_tier(spark, sf_dir):
    """Replay of an access log against a tier of three items: hits per item, a fold over each user's log in one Arrow UDF."""
    def replay(logs: pd.Series) -> pd.Series:
        def hits(log):
            tier: list = []
            n = 0
            for key in log:
                n += key in tier
                tier = [k for k in tier if k != key][-2:] + [key]
            return n

        return logs.map(hits)

    logs = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", (F.col("event_id") * 7 % 5).alias("page")))).alias("l"))
    return logs.select("user_id", F.pandas_udf(replay, "long")(F.col("l.page")).alias("hits"))


@query("win05_finished_retention", "select o_custkey, o_orderkey from orders where o_orderstatus <> 'O' qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) > 3")
def finished_retention(spark, sf_dir):
    """Finished jobs beyond the newest are dropped, running ones never."""
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(spark, sf_dir, "orders").where("o_orderstatus <> 'O'").withColumn("r", F.row_number().over(order)).where("r > 3").select("o_custkey", "o_orderkey")


@query("win06_newest_raster", "select user_id, arg_max(event_type, struct_pack(a := ts, b := event_id)) as name from events group by user_id")
def newest_raster(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("name"))


@query("win07_front_page", """with l as (select user_id as item, event_id % 8 as page, arg_max(event_type, struct_pack(a := ts, b := event_id)) as stage from events group by 1, 2)
  select item, min(page) as page, arg_min(stage, page) as stage from l where stage <> 'purchase' group by item""")
def front_page(spark, sf_dir):
    """Per item the lowest page that is not written yet, with its last stage."""
    last = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("item"), (F.col("event_id") % 8).alias("page")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("stage"))
    return last.where("stage <> 'purchase'").groupBy("item").agg(F.min("page").alias("page"), F.min_by("stage", "page").alias("stage"))


@query("win08_longest_fit", "select doc_id, least(length(text), 300 - doc_id % 50)::int as longest from documents")
def longest_fit(spark, sf_dir):
    """The largest n a monotone predicate holds for, by bisection inside the expression."""
    n = F.length("text")
    fits = lambda k: k + F.col("doc_id") % 50 <= 300
    step = lambda s, _: F.when(s["lo"] > s["hi"], s).otherwise(F.when(fits(F.floor((s["lo"] + s["hi"]) / 2).cast("int")), F.struct((F.floor((s["lo"] + s["hi"]) / 2) + 1).cast("int").alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), (F.floor((s["lo"] + s["hi"]) / 2) - 1).cast("int").alias("hi"))))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(32)), F.struct(F.lit(1).alias("lo"), n.alias("hi")), step, lambda s: s["hi"])
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("longest"))


@query("win09_log_tail", "select event_id, event_type from events order by event_id desc limit 200")
def log_tail(spark, sf_dir):
    """The newest 200 lines."""
    return table(spark, sf_dir, "events").orderBy(F.desc("event_id")).limit(200).select("event_id", "event_type")


@query("win10_listed_first", "select p, row_number() over (order by coalesce(list_position(['5-LOW', '1-URGENT'], p), 1000), p) as place from (select distinct o_orderpriority as p from orders)")
def listed_first(spark, sf_dir):
    """Listed names in the list's order, then the others sorted; a handful of names."""
    listed = F.array(F.lit("5-LOW"), F.lit("1-URGENT"))
    p = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("p")).distinct()
    at = F.array_position(listed, F.col("p"))
    return p.withColumn("place", F.row_number().over(Window.orderBy(F.when(at > 0, at).otherwise(1000), "p")).cast("long"))
