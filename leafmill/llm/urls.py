"""URL filters by a sort-merge range join.

A rule (host, path prefix) and a url's probe are keys on one axis: the host's
labels reversed, then the path.  A url gets one probe for each domain it lies
under, so "the host or a subdomain, path starts with" turns into "key starts
with", and a rule is the interval of keys that start with its own.  Such
intervals nest or are disjoint.  A sorted sweep then passes rule starts, rule
ends and probes in key order: a start pushes its rule on the stack, an end
leaves what was below it, a probe reads the stack's top, the longest
path rule for that domain.  The longest over a url's probes decides.

The axis is cut into ranges by a sample of about SAMPLE keys, whatever the number of rows (those whose hash is small enough), one range
for each ROWS probes or partition, and each range is swept by
itself; a rule is sent to every range that its interval touches.  A key that is
so frequent that several cuts fall on it is dealt out over the ranges between them
by row, so a host or url with a third of all rows is no single task.  Cuts change the load,
never the result.

Rules on the same key: block wins.  Of rules of equal length the one with the longer
host, then the smaller text wins.  Null urls and urls without "://" have empty host
and path and match nothing.  Repeated rows and ids are judged row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm.common import cut, let, table, with_row_id

#: The query's rules (fixed values): verdict, host, path.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: Keys that the cuts are taken from, about; probes of a range.
SAMPLE, ROWS = 4096, 2_000_000
DEFAULT = "allow"


def split_url(url):
    """(host, path) expressions of a url: no "://" gives two empty strings."""
    found = F.locate("://", url) > 0
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(found, lower).otherwise(""), F.when(found, path).otherwise("")


def axis(host, path):
    """Key of a host and a path: reversed labels, a mark below every character of a host, the path."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit("\x01"), path)


def _past(key):
    """The first key after all that start with ``key``: U+10FFFF sorts above what a url holds."""
    return F.concat(key, F.lit("\U0010ffff"))


def _chains(rules: DataFrame) -> DataFrame:
    """Rules with ``below``: the nested rules around each, outermost first (by prefix, on the key)."""
    prefixes = rules.select(F.col("key").alias("of"), F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda n: F.substring(F.col("key"), F.lit(1), n))).alias("key"))
    around = prefixes.where("key <> of").join(rules.select("key", "rule"), "key")
    chains = around.groupBy(F.col("of").alias("key")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.length("key").alias("n"), "rule"))), lambda x: x["rule"]).alias("below"))
    none = F.array().cast(chains.schema["below"].dataType)
    return rules.join(chains, "key", "left").withColumn("below", F.coalesce("below", none))


def _cuts(keys: DataFrame, count: int, ranges: int) -> list[str]:
    """Keys that cut the axis into about equal shares, from a sample of about SAMPLE of ``count`` keys: only its rows leave their tasks."""
    parts = 1 << 30
    some = keys.where(F.pmod(F.xxhash64("_row", "key"), F.lit(parts)) < max(1, SAMPLE * parts // max(count, 1)))
    got = sorted(r[0] for r in some.select("key").collect())
    return [got[len(got) * i // ranges] for i in range(1, ranges)] if got else []


def _count_below(cuts: list[str], key, equal: bool):
    """Number of cuts that are < key (<= key if ``equal``), by binary search inside the expression."""
    if not cuts:
        return F.lit(0)
    below = (lambda c: c <= key) if equal else (lambda c: c < key)
    bits = [1 << b for b in range(len(cuts).bit_length() - 1, -1, -1)]
    return let(F.array(*map(F.lit, cuts)), lambda a: F.aggregate(F.array(*map(F.lit, bits)), F.lit(0), lambda at, b: F.when((at + b <= len(cuts)) & below(F.get(a, at + b - 1)), at + b).otherwise(at)))


def judge(urls: DataFrame, rules: DataFrame, ranges: int | None = None, default: str = DEFAULT) -> DataFrame:
    """``urls`` (a column ``url`` and others) with host, path, rule and verdict; ``rules`` has verdict, host, path."""
    spark = urls.sparkSession
    host, path = split_url(F.col("url"))
    kept = [c for c in urls.columns if c != "url"]
    rows = with_row_id(urls.select(F.struct(*kept).alias("_kept") if kept else F.struct(F.lit(0).alias("_")).alias("_kept"), host.alias("host"), path.alias("path")), "_row")

    r = rules.where("host is not null and path is not null").select("verdict", F.lower("host").alias("host"), "path")
    r = r.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block sorts after allow
    text = F.concat("host", "path")
    r = r.select(axis(F.col("host"), F.col("path")).alias("key"), F.struct((-F.length(text)).alias("a"), (-F.length("host")).alias("b"), text.alias("text"), "verdict").alias("rule"))
    r = cut(_chains(r))

    labels = F.split("host", r"\.")
    under = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, -n, n), "."))
    probes = rows.where("host <> ''").select("_row", F.explode(under).alias("host"), "path").select("_row", axis(F.col("host"), F.col("path")).alias("key"))
    count = urls.count()
    cuts = _cuts(probes, 4 * count, ranges or min(SAMPLE // 4, max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * count // ROWS)))
    low, high = _count_below(cuts, F.col("key"), False), _count_below(cuts, F.col("key"), True)
    points = probes.select((low + F.pmod(F.xxhash64("_row"), high - low + 1)).alias("at"), "key", F.lit(1).alias("kind"), "_row", F.lit(None).cast(r.schema["below"].dataType).alias("stack"))
    r = r.withColumn("past", _past(F.col("key"))).withColumn("at", F.explode(F.sequence(_count_below(cuts, F.col("key"), False), _count_below(cuts, F.col("past"), True))))
    nobody = F.lit(None).cast("long").alias("_row")
    starts = r.select("at", "key", F.lit(0).alias("kind"), nobody, F.concat("below", F.array("rule")).alias("stack"))
    ends = r.select("at", F.col("past").alias("key"), F.lit(2).alias("kind"), nobody, F.col("below").alias("stack"))
    # of ends on one key the outermost comes last, with the shortest stack
    order = Window.partitionBy("at").orderBy("key", "kind", F.when(F.col("kind") == 2, -F.size("stack")).otherwise(0))
    swept = points.union(starts).union(ends).withColumn("stack", F.last("stack", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    best = swept.where("kind = 1 and size(stack) > 0").select("_row", F.element_at("stack", -1).alias("rule")).groupBy("_row").agg(F.min("rule").alias("rule"))
    names = [F.col(f"_kept.{c}") for c in kept]
    return rows.join(best, "_row", "left").select(*names, "host", "path", F.col("rule.text").alias("rule"), F.coalesce("rule.verdict", F.lit(default)).alias("verdict"))


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(r, ("verdict", "host", "path"), strict=True)]) for r in RULES])))
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


ORACLES = {
    "op2_urls": f"""
    with r(verdict, host, path) as (values {', '.join(map(repr, RULES))}),
    u as (select row_number() over () as i, page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
    s as (select i, page_id, lower(regexp_extract(rest, '^[^/?#]*')) as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
    m as (select i, r.host || r.path as rule, verdict, row_number() over (partition by i order by -length(r.host || r.path), -length(r.host), r.host || r.path) as n
      from s join r on (s.host = r.host or s.host like '%.' || r.host) and starts_with(s.path, r.path))
    select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from s left join (select * from m where n = 1) m using (i)
    """
}
QUERIES = {"op2_urls": op2_urls}
