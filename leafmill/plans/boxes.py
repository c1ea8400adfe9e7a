"""Queries of SURVEY sections 2.5 and 2.8 over boxes: geometry, neighbours, blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from leafmill.functions import geometry as g
from leafmill.operators import grouping
from leafmill.plans.registry import query
from leafmill.plans.standins import BOXES, boxes

_WH = "least(x1 - x0, y1 - y0)"
_FIELDS = ("id", "x0", "y0", "x1", "y1")


def _pair(extra: str = "") -> str:
    return f"{BOXES}, p as (select a.page, a.id as i, b.id as j, a.x0 ax0, a.y0 ay0, a.x1 ax1, a.y1 ay1, b.x0 bx0, b.y0 by0, b.x1 bx1, b.y1 by1{extra} from boxes a join boxes b on a.page = b.page and a.id < b.id)"


OX, OY = "(least(ax1, bx1) - greatest(ax0, bx0))", "(least(ay1, by1) - greatest(ay0, by0))"
INSIDE = f"(greatest({OX}, 0) * greatest({OY}, 0))::double / least((ax1 - ax0) * (ay1 - ay0), (bx1 - bx0) * (by1 - by0))"
GA, GB = "least(ax1 - ax0, ay1 - ay0)", "least(bx1 - bx0, by1 - by0)"
EDGES = f"""{_pair()}, u as (select page, median({_WH}) as unit from boxes group by page),
  edges as (select p.page, i, j from p join u using (page) where {INSIDE} >= 0.7::double or (least({GA}, {GB}) >= 0.3::double * greatest({GA}, {GB}) and
    (({OY} >= 0.5 * least(ay1 - ay0, by1 - by0) and -{OX} <= 1.5 * unit) or ({OX} >= 0.5 * least(ax1 - ax0, bx1 - bx0) and -{OY} <= 1.5 * unit))))"""
BLOCKS = f"{EDGES}, sym as (select page, i, j from edges union all select page, j, i from edges), reach as (select page, id as i, id as j from boxes union select r.page, r.i, b.j from reach r join sym b on r.page = b.page and r.j = b.i), blocks as (select page, i as id, min(j) as block from reach group by page, i)"


@query("geo01_bounding_box", f"with {BOXES} select page, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from boxes group by page")
def bounding_box(spark, sf_dir):
    """Box of all points of a page's polygons."""
    points = boxes(spark, sf_dir).select("page", g.bbox(g.corners()).alias("b"))
    return points.groupBy("page").agg(F.min("b.x0").cast("long").alias("x0"), F.min("b.y0").cast("long").alias("y0"), F.max("b.x1").cast("long").alias("x1"), F.max("b.y1").cast("long").alias("y1"))


@query("geo02_box_to_points", f"with {BOXES} select page, id, [[x0, y0], [x1, y0], [x1, y1], [x0, y1]]::double[][] as polygon from boxes")
def box_to_points(spark, sf_dir):
    return boxes(spark, sf_dir).select("page", "id", F.transform(g.corners(), lambda p: F.array(p["x"], p["y"])).alias("polygon"))


@query("geo03_ellipse", f"with {BOXES} select page, id, count(*) as points, round(min(x), 3) as left, round(max(y), 3) as bottom, round(sum(x * (k + 1)), 3) as xs, round(sum(y * (k + 1)), 3) as ys from (select page, id, k, (x0 + x1) / 2.0 + (x1 - x0) / 2.0 * cos(k * 2 * pi() / 64) as x, (y0 + y1) / 2.0 + (y1 - y0) / 2.0 * sin(k * 2 * pi() / 64) as y from (select *, unnest(range(0, 64))::int as k from boxes)) group by page, id")
def ellipse(spark, sf_dir):
    """All points of the ellipse, given back as their number, extremes, and sums weighted by place; a batch's points are one matrix."""

    def summed(frame: pd.DataFrame) -> pd.DataFrame:
        xs, ys = g.ellipse_points(*(frame[c].to_numpy(float) for c in _FIELDS[1:]))
        place = np.arange(1, xs.shape[1] + 1)
        return pd.DataFrame({"points": xs.shape[1], "left": xs.min(axis=1), "bottom": ys.max(axis=1), "xs": xs @ place, "ys": ys @ place})

    of = F.pandas_udf(summed, "points long, left double, bottom double, xs double, ys double")
    points = boxes(spark, sf_dir).select("page", "id", of(F.struct(*_FIELDS[1:])).alias("p"))
    return points.select("page", "id", "p.points", *[F.round(f"p.{c}", 3).alias(c) for c in ("left", "bottom", "xs", "ys")])


@query("geo04_containment", f"with {_pair()} select page, i, j, round({INSIDE}, 6) as share from p where {OX} > 0 and {OY} > 0")
def containment(spark, sf_dir):
    b = boxes(spark, sf_dir)
    joined = b.alias("a").join(b.alias("b"), (F.col("a.page") == F.col("b.page")) & (F.col("a.id") < F.col("b.id")) & (g.overlap("a", "b", "x") > 0) & (g.overlap("a", "b", "y") > 0))
    return joined.select("a.page", F.col("a.id").alias("i"), F.col("b.id").alias("j"), F.round(g.contained("a", "b"), 6).alias("share"))


@query("geo05_tilt", f"""with {BOXES}, c as (select page, id, [[x0, y0], [x1, y0 + id], [x1, y1 + id], [x0, y1]] as p from boxes),
  e as (select page, id, k, p[k % 4 + 1][1] - p[k][1] as dx, p[k % 4 + 1][2] - p[k][2] as dy from (select *, unnest([1, 2, 3, 4]) as k from c)),
  l as (select page, id, abs(degrees(atan2(dy::double, dx::double))) % 90 as deg from e qualify row_number() over (partition by page, id order by sqrt((dx * dx + dy * dy)::double) desc, k) = 1)
  select page, id, round(least(deg, 90 - deg), 6) as tilt from l""")
def tilt(spark, sf_dir):
    slant = F.array(g.point(F.col("x0"), F.col("y0")), g.point(F.col("x1"), F.col("y0") + F.col("id")), g.point(F.col("x1"), F.col("y1") + F.col("id")), g.point(F.col("x0"), F.col("y1")))
    return boxes(spark, sf_dir).select("page", "id", F.round(g.tilt(slant), 6).alias("tilt"))


@query("geo06_glyph_unit", f"with {BOXES} select page, median({_WH})::double as unit from boxes group by page")
def glyph_unit(spark, sf_dir):
    return boxes(spark, sf_dir).groupBy("page").agg(F.expr(f"percentile({_WH}, 0.5)").alias("unit"))


@query("geo07_glyph_px", f"with {BOXES} select page, list_sort(list({_WH}))[(count(*) // 2 + 1)::int]::int as px from boxes group by page")
def glyph_px(spark, sf_dir):
    """The upper median: element n // 2 of the sorted short sides."""
    sides = boxes(spark, sf_dir).groupBy("page").agg(F.sort_array(F.collect_list(F.expr(_WH))).alias("s"))
    return sides.select("page", F.get("s", F.floor(F.size("s") / 2).cast("int")).cast("int").alias("px"))


@query("geo08_neighbours", f"with {EDGES} select * from edges")
@query("join03_neighbour_pairs", f"with {EDGES} select * from edges")
def neighbours(spark, sf_dir):
    return grouping.neighbour_edges(boxes(spark, sf_dir))


_FLAT = "greatest(ax1 - ax0, bx1 - bx0) >= greatest(ay1 - ay0, by1 - by0)"


@query("geo09_same_text", f"""with {_pair()}, s as (select page, i, j, {OX} as ox, {OY} as oy, case when {_FLAT} then {OX} else {OY} end as span, case when {_FLAT} then {OY} else {OX} end as side,
  case when {_FLAT} then ax1 - ax0 else ay1 - ay0 end as sa, case when {_FLAT} then bx1 - bx0 else by1 - by0 end as sb, case when {_FLAT} then ay1 - ay0 else ax1 - ax0 end as ta, case when {_FLAT} then by1 - by0 else bx1 - bx0 end as tb from p)
  select page, i, j from s where ox > 0 and oy > 0 and span >= 0.8 * greatest(sa, sb) and side >= 0.7 * least(ta, tb) and least(ta, tb) >= 0.6 * greatest(ta, tb)""")
def same_text(spark, sf_dir):
    return grouping.pairs(boxes(spark, sf_dir), g.same_text("a", "b"))


@query("geo10_convex_hull")
def convex_hull(spark, sf_dir):
    return boxes(spark, sf_dir).groupBy("page").agg(F.collect_list(F.struct(*_FIELDS)).alias("b")).select("page", grouping.hull_udf("b").alias("hull"))


@query("geo11_to_page", f"with {BOXES} select page, id, least(greatest(round_even(x0 * 1.37::double, 0), 0), 559)::int as x, least(greatest(round_even(y0 * 0.73::double, 0), 0), 299)::int as y, greatest(32, (x1 // 32) * 32)::int as net from boxes")
def to_page(spark, sf_dir):
    p = g.to_page(F.col("x0"), F.col("y0"), F.lit(1.37), F.lit(0.73), F.lit(560), F.lit(300))
    return boxes(spark, sf_dir).select("page", "id", p["x"].alias("x"), p["y"].alias("y"), F.greatest(F.lit(32), F.floor(F.col("x1") / 32) * 32).cast("int").alias("net"))


#: A slanted quadrilateral of a box, the same in both engines.
def _quad():
    w = F.col("x1") - F.col("x0")
    return F.array(g.point(F.col("x0"), F.col("y0")), g.point(F.col("x1"), F.col("y0")), g.point(F.col("x1") - w / 4, F.col("y1")), g.point(F.col("x0") + w / 4, F.col("y1")))


_LO = "x0 + ((x1 - x0) / 4.0) * ({y} - y0) / (y1 - y0)"
_HI = "x1 - ((x1 - x0) / 4.0) * ({y} - y0) / (y1 - y0)"


@query("geo12_widest_chord", f"with {BOXES} select page, id, round({_LO.format(y='(y0 + 7)')}, 3) as lo, round({_HI.format(y='(y0 + 7)')}, 3) as hi from boxes")
def widest_chord(spark, sf_dir):
    c = boxes(spark, sf_dir).select("page", "id", g.widest_chord(_quad(), F.col("y0") + 7).alias("c"))
    return c.select("page", "id", F.round("c.lo", 3).alias("lo"), F.round("c.hi", 3).alias("hi"))


@query("geo13_narrowest_chord", f"with {BOXES} select page, id, round({_LO.format(y='(y0 + 15)')}, 3) as lo, round(least({_HI.format(y='(y0 + 15)')}, 500), 3) as hi from boxes where {_LO.format(y='(y0 + 15)')} < 500")
def narrowest_chord(spark, sf_dir):
    c = boxes(spark, sf_dir).select("page", "id", g.narrowest(_quad(), F.col("y0") + 3, F.col("y0") + 15, F.lit(500)).alias("c")).where("c is not null")
    return c.select("page", "id", F.round("c.lo", 3).alias("lo"), F.round("c.hi", 3).alias("hi"))


@query("geo14_inset", f"with {BOXES} select page, id, case when y1 - y0 <= 60 or x1 - x0 <= 60 then [[x0, y0], [x1, y0], [x1, y1], [x0, y1]] else [[x0 + 30, y0 + 30], [x1 - 30, y0 + 30], [x1 - 30, y1 - 30], [x0 + 30, y1 - 30]] end::double[][] as polygon from boxes")
def inset(spark, sf_dir):
    return boxes(spark, sf_dir).select("page", "id", F.transform(g.inset(g.corners(), F.lit(30)), lambda p: F.array(F.round(p["x"], 3), F.round(p["y"], 3))).alias("polygon"))


@query("geo15_hit_test", f"with {BOXES} select page, min(id) as hit from boxes where 150 between x0 and x1 - 1 and 150 between y0 and y1 - 1 group by page")
def hit_test(spark, sf_dir):
    """The first region of a page, by id, that holds a point."""
    return boxes(spark, sf_dir).where(g.holds(g.corners(), F.lit(150), F.lit(150))).groupBy("page").agg(F.min("id").alias("hit"))


@query("geo16_reading_order", f"with {BOXES} select page, id, row_number() over (partition by page order by y0 // 20, -x1, id) as place from boxes")
def reading_order(spark, sf_dir):
    """Bands from the top, right to left inside a band."""
    order = Window.partitionBy("page").orderBy(F.floor(F.col("y0") / 20), -F.col("x1"), "id")
    return boxes(spark, sf_dir).select("page", "id", F.row_number().over(order).cast("long").alias("place"))


@query("geo17_line_order", f"""with recursive {BOXES}, v as (select page, 2 * count(*) filter (y1 - y0 > x1 - x0) > count(*) as up from boxes group by page),
  t as (select page, id, case when up then -(x0 + x1) / 2.0 else (y0 + y1) / 2.0 end as m, case when up then x1 - x0 else y1 - y0 end as thick, case when up then y0 else x0 end as along from boxes join v using (page)),
  s as (select page, list_sort(list(thick))[(count(*) // 2 + 1)::int] as line from t group by page),
  o as (select t.*, line, row_number() over (partition by page order by m, id) as k from t join s using (page)),
  f as (select page, id, k, m as head, line, along, 1 as r from o where k = 1
    union all select o.page, o.id, o.k, case when abs(o.m - f.head) <= 0.5 * o.line then f.head else o.m end, o.line, o.along, case when abs(o.m - f.head) <= 0.5 * o.line then f.r else f.r + 1 end from f join o on o.page = f.page and o.k = f.k + 1)
  select page, list(id order by r, along, k) as ids from f group by page""")
def line_order(spark, sf_dir):
    return boxes(spark, sf_dir).groupBy("page").agg(F.collect_list(F.struct(*_FIELDS)).alias("b")).select("page", grouping.line_order("b").alias("ids"))


_LINES = f"""{BOXES}, v as (select page, 2 * count(*) filter (y1 - y0 > x1 - x0) > count(*) as up from boxes group by page),
  t as (select b.*, case when up then x1 - x0 else y1 - y0 end as thick, (x1 - x0) * (y1 - y0) as area from boxes b join v using (page)),
  m as (select page, list_sort(list(thick))[(count(*) // 2 + 1)::int] as line from t group by page),
  h as (select a.page, a.id as holder, b.id as held, a.thick <= 1.5 * line as is_line from t a join t b on a.page = b.page and a.id <> b.id and b.area < a.area join m on a.page = m.page
    where (greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0))::double / b.area >= 0.7::double),
  d as (select page, held as id from h where is_line union select page, holder from h where not is_line)"""


@query("geo18_line_resolver", f"with {_LINES} select page, id from boxes where (page, id) not in (select page, id from d)")
def line_resolver(spark, sf_dir):
    """A line over its words stays and they go; a block over its lines goes."""
    b = boxes(spark, sf_dir)
    up = b.groupBy("page").agg((2 * F.count_if(g.height() > g.width()) > F.count("*")).alias("up"))
    t = b.join(up, "page").withColumn("thick", F.when(F.col("up"), g.width()).otherwise(g.height())).withColumn("area", g.width() * g.height())
    sizes = t.groupBy("page").agg(F.sort_array(F.collect_list("thick")).alias("s")).select("page", F.get("s", F.floor(F.size("s") / 2).cast("int")).alias("line"))
    t = t.join(sizes, "page")
    over = F.greatest(g.overlap("a", "b", "x"), F.lit(0)) * F.greatest(g.overlap("a", "b", "y"), F.lit(0)) / F.col("b.area")
    held = t.alias("a").join(t.alias("b"), (F.col("a.page") == F.col("b.page")) & (F.col("a.id") != F.col("b.id")) & (F.col("b.area") < F.col("a.area")) & (over >= 0.7))
    gone = held.select(F.col("a.page").alias("page"), F.when(F.col("a.thick") <= 1.5 * F.col("a.line"), F.col("b.id")).otherwise(F.col("a.id")).alias("id"))
    return b.select("page", "id").join(gone, ["page", "id"], "left_anti")


@query("geo19_page_context", f"with {BOXES}, s as (select page, max(x1) * 7 as w, max(y1) * 5 as h from boxes group by page), k as (select *, least(1.0::double, 1024.0::double / greatest(w, h)) as f from s) select page, greatest(1, round_even(w * f, 0))::int as w, greatest(1, round_even(h * f, 0))::int as h from k")
def page_context(spark, sf_dir):
    """Size of the page image that goes with a request: 1024 px on the longer side at most, never enlarged."""
    s = boxes(spark, sf_dir).groupBy("page").agg((F.max("x1") * 7).alias("w"), (F.max("y1") * 5).alias("h"))
    f = F.least(F.lit(1.0), F.lit(1024.0) / F.greatest("w", "h"))
    return s.select("page", F.greatest(F.lit(1), F.bround(F.col("w") * f, 0)).cast("int").alias("w"), F.greatest(F.lit(1), F.bround(F.col("h") * f, 0)).cast("int").alias("h"))


@query("agg04_greedy_dedupe", f"""with recursive {_pair()}, q as (select page, i, j, {OX} as ox, {OY} as oy, case when {_FLAT} then {OX} else {OY} end as span, case when {_FLAT} then {OY} else {OX} end as side,
    case when {_FLAT} then ax1 - ax0 else ay1 - ay0 end as sa, case when {_FLAT} then bx1 - bx0 else by1 - by0 end as sb, case when {_FLAT} then ay1 - ay0 else ax1 - ax0 end as ta, case when {_FLAT} then by1 - by0 else bx1 - bx0 end as tb from p),
  same as (select page, i, j from q where ox > 0 and oy > 0 and span >= 0.8 * greatest(sa, sb) and side >= 0.7 * least(ta, tb) and least(ta, tb) >= 0.6 * greatest(ta, tb)),
  last as (select page, max(id) as n from boxes group by page),
  hit as (select page, j, list(i) as eq from same group by page, j),
  f as (select page, n, 0::bigint as k, []::bigint[] as kept from last
    union all select f.page, f.n, f.k + 1, case when coalesce(list_has_any(f.kept, hit.eq), false) then f.kept else list_append(f.kept, f.k + 1) end from f left join hit on hit.page = f.page and hit.j = f.k + 1 where f.k < f.n)
  select page, unnest(kept) as id from f where k = n""")
def greedy_dedupe(spark, sf_dir):
    return boxes(spark, sf_dir).groupBy("page").agg(F.collect_list(F.struct(*_FIELDS)).alias("b")).select("page", F.explode(grouping.greedy_keep("b")).alias("id"))


@query("agg05_components", f"with recursive {BLOCKS} select page, id, block from blocks")
def components(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return grouping.page_components(b, grouping.neighbour_edges(b))


def _blocks(spark, sf_dir):
    b = boxes(spark, sf_dir)
    named = grouping.page_components(b, grouping.neighbour_edges(b)).join(b, ["page", "id"])
    return named.groupBy("page", "block").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.sort_array(F.collect_list("id")).alias("members"), F.collect_list(F.struct(*_FIELDS)).alias("boxes"))


@query("agg06_absorb", f"""with recursive {BLOCKS}, m as (select page, block, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from blocks join boxes using (page, id) group by page, block),
  s as (select *, (x1 - x0) * (y1 - y0) as area from m),
  h as (select a.page, a.block, b.block as into_, b.area from s a join s b on a.page = b.page and a.area < b.area and a.area > 0
    where greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) >= 0.5 * a.area)
  select page, block, into_ as "into" from h qualify row_number() over (partition by page, block order by area, into_) = 1""")
def absorb(spark, sf_dir):
    return grouping.absorbed(_blocks(spark, sf_dir))


@query("agg07_group_merge", f"with recursive {BLOCKS} select page, block, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1, list(id order by id) as members from blocks join boxes using (page, id) group by page, block")
def group_merge(spark, sf_dir):
    return _blocks(spark, sf_dir).drop("boxes")
