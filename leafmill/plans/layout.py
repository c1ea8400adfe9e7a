"""Queries of SURVEY sections 2.6 and 2.12: pixels and text layout."""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from leafmill.llm.common import small_batches
from leafmill.operators import layout, pixels
from leafmill.plans.registry import query
from leafmill.plans.standins import BOXES, boxes, table



@query("pix02_changed_pixels", "select a.vec_id, len(list_filter(range(1, 65), lambda i: a.embedding[i] <> coalesce(b.embedding[i], 9))) as changed from embeddings a join embeddings b on b.vec_id = a.vec_id // 2")
def changed_pixels(spark, sf_dir):
    """Elements of two pages that differ."""
    e = table(spark, sf_dir, "embeddings")
    other = e.select(F.col("vec_id").alias("k"), F.col("embedding").alias("other"))
    diff = F.size(F.filter(F.zip_with("embedding", "other", lambda a, b: ~a.eqNullSafe(b)), lambda d: d)).cast("long")
    return e.join(other, F.floor(F.col("vec_id") / 2) == F.col("k")).select("vec_id", diff.alias("changed"))


@query("pix04_polarity", "select user_id, avg(floor(value) % 256) < 128 as dark from events group by user_id")
def polarity(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg((F.avg(F.floor("value") % 256) < 128).alias("dark"))


@query("pix05_ink_separator", "with r as (select user_id, event_id % 16 as ray, bool_or(floor(value) % 256 < 110) as hit from events group by 1, 2) select user_id, avg(hit::int) >= 0.5 as separated from r group by user_id")
def ink_separator(spark, sf_dir):
    """Rays across a gap: separated if half of them hit ink."""
    rays = table(spark, sf_dir, "events").groupBy("user_id", (F.col("event_id") % 16).alias("ray")).agg(F.bool_or(F.floor("value") % 256 < 110).alias("hit"))
    return rays.groupBy("user_id").agg((F.avg(F.col("hit").cast("int")) >= 0.5).alias("separated"))


def _page(row: list[float]) -> np.ndarray:
    return (np.abs(np.asarray(row, float)) * 900).astype(int).reshape(8, 8) % 256


def _with_page(spark, sf_dir, f, kind: str):
    def each(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: f(_page(r)))

    return table(spark, sf_dir, "embeddings").select("vec_id", F.pandas_udf(each, kind)("embedding").alias("out"))


@query("pix07_erase_mask")
def erase_mask(spark, sf_dir):
    return _with_page(spark, sf_dir, lambda p: int(pixels.erase_mask(p, p < 60, (1, 1, 6, 6)).sum()), "long")


@query("pix08_flat_colour", "with c as (select user_id, floor(value / 8)::int as v from events), m as (select user_id, median(v) as m, count(*) as n from c group by user_id) select user_id, case when n >= 32 and avg((abs(v - m) <= 8)::int) >= 0.5 then round_even(m, 0)::int end as colour from c join m using (user_id) group by user_id, m, n")
def flat_colour(spark, sf_dir):
    """The median if enough values are near it, half to even; unknown for few values. Medians of small whole numbers are bounded maps."""
    c = table(spark, sf_dir, "events").select("user_id", F.floor(F.col("value") / 8).cast("int").alias("v"))
    m = c.groupBy("user_id").agg(F.expr("percentile(v, 0.5)").alias("m"), F.count("*").alias("n"))
    near = c.join(m, "user_id").groupBy("user_id", "m", "n").agg(F.avg((F.abs(F.col("v") - F.col("m")) <= 8).cast("int")).alias("near"))
    return near.select("user_id", F.when((F.col("n") >= 32) & (F.col("near") >= 0.5), F.bround("m", 0).cast("int")).alias("colour"))


@query("pix09_structure_fill")
def structure_fill(spark, sf_dir):
    mask = np.zeros((8, 8), bool)
    mask[2:5, 2:5] = True
    return _with_page(spark, sf_dir, lambda p: int((pixels.fill(p, mask, p > 200) != p).sum()), "long")


@query("pix10_crops")
def crops(spark, sf_dir):
    """Crops of a page's boxes, a greedy fold per page."""

    def each(rows: pd.Series) -> pd.Series:
        return rows.map(lambda b: pixels.crops([(r["x0"], r["y0"], r["x1"], r["y1"]) for r in sorted(b, key=lambda r: r["id"])]))

    rows = boxes(spark, sf_dir).groupBy("page").agg(F.collect_list(F.struct("id", "x0", "y0", "x1", "y1")).alias("b"))
    return rows.select("page", F.pandas_udf(each, "array<long>")("b").alias("rides_in"))


@query("pix12_erase_method", "select l_orderkey, list_extract(['none', 'fill', 'model'], max(case when l_returnflag = 'R' then 2 when l_returnflag = 'A' then 1 else 0 end)::int + 1) as method from lineitem group by l_orderkey")
def erase_method(spark, sf_dir):
    """Of the methods of a region's parts the strongest."""
    code = F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "A", 1).otherwise(0)
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.get(F.array(*map(F.lit, ["none", "fill", "model"])), F.max(code)).alias("method"))


_ROOM = "x0 = 0 or y0 = 0 as edge, (x1 - x0) * 100 // 170 as filled, (l_area * 7) % 100 as held, (l_area * 3) % 100 as solid, l_area // 300 as times"


@query("pix13_room_decline", f"with {BOXES}, m as (select page, id, {_ROOM} from (select *, (x1 - x0) * (y1 - y0) as l_area from boxes)) select page, id, case when edge then 'window' when filled < 60 then 'fill' when held < 80 then 'containment' when solid < 80 then 'solidity' when times > 20 then 'area' end as declined from m")
def room_decline(spark, sf_dir):
    """Why a flooded room is not used: the first rule that applies."""
    m = boxes(spark, sf_dir).withColumn("l_area", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).selectExpr("page", "id", *[e.replace("//", "div") for e in _ROOM.split(", ")])
    rule = F.when(F.col("edge"), "window").when(F.col("filled") < 60, "fill").when(F.col("held") < 80, "containment").when(F.col("solid") < 80, "solidity").when(F.col("times") > 20, "area")
    return m.select("page", "id", rule.alias("declined"))


@query("pix13_room_flood")
def room_flood(spark, sf_dir):
    return _with_page(spark, sf_dir, lambda p: int(pixels.flood(p, (4, 4), 60).sum()), "long")


@query("pix14_ink_style", "select l_orderkey, case when avg(v) >= 200 and stddev_pop(v) <= 25 then 'plain' when avg(v) < 100 then 'dark' else 'busy' end as style from (select l_orderkey, (l_quantity * 5)::bigint as v from lineitem) group by l_orderkey")
def ink_style(spark, sf_dir):
    """Bounds are held against whole sums: a deviation in doubles depends, at the bound, on the order its rows came in."""
    v = F.rint(F.col("l_quantity") * 5).cast("bigint")
    n, total, squares = (x.cast("decimal(19,0)") for x in (F.count(v), F.sum(v), F.sum(v * v)))
    even = n * squares - total * total <= 625 * n * n
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.when((total >= 200 * n) & even, "plain").when(total < 100 * n, "dark").otherwise("busy").alias("style"))


@query("pix15_raster_metrics")
def raster_metrics(spark, sf_dir):
    """Overflow of set lines over their box, with a fixed advance: (overflow, off the page) per box."""

    def each(frame: pd.DataFrame) -> pd.Series:
        out = []
        for x0, y0, x1, y1 in zip(frame["x0"], frame["y0"], frame["x1"], frame["y1"], strict=True):
            shape = layout.Shape([(x0, y0), (x1, y0), (x1, y1), (x0, y1)], (560, 560))
            lines = shape.at_floor("one two three") or []
            ends = [x + layout.fixed_advance(s, 12) for x, _, s in lines]
            out.append(round(max([0.0, *(e - x1 for e in ends), *(x0 - x for x, _, _ in lines)]), 6))
        return pd.Series(out)

    return boxes(spark, sf_dir).select("page", "id", F.pandas_udf(each, "double")(F.struct("x0", "y0", "x1", "y1")).alias("overflow"))


@query("pix16_ctc_decode", "with s as (select vec_id, unnest(range(1, 65)) as t, unnest(list_transform(embedding, lambda v: case when v > 0.1 then 1 when v > 0 then 2 when v > -0.1 then 0 else 3 end)) as c from embeddings), k as (select *, lag(c) over (partition by vec_id order by t) as p from s) select vec_id, string_agg(c::varchar, '' order by t) as text from k where c <> 0 and c is distinct from p group by vec_id")
def ctc_decode(spark, sf_dir):
    """Best class per step, repeats collapsed, blanks dropped; in the row's own array, without a shuffle."""
    c = F.transform("embedding", lambda v: F.when(v > F.lit(0.1).cast("double"), 1).when(v > 0, 2).when(v > F.lit(-0.1).cast("double"), 0).otherwise(3))
    e = table(spark, sf_dir, "embeddings").select("vec_id", c.alias("c"))
    kept = F.filter("c", lambda x, i: (x != 0) & ((i == 0) | (x != F.get("c", i - 1))))
    return e.select("vec_id", F.array_join(F.transform(kept, lambda x: x.cast("string")), "").alias("text")).where("text <> ''")


@query("pix17_ink_drop", "select l_orderkey, case when count(*) filter (l_quantity < 26) = 0 then 1.0::double else 1 - count(*) filter (l_quantity < 26 and l_discount < 0.03)::double / count(*) filter (l_quantity < 26) end >= 0.8 as erased from lineitem group by l_orderkey")
def ink_drop(spark, sf_dir):
    """Share of dark pixels that went; all of them if there were none."""
    before, after = F.count_if(F.col("l_quantity") < 26), F.count_if((F.col("l_quantity") < 26) & (F.col("l_discount") < 0.03))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.when(before == 0, 1.0).otherwise(1 - after / before) >= 0.8).alias("erased"))


@query("lay01_font_range", "select l_orderkey, greatest(12, round_even(12.0::double * h / 2480, 0))::int as floor, greatest(96, 4 * greatest(12, round_even(12.0::double * h / 2480, 0)))::int as ceiling from (select l_orderkey, sum(l_suppkey)::bigint * 37 as h from lineitem group by 1)")
def font_range(spark, sf_dir):
    h = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.sum("l_suppkey") * 37).alias("h"))
    floor = F.greatest(F.lit(12), F.bround(F.lit(12.0) * F.col("h") / 2480, 0)).cast("int")
    return h.select("l_orderkey", floor.alias("floor"), F.greatest(F.lit(96), 4 * floor).alias("ceiling"))


@query("lay02_text_width", "select doc_id, round(length(t) * 6.0::double + case when length(t) > 0 then -0.02::double * 12 * (length(t) - 1) else 0 end, 6) as width from (select doc_id, text as t from documents)")
def text_width(spark, sf_dir):
    """Advance and tracking between glyphs."""
    n = F.length("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.round(n * F.lit(6.0) + F.when(n > 0, F.lit(-0.02) * 12 * (n - 1)).otherwise(0.0), 6).alias("width"))


def _shape(i: int) -> layout.Shape:
    """The shape of a document; there are 35 of them, each made once a process."""
    return _shape_of(i % 7, i % 5)


@cache
def _shape_of(a: int, b: int) -> layout.Shape:
    w, h = 60 + a * 40, 40 + b * 30
    return layout.Shape([(100, 100), (100 + w, 100), (100 + w * 3 / 4, 100 + h), (100 + w / 4, 100 + h)], (600, 600))


def _laid(spark, sf_dir, f, kind: str):
    """``f(shape, text)`` for each document in a shape that depends on its id; batches are bounded in bytes, not only in rows."""
    small_batches(spark)

    def each(ids: pd.Series, texts: pd.Series) -> pd.Series:
        out = []
        for i, t in zip(ids, texts, strict=True):
            out.append(f(_shape(i), t))
        return pd.Series(out)

    return table(spark, sf_dir, "documents").select("doc_id", F.pandas_udf(each, kind)("doc_id", "text").alias("out"))


@query("lay03_wrap", "with recursive w as (select doc_id, list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda x: x <> '') as ws from documents), f as (select doc_id, ws, 1 as i, 0 as line, 0 as used from w union all select doc_id, ws, i + 1, case when used > 0 and used + 1 + length(ws[i]) <= 40 then line else line + 1 end, case when used > 0 and used + 1 + length(ws[i]) <= 40 then used + 1 + length(ws[i]) else length(ws[i]) end from f where i <= len(ws)) select doc_id, max(line)::int as lines from f group by doc_id")
def wrap(spark, sf_dir):
    """Greedy wrap at a constant width, folded over a row's words."""
    words = F.filter(F.split("text", "[ \n]"), lambda x: x != "")
    fits = lambda a, x: (a["used"] > 0) & (a["used"] + 1 + F.length(x) <= 40)
    step = lambda a, x: F.struct(F.when(fits(a, x), a["line"]).otherwise(a["line"] + 1).alias("line"), F.when(fits(a, x), a["used"] + 1 + F.length(x)).otherwise(F.length(x)).alias("used"))
    return table(spark, sf_dir, "documents").select("doc_id", F.aggregate(words, F.struct(F.lit(0).alias("line"), F.lit(0).alias("used")), step)["line"].alias("lines"))


@query("lay04_layout")
def laid_out(spark, sf_dir):
    return _laid(spark, sf_dir, lambda s, t: "|".join(x for _, _, x in s.layout(t, layout.Setting(12)) or []), "string")


@query("lay05_capacity")
def capacity(spark, sf_dir):
    return _laid(spark, sf_dir, lambda s, t: s.capacity(t), "int")


@query("lay06_ladder")
def ladder(spark, sf_dir):
    return _laid(spark, sf_dir, lambda s, t: "{1}:{2}:{3}".format(*s.ladder(t)), "string")


@query("lay07_truncate")
def truncate(spark, sf_dir):
    return _laid(spark, sf_dir, lambda s, t: ":".join(s.truncate(t)[::-1]), "string")


_FIT = "text string, rung int, size int, rung4_skipped boolean, fit_compromised boolean, fit_failed boolean, retranslated boolean, reply_rejected boolean, reason string"


def _fitted(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([layout.fit(_shape(i), t) for i, t in zip(ids, texts, strict=True)], columns=layout.Fit._fields)


def _answered(ids: pd.Series, texts: pd.Series, replies: pd.Series, fits: pd.DataFrame) -> pd.DataFrame:
    """Fits on rung 5 with the reply to their text, if there is one and it is taken; other fits stay."""

    def one(i, t, r, fit):
        return fit if fit.rung < 5 or pd.isna(r) else layout.shortened(_shape(i), t, r) or fit._replace(reply_rejected=True)

    held = (layout.Fit(*f) for f in fits[list(layout.Fit._fields)].itertuples(index=False))
    return pd.DataFrame([one(*row) for row in zip(ids, texts, replies, held, strict=True)], columns=layout.Fit._fields)


@query("lay08_two_phase")
def two_phase(spark, sf_dir):
    """Regions on rung 5 ask once per page for shorter text, which a caller's function gives; a reply over the cap is not taken and the text is cut.

    Pages are runs of 16 documents; the stand-in for the caller answers with three words, or for odd ids with too much.
    """

    @F.pandas_udf("array<string>")
    def shorten(requests: pd.Series) -> pd.Series:
        return requests.map(lambda page: [" ".join(r["text"].split()[:3]) if r["doc_id"] % 2 == 0 else r["text"] + r["text"] for r in page])

    small_batches(spark)
    rows = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 16).alias("page"), "doc_id", F.col("text").alias("t"))
    # every text is fitted once: a page's rows travel together with their fits, those that ask first
    pages = rows.withColumn("fit", F.pandas_udf(_fitted, _FIT)("doc_id", "t")).groupBy("page").agg(F.sort_array(F.collect_list(F.struct("doc_id", "t", "fit"))).alias("rows"))
    ask = pages.select("page", F.filter("rows", lambda r: r["fit"]["rung"] == 5).alias("asks"), F.filter("rows", lambda r: r["fit"]["rung"] < 5).alias("done"))
    ask = ask.withColumn("reply", shorten(F.transform("asks", lambda r: F.struct(r["doc_id"].alias("doc_id"), r["t"].alias("text")))))
    each = ask.select("page", F.explode(F.arrays_zip(F.concat("asks", "done").alias("row"), "reply")).alias("z")).select("page", "z.row.*", "z.reply")
    asked = F.col("fit.rung") == 5
    return each.select("page", "doc_id", asked.alias("asked"), F.pandas_udf(_answered, _FIT)("doc_id", F.when(asked, F.col("t")), "reply", "fit").alias("fit")).select("page", "doc_id", "asked", "fit.*")


@query("lay09_fit_row")
def fit_row(spark, sf_dir):
    """What is stored of every set region."""
    small_batches(spark)
    rows = table(spark, sf_dir, "documents").select("doc_id", F.pandas_udf(_fitted, _FIT)("doc_id", "text").alias("fit"))
    return rows.select("doc_id", "fit.*")


@query("lay10_glyph_positions", "select doc_id, len(xs) as glyphs, xs[-1] as last, round(list_sum(xs), 3) as total from (select doc_id, list_transform(range(1, length(text) + 1), lambda k: round((k - 1) * (6.0::double - 0.24::double), 6)) as xs from documents)")
def glyph_positions(spark, sf_dir):
    """Glyph by glyph the advances and tracking before it; how many, the last and the sum are given back.

    With a fixed advance the positions of a text are the first of those of a longer one: a batch lays its longest
    text and sums it glyph by glyph, and each text takes its place there.  Only lengths go to Python.
    """

    @F.pandas_udf("last double, total double")
    def placed(n: pd.Series) -> pd.DataFrame:
        xs = np.round(np.arange(n.max()) * (6.0 - 0.24), 6)
        at = n.to_numpy() - 1
        of = lambda values: pd.Series([values[i] if i >= 0 else None for i in at], dtype="Float64")
        return pd.DataFrame({"last": of(xs), "total": of(np.cumsum(xs))})

    rows = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("glyphs"))
    rows = rows.withColumn("p", placed(F.coalesce("glyphs", F.lit(0).cast("long"))))
    return rows.select("doc_id", "glyphs", "p.last", F.round("p.total", 3).alias("total"))
