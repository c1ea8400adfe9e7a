"""Operators that have no SQL form: fixtures, properties and brute force."""

import itertools
import random
import tarfile
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.engine import BadRequest, Engine
from leafmill.operators import grouping, layout, pixels, safety
from leafmill.sources import archives


def test_hull_encloses_and_is_convex():
    rng = random.Random(1)
    for _ in range(50):
        pts = [(rng.randint(0, 20), rng.randint(0, 20)) for _ in range(12)]
        h = grouping.hull(pts)
        for (ax, ay), (bx, by) in zip(h, h[1:] + h[:1], strict=True):
            assert all((bx - ax) * (y - ay) - (by - ay) * (x - ax) >= 0 for x, y in pts)


def test_greedy_dedupe_dropped_box_drops_none():
    a, b, c = ({"id": i, "x0": x, "y0": 0, "x1": x + 100, "y1": 20} for i, x in ((1, 0), (2, 15), (3, 30)))
    assert grouping._same(a, b) and grouping._same(b, c) and not grouping._same(a, c)
    import pandas as pd

    assert list(grouping._greedy_keep_of(pd.Series([[a, b, c]]))) == [[1, 3]]


def test_layout_is_monotone():
    shape = layout.Shape([(10, 10), (210, 10), (170, 120), (50, 120)], (400, 2480))
    text = "the quick brown fox jumps over the lazy dog and runs away from the hill again " * 3
    fits = [bool(shape.at_floor(text[:n])) for n in range(1, len(text) + 1)]
    assert fits == sorted(fits, reverse=True)
    assert shape.capacity(text) == sum(fits)


def test_ladder_rungs_and_truncation():
    wide = layout.Shape([(100, 100), (400, 100), (400, 300), (100, 300)], (600, 2480))
    assert wide.ladder("short")[1] == 1
    small = layout.Shape([(100, 100), (130, 100), (130, 115), (100, 115)], (600, 2480))
    lines, rung, skipped, _ = small.ladder("much too long for so small a box")
    assert (lines, rung, skipped) == (None, 5, False)
    edge = layout.Shape([(0, 100), (30, 100), (30, 115), (0, 115)], (600, 2480))
    assert edge.ladder("much too long for so small a box")[2]
    assert small.truncate("verylongtoken")[0].endswith("…")
    assert small.truncate("averylongword anotherverylongword") == ("", "no whole word fits")


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32 - 1))
def test_fill_leaves_the_rest_alone(seed):
    rng = np.random.default_rng(seed)
    page, mask = rng.integers(0, 256, (12, 12)), np.zeros((12, 12), bool)
    mask[4:8, 4:8] = True
    out = pixels.fill(page, mask, page > 200)
    assert (out[~mask] == page[~mask]).all()


def test_grow_and_flood():
    m = np.zeros((5, 5), bool)
    m[2, 2] = True
    assert pixels.grow(m).sum() == 9
    page = np.zeros((5, 5), int)
    page[:, 2] = 255
    assert pixels.flood(page, (0, 0)).sum() == 10


def test_crops_ride_along():
    assert pixels.crops([(0, 0, 100, 100), (10, 10, 20, 20), (5000, 0, 5010, 10)]) == [0, 0, 2]


HOSTILE = {"slip.cbz": ("../x.png", "parent-traversal"), "abs.cbz": ("/x.png", "absolute-path"), "drive.cbz": ("C:x.png", "drive-letter")}


def test_members_budget_and_reasons(spark, tmp_path):
    for name, (member, _) in HOSTILE.items():
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr(member, b"x")
    with zipfile.ZipFile(tmp_path / "bomb.cbz", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.png", bytes(1 << 20))
    with zipfile.ZipFile(tmp_path / "good.cbz", "w") as z:
        for n in (10, 9):
            z.writestr(f"p{n}.png", b"data")
    with tarfile.open(tmp_path / "link.cbt", "w:gz") as t:
        i = tarfile.TarInfo("l.png")
        i.type, i.linkname = tarfile.SYMTYPE, "/etc/passwd"
        t.addfile(i)
    (tmp_path / "x.cb7").write_bytes(bytes.fromhex("377ABCAF271C0000"))
    (tmp_path / "x.cbr").write_bytes(b"")
    rows = archives.read_members(spark, str(tmp_path)).collect()
    refused = {r.item: r.refused for r in rows if r.refused}
    assert refused == {n: why for n, (_, why) in HOSTILE.items()} | {"bomb.cbz": "ratio-cap", "link.cbt": "link-entry", "x.cb7": "7z reader unavailable", "x.cbr": "unrecognised archive signature"}
    assert [(r.member, bytes(r.content)) for r in rows if r.item == "good.cbz"] == [("p10.png", b"data"), ("p9.png", b"data")]
    capped = archives.read_members(spark, str(tmp_path), members=1).where("item = 'good.cbz'").collect()
    assert [r.refused for r in capped] == ["member-count"]


def test_escape_backstop(spark):
    from pyspark.sql import functions as F

    cases = {"a/../../x": True, "a/../x": False, "/x": True, "C:/x": True, "a/b": False, "..\\x": True}
    df = spark.createDataFrame([(k,) for k in cases], "n string")
    assert {r.n: r.e for r in df.select("n", safety.depth_escapes(F.col("n")).alias("e")).collect()} == cases


def test_natural_order(spark):
    from pyspark.sql import functions as F

    from leafmill.functions import names

    want = ["ch1/p1", "ch1/p2", "ch1/p9", "ch1/p10", "ch2/p1", "ch2/p2", "ch10/p1", "ch10/p2"]
    df = spark.createDataFrame([(w,) for w in sorted(want)], "n string")
    assert [r.n for r in df.orderBy(names.natural_key(F.col("n"))).collect()] == want


def test_zip_round_trip(spark, tmp_path):
    rows = [("a.cbz", i, f"p{i}.png", bytes([i])) for i in range(5)] + [("b.cbz", 0, "x.png", b"")]
    made = archives.write_archives(spark.createDataFrame(rows, "item string, place int, name string, content binary"), str(tmp_path / "out"))
    assert {r.item: r.entries for r in made.collect()} == {"a.cbz": 5, "b.cbz": 1}
    got = archives.read_members(spark, str(tmp_path / "out")).collect()
    assert [(r.item, r.member, bytes(r.content)) for r in got] == [(i, n, c) for i, _, n, c in rows]


def test_engine_errors(spark):
    e = Engine(spark)
    with pytest.raises(BadRequest):
        e.run_job()
    with pytest.raises(Exception, match="no detector"):
        e.detect(None)
    assert e.health()["ok"] and not e.models()["detect"]


def test_page_labels_against_closure():
    rng = random.Random(2)
    ids = list(range(12))
    edges = [tuple(sorted(rng.sample(ids, 2))) for _ in range(8)]
    got = grouping._label(ids, [a for a, _ in edges], [b for _, b in edges])
    reach = {i: {i} for i in ids}
    for _ in ids:
        for a, b in itertools.chain(edges, [(b, a) for a, b in edges]):
            reach[a] |= reach[b]
    assert got == [min(reach[i]) for i in ids]


def test_tar_writer_and_comicinfo_first(spark, tmp_path):
    from leafmill.sources import archives

    rows = [("a.cbt", 1, "p1.png", bytearray(b"one")), ("a.cbt", 2, "p2.png", bytearray(b"two" * 400)), ("a.cbt", 3, "ComicInfo.xml", bytearray(b"<x/>"))]
    for kind in ("tar", "tar.gz", "tar.bz2", "tar.xz", "zip"):
        folder = str(tmp_path / kind)
        assert archives.write_archives(spark.createDataFrame(rows, "item string, place int, name string, content binary"), folder, kind).collect()[0].entries == 3
        back = sorted(archives.read_members(spark, folder).collect(), key=lambda r: r.position)
        assert [(r.member, bytes(r.content), r.refused) for r in back] == [("ComicInfo.xml", b"<x/>", None), ("p1.png", b"one", None), ("p2.png", b"two" * 400, None)]


def test_fit_takes_a_short_reply_and_rejects_a_long_one():
    small = layout.Shape([(100, 100), (150, 100), (150, 130), (100, 130)], (600, 2480))
    long = "words that do not fit into so small a box at all"
    assert layout.fit(small, "ok").rung == 1
    assert layout.fit(small, long, "ok ok")[6:8] == (True, False) and layout.fit(small, long, "ok ok").text == "ok ok"
    rejected = layout.fit(small, long, long * 3)
    assert rejected.reply_rejected and rejected.rung == 5 and long.startswith(rejected.text) and rejected.reason == layout.REASONS["cut"]
    assert layout.fit(small, long)[6:8] == (False, False)


def test_bands_are_exact():
    """A notch between two samples of a line is seen; of two runs the wider, of equal ones the left."""
    notched = layout.Bands([(0, 0), (100, 0), (100, 49), (40, 50), (100, 51), (100, 100), (0, 100)])
    assert notched.free(0, 40) == (0, 100) and notched.free(45, 55)[1] == pytest.approx(40)
    two = layout.Bands([(0, 0), (100, 0), (100, 100), (60, 100), (60, 50), (40, 50), (40, 100), (0, 100)])
    assert two.free(60, 90) == (0, 40) and two.free(10, 40) == (0, 100) and two.free(90, 110) is None
