"""What reviews found: small inputs on which the queries failed, differed from SQL or took far too long."""

import math
import time

import numpy as np
import pytest
from twins import same

from leafmill.functions import geometry
from leafmill.operators import layout, safety
from leafmill.plans import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


def _put(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")


def test_chrf_of_long_texts_ends(spark, tmp_path):
    """Each gram once made the whole list of characters anew: this took the square of a text's length."""
    text = "the quick brown fox, jumps over (the) lazy dog. " * 400
    _put(spark, tmp_path, "conversations", [(1, 0, text), (1, 1, text[:-7] + "cat!")], "conv_id long, turn long, text string")
    began = time.time()
    same(QUERIES["agg08_chrf"](spark, str(tmp_path)), ORACLES["agg08_chrf"], str(tmp_path))
    assert time.time() - began < 60


def test_chrf_of_many_texts_a_side(spark, tmp_path):
    """Every text of a side pairs with every one of the other; null, empty and one-sided ones pair as SQL has it."""
    texts = [(1, 0, "one two (three"), (1, 0, "one two"), (1, 1, "two one, three"), (1, 1, "two"), (1, 1, None), (2, 0, "a cat sat"), (2, 1, "a cat sat down"), (3, 0, "alone"), (4, 0, ""), (4, 1, "x yz"), (5, 0, None), (5, 1, "q r s"), (None, 0, "no key"), (None, 1, "no key"), (6, 2, "later")]
    _put(spark, tmp_path, "conversations", texts, "conv_id long, turn long, text string")
    same(QUERIES["agg08_chrf"](spark, str(tmp_path)), ORACLES["agg08_chrf"], str(tmp_path))


def test_glyph_positions_of_empty_and_null_texts(spark, tmp_path):
    """The last of no positions is null and no error; of a null text all is null."""
    _put(spark, tmp_path, "documents", [(1, ""), (2, None), (3, "abc")], "doc_id long, text string")
    same(QUERIES["lay10_glyph_positions"](spark, str(tmp_path)), ORACLES["lay10_glyph_positions"], str(tmp_path))


def test_ink_style_at_its_bound(spark, tmp_path):
    """A deviation of exactly 25 is within the bound, whatever doubles make of the rows' order; halves go to even."""
    orders = [(1, [50, 40, 40, 50]), (2, [39, 49, 49, 39]), (3, [50, 36, 36, 50]), (4, [0.5, 0.5]), (5, [19.9, 19.9]), (6, [42.0])]
    _put(spark, tmp_path, "lineitem", [(k, float(v)) for k, vs in orders for v in vs], "l_orderkey long, l_quantity double")
    same(QUERIES["pix14_ink_style"](spark, str(tmp_path)), ORACLES["pix14_ink_style"], str(tmp_path))


@pytest.mark.parametrize("name", ["src07_zip_members", "src08_tar_members", "src09_compressed_tar"])
def test_members_of_a_large_archive_come_back(spark, tmp_path, name):
    """An item of more members than the safety budget admits to archives of others."""
    _put(spark, tmp_path, "pages", [(i, f"http://a.example/p/{i}", "") for i in range(safety.MAX_MEMBERS + 10)] + [(-1, "http://b.example/q", "")], "page_id long, url string, html string")
    same(QUERIES[name](spark, str(tmp_path)), ORACLES[name], str(tmp_path))


def test_fit_deals_words_only_where_they_fit(monkeypatch):
    """Whether words fit shows from their ends; lines are made for the setting that is taken, and any metric gives the same."""
    texts = ["one two three", "a " * 9 + "longerword " * 3, "word " * 500, "x" * 300, " lead and tail ", "mid length text of some ten words to be set"]
    points = [(100, 100), (240, 100), (205, 170), (135, 170)]
    slow = layout.Shape(points, (600, 600), lambda text, size: layout.fixed_advance(text, size))
    want = [layout.fit(slow, t, r) for t in texts for r in (None, "a b c", t + t)]
    fast, calls, dealt = layout.Shape(points, (600, 600)), [], layout.Shape._dealt
    monkeypatch.setattr(layout.Shape, "_dealt", lambda *a: calls.append(1) or dealt(*a))
    assert [layout.fit(fast, t, r) for t in texts for r in (None, "a b c", t + t)] == want
    calls.clear()
    assert layout.fit(fast, "word " * 500).rung == 5 and not calls


def test_ellipse_points_of_a_batch():
    """Points of many boxes at once, as each box has them."""
    boxes = np.array([(0, 0, 40, 20), (7, 399, 126, 478), (5, 5, 5, 5)], float)
    xs, ys = geometry.ellipse_points(*boxes.T)
    for (x0, y0, x1, y1), px, py in zip(boxes, xs, ys, strict=True):
        assert px == pytest.approx([(x0 + x1) / 2 + (x1 - x0) / 2 * math.cos(k * math.tau / 64) for k in range(64)])
        assert py == pytest.approx([(y0 + y1) / 2 + (y1 - y0) / 2 * math.sin(k * math.tau / 64) for k in range(64)])
