"""Columns and headers of pages of laws, on literal cases."""

from quillon.operators import legal


def test_column_gap_joins_nothing_back(spark):
    """Sizes of pages that are exploded into bins are guessed far too small, so that a join of them was broadcast."""
    two = {*range(14, 20), *range(40, 46)}
    full = {1: two, 2: two | {29, 30}, 3: {*range(10)}, 4: set(), None: two}
    df = spark.createDataFrame([(p, b, 10 * (b in f)) for p, f in full.items() for b in range(60)], "page int, bin int, n int")
    out = legal.column_gap(df, ["page"])
    assert "Join" not in out._jdf.queryExecution().toString()
    assert sorted((r["page"], r["g0"], r["g1"], round(r["mid"], 4)) for r in out.collect()) == [(1, 20, 39, 0.5), (2, 20, 28, 0.4083)]


def test_header_box_of_equally_near_ones(spark):
    """One 5 above and one 5 below the body's top: the upper one, in whatever order they come; a box without a place only where there is no other."""
    heads = [("k", 2, 405.0, 9, 415.0), ("k", 2, 415.0, 9, 425.0), ("n", 1, None, 9, None), ("n", 1, 830.0, 9, 840.0), ("o", 1, None, 9, None)]
    bodies = spark.createDataFrame([("k", 420.0, 842.0), ("n", 420.0, 842.0), ("o", 420.0, 842.0)], "k string, y0 double, height double")
    for rows in (heads, heads[::-1]):
        made = legal.header_box(spark.createDataFrame(rows, "k string, x0 int, y0 double, x1 int, y1 double").coalesce(1), bodies, ["k"])
        assert sorted((r["k"], r["x0"], r["y0"]) for r in made.collect()) == [("k", 2, 405.0), ("n", 1, 830.0), ("o", 1, None)]
