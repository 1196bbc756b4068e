"""Chunks of whole books, in tasks that read many of them."""

from quillon.operators import books


def test_books_in_tasks(spark):
    """Books one after the other: no call for each, pages in any order, and a book longer than an Arrow batch."""
    first = [(1, p, f"Chapter {p}\nword {p}" if p % 2 else f"more {p}") for p in range(7, 0, -1)]
    rows = [*first, *[(d, 1, f"# Title {d}\nbody {d}") for d in range(2, 40)], (40, 1, None), (None, 1, "# lost\nbody"), (41, 1, "one\n\ntwo")]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "3")
    try:
        out = books.book_chunks(spark.createDataFrame(rows, "doc_id bigint, page int, text string").repartition(5))
        plan = out._jdf.queryExecution().toString()
        got = sorted((r["doc_id"], r["place"], r["kind"], r["heading"], r["text"]) for r in out.collect())
    finally:
        spark.conf.set(name, before)
    pages = {d: sorted((p, t or "") for x, p, t in rows if x == d) for d in range(1, 42)}
    assert got == [(d, i, *m) for d, held in pages.items() for i, m in enumerate(books.book(held))]
    assert [x[2:4] for x in got if x[0] == 1] == [("full_chapter", str(p)) for p in (1, 3, 5, 7)]
    assert "FlatMapGroupsInPandas" not in plan
