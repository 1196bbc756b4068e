"""Operators on literal cases, and folds against plain specifications."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon import streaming
from quillon.operators import chunk, graph, layout, match, retrieve
from quillon.sources import html_text, read_collection, write_collection


def test_fusion_of_three_channels(spark):
    rows = [(0, "a", 0, 0), (0, "b", 0, 1), (0, "b", 1, 0), (0, "a", 1, 1), (0, "c", 1, 2), (0, "c", 2, 0), (0, None, 2, 1)]
    df = spark.createDataFrame(rows, "query_id int, chunk_id string, channel int, rank int")
    got = {r["chunk_id"]: round(r["fusion_score"], 6) for r in retrieve.fuse(df).collect()}
    assert got == {"a": 0.013035, "b": 0.012983, "c": 0.008041}
    alone = {r["chunk_id"]: r["fusion_score"] for r in retrieve.fuse(df, (0, 0, 0)).collect()}
    assert alone["c"] == 0 and alone["a"] > alone["b"]


def test_normalise_threshold_and_pages(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (1, 3.0), (2, 5.0), (2, 5.0)], "g int, s double")
    got = sorted((r["g"], r["s"], r["n"]) for r in retrieve.normalise(df, "s", "n", ["g"]).collect())
    assert got == [(1, 2.0, 0.0), (1, 3.0, 0.5), (1, 4.0, 1.0), (2, 5.0, 1.0), (2, 5.0, 1.0)]
    scores = spark.createDataFrame([(1, 1.0), (1, 0.4), (1, 0.0)], "g int, s double")
    kept = lambda floor: retrieve.threshold(scores, "s", 0.5, floor, ["g"], [F.desc("s")]).count()
    assert (kept(2), kept(1)) == (2, 1)
    ten = spark.createDataFrame([(0, i) for i in range(10)], "g int, i int")
    pages = [[(r["i"], r["next_cursor"]) for r in match.page(ten, ["g"], [F.col("i")], F.lit(start), 3).orderBy("i").collect()] for start in (0, 8)]
    assert pages == [[(0, 3), (1, 3), (2, 3)], [(8, None), (9, None)]]


def test_lexical_ranks_keep_documents_without_overlap(spark):
    df = spark.createDataFrame([(0, "a b"), (1, "c"), (2, "B x"), (3, "")], "chunk_id int, text string")
    assert [(r["chunk_id"], r["score"]) for r in retrieve.sparse_channel(df, "a b", 0).orderBy("rank").collect()] == [(0, 2.0), (2, 1.0), (1, 0.0), (3, 0.0)]


def test_graph_score_and_blend(spark):
    rows = [(2, 2, True, False, False, False, 0.68), (9, 9, True, True, True, True, 1.0), (0, 0, False, False, False, False, 0.0)]
    df = spark.createDataFrame(rows, "k int, n int, d boolean, e boolean, c boolean, a boolean, want double")
    out = df.select("want", match.graph_score(*[F.col(c) for c in "kndeca"]).alias("got")).collect()
    assert all(abs(r["want"] - r["got"]) < 1e-9 for r in out)
    two = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.0, 0.0)], "g int, re_score double, graph_score double")
    assert sorted(round(r["final_score"], 6) for r in match.blend(two, ["g"], weights=(0, 0)).collect()) == [0.2, 0.8]


def test_graph_walks(spark):
    edges = spark.createDataFrame([("a", "b", "NEXT"), ("b", "a", "PREV")], "src string, dst string, type string")
    start = spark.createDataFrame([("a",)], "key string")
    assert {(r["node"], r["hop"]) for r in graph.expand(edges, start, 2).collect()} == {("b", 1), ("a", 2)}
    art = spark.createDataFrame([("d", "10", 0, "x"), ("d", "2", 1, "y"), ("d", None, 2, "z")], "doc string, number string, seq int, key string")
    assert {(r["src"], r["dst"]) for r in graph.sequence_edges(art, "doc", "number", "seq", "key").where("type = 'NEXT'").collect()} == {("y", "x"), ("x", "z")}
    old = spark.createDataFrame([("k", 1, "a", "b")], "key string, seq int, p string, q string")
    new = spark.createDataFrame([("k", 2, None, "c")], "key string, seq int, p string, q string")
    assert [tuple(r) for r in graph.upsert(old, new, ["key"], "seq").collect()] == [("k", "a", "c")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=12))
def test_packing_keeps_order_and_limits(sizes):
    paragraphs = [" ".join(["w"] * n) for n in sizes]
    out = chunk.pack(paragraphs, 100, 20, chunk.count_words)
    assert all(n >= 20 and n == chunk.count_words(t) for t, n in out)
    assert all(n <= 100 or "\n\n" not in t for t, n in out)


def test_packing_and_regions():
    w = lambda n: " ".join(["w"] * n)
    assert [n for _, n in chunk.pack([w(300), w(300), w(50)], 512, 100, chunk.count_words)] == [300, 350]
    assert [n for _, n in chunk.split_tokens(f"{w(5)}\n\n{'a b c. ' * 6}", 10, 1, chunk.count_words)][0] == 5
    assert chunk.merge_regions([(1, 0, 5, 0.6), (1, 3, 9, 0.6), (1, 20, 22, 0.6), (1, 21, 30, 0.9)]) == [(1, 0, 9, 0.6), (1, 21, 30, 0.9)]


def test_chapters_tables_and_html(spark):
    text = "front\nChapter 1: One\nbody a\n제 2 장\nbody b"
    docs = spark.createDataFrame([(1, text), (2, "a | b | c\nd | e | f\nplain"), (3, None)], "doc_id long, text string")
    got = [(r["chapter"], r["title"], r["text"]) for r in chunk.chapters(docs).orderBy("place").collect()]
    assert got == [("1", "One", "body a"), ("2", "", "body b")]
    assert [(r["doc_id"], r["first_line"], r["last_line"]) for r in chunk.detect_tables(docs).collect()] == [(2, 0, 1)]
    assert html_text("<p>a<script>x</script> b</p><br>c") == "a\nb\nc" and html_text(None) == ""


def test_article_chunks(spark):
    lines = [(1, i, t) for i, t in enumerate(["전문", "제1조 (목적)", "본문", "제2조", "끝"])]
    out = layout.article_chunks(spark.createDataFrame(lines, "doc int, line int, text string")).orderBy("seq").collect()
    assert [(r["article"], r["text"]) for r in out] == [("?", "전문"), ("1", "제1조 (목적)\n본문"), ("2", "제2조\n끝")]


def test_collection_and_ingestion(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "law", "KR"), ("b", "law", "US"), ("c", "book", "US")], "chunk_id string, doc_type string, country string")
    where = str(tmp_path / "c")
    write_collection(chunks, where)
    write_collection(chunks.where("chunk_id = 'a'"), where)  # replaces its own partition only
    assert {r["chunk_id"] for r in read_collection(spark, where, country="US").collect()} == {"b", "c"}
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    chunks.write.parquet(source)
    for _ in range(2):
        streaming.ingest(spark, source, "chunk_id string, doc_type string, country string", lambda df: df.where("country = 'US'"), out, str(tmp_path / "cp"))
    assert spark.read.parquet(out).count() == 2
