"""Queries over synthetic lines of laws: every order is a line whose text goes by its key, eight lines a page."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators import books, graph, layout, legal
from quillon.plans.requests import choose, choose_sql
from quillon.sources import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


LINES = [
    "제1조 (목적) 모든 국민은 법 앞에 평등하다.",
    "제 2 조 국민의 자유와 권리",
    "Article 3",
    "Article (4) Freedom of speech",
    "① 누구든지 성별에 의하여 차별을 받지 아니한다",
    "② 모든 국민은 신체의 자유를 가진다.",
    "법제처 12",
    "Page 7",
    "17",
    "- - -",
    "which continues in small letters",
    "This sentence ends here.",
    "hyphen-",
    "ated words go on",
    "대한민국 헌법",
    "No State shall make or enforce any law which shall abridge the privileges of citizens",
    "and this goes on",
]


def lines(spark, sf):
    """id, page (eight orders), line and text; the remainder of a product makes pages differ."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") * 7 + F.col("o_orderkey")).alias("k"))
    return o.select("id", F.floor(F.col("id") / 8).alias("page"), (F.col("id") % 8).cast("int").alias("line"), choose(LINES, "k").alias("text"), (F.col("id") % 800).cast("double").alias("y0"), (F.col("id") % 800 + 10).cast("double").alias("y1"))


_L = f"l AS (SELECT o_orderkey AS id, o_orderkey // 8 AS page, (o_orderkey % 8)::INTEGER AS line, {choose_sql(LINES, '(o_custkey * 7 + o_orderkey)')} AS text, (o_orderkey % 800)::DOUBLE AS y0, (o_orderkey % 800 + 10)::DOUBLE AS y1 FROM orders)"
_KO, _EN = r"^\s*제\s*(\d+)\s*조(?:\s|①②③④⑤⑥⑦⑧⑨⑩|$|\(|\[|의|【|〔)", r"(?i)^\s*Article\s*(?:\(?\s*(\d+)\s*\)?\.?\s*$|\(\s*(\d+)\s*\))"
_H = f"nullif(regexp_extract(text, '{_KO}', 1) || regexp_extract(text, '{_EN}', 1) || regexp_extract(text, '{_EN}', 2), '')"
_NOISE = " OR ".join(f"regexp_matches(text, '{p}')" for p in tx.NOISE)
_PAGE = f"WITH {_L}, t AS (SELECT page, string_agg(text, chr(10) ORDER BY line) AS t FROM l GROUP BY page) "


def pages(spark, sf):
    held = F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: s["text"])
    return lines(spark, sf).groupBy("page").agg(F.array_join(held, "\n").alias("t"))


@query(f"WITH {_L} SELECT id, regexp_matches(text, '[가-힣]') AS hangul, regexp_matches(text, '[A-Za-z]') AS latin FROM l")
def f9_scripts(spark, sf):
    return lines(spark, sf).select("id", legal.has_hangul(F.col("text")).alias("hangul"), legal.has_latin(F.col("text")).alias("latin"))


@query(f"WITH {_L} SELECT id, {_H} AS number, nullif(regexp_extract(text, '^\\s*(\\d{{1,2}})[.)\\s]', 1), '') AS lead FROM l")
def f10_headers(spark, sf):
    lead = F.nullif(F.regexp_extract("text", r"^\s*(\d{1,2})[.)\s]", 1), F.lit(""))
    return lines(spark, sf).select("id", tx.header_number(F.col("text")).alias("number"), lead.alias("lead"))


@query(f"""WITH {_L} SELECT id, CASE WHEN regexp_matches(text, '제\\s*\\d+\\s*조') THEN trim(regexp_extract(text, '제\\s*\\d+\\s*조\\s*(?:의\\s*\\d+\\s*)?(.*)$', 1)) ELSE trim(regexp_extract(text, '(?i)Article\\s*\\(?\\s*\\d+\\s*\\)?\\s*(.*)$', 1)) END AS body FROM l WHERE {_H} IS NOT NULL""")
def f11_body_after_header(spark, sf):
    headed = lines(spark, sf).withColumn("n", tx.header_number(F.col("text"))).where("n is not null")
    return headed.select("id", legal.body_after_header(F.col("text"), F.col("n")).alias("body"))


@query(f"WITH {_L} SELECT id FROM l WHERE NOT (({_H} IS NULL AND ({_NOISE})) OR (regexp_matches(text, '^\\s*\\d+\\s*$') AND (y0 < 90 OR y1 > 842 - 90)))")
def f12_without_noise(spark, sf):
    return legal.without_noise(lines(spark, sf).withColumn("height", F.lit(842.0)), "height").select("id")


@query(f"""WITH {_L}, b AS (SELECT *, regexp_matches(text, '^\\s*\\d+\\s*$') OR (length(text) <= 30 AND NOT regexp_matches(text, '[가-힣A-Za-z]')) AS bare, count(*) OVER w AS n, row_number() OVER o AS i FROM l WINDOW w AS (PARTITION BY page), o AS (PARTITION BY page ORDER BY line)),
s AS (SELECT page, CASE WHEN max(bare::INT) FILTER (i = 1) = 0 THEN 0 WHEN max(bare::INT) FILTER (i = 2) = 0 THEN 1 ELSE 2 END AS top, CASE WHEN max(bare::INT) FILTER (i = n) = 0 THEN 0 WHEN max(bare::INT) FILTER (i = n - 1) = 0 THEN 1 ELSE 2 END AS bottom FROM b GROUP BY page)
SELECT id FROM b JOIN s USING (page) WHERE n <= 4 OR (i > top AND i <= n - bottom)""")
def f13_inner_lines(spark, sf):
    return legal.inner_lines(lines(spark, sf), ["page"]).select("id")


def _reflow_sql(goes_on: str, ends: list[str], hyphen: bool) -> str:
    closed = " OR ".join(f"ends_with({'rtrim(a)' if hyphen else 'a'}, '{e.replace(chr(39), chr(39) * 2)}')" for e in ends)
    cut = "WHEN ends_with(a, '-') AND regexp_matches(x, '^[a-z]') THEN a[:-2] || x " if hyphen else ""
    return _PAGE + f"SELECT page, list_reduce(string_split(t, chr(10)), lambda a, x: CASE {cut}WHEN NOT ({closed}) AND regexp_matches(x, '{goes_on}') THEN a || ' ' || x ELSE a || chr(10) || x END) AS t FROM t"


@query(_reflow_sql("^[①②③④⑤⑥⑦⑧⑨⑩a-z]", legal.KO_ENDS, False))
def f14_reflow_korean(spark, sf):
    return pages(spark, sf).select("page", legal.reflow(F.col("t")).alias("t"))


@query(_reflow_sql("^[a-z0-9]", legal.EN_ENDS, True))
def w13_reflow_english(spark, sf):
    return pages(spark, sf).select("page", legal.reflow(F.col("t"), "en").alias("t"))


_BLOCKS = _PAGE + r""", b AS (SELECT page, t, list_filter(list_transform(string_split(regexp_replace(chr(10) || t, '\n(제\s*\d+\s*조(?:\s|\())', chr(1) || '\1', 'g'), chr(1)), lambda p: trim(p, E' \n')), lambda p: regexp_matches(p, '^제\s*\d+\s*조')) AS parts FROM t)"""


@query(_BLOCKS + " SELECT page, CASE WHEN len(parts) = 0 THEN [''] ELSE list_transform(list_filter(parts, lambda p: length(p) >= 10), lambda p: replace(regexp_extract(p, '^제\\s*\\d+\\s*조'), ' ', '')) END AS labels, md5(CASE WHEN len(parts) = 0 THEN trim(t) ELSE array_to_string(list_filter(parts, lambda p: length(p) >= 10), '|') END) AS h FROM b")
def f15_article_blocks(spark, sf):
    b = pages(spark, sf).withColumn("b", legal.blocks(F.col("t")))
    return b.select("page", F.transform("b", lambda x: x["label"]).alias("labels"), F.md5(F.array_join(F.transform("b", lambda x: x["text"]), "|")).alias("h"))


@query(_BLOCKS + " SELECT page, coalesce(list_filter(parts, lambda p: length(p) >= 10 AND regexp_matches(p, '^제\\s*2\\s*조'))[1], trim(t)) AS t FROM b")
def f15_clamp(spark, sf):
    return pages(spark, sf).select("page", legal.clamp(F.col("t"), F.lit("2")).alias("t"))


@query(f"""WITH {_L} SELECT id, CASE WHEN id % 3 = 0 THEN 'bilingual' WHEN id % 3 = 1 THEN 'english_only' ELSE 'korean_only' END AS kind, trim(regexp_replace(replace(text, 'a', chr(160)), '[ \\t\\x{{00A0}}]+', ' ', 'g')) AS line FROM l""")
def f17_text_type(spark, sf):
    ko, en = F.when(F.col("id") % 3 != 1, F.col("text")), F.when(F.col("id") % 3 != 2, F.col("text"))
    return lines(spark, sf).select("id", tx.text_type(ko, en).alias("kind"), tx.line_text(F.translate("text", "a", " ")).alias("line"))


@query(f"""WITH {_L}, x AS (SELECT *, {_H} AS h, coalesce(nullif(regexp_extract(text, '([①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳])', 1), ''), CASE WHEN try_cast(regexp_extract(text, '^\\s*(\\d{{1,2}})[.)\\s]', 1) AS INT) BETWEEN 1 AND 20 THEN regexp_extract(text, '^\\s*(\\d{{1,2}})[.)\\s]', 1) END) AS p FROM l),
y AS (SELECT *, last_value(h IGNORE NULLS) OVER (PARTITION BY page ORDER BY line ROWS UNBOUNDED PRECEDING) AS art FROM x), z AS (SELECT *, h IS NOT NULL OR (p IS NOT NULL AND art IS NOT NULL) AS o FROM y),
s AS (SELECT *, sum(o::INT) OVER (PARTITION BY page ORDER BY line ROWS UNBOUNDED PRECEDING) AS seq FROM z)
SELECT page, seq::BIGINT AS seq, coalesce(max(art), '?') AS article, max(CASE WHEN o AND h IS NULL THEN p END) AS paragraph, string_agg(text, chr(10) ORDER BY line) AS text FROM s GROUP BY page, seq""")
def c4_paragraph_chunks(spark, sf):
    return legal.paragraph_chunks(lines(spark, sf).withColumnRenamed("page", "doc")).withColumnRenamed("doc", "page").select("page", "seq", "article", "paragraph", "text")


@query("SELECT doc_id AS id FROM documents WHERE least(n_chars, 1600) / 1000.0 >= 0.8 AND n_chars >= 200")
def p18_body_pages(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), (F.least("n_chars", F.lit(1600)) / 1000.0).alias("quality"), F.col("n_chars").alias("chars"))
    return legal.body_pages(d).select("id")


@query(f"WITH {_L} SELECT id FROM l WHERE length(text) >= 30 OR id % 4 = 0")
def p19_long_chunks(spark, sf):
    c = lines(spark, sf).select("id", F.when(legal.has_hangul(F.col("text")), F.col("text")).alias("ko"), F.when(~legal.has_hangul(F.col("text")), F.col("text")).alias("en"), F.when(F.col("id") % 4 == 0, "1").alias("article"))
    return legal.long_chunks(c).select("id")


@query(f"""WITH {_L}, s AS (SELECT page, avg(regexp_matches(text, '[가-힣]')::INT) FILTER (line < 4) AS a, avg(regexp_matches(text, '[가-힣]')::INT) FILTER (line >= 4) AS b FROM l GROUP BY page), k AS (SELECT page, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM s)
SELECT page, (a >= .6 AND b >= .6) OR (a < .3 AND b < .3) AS newspaper, CASE WHEN NOT ((a >= .6 AND b >= .6) OR (a < .3 AND b < .3)) THEN CASE WHEN a >= b THEN 'left' ELSE 'right' END END AS korean FROM k""")
def a15_column_kind(spark, sf):
    return legal.column_kind(lines(spark, sf).withColumn("side", F.when(F.col("line") < 4, "left").otherwise("right")), ["page"]).select("page", "newspaper", "korean")


@query(f"""WITH {_L}, x AS (SELECT *, regexp_matches(text, '^\\s*제\\s*\\d+\\s*조(?:\\s|$|\\(|\\[|의|【|〔)')::INT + regexp_matches(text, '(?i)^\\s*Article\\s*\\(?\\s*\\d+\\s*\\)?\\b')::INT AS hit FROM l)
SELECT page, round(greatest(0, sum(hit) * 2.0 + least(avg(length(text)) / 40.0, 2.0) - avg((length(text) <= 12)::INT) * 2.0 + CASE WHEN bool_or(regexp_matches(text, '[가-힣]')) AND bool_or(regexp_matches(text, '[A-Za-z]')) THEN .5 WHEN bool_or(regexp_matches(text, '[가-힣]')) THEN .3 ELSE 0 END), 6)::DOUBLE AS quality FROM x GROUP BY page""")
def a16_legal_quality(spark, sf):
    return layout.page_quality(lines(spark, sf), ["page"]).select("page", F.round("quality", 6).alias("quality"))


def bins(spark, sf):
    """A coverage of 60 bins for each customer: orders spread over two columns with a gap that goes by key."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("page"))
    every = c.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(59))))
    gap = F.col("bin").between(F.col("page") % 30 + 10, F.col("page") % 30 + 10 + F.col("page") % 6) | (F.col("bin") == F.col("page") % 17 + 20)
    return every.select("page", F.col("bin").cast("int").alias("bin"), F.when(gap, 0).when(F.col("page") % 13 == 0, F.when(F.col("bin") < 20, 50).otherwise(1)).otherwise(5).alias("n"))


_BINS = """b AS (SELECT c_custkey AS page, bin::INTEGER AS bin, CASE WHEN bin BETWEEN c_custkey % 30 + 10 AND c_custkey % 30 + 10 + c_custkey % 6 OR bin = c_custkey % 17 + 20 THEN 0 WHEN c_custkey % 13 = 0 THEN CASE WHEN bin < 20 THEN 50 ELSE 1 END ELSE 5 END AS n FROM customer, unnest(range(60)) AS u(bin))"""


@query(f"""WITH {_BINS}, t AS (SELECT *, sum(n) OVER (PARTITION BY page) AS t FROM b), m AS (SELECT *, bin - row_number() OVER (PARTITION BY page ORDER BY bin) AS r FROM t WHERE bin BETWEEN 12 AND 47 AND n <= t * 0.05),
g AS (SELECT page, min(bin) AS g0, max(bin) AS g1 FROM m GROUP BY page, r HAVING count(*) >= 2 QUALIFY row_number() OVER (PARTITION BY page ORDER BY max(bin) - min(bin) DESC, min(bin)) = 1)
SELECT g.page, g0::INTEGER AS g0, g1::INTEGER AS g1, round((g0 + g1 + 1) / 2.0 / 60, 6) AS mid FROM g JOIN t USING (page) GROUP BY ALL HAVING sum(n) FILTER (bin < g0) / sum(n) >= .1 AND sum(n) FILTER (bin > g1) / sum(n) >= .1""")
def c5_column_gap(spark, sf):
    return legal.column_gap(bins(spark, sf), ["page"]).select("page", "g0", "g1", F.round("mid", 6).alias("mid"))


@query("""WITH b AS (SELECT l_orderkey AS k, l_partkey % 500 AS x0, l_partkey % 500 + l_quantity AS x1, l_suppkey % 800 AS y0, l_suppkey % 800 + 12.0 AS y1 FROM lineitem), k AS (SELECT * FROM b WHERE y1 > 45 AND y0 < 797)
SELECT k, min(x0)::DOUBLE AS x0, max(x1)::DOUBLE AS x1, greatest(min(y0), 0)::DOUBLE AS y0, least(max(y1), 797)::DOUBLE AS y1 FROM k GROUP BY k HAVING max(x1) > min(x0) AND least(max(y1), 797) > greatest(min(y0), 0)""")
def a13_edge_boxes(spark, sf):
    li = table(spark, sf, "lineitem")
    b = li.select(F.col("l_orderkey").alias("k"), (F.col("l_partkey") % 500).cast("double").alias("x0"), (F.col("l_partkey") % 500 + F.col("l_quantity")).alias("x1"), (F.col("l_suppkey") % 800).cast("double").alias("y0"), (F.col("l_suppkey") % 800 + 12.0).alias("y1"), F.lit(842.0).alias("height"))
    return legal.edge_boxes(b, ["k"])


@query("""WITH h AS (SELECT l_orderkey AS k, l_linenumber AS x0, (l_partkey * 13 % 800)::DOUBLE AS y0, (l_partkey * 13 % 800 + 10)::DOUBLE AS y1, (l_orderkey % 700)::DOUBLE AS b FROM lineitem),
t AS (SELECT *, b - y1 AS gap, CASE WHEN b - y1 BETWEEN -5 AND 30 THEN 0 WHEN b - y1 BETWEEN -5 AND 50 THEN 1 WHEN b - y1 >= -5 THEN 2 WHEN y0 < 421 THEN 3 ELSE 4 END AS tier FROM h)
SELECT k, x0::INTEGER AS x0, y0 FROM t QUALIFY row_number() OVER (PARTITION BY k ORDER BY tier, CASE WHEN tier <= 2 THEN abs(gap) ELSE y0 END, x0) = 1""")
def c7_header_box(spark, sf):
    li = table(spark, sf, "lineitem")
    y = (F.col("l_partkey") * 13 % 800).cast("double")
    heads = li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("x0"), y.alias("y0"), F.col("l_linenumber").alias("x1"), (y + 10).alias("y1"))
    bodies = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 700).cast("double").alias("y0"), F.lit(842.0).alias("height"))
    return legal.header_box(heads, bodies, ["k"]).select("k", "x0", "y0")


@query("""WITH r AS (SELECT l_orderkey AS k, l_linenumber // 3 AS row, l_linenumber % 3 AS x0, CASE WHEN l_partkey % 50 = 0 THEN 'Total 5' ELSE 'x' END AS text FROM lineitem),
s AS (SELECT k, count(*) AS cells, count(DISTINCT row) AS rows, count(*) FILTER (row = 0) AS cols, count(DISTINCT x0) AS edges, bool_or(text = 'Total 5') AS head FROM r GROUP BY k)
SELECT k, rows, cols, edges, round(cells / (rows * cols)::DOUBLE, 6) AS density, rows >= 2 AND cols >= 2 AND (cells / (rows * cols)::DOUBLE >= .7 OR head) AS "table" FROM s WHERE cols > 0""")
def a20_table_like(spark, sf):
    li = table(spark, sf, "lineitem")
    r = li.select(F.col("l_orderkey").alias("k"), F.floor(F.col("l_linenumber") / 3).alias("row"), (F.col("l_linenumber") % 3).alias("x0"), F.when(F.col("l_partkey") % 50 == 0, "Total 5").otherwise("x").alias("text"))
    return legal.table_like(r, ["k"]).withColumn("density", F.round("density", 6))


@query("""WITH r AS (SELECT l_orderkey AS k, l_partkey % 100 AS a, l_partkey % 100 + l_quantity AS b FROM lineitem), m AS (SELECT *, max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
i AS (SELECT *, sum((a > coalesce(reach, -1))::INT) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM m) SELECT k, min(a)::BIGINT AS first, max(b) AS last, count(*)::BIGINT AS parts FROM i GROUP BY k, i.i""")
def w9_merged_intervals(spark, sf):
    r = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_partkey") % 100).alias("first"), (F.col("l_partkey") % 100 + F.col("l_quantity")).alias("last"))
    return legal.merged_intervals(r, ["k"])


# ---- graphs of articles


def chunks(spark, sf):
    t = table(spark, sf, "conversations")
    number = F.when(F.col("turn") % 5 != 4, F.col("turn").cast("string"))
    return t.select(F.col("conv_id").cast("string").alias("doc"), F.lit("KR").alias("country"), F.col("conv_id").cast("string").alias("version"), F.col("turn").cast("int").alias("seq"), number.alias("article"), F.lit(None).cast("string").alias("paragraph"), choose(LINES, "turn").alias("ko"), F.col("role").alias("en"))


_WORDS = "k(concept, word) AS (VALUES " + ", ".join(f"('{c}', '{w}')" for c, ws in tx.CONCEPTS.items() for w in ws) + ")"


@query(f"""WITH {_WORDS}, a AS (SELECT conv_id::VARCHAR AS doc, turn, 'KR:' || conv_id || ':' || CASE WHEN turn % 5 <> 4 THEN turn::VARCHAR ELSE conv_id || ':' || turn END AS key, CASE WHEN turn % 5 <> 4 THEN turn ELSE 100000 + turn END AS o, {choose_sql(LINES, 'turn')} AS text FROM conversations),
n AS (SELECT key AS src, lead(key) OVER (PARTITION BY doc ORDER BY o, turn, key) AS dst FROM a)
SELECT DISTINCT 'KR' AS src, doc AS dst, 'HAS_DOCUMENT' AS type FROM a UNION ALL SELECT DISTINCT doc, key, 'HAS_ARTICLE' FROM a UNION ALL SELECT DISTINCT key, 'ko:' || concept, 'RELATES_TO_CONCEPT' FROM a JOIN k ON contains(lower(text), word)
UNION ALL SELECT DISTINCT src, dst, 'NEXT' FROM n WHERE dst IS NOT NULL UNION ALL SELECT DISTINCT dst, src, 'PREV' FROM n WHERE dst IS NOT NULL""")
def g8_build_graph(spark, sf):
    return graph.build(chunks(spark, sf))[1]


@query(f"""WITH {_WORDS}, {_L} SELECT id, coalesce(list_sort(list(DISTINCT concept) FILTER (concept IS NOT NULL)), []) AS tags FROM l LEFT JOIN k ON contains(lower(text), word) GROUP BY id""")
def g9_concept_tag(spark, sf):
    return lines(spark, sf).select("id", F.array_sort(tx.concepts(F.col("text"), fold=True)).alias("tags"))


@query("""WITH m AS (SELECT o_custkey % 100 AS a, o_orderstatus AS c, o_orderkey % 500 AS k, o_totalprice AS s, row_number() OVER (PARTITION BY o_custkey % 100 ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders),
t AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY a, c ORDER BY place, k) <= 3) SELECT a::VARCHAR AS src, k::VARCHAR AS dst, arg_max(s, place) AS score, 'COMPARES_TO' AS type FROM t GROUP BY a, k""")
def g10_save_pairs(spark, sf):
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 100).alias("a"), F.col("o_orderstatus").alias("country"), (F.col("o_orderkey") % 500).alias("k"), F.col("o_totalprice").alias("score"), "o_orderkey")
    placed = o.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "o_orderkey")))
    return graph.save_pairs(placed.select(F.col("a").cast("string").alias("anchor_key"), "country", F.col("k").cast("string").alias("key"), "score", "place"))


# ---- books: a document's words, broken into lines, with headings that go by key

_HEADS = ["Chapter 1: The start", "Section 2.1 - Ways", "# Notes", "plain", "제 2 장 국민", "[1] first note", "Contents", "Chapter 3 End ..... 12", "Preface", "Appendix A", "[2] other", "CHAPTER IV", "References", "## More"]


def book_lines(spark, sf):
    """doc, line, text: an order is a line."""
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 400).alias("doc"), F.col("o_orderkey").alias("line"), (F.col("o_orderkey") + F.col("o_custkey")).alias("k"))
    return o.select("doc", "line", choose(_HEADS, "k").alias("text"))


_B = f"b AS (SELECT o_custkey % 400 AS doc, o_orderkey AS line, {choose_sql(_HEADS, '(o_orderkey + o_custkey)')} AS text FROM orders)"


@query(f"""WITH {_B}, m AS (SELECT doc, line, nullif(regexp_extract(text, '^(?:Chapter|CHAPTER)\\s+(\\d+|[IVX]+)(?:\\s*[:\\-]\\s*(?:.+?))?$', 1), '') AS en, nullif(regexp_extract(text, '^제\\s*(\\d+)\\s*장', 1), '') AS ko, text FROM b),
s AS (SELECT *, sum((coalesce(en, ko) IS NOT NULL)::INT) OVER (PARTITION BY doc ORDER BY line ROWS UNBOUNDED PRECEDING) AS place FROM m)
SELECT doc, place::BIGINT AS place, max(coalesce(en, ko)) AS chapter, count(*)::BIGINT AS lines FROM s WHERE place > 0 GROUP BY doc, place""")
def c11_chapter_split(spark, sf):
    return books.chapter_lines(book_lines(spark, sf)).groupBy("doc", "place").agg(F.max("chapter").alias("chapter"), F.count(F.lit(1)).alias("lines"))


@query(f"""WITH {_B}, m AS (SELECT *, regexp_extract(text, '^(#+)\\s+(.+?)$', 1) AS marks, regexp_extract(text, '^(#+)\\s+(.+?)$', 2) AS head, regexp_extract(text, '(?i)^(?:Section|섹션)\\s+(\\d+(?:\\.\\d+)*)(?:\\s*[:\\-]\\s*(.+?))?$', 1) AS num, regexp_extract(text, '(?i)^(?:Section|섹션)\\s+(\\d+(?:\\.\\d+)*)(?:\\s*[:\\-]\\s*(.+?))?$', 2) AS name FROM b)
SELECT doc, line, CASE WHEN marks <> '' THEN length(marks) ELSE 2 END::INTEGER AS level, CASE WHEN marks <> '' THEN head WHEN name <> '' THEN 'Section ' || num || ': ' || name ELSE 'Section ' || num END AS title FROM m WHERE marks <> '' OR num <> ''""")
def c12_sections(spark, sf):
    return books.sections(book_lines(spark, sf)).select("doc", "line", "level", "title")


@query(f"""WITH {_B}, n AS (SELECT doc, line, regexp_extract(text, '^\\[(\\d+)\\]\\s*(.+?)$', 1) AS k, regexp_extract(text, '^\\[(\\d+)\\]\\s*(.+?)$', 2) AS note FROM b) SELECT doc, k AS number, arg_max(note, line) AS note FROM n WHERE k <> '' GROUP BY doc, k""")
def a18_footnotes(spark, sf):
    return books.footnotes(book_lines(spark, sf))


@query(f"""WITH {_B}, h AS (SELECT doc, min(line) FILTER (regexp_matches(text, '(?i)^(?:목차|Contents|TABLE OF CONTENTS)$')) AS toc FROM b GROUP BY doc), e AS (SELECT doc, min(line) AS stop FROM b JOIN h USING (doc) WHERE line > toc AND regexp_matches(text, '^((Chapter|CHAPTER)\\s+(\\d+|[IVX]+)(\\s*[:\\-]\\s*.+)?|제\\s*\\d+\\s*장.*)$') GROUP BY doc)
SELECT b.doc, line, regexp_extract(text, '^(?:Chapter|제)\\s*(\\d+|[IVX]+)[:\\.\\s]+(.+?)\\s+\\.{{2,}}\\s*(\\d+)$', 1) AS chapter, regexp_extract(text, '^(?:Chapter|제)\\s*(\\d+|[IVX]+)[:\\.\\s]+(.+?)\\s+\\.{{2,}}\\s*(\\d+)$', 2) AS title, regexp_extract(text, '^(?:Chapter|제)\\s*(\\d+|[IVX]+)[:\\.\\s]+(.+?)\\s+\\.{{2,}}\\s*(\\d+)$', 3)::INTEGER AS page
FROM b JOIN h USING (doc) LEFT JOIN e USING (doc) WHERE line > toc AND line < coalesce(stop, line + 1) AND regexp_matches(text, '^(?:Chapter|제)\\s*(\\d+|[IVX]+)[:\\.\\s]+(.+?)\\s+\\.{{2,}}\\s*(\\d+)$')""")
def c10_toc(spark, sf):
    return books.contents(book_lines(spark, sf))


@query(f"""WITH {_B} SELECT doc, line, CASE WHEN regexp_matches(text, '(?i)^(Preface|서문|머리말|프롤로그)$') THEN 'preface' WHEN regexp_matches(text, '(?i)^(Epilogue|에필로그|맺음말|후기)$') THEN 'epilogue' WHEN regexp_matches(text, '(?i)^(Appendix|부록)\\s*([A-Z]|\\d+)?(\\s*[:\\-]\\s*.+)?$') THEN 'appendix' WHEN regexp_matches(text, '(?i)^(References|참고문헌|Bibliography)$') THEN 'references' WHEN regexp_matches(text, '(?i)^(Index|색인)$') THEN 'index' END AS part FROM b""")
def c15_book_parts(spark, sf):
    return book_lines(spark, sf).select("doc", "line", books.part_of(F.col("text")).alias("part"))


@query()
def c1_book_chunks(spark, sf):
    """Every document as a book: by chapters, else by pages' sections, else packed paragraphs."""
    return books.book_chunks(table(spark, sf, "documents").select("doc_id", F.lit(1).alias("page"), "text"))
