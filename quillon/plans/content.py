"""Text, catalogue, layout, chunking, presentation and state queries with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon import streaming
from quillon.functions import text as tx
from quillon.operators import chunk, layout, match, present
from quillon.sources import delete_where, read_html, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def questions(spark, sf):
    """Synthetic queries over the article grammar, made from keys in both engines."""
    n = F.col("c_custkey")
    q = F.when(n % 4 == 0, F.concat(F.lit("제 "), (n % 90).cast("string"), F.lit(" 조 은 무엇"))).when(n % 4 == 1, F.concat(F.lit("제"), (n % 9).cast("string"), F.lit("조와 제"), (n % 7 + 10).cast("string"), F.lit("조 비교")))
    q = q.when(n % 4 == 2, F.lit("표현의 자유 는 평등")).otherwise(F.concat(F.lit("Article ("), n.cast("string"), F.lit(") text")))
    return table(spark, sf, "customer").select(n.alias("id"), q.alias("q"))


_Q = """q AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN '제 ' || c_custkey % 90 || ' 조 은 무엇' WHEN 1 THEN '제' || c_custkey % 9 || '조와 제' || c_custkey % 7 + 10 || '조 비교' WHEN 2 THEN '표현의 자유 는 평등' ELSE 'Article (' || c_custkey || ') text' END AS q FROM customer)""".replace("c_custkey % 7 + 10", "(c_custkey % 7 + 10)").replace("c_custkey % 90", "(c_custkey % 90)").replace("c_custkey % 9 ", "(c_custkey % 9) ")


@query("WITH " + _Q + r""" SELECT id, list_sort(list_transform(list_distinct(list_concat(regexp_extract_all(q, '제\s*(\d+)\s*조', 1), regexp_extract_all(q, '(?i)Article\s*\(?\s*(\d+)\s*\)?', 1))), lambda x: x::INTEGER)) AS numbers FROM q""")
def f2_article_numbers(spark, sf):
    return questions(spark, sf).select("id", tx.article_numbers(F.col("q")).alias("numbers"))


@query("WITH " + _Q + r""", a AS (SELECT id, q, list_distinct(regexp_extract_all(q, '제\s*(\d+)\s*조', 1)) AS n FROM q)
SELECT id, CASE WHEN len(n) = 1 THEN 'exact_article' WHEN len(n) > 1 THEN 'multi_article' WHEN id % 4 = 2 THEN 'concept' ELSE 'hybrid' END AS strategy, CASE WHEN id % 4 = 2 THEN ['평등권', '자유권', '기본권'] ELSE []::VARCHAR[] END AS concepts FROM a""")
def f1_query_analysis(spark, sf):
    a = tx.analysis(F.col("q"))
    return questions(spark, sf).select("id", a["search_strategy"].alias("strategy"), a["concept_keywords"].alias("concepts"))


@query("WITH " + _Q + r""" SELECT id, trim(regexp_replace(regexp_replace(q, '제\s*(\d+)\s*조', '제\1조', 'g'), '\s+(은|는|이|가|을|를|에|에서|대해|관해|에대해)\s+', ' ', 'g')) AS q FROM q""")
def f5_canonicalise(spark, sf):
    return questions(spark, sf).select("id", tx.canonical(F.col("q")).alias("q"))


@query("WITH " + _Q + r""" SELECT id, list_sort(list_distinct(list_filter(string_split_regex(q, '\s+'), lambda w: length(w) >= 2 AND regexp_matches(w, '[가-힣]')))) AS words FROM q""")
def f6_keywords(spark, sf):
    return questions(spark, sf).select("id", tx.keywords(F.col("q")).alias("words"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS h FROM documents")
def f7_whitespace(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.collapse(F.col("text"))).alias("h"))


_EDGES = "E' \\t\\n\\r' || chr(11) || chr(12)"


@query(f"WITH t AS (SELECT doc_id, text, trim(coalesce(text, ''), {_EDGES}) AS kept FROM documents) SELECT doc_id, CASE WHEN length(kept) > 400 THEN substr(kept, 1, 400) || '...[TRUNCATED]' ELSE kept END AS shown, CASE WHEN length(text) > 1000 THEN length(substr(text, 1, 980) || ' ...[truncated]') ELSE length(text) END::INTEGER AS stored FROM t")
def f19_truncate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.truncate(F.col("text"), 400, "...[TRUNCATED]").alias("shown"), F.length(tx.fit(F.col("text"), 1000)).alias("stored"))


@query("SELECT doc_id, lang || '_' || doc_id || '_' || substr(sha256(text), 1, 8) AS file_id, 'book_' || substr(md5(lang || '_' || source || '_' || doc_id), 1, 8) AS book_id FROM documents")
def f20_hash_ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.concat_ws("_", "lang", "doc_id", F.substring(F.sha2("text", 256), 1, 8)).alias("file_id"), F.concat(F.lit("book_"), F.substring(F.md5(F.concat_ws("_", "lang", "source", F.col("doc_id").cast("string"))), 1, 8)).alias("book_id"))


@query("SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events")
def p9_json_coerce(spark, sf):
    m = F.coalesce(F.from_json("props", "map<string,string>"), F.create_map().cast("map<string,string>"))
    return table(spark, sf, "events").select("event_id", F.coalesce(F.get(F.map_values(F.map_filter(m, lambda k, v: k == "k")), F.lit(0)).try_cast("bigint"), F.lit(0)).cast("bigint").alias("k"))


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '7'")
def p1_metadata_equality(spark, sf):
    """The key is promoted to a column first, as a path into JSON is never pushed to the scan."""
    return table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k")).where("k = '7'").select("event_id")


@query("SELECT doc_id FROM documents WHERE lang <> 'en' AND source = 'src1'")
def p3_exclude_country(spark, sf):
    d = table(spark, sf, "documents")
    return d.where(~F.col("lang").eqNullSafe("en") & (F.col("source") == "src1")).select("doc_id")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'none' ELSE lang END AS t FROM documents")
def p12_text_fallback(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", tx.first_text(F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")), F.lit("none")).alias("t"))


@query("SELECT conv_id, turn, '제' || conv_id || '조' || CASE WHEN turn > 1 THEN ' ' || turn || '항' ELSE '' END AS path, 'KR:' || CASE WHEN conv_id % 2 = 0 THEN '1987' ELSE 'latest' END || ':' || conv_id || CASE WHEN turn > 1 THEN ':' || turn ELSE '' END AS id FROM conversations")
def p17_display_path(spark, sf):
    c = table(spark, sf, "conversations")
    p = F.when(F.col("turn") > 1, F.col("turn").cast("string"))
    v = F.when(F.col("conv_id") % 2 == 0, "1987")
    return c.select("conv_id", "turn", tx.display_path(F.col("conv_id"), p).alias("path"), tx.article_id(F.lit("KR"), v, F.col("conv_id"), p, F.lit(None), F.lit(None)).alias("id"))


_FILES = "f AS (SELECT n_nationkey AS k, upper(substr(n_name, 1, 2)) || CASE n_nationkey % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '_v19' || (10 + n_nationkey) || '.pdf' ELSE '_2023-12-01.pdf' END AS name FROM nation)"


def files(spark, sf):
    n = F.col("n_nationkey")
    tail = F.when(n % 3 == 0, ".pdf").when(n % 3 == 1, F.concat(F.lit("_v19"), (n + 10).cast("string"), F.lit(".pdf"))).otherwise("_2023-12-01.pdf")
    return table(spark, sf, "nation").select(n.alias("k"), F.concat(F.upper(F.substring("n_name", 1, 2)), tail).alias("name"))


@query("WITH " + _FILES + " SELECT k, CASE WHEN substr(name, 1, 2) IN ('AL', 'BR', 'CA', 'NA') THEN substr(name, 1, 2) END AS code FROM f")
def s17_country_from_name(spark, sf):
    return files(spark, sf).select("k", tx.country_of_file(F.col("name"), ["AL", "BR", "CA", "NA"]).alias("code"))


@query("WITH " + _FILES + " SELECT k, CASE k % 3 WHEN 1 THEN '19' || (10 + k) WHEN 2 THEN '2023' END AS version FROM f")
def s18_version_from_name(spark, sf):
    return files(spark, sf).select("k", tx.version_of_file(F.col("name")).alias("version"))


@query("SELECT p_partkey AS page, (p_size * 150 / 72.0)::DOUBLE AS raw, trunc(p_size * 10.0 * 150 / 72)::INTEGER AS px FROM part")
def s20_page_dims(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("page"), (F.col("p_size") * 150 / 72.0).cast("double").alias("raw"), tx.pixels(F.col("p_size") * 10.0, 150).alias("px"))


# ---- catalogue


@query("SELECT o_custkey AS doc, count(*) AS chunks, arg_min(o_orderstatus, o_orderkey) AS status, max(o_orderdate) AS indexed FROM orders GROUP BY o_custkey ORDER BY indexed DESC, doc LIMIT 100")
def a3_document_list(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("doc")).agg(F.count(F.lit(1)).alias("chunks"), F.min_by("o_orderstatus", "o_orderkey").alias("status"), F.max("o_orderdate").alias("indexed"))
    return o.orderBy(F.desc("indexed"), "doc").limit(100)


@query("SELECT n_name AS country, count(*) AS articles FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY n_name ORDER BY articles DESC, country")
def a4_country_counts(spark, sf):
    n, c, o = table(spark, sf, "nation"), table(spark, sf, "customer"), table(spark, sf, "orders")
    per = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))  # counted before the joins
    j = per.join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    return j.groupBy(F.col("n_name").alias("country")).agg(F.sum("n").alias("articles")).orderBy(F.desc("articles"), "country")


@query("SELECT r_name AS continent, count(*) AS countries, list_sort(list(n_name)) AS names, (SELECT count(*) FROM documents) AS total_chunks FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def a8_continent_stats(spark, sf):
    j = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 5 regions
    total = table(spark, sf, "documents").agg(F.count(F.lit(1)))
    return j.groupBy(F.col("r_name").alias("continent")).agg(F.count(F.lit(1)).alias("countries"), F.array_sort(F.collect_list("n_name")).alias("names")).withColumn("total_chunks", total.scalar())


@query("SELECT p_partkey AS id, (SELECT count(*) FROM part WHERE p_brand = 'Brand#13') AS total FROM part WHERE p_brand = 'Brand#13' ORDER BY p_partkey LIMIT 10 OFFSET 5")
def p7_catalog_page(spark, sf):
    p = table(spark, sf, "part").where("p_brand = 'Brand#13'")
    return p.orderBy("p_partkey").offset(5).limit(10).select(F.col("p_partkey").alias("id"), p.agg(F.count(F.lit(1))).scalar().alias("total"))


@query("SELECT l_orderkey AS doc, l_linenumber AS line FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def s9_delete_anti(spark, sf):
    gone = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("doc"))
    return delete_where(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("line")), gone, "doc")


@query("SELECT count(*) FILTER (event_type = 'click') AS ok, count(*) FILTER (event_type <> 'click') AS failed FROM events")
def a10_batch_counts(spark, sf):
    return table(spark, sf, "events").agg(F.count_if(F.col("event_type") == "click").alias("ok"), F.count_if(F.col("event_type") != "click").alias("failed"))


@query("SELECT coalesce(CASE WHEN doc_id % 5 <> 0 THEN (doc_id % 20)::VARCHAR END, 'unknown') AS article, count(*) AS n FROM documents GROUP BY 1")
def a11_group_by_article(spark, sf):
    a = F.when(F.col("doc_id") % 5 != 0, (F.col("doc_id") % 20).cast("string"))
    return table(spark, sf, "documents").groupBy(F.coalesce(a, F.lit("unknown")).alias("article")).agg(F.count(F.lit(1)).alias("n"))


# ---- layout


def lines(spark, sf):
    d = table(spark, sf, "documents").select((F.col("doc_id") % 50).alias("doc"), F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return d


_LINES = "l AS (SELECT doc_id % 50 AS doc, doc_id AS page, unnest(range(0, len(string_split(text, E'\\n')))) AS line, unnest(string_split(text, E'\\n')) AS text FROM documents)"


@query("WITH " + _LINES + """, e AS (SELECT *, count(*) OVER (PARTITION BY doc, page) AS n FROM l), p AS (SELECT doc, count(DISTINCT page) AS pages FROM l GROUP BY doc HAVING pages >= 3)
SELECT doc, text, count(*) AS times, any_value(pages) AS pages FROM e JOIN p USING (doc) WHERE (line < 4 OR line >= n - 2) AND length(text) >= 4 GROUP BY doc, text HAVING count(*) / any_value(pages)::DOUBLE >= 0.1""")
def a12_repeated_edge_lines(spark, sf):
    return layout.repeated_edge_lines(lines(spark, sf), 0.1)


@query("SELECT l_orderkey AS chunk, min(l_quantity) - 1 AS x0, greatest(min(l_tax * 100) - 1, 0.0) AS y0, max(l_quantity + l_linenumber * 5) + 1 AS x1, max(l_tax * 100 + 10) + 1 AS y1 FROM lineitem GROUP BY l_orderkey")
def a13_bbox_union(spark, sf):
    b = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("chunk"), F.col("l_quantity").alias("x0"), (F.col("l_tax") * 100).alias("y0"), (F.col("l_quantity") + F.col("l_linenumber") * 5).alias("x1"), (F.col("l_tax") * 100 + 10).alias("y1"))
    return layout.box_union(b, ["chunk"], 1.0)


_COVER = """w AS (SELECT l_linenumber AS page, least(greatest(floor(l_quantity / 60 * 60), 0), 59)::INT AS a, least(greatest(floor((l_quantity + 2) / 60 * 60), 0), 59)::INT AS b FROM lineitem),
c AS (SELECT page, bin, count(*) AS n FROM (SELECT page, unnest(range(least(a, b), b + 1))::INTEGER AS bin FROM w) GROUP BY page, bin)"""


def cover(spark, sf):
    w = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("page"), F.col("l_quantity").alias("x0"), (F.col("l_quantity") + 2).alias("x1"))
    return layout.coverage(w, F.lit(60.0), ["page"])


@query("WITH " + _COVER + " SELECT page, bin, n FROM c")
def a14_coverage_histogram(spark, sf):
    return cover(spark, sf)


@query("WITH " + _COVER + ", m AS (SELECT page, bin, avg(n) OVER (PARTITION BY page) AS a, n FROM c), r AS (SELECT page, bin, bin - row_number() OVER (PARTITION BY page ORDER BY bin) AS g FROM m WHERE n < a) SELECT page, min(bin) AS first, max(bin) AS last, count(*) AS size FROM r GROUP BY page, g HAVING count(*) >= 2")
def w8_gap_islands(spark, sf):
    """Runs of bins that are covered less than a page's mean."""
    mean = F.avg("n").over(Window.partitionBy("page"))
    return layout.islands(cover(spark, sf).withColumn("_a", mean).where("n < _a").drop("_a", "n"), ["page"], "bin")


@query("WITH " + _LINES + """, f AS (SELECT * FROM l WHERE text <> '') SELECT page, round(greatest(least(avg(length(text)) / 40.0, 2.0) - avg((length(text) <= 12)::INT) * 2.0, 0.0), 6) AS quality, sum(length(text))::BIGINT AS chars FROM f GROUP BY page""")
def a16_page_quality(spark, sf):
    return layout.page_quality(lines(spark, sf), ["page"]).select("page", F.round("quality", 6).alias("quality"), "chars")


@query("WITH " + _LINES + " SELECT doc, round(avg((regexp_matches(text, '[äöüß]'))::INT), 6) AS share FROM l GROUP BY doc")
def a15_ratio(spark, sf):
    return lines(spark, sf).groupBy("doc").agg(F.round(F.avg(F.col("text").rlike("[äöüß]").cast("int")), 6).alias("share"))


_GENRES = "k(place, genre, word) AS (VALUES " + ", ".join(f"({i}, '{g}', '{w.lower()}')" for i, (g, ws) in enumerate(tx.GENRES.items()) for w in ws) + ")"


@query(f"WITH {_GENRES}, n AS (SELECT doc_id, place, genre, count(word) AS n FROM documents JOIN k ON contains(lower(text), word) GROUP BY ALL), b AS (SELECT doc_id, genre FROM n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, place) = 1) SELECT doc_id, coalesce(genre, 'general') AS genre FROM documents LEFT JOIN b USING (doc_id)")
def a17_genre(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.coalesce(tx.genre(F.col("text")), F.lit("general")).alias("genre"))


@query("SELECT doc_id, len(list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> ''))::INTEGER AS tokens FROM documents")
def a22_token_count(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.token_count(F.col("text")).alias("tokens"))


@query("SELECT conv_id, turn, last_value(CASE WHEN turn % 3 = 1 THEN role || turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS article FROM conversations")
def w10_carry_forward(spark, sf):
    c = table(spark, sf, "conversations")
    return layout.carry_forward(c, ["conv_id"], "turn", F.when(F.col("turn") % 3 == 1, F.concat("role", F.col("turn").cast("string"))), "article").select("conv_id", "turn", "article")


_MERGE = """c AS (SELECT conv_id AS doc, turn AS seq, text, CASE WHEN turn % 4 = 0 THEN 'a' || turn END AS article FROM conversations),
k AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY seq) = 1 OR length(text) > 40 OR article IS NOT NULL AS keep FROM c), i AS (SELECT *, sum(keep::INT) OVER (PARTITION BY doc ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM k)"""


@query("WITH " + _MERGE + " SELECT doc, island::BIGINT AS island, arg_min(article, seq) AS article, string_agg(text, ' ' ORDER BY seq) AS text FROM i GROUP BY doc, island".replace("arg_min(article, seq)", "arg_min_null(article, seq)"))
def a23_tiny_merge(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("seq"), "text", F.when(F.col("turn") % 4 == 0, F.concat(F.lit("a"), F.col("turn").cast("string"))).alias("article"))
    return layout.merge_tiny(c).select("doc", F.col("island").cast("bigint").alias("island"), "article", "text")


@query("SELECT l_orderkey AS page, floor(l_discount * 100 / 3)::BIGINT AS row, string_agg(l_linenumber::VARCHAR, ' ' ORDER BY l_quantity, l_linenumber) AS text FROM lineitem GROUP BY 1, 2")
def c6_words_to_lines(spark, sf):
    w = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_quantity").alias("x0"), (F.col("l_discount") * 100).alias("y0"), F.col("l_linenumber").alias("word_no"), F.col("l_linenumber").cast("string").alias("text"))
    return layout.words_to_lines(w, ["page"])


_ART = """l AS (SELECT conv_id AS doc, turn AS line, CASE WHEN turn % 3 = 0 THEN '제' || (turn + 1) || '조 (' || role || ')' ELSE role || ' ' || turn END AS text FROM conversations),
h AS (SELECT *, CASE WHEN line % 3 = 0 THEN (line + 1)::VARCHAR END AS h FROM l), i AS (SELECT *, sum((h IS NOT NULL)::INT) OVER (PARTITION BY doc ORDER BY line ROWS UNBOUNDED PRECEDING) AS seq FROM h)"""


@query("WITH " + _ART + " SELECT doc, seq::BIGINT AS seq, coalesce(min(h), '?') AS article, string_agg(text, E'\\n' ORDER BY line) AS text FROM i GROUP BY doc, seq")
def c3_article_chunks(spark, sf):
    t = F.col("turn")
    text = F.when(t % 3 == 0, F.concat(F.lit("제"), (t + 1).cast("string"), F.lit("조 ("), "role", F.lit(")"))).otherwise(F.concat_ws(" ", "role", "turn"))
    out = layout.article_chunks(table(spark, sf, "conversations").select(F.col("conv_id").alias("doc"), t.alias("line"), text.alias("text")))
    return out.select("doc", F.col("seq").cast("bigint").alias("seq"), "article", "text")


# ---- chunkers and models of tables: folds, checked by brute force in the tests


@query('''WITH RECURSIVE p AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS n FROM conversations WHERE trim(text) <> ''),
w AS (SELECT conv_id, i, n, 1 AS g, n AS size FROM p WHERE i = 1 UNION ALL SELECT p.conv_id, p.i, p.n, CASE WHEN size + p.n <= 512 THEN g ELSE g + 1 END, CASE WHEN size + p.n <= 512 THEN size + p.n ELSE p.n END FROM w JOIN p ON p.conv_id = w.conv_id AND p.i = w.i + 1)
SELECT conv_id AS doc_id, (row_number() OVER (PARTITION BY conv_id ORDER BY g) - 1)::INTEGER AS chunk_index, sum(n)::INTEGER AS token_count FROM w GROUP BY conv_id, g HAVING sum(n) >= 100''')
def c2_basic_chunk(spark, sf):
    """Conversations as documents whose paragraphs are their turns."""
    t = table(spark, sf, "conversations")
    held = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"])
    return chunk.chunk(t.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(held, "\n\n").alias("text"))).select("doc_id", "chunk_index", "token_count")


_WORDS = "len(list_filter(string_split_regex({}, '\\s+'), lambda w: w <> ''))"


@query(rf"""WITH RECURSIVE a AS (SELECT doc_id, unnest(range(len(string_split(text, E'\n\n')))) AS i, unnest(string_split(text, E'\n\n')) AS raw FROM documents), b AS (SELECT doc_id, i, trim(raw, {_EDGES}) AS para FROM a), c AS (SELECT *, {_WORDS.format("para")} AS n FROM b WHERE para <> ''),
s AS (SELECT doc_id, i, string_split_regex(para, '[.!?]\s+') AS parts, regexp_extract_all(para, '[.!?]\s+') AS stops FROM c WHERE n > 512), t AS (SELECT doc_id, i, unnest(range(len(parts))) AS j, parts, stops FROM s),
m AS (SELECT doc_id, i, 0 AS j, true AS piece, n FROM c WHERE n <= 512 UNION ALL SELECT doc_id, i, -1, false, 0 FROM s UNION ALL SELECT doc_id, i, 2 * j, true, {_WORDS.format("parts[j + 1]")} FROM t UNION ALL SELECT doc_id, i, 2 * j + 1, true, {_WORDS.format("stops[j + 1]")} FROM t WHERE j < len(stops)),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS pos FROM m),
w AS (SELECT doc_id, pos, n, CASE WHEN piece THEN 0 ELSE 1 END AS g, n AS size FROM p WHERE pos = 1 UNION ALL SELECT p.doc_id, p.pos, p.n, CASE WHEN piece AND size + p.n <= 512 THEN g ELSE g + 1 END, CASE WHEN piece AND size + p.n <= 512 THEN size + p.n ELSE p.n END FROM w JOIN p ON p.doc_id = w.doc_id AND p.pos = w.pos + 1),
k AS (SELECT doc_id, g, sum(n) AS n, max(g) OVER (PARTITION BY doc_id) AS last FROM w GROUP BY doc_id, g)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1)::INTEGER AS chunk_index, n::INTEGER AS token_count FROM k WHERE n > 0 AND (g < last OR n >= 100)""")
def c13_token_split(spark, sf):
    return chunk.chunk(table(spark, sf, "documents"), "split").select("doc_id", "chunk_index", "token_count")


@query(rf"""WITH d AS (SELECT conv_id AS doc_id, string_agg('Chapter ' || turn || E': t\n' || text, E'\n' ORDER BY turn, text) AS text FROM conversations WHERE text IS NOT NULL GROUP BY conv_id),
l AS (SELECT doc_id, unnest(range(len(string_split(text, E'\n')))) AS line, unnest(string_split(text, E'\n')) AS text FROM d), h AS (SELECT *, regexp_extract(text, '^(?:Chapter|CHAPTER)\s+(\d+|[IVX]+)(?:[ \t]*[:\-][ \t]*.+)?$', 1) AS chapter, regexp_extract(text, '^(?:Chapter|CHAPTER)\s+(?:\d+|[IVX]+)[ \t]*[:\-][ \t]*(.+)$', 1) AS title FROM l),
i AS (SELECT *, sum((chapter <> '')::INT) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS g FROM h)
SELECT doc_id, (g - 1)::INTEGER AS place, max(chapter) AS chapter, trim(max(title), {_EDGES}) AS title, trim(coalesce(string_agg(text, E'\n' ORDER BY line) FILTER (chapter = ''), ''), {_EDGES}) AS text FROM i WHERE g > 0 GROUP BY doc_id, g""")
def c9_chapters(spark, sf):
    d = table(spark, sf, "conversations").where("text is not null").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: F.concat(F.lit("Chapter "), s["turn"].cast("string"), F.lit(": t\n"), s["text"])), "\n").alias("text"))
    return chunk.chapters(d)


_ROWS = "CASE WHEN l_quantity >= 20 THEN '| ' || l_linenumber || ' | ' || l_partkey || ' |' WHEN l_tax > 0.02 THEN l_linenumber || '  ' || l_partkey || '  ' || l_suppkey ELSE 'line ' || l_linenumber END"


@query(rf"""WITH l AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, {_ROWS}) - 1 AS line, {_ROWS} AS text FROM lineitem),
k AS (SELECT doc_id, line, CASE WHEN len(text) - len(replace(text, '|', '')) >= 2 THEN 'bordered' WHEN len(string_split_regex(trim(text), '\s{{2,}}|\t')) >= 3 THEN 'borderless' END AS kind FROM l), i AS (SELECT *, line - row_number() OVER (PARTITION BY doc_id, kind ORDER BY line) AS g FROM k WHERE kind IS NOT NULL)
SELECT doc_id, min(line)::INTEGER AS first_line, max(line)::INTEGER AS last_line, kind, CASE kind WHEN 'bordered' THEN 0.7 ELSE 0.6 END::DOUBLE AS confidence FROM i GROUP BY doc_id, kind, g HAVING count(*) >= 2""")
def c14_table_detect(spark, sf):
    """Orders as documents whose lines are table rows with bars, aligned columns or plain text."""
    line = F.expr(_ROWS)
    held = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("text")))), lambda s: s["text"])
    return chunk.detect_tables(table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_join(held, "\n").alias("text")))


@query()
def s3_html_to_text(spark, sf):
    return read_html(table(spark, sf, "pages")).select("page_id", "text")


# ---- presentation and state


@query("""WITH p AS (SELECT lang, arg_min(text, doc_id) AS text FROM documents WHERE lang <> 'en' GROUP BY lang), i AS (SELECT lang, text, row_number() OVER (ORDER BY lang) - 1 AS place FROM p), b AS (SELECT string_agg(trim('## ' || lang || E'\\n' || CASE WHEN length(trim(text)) > 350 THEN substr(trim(text), 1, 350) || '...' ELSE trim(text) END), E'\\n\\n' ORDER BY place) FILTER (place < 2) AS blocks, count(*) AS n FROM i)
SELECT doc_id AS anchor, md5('Query: rights' || E'\\n\\n# Doc ' || doc_id || E'\\n' || CASE WHEN length(trim(text)) > 500 THEN substr(trim(text), 1, 500) || '...' ELSE trim(text) END || E'\\n\\n' || blocks || CASE WHEN n > 2 THEN E'\\n\\n(+' || (n - 2) || ')' ELSE '' END) AS prompt FROM documents, b WHERE lang = 'en'""")
def l1_pair_prompt(spark, sf):
    """A prompt for every English document, with the first document of each other language."""
    d = table(spark, sf, "documents")
    anchors = d.where("lang = 'en'").select(F.col("doc_id").alias("anchor"), F.lit("rights").alias("query"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"), "text")
    best = d.where("lang <> 'en'").groupBy(F.col("lang").alias("country")).agg(F.min_by("text", "doc_id").alias("text"))
    placed = best.withColumn("place", F.row_number().over(Window.orderBy("country")) - 1)  # a row for each language
    return present.pair_prompt(anchors.select("anchor").join(F.broadcast(placed), F.lit(True)), anchors, 2).select("anchor", F.md5("prompt").alias("prompt"))


@query("""SELECT lang AS country, md5('Query: rights' || E'\\n' || string_agg('- ' || CASE WHEN length(trim(source)) > 3 THEN substr(trim(source), 1, 3) || '...' ELSE trim(source) END, E'\\n' ORDER BY doc_id)) AS prompt FROM documents GROUP BY lang""")
def l2_country_prompt(spark, sf):
    items = table(spark, sf, "documents").select(F.col("lang").alias("country"), F.col("doc_id").alias("place"), F.col("source").alias("text"))
    return present.country_prompt(items, F.lit("rights"), 3).select("country", F.md5("prompt").alias("prompt"))


@query("""WITH e AS (SELECT user_id AS key, arg_max(event_type, ts) AS payload, max(ts) AS ts FROM events GROUP BY user_id), n AS (SELECT max(ts) AS now FROM events) SELECT key FROM e, n WHERE ts > now - INTERVAL 1800 SECOND""")
def x2_ttl(spark, sf):
    e = table(spark, sf, "events")
    now = e.agg(F.max("ts")).scalar()
    return streaming.live(e.select(F.col("user_id").alias("key"), F.col("event_type").alias("payload"), "ts"), now, 1800).select("key")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def s24_windowed_counts(spark, sf):
    out = streaming.windowed_counts(table(spark, sf, "events"), "ts", "10 minutes", "1 hour", ["event_type"])
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""WITH b AS (SELECT l_orderkey AS id, l_linenumber AS page, l_quantity AS x0, l_tax * 1000 AS y0, l_quantity + 30 AS x1, l_tax * 1000 + 20 AS y1 FROM lineitem), p AS (SELECT DISTINCT l_linenumber AS page, 60.0 AS width, 90.0 AS height FROM lineitem),
h AS (SELECT id, page, width, height, greatest(0, least(x0, width)) AS x0, greatest(0, least(y0, height)) AS y0, greatest(0, least(x1, width)) AS x1, greatest(0, least(y1, height)) AS y1 FROM b JOIN p USING (page))
SELECT id, page, (x0 * 2)::DOUBLE AS x0, round(y0 * 2, 6)::DOUBLE AS y0, (x1 * 2)::DOUBLE AS x1, round(y1 * 2, 6)::DOUBLE AS y1 FROM h WHERE x1 - x0 >= 1 AND y1 - y0 >= 1 AND NOT (x1 - x0 >= width * .99 AND y1 - y0 >= height * .99)""")
def f25_display_box(spark, sf):
    b = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("page"), F.col("l_quantity").alias("x0"), (F.col("l_tax") * 1000).alias("y0"), (F.col("l_quantity") + 30).alias("x1"), (F.col("l_tax") * 1000 + 20).alias("y1"))
    p = b.select("page").distinct().withColumns({"width": F.lit(60.0), "height": F.lit(90.0)})
    return present.display_box(b, p, F.lit(2.0)).select("id", "page", "x0", F.round("y0", 6).alias("y0"), "x1", F.round("y1", 6).alias("y1"))


@query("SELECT event_id AS id, row_number() OVER (ORDER BY ts DESC, event_id)::INTEGER AS place FROM events QUALIFY place <= 50")
def s23_history(spark, sf):
    top = table(spark, sf, "events").orderBy(F.desc("ts"), "event_id").limit(50)
    return top.select(F.col("event_id").alias("id"), F.row_number().over(Window.orderBy(F.desc("ts"), "event_id")).alias("place"))


@query("SELECT o_custkey AS country, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 AS place FROM orders QUALIFY place < 3")
def w3_topk_per_anchor(spark, sf):
    o = table(spark, sf, "orders")
    return match.page(o, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], F.lit(0), 3).select(F.col("o_custkey").alias("country"), F.col("o_orderkey").alias("id"), F.col("place").cast("bigint").alias("place"))
