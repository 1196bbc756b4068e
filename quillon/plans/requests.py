"""Registry, request, metadata and presentation queries with their SQL; candidates are orders, their countries and texts go by key."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import countries, text as tx
from quillon.operators import match, request, retrieve
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


def lit_sql(v) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


def choose(values: list, key: str):
    """The value that a key's remainder points to, as a column."""
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), F.pmod(F.col(key), F.lit(len(values))).cast("int"))


def choose_sql(values: list, key: str) -> str:
    return f"[{', '.join(map(lit_sql, values))}][{key} % {len(values)} + 1]"


CODES = ["KR", "us", None, "DE", "xx", "JP", "fr"]
_REG = "r(place, code, name_ko, name_en, continent, region) AS (VALUES " + ", ".join(f"({r[0]}, {', '.join(map(lit_sql, r[1:]))})" for r in countries.ROWS) + ")"


def candidates(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("anchor"), choose(CODES, "o_orderkey").alias("code"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("ts"))


_C = f"c AS (SELECT o_orderkey AS id, o_custkey AS anchor, {choose_sql(CODES, 'o_orderkey')} AS code, o_totalprice AS price, o_orderdate AS ts FROM orders)"


@query(f"WITH {_REG} SELECT place::INTEGER AS place, code, name_ko, name_en, continent, region FROM r")
def s16_country_registry(spark, sf):
    return countries.registry(spark)


@query(f"WITH {_REG} SELECT continent, count(*)::BIGINT AS n, list(code ORDER BY place) AS codes FROM r GROUP BY continent")
def u5_registry_by_continent(spark, sf):
    return countries.by_continent(countries.registry(spark))


@query(f"WITH {_REG}, {_C} SELECT id, coalesce(upper(code) IN (SELECT code FROM r), false) AS valid FROM c")
def p23_valid_code(spark, sf):
    return candidates(spark, sf).select("id", countries.valid(F.col("code")).alias("valid"))


@query(f"WITH {_REG}, {_C} SELECT id, coalesce(r.name_ko, c.code) AS name_ko, coalesce(r.name_en, c.code) AS name_en, coalesce(r.continent, 'asia') AS continent, coalesce(r.region, 'Unknown') AS region FROM c LEFT JOIN r ON upper(c.code) = r.code")
def j11_country_enrichment(spark, sf):
    return countries.enrich(candidates(spark, sf), "code", "asia").select("id", "name_ko", "name_en", "continent", "region")


@query(f"WITH {_REG}, q AS (SELECT r_regionkey AS k, {choose_sql(['LAND', '국', 'us', 'Korea', 'zz'], 'r_regionkey')} AS term FROM region) SELECT k::INTEGER AS k, code FROM q JOIN r ON contains(lower(name_ko), lower(term)) OR contains(lower(name_en), lower(term)) OR contains(lower(code), lower(term))")
def f23_country_search(spark, sf):
    q = table(spark, sf, "region").select(F.col("r_regionkey").cast("int").alias("k"), choose(["LAND", "국", "us", "Korea", "zz"], "r_regionkey").alias("term"))
    both = F.broadcast(countries.registry(spark)).join(q, F.lit(True))  # 118 rows and a request's terms
    return countries.search(both, F.col("term")).select("k", "code")


@query(f"WITH {_REG} SELECT code FROM r WHERE region = 'East Asia'")
def p20_region_filter(spark, sf):
    return countries.in_region(countries.registry(spark), "East Asia").select("code")


@query(f"WITH {_REG} SELECT place::INTEGER AS place, code, name_ko FROM r WHERE contains(lower(name_en), 'an')")
def a9_countries(spark, sf):
    return countries.registry(spark).where(F.lower("name_en").contains("an")).select("place", "code", "name_ko")


@query(f"WITH {_C} SELECT id FROM c WHERE coalesce(CASE WHEN id % 5 = 0 THEN NULL ELSE price / 600000 END, 0) >= 0.1")
def p6_display_threshold(spark, sf):
    shown = F.when(F.col("id") % 5 != 0, F.col("price") / 600000)
    return candidates(spark, sf).where(F.coalesce(shown, F.lit(0.0)) >= 0.1).select("id")


def _rows(spark, sf):
    n = F.col("id")
    boxes = choose(['[{"x0":1,"y0":2,"x1":3,"y1":4}]', "no list", None], "id")
    return candidates(spark, sf).select("id", F.col("code").alias("country"), F.when(n % 2 == 0, "bilingual").alias("text_type"), F.when(n % 3 == 0, F.lit(False)).alias("has_korean"), F.when(n % 4 > 0, (n % 4 - 1).cast("int")).alias("page"), F.when(n % 5 > 0, F.col("price")).alias("score"), F.when(n % 7 > 0, F.col("price") / 2).alias("display_score"), boxes.alias("boxes"))


def _shown_sql(home: bool) -> str:
    a, b, c = ("KR", "korean_only", "true") if home else ("", "english_only", "false")
    return f"""WITH {_C} SELECT id, coalesce(code, '{a}') AS country, CASE WHEN id % 2 = 0 THEN 'bilingual' ELSE '{b}' END AS text_type, CASE WHEN id % 3 = 0 THEN false ELSE {c} END AS has_korean,
CASE WHEN id % 4 IN (0, 1) THEN 1 ELSE id % 4 - 1 END::INTEGER AS page, CASE WHEN id % 5 > 0 THEN price WHEN id % 7 > 0 THEN price / 2 ELSE 0.0 END AS score, CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END::INTEGER AS boxes FROM c"""


@query(_shown_sql(True))
def p8_candidates_home(spark, sf):
    return request.shown(_rows(spark, sf), True).select("id", "country", "text_type", "has_korean", "page", "score", F.size("boxes").alias("boxes"))


@query(_shown_sql(False))
def p8_candidates_abroad(spark, sf):
    return request.shown(_rows(spark, sf), False).select("id", "country", "text_type", "has_korean", "page", "score", F.size("boxes").alias("boxes"))


def _meta(spark, sf):
    """Metadata maps: the article stands at the top (null for some), in the structure, or nowhere."""
    n = F.col("id")
    top = F.when(n % 3 == 0, F.create_map(F.lit("article_number"), F.when(n % 2 == 0, n.cast("string")), F.lit("title"), F.lit("T"))).otherwise(F.create_map(F.lit("title"), F.concat(F.lit("T"), n.cast("string"))))
    inner = F.when(n % 4 != 1, F.create_map(F.lit("article_number"), (n % 90).cast("string"), F.lit("title"), F.lit("inner"), F.lit(""), F.lit("x"))).otherwise(F.create_map(F.lit("chapter"), F.lit(None).cast("string")))
    return candidates(spark, sf).select("id", top.alias("meta"), inner.alias("structure"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey::VARCHAR END WHEN o_orderkey % 4 <> 1 THEN (o_orderkey % 90)::VARCHAR END AS article FROM orders")
def p11_pick(spark, sf):
    return _meta(spark, sf).select("id", request.pick(F.col("meta"), F.col("structure"), "article_number").alias("article"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 <> 1 THEN ['article_number', 'title'] ELSE [] END AS keys FROM orders")
def p14_clean_props(spark, sf):
    return _meta(spark, sf).select("id", F.array_sort(F.map_keys(request.clean_props(F.col("structure")))).alias("keys"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'T' ELSE 'T' || o_orderkey END AS title, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey::VARCHAR END WHEN o_orderkey % 4 <> 1 THEN (o_orderkey % 90)::VARCHAR END AS article, 'KR' AS country,
CASE WHEN o_orderkey % 4 = 1 THEN true ELSE false END AS has_chapter FROM orders""")
def p15_flatten(spark, sf):
    flat = request.flatten(F.col("meta"), F.col("structure"), F.create_map(F.lit("country"), F.lit("KR")))
    m = _meta(spark, sf).select("id", flat.alias("m"))
    return m.select("id", F.try_element_at("m", F.lit("title")).alias("title"), F.try_element_at("m", F.lit("article_number")).alias("article"), F.try_element_at("m", F.lit("country")).alias("country"), F.map_contains_key("m", F.lit("chapter")).alias("has_chapter"))


@query("SELECT event_id, '{\"ts\":\"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '\",\"tags\":[\"' || event_type || '\",\"' || user_id || '\"]}' AS json FROM events")
def p16_json_safe(spark, sf):
    tags = F.array(F.col("event_type"), F.col("user_id").cast("string"))
    return table(spark, sf, "events").select("event_id", F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), tags.alias("tags"))).alias("json"))


_IDS = [["", "s1", None], [None, "t1", "", "t2"], ["m1", None, " ", "m2", "m3"]]


@query(f"""WITH {_C}, i AS (SELECT id, nullif(trim({choose_sql(_IDS[0], 'id')}), '') AS s, nullif(trim({choose_sql(_IDS[1], 'id')}), '') AS t, nullif(trim({choose_sql(_IDS[2], 'id')}), '') AS m, CASE WHEN id % 2 = 0 THEN '1987' ELSE '' END AS v FROM c)
SELECT id, coalesce(s, t, m, 'KR_' || CASE WHEN v = '' THEN 'latest' ELSE v END) AS home, coalesce(t, s, m, 'DE_latest') AS abroad FROM i""")
def p24_document_of(spark, sf):
    ids = [choose(v, "id") for v in _IDS]
    version = F.when(F.col("id") % 2 == 0, "1987").otherwise("")
    return candidates(spark, sf).select("id", request.document_of(*ids, F.lit("KR"), version, True).alias("home"), request.document_of(*ids, F.lit("DE"), version, False).alias("abroad"))


@query("""SELECT DISTINCT conv_id AS doc, p::INTEGER AS page FROM (SELECT conv_id, unnest([turn - 1, turn, turn + 1]) AS p, max(turn) OVER (PARTITION BY conv_id) AS pages FROM conversations WHERE turn >= 1) WHERE p BETWEEN 1 AND pages""")
def p25_rendered_pages(spark, sf):
    t = table(spark, sf, "conversations").where("turn >= 1")
    pages = F.max("turn").over(Window.partitionBy("conv_id"))
    return request.rendered_pages(t.select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), pages.alias("pages"))).select("doc", F.col("page").cast("int").alias("page"))


@query("SELECT o_custkey AS anchor, list_sort(list_distinct(list((o_orderkey % 7)::INTEGER))) AS pages FROM orders GROUP BY o_custkey")
def a24_highlight_pages(spark, sf):
    return candidates(spark, sf).groupBy("anchor").agg(F.collect_list(F.struct((F.col("id") % 7).cast("int").alias("page"))).alias("b")).select("anchor", request.highlighted(F.col("b")).alias("pages"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_totalprice > 100000 AND o_orderkey % 90 > 20")
def p21_valid_boxes(spark, sf):
    box = F.array(F.struct(F.lit(100000.0).alias("x0"), F.lit(20.0).alias("y0"), F.col("price").alias("x1"), (F.col("id") % 90).cast("double").alias("y1")))
    return candidates(spark, sf).where(F.size(request.valid_boxes(box)) > 0).select("id")


@query(f"""WITH {_C}, g AS (SELECT anchor, code, min(id) AS p, list(id ORDER BY price DESC, id) AS items FROM c WHERE code IS NOT NULL GROUP BY anchor, code) SELECT anchor, code, items, row_number() OVER (PARTITION BY anchor ORDER BY p, code)::INTEGER AS place FROM g""")
def a6_group_by_country(spark, sf):
    c = candidates(spark, sf).where("code is not null")
    return request.grouped(c, ["anchor"], "code", [F.desc("price"), F.col("id")], "id", "id").select("anchor", "code", "items", "place")


@query(f"WITH {_C} SELECT anchor, id FROM c WHERE code = 'DE'")
def a25_items_of_country(spark, sf):
    c = candidates(spark, sf).where("code is not null")
    pairs = request.grouped(c, ["anchor"], "code", [F.desc("price"), F.col("id")], "id", "id")
    return pairs.where("code = 'DE'").select("anchor", F.explode("items").alias("id"))


@query("SELECT c_custkey AS anchor, coalesce(list_sort(list(o_orderkey) FILTER (o_orderkey IS NOT NULL)), []) AS items FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY c_custkey")
def j15_anchor_matches(spark, sf):
    found = table(spark, sf, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("anchor")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("items"))
    return request.with_matches(table(spark, sf, "customer").select(F.col("c_custkey").alias("anchor")), found, "anchor")


@query(f"WITH {_REG}, {_C} SELECT DISTINCT anchor FROM c WHERE code IN (SELECT code FROM r WHERE continent = 'asia')")
def j20_still_valid(spark, sf):
    valid = countries.registry(spark).where("continent = 'asia'").select("code")
    return candidates(spark, sf).join(F.broadcast(valid), "code", "left_semi").select("anchor").distinct()  # 118 rows at most


@query("SELECT doc_id AS key, upper(substr(lang || ' ' || source, 1, 6)) AS summary FROM documents")
def l3_auto_summary(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.concat_ws(" ", "lang", "source").alias("prompt"))
    return request.complete(d, lambda p: f" {p[:6].upper()} ", "prompt", "summary").select("key", "summary")


@query("""SELECT event_id AS key, CASE WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN 'old' ELSE upper(event_type) END AS summary, (event_id % 3 = 0 AND event_id % 2 = 0) AS hit FROM events""")
def l4_cached_summary(spark, sf):
    e = table(spark, sf, "events")
    now = F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")
    age = F.when(F.col("event_id") % 2 == 0, 599).otherwise(600)
    cached = e.where("event_id % 3 = 0").select(F.col("event_id").alias("key"), F.lit("old").alias("summary"), (now - F.make_interval(secs=age)).alias("ts"))
    return request.summarise(e.select(F.col("event_id").alias("key"), F.col("event_type").alias("prompt")), cached, str.upper, now)


@query("""SELECT event_id, CASE date_diff('day', ts::DATE, n) WHEN 0 THEN '오늘' WHEN 1 THEN '어제' ELSE month(ts) || '월 ' || day(ts) || '일' END AS label, strftime(ts, '%Y%m%d') AS stamp FROM events, (SELECT max(ts)::DATE AS n FROM events)""")
def f22_relative_day(spark, sf):
    e = table(spark, sf, "events")
    now = F.broadcast(e.agg(F.max("ts").alias("now")))  # one row
    return e.join(now, F.lit(True)).select("event_id", request.relative_day(F.col("ts"), F.col("now")).alias("label"), F.date_format("ts", "yyyyMMdd").alias("stamp"))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(var_pop(value), 6) AS variance, trunc(avg(value))::INTEGER AS whole, least(1.0, greatest(0.0, round(avg(value) / 100, 6))) AS held FROM events GROUP BY event_type")
def f24_moments(spark, sf):
    mean = F.avg("value")
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(mean, 6).alias("mean"), F.round(F.var_pop("value"), 6).alias("variance"), mean.cast("int").alias("whole"), tx.clamp01(F.round(mean / 100, 6)).alias("held"))


_REMARKS = ["요약 (제1조). 다음 문장", "a (b) c", "no remark", "끝 (x)", "(a) (b). c"]


@query(f"SELECT id, regexp_replace(regexp_replace(t, '\\)\\.\\s+', ').' || chr(10), 'g'), '\\)\\s+([^\\s.,)])', ')' || chr(10) || '\\1', 'g') AS t FROM (SELECT o_orderkey AS id, {choose_sql(_REMARKS, 'o_orderkey')} AS t FROM orders)")
def f26_broken_lines(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), request.broken_lines(choose(_REMARKS, "o_orderkey")).alias("t"))


@query("SELECT doc_id, CASE lang WHEN 'ko' THEN '한국어' WHEN 'en' THEN 'English' WHEN 'ja' THEN '日本語' WHEN 'zh' THEN '中文' ELSE lang END AS label FROM documents")
def f29_language_label(spark, sf):
    return table(spark, sf, "documents").select("doc_id", request.language_label(F.col("lang")).alias("label"))


@query("""SELECT o_orderkey AS id, md5('{"anchor": ' || o_custkey || ', "note": ' || CASE WHEN o_orderkey % 3 = 0 THEN 'null' WHEN o_orderkey % 3 = 1 THEN '"a|b"' ELSE '""' END || ', "status": "' || o_orderstatus || '"}') AS key FROM orders""")
def f21_cache_key(spark, sf):
    o = table(spark, sf, "orders")
    note = F.when(F.col("o_orderkey") % 3 == 1, "a|b").when(F.col("o_orderkey") % 3 == 2, "")
    return o.select(F.col("o_orderkey").alias("id"), F.md5(request.canonical_json({"status": F.col("o_orderstatus"), "note": note, "anchor": F.col("o_custkey")})).alias("key"))


@query("SELECT l_orderkey AS orderkey, count(*)::BIGINT AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def s14_unique_violations(spark, sf):
    return request.unique_violations(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("orderkey")), ["orderkey"])


@query("SELECT doc_id - 5 AS id, lang, source FROM documents WHERE doc_id >= 5 ORDER BY doc_id LIMIT 10")
def s22_peek(spark, sf):
    return request.peek(table(spark, sf, "documents").withColumn("id", F.col("doc_id") - 5), "id", ["lang", "source"])


@query("""SELECT d.doc_id AS doc, CASE WHEN d.doc_id % 3 = 0 THEN lang || '/' || d.doc_id || '.pdf' WHEN d.doc_id % 3 = 1 THEN source || '/' || d.doc_id || '.pdf' WHEN d.doc_id % 2 = 0 THEN 'meta/' || d.doc_id END AS key FROM documents d""")
def s21_resolve_key(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "lang", "source")
    name = lambda c: F.concat(F.col(c), F.lit("/"), F.col("doc").cast("string"), F.lit(".pdf"))
    objects = d.where("doc % 3 = 0").select(name("lang").alias("key")).unionByName(d.where("doc % 3 <= 1").select(name("source").alias("key")))
    meta = d.where("doc % 2 = 0").select("doc", F.concat(F.lit("meta/"), F.col("doc").cast("string")).alias("key"))
    return request.resolve_key(d, objects, meta, [name("lang"), name("source")])


@query("""WITH b AS (SELECT doc_id, doc_id // 300 AS batch, n_chars > 1500 AS bad FROM documents) SELECT batch::INTEGER AS batch, count(*)::BIGINT AS rows, count(*) FILTER (bad)::BIGINT AS failed, coalesce(list_sort(list(doc_id) FILTER (bad))[1:5], []) AS failures, CASE WHEN bool_or(bad) THEN 'failed' ELSE 'inserted' END AS status FROM b GROUP BY batch""")
def s8_batch_status(spark, sf):
    return request.batch_status(table(spark, sf, "documents"), "doc_id", F.col("n_chars") <= 1500)


@query("""WITH t AS (SELECT doc_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> ''))) AS w FROM documents), c AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 4))::INTEGER % 16 AS cell, count(*) AS n FROM t GROUP BY 1, 2),
v AS (SELECT doc_id, list_transform(range(16), lambda i: coalesce(max(n) FILTER (cell = 0), 0)) AS z, list(struct_pack(cell := cell, n := n)) AS l FROM c GROUP BY doc_id)
SELECT doc_id, round(max(n) FILTER (cell = 3) / sqrt(sum(n * n)), 6) AS third, round(sum((n / norm) * (n / norm)), 6) AS length FROM (SELECT *, sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS norm FROM c) GROUP BY doc_id, norm""".replace("""v AS (SELECT doc_id, list_transform(range(16), lambda i: coalesce(max(n) FILTER (cell = 0), 0)) AS z, list(struct_pack(cell := cell, n := n)) AS l FROM c GROUP BY doc_id)
""", "").replace("GROUP BY 1, 2),", "GROUP BY 1, 2)"))
def r1_default_embedding(spark, sf):
    v = request.embed(table(spark, sf, "documents"), "doc_id", "text")
    third = F.col("vector")[3]
    return v.select("doc_id", F.when(third > 0, F.round(third, 6)).alias("third"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x), 6).alias("length"))


@query("SELECT anchor, id, place::INTEGER AS place FROM (SELECT o_custkey AS anchor, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY floor(o_totalprice / 50000) DESC, o_orderkey) AS place FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY floor(o_totalprice / 50000) DESC, o_orderkey) = 1))")
def t9_final_order(spark, sf):
    """Sorted by the final score, the best of each key kept, sorted again; equal scores in their first order."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("anchor"), F.col("o_orderkey").alias("id"), "o_orderpriority", F.floor(F.col("o_totalprice") / 50000).alias("s"))
    once = match.dedupe_best(o, ["anchor", "o_orderpriority"], "s", "id")
    return once.withColumn("place", F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("s"), "id"))).select("anchor", "id", "place")


@query("SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY round(floor(n_chars / 500) / 10 + CASE WHEN doc_id % 20 = 6 THEN .8 ELSE 0 END + CASE WHEN doc_id % 11 = 0 THEN .3 ELSE 0 END, 6) DESC, doc_id)::INTEGER AS place FROM documents")
def t10_boost_order(spark, sf):
    d = table(spark, sf, "documents")
    no = F.lit(False)
    score = match.boost(F.floor(F.col("n_chars") / 500) / 10, F.lit("exact_article"), F.col("doc_id") % 20 == 6, F.col("doc_id") % 11 == 0, F.lit("other"), no)
    return d.withColumn("s", F.round(score, 6)).withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("s"), "doc_id"))).select("doc_id", "place")


@query("SELECT n_nationkey AS k, row_number() OVER (ORDER BY lower(coalesce(t, '')), t, n_nationkey)::INTEGER AS place FROM (SELECT n_nationkey, " + choose_sql(["beta", "Alpha", None, "alpha", "gamma"], "n_nationkey") + " AS t FROM nation)")
def t14_locale_order(spark, sf):
    """Titles whatever their case, small letters after capitals, no title first."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), choose(["beta", "Alpha", None, "alpha", "gamma"], "n_nationkey").alias("t"))
    return n.select("k", F.row_number().over(Window.orderBy(F.lower(F.coalesce("t", F.lit(""))), F.col("t").asc_nulls_last(), "k")).alias("place"))


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 40")
def u7_load_more(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    return d.orderBy("doc_id").limit(20).unionByName(d.orderBy("doc_id").offset(20).limit(20))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source ELSE lang END AS asked FROM documents")
def r14_rerank_query(spark, sf):
    """The anchor's text where it has one, else the query."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", tx.first_text(F.when(F.col("doc_id") % 3 != 0, F.col("lang")), F.col("source")).alias("asked"))


@query("SELECT o_custkey AS query_id, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS place FROM orders QUALIFY place <= 3")
def r8_rerank_fallback(spark, sf):
    """A pair score that fails leaves the order by the former score."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"), F.lit("q").alias("query"), F.lit("t").alias("text"))
    out = retrieve.rerank(o, lambda q, t: F.lit(None).cast("double"), 3, ["query_id"], [F.desc("score"), F.col("id")])
    return out.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("prev"))).select("query_id", "id", "place")
