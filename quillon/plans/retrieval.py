"""Retrieval, matching and graph queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators import graph, match, retrieve
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


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.col("lang").alias("country"), (F.col("doc_id") % 20 + 1).cast("int").alias("article"), "source", "n_chars")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def question(spark: SparkSession, sf: str) -> tuple[str, list[float]]:
    """The first 8 words of item 0, and vector 0: one row each, read by the driver as a query would be."""
    item = table(spark, sf, "benchmark").where("item_id = 0").select(F.lit(0).alias("k"), "text")
    row = item.join(table(spark, sf, "embeddings").where("vec_id = 0").select(F.lit(0).alias("k"), "embedding"), "k").first()
    return " ".join(row["text"].split()[:8]), list(row["embedding"])


_Q = "q AS (SELECT list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')[1:8] AS w FROM benchmark WHERE item_id = 0), "
_D = """dense AS (SELECT vec_id AS chunk_id, list_inner_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS score FROM embeddings),
d AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) - 1 AS rank FROM dense QUALIFY rank < 100), """
_S = """sparse AS (SELECT doc_id AS chunk_id, len(list_intersect(list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda w: w <> '')), (SELECT list_transform(w, lambda x: lower(x)) FROM q)))::DOUBLE AS score FROM documents),
s AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) - 1 AS rank FROM sparse QUALIFY rank < 100), """
_K = """k AS (SELECT doc_id AS chunk_id, 1.0 AS score, row_number() OVER (ORDER BY doc_id % 20 + 1, doc_id) - 1 AS rank FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id % 20 ORDER BY doc_id) AS n FROM documents WHERE doc_id % 20 + 1 IN (1, 7)) WHERE n <= 10), """
_U = "u AS (SELECT 0 AS c, chunk_id, rank, .5 AS w FROM d UNION ALL SELECT 1, chunk_id, rank, .3 FROM s UNION ALL SELECT 2, chunk_id, rank, .2 FROM k), "
_F = """f AS (SELECT chunk_id, sum(w / (60 + rank + 1)) AS fusion, max(rank) FILTER (c = 0) AS dense_rank, max(rank) FILTER (c = 1) AS sparse_rank, max(rank) FILTER (c = 2) AS keyword_rank, min(c * 1000000 + rank) AS first FROM u GROUP BY chunk_id), """
_N = "n AS (SELECT *, CASE WHEN max(fusion) OVER () - min(fusion) OVER () < 1e-9 THEN 1.0 ELSE (fusion - min(fusion) OVER ()) / (max(fusion) OVER () - min(fusion) OVER ()) END AS score FROM f) "


@query("WITH " + _D.rstrip(", ") + " SELECT chunk_id, rank::INTEGER AS rank, round(score, 6) AS score FROM d")
def r2_dense_topk(spark, sf):
    return retrieve.dense_channel(vectors(spark, sf), question(spark, sf)[1], 0).select("chunk_id", "rank", F.round("score", 6).alias("score"))


@query("WITH " + _Q + _S.rstrip(", ") + " SELECT chunk_id, rank::INTEGER AS rank, score FROM s")
def r3_lexical_rank(spark, sf):
    return retrieve.sparse_channel(corpus(spark, sf), question(spark, sf)[0], 0).select("chunk_id", "rank", "score")


@query("WITH " + _K.rstrip(", ") + " SELECT chunk_id, rank::INTEGER AS rank FROM k")
def j13_keyword_channel(spark, sf):
    return retrieve.keyword_channel(corpus(spark, sf), [1, 7], 0).select("chunk_id", "rank")


@query("WITH " + _Q + _D + _S + _K + _U + _F.rstrip(", ") + " SELECT chunk_id, round(fusion, 9) AS fusion_score, dense_rank::INTEGER AS dense_rank, sparse_rank::INTEGER AS sparse_rank, keyword_rank::INTEGER AS keyword_rank FROM f")
def a1_rrf(spark, sf):
    q, v = question(spark, sf)
    c = corpus(spark, sf)
    found = retrieve.dense_channel(vectors(spark, sf), v, 0).unionByName(retrieve.sparse_channel(c, q, 0)).unionByName(retrieve.keyword_channel(c, [1, 7], 0))
    return retrieve.fuse(found).select("chunk_id", F.round("fusion_score", 9).alias("fusion_score"), "dense_rank", "sparse_rank", "keyword_rank")


_R = """f2 AS (SELECT *, row_number() OVER (ORDER BY fusion DESC, first, chunk_id) AS prev FROM f QUALIFY prev <= 50), ja AS (SELECT list_distinct(list_transform(w, lambda x: lower(x))) AS a FROM q),
jt AS (SELECT f2.*, list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda w: w <> '')) AS t, a FROM f2 LEFT JOIN documents ON doc_id = chunk_id, ja),
js AS (SELECT *, len(list_intersect(t, a)) / (len(t) + len(a) - len(list_intersect(t, a)))::DOUBLE AS raw FROM jt),
n AS (SELECT *, CASE WHEN max(raw) OVER () - min(raw) OVER () < 1e-9 THEN 1.0 ELSE (raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER ()) END AS score FROM js) """


@query("WITH " + _Q + _D + _S + _K + _U + _F + _N + "SELECT chunk_id, round(fusion, 9) AS fusion_score, round(score, 6) AS score, row_number() OVER (ORDER BY fusion DESC, first, chunk_id)::INTEGER AS position FROM n QUALIFY position <= 10")
def t3_fused_order(spark, sf):
    """The search without a pair score."""
    q, v = question(spark, sf)
    out = retrieve.hybrid_search(corpus(spark, sf), vectors(spark, sf), q, v, [1, 7], pair_score=None)
    return out.select("chunk_id", F.round("fusion_score", 9).alias("fusion_score"), F.round("score", 6).alias("score"), "position")


@query("WITH " + _Q + _D + _S + _K + _U + _F + _R + "SELECT chunk_id, round(fusion, 9) AS fusion_score, round(raw, 6) AS raw_score, round(score, 6) AS score, row_number() OVER (ORDER BY raw DESC, prev)::INTEGER AS position FROM n QUALIFY position <= 10")
def r9_hybrid_search(spark, sf):
    q, v = question(spark, sf)
    out = retrieve.hybrid_search(corpus(spark, sf), vectors(spark, sf), q, v, [1, 7])
    return out.select("chunk_id", F.round("fusion_score", 9).alias("fusion_score"), F.round("raw_score", 6).alias("raw_score"), F.round("score", 6).alias("score"), "position")


_FR = "(SELECT * FROM documents WHERE lang = 'fr' AND source = 'src1')"


@query("WITH " + _Q + _D.replace("FROM embeddings)", f"FROM embeddings WHERE vec_id IN (SELECT doc_id FROM {_FR}))") + _S.replace("FROM documents)", f"FROM {_FR})") + _K.replace("FROM documents WHERE", f"FROM {_FR} WHERE") + _U + _F + _R + "SELECT chunk_id, round(raw, 6) AS raw_score, row_number() OVER (ORDER BY raw DESC, prev)::INTEGER AS position FROM n QUALIFY position <= 10")
def s6_filtered_search(spark, sf):
    """The search in one country and source."""
    q, v = question(spark, sf)
    out = retrieve.hybrid_search(corpus(spark, sf), vectors(spark, sf), q, v, [1, 7], country="fr", source="src1")
    return out.select("chunk_id", F.round("raw_score", 6).alias("raw_score"), "position")


@query("""WITH """ + _Q + """c AS (SELECT * FROM documents WHERE doc_id % 20 + 1 = 7),
d AS (SELECT vec_id AS chunk_id, row_number() OVER (ORDER BY list_inner_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) DESC, vec_id) - 1 AS rank FROM embeddings WHERE vec_id IN (SELECT doc_id FROM c) QUALIFY rank < 100),
sp AS (SELECT doc_id AS chunk_id, len(list_intersect(list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda w: w <> '')), (SELECT list_transform(w, lambda x: lower(x)) FROM q))) AS score FROM c),
s AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) - 1 AS rank FROM sp QUALIFY rank < 100),
k AS (SELECT doc_id AS chunk_id, row_number() OVER (ORDER BY doc_id) - 1 AS rank FROM c QUALIFY rank < 10),
u AS (SELECT 0 AS c, chunk_id, rank, .2 AS w FROM d UNION ALL SELECT 1, chunk_id, rank, .1 FROM s UNION ALL SELECT 2, chunk_id, rank, .7 FROM k), """ + _F + _R + "SELECT chunk_id, round(score, 6) AS score, row_number() OVER (ORDER BY raw DESC, prev)::INTEGER AS position FROM n QUALIFY position <= 10")
def r6_exact_article(spark, sf):
    q, v = question(spark, sf)
    return retrieve.hybrid_search(corpus(spark, sf), vectors(spark, sf), q, v, [7], exact_article=True).select("chunk_id", F.round("score", 6).alias("score"), "position")


def order_scores(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("anchor"), F.col("o_totalprice").alias("s"))


@query("SELECT o_orderkey AS id, round(CASE WHEN max(o_totalprice) OVER w - min(o_totalprice) OVER w < 1e-9 THEN 1.0 ELSE (o_totalprice - min(o_totalprice) OVER w) / (max(o_totalprice) OVER w - min(o_totalprice) OVER w) END, 6) AS score FROM orders WINDOW w AS (PARTITION BY o_custkey % 50)")
def a2_minmax(spark, sf):
    return retrieve.normalise(order_scores(spark, sf), "s", "n", ["anchor"]).select("id", F.round("n", 6).alias("score"))


@query("""WITH n AS (SELECT o_orderkey AS id, o_custkey % 50 AS anchor, o_totalprice AS s, sum((o_totalprice >= 450000)::INT) OVER (PARTITION BY o_custkey % 50) AS passed,
row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_totalprice DESC, o_orderkey) AS i FROM orders) SELECT id, anchor FROM n WHERE CASE WHEN passed >= 3 THEN s >= 450000 ELSE i <= 3 END""")
def p4_threshold_floor(spark, sf):
    return retrieve.threshold(order_scores(spark, sf), "s", 450000, 3, ["anchor"], [F.desc("s"), F.col("id")]).select("id", "anchor")


@query("""WITH n AS (SELECT o_orderkey AS id, o_custkey % 50 AS anchor, o_totalprice / 600000 AS s FROM orders), m AS (SELECT *, sum((s >= 0.05)::INT) OVER (PARTITION BY anchor) AS passed, row_number() OVER (PARTITION BY anchor ORDER BY s DESC, id) AS i FROM n),
t AS (SELECT * FROM m WHERE CASE WHEN passed >= 1 THEN s >= 0.05 ELSE i <= 3 END) SELECT id, anchor, row_number() OVER (PARTITION BY anchor ORDER BY s DESC, id)::INTEGER AS place FROM t QUALIFY place <= 5""")
def p5_anchor_threshold(spark, sf):
    s = order_scores(spark, sf).withColumn("s", F.col("s") / 600000)
    over = Window.partitionBy("anchor").orderBy(F.desc("s"), "id")
    passed = F.sum((F.col("s") >= 0.05).cast("int")).over(Window.partitionBy("anchor"))
    kept = s.withColumn("p", passed).withColumn("i", F.row_number().over(over)).where(F.when(F.col("p") >= 1, F.col("s") >= 0.05).otherwise(F.col("i") <= 3))
    return kept.withColumn("place", F.row_number().over(over)).where("place <= 5").select("id", "anchor", "place")


_EVIDENCE = """t0 AS (SELECT conv_id AS id, turn, role, (conv_id // 2) || ':' || conv_id || ':' || turn AS key, conv_id // 2 AS doc, CASE WHEN turn % 5 <> 4 THEN turn ELSE 100000 + turn END AS o FROM conversations),
nx0 AS (SELECT * FROM (SELECT key AS src, lead(key) OVER (PARTITION BY doc ORDER BY o, turn, key) AS dst FROM t0) WHERE dst IS NOT NULL), nb0 AS (SELECT src, dst FROM nx0 UNION ALL SELECT dst, src FROM nx0),
cmp AS (SELECT key AS src, (doc || ':' || (id + 1) || ':1') AS dst FROM t0 WHERE id % 2 = 0 AND turn = 1),
ev AS (SELECT id, list(DISTINCT role) AS ck, list(DISTINCT key) AS ids, list(DISTINCT turn::VARCHAR) AS nums FROM t0 GROUP BY id),
nb AS (SELECT id, list(DISTINCT dst) AS nb FROM t0 JOIN nb0 ON src = key GROUP BY id), ct AS (SELECT id, list(DISTINCT dst) AS ct FROM t0 JOIN cmp ON src = key GROUP BY id), """
_PAIR = _EVIDENCE + """a AS (SELECT doc_id AS anchor, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')) AS t FROM documents WHERE lang = 'en'),
p AS (SELECT doc_id AS chunk_id, lang AS country, (doc_id % 20 + 1)::VARCHAR AS number, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')) AS t FROM documents WHERE lang <> 'en' ORDER BY doc_id LIMIT 80),
x AS (SELECT anchor, chunk_id, country, number, CASE WHEN len(a.t) + len(p.t) = 0 THEN 0 ELSE len(list_intersect(a.t, p.t)) / (len(a.t) + len(p.t) - len(list_intersect(a.t, p.t)))::DOUBLE END AS re_score FROM a, p),
y AS (SELECT x.*, coalesce(len(list_intersect(ea.ck, ef.ck)), 0) AS keys, coalesce(list_has_any(ct.ct, ef.ids), false) AS direct, coalesce(list_has_any(nb.nb, ef.ids), false) AS near, coalesce(list_contains(ea.nums, number), false) AS same
 FROM x LEFT JOIN ev ea ON ea.id = anchor LEFT JOIN ev ef ON ef.id = chunk_id LEFT JOIN nb ON nb.id = anchor LEFT JOIN ct ON ct.id = anchor),
g AS (SELECT *, least(1.0, least(keys * 0.12, 0.36) + least(keys * 0.08, 0.24) + CASE WHEN direct THEN .28 ELSE 0 END + CASE WHEN near THEN .06 ELSE 0 END + CASE WHEN same THEN .06 ELSE 0 END)::DOUBLE AS graph_score FROM y)"""


def articles(spark, sf):
    """Turns as articles with ids of three parts; two conversations are one law."""
    t = table(spark, sf, "conversations")
    law = F.floor(F.col("conv_id") / 2)
    return t.select(F.concat_ws(":", law.cast("string"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"), law.cast("string").alias("doc"), F.when(F.col("turn") % 5 != 4, F.col("turn").cast("string")).alias("number"), F.col("turn").cast("int").alias("seq"), "role", F.col("conv_id").alias("id"))


def evidence(spark, sf):
    """What the graph knows of each conversation's articles."""
    t = articles(spark, sf)
    edge = lambda df, dst, kind: df.select(F.col("key").alias("src"), dst.alias("dst"), F.lit(kind).alias("type"))
    compare = edge(t.where("id % 2 = 0 and seq = 1"), F.concat_ws(":", "doc", (F.col("id") + 1).cast("string"), F.lit("1")), "COMPARES_TO")
    every = graph.sequence_edges(t, "doc", "number", "seq", "key").unionByName(edge(t, F.col("role"), "RELATES_TO_CONCEPT")).unionByName(compare)
    names = t.select(F.col("role").alias("key"), F.upper("role").alias("name")).distinct()
    return graph.evidence(t.groupBy("id").agg(F.collect_list("key").alias("article_ids")), every, names)


def pairs(spark, sf):
    """Every English document against a capped pool from abroad, which travels to the anchors, with the graph's evidence of each pair."""
    c = corpus(spark, sf)
    anchors = c.where("country = 'en'").select(F.col("chunk_id").alias("anchor"), tx.term_keys(F.col("text")).alias("terms"))
    pool = c.where("country <> 'en'").orderBy("chunk_id").limit(80).select("chunk_id", "country", F.col("article").cast("string").alias("number"), tx.term_keys(F.col("text")).alias("terms"))
    x = match.overlap_pairs(anchors, pool)
    return match.evidence_score(x, evidence(spark, sf))


@query("WITH " + _PAIR + " SELECT anchor, chunk_id, round(re_score, 6) AS re_score, round(graph_score, 6) AS graph_score FROM g")
def r12_graph_score(spark, sf):
    return pairs(spark, sf).select("anchor", "chunk_id", F.round("re_score", 6).alias("re_score"), F.round("graph_score", 6).alias("graph_score"))


_BLEND = _PAIR + """, r AS (SELECT *, CASE WHEN max(re_score) OVER w - min(re_score) OVER w < 1e-9 THEN 1.0 ELSE (re_score - min(re_score) OVER w) / (max(re_score) OVER w - min(re_score) OVER w) END * .75
 + CASE WHEN max(graph_score) OVER w - min(graph_score) OVER w < 1e-9 THEN 1.0 ELSE (graph_score - min(graph_score) OVER w) / (max(graph_score) OVER w - min(graph_score) OVER w) END * .25 AS final FROM g WINDOW w AS (PARTITION BY anchor))"""


@query("WITH " + _BLEND + " SELECT anchor, chunk_id, round(round(final, 9), 6) AS final_score, CASE WHEN max(final) OVER (PARTITION BY anchor) - min(final) OVER (PARTITION BY anchor) < 1e-9 THEN 1.0 ELSE round(round((final - min(final) OVER (PARTITION BY anchor)) / (max(final) OVER (PARTITION BY anchor) - min(final) OVER (PARTITION BY anchor)), 9), 6) END AS display_score FROM r")
def r13_graph_blend(spark, sf):
    return match.blend(pairs(spark, sf), ["anchor"]).select("anchor", "chunk_id", F.round(F.round("final_score", 9), 6).alias("final_score"), F.round(F.round("display_score", 9), 6).alias("display_score"))


@query("WITH " + _BLEND + """, n AS (SELECT anchor, country, chunk_id, row_number() OVER (PARTITION BY anchor, country ORDER BY round(final, 9) DESC, chunk_id) - 1 AS place, count(*) OVER (PARTITION BY anchor, country) AS total FROM r)
SELECT anchor, country, chunk_id, place::INTEGER AS place, CASE WHEN total > 5 THEN 5 END::INTEGER AS next_cursor FROM n WHERE place >= 2 AND place < 5""")
def w4_country_paging(spark, sf):
    b = match.blend(pairs(spark, sf), ["anchor"]).withColumn("f", F.round("final_score", 9))
    return match.page(b, ["anchor", "country"], [F.desc("f"), F.col("chunk_id")], F.lit(2), 3).select("anchor", "country", "chunk_id", "place", "next_cursor")


@query("WITH " + _BLEND + " SELECT anchor, country, chunk_id AS dst FROM r QUALIFY row_number() OVER (PARTITION BY anchor, country ORDER BY round(final, 9) DESC, chunk_id) <= 3")
def w5_compare_topn(spark, sf):
    b = match.blend(pairs(spark, sf), ["anchor"]).withColumn("f", F.round("final_score", 9))
    over = Window.partitionBy("anchor", "country").orderBy(F.desc("f"), "chunk_id")
    return b.withColumn("i", F.row_number().over(over)).where("i <= 3").select("anchor", "country", F.col("chunk_id").alias("dst"))


@query("WITH " + _BLEND + """, tx AS (SELECT doc_id AS chunk_id, text FROM documents), d AS (SELECT r.anchor, r.chunk_id, round(final, 9) AS final FROM r JOIN tx USING (chunk_id) QUALIFY row_number() OVER (PARTITION BY anchor, text ORDER BY final DESC, chunk_id) = 1)
SELECT anchor, chunk_id, row_number() OVER (PARTITION BY anchor ORDER BY final DESC, chunk_id)::INTEGER AS place FROM d QUALIFY place <= 5""")
def j2_graph_match(spark, sf):
    """The whole matcher: pool, pair score, evidence, blend, once for each text, best five."""
    c = corpus(spark, sf)
    pool = c.select("chunk_id", "country", F.col("article").cast("string").alias("number"), "text")
    anchors = c.where("country = 'en'").select(F.col("chunk_id").alias("anchor"), "text")
    out = match.graph_match(anchors, pool, evidence(spark, sf), limit=80, home="en")
    over = Window.partitionBy("anchor").orderBy(F.round("final_score", 9).desc(), "chunk_id")
    return out.withColumn("place", F.row_number().over(over)).where("place <= 5").select("anchor", "chunk_id", "place")


@query("SELECT o_custkey AS cust, o_orderstatus AS status, o_orderkey AS id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY floor(o_totalprice / 10000) DESC, o_orderkey) = 1")
def a5_dedupe_best(spark, sf):
    o = table(spark, sf, "orders").withColumn("s", F.floor(F.col("o_totalprice") / 10000))
    return match.dedupe_best(o, ["o_custkey", "o_orderstatus"], "s", "o_orderkey").select(F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("id"))


@query("""SELECT doc_id, round(n_chars / 1000000.0 + CASE WHEN doc_id % 20 + 1 = 7 THEN CASE WHEN source = 'src1' THEN .8 WHEN source = 'src2' THEN .5 ELSE 0 END ELSE 0 END
+ CASE WHEN doc_id % 11 = 0 THEN .3 ELSE 0 END + CASE lang WHEN 'en' THEN .1 WHEN 'fr' THEN .05 ELSE 0 END + CASE WHEN doc_id % 13 = 0 THEN .15 ELSE 0 END, 6) AS score FROM documents""")
def r15_boost(spark, sf):
    c = corpus(spark, sf)
    strategy = F.when(F.col("source") == "src1", "exact_article").when(F.col("source") == "src2", "multi_article").otherwise("hybrid")
    section = F.when(F.col("country") == "en", "main_body").when(F.col("country") == "fr", "preamble").otherwise("other")
    s = match.boost(F.col("n_chars") / 1000000.0, strategy, F.col("article") == 7, F.col("chunk_id") % 11 == 0, section, F.col("chunk_id") % 13 == 0)
    return c.select(F.col("chunk_id").alias("doc_id"), F.round(s, 6).alias("score"))


_JACCARD = "list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> ''))"


@query("WITH " + _Q + f"""p AS (SELECT doc_id AS chunk_id, {_JACCARD} AS t, (SELECT list_distinct(list_transform(w, lambda x: lower(x))) FROM q) AS a FROM documents WHERE lang = 'fr'),
s AS (SELECT chunk_id, CASE WHEN len(t) + len(a) = 0 THEN 0 ELSE len(list_intersect(t, a)) / (len(t) + len(a) - len(list_intersect(t, a)))::DOUBLE END AS raw FROM p ORDER BY raw DESC, chunk_id LIMIT 5)
SELECT chunk_id, round(raw, 6) AS score, round(CASE WHEN max(raw) OVER () - min(raw) OVER () < 1e-9 THEN 1.0 ELSE (raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER ()) END, 6) AS display_score FROM s""")
def r16_rematch(spark, sf):
    return match.rematch(corpus(spark, sf), question(spark, sf)[0], "fr", retrieve.overlap_score).select("chunk_id", F.round("score", 6).alias("score"), F.round("display_score", 6).alias("display_score"))


@query("WITH " + _Q + f"""c AS (SELECT vec_id, row_number() OVER (ORDER BY list_inner_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) DESC, vec_id) AS prev FROM embeddings JOIN documents ON vec_id = doc_id WHERE lang = 'en' QUALIFY prev <= 10),
s AS (SELECT doc_id, prev, {_JACCARD} AS t, (SELECT list_distinct(list_transform(w, lambda x: lower(x))) FROM q) AS a FROM c JOIN documents ON doc_id = vec_id)
SELECT doc_id AS chunk_id, round(len(list_intersect(t, a)) / (len(t) + len(a) - len(list_intersect(t, a)))::DOUBLE, 6) AS re_score FROM s ORDER BY len(list_intersect(t, a)) / (len(t) + len(a) - len(list_intersect(t, a)))::DOUBLE DESC, prev LIMIT 5""")
def r17_library_search(spark, sf):
    q, v = question(spark, sf)
    c = corpus(spark, sf).where("country = 'en'")
    top = retrieve.dense_channel(vectors(spark, sf).join(c.select("chunk_id"), "chunk_id", "left_semi"), v, 0, 10)
    named = top.join(c.select("chunk_id", "text"), "chunk_id").withColumn("query", F.lit(q))
    return retrieve.rerank(named, retrieve.overlap_score, 5, ["query_id"], [F.col("rank")]).select("chunk_id", F.round("re_score", 6).alias("re_score"))


@query("SELECT o_orderkey AS id, CASE WHEN -(o_totalprice - 200000) / 200 > 709.78 THEN 0.5 ELSE round(1 / (1 + exp(-(o_totalprice - 200000) / 200)), 6) END AS p FROM orders")
def r10_sigmoid(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.round(tx.sigmoid((F.col("o_totalprice") - 200000) / 200), 6).alias("p"))


@query("SELECT doc_id, CASE WHEN n_chars / 4000.0 >= .8 THEN 'high' WHEN n_chars / 4000.0 >= .6 THEN 'medium' ELSE 'low' END AS level, least(1.0, greatest(0.0, n_chars / 4000.0)) AS clamped FROM documents")
def r18_levels(spark, sf):
    return corpus(spark, sf).select(F.col("chunk_id").alias("doc_id"), tx.level(F.col("n_chars") / 4000.0).alias("level"), tx.clamp01(F.col("n_chars") / 4000.0).alias("clamped"))


# ---- graph: conversations are documents, turns are articles


def turns(spark, sf):
    t = table(spark, sf, "conversations")
    return t.select(F.concat_ws(":", "conv_id", "turn").alias("key"), F.col("conv_id").cast("string").alias("doc"), F.when(F.col("turn") % 5 != 4, F.col("turn").cast("string")).alias("number"), F.col("turn").cast("int").alias("seq"), "role")


_NEXT = """t AS (SELECT conv_id || ':' || turn AS key, conv_id, CASE WHEN turn % 5 <> 4 THEN turn ELSE 100000 + turn END AS o, turn, role FROM conversations),
nx AS (SELECT * FROM (SELECT key AS src, lead(key) OVER (PARTITION BY conv_id ORDER BY o, turn) AS dst FROM t) WHERE dst IS NOT NULL),
e AS (SELECT src, dst, 'NEXT' AS type FROM nx UNION ALL SELECT dst, src, 'PREV' FROM nx)"""


@query("WITH " + _NEXT + " SELECT src, dst, type FROM e")
def w7_next_prev(spark, sf):
    return graph.sequence_edges(turns(spark, sf), "doc", "number", "seq", "key").select("src", "dst", "type")


def edges(spark, sf):
    """NEXT and PREV between turns, and an edge from each turn to its role as a concept."""
    t = turns(spark, sf)
    seq = graph.sequence_edges(t, "doc", "number", "seq", "key").withColumns({"score": F.lit(1.0), "query": F.lit(None).cast("string")})
    return seq.unionByName(t.select(F.col("key").alias("src"), F.col("role").alias("dst"), F.lit("RELATES_TO_CONCEPT").alias("type"), (F.col("seq") / 10.0).alias("score"), F.lit(None).cast("string").alias("query")))


@query("WITH " + _NEXT + """ SELECT key AS article, list_sort(list(DISTINCT role)) AS concepts, list_sort(list(DISTINCT n.dst) FILTER (n.dst IS NOT NULL)) AS next_ids, list_sort(list(DISTINCT p.dst) FILTER (p.dst IS NOT NULL)) AS prev_ids
FROM t LEFT JOIN (SELECT * FROM e WHERE type = 'NEXT') n ON n.src = key LEFT JOIN (SELECT * FROM e WHERE type = 'PREV') p ON p.src = key GROUP BY key""".replace("list_sort(list(DISTINCT n.dst) FILTER (n.dst IS NOT NULL))", "coalesce(list_sort(list(DISTINCT n.dst) FILTER (n.dst IS NOT NULL)), [])").replace("list_sort(list(DISTINCT p.dst) FILTER (p.dst IS NOT NULL))", "coalesce(list_sort(list(DISTINCT p.dst) FILTER (p.dst IS NOT NULL)), [])"))
def g3_article_graph(spark, sf):
    n = graph.neighbourhood(edges(spark, sf))
    return n.select(F.col("src").alias("article"), "concepts", F.col("next").alias("next_ids"), F.col("prev").alias("prev_ids")).where(F.size("concepts") > 0)


@query("SELECT conv_id || ':' || turn AS article, conv_id::VARCHAR AS country, role AS concept, turn / 10.0 AS score FROM conversations WHERE contains(lower(role), 'ass') ORDER BY score DESC, country, article LIMIT 20")
def g4_by_concept(spark, sf):
    t = turns(spark, sf)
    concepts = t.select(F.col("role").alias("key"), F.col("role").alias("name")).distinct()
    return graph.by_concept(t.select("key", F.col("doc").alias("country")), concepts, edges(spark, sf), "ASS")


def _expand_sql(depth: int) -> str:
    return f"""WITH RECURSIVE {_NEXT.replace('t AS (', 't AS MATERIALIZED (', 1)}, b AS (SELECT src, dst, src || '>' || type || '>' || dst AS edge FROM e UNION ALL SELECT dst, src, src || '>' || type || '>' || dst FROM e),
w AS (SELECT key AS start, key AS nd, 0 AS hop, []::VARCHAR[] AS path FROM t WHERE turn = 1 UNION ALL SELECT start, dst, hop + 1, list_append(path, edge) FROM w JOIN b ON w.nd = b.src WHERE hop < {depth} AND NOT list_contains(path, edge))
SELECT start, nd AS node, min(hop)::INTEGER AS hop FROM w WHERE hop > 0 GROUP BY start, nd QUALIFY row_number() OVER (PARTITION BY start ORDER BY min(hop), nd) <= 30"""


def _expand(depth: int):
    def f(spark, sf):
        t = turns(spark, sf)
        e = graph.sequence_edges(t, "doc", "number", "seq", "key")
        return graph.expand(e, t.where("seq = 1").select("key"), depth).select("start", "node", "hop")

    f.__name__ = f"g5_expand_depth{depth}"
    query(_expand_sql(depth))(f)


for _depth in (1, 2, 3):
    _expand(_depth)


@query("""SELECT t.conv_id || ':' || t.turn AS src, t.role AS dst, max(t.turn / 10.0) AS score FROM conversations t WHERE t.role <> 'system' AND t.conv_id % 3 <> 0 GROUP BY ALL""")
def g2_edges_semi(spark, sf):
    t = turns(spark, sf)
    e = edges(spark, sf).where("type = 'RELATES_TO_CONCEPT'").withColumn("seq", F.lit(0))
    src, dst = t.where("doc % 3 <> 0").select("key"), t.where("role <> 'system'").select(F.col("role").alias("key")).distinct()
    return graph.connect(e, src, dst).select("src", "dst", "score")


@query("WITH " + _NEXT + " SELECT src, dst, type FROM e WHERE split_part(src, ':', 1)::BIGINT % 4 <> 0")
def g7_delete_doc(spark, sf):
    t = turns(spark, sf)
    e = graph.sequence_edges(t, "doc", "number", "seq", "key")
    return graph.delete_document(t, e, t.where("doc % 4 = 0"))[1].select("src", "dst", "type")


@query("WITH " + _NEXT + """ SELECT conv_id::VARCHAR AS id, list_sort(list(DISTINCT role)) AS concept_keys, coalesce(list_sort(list(DISTINCT dst) FILTER (dst IS NOT NULL)), []) AS neighbours FROM t LEFT JOIN e ON e.src = key GROUP BY conv_id""")
def j9_evidence(spark, sf):
    ids = turns(spark, sf).groupBy(F.col("doc").alias("id")).agg(F.collect_list("key").alias("article_ids"))
    return graph.evidence(ids, edges(spark, sf)).select("id", "concept_keys", "neighbours")


@query("""SELECT c_custkey AS id, o_orderkey AS key, row_number() OVER (PARTITION BY c_custkey ORDER BY CASE WHEN o_orderpriority[1:1] = (c_custkey % 5 + 1)::VARCHAR THEN 0 ELSE 1 END, o_orderkey)::INTEGER AS place
FROM customer JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O' QUALIFY place <= 5""")
def j8_resolve_ids(spark, sf):
    none = F.lit(None).cast("string")
    meta = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("country"), F.lit("O").alias("article"), none.alias("paragraph"), (F.col("c_custkey") % 5 + 1).cast("string").alias("version"))
    art = table(spark, sf, "orders").select(F.col("o_custkey").alias("country"), F.col("o_orderstatus").alias("article"), none.alias("paragraph"), F.substring("o_orderpriority", 1, 1).alias("version"), F.col("o_orderkey").alias("key"), F.col("o_orderkey").alias("seq"))
    return graph.resolve(meta, art)


@query("""SELECT user_id, arg_max(event_type, event_id) FILTER (event_type <> 'view') AS last_type, arg_max(value, event_id) FILTER (value IS NOT NULL) AS last_value FROM events GROUP BY user_id""")
def a19_upsert_lww(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("event_id").alias("seq"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("last_type"), F.col("value").alias("last_value"))
    return graph.upsert(e.where("seq % 2 = 0"), e.where("seq % 2 = 1"), ["user_id"], "seq")
