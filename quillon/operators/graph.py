"""A property graph as vertex and edge DataFrames: vertices (label, key, props), edges (src, dst, type, score, query)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as tx


def upsert(old: DataFrame, new: DataFrame, key: list[str], seq: str) -> DataFrame:
    """Last write wins for each property; a null property keeps what was there. Both have key, seq and properties."""
    props = [c for c in old.columns if c not in (*key, seq)]
    both = old.unionByName(new)
    return both.groupBy(*key).agg(*[F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in props])


def connect(edges: DataFrame, src: DataFrame, dst: DataFrame, seq: str = "seq") -> DataFrame:
    """One edge for each (src, type, dst) whose ends both exist, with its last score and query."""
    kept = edges.join(src.select(F.col("key").alias("src")), "src", "left_semi").join(dst.select(F.col("key").alias("dst")), "dst", "left_semi")
    return kept.groupBy("src", "type", "dst").agg(F.max_by("score", seq).alias("score"), F.max_by("query", seq).alias("query"))


def sequence_edges(articles: DataFrame, doc: str, number: str, seq: str, key: str) -> DataFrame:
    """NEXT and PREV between neighbours in numeric order; articles without number come last, by seq."""
    order = F.coalesce(F.col(number).try_cast("int"), F.lit(100000) + F.col(seq))
    follow = articles.withColumn("dst", F.lead(key).over(Window.partitionBy(doc).orderBy(order, seq, key))).where("dst is not null").select(F.col(key).alias("src"), "dst")
    return follow.withColumn("type", F.lit("NEXT")).unionByName(follow.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("PREV").alias("type")))


def neighbourhood(edges: DataFrame) -> DataFrame:
    """For each source the distinct targets of each type, collected before any join so that nothing fans out."""
    sets = lambda t: F.array_sort(F.collect_set(F.when(F.col("type") == t, F.col("dst"))))
    return edges.groupBy("src").agg(sets("RELATES_TO_CONCEPT").alias("concepts"), sets("COMPARES_TO").alias("compares"), sets("NEXT").alias("next"), sets("PREV").alias("prev"))


def by_concept(articles: DataFrame, concepts: DataFrame, edges: DataFrame, name: str, limit: int = 20) -> DataFrame:
    """Articles of concepts whose name contains the text, best score first."""
    wanted = concepts.where(F.lower("name").contains(name.lower()))
    hits = edges.where("type = 'RELATES_TO_CONCEPT'").join(wanted.select(F.col("key").alias("dst"), "name"), "dst")
    return hits.join(articles.select(F.col("key").alias("src"), "country"), "src").orderBy(F.desc("score"), "country", "src", "dst").limit(limit).select(F.col("src").alias("article"), "country", F.col("name").alias("concept"), "score")


def expand(edges: DataFrame, start: DataFrame, depth: int = 1, limit: int = 30) -> DataFrame:
    """(start, node, hop) of what is reached over 1 to depth edges in either direction.

    An edge is walked once on a path, a node may be met again, so the start is its
    own neighbour at depth two. depth is held to 1..3 and limit to 1..100 nodes.
    """
    depth, limit = min(3, max(1, depth)), min(100, max(1, limit))
    named = edges.withColumn("edge", F.xxhash64("src", "type", "dst"))
    both = named.select("src", "dst", "edge").unionByName(named.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge"))
    step = start.select(F.col("key").alias("start"), F.col("key").alias("at"), F.array().cast("array<bigint>").alias("path"))
    found = None
    for hop in range(1, depth + 1):
        walked = step.join(both, step["at"] == both["src"]).where(~F.array_contains("path", F.col("edge")))
        step = walked.select("start", F.col("dst").alias("at"), F.array_append("path", F.col("edge")).alias("path"))
        reached = step.select("start", F.col("at").alias("node"), F.lit(hop).alias("hop"))
        found = reached if found is None else found.unionByName(reached)
    nearest = found.groupBy("start", "node").agg(F.min("hop").alias("hop"))
    over = Window.partitionBy("start").orderBy("hop", "node")
    return nearest.withColumn("_i", F.row_number().over(over)).where(F.col("_i") <= limit).drop("_i")


def evidence(ids: DataFrame, edges: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """For each (id, article_ids): the union of concepts, comparisons and neighbours of all its articles; only their edges are read.

    names: (key, name) of concepts; without it a concept's key is its name.
    """
    one = ids.select("id", F.explode("article_ids").alias("src"))
    near = neighbourhood(edges.join(one.select("src").distinct(), "src", "left_semi"))
    joined = one.join(near, "src", "left")
    none = F.array().cast("array<string>")
    merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    out = joined.groupBy("id").agg(F.array_sort(F.collect_set("src")).alias("article_ids"), merged("concepts").alias("concept_keys"), merged("compares").alias("compare_targets"), merged(F.concat(F.coalesce("next", none), F.coalesce("prev", none))).alias("neighbours"))
    if names is None:
        return out.withColumn("concept_names", F.col("concept_keys"))
    told = out.select("id", F.explode("concept_keys").alias("key")).join(names, "key").groupBy("id").agg(F.array_sort(F.collect_set("name")).alias("concept_names"))
    return out.join(told, "id", "left").withColumn("concept_names", F.coalesce("concept_names", none))


def build(chunks: DataFrame, most: int = 10) -> tuple[DataFrame, DataFrame]:
    """(articles, edges) of chunks (doc, country, version, seq, article, paragraph, ko, en).

    Articles get their ids from country, version, number and paragraph, and one space between words; edges lead from a
    country to its documents, from those to their articles, along the articles, and to at most so many concepts each.
    """
    ko, en = tx.collapse(F.col("ko")), tx.collapse(F.col("en"))
    key = tx.article_id(F.col("country"), F.col("version"), F.col("article"), F.col("paragraph"), F.col("doc"), F.col("seq"))
    articles = chunks.select(key.alias("key"), "doc", "country", F.col("article").alias("number"), "paragraph", "seq", ko.alias("text_ko"), en.alias("text_en"))
    edge = lambda df, src, dst, kind: df.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(kind).alias("type")).distinct()
    told = articles.withColumn("concept", F.explode(F.slice(tx.concepts(tx.first_text(F.col("text_ko"), F.col("text_en")), fold=True), 1, most))).withColumn("concept", F.concat(F.lit("ko:"), "concept"))
    out = edge(articles, "country", "doc", "HAS_DOCUMENT").unionByName(edge(articles, "doc", "key", "HAS_ARTICLE")).unionByName(edge(told, "key", "concept", "RELATES_TO_CONCEPT"))
    return articles, out.unionByName(sequence_edges(articles, "doc", "number", "seq", "key").select("src", "dst", "type").distinct())


def save_pairs(matches: DataFrame, top: int = 3) -> DataFrame:
    """COMPARES_TO edges from each anchor to its best few of each country; matches: anchor_key, country, key, score, place."""
    over = Window.partitionBy("anchor_key", "country").orderBy("place", "key")
    kept = matches.withColumn("_i", F.row_number().over(over)).where(F.col("_i") <= top)
    return kept.groupBy(F.col("anchor_key").alias("src"), F.col("key").alias("dst")).agg(F.max_by("score", "place").alias("score")).withColumn("type", F.lit("COMPARES_TO"))


def delete_document(vertices: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges without the keys in gone and whatever touches them."""
    keys = gone.select("key").distinct()
    kept = edges.join(keys.withColumnRenamed("key", "src"), "src", "left_anti").join(keys.withColumnRenamed("key", "dst"), "dst", "left_anti")
    return vertices.join(keys, "key", "left_anti"), kept


def resolve(meta: DataFrame, articles: DataFrame, top: int = 5) -> DataFrame:
    """Article keys for (id, country, article, paragraph, version): same version first, then no paragraph, then seq."""
    a = articles.select(F.col("country").alias("c"), F.col("article").alias("n"), F.col("paragraph").alias("p"), F.col("version").alias("v"), "key", "seq")
    hit = meta.join(a, (meta["country"] == a["c"]) & (meta["article"] == a["n"])).where(meta["paragraph"].isNull() | (meta["paragraph"] == F.col("p")))
    over = Window.partitionBy("id").orderBy(F.when(F.col("version") == F.col("v"), 0).otherwise(1), F.when(F.coalesce("p", F.lit("")) == "", 0).otherwise(1), "seq", "key")
    return hit.withColumn("place", F.row_number().over(over)).where(F.col("place") <= top).select("id", "key", "place")
