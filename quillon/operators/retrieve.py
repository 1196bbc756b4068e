"""Hybrid retrieval: dense, lexical and key channels, reciprocal-rank fusion, rerank, normalisation, threshold, top-k.

A search is one query: its vector and words are literals, so that the corpus is scanned
and never joined; results carry its query_id. A corpus row is (chunk_id, text, country, article). Orders are total: ties go to the smaller chunk_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as tx

DENSE, SPARSE, KEYWORD = 0, 1, 2


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def ranked(df: DataFrame, order: list[Column], limit: int, by: str = "query_id") -> DataFrame:
    """The first rows of each query with their 0-based rank."""
    over = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(over) - 1).where(F.col("rank") < limit)


def dense_channel(corpus: DataFrame, vector: list[float], query_id, limit: int = 100) -> DataFrame:
    """One query against all vectors (chunk_id, embedding): a literal, no join; top rows by TakeOrderedAndProject."""
    score = inner_product(F.col("embedding"), F.lit(vector))
    top = corpus.select("chunk_id", score.alias("score")).orderBy(F.desc("score"), "chunk_id").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")) - 1).select(F.lit(query_id).alias("query_id"), "chunk_id", "score", F.lit(DENSE).alias("channel"), "rank")


def sparse_channel(corpus: DataFrame, query: str, query_id, limit: int = 100, cap: int | None = None) -> DataFrame:
    """Shared distinct words; documents that share none are ranked too. cap: only so many of the first chunk_ids."""
    source = corpus if cap is None else corpus.orderBy("chunk_id").limit(cap)
    wanted = F.array(*[F.lit(w) for w in sorted(set(query.lower().split()))])
    top = source.select("chunk_id", F.size(F.array_intersect(tx.terms(F.col("text")), wanted)).cast("double").alias("score")).orderBy(F.desc("score"), "chunk_id").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")) - 1).select(F.lit(query_id).alias("query_id"), "chunk_id", "score", F.lit(SPARSE).alias("channel"), "rank")


def keyword_channel(corpus: DataFrame, numbers: list[int], query_id, each: int = 10) -> DataFrame:
    """Chunks of each named article; ranks run on across numbers."""
    hits = corpus.where(F.col("article").isin(numbers)).withColumn("n", F.row_number().over(Window.partitionBy("article").orderBy("chunk_id"))).where(F.col("n") <= each)
    return hits.select(F.lit(query_id).alias("query_id"), "chunk_id", F.lit(1.0).alias("score"), F.lit(KEYWORD).alias("channel"), (F.row_number().over(Window.orderBy("article", "chunk_id")) - 1).alias("rank"))


def fuse(candidates: DataFrame, weights: tuple[float, float, float] = (0.5, 0.3, 0.2), k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of (query_id, chunk_id, channel, rank). Weights that sum to nothing mean dense alone."""
    total = sum(weights)
    w = [x / total for x in weights] if total > 0 else [1.0, 0.0, 0.0]
    weight = F.lit(0.0)
    for channel, value in enumerate(w):
        weight = F.when(F.col("channel") == channel, value).otherwise(weight)
    part = weight / (F.lit(k) + F.col("rank") + 1)
    rank_of = lambda c: F.max(F.when(F.col("channel") == c, F.col("rank")))
    named = candidates.where(F.col("chunk_id").isNotNull()).withColumn("part", part)
    return named.groupBy("query_id", "chunk_id").agg(
        F.sum("part").alias("fusion_score"), rank_of(DENSE).alias("dense_rank"), rank_of(SPARSE).alias("sparse_rank"), rank_of(KEYWORD).alias("keyword_rank"), F.min(F.struct("channel", "rank")).alias("first")
    )


def normalise(df: DataFrame, score: str, out: str, by: list[str]) -> DataFrame:
    """Min-max within each group; a range under 1e-9 makes every value 1."""
    over = Window.partitionBy(*by)
    low, high = F.min(score).over(over), F.max(score).over(over)
    return df.withColumn(out, F.when(high - low < 1e-9, 1.0).otherwise((F.col(score) - low) / (high - low)))


def threshold(df: DataFrame, score: str, least: float | None, floor: int, by: list[str], order: list[Column]) -> DataFrame:
    """Rows that reach the threshold; where fewer than floor do, the first max(floor, 1)."""
    if not least or least <= 0:
        return df
    everything = Window.partitionBy(*by)
    passed = F.col(score) >= least
    marked = df.withColumn("_n", F.sum(passed.cast("int")).over(everything)).withColumn("_i", F.row_number().over(everything.orderBy(*order)))
    return marked.where(F.when(F.col("_n") >= floor, passed).otherwise(F.col("_i") <= max(floor, 1))).drop("_n", "_i")


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays without repeats; of two empty ones 0. The intersection is bound to a name, so that it is made once."""
    every = F.size(a) + F.size(b)
    shared = F.transform(F.array(F.size(F.array_intersect(a, b))), lambda n: F.when(every > n, n / (every - n)).otherwise(0.0))
    return F.get(shared, F.lit(0))


def overlap_score(query: Column, text: Column) -> Column:
    """The default pair score: Jaccard similarity of the two term sets."""
    return jaccard(tx.terms(query), tx.terms(text))


def rerank(df: DataFrame, pair_score, top: int, by: list[str], previous: list[Column], cap: int | None = None) -> DataFrame:
    """Score (query, text) pairs of the first cap rows of each group and keep the best top, ties in the previous order."""
    over = Window.partitionBy(*by)
    placed = df.withColumn("prev", F.row_number().over(over.orderBy(*previous)))
    if cap is not None:
        placed = placed.where(F.col("prev") <= cap)
    scored = placed.withColumn("re_score", pair_score(F.col("query"), F.col("text")))
    return scored.withColumn("_i", F.row_number().over(over.orderBy(F.desc("re_score"), "prev"))).where(F.col("_i") <= max(1, top)).drop("_i")


def hybrid_search(
    corpus: DataFrame, vectors: DataFrame, query: str, vector: list[float], articles: list[int], query_id=0, top_k: int = 10, initial: int = 100, least: float | None = None, min_results: int = 1,
    weights=(0.5, 0.3, 0.2), exact_article: bool = False, sparse_cap: int | None = None, pair_score=overlap_score, country: str | None = None, source: str | None = None,
) -> DataFrame:
    """All channels, fused, reranked, normalised, thresholded.

    exact_article restricts every channel to the article and favours keys; country and source restrict the
    corpus. The first max(4 * top_k, 50) fused rows are scored as pairs with the query (pair_score; None: the
    fusion score stays), raw_score is that score and score the same between 0 and 1.
    """
    if country is not None or source is not None or exact_article:
        for name, value in (("country", country), ("source", source)):
            corpus = corpus if value is None else corpus.where(F.col(name) == value)
        corpus = corpus.where(F.col("article").isin(articles)) if exact_article else corpus
        vectors = vectors.join(corpus.select("chunk_id"), "chunk_id", "left_semi")
    if exact_article:
        weights = (0.2, 0.1, 0.7)
    found = dense_channel(vectors, vector, query_id, initial).unionByName(sparse_channel(corpus, query, query_id, initial, sparse_cap))
    if articles:
        found = found.unionByName(keyword_channel(corpus, articles, query_id))
    order = [F.desc("fusion_score"), F.col("first"), F.col("chunk_id")]
    fused = fuse(found, weights)
    if pair_score is None:
        ranked_ = fused.withColumn("raw_score", F.col("fusion_score")).withColumn("prev", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    else:
        cap = max(4 * top_k, 50)
        over = Window.partitionBy("query_id").orderBy(*order)
        first = fused.withColumn("prev", F.row_number().over(over)).where(F.col("prev") <= cap)
        # at most cap rows meet the corpus
        texts = corpus.select("chunk_id", "text").join(F.broadcast(first.select("chunk_id")), "chunk_id", "left_semi")
        named = first.join(texts, "chunk_id", "left").withColumn("re_score", pair_score(F.lit(query), F.coalesce("text", F.lit("")))).drop("text")
        ranked_ = named.withColumn("raw_score", F.coalesce("re_score", "fusion_score"))
    scored = normalise(ranked_, "raw_score", "score", ["query_id"]).withColumn("display_score", F.col("score"))
    best = [F.desc("raw_score"), F.col("prev")]
    kept = threshold(scored, "score", least, min_results, ["query_id"], best)
    out = kept.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(*best)))
    return out.where(F.col("position") <= top_k) if top_k else out
