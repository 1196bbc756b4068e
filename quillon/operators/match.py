"""Anchors against candidate pools: graph score, blending, dedupe, grouping and paging."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from quillon.functions import text as tx

from .retrieve import jaccard, normalise


def graph_score(keys: Column, names: Column, direct: Column, neighbour: Column, country: Column, article: Column) -> Column:
    """Evidence of a pair: shared concept keys and names (counts), and four hits."""
    flag = lambda c, v: F.when(c, v).otherwise(0.0)
    total = F.least(keys * 0.12, F.lit(0.36)) + F.least(names * 0.08, F.lit(0.24)) + flag(direct, 0.28) + flag(neighbour, 0.06) + flag(country, 0.08) + flag(article, 0.06)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def blend(df: DataFrame, by: list[str], rerank: str = "re_score", graph: str = "graph_score", weights: tuple[float, float] = (0.75, 0.25)) -> DataFrame:
    """final_score: both scores min-max normalised per anchor and mixed; display_score: the mix normalised again."""
    a, b = (min(1.0, max(0.0, w)) for w in weights)
    a, b = (0.8, 0.2) if a + b == 0 else (a / (a + b), b / (a + b))
    both = normalise(normalise(df, rerank, "_r", by), graph, "_g", by)
    return normalise(both.withColumn("final_score", F.col("_r") * a + F.col("_g") * b).drop("_r", "_g"), "final_score", "display_score", by)


def dedupe_best(df: DataFrame, key: list[str], score: str, position: str) -> DataFrame:
    """The best row of each key; of equal scores the first."""
    over = Window.partitionBy(*key).orderBy(F.desc(score), position)
    return df.withColumn("_i", F.row_number().over(over)).where("_i = 1").drop("_i")


def page(df: DataFrame, group: list[str], order: list[Column], start: Column, size: int) -> DataFrame:
    """Rows [start, start + size) of each group, and where the next page starts (null: nowhere)."""
    over = Window.partitionBy(*group)
    numbered = df.withColumn("_i", F.row_number().over(over.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(over))
    taken = numbered.where((F.col("_i") >= start) & (F.col("_i") < start + size))
    return taken.withColumn("next_cursor", F.when(start + size < F.col("_n"), (start + size).cast("int"))).withColumnRenamed("_i", "place").drop("_n")


def boost(base: Column, strategy: Column, same_article: Column, chapter: Column, section: Column, cases: Column) -> Column:
    """A result's score with the query's hints: exact or multiple article, chapter, kind of section, cited cases."""
    return (
        base + F.when(same_article & (strategy == "exact_article"), 0.8).when(same_article & (strategy == "multi_article"), 0.5).otherwise(0.0)
        + F.when(chapter, 0.3).otherwise(0.0) + F.when(section == "main_body", 0.1).when(section == "preamble", 0.05).otherwise(0.0) + F.when(cases, 0.15).otherwise(0.0)
    )


def rematch(pool: DataFrame, anchor_text: str, country: str, pair_score, top: int = 5) -> DataFrame:
    """A cached pool scored anew against one text, within one country."""
    rows = pool.where(F.col("country") == country).withColumn("raw_score", pair_score(F.lit(anchor_text), F.col("text")))
    best = rows.orderBy(F.desc("raw_score"), "chunk_id").limit(max(1, top)).withColumn("_g", F.lit(0))
    return normalise(best, "raw_score", "display_score", ["_g"]).drop("_g").withColumn("score", F.col("raw_score"))


_SETS = ["article_ids", "concept_keys", "concept_names", "compare_targets", "neighbours"]


def _known(df: DataFrame, evidence: DataFrame, key: str, side: str) -> DataFrame:
    """df with the evidence of its key, as columns of one side."""
    return df.join(evidence.select(F.col("id").alias(key), *[F.col(c).alias(f"_{side}_{c}") for c in _SETS]), key, "left")


def _evidence_score(both: DataFrame, number: str, target: str | None) -> DataFrame:
    """Pairs with the evidence of both sides, which goes, as graph_score."""
    count = lambda c: F.coalesce(F.nullif(F.size(F.array_intersect(f"_a_{c}", f"_b_{c}")), F.lit(-1)), F.lit(0))
    hit = lambda c: F.coalesce(F.arrays_overlap(f"_a_{c}", "_b_article_ids"), F.lit(False))
    numbers = F.transform("_a_article_ids", lambda i: F.get(F.split(i, ":"), F.lit(2)))
    same = F.coalesce(F.array_contains(numbers, F.col(number)), F.lit(False))
    country = F.lit(False) if target is None else F.col("country") == target
    out = both.withColumn("graph_score", graph_score(count("concept_keys"), count("concept_names"), hit("compare_targets"), hit("neighbours"), country, same))
    return out.drop(*[f"_{x}_{c}" for x in "ab" for c in _SETS])


def evidence_score(pairs: DataFrame, evidence: DataFrame, number: str = "number", target: str | None = None) -> DataFrame:
    """pairs (anchor, chunk_id, country, number) with graph_score, from the evidence (id, article_ids, concept_keys, concept_names, compare_targets, neighbours) of both."""
    return _evidence_score(_known(_known(pairs, evidence, "anchor", "a"), evidence, "chunk_id", "b"), number, target)


def shared_keys(pool: list[list[int] | None]) -> Callable[[Column], Column]:
    """For an array of keys without repeats, how many of them each array of the pool holds, by place; of null null.

    Each key is looked up once for the whole pool, so that a row costs its own keys and what they hit.
    """
    at = np.repeat(np.arange(len(pool), dtype="int64"), [len(p or []) for p in pool])
    keys = np.fromiter((k for p in pool for k in p or []), "int64", len(at))
    order = np.argsort(keys, kind="stable")
    vocabulary, first, times = np.unique(keys[order], return_index=True, return_counts=True)
    places = at[order]

    def counts(row) -> np.ndarray | None:
        if row is None:
            return None
        own = np.asarray(row, dtype="int64")
        i = np.minimum(np.searchsorted(vocabulary, own), max(len(vocabulary) - 1, 0))
        i = i[vocabulary[i] == own] if len(vocabulary) else i[:0]
        n = times[i]
        taken = np.repeat(first[i] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(places[taken], minlength=len(pool)).astype("int32")

    @F.pandas_udf("array<int>")
    def shared(s: pd.Series) -> pd.Series:
        return pd.Series([counts(x) for x in s], dtype=object)

    return shared


def graph_match(anchors: DataFrame, pool: DataFrame, evidence: DataFrame, pair_score=jaccard, prepare=tx.term_keys, query: Column | None = None, limit: int = 80, target: str | None = None, home: str = "KR", weights: tuple[float, float] = (0.75, 0.25)) -> DataFrame:
    """Every anchor (anchor, text) against the first limit candidates (chunk_id, country, number, text) from abroad, best first.

    A candidate is scored against the anchor's text, or the query where that is empty: pair_score of what prepare makes of
    both, once for each text. The score is blended with the graph's evidence of the pair; of candidates of one text the
    best stays. The pool is bounded by limit and travels to the anchors with its evidence; anchors get theirs before they
    meet it, so that pairs are made where they are ranked. For the Jaccard similarity of 64-bit keys the driver reads the
    pool's keys, and an anchor's are counted against all of them at once.
    """
    abroad = pool.where(~F.col("country").eqNullSafe(home))
    if target is not None:
        abroad = abroad.where(F.col("country") == target)
    held = abroad.orderBy("chunk_id").limit(max(1, limit))
    said = F.nullif(F.trim("text"), F.lit(""))
    asked = anchors.select("anchor", prepare(said if query is None else F.coalesce(said, query)).alias("_a"))
    offered = held.withColumn("_p", prepare(F.col("text"))).withColumn("_text", F.xxhash64("text")).drop("text")
    if pair_score is jaccard and offered.schema["_p"].dataType == ArrayType(LongType(), offered.schema["_p"].dataType.containsNull):
        rows = offered.collect()
        kinds = StructType([StructField(f.name, f.dataType) for f in offered.schema if f.name != "_p"]).add("_m", IntegerType()).add("_j", IntegerType())
        made = [(*[r[f.name] for f in kinds.fields[:-2]], None if r["_p"] is None else len(r["_p"]), j) for j, r in enumerate(rows)]
        offered = anchors.sparkSession.createDataFrame(made, kinds)
        asked = asked.select("anchor", F.size("_a").alias("_a"), shared_keys([r["_p"] for r in rows])(F.col("_a")).alias("_c"))
        n = F.get("_c", F.col("_j"))
        every = F.col("_a") + F.col("_m") - n
        score = F.when(every > 0, n / every).otherwise(0.0)
    else:
        score = F.coalesce(pair_score(F.col("_a"), F.col("_p")), F.lit(0.0))
    both = _known(asked, evidence, "anchor", "a").join(F.broadcast(_known(offered, evidence, "chunk_id", "b")), F.lit(True))
    told = _evidence_score(both.withColumn("re_score", score), "number", target).drop("_a", "_p", "_c", "_m", "_j")
    scored = blend(told, ["anchor"], weights=weights)
    once = dedupe_best(scored, ["anchor", "_text"], "final_score", "chunk_id").drop("_text")
    place = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("final_score"), "chunk_id"))
    return once.withColumn("place", place)


def overlap_pairs(anchors: DataFrame, pool: DataFrame) -> DataFrame:
    """Every anchor (anchor, terms) with every row of the pool (chunk_id, terms, any more) and re_score, the Jaccard similarity of their terms.

    Shared terms are counted by a join on the term, so that pairs without any cost nothing; the pool is bounded by the request.
    """
    places = pool.select("chunk_id", F.explode("terms").alias("_t")).groupBy("_t").agg(F.collect_list("chunk_id").alias("_c"))
    hits = anchors.select("anchor", F.explode("terms").alias("_t")).join(F.broadcast(places), "_t")  # the terms of a bounded pool
    shared = hits.select("anchor", F.explode("_c").alias("chunk_id")).groupBy("anchor", "chunk_id").agg(F.count(F.lit(1)).alias("_n"))
    left = anchors.select("anchor", F.size("terms").alias("_a"))
    right = pool.withColumn("_p", F.size("terms")).drop("terms")
    both = left.join(F.broadcast(right), F.lit(True)).join(shared, ["anchor", "chunk_id"], "left")
    n = F.coalesce("_n", F.lit(0))
    every = F.col("_a") + F.col("_p") - n
    return both.withColumn("re_score", F.when(every > 0, n / every).otherwise(0.0)).drop("_a", "_p", "_n")
