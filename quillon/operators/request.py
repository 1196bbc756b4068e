"""Requests and their results: candidates as rows for a client, metadata, prompts' completions, collections' state."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as tx

#: Labels of language codes; any other code is its own label.
LANGUAGES = {"ko": "한국어", "en": "English", "ja": "日本語", "zh": "中文"}


def shown(df: DataFrame, home: bool) -> DataFrame:
    """Candidates (country, text_type, has_korean, page, score, display_score, boxes) with what a client expects in place of nulls.

    A page is at least 1 where it is null or 0; boxes that are no list are none; a score is the display score where it is null.
    """
    kind = ("KR", "korean_only", True) if home else ("", "english_only", False)
    return df.withColumns({
        "country": F.coalesce("country", F.lit(kind[0])), "text_type": F.coalesce("text_type", F.lit(kind[1])), "has_korean": F.coalesce("has_korean", F.lit(kind[2])),
        "page": F.when(F.coalesce("page", F.lit(0)) == 0, 1).otherwise(F.col("page")).cast("int"), "score": F.coalesce("score", "display_score", F.lit(0.0)),
        "boxes": F.coalesce(F.from_json("boxes", "array<struct<x0 double,y0 double,x1 double,y1 double>>"), F.array()),
    })


def pick(meta: Column, structure: Column, key: str) -> Column:
    """A key's value at the top where the key is present, even if null, else inside the structure."""
    return F.when(F.coalesce(F.map_contains_key(meta, F.lit(key)), F.lit(False)), F.try_element_at(meta, F.lit(key))).otherwise(F.try_element_at(structure, F.lit(key)))


def flatten(meta: Column, structure: Column, extra: Column, cap: int = 16000) -> Column:
    """A document's metadata: its own keys, those of its structure that it lacks, and extra ones over all; values are cut at cap letters."""
    own = F.map_filter(meta, lambda k, v: ~F.coalesce(F.map_contains_key(extra, k), F.lit(False)))
    rest = F.map_filter(structure, lambda k, v: ~F.map_contains_key(meta, k) & ~F.map_contains_key(extra, k))
    return F.transform_values(F.map_concat(rest, own, extra), lambda k, v: F.substring(v, 1, cap))


def clean_props(props: Column) -> Column:
    """Properties without nulls and empty keys."""
    return F.map_filter(props, lambda k, v: v.isNotNull() & (F.trim(k) != ""))


def document_of(structure_id: Column, top_id: Column, meta_id: Column, country: Column, version: Column, home: bool) -> Column:
    """Which document a result is shown in: the first id that is not empty, else one made of country and version."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    made = F.concat_ws("_", country, F.coalesce(some(version), F.lit("latest"))) if home else F.concat(country, F.lit("_latest"))
    order = (structure_id, top_id, meta_id) if home else (top_id, structure_id, meta_id)
    return F.coalesce(*[some(c) for c in order], made)


def rendered_pages(visible: DataFrame, total: str = "pages") -> DataFrame:
    """The pages to draw: each visible one and its neighbours, without those outside of the document."""
    near = visible.select("doc", total, F.explode(F.array(F.col("page") - 1, F.col("page"), F.col("page") + 1)).alias("page"))
    return near.where((F.col("page") >= 1) & (F.col("page") <= F.col(total))).select("doc", "page").distinct()


def highlighted(boxes: Column) -> Column:
    """Distinct pages that have boxes, ascending."""
    return F.array_sort(F.array_distinct(F.transform(boxes, lambda b: b["page"])))


def first_boxes(own: Column, other: Column) -> Column:
    """An article's boxes, or its paragraph's where it has none."""
    return F.when(F.size(own) > 0, own).otherwise(other)


def valid_boxes(boxes: Column) -> Column:
    return F.filter(boxes, lambda b: (b["x1"] > b["x0"]) & (b["y1"] > b["y0"]))


def grouped(df: DataFrame, by: list[str], group: str, order: list[Column], item: str, position: str) -> DataFrame:
    """One row for each group: its items in order; groups are placed by their first appearance."""
    placed = df.withColumn("_i", F.row_number().over(Window.partitionBy(*by, group).orderBy(*order)))
    made = placed.groupBy(*by, group).agg(F.min(position).alias("_p"), F.transform(F.array_sort(F.collect_list(F.struct("_i", item))), lambda s: s[item]).alias("items"))
    return made.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("_p", group))).drop("_p")


def with_matches(anchors: DataFrame, matches: DataFrame, by: str, items: str = "items") -> DataFrame:
    """Every anchor with its matches, an empty list where it has none."""
    kind = matches.schema[items].dataType
    return anchors.join(matches.select(by, items), by, "left").withColumn(items, F.coalesce(items, F.array().cast(kind)))


def complete(df: DataFrame, model: Callable[[str], str], prompt: str = "prompt", out: str = "completion") -> DataFrame:
    """df with the model's trimmed completion of each prompt; null where the model fails or says nothing.

    model runs on the executors, once for each prompt of an Arrow batch.
    """

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(p: str | None) -> str | None:
            if p is None:
                return None
            try:
                return (model(p) or "").strip() or None
            except Exception:  # a failed completion is a missing one
                return None

        return s.map(one)

    return df.withColumn(out, run(F.col(prompt)))


def summarise(prompts: DataFrame, cached: DataFrame, model: Callable[[str], str], now: Column, ttl: int = 600) -> DataFrame:
    """(key, prompt) with a summary: the cached one (key, summary, ts) while it is younger than ttl seconds, else the model's."""
    fresh = cached.where(F.col("ts") > now - F.make_interval(secs=F.lit(ttl))).groupBy("key").agg(F.max_by("summary", "ts").alias("_old"))
    both = prompts.join(fresh, "key", "left")
    asked = complete(both.withColumn("_ask", F.when(F.col("_old").isNull(), F.col("prompt"))), model, "_ask", "_new")
    return asked.select("key", F.coalesce("_old", "_new").alias("summary"), F.col("_old").isNotNull().alias("hit"))


def relative_day(ts: Column, now: Column) -> Column:
    """Today, yesterday, or month and day, in Korean."""
    days = F.datediff(now, ts)
    return F.when(days == 0, "오늘").when(days == 1, "어제").otherwise(F.concat(F.month(ts).cast("string"), F.lit("월 "), F.dayofmonth(ts).cast("string"), F.lit("일")))


def language_label(code: Column) -> Column:
    out = code
    for k, v in LANGUAGES.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def broken_lines(c: Column) -> Column:
    """A summary with a line break after each closing bracket that ends a remark."""
    return F.regexp_replace(F.regexp_replace(c, r"\)\.\s+", ").\n"), r"\)\s+(?=[^\s.,)])", ")\n")


def canonical_json(parts: dict[str, Column]) -> Column:
    """An object with its keys in order, as one text: strings quoted and escaped, nulls written out."""
    fields = []
    for k in sorted(parts):
        value = F.coalesce(F.regexp_replace(F.to_json(F.struct(parts[k].alias("v")), {"ignoreNullFields": "false"}), r"^\{\"v\":|\}$", ""), F.lit("null"))
        fields.append(F.concat(F.lit(f'"{k}": '), value))
    return F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}"))


def unique_violations(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that stand more than once."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def peek(df: DataFrame, key: str, fields: list[str], limit: int = 10) -> DataFrame:
    """The first rows of a collection by key, negative keys apart, and some of their fields."""
    return df.where(F.col(key) >= 0).orderBy(key).limit(limit).select(key, *fields)


def resolve_key(wanted: DataFrame, objects: DataFrame, meta: DataFrame, candidates: list[Column]) -> DataFrame:
    """(doc, key): the first candidate key that is an object, else the one that the document's metadata names."""
    keys = objects.select("key").distinct()
    tried = wanted.withColumn("_t", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), c.alias("key")) for i, c in enumerate(candidates)])))
    found = tried.select("doc", "_t.i", "_t.key").join(keys, "key").groupBy("doc").agg(F.min_by("key", "i").alias("_k"))
    named = meta.select("doc", F.col("key").alias("_m"))
    return wanted.select("doc").join(found, "doc", "left").join(named, "doc", "left").select("doc", F.coalesce("_k", "_m").alias("key"))


def batch_status(rows: DataFrame, by: str, good: Column, size: int = 300, most: int = 5) -> DataFrame:
    """Rows in batches of size by their place: how many are sent, whether the batch holds a bad row, and at most so many failures."""
    placed = rows.withColumn("batch", F.floor(F.col(by) / size).cast("int")).withColumn("_bad", ~F.coalesce(good, F.lit(False)))
    bad = F.slice(F.array_sort(F.collect_list(F.when(F.col("_bad"), F.col(by)))), 1, most)
    out = placed.groupBy("batch").agg(F.count(F.lit(1)).alias("rows"), F.count_if("_bad").alias("failed"), bad.alias("failures"))
    return out.withColumn("status", F.when(F.col("failed") > 0, "failed").otherwise("inserted"))


def embed(df: DataFrame, key: str, text: str, size: int = 16) -> DataFrame:
    """(key, vector): the default embedding counts distinct terms into cells by a digest and scales the counts to length one; texts without terms have none."""
    terms = df.select(key, F.explode(tx.terms(F.col(text))).alias("_w"))
    cell = F.conv(F.substring(F.md5(F.col("_w")), 1, 4), 16, 10).cast("int") % size
    counts = terms.withColumn("_c", cell).groupBy(key).agg(F.array(*[F.count_if(F.col("_c") == i).cast("double") for i in range(size)]).alias("_n"))
    norm = F.sqrt(F.aggregate("_n", F.lit(0.0), lambda a, x: a + x * x))
    return counts.withColumn("_l", norm).select(key, F.transform("_n", lambda x: x / F.col("_l")).alias("vector"))
