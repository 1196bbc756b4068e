"""Shapes of results: prompts, boxes on screen, cache keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as tx


def pair_prompt(items: DataFrame, anchors: DataFrame, most: int = 5) -> DataFrame:
    """One prompt for each anchor (anchor, query, title, text): the first item of each of the first countries.

    items: anchor, place (of the country), country, text: one row for each country.
    """
    block = F.trim(F.concat(F.lit("## "), F.col("country"), F.lit("\n"), tx.truncate(F.col("text"), 350, "...")))
    shown = items.where(F.col("place") < most).groupBy("anchor").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", block.alias("b")))), lambda s: s["b"]), "\n\n").alias("blocks"))
    rest = items.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    joined = anchors.join(shown, "anchor", "left").join(rest, "anchor", "left")
    more = F.when(F.col("n") > most, F.concat(F.lit("\n\n(+"), (F.col("n") - most).cast("string"), F.lit(")"))).otherwise("")
    body = F.concat(F.coalesce("blocks", F.lit("(none)")), more)
    return joined.select("anchor", F.concat(F.lit("Query: "), F.col("query"), F.lit("\n\n# "), F.col("title"), F.lit("\n"), tx.truncate(F.col("text"), 500, "..."), F.lit("\n\n"), body).alias("prompt"))


def country_prompt(items: DataFrame, query: Column, each: int = 350) -> DataFrame:
    """One prompt for each country from all of its items (country, place, text)."""
    line = F.concat(F.lit("- "), tx.truncate(F.col("text"), each, "..."))
    return items.groupBy("country").agg(F.concat(F.lit("Query: "), query, F.lit("\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("l")))), lambda s: s["l"]), "\n")).alias("prompt"))


def display_box(boxes: DataFrame, pages: DataFrame, scale: Column, by: str = "page") -> DataFrame:
    """Boxes in pixels, held inside the page; boxes that are nearly the page or thinner than a point go."""
    joined = boxes.join(pages, by)
    inside = lambda c, most: F.greatest(F.lit(0.0), F.least(F.col(c), F.col(most)))
    held = joined.withColumns({"x0": inside("x0", "width"), "x1": inside("x1", "width"), "y0": inside("y0", "height"), "y1": inside("y1", "height")})
    wide, tall = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    kept = held.where((wide >= 1) & (tall >= 1) & ~((wide >= F.col("width") * 0.99) & (tall >= F.col("height") * 0.99)))
    return kept.select(*boxes.drop("x0", "x1", "y0", "y1").columns, *[(F.col(c) * scale).alias(c) for c in ("x0", "y0", "x1", "y1")])
