"""Page-level analytics: repeated edge lines, coverage gaps, boxes, quality, words to lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as tx


def repeated_edge_lines(lines: DataFrame, share: float = 0.25, top: int = 4, bottom: int = 2, least: int = 4, pages: int = 3) -> DataFrame:
    """Texts of the first or last lines of pages that come up on a share of a document's pages; lines: doc, page, line, text."""
    n = F.count(F.lit(1)).over(Window.partitionBy("doc", "page"))
    edge = lines.withColumn("_n", n).where(((F.col("line") < top) | (F.col("line") >= F.col("_n") - bottom)) & (F.length("text") >= least))
    total = lines.groupBy("doc").agg(F.count_distinct("page").alias("pages")).where(F.col("pages") >= pages)
    return edge.groupBy("doc", "text").agg(F.count(F.lit(1)).alias("times")).join(total, "doc").where(F.col("times") / F.col("pages") >= share).select("doc", "text", "times", "pages")


def box_union(boxes: DataFrame, by: list[str], pad: float = 0.0, least: float = 2.0) -> DataFrame:
    """The padded box around each group's boxes; degenerate ones go."""
    out = boxes.groupBy(*by).agg((F.min("x0") - pad).alias("x0"), F.greatest(F.min("y0") - pad, F.lit(0.0)).alias("y0"), (F.max("x1") + pad).alias("x1"), (F.max("y1") + pad).alias("y1"))
    return out.where((F.col("x1") - F.col("x0") >= least) & (F.col("y1") - F.col("y0") >= least))


def coverage(words: DataFrame, width: Column, by: list[str], bins: int = 60) -> DataFrame:
    """How many words cover each of the bins of a page's width."""
    at = lambda c: F.least(F.greatest(F.floor(F.col(c) / width * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    return words.withColumn("bin", F.explode(F.sequence(F.least(at("x0"), at("x1")), at("x1")))).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))


def islands(df: DataFrame, by: list[str], place: str, least: int = 2) -> DataFrame:
    """Runs of consecutive places: first, last and length of each run of at least so many."""
    run = F.col(place) - F.row_number().over(Window.partitionBy(*by).orderBy(place))
    return df.withColumn("_r", run).groupBy(*by, "_r").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("size")).where(F.col("size") >= least).drop("_r")


def page_quality(lines: DataFrame, by: list[str]) -> DataFrame:
    """A page's score: headers and line length speak for content, short lines and index fragments against it."""
    hit = F.col("text").rlike(r"^\s*제\s*\d+\s*조(?:\s|$|\(|\[|의|【|〔)").cast("int") + F.col("text").rlike(r"(?i)^\s*Article\s*\(?\s*\d+\s*\)?\b").cast("int")
    index = F.col("text").rlike(r"^\s*제\s*\d+\s*조\s*제\s*\d+\s*(항|호)\b.*$")
    found = lines.where(F.coalesce(F.col("text"), F.lit("")) != "")
    sums = found.groupBy(*by).agg(
        F.sum(hit).alias("hits"), F.avg(F.length("text")).alias("avg_len"), F.avg((F.length("text") <= 12).cast("double")).alias("short"), F.sum(index.cast("int")).alias("index"),
        F.max(F.col("text").rlike("[가-힣]")).alias("ko"), F.max(F.col("text").rlike("[A-Za-z]")).alias("en"), F.sum(F.length("text")).alias("chars"),
    )
    score = F.col("hits") * 2.0 + F.least(F.col("avg_len") / 40.0, F.lit(2.0)) - F.col("short") * 2.0 - F.col("index") * 1.5 + F.when(F.col("ko") & F.col("en"), 0.5).when(F.col("ko"), 0.3).otherwise(0.0)
    return sums.select(*by, F.greatest(score, F.lit(0.0)).alias("quality"), "chars")


def words_to_lines(words: DataFrame, by: list[str], bucket: float = 3.0) -> DataFrame:
    """Words of one height bucket as a line, from left to right."""
    return words.withColumn("row", F.floor(F.col("y0") / bucket)).groupBy(*by, "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "word_no", "text"))), lambda s: s["text"]), " ").alias("text"))


def carry_forward(lines: DataFrame, by: list[str], order: str, value: Column, name: str) -> DataFrame:
    """The last value that is not null so far."""
    return lines.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def article_chunks(lines: DataFrame, strict_circled: bool = False) -> DataFrame:
    """Lines (doc, line, text) as article chunks: a header opens one, what comes before the first is article ``?``."""
    marked = lines.withColumn("_h", tx.header_number(F.col("text"), strict_circled))
    island = F.sum(F.col("_h").isNotNull().cast("int")).over(Window.partitionBy("doc").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("seq", island).groupBy("doc", "seq").agg(F.coalesce(F.min("_h"), F.lit("?")).alias("article"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: s["text"]), "\n").alias("text"))


def merge_tiny(chunks: DataFrame, most: int = 40) -> DataFrame:
    """Chunks (doc, seq, article, text, and lang if there) of few letters and no article go to the chunk before them; the first always stays.

    Texts are joined within a language only: a chunk's text is that of its first language, search_text that of all, line by line.
    """
    rows = chunks if "lang" in chunks.columns else chunks.withColumn("lang", F.lit(""))
    over = Window.partitionBy("doc").orderBy("seq")
    keep = (F.row_number().over(over) == 1) | (F.length("text") > most) | F.col("article").isNotNull()
    island = rows.withColumn("_k", keep).withColumn("island", F.sum(F.col("_k").cast("int")).over(over.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("seq", "lang", "text"))).alias("_p")
    held = island.groupBy("doc", "island").agg(F.min_by("article", "seq").alias("article"), parts)
    own = F.filter("_p", lambda s: s["lang"].eqNullSafe(F.get("_p", F.lit(0))["lang"]))
    join = lambda p, by: F.array_join(F.transform(p, lambda s: s["text"]), by)
    return held.select("doc", "island", "article", join(own, " ").alias("text"), join(F.col("_p"), "\n").alias("search_text"))
