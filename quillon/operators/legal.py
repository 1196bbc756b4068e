"""Texts of laws as lines: noise, edges, reflow, article blocks, and columns of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as tx

# How lines end that end a sentence, in Korean and in English, and where articles begin inside a text.
KO_ENDS = ["다", "라", "다.", "다,", "함", "임", "음"]
EN_ENDS = [".", "!", "?", ":", ";", ")", '"', "'"]
KO_ARTICLE = r"(?<=^|\n)(?=제\s*\d+\s*조(?:\s|①②③④⑤⑥⑦⑧⑨⑩|$|\(|\[|의|【|〔))"
EN_ARTICLE = r"(?i)(?<=^|\n)(?=Article\s*\(?\s*\d+\s*\)?\b)"


def has_hangul(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike("[가-힣]")


def has_latin(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike("[A-Za-z]")


def body_after_header(line: Column, number: Column) -> Column:
    """What follows the article's header in a line, a suffix number apart; empty where nothing does."""
    ko = F.call_function("regexp_extract", line, F.concat(F.lit(r"제\s*"), number, F.lit(r"\s*조\s*(?:의\s*\d+\s*)?(.*)$")), F.lit(1))
    en = F.call_function("regexp_extract", line, F.concat(F.lit(r"(?i)Article\s*\(?\s*"), number, F.lit(r"\s*\)?\s*(.*)$")), F.lit(1))
    return F.coalesce(F.nullif(F.trim(ko), F.lit("")), F.nullif(F.trim(en), F.lit("")), F.lit(""))


def without_noise(lines: DataFrame, height: str | None = None, edge: float = 90.0) -> DataFrame:
    """Lines without those that carry nothing: fixed patterns, and bare numbers near a page's upper or lower edge (y0, y1)."""
    out = tx.is_noise(F.col("text"))
    if height:
        out = out | (F.col("text").rlike(r"^\s*\d+\s*$") & ((F.col("y0") < edge) | (F.col("y1") > F.col(height) - edge)))
    return lines.where(~F.coalesce(out, F.lit(False)))


def inner_lines(lines: DataFrame, by: list[str], order: str = "line") -> DataFrame:
    """Lines without at most two at each end that are numbers or short and without letters; pages of four lines stay whole."""
    bare = F.col("text").rlike(r"^\s*\d+\s*$") | ((F.length("text") <= 30) & ~has_hangul(F.col("text")) & ~has_latin(F.col("text")))
    page = Window.partitionBy(*by)
    marked = lines.withColumns({"_bare": bare, "_n": F.count(F.lit(1)).over(page), "_i": F.row_number().over(page.orderBy(order))}).withColumn("_j", F.col("_n") - F.col("_i") + 1)
    first, second = (F.coalesce(F.max(F.when(F.col(c) == 1, F.col("_bare"))).over(page), F.lit(False)) for c in ("_i", "_j"))
    drop = F.col("_bare") & ((F.col("_i") == 1) | (F.col("_j") == 1) | ((F.col("_i") == 2) & first) | ((F.col("_j") == 2) & second))
    return marked.withColumn("_drop", drop).where("_n <= 4 or not _drop").drop("_bare", "_n", "_i", "_j", "_drop")


def reflow(c: Column, lang: str = "ko") -> Column:
    """Lines joined to the one before unless that ends a sentence; in English a hyphen at the end joins without a space."""
    lines = F.split(F.coalesce(c, F.lit("")), "\n")
    lead = lambda x: F.substring(x, 1, 1)
    small = lambda x: (lead(x) != "") & (F.lower(lead(x)) == lead(x)) & (F.upper(lead(x)) != lead(x))
    ends = KO_ENDS if lang == "ko" else EN_ENDS

    def closed(held: Column) -> Column:
        tail = held if lang == "ko" else F.rtrim(held)
        out = F.lit(False)
        for e in ends:
            out = out | F.endswith(tail, F.lit(e))
        return out

    def step(state: Column, x: Column) -> Column:
        held, done = state["held"], state["done"]
        goes_on = (lead(x).isin([*"①②③④⑤⑥⑦⑧⑨⑩"]) | small(x)) if lang == "ko" else (small(x) | lead(x).rlike(r"\d"))
        joined = F.when(~closed(held) & (x != "") & goes_on, F.concat(held, F.lit(" "), x))
        if lang != "ko":
            joined = F.when(F.endswith(held, F.lit("-")) & small(x), F.concat(F.substr(held, F.lit(1), F.length(held) - 1), x)).otherwise(joined)
        return F.when(held == "", F.struct(x.alias("held"), done.alias("done"))).when(joined.isNotNull(), F.struct(joined.alias("held"), done.alias("done"))).otherwise(F.struct(x.alias("held"), F.array_append(done, held).alias("done")))

    begin = F.struct(F.lit("").alias("held"), F.array().cast("array<string>").alias("done"))
    return F.aggregate(lines, begin, step, lambda s: F.trim(F.array_join(F.when(s["held"] == "", s["done"]).otherwise(F.array_append(s["done"], s["held"])), "\n")))


def blocks(c: Column, lang: str = "ko", least: int = 10) -> Column:
    """(label, text) of the articles in a text, those under least letters apart; a text without any is one block without label."""
    text = F.coalesce(c, F.lit(""))
    mark = KO_ARTICLE if lang == "ko" else EN_ARTICLE
    head = r"^(제\s*\d+\s*조)" if lang == "ko" else r"(?i)^(Article\s*\(?\s*\d+\s*\)?)"
    parts = F.transform(F.split(text, mark), lambda p: F.struct(F.regexp_replace(F.regexp_extract(p, head, 1), " ", "").alias("label"), F.trim(F.regexp_replace(p, r"^\s+|\s+$", "")).alias("text")))
    # the first part is what stands before the first article
    named = F.filter(F.filter(parts, lambda p: p["label"] != ""), lambda p: F.length(p["text"]) >= least)
    whole = F.array(F.struct(F.lit("").alias("label"), F.trim(text).alias("text")))
    return F.when(text == "", F.slice(whole, 1, 0)).when(F.exists(parts, lambda p: p["label"] != ""), named).otherwise(whole)


def clamp(c: Column, number: Column, lang: str = "ko") -> Column:
    """The block of one article in a text, else the whole text."""
    hit = F.filter(blocks(c, lang), lambda b: F.regexp_extract(b["label"], r"(\d+)", 1) == number)
    return F.coalesce(F.try_element_at(hit, F.lit(1))["text"], F.trim(c))


def body_pages(pages: DataFrame, least: float = 0.8, chars: int = 200) -> DataFrame:
    """Pages (quality, chars) that hold a body."""
    return pages.where((F.col("quality") >= least) & (F.col("chars") >= chars))


def long_chunks(chunks: DataFrame, least: int = 30) -> DataFrame:
    """Chunks (ko, en, article) without those of few letters and no article."""
    body = F.concat(F.coalesce("ko", F.lit("")), F.lit("\n"), F.coalesce("en", F.lit("")))
    return chunks.where((F.length(F.regexp_replace(body, r"^\s+|\s+$", "")) >= least) | (F.coalesce("article", F.lit("")) != ""))


def column_kind(lines: DataFrame, by: list[str]) -> DataFrame:
    """How two columns (side: left, right) are read: one after the other as in a newspaper, or as two languages, and which holds the Korean."""
    share = lambda s: F.sum((has_hangul(F.col("text")) & (F.col("side") == s)).cast("int")) / F.greatest(F.sum((F.col("side") == s).cast("int")), F.lit(1))
    sides = lines.groupBy(*by).agg(share("left").alias("left"), share("right").alias("right"))
    both, none = (F.col("left") >= 0.6) & (F.col("right") >= 0.6), (F.col("left") < 0.3) & (F.col("right") < 0.3)
    return sides.withColumns({"newspaper": both | none, "korean": F.when(~(both | none), F.when(F.col("left") >= F.col("right"), "left").otherwise("right"))})


def column_gap(bins: DataFrame, by: list[str], size: int = 60, first: int = 12, last: int = 47) -> DataFrame:
    """The gap between two columns from a page's word coverage (bin, n; all bins): the widest run of nearly empty bins in the middle.

    A gap needs two bins and a tenth of the coverage on each side; of equal ones the first counts. mid is a share of the width.
    """
    page = Window.partitionBy(*by)
    placed = F.when(F.col("bin").isNotNull(), F.col("n"))
    upto = F.sum(placed).over(page.orderBy("bin").rangeBetween(Window.unboundedPreceding, 0))
    marked = bins.where(" and ".join(f"`{c}` is not null" for c in by)).withColumns({"_t": F.sum("n").over(page), "_s": F.sum(placed).over(page), "_u": upto, "_n": F.sum("n").over(page.orderBy("bin").rangeBetween(0, 0))})
    middle = marked.where((F.col("bin") >= first) & (F.col("bin") <= last) & (F.col("n") <= F.col("_t") * 0.05))
    run = F.col("bin") - F.row_number().over(page.orderBy("bin"))
    # what lies left and right of a run goes along with it, so that nothing is joined back
    gap = F.struct((F.max("bin") - F.min("bin")).alias("w"), (-F.min("bin")).alias("first"), F.max("bin").alias("g1"), F.min_by(F.col("_u") - F.col("_n"), "bin").alias("l"), F.max_by(F.col("_s") - F.col("_u"), "bin").alias("r"), F.max("_t").alias("t"))
    best = middle.withColumn("_r", run).groupBy(*by, "_r").agg(gap.alias("_g")).where("_g.w > 0").groupBy(*by).agg(F.max("_g").alias("b"))
    g0 = -F.col("b.first")
    return best.where("b.t > 0 and b.l / b.t >= 0.1 and b.r / b.t >= 0.1").select(*by, g0.alias("g0"), F.col("b.g1").alias("g1"), ((g0 + F.col("b.g1") + 1) / 2.0 / size).alias("mid"))


def header_box(heads: DataFrame, bodies: DataFrame, by: list[str]) -> DataFrame:
    """Of the boxes of an article's number the one that is its header: near above the body, else in the upper half, else topmost.

    Of boxes as near as each other the left one counts, then the upper one; what is null comes last.
    """
    joined = heads.join(bodies.select(*by, F.col("y0").alias("_b"), "height"), by)
    gap = F.col("_b") - F.col("y1")
    tier = F.when((gap >= -5) & (gap <= 30), 0).when((gap >= -5) & (gap <= 50), 1).when(gap >= -5, 2).when(F.col("y0") < F.col("height") / 2, 3).otherwise(4)
    near = F.when(tier <= 2, F.abs(gap)).otherwise(F.col("y0"))
    order = F.struct(*[c for k in (tier, near, *map(F.col, ("x0", "y0", "x1", "y1"))) for c in (k.isNull(), k)])
    best = F.min_by(F.struct(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]), order).alias("b")
    return joined.groupBy(*by).agg(best).select(*by, "b.*")


def edge_boxes(boxes: DataFrame, by: list[str], height: str = "height", margin: float = 45.0) -> DataFrame:
    """The box around each group's boxes without those inside a page's margins; what reaches into them is cut."""
    kept = boxes.where((F.col("y1") > margin) & (F.col("y0") < F.col(height) - margin))
    return kept.groupBy(*by).agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.greatest(F.min("y0"), F.lit(0.0)).alias("y0"), F.least(F.max("y1"), F.max(height) - margin).alias("y1")).where("x1 > x0 and y1 > y0")


def table_like(rows: DataFrame, by: list[str], header: str = r"(?i)\b(table|total|no)\b|표|합계") -> DataFrame:
    """Whether blocks in rows (row, x0, text) look like a table: many columns filled in nearly every row, or a header's word."""
    width = rows.where("row = 0").groupBy(*by).agg(F.count(F.lit(1)).alias("cols"))
    sums = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("cells"), F.count_distinct("row").alias("rows"), F.count_distinct("x0").alias("edges"), F.max(F.col("text").rlike(header)).alias("head"))
    joined = sums.join(width, by)
    density = F.col("cells") / (F.col("rows") * F.col("cols"))
    return joined.select(*by, "rows", "cols", "edges", density.alias("density"), ((F.col("rows") >= 2) & (F.col("cols") >= 2) & ((density >= 0.7) | F.col("head"))).alias("table"))


def merged_intervals(regions: DataFrame, by: list[str]) -> DataFrame:
    """Regions (first, last) that overlap as one, from the first to the last of any of them."""
    over = Window.partitionBy(*by).orderBy("first", "last")
    reach = F.max("last").over(over.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum((F.col("first") > F.coalesce(reach, F.lit(-1))).cast("int")).over(over.rowsBetween(Window.unboundedPreceding, 0))
    marked = regions.withColumn("_r", reach).withColumn("_i", island)
    return marked.groupBy(*by, "_i").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count(F.lit(1)).alias("parts")).drop("_i")


def paragraph_chunks(lines: DataFrame) -> DataFrame:
    """Lines (doc, line, text) as chunks of one paragraph: an article's header opens one, and so does a paragraph's key inside an article."""
    marked = lines.withColumns({"_h": tx.header_number(F.col("text")), "_p": tx.paragraph_key(F.col("text"))})
    over = Window.partitionBy("doc").orderBy("line")
    upto = over.rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("article", F.last("_h", ignorenulls=True).over(upto))
    opens = F.col("_h").isNotNull() | (F.col("_p").isNotNull() & F.col("article").isNotNull())
    marked = marked.withColumn("_o", opens).withColumn("seq", F.sum(F.col("_o").cast("int")).over(upto))
    key = F.min_by(F.when(F.col("_o") & F.col("_h").isNull(), F.col("_p")), "line")
    return marked.groupBy("doc", "seq").agg(F.coalesce(F.max("article"), F.lit("?")).alias("article"), key.alias("paragraph"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: s["text"]), "\n").alias("text"))
