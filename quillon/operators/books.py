"""Books: their parts, contents, chapters, sections and notes as lines, and chunks of whole books."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators import chunk

# How chapters, sections, notes, contents and other parts of a book are headed.
CHAPTER_EN = r"^(?:Chapter|CHAPTER)\s+(\d+|[IVX]+)(?:\s*[:\-]\s*(.+?))?$"
CHAPTER_KO = r"^제\s*(\d+)\s*장(?:\s*[:\-\.\s]\s*(.+?))?$"
SECTION_NUMBER = r"(?i)^(?:Section|섹션)\s+(\d+(?:\.\d+)*)(?:\s*[:\-]\s*(.+?))?$"
SECTION_MARK = r"^(#+)\s+(.+?)$"
NOTE = r"^\[(\d+)\]\s*(.+?)$"
CONTENTS = r"(?i)^(?:목차|Contents|TABLE OF CONTENTS)$"
CONTENTS_ENTRY = r"^(?:Chapter|제)\s*(\d+|[IVX]+)[:\.\s]+(.+?)\s+\.{2,}\s*(\d+)$"
PARTS = {
    "preface": r"(?i)^(?:Preface|서문|머리말|프롤로그)$",
    "epilogue": r"(?i)^(?:Epilogue|에필로그|맺음말|후기)$",
    "appendix": r"(?i)^(?:Appendix|부록)\s*([A-Z]|\d+)?(?:\s*[:\-]\s*(.+?))?$",
    "references": r"(?i)^(?:References|참고문헌|Bibliography)$",
    "index": r"(?i)^(?:Index|색인)$",
}
TARGET, LEAST = 512, 100


def _group(c: Column, pattern: str, n: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, n), F.lit(""))


def part_of(line: Column) -> Column:
    """What a line heads besides chapters: a preface, an epilogue, an appendix, references or an index."""
    out = F.lit(None).cast("string")
    for name, p in reversed(PARTS.items()):
        out = F.when(line.rlike(p), name).otherwise(out)
    return out


def chapter_lines(lines: DataFrame) -> DataFrame:
    """Lines (doc, line, text) from the first chapter on, with their chapter's place, number and title."""
    number = F.coalesce(_group(F.col("text"), CHAPTER_EN, 1), _group(F.col("text"), CHAPTER_KO, 1))
    title = F.coalesce(_group(F.col("text"), CHAPTER_EN, 2), _group(F.col("text"), CHAPTER_KO, 2), F.lit(""))
    upto = Window.partitionBy("doc").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("_h", F.when(number.isNotNull(), F.struct(number.alias("chapter"), F.trim(title).alias("title"))))
    marked = marked.withColumns({"place": F.sum(F.col("_h").isNotNull().cast("int")).over(upto), "_c": F.last("_h", ignorenulls=True).over(upto)})
    return marked.where("place > 0").select("doc", "line", "text", "place", "_c.chapter", "_c.title")


def sections(lines: DataFrame) -> DataFrame:
    """Headings of sections: their level (marks, or 2 for numbered ones) and title."""
    t = F.col("text")
    marks, number, name = _group(t, SECTION_MARK, 1), _group(t, SECTION_NUMBER, 1), _group(t, SECTION_NUMBER, 2)
    numbered = F.concat(F.lit("Section "), number, F.coalesce(F.concat(F.lit(": "), F.trim(name)), F.lit("")))
    out = lines.withColumns({"level": F.when(marks.isNotNull(), F.length(marks)).when(number.isNotNull(), 2), "title": F.coalesce(F.trim(_group(t, SECTION_MARK, 2)), numbered)})
    return out.where("level is not null").select("doc", "line", "level", "title")


def footnotes(lines: DataFrame) -> DataFrame:
    """Each document's notes by number; of several for a number the last."""
    found = lines.select("doc", "line", _group(F.col("text"), NOTE, 1).alias("number"), F.trim(_group(F.col("text"), NOTE, 2)).alias("note"))
    return found.where("number is not null").groupBy("doc", "number").agg(F.max_by("note", "line").alias("note"))


def contents(lines: DataFrame) -> DataFrame:
    """Entries of a table of contents: between its heading and the first chapter after it."""
    t = F.col("text")
    first = lines.groupBy("doc").agg(F.min(F.when(t.rlike(CONTENTS), F.col("line"))).alias("_from"))
    after = lines.join(first, "doc").where("line > _from")
    upto = Window.partitionBy("doc").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    before = after.withColumn("_n", F.sum((t.rlike(CHAPTER_EN) | t.rlike(CHAPTER_KO)).cast("int")).over(upto)).where("_n = 0")
    return before.where(t.rlike(CONTENTS_ENTRY)).select("doc", "line", *[F.regexp_extract(t, CONTENTS_ENTRY, i).alias(c) for i, c in ((1, "chapter"), (2, "title"))], F.regexp_extract(t, CONTENTS_ENTRY, 3).cast("int").alias("page"))


def _cut(text: str, pattern: str) -> list[tuple[re.Match, str]]:
    """Each heading's match with the text from it to the next."""
    found = list(re.finditer(pattern, text, re.MULTILINE))
    return [(m, text[m.start() : n.start() if n else len(text)].strip()) for m, n in zip(found, [*found[1:], None], strict=False)]


def book(pages: list[tuple[int, str]], target: int = TARGET, least: int = LEAST, count: Callable[[str], int] = chunk.count_words) -> list[tuple[str, str, str]]:
    """(kind, heading, text) chunks of a book: chapters, their sections or packed paragraphs where they are too long; a book without chapters by its pages' sections."""
    full = "\n\n".join(f"[PAGE_{n}]\n{t.strip()}" for n, t in pages if t and t.strip())
    limit = 2 * target

    def packed(text: str, heading: str) -> list[tuple[str, str, str]]:
        return [("split", heading, c) for c, _ in chunk.split_tokens(text, target, least, count)]

    out: list[tuple[str, str, str]] = []
    flat = lambda p: p.replace("(?i)", "")
    for m, text in _cut(full, f"(?:{CHAPTER_EN})|(?:{CHAPTER_KO})"):
        name = m[1] or m[3]
        if count(text) <= limit:
            out.append(("full_chapter", name, text))
            continue
        parts = _cut(text, f"(?:{SECTION_MARK})|(?i:{flat(SECTION_NUMBER)})")
        for s, body in parts:
            out += [("section", f"{name}/{(s[2] or s[3]).strip()}", body)] if count(body) <= limit else packed(body, name)
        if not parts:
            out += packed(text, name)
    if out:
        return out
    for n, t in pages:
        if not t or not t.strip():
            continue
        parts = [(m[2].strip(), text[m.end() - m.start() :].strip()) for m, text in _cut(t, SECTION_MARK)] or [("", t)]
        for title, body in parts:
            if body:
                out += [("section_fallback", title, body)] if count(body) <= limit else packed(body, title or str(n))
    return out


def book_chunks(pages: DataFrame, target: int = TARGET, least: int = LEAST) -> DataFrame:
    """(doc_id, place, kind, heading, text) of pages (doc_id, page, text): as books, or packed paragraphs of each page where that gives nothing.

    A book's pages meet in one task, as a chapter runs over pages. Tasks read their books one after the other from rows
    sorted by book, so that a book costs no call of its own and a task holds one book besides a batch.
    """

    def chunks(doc, held: list[tuple[int, str]]) -> list[tuple]:
        rows = sorted(held)
        made = book(rows, target, least) or [("basic", str(p), c) for p, t in rows for c, _ in chunk.pack(filter(None, map(str.strip, re.split(r"\n\n+", t))), target, least, chunk.count_words)]
        return [(doc, i, *m) for i, m in enumerate(made)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = lambda out: pd.DataFrame(out, columns=["doc_id", "place", "kind", "heading", "text"])
        doc, held = None, []
        for batch in batches:
            out = []
            for d, p, t in zip(batch["doc_id"], batch["page"], batch["text"], strict=True):
                if held and d != doc:
                    out += chunks(doc, held)
                    held = []
                doc = d
                held.append((int(p), t or ""))
            yield frame(out)
        if held:
            yield frame(chunks(doc, held))

    rows = pages.where("doc_id is not null").select("doc_id", "page", "text").repartition("doc_id").sortWithinPartitions("doc_id")
    return rows.mapInPandas(run, "doc_id bigint, place int, kind string, heading string, text string")
