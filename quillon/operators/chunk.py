"""Ordered folds over one document: token packing, sentence splitting, chapters, tables.

Packing is a fold over a document's paragraphs; it runs per row in Arrow batches,
so a document is all a task holds at a time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TARGET, LEAST = 512, 100


def count_words(text: str) -> int:
    return len(text.split())


def pack(paragraphs: Iterable[str], target: int, least: int, count: Callable[[str], int]) -> list[tuple[str, int]]:
    """Greedy chunks of paragraphs up to target tokens; any under least is dropped, one too large stays whole."""
    out, held, size = [], [], 0
    for p in paragraphs:
        n = count(p)
        if size + n <= target:
            held.append(p)
            size += n
            continue
        if held and size >= least:
            out.append(("\n\n".join(held), size))
        held, size = [p], n
    if held and size >= least:
        out.append(("\n\n".join(held), size))
    return out


def pieces(text: str, target: int, count: Callable[[str], int]) -> Iterator[tuple[str | None, str, int]]:
    """(joiner, piece, tokens): whole paragraphs, and the sentences and stops of those over target, which open a chunk (joiner None)."""
    for p in filter(None, map(str.strip, text.split("\n\n"))):
        whole = count(p)
        parts = [("\n\n", p)] if whole <= target else [(None, ""), *(("", s) for s in re.split(r"([.!?]\s+)", p))]
        yield from ((joiner, s, whole if joiner else count(s)) for joiner, s in parts)


def split_tokens(text: str, target: int, least: int, count: Callable[[str], int]) -> list[tuple[str, int]]:
    """Like pack, but a paragraph over target is cut at sentence ends, and only the last chunk may be dropped."""
    made = list(pieces(text, target, count))
    # (chunk, tokens so far) after each piece; one that does not fit opens the next chunk
    step = lambda at, x: (at[0], at[1] + x[2]) if x[0] is not None and at[1] + x[2] <= target else (at[0] + 1, x[2])
    placed = list(accumulate(made, step, initial=(0, 0)))[1:]
    out = []
    for _, group in groupby(zip(placed, made, strict=True), key=lambda x: x[0][0]):
        members = list(group)
        body = [(joiner or "", s) for _, (joiner, s, _) in members if s]
        out.append(("".join((joiner if i else "") + s for i, (joiner, s) in enumerate(body)), members[-1][0][1]))
    return [(c.strip(), n) for i, (c, n) in enumerate(out) if c and (i + 1 < len(out) or n >= least)]


def chunk(docs: DataFrame, how: str = "basic", target: int = TARGET, least: int = LEAST, count: Callable[[str], int] = count_words) -> DataFrame:
    """(doc_id, chunk_index, chunk_text, token_count) of docs (doc_id, text)."""

    def run(batches):
        for batch in batches:
            rows = []
            for d, t in zip(batch["doc_id"], batch["text"], strict=True):
                text = t or ""
                made = pack(filter(None, map(str.strip, re.split(r"\n\n+", text))), target, least, count) if how == "basic" else split_tokens(text, target, least, count)
                rows += [(d, i, c, n) for i, (c, n) in enumerate(made)]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "chunk_text", "token_count"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInPandas(run, "doc_id bigint, chunk_index int, chunk_text string, token_count int")


_CHAPTER = re.compile(r"(?:^|\n)(?:(?:Chapter|CHAPTER)\s+(\d+|[IVX]+)(?:[ \t]*[:\-][ \t]*(.+?))?|제\s*(\d+)\s*장(?:[ \t]*[:\-.][ \t]*(.+?))?)(?=\n|$)")


def chapters(docs: DataFrame) -> DataFrame:
    """(doc_id, place, chapter, title, text): what follows each chapter heading; text before the first is dropped."""

    def run(batches):
        for batch in batches:
            rows = []
            for d, t in zip(batch["doc_id"], batch["text"], strict=True):
                found = list(_CHAPTER.finditer(t or ""))
                for i, m in enumerate(found):
                    end = found[i + 1].start() if i + 1 < len(found) else len(t)
                    rows.append((d, i, m[1] or m[3], (m[2] or m[4] or "").strip(), t[m.end() : end].strip()))
            yield pd.DataFrame(rows, columns=["doc_id", "place", "chapter", "title", "text"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInPandas(run, "doc_id bigint, place int, chapter string, title string, text string")


def merge_regions(regions: list[tuple]) -> list[tuple]:
    """(page, start, end, confidence) regions: of overlapping ones the surer stays, or the first grows to the later end."""
    out: list[tuple] = []
    for r in sorted(regions, key=lambda r: (r[0], r[1], -r[3])):
        last = out[-1] if out else None
        if last and last[0] == r[0] and r[1] <= last[2]:
            out[-1] = r if r[3] > last[3] else (last[0], last[1], max(last[2], r[2]), last[3])
        else:
            out.append(r)
    return out


def detect_tables(docs: DataFrame) -> DataFrame:
    """(doc_id, first_line, last_line, kind, confidence): bordered (rows with bars) and borderless (aligned columns) tables."""

    def regions(text: str) -> list[tuple]:
        found, lines = [], text.split("\n")
        for kind, sure, test in (("bordered", 0.7, lambda s: s.count("|") >= 2), ("borderless", 0.6, lambda s: len(re.split(r"\s{2,}|\t", s.strip())) >= 3)):
            start = None
            for i, line in enumerate([*lines, ""]):
                if test(line):
                    start = i if start is None else start
                elif start is not None:
                    if i - start >= 2:
                        found.append((0, start, i - 1, sure, kind))
                    start = None
        return merge_regions(found)

    def run(batches):
        for batch in batches:
            rows = [(d, r[1], r[2], r[4] if len(r) > 4 else "merged", r[3]) for d, t in zip(batch["doc_id"], batch["text"], strict=True) for r in regions(t or "")]
            yield pd.DataFrame(rows, columns=["doc_id", "first_line", "last_line", "kind", "confidence"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInPandas(run, "doc_id bigint, first_line int, last_line int, kind string, confidence double")
