"""Substring dedup by fingerprints of suffixes in prefix groups, in place of suffix trees.

Every word position of every document with at least ``window`` words after it is
a suffix. A suffix is known by the fingerprints on its path from the root: that
of its first ``PREFIX`` words and that of its first ``window`` words.

1. *Prefixes.* One pass counts the suffixes below each short prefix (2**16 bins,
   so what the driver sees is bounded). Runs of light bins are joined, and a bin
   too heavy for one task is cut below a longer prefix, the full window, so that
   variable-length prefixes give groups of about equal, memory-sized numbers of
   suffixes, however common one phrase is.
2. *Subtrees.* Documents are dealt into ranges of doc_id. Each range sends a
   prefix group the distinct suffix fingerprints it holds (8 bytes each, sorted,
   so a passage copied a thousand times in one range is sent once). A group sorts
   its leaves; a run of equal leaves is an internal node ``window`` words deep,
   a repeat. Ranges are ordered by doc_id, so all but the first range at a node
   learn that this node also has a leaf in a smaller document.
3. *Removal.* Each range meets its answers, finds the nodes that repeat within
   the range, and takes the union of all windows whose node has a leaf in a
   smaller document: the maximal repeats, cut out of the text.

No group is keyed by content alone, so a passage in a third of all documents
lands in no single task: it is one leaf for each range.

Defined cases: null, empty and short texts (under ``window`` words) lose
nothing; a null text has no words; rows of equal doc_id are judged alike, and
none counts as smaller than another; a null doc_id takes no part and stays as it
is (its words are still joined by one space). Very long texts are read whole; equal
windows within one document are no ties, as only a smaller doc_id removes; an empty
table gives no rows. Extra columns are passed through.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, freed, ranges, released, shielded
from .words import Rolling, slices, spans, text_bytes, window_starts, word_keys

WINDOW = 50
PREFIX = 4
_BINS = 1 << 16
#: Text in one range of documents, and suffixes in one prefix group at most.
RANGE_BYTES = 4 << 20
GROUP_SUFFIXES = 1 << 20


def _suffixes(table: pa.Table, window: int):
    """Of all suffixes of a table's documents: first word, document, full key, prefix bin; and the words' layout."""
    data, offsets = text_bytes(table.column("_q_text"))
    starts, ends, first = spans(data, offsets)
    roll = Rolling(word_keys(data, starts, ends))
    at, doc = window_starts(first, window)
    ids = table.column("_q_id").to_numpy(zero_copy_only=False) if not table.column("_q_id").null_count else None
    if ids is None:  # a null id takes no part
        known = table.column("_q_id").is_valid().to_numpy()
        at, doc = at[known[doc]], doc[known[doc]]
    full = roll.at(at, window)
    bins = (roll.at(at, min(PREFIX, window)) >> np.uint64(48)).astype(np.int64)
    return at, doc, full, bins, first


def _count_prefixes(window: int):
    def run(batches):
        counts = np.zeros(_BINS, np.int64)
        for table in slices(batches, text="_q_text"):
            counts += np.bincount(_suffixes(table, window)[3], minlength=_BINS)
        at = np.flatnonzero(counts)
        yield pa.record_batch({"bin": pa.array(at.astype(np.int32)), "n": pa.array(counts[at])})

    return run


def prefix_groups(counts: np.ndarray, target: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For each prefix bin its first group and in how many groups it is cut; and the number of groups."""
    first, parts = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    group, filled = 0, 0
    for b in np.flatnonzero(counts):
        n = int(counts[b])
        if filled and filled + n > target:
            group, filled = group + 1, 0
        first[b] = group
        if n > target:
            parts[b] = -(-n // target)
            group, filled = group + int(parts[b]), 0
        else:
            filled += n
    return first, parts, group + 1


def _send(window: int, first: np.ndarray, parts: np.ndarray):
    def run(batches):
        for table in slices(batches, text="_q_text"):
            _, doc, full, bins, _ = _suffixes(table, window)
            if not len(full):
                continue
            chunk = table.column("_q_range").to_numpy()[doc].astype(np.int64)
            group = first[bins] + (full % parts[bins].astype(np.uint64)).astype(np.int64)
            order = np.lexsort((full, group, chunk))
            chunk, group, full = chunk[order], group[order], full[order]
            new = np.ones(len(full), bool)
            new[1:] = (chunk[1:] != chunk[:-1]) | (group[1:] != group[:-1]) | (full[1:] != full[:-1])
            chunk, group, full = chunk[new], group[new], full[new]
            edge = np.flatnonzero(np.concatenate(([True], (chunk[1:] != chunk[:-1]) | (group[1:] != group[:-1]))))
            sizes = np.diff(np.append(edge, len(full)))
            offsets = np.concatenate(([0], np.cumsum(sizes))) * 8
            keys = pa.Array.from_buffers(pa.binary(), len(edge), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(full)])
            yield pa.record_batch({"grp": pa.array(group[edge].astype(np.int32)), "chunk": pa.array(chunk[edge].astype(np.int32)), "keys": keys})

    return run


def _keys(column) -> tuple[np.ndarray, np.ndarray]:
    """All 8-byte keys of a binary column, and how many each row has."""
    data, offsets = text_bytes(column)
    return np.frombuffer(data.tobytes(), np.uint64), np.diff(offsets) // 8


def _subtree(table: pa.Table) -> pa.Table:
    """For each range the leaves at nodes that also have a leaf in an earlier range."""
    table = table.take(pa.array(np.argsort(table.column("chunk").to_numpy(), kind="stable")))
    keys, sizes = _keys(table.column("keys"))
    chunk = np.repeat(table.column("chunk").to_numpy(), sizes)
    order = np.argsort(keys, kind="stable")  # leaves in path order, earlier ranges first
    keys, chunk = keys[order], chunk[order]
    deep = np.zeros(len(keys), bool)
    deep[1:] = keys[1:] == keys[:-1]
    head = np.maximum.accumulate(np.where(deep, 0, np.arange(len(keys))))
    deep &= chunk != chunk[head]
    keys, chunk = keys[deep], chunk[deep]
    order = np.argsort(chunk, kind="stable")
    keys, chunk = keys[order], chunk[order]
    edge = np.flatnonzero(np.concatenate(([True], chunk[1:] != chunk[:-1]))) if len(chunk) else np.zeros(0, np.int64)
    offsets = np.concatenate((edge, [len(keys)])) * 8
    return pa.table({"chunk": pa.array(chunk[edge].astype(np.int32)), "keys": pa.Array.from_buffers(pa.binary(), len(edge), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(keys.copy())])})


def _remove(window: int, passed: list[str]):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        docs = docs.take(pa.array(np.argsort(docs.column("_q_id").fill_null(0).to_numpy(), kind="stable")))
        told = np.sort(_keys(answers.column("keys"))[0])
        kept, n_words, n_removed = [], [], []
        rows = docs.num_rows
        data, offsets = text_bytes(docs.column("_q_text"))
        at, doc, full, _, first = _suffixes(docs, window)
        ids = docs.column("_q_id").fill_null(0).to_numpy()
        drop = np.zeros(len(full), bool)
        if len(full):
            order = np.argsort(full, kind="stable")
            ranked = full[order]
            same = np.concatenate(([False], ranked[1:] == ranked[:-1]))
            head = np.maximum.accumulate(np.where(same, 0, np.arange(len(full))))
            owner = ids[doc[order]]
            drop[order] = owner[head] < owner
            if len(told):
                where = np.minimum(np.searchsorted(told, full), len(told) - 1)
                drop |= told[where] == full
        cover = np.zeros(first[-1] + 1, np.int64)
        hit = at[drop]
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + window, -1)
        keep = np.cumsum(cover)[:-1] == 0
        buffer = memoryview(data)
        for i in range(rows):
            words = bytes(buffer[offsets[i] : offsets[i + 1]]).split()
            mask = keep[first[i] : first[i + 1]]
            n = int(np.count_nonzero(mask))
            kept.append(b" ".join(words if n == len(words) else compress(words, mask)))
            n_words.append(len(words))
            n_removed.append(len(words) - n)
        out = {c: docs.column(c) for c in passed}
        out |= {"_q_n_words": pa.array(n_words, pa.int64()), "_q_n_removed": pa.array(n_removed, pa.int64()), "_q_kept": pa.array(kept, pa.binary()).cast(pa.string())}
        return pa.table(out)

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, range_bytes: int = RANGE_BYTES, group_suffixes: int = GROUP_SUFFIXES) -> DataFrame:
    """docs (doc_id, text, any more) with ``_q_n_words``, ``_q_n_removed`` and ``_q_kept``, the text that stays."""
    passed = docs.columns
    base = docs.select(*[F.col(f"`{c}`") for c in passed], F.col("doc_id").cast("bigint").alias("_q_id"), F.col("text").alias("_q_text"))
    slim = base.select("_q_id", "_q_text")
    counts = np.zeros(_BINS, np.int64)
    for r in slim.mapInArrow(released(_count_prefixes(window)), "bin int, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        counts[r["bin"]] = r["n"]
    first, parts, _ = prefix_groups(counts, int(min(group_suffixes, max(1 << 14, counts.sum() // 64))))
    span = ranges(slim, "_q_id", "_q_text", range_bytes)
    sent = slim.where("_q_id is not null").withColumn("_q_range", span).mapInArrow(released(_send(window, first, parts)), "grp int, chunk int, keys binary")
    answers = sent.groupBy("grp").applyInArrow(freed(_subtree), "chunk int, keys binary")
    schema = T.StructType([*docs.schema.fields, T.StructField("_q_n_words", T.LongType()), T.StructField("_q_n_removed", T.LongType()), T.StructField("_q_kept", T.StringType())])
    dealt = base.withColumn("_q_range", span)
    return dealt.groupBy("_q_range").cogroup(answers.groupBy("chunk")).applyInArrow(freed(_remove(window, passed)), schema)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.col("_q_n_words").alias("n_words"), F.col("_q_n_removed").alias("n_removed"), F.sha2(F.col("_q_kept").cast("binary"), 256).alias("kept_sha256"))


@shielded
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each text without what repeats from a smaller doc_id; other columns stay, n_chars follows the text."""
    out = remove_repeats(docs)
    changed = F.col("_q_n_removed") > 0
    new = {"text": F.when(changed, F.col("_q_kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("_q_kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


QUERIES: dict[str, Callable] = {"op1_substring_dedup": op1_substring_dedup}
#: Windows are compared as text; DuckDB numbers each word of each document.
ORACLE = {
    "op1_substring_dedup": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, len(w) AS n, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50),
k AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h FROM s),
m AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY h) AS first_doc FROM k),
c AS (SELECT doc_id, list(DISTINCT q) AS gone FROM (SELECT doc_id, unnest(range(p, p + 50)) AS q FROM m WHERE first_doc < doc_id) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN c ON d.doc_id = c.doc_id""",
}
