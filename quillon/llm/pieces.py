"""Encoding a corpus through its distinct pieces, each of which is encoded once in the whole corpus.

A single space between two characters that are not white space always starts a new
match of the byte-level pattern, so the ids of a text are the ids of its space-led
pieces, one after the other; a text with other white space around a space is cut at
every match of the pattern. Three steps:

1. Every task cuts its texts, a few MB at once (a run), numbers the run's distinct
   pieces by frequency, and writes the texts as sequences of these numbers. The
   pieces with their counts go to buckets (one message for each run and bucket that
   has any; a bucket is known by the piece's letters, so that a word and the same
   word before a comma meet). A run's name is a digest of its contents and place, so
   a task that runs again gives the same runs.
2. A bucket encodes its distinct pieces at once and answers every run.
3. Each run meets its answers, and one gather puts the ids of its texts together.

No group is keyed by content: a piece in every document is one entry of each run's
message.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed, released
from .words import slices, text_bytes, word_keys

#: Text of a run, and of the corpus for each bucket.
RUN_BYTES = 12 << 20
BUCKET_BYTES = 24 << 20
#: Marks that end a piece as a match of their own.
TAIL = ".,;:!?)"
#: Default level at which rows are packed.
LEVEL = 3


def matcher(pattern: str = public_tokenizers.PATTERN) -> regex.Pattern:
    """The pattern with white space as the Unicode property, so that U+001C to U+001F do not count."""
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def _plain(column) -> pa.LargeStringArray:
    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    return column


def _one(column) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def cut(column, matches: Callable[[str], list[str]]) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Texts in pieces: the pieces' numbers text by text, how many each text has, the distinct pieces, commonest first, and their counts.

    Joined, its pieces are the text, and each has its ids whatever stands beside it.
    """
    texts = _plain(column)
    lists = pc.split_pattern(texts, " ")
    first = lists.offsets.to_numpy() - lists.offsets[0].as_py() if len(lists) else np.zeros(1, np.int64)
    counts = np.diff(first)
    held = lists.flatten().dictionary_encode()
    words, at = held.dictionary, held.indices.to_numpy()
    # a word that is empty or has white space at an end stands beside white space: its text is cut at every match
    bare = pc.binary_length(pc.utf8_trim_whitespace(words)).to_numpy(zero_copy_only=False)
    odd = (bare == 0) | (bare < pc.binary_length(words).to_numpy(zero_copy_only=False))
    strange = np.flatnonzero(np.bincount(np.repeat(np.arange(len(counts)), counts), odd[at], len(counts))) if len(at) else np.zeros(0, np.int64)
    key = 2 * at + np.int32(1)  # odd: led by a space
    key[first[:-1]] -= 1
    del lists, held, at
    more: dict[str, int] = {}
    if len(strange):
        found = [matches(texts[i].as_py()) for i in strange.tolist()]
        base = 2 * len(words)
        cut_at = np.ones(len(counts), bool)
        cut_at[strange] = False
        usual = np.flatnonzero(cut_at)
        kept = key[ragged(first[usual], counts[usual])]
        counts = counts.copy()
        counts[strange] = [len(f) for f in found]
        starts = np.cumsum(counts) - counts
        new = np.empty(int(counts.sum()), np.int32)
        new[ragged(starts[usual], counts[usual])] = kept
        new[ragged(starts[strange], counts[strange])] = [base + more.setdefault(m, len(more)) for f in found for m in f]
        key = new
    n = np.bincount(key, minlength=2 * len(words) + len(more))
    used = np.flatnonzero(n)
    used = used[np.argsort(-n[used], kind="stable")]
    number = np.empty(len(n), np.int32)
    number[used] = np.arange(len(used))
    every = pa.concat_arrays([words, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), words, pa.scalar("", pa.large_string())), pa.array(list(more), pa.large_string())])
    place = np.where(used < 2 * len(words), used // 2 + (used % 2) * len(words), used)
    return number[key], counts, every.take(pa.array(place)), n[used]


def pack_rows(table: pa.Table, level: int = LEVEL) -> bytes:
    sink, options = pa.BufferOutputStream(), pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=level))
    with pa.ipc.new_stream(sink, table.schema, options=options) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack_rows(blob) -> pa.Table:
    return pa.ipc.open_stream(blob.as_buffer()).read_all()


def pack_values(values: np.ndarray, run: int = 1 << 20) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    parts = [_pack(values[i : i + run]) for i in range(0, len(values), run)]
    return b"".join(c for c, _ in parts), b"".join(d for _, d in parts)


def _pack(values: np.ndarray) -> tuple[bytes, bytes]:
    size = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    code = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    code[: len(values)] = size - 1
    control = (code.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    at = np.cumsum(size, dtype=np.int32) - size
    data = np.zeros(int(at[-1]) + int(size[-1]), np.uint8)
    for k in range(4):
        has = size > k
        data[at[has] + k] = values[has] >> (8 * k) & 0xFF
    return control.tobytes(), data.tobytes()


#: The four value lengths that each control byte stands for.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


def unpack_values(control: np.ndarray, data: np.ndarray, n: int, run: int = 1 << 18) -> np.ndarray:
    out = np.zeros(n, np.uint32)
    before = 0
    for i in range(0, len(control), run):
        part = out[4 * i : 4 * (i + run)]
        size = LENGTHS[control[i : i + run]].reshape(-1)[: len(part)]
        at = np.cumsum(size, dtype=np.int64) - size + before
        for k in range(4):
            has = size > k
            part[has] |= data[at[has] + k].astype(np.uint32) << np.uint32(8 * k)
        before = int(at[-1]) + int(size[-1])
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of runs of the given starts and lengths, one run after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 2**31 and (not len(starts) or starts.max() < 2**31) else np.int64
    out = np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    out += np.arange(total, dtype=kind)
    return out


def strings(column: pa.LargeStringArray) -> list[str]:
    """The column's values, by one join and split where a mark is free."""
    if not len(column):
        return []
    joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(column)], pa.int64()), column), pa.scalar("\x01", pa.large_string()))[0].as_py()
    out = joined.split("\x01")
    return out if len(out) == len(column) else column.to_pylist()


def _runs(text: str, kept: list[str], pattern: str, by_range: bool, level: int):
    def run(batches):
        matches = matcher(pattern).findall
        for k, table in enumerate(slices(batches, RUN_BYTES, text)):
            of = table.column("_q_range").to_numpy() if by_range else np.zeros(table.num_rows)
            for r in np.unique(of).tolist():
                mine = table.filter(pa.array(of == r)) if by_range else table
                yield _run(mine, text, kept, matches, k, r if by_range else None, level)

    return run


def _run(mine: pa.Table, text: str, kept: list[str], matches, k: int, part: int | None, level: int) -> pa.RecordBatch:
    codes, counts, pieces, n = cut(mine.column(text), matches)
    control, data = pack_values(codes)
    held = pa.table({"control": [control], "data": [data], "counts": [counts.astype("<u4").tobytes()]}, schema=pa.schema([(c, pa.large_binary()) for c in ("control", "data", "counts")]))
    rows = [pack_rows(x, level) for x in (mine.select(kept), held, pa.table({"piece": pieces, "n": pa.array(n)}))]
    name = hashlib.blake2b(f"{TaskContext.get().partitionId()} {k} {part} ".encode(), digest_size=8)
    for r in rows:
        name.update(r)
    uid = int.from_bytes(name.digest()) >> 1
    return pa.record_batch({"part": pa.array([uid if part is None else part], pa.int64()), "uid": pa.array([uid], pa.int64()), **{c: pa.array([r], pa.binary()) for c, r in zip(("rows", "codes", "pieces"), rows, strict=True)}})


def _messages(buckets: int, level: int):
    """A run's pieces for each bucket, with their numbers."""

    def run(batches):
        for batch in batches:
            for part, uid, blob in zip(batch.column("part").to_pylist(), batch.column("uid").to_pylist(), batch.column("pieces"), strict=True):
                table = unpack_rows(blob).combine_chunks()
                core = pc.utf8_rtrim(pc.utf8_trim_whitespace(table.column("piece")), characters=TAIL)
                data, offsets = text_bytes(core)
                to = (word_keys(data, offsets[:-1], offsets[1:]) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                edge = np.append(np.flatnonzero(np.diff(to[order], prepend=-1)), len(to))
                table = table.take(pa.array(order))
                for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    step = pa.array(np.diff(order[i:j], prepend=0).astype(np.int32))  # the numbers ascend
                    rows = pack_rows(table.slice(i, j - i).append_column("step", step), level)
                    yield pa.record_batch({"bucket": pa.array([int(to[order[i]])], pa.int32()), "part": pa.array([part], pa.int64()), "uid": pa.array([uid], pa.int64()), "rows": pa.array([rows], pa.binary())})

    return run


def _encode(encoder: Callable[[], Callable[[pa.LargeStringArray], tuple[np.ndarray, np.ndarray]]], level: int):
    def run(asked: pa.Table) -> pa.Table:
        tables = [unpack_rows(b) for b in asked.column("rows")]
        every = pa.concat_arrays([_one(t.column("piece")) for t in tables]).dictionary_encode()
        at, count = every.indices.to_numpy(), np.concatenate([t.column("n").to_numpy() for t in tables])
        ids, ends = encoder()(every.dictionary)
        lengths = np.diff(ends, prepend=0)
        starts = ends - lengths
        # how often each id stands in the corpus
        total = np.bincount(ids, np.repeat(np.bincount(at, count, len(lengths)), lengths)).astype(np.int64)
        some = np.flatnonzero(total)
        out = [(-1, 0, pack_rows(pa.table({"id": pa.array(some, pa.int64()), "n": pa.array(total[some])})))]
        ids = ids.astype(np.uint16 if not len(ids) or ids.max() < 1 << 16 else np.uint32)
        edge = np.cumsum([0, *(t.num_rows for t in tables)]).tolist()
        for part, uid, t, i, j in zip(asked.column("part").to_pylist(), asked.column("uid").to_pylist(), tables, edge[:-1], edge[1:], strict=True):
            size = lengths[at[i:j]]
            flat = ids[ragged(starts[at[i:j]], size)]
            held = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(flat))
            out.append((part, uid, pack_rows(pa.table({"step": t.column("step"), "ids": held}), level)))
        return pa.table({"part": pa.array([o[0] for o in out], pa.int64()), "uid": pa.array([o[1] for o in out], pa.int64()), "rows": pa.array([o[2] for o in out], pa.binary())})

    return freed(run)


@dataclass
class Run:
    """Rows with the ids of their texts, one after the other, and where each text's ids end."""

    rows: pa.Table
    ids: np.ndarray
    ends: np.ndarray

    def texts(self) -> Iterator[np.ndarray]:
        for i, j in zip([0, *self.ends[:-1].tolist()], self.ends.tolist(), strict=False):
            yield self.ids[i:j]


def _assemble(rows, codes, answers: list) -> Run:
    held = unpack_rows(codes)
    counts = np.frombuffer(held.column("counts")[0].as_buffer(), "<u4").astype(np.int64)
    control, data = (np.frombuffer(held.column(c)[0].as_buffer(), np.uint8) for c in ("control", "data"))
    code = unpack_values(control, data, int(counts.sum()))
    told = [unpack_rows(a) for a in answers]
    places = [np.cumsum(t.column("step").to_numpy()) for t in told]
    flats = [_one(t.column("ids")) for t in told]
    pieces = sum(len(p) for p in places)
    start, size, before = np.zeros(pieces, np.int64), np.zeros(pieces, np.int64), 0
    for place, flat in zip(places, flats, strict=True):
        offsets = flat.offsets.to_numpy().astype(np.int64)
        start[place], size[place] = before + offsets[:-1], np.diff(offsets)
        before += int(offsets[-1])
    ids = np.concatenate([f.flatten().to_numpy() for f in flats]) if flats else np.zeros(0, np.uint16)
    length = size[code]
    upto = np.append(0, np.cumsum(length))
    return Run(unpack_rows(rows), ids[ragged(start[code], length)].astype("<u4"), upto[np.cumsum(counts)])


def cut_runs(docs: DataFrame, text: str, kept: list[str], pattern: str = public_tokenizers.PATTERN, ranges=None, level: int = LEVEL) -> DataFrame:
    """part, uid, rows, codes and pieces of each run. With ranges, a column of numbers, a run's part is its range's number; else its name."""
    wanted = docs.select(*dict.fromkeys([text, *kept])) if ranges is None else docs.select(*dict.fromkeys([text, *kept]), ranges.cast("bigint").alias("_q_range"))
    return wanted.mapInArrow(released(_runs(text, kept, pattern, ranges is not None, level)), "part bigint, uid bigint, rows binary, codes binary, pieces binary")


def buckets_of(docs: DataFrame, text: str) -> int:
    return int(max(16, -(-(docs.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0) // BUCKET_BYTES)))


def encoded(runs: DataFrame, encoder, buckets: int, level: int = LEVEL) -> DataFrame:
    """(part, uid, rows): the ids of a run's pieces; at part -1 counts of ids.

    encoder() gives a function that turns an array of pieces into all of their ids and the end of each piece's.
    """
    messages = runs.mapInArrow(released(_messages(buckets, level)), "bucket int, part bigint, uid bigint, rows binary")
    return messages.groupBy("bucket").applyInArrow(_encode(encoder, level), "part bigint, uid bigint, rows binary")


def assembled(runs: DataFrame, answers: DataFrame, finish: Callable[[list[Run], int], pa.Table], schema) -> DataFrame:
    """finish(runs, number) of every part."""

    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        by: dict[int, list] = {}
        for uid, b in zip(told.column("uid").to_pylist(), told.column("rows"), strict=True):
            by.setdefault(uid, []).append(b)
        order = np.argsort(rows.column("uid").to_numpy())
        uids, content, codes = rows.column("uid").to_pylist(), rows.column("rows"), rows.column("codes")
        return finish([_assemble(content[i], codes[i], by.get(uids[i], [])) for i in order.tolist()], rows.column("part")[0].as_py())

    return runs.groupBy("part").cogroup(answers.where("part >= 0").groupBy("part")).applyInArrow(freed(run), schema)
