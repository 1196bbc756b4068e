"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

The corpus's distinct pieces are encoded once (see ``pieces``), and their counts
tell how often each id stands in the corpus. Ids are ranked by that, commonest
first, once for all files. Documents are dealt into ranges of doc_id, and each range
becomes one block of ranks in one to four bytes; the lengths stand apart, four to a
control byte, so that a reader gets the lengths of four values from one look into a
256-row table and all values by array operations. Blocks are numbered in ascending
order of doc_id and kept as rows (block, tokens, bytes) of Parquet files in the
shared folder, a container that every file system Spark writes to can hold; block
-1 is the table of ids by rank, as long as the vocabulary at most.

Block layout, little-endian: ``QTF2``; u32 documents, u64 values; i64 doc_id of each
document; u8 whether it is known; u32 values of each document; control bytes; data
bytes. Table layout: ``QTR2``; u32 id of each rank.

Defined cases: null and empty texts hold the end id alone; rows of equal doc_id
follow each other in the order of their ranks; null doc_ids come first, in blocks of
their own; ids of equal counts rank by number; very long texts are encoded whole;
extra columns are not written. An empty table gives no blocks but the table of ids.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, forget, ranges, released, small_batches, written
from .pieces import TAIL, Run, assembled, buckets_of, cut_runs, encoded, pack_values, ragged, strings, unpack_values

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END = 0
#: Text of one block, and blocks whose tokens are summed together first.
BLOCK_BYTES, GROUP = 12 << 20, 4096
_MAGIC, _TABLE = b"QTF2", b"QTR2"
_PLAIN = r"^ [A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+$"


class Encoder:
    """The tokenizers library over pieces; strings of special tokens are ordinary text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        space = np.zeros(self.library.get_vocab_size(), bool)  # ids that begin with a space, which byte-level BPE writes as this letter
        space[[i for t, i in self.library.get_vocab().items() if t.startswith("\u0120")]] = True
        self.space = space

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]  # ids alone, without offsets

    def _flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self._encode(texts)
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int64, int(size.sum())), size

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each has, of space-led words of plain letters, encoded as running text and cut where an id begins with a space."""
        parts = [self._flat([])]
        for i in range(0, len(words), 1000):
            run = words[i : i + 1000]
            ids = np.array(self._encode(["".join(run)])[0], np.int64)
            edge = np.append(np.flatnonzero(self.space[ids]), len(ids))
            parts.append((ids, np.diff(edge)) if len(edge) == len(run) + 1 and not edge[0] else self._flat(run))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def pieces(self, pieces: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after the other, and where each piece's ids end.

        A word of plain letters and the marks after it are two matches, so such a word is encoded once.
        """
        core = pc.utf8_rtrim(pieces, characters=TAIL)
        plain = pc.match_substring_regex(core, _PLAIN)
        core = pc.if_else(plain, core, pieces)
        cores = core.dictionary_encode()
        word = pc.match_substring_regex(cores.dictionary, _PLAIN).to_numpy(zero_copy_only=False)
        at = cores.indices.to_numpy()
        # what follows a core in its piece, by the bytes both have
        cut = pc.binary_length(core).to_numpy(zero_copy_only=False).astype(np.int64)
        whole = pc.binary_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64)
        some = np.flatnonzero(whole > cut)
        tails = pa.array([p[-k:] for p, k in zip(pieces.take(pa.array(some)).to_pylist(), (whole - cut)[some].tolist(), strict=True)], pa.large_string()).dictionary_encode()
        flat, size = [], np.zeros(len(word), np.int64)
        for mine, how in ((np.flatnonzero(word), self._words), (np.flatnonzero(~word), self._flat)):
            ids, n = how(strings(cores.dictionary.take(pa.array(mine))))
            size[mine] = n
            flat.append((mine, ids))
        start = np.zeros(len(word), np.int64)
        before = 0
        for mine, ids in flat:
            start[mine] = before + np.cumsum(size[mine]) - size[mine]
            before += len(ids)
        last, many = self._flat(tails.dictionary.to_pylist())
        every = np.concatenate((*(ids for _, ids in flat), last))
        # each piece's ids are two runs: its core's and its tail's
        lengths = np.zeros((len(pieces), 2), np.int64)
        starts = np.zeros((len(pieces), 2), np.int64)
        lengths[:, 0], starts[:, 0] = size[at], start[at]
        of = tails.indices.to_numpy()
        lengths[some, 1], starts[some, 1] = many[of], (before + np.cumsum(many) - many)[of]
        return every[ragged(starts.reshape(-1), lengths.reshape(-1))], np.cumsum(lengths.sum(axis=1))


_MADE: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _MADE:
        _MADE[path] = Encoder(path)
    return _MADE[path]


def write_block(doc_ids: list[int | None], counts: np.ndarray, ranks: np.ndarray) -> bytes:
    control, data = pack_values(ranks)
    head = _MAGIC + struct.pack("<IQ", len(doc_ids), len(ranks))
    known = np.array([d is not None for d in doc_ids], np.uint8)
    return b"".join([head, np.array([d or 0 for d in doc_ids], "<i8").tobytes(), known.tobytes(), counts.astype("<u4").tobytes(), control, data])


def read_block(block: bytes, table: np.ndarray) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, values of each document, all ids)."""
    if block[:4] != _MAGIC:
        raise ValueError("not a block of token ids")
    docs, n = struct.unpack_from("<IQ", block, 4)
    at = 16

    def take(kind: str, many: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(block, kind, many, at)
        at += out.nbytes
        return out

    doc_ids, known, counts = take("<i8", docs), take("u1", docs), take("<u4", docs)
    control = take("u1", -(-n // 4))
    values = unpack_values(control, np.frombuffer(block, "u1", -1, at), n)
    return [d if k else None for d, k in zip(doc_ids.tolist(), known.tolist(), strict=True)], counts, table[values]


def _counts(batches):
    total = np.zeros(0, np.int64)
    for batch in batches:
        for b in batch.column("rows"):
            held = pa.ipc.open_stream(b.as_buffer()).read_all()
            part = np.bincount(held.column("id").to_numpy(), held.column("n").to_numpy()).astype(np.int64)
            total = np.pad(total, (0, max(0, len(part) - len(total))))
            total[: len(part)] += part
    some = np.flatnonzero(total)
    yield pa.record_batch({"id": pa.array(some, pa.int64()), "n": pa.array(total[some])})


def write(docs: DataFrame, vocabulary: str = VOCABULARY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Write the blocks of docs (doc_id, text) and return them as read back: block, tokens, bytes."""
    small_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    runs = written(cut_runs(slim, "text", ["doc_id"], ranges=ranges(slim, "doc_id", "text", block_bytes)), "piece-runs")
    answers = written(encoded(runs.select("part", "uid", "pieces"), lambda: encoder(vocabulary).pieces, buckets_of(slim, "text")), "piece-ids")
    counts = {r["id"]: r["n"] for r in answers.where("part < 0").mapInArrow(released(_counts), "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()}  # as many rows as the vocabulary has ids
    counts[END] = counts.get(END, 0) + slim.count()
    table = np.array(sorted(counts, key=lambda i: (-counts[i], i)), np.uint32)
    rank = np.zeros(int(table.max()) + 1, np.uint32)
    rank[table] = np.arange(len(table))
    end = rank[END : END + 1].astype("<u4")

    def finish(runs: list[Run], block: int) -> pa.Table:
        ids = [d for r in runs for d in r.rows.column("doc_id").to_pylist()]
        found = [x for r in runs for x in Run(r.rows, rank[r.ids], r.ends).texts()]
        order = sorted(range(len(ids)), key=lambda i: ids[i] or 0)
        if len(set(ids)) < len(ids):  # rows of equal doc_id
            order.sort(key=lambda i: (ids[i] or 0, found[i].tolist()))
        sizes = np.array([len(found[i]) + 1 for i in order])
        ranks = np.concatenate([x for i in order for x in (found[i], end)])
        return pa.table({"block": pa.array([block], pa.int32()), "tokens": pa.array([int(sizes.sum())], pa.int64()), "bytes": pa.array([write_block([ids[i] for i in order], sizes, ranks)], pa.binary())})

    schema = "block int, tokens bigint, bytes binary"
    blocks = assembled(runs.select("part", "uid", "rows", "codes"), answers, finish, schema)
    ids = docs.sparkSession.createDataFrame([(-1, 0, _TABLE + table.astype("<u4").tobytes())], schema)
    out = written(blocks.unionByName(ids), "token-blocks", "zstd")
    forget(answers)
    forget(runs)
    return out


def read(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the blocks."""
    held = bytes(blocks.where("block = -1").select("bytes").first()["bytes"])
    if held[:4] != _TABLE:
        raise ValueError("not a table of token ids")
    table = np.frombuffer(held, "<u4", offset=4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, content in zip(batch.column("block").to_pylist(), batch.column("bytes"), strict=True):
                doc_ids, counts, ids = read_block(content.as_py(), table)
                ends = np.cumsum(counts, dtype=np.int64)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pa.record_batch({"block": pa.array([number] * len(doc_ids), pa.int32()), "doc_id": pa.array(doc_ids, pa.int64()), "before": pa.array(ends - counts), "n_tokens": pa.array(counts.astype(np.int64)), "ids_crc32": pa.array(crc, pa.int64())})

    # the tokens before each block: those of the groups of blocks before its own, and those of its group before it
    sizes = blocks.where("block >= 0").select("block", "tokens", F.floor(F.col("block") / GROUP).alias("of"))
    group = sizes.groupBy("of").agg(F.sum("tokens").alias("n"))
    upto = lambda window: window.rowsBetween(Window.unboundedPreceding, -1)
    group = group.select("of", F.coalesce(F.sum("n").over(upto(Window.orderBy("of"))), F.lit(0)).alias("first"))  # a row for each GROUP blocks
    start = sizes.join(group, "of").select("block", (F.col("first") + F.coalesce(F.sum("tokens").over(upto(Window.partitionBy("of").orderBy("block"))), F.lit(0))).alias("first"))
    docs = blocks.where("block >= 0").select("block", "bytes").mapInArrow(released(run), "block int, doc_id bigint, before bigint, n_tokens bigint, ids_crc32 bigint")
    return docs.join(start, "block").select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(documents(spark, sf_dir)))


QUERIES: dict[str, Callable] = {"op5_token_files": op5_token_files}
ORACLE: dict[str, str] = {}
