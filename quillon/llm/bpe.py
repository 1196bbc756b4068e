"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The corpus's distinct pieces are gathered by a shuffle (see ``pieces``) and each is
merged once. A bucket lays out its distinct words as linked lists of byte tokens,
with an inverted index from the rank a neighbouring pair would merge into (a rank
is one pair's) to the positions of such pairs. Ranks are taken in ascending order;
all positions of a rank are merged together and only the touched neighbours enter
the index anew. Within a word this is the order of the greedy merges: when a rank
comes up, no pair of any word has a smaller one. The ids are joined back to the
runs of documents.

Defined cases: null and empty texts have no ids and decode to the empty string;
very long texts and words are encoded whole; repeated rows give repeated rows; ties
do not occur, as ranks are distinct; an empty table gives no rows; extra columns are
passed through (the name ``_q_ids`` is the operator's own). Ids are
stored as little-endian unsigned 32-bit integers in one binary value per document.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, released, small_batches
from .pieces import Run, assembled, buckets_of, cut, cut_runs, encoded, matcher, ragged, strings

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Runs and pieces are shuffled more than once, so they are packed more tightly than elsewhere.
PACK_LEVEL = 9


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class MergeReplay:
    """Encode and decode with one vocabulary of ranks."""

    def __init__(self, path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN):
        self.ranks = read_ranks(path)
        self.tokens = {i: b for b, i in self.ranks.items()}
        self.first = np.array([self.ranks[bytes([b])] for b in range(256)])
        self.first_pairs = np.array([[self.ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)])
        # what each pair of tokens merges into, if that is a token
        merged = {self.ranks[t[:k]] << 20 | self.ranks[t[k:]]: r for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks}
        self.pair_keys = np.array(sorted(merged))
        self.pair_ranks = np.array([merged[k] for k in self.pair_keys.tolist()])
        self.matches = matcher(pattern).findall

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What each pair merges into; -1: nothing."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and where each word's ids end."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        n = len(raw)
        sym = self.first[raw]
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        nxt[ends - 1] = -1
        prv[ends[:-1]] = -1
        at = np.flatnonzero(nxt >= 0)
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def enter(rank: np.ndarray, places: np.ndarray) -> None:
            """Put places into the index under the ranks that their pairs merge into."""
            order = np.argsort(rank, kind="stable")
            rank, places = rank[order], places[order]
            edge = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, group in zip(rank[np.append(0, edge)].tolist(), np.split(places, edge), strict=True):
                if r >= 0:
                    if r in index:
                        index[r].append(group)
                    else:
                        index[r] = [group]
                        heappush(queue, r)

        if len(at):
            enter(self.first_pairs[raw[at], raw[at + 1]], at)
        while queue:
            r = heappop(queue)
            held = index.pop(r)
            p = held[0] if len(held) == 1 else np.concatenate(held)
            p = p[(sym[p] >= 0) & (nxt[p] >= 0)]
            p = np.unique(p[self._rank(sym[p], sym[nxt[p]]) == r])  # a neighbour may have been merged away since
            if not len(p):
                continue
            chained = np.zeros(len(p), bool)
            chained[1:] = p[1:] == nxt[p[:-1]]
            if chained.any():  # of overlapping pairs the first, the third and so on
                i = np.arange(len(p))
                p = p[(i - np.maximum.accumulate(np.where(chained, 0, i))) % 2 == 0]
            q = nxt[p]
            sym[p], sym[q] = r, -1
            after, before = nxt[q], prv[p]
            nxt[p] = after
            right = after >= 0
            prv[after[right]] = p[right]
            left = before >= 0
            places = np.concatenate((p[right], before[left]))
            if len(places):
                enter(self._rank(sym[places], sym[nxt[places]]), places)
        alive = sym >= 0
        return sym[alive], np.cumsum(alive)[ends - 1]

    def pieces(self, pieces: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after the other, and where each piece's ids end; a word of several pieces is merged once."""
        found = [self.matches(p) for p in strings(pieces)]
        words = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(found)))}
        if not words:
            return np.zeros(0, np.int64), np.zeros(len(pieces), np.int64)
        ids, ends = self.replay([w.encode() for w in words])
        of = np.fromiter(map(words.__getitem__, chain.from_iterable(found)), np.int64)
        lengths = np.diff(ends, prepend=0)
        flat = ids[ragged((ends - lengths)[of], lengths[of])]
        upto = np.append(0, np.cumsum(lengths[of]))
        return flat, upto[np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))]

    def encode(self, texts: list[str]) -> list[bytes]:
        codes, counts, pieces, _ = cut(pa.array(texts, pa.large_string()), self.matches)
        ids, ends = self.pieces(pieces)
        size = np.diff(ends, prepend=0)
        flat = ids[ragged((ends - size)[codes], size[codes])].astype("<u4")
        edge = np.append(0, np.cumsum(size[codes]))[np.append(0, np.cumsum(counts))]
        return [flat[i:j].tobytes() for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decimal_digest(self, ids: bytes) -> str:
        """SHA-256 of the ids as decimal text."""
        return hashlib.sha256(" ".join(map(str, np.frombuffer(ids, "<u4").tolist())).encode()).hexdigest()


_MADE: dict[tuple[str, str], MergeReplay] = {}


def codec(path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> MergeReplay:
    """One codec for each worker."""
    if (path, pattern) not in _MADE:
        _MADE[path, pattern] = MergeReplay(path, pattern)
    return _MADE[path, pattern]


def _encoded(docs: DataFrame, finish: Callable, schema, vocabulary: str, pattern: str, text: str, kept: list[str]) -> DataFrame:
    small_batches(docs.sparkSession)
    # both of its uses read one exchange of the runs
    runs = cut_runs(docs, text, kept, pattern, level=PACK_LEVEL).repartition("part")
    return assembled(runs, encoded(runs, lambda: codec(vocabulary, pattern).pieces, buckets_of(docs, text), PACK_LEVEL), finish, schema)


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN, text: str = "text") -> DataFrame:
    """docs with ``_q_ids``, the ids of each text."""

    def finish(runs: list[Run], _: int) -> pa.Table:
        return pa.concat_tables([r.rows.append_column("_q_ids", pa.array([x.tobytes() for x in r.texts()], pa.binary())) for r in runs])

    return _encoded(docs, finish, T.StructType([*docs.schema.fields, T.StructField("_q_ids", T.BinaryType())]), vocabulary, pattern, text, docs.columns)


def decode(df: DataFrame, vocabulary: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """df (with ``_q_ids``) with ``_q_bytes``, the bytes the ids stand for."""

    def run(batches):
        made = codec(vocabulary, pattern)
        for batch in batches:
            held = pa.array([made.decode(x or b"") for x in batch.column("_q_ids").to_pylist()], pa.binary())
            yield from pa.Table.from_batches([batch]).append_column("_q_bytes", held).to_batches()

    return df.mapInArrow(released(run), T.StructType([*df.schema.fields, T.StructField("_q_bytes", T.BinaryType())]))


def digests(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Of each text's ids, and of the bytes they decode to."""

    def finish(runs: list[Run], _: int) -> pa.Table:
        made = codec(vocabulary, pattern)
        parts = []
        for r in runs:
            n, ids, decoded = [], [], []
            for x in r.texts():
                found = x.tobytes()
                n.append(len(x))
                ids.append(made.decimal_digest(found))
                decoded.append(hashlib.sha256(made.decode(found)).hexdigest())
            parts.append(pa.table({"doc_id": r.rows.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}))
        return pa.concat_tables(parts)

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return _encoded(slim, finish, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", vocabulary, pattern, "text", ["doc_id"])


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the ids of each text and proof that they decode to it."""
    return digests(docs)


QUERIES: dict[str, Callable] = {"op9_byte_bpe": op9_byte_bpe}
ORACLE: dict[str, str] = {}
