"""Benchmark decontamination by template canonicalisation.

A text becomes a row of tokens: words in lower case without outer punctuation, in
which numbers, units after numbers and names (capitals within a sentence) give
way to typed placeholders. Windows of ``WINDOW`` tokens of both sides are joined
by hash; what stood in the placeholders travels along as slots. For a document
and an item the slots must be consistent: one value of the item stands for one
value of the document throughout. An item is in a document if consistent windows
cover at least ``COVER`` of the item's windows, so the same question with other
numbers or names is caught, and a chance hit of a few words is not.

Every text is read with names as words, with names within a sentence as
placeholders, and with every capital as one, those that open a sentence too, so that
a passage is found whatever sentence it was pasted into and wherever its names stand.
A window of fewer than three words outside of placeholders grows, forwards and
backwards, until it has three, and it also counts, ungrown, if all of its values are
the same. So every window of an item can be covered by the item's own copy.

Only windows whose hash passes a bit map of the benchmark's windows (2**22 bits,
whatever the benchmark's size) leave a task; the join then decides exactly. The
benchmark's side is broadcast only while its counted rows are under
``BROADCAST_ROWS``, and shuffled beyond.

Defined cases: null and empty texts match nothing; an item of fewer tokens than a
window is one window of its own length if it has ``LEAST`` tokens, and is too
short to be evidence below that, and if it has too few words outside of placeholders
only its exact copy is evidence; repeated rows are judged alike, by the union of their
windows; a null doc_id is kept and never judged; very long texts are read whole; of values
equally often in a slot the item's own counts, else the smallest; an empty table gives
no rows; extra columns are passed through.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, released, shielded
from .words import LOWER, Rolling, mix, slices, spans, text_bytes, window_starts, word_keys

WINDOW = 5
LEAST = 3
COVER = 0.8
BROADCAST_ROWS = 100_000
_BITS = 22
_LITERALS = 3
U = np.uint64
#: Units that a number before them turns into a placeholder.
UNITS = "mm cm m km in ft yd mi mg g kg t lb lbs oz ml l kb mb gb tb s sec min h hr hrs hour hours day days week weeks month months year years minute minutes second seconds meter meters metre metres kilometer kilometers mile miles gram grams kilogram kilograms pound pounds liter liters litre litres percent dollar dollars euro euros cent cents usd eur gbp mph kmh"
WORD, NUMBER, NAME, UNIT = 0, 1, 2, 3
#: Readings: names as words, names within sentences as placeholders, those that open a sentence too, all values as words.
READINGS = WORDS, NAMES, OPENINGS, EXACT = 0, 1, 2, 3
_HOLDERS = mix(np.arange(1, 4, dtype=U) + U(0x51ED270B))
_CORE = np.zeros(256, bool)
_CORE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:;"]] = True


def _unit_keys() -> np.ndarray:
    data, offsets = text_bytes(pa.array([UNITS]))
    starts, ends, _ = spans(data, offsets)
    return np.sort(word_keys(data, starts, ends))


_UNIT_KEYS = _unit_keys()


class Templates:
    """Tokens of consecutive texts: bounds, types, keys, and each text's first token."""

    def __init__(self, column):
        data, offsets = text_bytes(column)
        starts, ends, first = spans(data, offsets)
        core = np.flatnonzero(_CORE[data])
        lo, hi = np.searchsorted(core, starts), np.searchsorted(core, ends)
        full = hi > lo
        after_stop = np.ones(len(starts), bool)
        if len(starts) > 1:
            lines = np.concatenate(([0], np.cumsum(data == 10)))
            after_stop[1:] = _STOP[data[ends[:-1] - 1]] | (lines[starts[1:]] > lines[ends[:-1]])
        after_stop[first[:-1][first[:-1] < len(starts)]] = True
        kept = np.flatnonzero(full)
        self.first = np.searchsorted(kept, first)
        self.begin, self.end = core[lo[kept]], core[hi[kept] - 1] + 1
        self.data = data
        low = LOWER[data]
        key = word_keys(low, self.begin, self.end)
        digits = np.concatenate(([0], np.cumsum((data >= 48) & (data <= 57))))
        number = digits[self.end] > digits[self.begin]
        lead = data[self.begin] if len(kept) else data[:0]
        second = data[np.minimum(self.begin + 1, max(len(data) - 1, 0))] if len(kept) else data[:0]
        capital = ((lead >= 65) & (lead <= 90)) | ((lead == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97))
        kind = np.where(number, NUMBER, np.where(capital & ~after_stop[kept], NAME, WORD)).astype(np.int8)
        if len(kept):
            where = np.minimum(np.searchsorted(_UNIT_KEYS, key), len(_UNIT_KEYS) - 1)
            behind = np.zeros(len(kept), bool)
            behind[1:] = number[:-1]
            behind[self.first[:-1][self.first[:-1] < len(kept)]] = False
            kind[(_UNIT_KEYS[where] == key) & behind & ~number] = UNIT
        self.key = key
        opening = capital & after_stop[kept] & (kind == WORD)
        self.kinds = (np.where(kind == NAME, WORD, kind), kind, np.where(opening, NAME, kind).astype(np.int8), np.zeros(len(kind), np.int8))
        self.rolls: dict[int, Rolling] = {}

    def windows(self, n: int, reading: int, whole: bool = False):
        """(hash, place, text, first token, tokens) of the windows that stand for n tokens at a place; whole: of texts of exactly n tokens.

        A window of too few words grows forwards, and another one backwards, until it has enough of them;
        the EXACT reading holds just these windows, ungrown, with all of their values.
        """
        kind = self.kinds[reading]
        at, doc = window_starts(self.first, n)
        if whole:
            mine = np.diff(self.first)[doc] == n
            at, doc = at[mine], doc[mine]
        word = np.flatnonzero((self.kinds[WORDS] if reading == EXACT else kind) == WORD)
        plain = np.searchsorted(word, np.arange(len(kind) + 1))
        low = plain[at + n] - plain[at] < min(_LITERALS, n)
        if reading == EXACT:
            lo, hi, kept = at[low], at[low] + n, np.flatnonzero(low)
        else:
            lo, hi, kept = at[~low], at[~low] + n, np.flatnonzero(~low)
            if n == WINDOW and low.any() and len(word):
                few = np.flatnonzero(low)
                last = plain[at[few]] + _LITERALS - 1
                end = word[np.minimum(last, len(word) - 1)] + 1
                fits = (last < len(word)) & (end <= self.first[doc[few] + 1])
                ahead, ends = few[fits], end[fits]
                lead = plain[at[few] + n] - _LITERALS
                start = word[np.maximum(lead, 0)]
                fits = (lead >= 0) & (start >= self.first[doc[few]])
                back, starts = few[fits], start[fits]
                lo, hi, kept = np.concatenate((lo, at[ahead], starts)), np.concatenate((hi, ends, at[back] + n)), np.concatenate((kept, ahead, back))
            if reading != WORDS:  # windows without a name of this reading are those of the reading before
                other = np.concatenate(([0], np.cumsum(kind != self.kinds[reading - 1])))
                new = other[hi] > other[lo]
                lo, hi, kept = lo[new], hi[new], kept[new]
        if not len(lo):
            return np.zeros(0, U), at[:0], doc[:0], at[:0], at[:0]
        if reading not in self.rolls:
            self.rolls[reading] = Rolling(np.where(kind > 0, _HOLDERS[np.maximum(kind, 1) - 1], self.key))
        size = hi - lo
        return mix(self.rolls[reading].at(lo, size) ^ size.astype(U)), at[kept], doc[kept], lo, size

    def slots(self, at: int, n: int, reading: int) -> list[str]:
        """What stands in the placeholders of a window, with their types."""
        return [f"{t}:{bytes(self.data[self.begin[i] : self.end[i]]).decode(errors='replace')}" for i in range(at, at + n) if (t := int(self.kinds[reading][i]))]


def _items(batches):
    for table in slices(batches, text="text"):
        made = Templates(table.column("text"))
        ids = table.column("item_id").to_pylist()
        rows = defaultdict(list)
        sizes = np.diff(made.first)
        for n in range(LEAST, WINDOW + 1):
            for reading in READINGS:
                keys, *of = made.windows(n, reading, whole=n < WINDOW)
                for k, t, d, lo, size in zip(keys.view(np.int64).tolist(), *(x.tolist() for x in of), strict=True):
                    if ids[d] is not None:
                        for name, value in (("hash", k), ("item_id", ids[d]), ("place", t - int(made.first[d])), ("total", max(1, int(sizes[d]) - WINDOW + 1)), ("item_slots", made.slots(lo, size, reading)), ("n", n)):
                            rows[name].append(value)
        yield pa.record_batch({"hash": pa.array(rows["hash"], pa.int64()), "item_id": pa.array(rows["item_id"], pa.int64()), "place": pa.array(rows["place"], pa.int32()), "total": pa.array(rows["total"], pa.int32()), "n": pa.array(rows["n"], pa.int32()), "item_slots": pa.array(rows["item_slots"], pa.list_(pa.string()))})


def _bits(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (keys >> U(64 - _BITS)).astype(np.int64), (keys & U(2**_BITS - 1)).astype(np.int64)


def _hits(bitmap: bytes, lengths: list[int]):
    def run(batches):
        bits = np.frombuffer(bitmap, bool) if len(bitmap) == 2**_BITS else np.unpackbits(np.frombuffer(bitmap, np.uint8)).view(bool)
        for table in slices(batches, text="_q_text"):
            made = Templates(table.column("_q_text"))
            ids = table.column("_q_id").to_numpy()
            out = defaultdict(list)
            for n in lengths:
                for reading in READINGS:
                    keys, _, doc, lo, size = made.windows(n, reading)
                    a, b = _bits(keys)
                    hit = np.flatnonzero(bits[a] & bits[b])
                    out["hash"].append(keys[hit].view(np.int64))
                    out["doc"].append(ids[doc[hit]])
                    out["slots"] += [made.slots(t, k, reading) for t, k in zip(lo[hit].tolist(), size[hit].tolist(), strict=True)]
            yield pa.record_batch({"hash": pa.array(np.concatenate(out["hash"])), "doc_id": pa.array(np.concatenate(out["doc"])), "doc_slots": pa.array(out["slots"], pa.list_(pa.string()))})

    return run


def covered(windows: list[dict]) -> tuple[int, bool]:
    """How many places of the item consistent windows cover, and whether any slot differs."""
    votes: dict[str, Counter] = defaultdict(Counter)
    for w in windows:
        for a, b in zip(w["item_slots"], w["doc_slots"], strict=True):
            votes[a][b] += 1
    chosen = {a: min(c, key=lambda b: (b != a, -c[b], b)) if a in c else min(c, key=lambda b: (-c[b], b)) for a, c in votes.items()}
    places, changed = set(), set()
    for w in windows:
        if all(chosen[a] == b for a, b in zip(w["item_slots"], w["doc_slots"], strict=True)):
            places.add(w["place"])
            if w["item_slots"] != w["doc_slots"]:
                changed.add(w["place"])
            else:
                changed.discard(w["place"])
    return len(places), bool(changed)


def _judge(cover: float):
    def run(batches):
        for batch in batches:
            keep, places, changed = [], [], []
            for i, (total, windows) in enumerate(zip(batch.column("total").to_pylist(), batch.column("windows").to_pylist(), strict=True)):
                n, other = covered(windows)
                if n >= cover * total:
                    keep.append(i)
                    places.append(n / total)
                    changed.append(other)
            kept = pa.array(keep, pa.int64())
            yield pa.record_batch({"doc_id": batch.column("doc_id").take(kept), "item_id": batch.column("item_id").take(kept), "coverage": pa.array(places, pa.float64()), "changed": pa.array(changed, pa.bool_())})

    return run


def matches(docs: DataFrame, benchmark: DataFrame, cover: float = COVER) -> DataFrame:
    """(doc_id, item_id, coverage, changed) for each item that a document holds."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").alias("text")).where("item_id is not null")
    windows = items.mapInArrow(_items, "hash bigint, item_id bigint, place int, total int, n int, item_slots array<string>")
    whole = windows.select("hash", "n").distinct()
    known = whole.groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()
    lengths = sorted({r["n"] for r in known})
    bits = np.zeros(2**_BITS, bool)
    high = F.shiftrightunsigned("hash", 64 - _BITS).alias("bit")
    low = F.col("hash").bitwiseAND(F.lit(2**_BITS - 1)).alias("bit")
    for r in whole.select(high).union(whole.select(low)).distinct().toLocalIterator():  # at most 2**22 numbers, whatever the benchmark
        bits[r["bit"]] = True
    found = docs.select(F.col("doc_id").cast("bigint").alias("_q_id"), F.col("text").alias("_q_text")).where("_q_id is not null and _q_text is not null")
    hits = found.mapInArrow(released(_hits(np.packbits(bits).tobytes(), lengths)), "hash bigint, doc_id bigint, doc_slots array<string>")
    side = windows.drop("n").distinct()
    if sum(r["c"] for r in known) <= BROADCAST_ROWS:
        side = F.broadcast(side)
    joined = hits.distinct().join(side, "hash")
    held = joined.groupBy("doc_id", "item_id", "total").agg(F.collect_list(F.struct("place", "item_slots", "doc_slots")).alias("windows"))
    held = held.where(F.size(F.array_distinct(F.transform("windows", lambda w: w["place"]))) >= F.col("total") * F.lit(cover))
    return held.mapInArrow(released(_judge(cover)), "doc_id bigint, item_id bigint, coverage double, changed boolean")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the benchmark items it holds."""
    docs = documents(spark, sf_dir)
    found = matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    per = found.groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("coverage").alias("coverage"), F.bool_or("changed").alias("reparameterised"))
    out = docs.select("doc_id").join(per, "doc_id", "left")
    return out.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("reparameterised", F.lit(False)).alias("reparameterised"))


@shielded
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold no benchmark item."""
    found = matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


QUERIES: dict[str, Callable] = {"op2_decontamination": op2_decontamination}
ORACLE: dict[str, str] = {}
