"""MinHash near-dedup with SuperMinHash signatures.

1. *Signatures.* A document's set holds its distinct shingles. For every element a
   random permutation of the ``SLOTS`` ranks is dealt step by step; in step j the
   element bids ``j + u`` for the slot its permutation has at j. As all bids of a
   step are larger than those of the steps before, a document is done as soon as
   all of its slots are taken, after very few steps if it is long (early stopping).
2. *Classes.* Documents with the same set are one class, known by its smallest
   doc_id; only that representative goes on. Copies need no pairs.
3. *Banding.* Representatives that agree in all ``ROWS`` slots of a band share a
   bucket. A bucket starts as a star: its members are held against its hub, the
   member that has most company over all of its bands (the original of a family of
   edited copies shares a bucket with nearly every copy). A bucket whose other
   members the links found so far do not connect is open. Its members are dealt to
   blocks of bounded size, and every two blocks that are not of one component meet
   in a cell. Members with a partner of another component in their cell whose
   signature is near enough send their texts there (a pair that shares several
   buckets in the first one only), and the cell compares all of them. There is no
   limit of rounds or partners, so no bucket is left before it is proven connected
   or all its pairs between components are verified.
4. *Verification.* A pair is a link if 100 * intersection >= 80 * union of the full
   sets, computed from the texts of the two documents: for a cell by one product of
   its members' incidence matrices over the shingles that occur in two of them. A
   cell returns no more links than connect its components.
5. *Grouping.* Union-find over links by alternating rounds in which every node
   takes the smallest representative it sees (large star, small star), each round
   written to the shared folder.

Defined cases: null texts and texts without words have the empty set, which is
linked with nothing; fewer words than a shingle are one shingle; rows of equal
doc_id are one document, linked if any of its rows is (each row keeps its own
n_shingles); a null doc_id is linked with nothing, kept, and has itself
(null) as its component; very long texts enter whole, their shingles in runs; of
ties between hubs the smallest doc_id wins, and the result depends on no tie; an
empty table gives no rows. Extra columns are passed through by the stage.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, forget, released, shielded, small_batches, written
from .words import LOWER, Rolling, mix, slices, spans, text_bytes, word_keys

SHINGLE = 4
SLOTS = 128
ROWS = 4
NEED, OF = 80, 100
#: Pairs that agree in fewer slots than this are not verified; at the needed similarity that has a chance under 1e-9.
AGREE = int(SLOTS * 0.8 - 6.2 * (SLOTS * 0.8 * 0.2) ** 0.5)
#: Bytes of text (and 256 for each document) in a cell's members, or on each of a cell's two sides.
CELL = 1 << 18
U = np.uint64


def shingle_sets(column, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle fingerprints of each text, one after the other, and how many each has."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, first = spans(data, offsets)
    roll = Rolling(word_keys(data, starts, ends))
    words = np.diff(first)
    counts = np.where(words >= n, words - n + 1, np.minimum(words, 1))
    doc = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + first[:-1][doc]
    keys = roll.at(at, np.minimum(words[doc], n))
    order = np.lexsort((keys, doc))
    keys, doc = keys[order], doc[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    keys, doc = keys[new], doc[new]
    return keys, np.bincount(doc, minlength=len(counts))


def super_minhash(keys: np.ndarray, counts: np.ndarray, slots: int = SLOTS, run: int = 1 << 17) -> np.ndarray:
    """SuperMinHash signatures (step in the high bits, the bid's fraction in the low 56) of consecutive sets.

    Elements come in runs of bounded size, as a set's signature is the least bid of all of its elements.
    """
    docs = len(counts)
    sig = np.full((docs, slots), np.iinfo(np.uint64).max, U)
    doc = np.repeat(np.arange(docs), counts)
    for lo in range(0, len(keys), run):
        _bid(keys[lo : lo + run], doc[lo : lo + run], sig, slots)
    return sig


def _bid(keys: np.ndarray, doc: np.ndarray, sig: np.ndarray, slots: int) -> None:
    state = np.tile(np.arange(slots, dtype=np.uint8), (len(keys), 1))
    row = np.arange(len(keys))
    low, high = int(doc[0]), int(doc[-1]) + 1
    for j in range(slots):
        seed = mix(keys[row] + U((0x9E3779B97F4A7C15 * (2 * j + 1)) % 2**64))
        k = j + ((seed >> U(40)) * U(slots - j) >> U(24)).astype(np.int64)
        slot = state[row, k]
        state[row, k] = state[row, j]
        bid = (U(j) << U(56)) | (mix(seed) >> U(8))
        np.minimum.at(sig.reshape(-1), doc[row] * slots + slot, bid)
        # done: all slots hold bids of this step or of those before
        open_ = (sig[low:high] >> U(56) > U(j)).any(axis=1)
        row = row[open_[doc[row] - low]]
        if not len(row):
            break


def _signatures(rows_per_band: int):
    def run(batches):
        for table in slices(batches, 1 << 20, "_q_text"):
            keys, counts = shingle_sets(table.column("_q_text"))
            sig = super_minhash(keys, counts)
            sums = np.zeros((len(counts), 2), U)
            doc = np.repeat(np.arange(len(counts)), counts)
            for c, salt in enumerate((U(1), U(0xD6E8FEB86659FD93))):
                np.add.at(sums[:, c], doc, mix(keys ^ salt))
            bands = np.zeros((len(counts), SLOTS // rows_per_band), U)
            for r in range(rows_per_band):
                bands = mix(bands * U(0x9E3779B97F4A7C15) + sig[:, r::rows_per_band] + U(r + 1))
            bands = mix(bands + np.arange(bands.shape[1], dtype=U))
            short = (mix(sig) & U(255)).astype(np.uint8)
            yield pa.record_batch({
                "id": table.column("_q_id").combine_chunks() if isinstance(table.column("_q_id"), pa.ChunkedArray) else table.column("_q_id"),
                "n": pa.array(counts.astype(np.int64)),
                "set1": pa.array(sums[:, 0].view(np.int64)), "set2": pa.array(sums[:, 1].view(np.int64)),
                "sig": pa.array([short[i].tobytes() for i in range(len(counts))], pa.binary()),
                "bands": pa.array(list(bands.view(np.int64)), pa.list_(pa.int64())),
                "packed": pa.array([bands[i].tobytes() for i in range(len(counts))], pa.binary()),
            })

    return run


def signatures(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n (set size), set1 and set2 (a 128-bit fingerprint of the set), sig (8 bits a slot), bands and packed (the bands as bytes)."""
    slim = docs.select(F.col(id_column).cast("bigint").alias("_q_id"), F.col(text).alias("_q_text"))
    return slim.mapInArrow(released(_signatures(ROWS)), "id bigint, n bigint, set1 bigint, set2 bigint, sig binary, bands array<bigint>, packed binary")


def _together(batches, size: int = 1 << 20):
    """Whole cells of rows that come sorted by ``cell``, regrouped into tables of about ``size`` bytes of text."""
    held, room = [], 0
    for batch in batches:
        cell = batch.column("cell").to_numpy()
        edges = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
        weight = np.cumsum(np.append(0, batch.column("weight").to_numpy()))
        last = held[-1].column("cell")[held[-1].num_rows - 1].as_py() if held else None
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if room >= size and held and int(cell[lo]) != last:
                yield pa.Table.from_batches(held)
                held, room = [], 0
            if hi > lo:
                held.append(batch.slice(lo, hi - lo))
                room += int(weight[hi] - weight[lo])
                last = int(cell[lo])
    if held:
        yield pa.Table.from_batches(held)


def _stars(batches):
    """Links of each cell's members (side 1) to its hub (side 0)."""
    for rows in _together(batches):
        cell, side, ids = (rows.column(c).to_numpy() for c in ("cell", "side", "id"))
        keys, n = shingle_sets(rows.column("text"))
        new = np.concatenate(([True], cell[1:] != cell[:-1]))
        group = np.cumsum(new) - 1
        # equal keys of one cell are neighbours after sorting by cell and key, the hub's first
        row = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((side[row], keys, group[row]))
        keys, row = keys[order], row[order]
        same = np.concatenate(([False], (keys[1:] == keys[:-1]) & (group[row][1:] == group[row][:-1])))
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(keys))))
        both = np.bincount(row[(side[row] == 1) & (side[row[head]] == 0)], minlength=len(n)) if len(keys) else np.zeros(len(n), np.int64)
        hub = np.full(group[-1] + 1, -1)
        hub[group[side == 0]] = np.flatnonzero(side == 0)
        of = hub[group]
        twice = np.bincount(group, side == 0) > 1  # a hub whose doc_id has several texts
        good = (side == 1) & (of >= 0) & (both > 0) & (OF * both >= NEED * (n + n[of] - both)) & ~twice[group]
        yield pa.record_batch({"a": pa.array(ids[good], pa.int64()), "b": pa.array(ids[of[good]], pa.int64())})
        for g in np.flatnonzero(twice).tolist():
            yield _similar(rows.filter(pa.array(group == g)), ids[group == g])


def _near(batches):
    """Of each cell, the rows that have a partner in another component whose signature is near enough."""
    for rows in _together(batches, 1 << 21):
        cell = rows.column("cell").to_numpy()
        edges = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
        side, band, label, n = (rows.column(c).to_numpy() for c in ("side", "band", "label", "n"))
        sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint8).reshape(-1, SLOTS)
        bands = np.frombuffer(b"".join(rows.column("bands").to_pylist()), np.int64).reshape(-1, SLOTS // ROWS)
        keep = np.zeros(len(cell), bool)
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            left = lo + np.flatnonzero(side[lo:hi] == 0)
            right = lo + np.flatnonzero(side[lo:hi] == 1)
            right = right if len(right) else left
            for at in range(0, len(left), 64):
                x = left[at : at + 64]
                fits = (label[x][:, None] != label[right][None]) & (OF * np.minimum(n[x][:, None], n[right][None]) >= NEED * np.maximum(n[x][:, None], n[right][None]))
                i, j = np.nonzero(fits)
                for k in range(0, len(i), 1 << 16):
                    p, q = x[i[k : k + (1 << 16)]], right[j[k : k + (1 << 16)]]
                    close = np.count_nonzero(sig[p] == sig[q], axis=1) >= AGREE
                    p, q = p[close], q[close]
                    # a pair that shares several buckets is looked at in the first of them
                    mine = np.argmax(bands[p] == bands[q], axis=1) == band[p]
                    keep[p[mine]] = keep[q[mine]] = True
        yield rows.select(["cell", "side", "id", "label"]).filter(pa.array(keep)).combine_chunks().to_batches()[0] if keep.any() else pa.RecordBatch.from_pydict({c: pa.array([], t) for c, t in (("cell", pa.int64()), ("side", pa.int32()), ("id", pa.int64()), ("label", pa.int64()))})


def _meet(keys: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets of the rows ``left`` with those of the rows ``right``."""
    out = np.zeros((len(left), len(right)), np.float32)
    row = np.repeat(np.arange(len(n)), n)
    _, at, count = np.unique(keys, return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1  # keys of one row alone meet nothing
    use = count[at] > 1
    at, row = column[at[use]], row[use]
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    width = int((count > 1).sum())
    side_of = np.full((2, len(n)), -1)
    side_of[0, left], side_of[1, right] = np.arange(len(left)), np.arange(len(right))
    step = 2048
    cuts = np.searchsorted(at, np.arange(0, width + step, step))
    for lo, hi, base in zip(cuts[:-1], cuts[1:], range(0, width, step), strict=False):
        block = []
        for of, size in zip(side_of, (len(left), len(right)), strict=True):
            dense = np.zeros((size, step), np.float32)
            r, c = of[row[lo:hi]], at[lo:hi] - base
            dense[r[r >= 0], c[r >= 0]] = 1
            block.append(dense)
        out += block[0] @ block[1].T
    return out.astype(np.int64)


def _similar(rows: pa.Table, label: np.ndarray) -> pa.RecordBatch:
    """Links that connect what is similar between components of one cell: no more of them than components."""
    side, ids = rows.column("side").to_numpy(), rows.column("id").to_numpy()
    keys, n = shingle_sets(rows.column("text"))
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if (side == 1).any() else left
    both = _meet(keys, n, left, right)
    good = (both > 0) & (OF * both >= NEED * (n[left][:, None] + n[right][None] - both)) & (label[left][:, None] != label[right][None])
    i, j = np.nonzero(good)
    names, of = np.unique(label, return_inverse=True)
    x, y = of[left[i]], of[right[j]]
    _, first = np.unique(np.minimum(x, y) * len(names) + np.maximum(x, y), return_index=True)
    parent = list(range(len(names)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    a, b = [], []
    for k in first.tolist():
        p, q = root(int(x[k])), root(int(y[k]))
        if p != q:
            parent[p] = q
            a.append(int(ids[left[i[k]]]))
            b.append(int(ids[right[j[k]]]))
    return pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _cross(batches):
    for rows in _together(batches, 1):
        yield _similar(rows, rows.column("label").to_numpy())


def _agree(batches):
    """Whether a member's signature is near its hub's."""
    for batch in batches:
        sig, hub = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SLOTS) for c in ("sig", "hub_sig"))
        n, m = batch.column("n").to_numpy(), batch.column("hub_n").to_numpy()
        near = (np.count_nonzero(sig == hub, axis=1) >= AGREE) & (OF * np.minimum(n, m) >= NEED * np.maximum(n, m))
        yield pa.record_batch({**{c: batch.column(c) for c in ("bucket", "band", "id", "set1", "hub")}, "near": pa.array(near)})


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("cell").sortWithinPartitions("cell", "side")


def _star_cells(pairs: DataFrame, text: DataFrame) -> DataFrame:
    """Links among pairs (id, hub): a hub's members are dealt to cells of bounded size, each of which gets the hub's text once."""
    pairs = pairs.join(text, "id")
    size = pairs.groupBy("hub").agg(F.sum("weight").alias("of_hub"))
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("of_hub") / CELL))
    placed = pairs.join(size, "hub").withColumn("cell", F.xxhash64("hub", part))
    hubs = placed.select("hub", "cell").distinct().join(text.withColumnRenamed("id", "hub"), "hub")
    rows = placed.select("cell", F.lit(1).alias("side"), "id", "weight", "text").unionByName(hubs.select("cell", F.lit(0).alias("side"), F.col("hub").alias("id"), "weight", "text"))
    return _dealt(rows).mapInArrow(released(_stars), "a bigint, b bigint")


def _open_cells(open_: DataFrame, side: DataFrame, text: DataFrame) -> DataFrame:
    """Links between members (bucket, band, id, set1, label) of one bucket that are in different components so far.

    A bucket's members are dealt to blocks of bounded size, a component's own where
    it fills some, and all pairs of blocks that are not of one component are cells.
    """
    member = open_.join(side.select("id", "set1", "n"), ["id", "set1"]).join(text.select("id", "weight"), "id")
    sizes = member.groupBy("bucket", "label").agg(F.sum("weight").alias("size"))
    small = F.col("size") < CELL
    total = sizes.groupBy("bucket").agg(F.coalesce(F.sum(F.when(small, F.col("size"))), F.lit(1)).alias("rest"))
    sizes = sizes.join(total, "bucket")
    own = F.struct(F.col("label").alias("of"), F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / CELL)).alias("part"))
    shared = F.struct(F.lit(None).cast("bigint").alias("of"), F.pmod(F.xxhash64("label"), F.ceil(F.col("rest") / CELL)).alias("part"))
    placed = written(member.join(sizes, ["bucket", "label"]).select("bucket", "band", "id", "set1", "label", "n", F.xxhash64(F.when(small, shared).otherwise(own)).alias("block")), "blocks")
    blocks = placed.groupBy("bucket", "block").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("n").alias("least"), F.max("n").alias("most"))
    i, j = (blocks.select("bucket", *[F.col(c).alias(f"{c}_{x}") for c in ("block", "low", "high", "least", "most")]) for x in "ij")
    fits = f"block_i <= block_j and least(low_i, low_j) <> greatest(high_i, high_j) and {OF} * most_i >= {NEED} * least_j and {OF} * most_j >= {NEED} * least_i"
    cells = i.join(j, "bucket").where(fits)
    end = lambda x, k: F.struct(F.col(f"block_{x}").alias("block"), F.lit(k).alias("side"))
    ends = F.when(F.col("block_i") == F.col("block_j"), F.array(end("i", 0))).otherwise(F.array(end("i", 0), end("j", 1)))
    cells = cells.select("bucket", F.xxhash64("bucket", "block_i", "block_j").alias("cell"), F.explode(ends).alias("e")).select("bucket", "cell", "e.block", "e.side")
    rows = cells.join(placed, ["bucket", "block"]).join(side.select("id", "set1", "sig", "packed"), ["id", "set1"]).select("cell", "side", "id", "label", "n", "band", "sig", F.col("packed").alias("bands"), F.lit(512).alias("weight"))
    near = written(_dealt(rows).mapInArrow(released(_near), "cell bigint, side int, id bigint, label bigint"), "near")
    rows = near.distinct().join(text, "id").select("cell", "side", "id", "label", "weight", "text")
    out = written(_dealt(rows).mapInArrow(released(_cross), "a bigint, b bigint").distinct(), "crossed")
    forget(placed)
    forget(near)
    return out


def links(docs: DataFrame, reps: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Confirmed links (a, b) that connect whatever is connected among the representatives; and tables to forget after use.

    reps: id, set1, n, sig, bands, packed; docs: _q_id, _q_text.
    """
    member = reps.select("id", "set1", F.posexplode("bands").alias("band", "value")).select("id", "set1", "band", F.xxhash64("band", "value").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("company")).where("company > 1")
    member = written(member.join(shared.hint("merge"), "bucket"), "buckets")  # only buckets with company
    company = member.groupBy("id", "set1").agg(F.sum("company").alias("company"))
    side = written(reps.select("id", "set1", "n", "sig", "packed").join(company, ["id", "set1"]), "sides")
    text = docs.select(F.col("_q_id").alias("id"), (F.octet_length("_q_text") + 256).cast("bigint").alias("weight"), F.col("_q_text").alias("text"))
    text = written(text.join(side.select("id").distinct().hint("merge"), "id", "left_semi"), "texts")
    held = member.select("bucket", "band", "id", "set1").join(side.select("id", "set1", "company", "n", "sig"), ["id", "set1"])
    hub = F.max(F.struct("company", (-F.col("id")).alias("low"), "set1", F.col("n").alias("hub_n"), F.col("sig").alias("hub_sig"))).alias("h")
    hubs = held.groupBy("bucket").agg(hub).select("bucket", (-F.col("h.low")).alias("hub"), F.col("h.set1").alias("hub_set"), "h.hub_n", "h.hub_sig")
    against = held.join(hubs, "bucket").where("id <> hub or set1 <> hub_set").select("bucket", "band", "id", "set1", "hub", "n", "hub_n", "sig", "hub_sig")
    against = written(against.mapInArrow(_agree, "bucket bigint, band int, id bigint, set1 bigint, hub bigint, near boolean"), "stars")
    good = written(_star_cells(against.where("near and id <> hub").select("id", "hub").distinct(), text).distinct(), "pairs")
    # the hub is done; a bucket whose other members are all known to be connected is done, too
    label = components(good)
    open_ = against.join(label, "id", "left").select("bucket", "band", "id", "set1", F.coalesce("component", "id").alias("label"))
    apart = open_.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket")
    more = _open_cells(open_.join(apart, "bucket", "left_semi"), side, text)
    for t in (member, side, text, against, good):
        forget(t)
    return label.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more), [label, more]


def _forest(batches):
    """The edges of a task as a forest of stars: every node with the smallest node that the task's edges connect it to."""
    for table in slices_of_rows(batches):
        u, v = table.column("u").to_numpy(), table.column("v").to_numpy()
        names, at = np.unique(np.concatenate((u, v)), return_inverse=True)
        a, b = at[: len(u)], at[len(u) :]
        low = np.arange(len(names))
        while True:  # smallest label of the neighbours, then jumps to the label's label
            best = low.copy()
            np.minimum.at(best, a, low[b])
            np.minimum.at(best, b, low[a])
            np.minimum.at(best, low, best.copy())
            best = best[best]
            if (best == low).all():
                break
            low = best
        out = np.flatnonzero(low != np.arange(len(names)))
        yield pa.record_batch({"u": pa.array(names[out]), "v": pa.array(names[low[out]])})


def slices_of_rows(batches, rows: int = 1 << 20):
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each node of the edges (a, b) reaches; a written table.

    Each task first turns its edges into a forest. Then large star and small star in
    turn until nothing changes: few rounds, and no node's neighbours are ever gathered,
    as only the smallest of them is needed.
    """

    def kept(df: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        checks = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("x"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("y")]
        out = written(df.observe(seen, *checks), "edges")
        return out, tuple(sorted(seen.get.items()))

    forest = lambda df: df.select("u", "v").mapInArrow(_forest, "u bigint, v bigint")
    edges, seen = kept(forest(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").repartition("v")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after, now = kept(small)
        forget(edges)
        edges = after
        if now == seen:
            out = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
            out._quillon_path = edges._quillon_path
            return out
        seen = now


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """_q_id, n_shingles and component_id for every row of docs."""
    small_batches(docs.sparkSession)
    base = written(signatures(docs, id_column, text), "signatures")
    sets = base.where("n > 0 and id is not null")
    of = F.min_by(F.struct("sig", "bands", "packed"), "id").alias("of")
    classes = written(sets.groupBy("set1", "set2", "n").agg(F.min("id").alias("rep"), of), "classes")
    member = written(sets.select("id", "set1", "set2", "n").join(classes.select("set1", "set2", "n", "rep").hint("merge"), ["set1", "set2", "n"]).select("id", "rep").distinct(), "members")
    # rows of one doc_id may have different sets: they link their classes
    twice = member.groupBy("id").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1").select("id")
    reps = classes.select(F.col("rep").alias("id"), "set1", "n", "of.sig", "of.bands", "of.packed")
    slim = docs.select(F.col(id_column).cast("bigint").alias("_q_id"), F.col(text).alias("_q_text")).where("_q_id is not null and _q_text is not null")
    found, trash = links(slim, reps)
    group = components(found.unionByName(member.join(twice, "id").select(F.col("id").alias("a"), F.col("rep").alias("b"))))
    label = member.join(group.select(F.col("id").alias("rep"), "component"), "rep", "left").groupBy("id").agg(F.min(F.coalesce("component", "rep")).alias("component"))
    out = base.select(F.col("id").alias("_q_id"), F.col("n").alias("n_shingles")).join(label.withColumnRenamed("id", "_q_id").hint("merge"), "_q_id", "left")
    out = written(out.select("_q_id", "n_shingles", F.coalesce("component", "_q_id").alias("component_id")), "groups")
    for t in (base, classes, member, group, *trash):
        forget(t)
    return out


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir))
    return out.select(F.col("_q_id").alias("doc_id"), "n_shingles", "component_id", (F.col("_q_id") == F.col("component_id")).alias("kept"))


@shielded
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the document of the smallest doc_id of each group stays."""
    out = near_duplicates(docs).where("component_id <> _q_id").select(F.col("_q_id").alias("doc_id")).distinct()
    return docs.join(out, "doc_id", "left_anti").select(*docs.columns)


QUERIES: dict[str, Callable] = {"op6_near_dedup": op6_near_dedup}
ORACLE: dict[str, str] = {}
