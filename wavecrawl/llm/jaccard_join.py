"""N-gram Jaccard join: count-vector R-trees inside lossless blocks, exact verification.

A document's set holds its distinct 5-word shingles (words: runs without blanks, A-Z in lower
case; with fewer words the whole sequence is one shingle; without words the set is empty and
links with nothing). Two sets link when 100 * intersection >= 75 * union.

1. Equal sets form a class, held by its smallest doc_id: copies are never paired.
2. Shingles are ordered by how many there are in their slot of a table of ``SLOTS`` counts over
   all documents, then by hash. Sets that link share one of their first ``n - ceil(0.75 n) + 1``
   shingles in any order; in this one, passages that many documents share come last and make no
   block. A class is in the block of the smallest class that has such a shingle of its own, so
   two that link meet in the block of the smallest holder of their shared shingle. First shingles
   travel once, packed by bucket (the hash modulo the number of buckets, and 40 bits of the rest;
   two that agree in these by chance only make a block larger). A class that shares such a
   shingle only with sets that are too small or too large to link is not put into its block.
   First shingles of slots that hold more
   than ``HOT`` texts and a ``HOT_SHARE``-th of all shingles may be in any share of the classes:
   they are aggregated as rows instead. A block whose classes are all in one smaller block goes.
3. Blocks of up to ``TILE`` classes and ``BUDGET`` shingles are dealt to groups of about
   ``BUDGET``. Larger ones are cut by set size, in steps of ``STEP``, and by hash into packed
   tiles of that bound; only tiles of the same or the next step meet, as sizes of sets that link
   differ by a third at most. So no task holds a whole large block.
4. In a group or pair of tiles, an R-tree over count vectors (shingles hashed into ``GROUPS``
   groups, counts capped into bytes from above) finds the pairs: the overlap with a point or a
   box is at most the sum of coordinate minima, and a pair can only link if this reaches 3/7 of
   the summed sizes. First only vectors travel, finer ones of one group for at most ``FINE``
   shingles on average (the tree's are folded from them), and classes that are in no pair of a
   block by the finer bound leave it. Whole sets travel for the classes that stay; the tree finds
   their pairs again, in tiles cut anew, and each is verified on whole sets.
5. A pair of several blocks counts in the smallest alone. Of each tile come its classes with
   their number of links and the smallest class they are connected to, never the links as rows.

The join's output is each row's class, component (from smallest-label spreading) and number of
links. ``Links.pairs`` gives every link between two classes as rows to those who read it: in a
group of near copies their number grows with its square.

Null and empty texts get n_shingles 0 and their own id. Rows that repeat a doc_id are one
document each, with the same id; if their texts differ, the id has the links of all of them. Rows
with a null doc_id come back with a null component and link nothing. Extra columns are ignored.
Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, small_or_plain, staged, table, without_ids

GROUPS = 64
TILE = 1000  # classes in a tile, on average
BUDGET = 1 << 18  # shingles in a tile, on average
FINE = 4  # shingles in a group of the finer vectors, at most, on average
STEP = 1.4  # sizes of a tile differ by less; above 4/3, so that sets that link are a step apart at most
SLOTS = 1 << 20  # counts that order the shingles: one byte each when they are sent
SLICE = 1 << 14  # slots that are summed together
LEAF = 32  # points in a leaf of the R-tree
KEYS = 1 << 21  # first shingles in a bucket, on average
HOT, HOT_SHARE = 1 << 16, 1 << 12  # counts of a slot above which its shingles don't go into buckets
KEY_BYTES = 5  # of a shingle inside its bucket
HEAVY_SHARE = 1000  # keys with more than 1 / HEAVY_SHARE of all rows: at most so many, broadcast
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes (as int64) of the text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z, and \x20 \x09-\x0D
    if not words:
        return np.zeros(0, np.int64)
    if len(words) < 5:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 1)], np.uint64).view(np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - 4
    out = np.zeros(n, np.uint64)
    for j in range(5):
        x = (h[j : j + n] ^ (out >> np.uint64(29))) * _ODD[j]
        out = out * _ODD[4 - j] + (x ^ (x >> np.uint64(32)))
    return np.unique((out ^ (out >> np.uint64(31))).view(np.int64))


def prefix_size(n: int) -> int:
    return n - -(-3 * n // 4) + 1 if n else 0


def count_vector(hashes: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """Shingles in each group (a power of two of them, by the hash's first bits); 255 stands for 255 or more."""
    shift = np.uint64(65 - groups.bit_length())
    return np.minimum(np.bincount((hashes.view(np.uint64) >> shift).astype(np.int64), minlength=groups), 255).astype(np.uint8)


def fine_groups(n: int) -> int:
    """Groups of the finer vector of a set of ``n``: the least power of two of ``n / FINE`` or more."""
    return max(GROUPS, 1 << max(0, -(-n // FINE) - 1).bit_length())


def folded(fine: bytes) -> np.ndarray:
    """The vector of ``GROUPS`` groups, of a finer one."""
    return np.minimum(np.frombuffer(fine, np.uint8).reshape(GROUPS, -1).sum(axis=1, dtype=np.int64), 255).astype(np.uint8)


def fine_bound(a: bytes, b: bytes) -> int:
    """Largest overlap of two sets by their finer vectors; the longer one is folded to the other's groups."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    capped = max(x.max(), y.max()) == 255
    groups = min(len(x), len(y))
    x, y = (v.reshape(groups, -1).sum(axis=1, dtype=np.int64) for v in (x, y))
    return np.iinfo(np.int32).max if capped else int(np.minimum(x, y).sum())


def _bound(points: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Largest overlap by coordinate minima, points x others; a capped count bounds nothing (its group may hold all)."""
    low = np.minimum(points[:, None, :], other[None, :, :]).astype(np.int32)
    out = low.sum(axis=2)
    full = (low == 255).any(axis=2)
    return np.where(full, np.iinfo(np.int32).max, out)


def rtree_pairs(va, na, vb, nb) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (a, b) that the bounds let through; b is packed into leaves and boxes over leaves."""
    order = np.lexsort((vb[:, 1], vb[:, 0], nb)) if len(nb) else np.zeros(0, int)
    leaves = [order[i : i + LEAF] for i in range(0, len(order), LEAF)]
    if not leaves or not len(na):
        return
    box = np.stack([vb[x].max(axis=0) for x in leaves])
    least, most = (np.array([f(nb[x]) for x in leaves]) for f in (np.min, np.max))
    for k in range(0, len(leaves), LEAF):  # boxes over leaves
        part = slice(k, k + LEAF)
        top = box[part].max(axis=0, keepdims=True)
        live = np.flatnonzero((_bound(va, top)[:, 0] * 7 >= 3 * (na + least[part].min())) & (4 * na >= 3 * least[part].min()) & (4 * most[part].max() >= 3 * na))
        for j in range(k, min(k + LEAF, len(leaves))):
            if not len(live):
                break
            near = live[(_bound(va[live], box[j : j + 1])[:, 0].astype(np.int64) * 7 >= 3 * (na[live] + least[j])) & (4 * na[live] >= 3 * least[j]) & (4 * most[j] >= 3 * na[live])]
            if not len(near):
                continue
            inside = leaves[j]
            ok = _bound(va[near], vb[inside]).astype(np.int64) * 7 >= 3 * (na[near][:, None] + nb[inside][None, :])
            x, y = np.nonzero(ok)
            yield near[x], inside[y]


def _describe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each text, and at the end the task's slot counts, in slices of the narrowest integers that hold them."""
    columns = ["doc_id", "n", "digest", "slice", "counts"]
    total = np.zeros(SLOTS, np.int64)
    for frame in frames:
        rows = []
        for i, t in zip(frame["doc_id"], frame["text"]):
            s = shingle_set(t)
            np.add.at(total, slots_of(s), 1)
            rows.append((i, len(s), xxhash.xxh3_128_digest(s.tobytes()), None, None))
        yield pd.DataFrame(rows, columns=columns)
    if total.any():
        rows = [(None, None, None, k, _narrow(total[k * SLICE : (k + 1) * SLICE])) for k in range(SLOTS // SLICE)]
        yield pd.DataFrame(rows, columns=columns)


def _sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = [(i, s.tobytes()) for i, s in zip(frame["doc_id"], map(shingle_set, frame["text"])) if len(s)]
        yield pd.DataFrame(rows, columns=["id", "held"])


def slots_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes.view(np.uint64) % np.uint64(SLOTS)).astype(np.int64)


def _narrow(counts: np.ndarray) -> bytes:
    return counts.astype(np.min_scalar_type(int(counts.max()))).tobytes()


def _summed(frame: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(SLICE, np.int64)
    for x in frame["counts"]:
        total += np.frombuffer(x, f"u{len(x) // SLICE}").astype(np.int64)
    return pd.DataFrame({"slice": [frame["slice"].iloc[0]], "counts": [_narrow(total)]})


def slot_ranks(slices: DataFrame) -> np.ndarray:
    """A byte for each slot that grows with the shingles of all sets in it: the counts' logarithms.

    Tasks' slices (slice, counts) are summed in two steps, so that no group holds those of all
    tasks. The driver gets ``SLOTS`` counts whatever the input.
    """
    schema = "slice int, counts binary"
    some = slices.groupBy("slice", (F.xxhash64("counts") % 64).alias("part")).applyInPandas(_summed, schema)
    rows = some.groupBy("slice").applyInPandas(_summed, schema).collect()
    counts = np.zeros(SLOTS, np.int64)
    for k, x in rows:
        counts[k * SLICE : (k + 1) * SLICE] = np.frombuffer(x, f"u{len(x) // SLICE}")
    return np.minimum(4 * np.log2(1 + counts), 255).astype(np.uint8)


def _outlines(ranks: np.ndarray):
    """Batches of texts -> the size of each set and its first shingles, rare slots first."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for i, t in zip(frame["doc_id"], frame["text"]):
                s = shingle_set(t)
                first = np.argsort(ranks[slots_of(s)], kind="stable")  # sets are sorted by hash
                rows.append((i, len(s), s[first[: prefix_size(len(s))]]))
            yield pd.DataFrame(rows, columns=["id", "n", "prefix"])

    return run


def _fine(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        sets = [(i, shingle_set(t)) for i, t in zip(frame["doc_id"], frame["text"])]
        yield pd.DataFrame([(i, count_vector(s, fine_groups(len(s))).tobytes()) for i, s in sets if len(s)], columns=["id", "held"])


PACKED = "bucket int, ids array<long>, sizes array<long>, counts array<int>, keys binary, id long, n long, often array<long>"


def packed(ids: list, sizes: list, prefixes: list, buckets: int) -> pd.DataFrame:
    """One row per bucket: its texts' ids, set sizes and numbers of shingles there, and these shingles in the texts' order."""
    keys = np.concatenate([*prefixes, np.zeros(0, np.int64)]).view(np.uint64)
    owner = np.repeat(np.arange(len(ids)), [len(x) for x in prefixes])
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    rest = (keys // np.uint64(buckets))[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
    owner, bucket = owner[order], bucket[order]
    ids, sizes = np.array(ids, np.int64), np.array(sizes, np.int64)
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    rows = []
    for s, e in zip(cuts, [*cuts[1:], len(bucket)]):
        there, counts = np.unique(owner[s:e], return_counts=True)
        rows.append((int(bucket[s]), ids[there], sizes[there], counts.astype(np.int32), rest[s:e].tobytes(), None, None, None))
    return pd.DataFrame(rows, columns=["bucket", "ids", "sizes", "counts", "keys", "id", "n", "often"])


def _dealt_keys(ranks: np.ndarray, buckets: int, hot: int):
    """Batches of texts -> their first shingles, packed by bucket; those of slots of rank ``hot`` or more as arrays."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, sizes, held, total = [], [], [], 0
        for frame in _outlines(ranks)(frames):
            rows = []
            for i, n, prefix in zip(frame["id"], frame["n"], frame["prefix"]):
                often = ranks[slots_of(prefix)] >= hot
                if often.any():
                    rows.append((None, None, None, None, None, i, n, prefix[often]))
                ids.append(i)
                sizes.append(n)
                held.append(prefix[~often])
                total += len(held[-1])
            if rows:
                yield pd.DataFrame(rows, columns=["bucket", "ids", "sizes", "counts", "keys", "id", "n", "often"])
            if total >= KEYS:
                yield packed(ids, sizes, held, buckets)
                ids, sizes, held, total = [], [], [], 0
        if total:
            yield packed(ids, sizes, held, buckets)

    return run


def shared_keys(frame: pd.DataFrame) -> pd.DataFrame:
    """Rows of a bucket -> ``lo, id, n``: for each shingle there, the smallest id that has it and the texts
    that have it together with another one of a size that allows a link."""
    ids, sizes, counts = (np.concatenate(frame[c].tolist()) for c in ("ids", "sizes", "counts"))
    owner = np.repeat(np.arange(len(ids), dtype=np.int32), counts)
    keys = np.zeros((len(owner), 8), np.uint8)
    keys[:, :KEY_BYTES] = np.frombuffer(b"".join(frame["keys"]), np.uint8).reshape(-1, KEY_BYTES)
    keys = keys.view("<u8").ravel()
    order = np.lexsort((sizes[owner], keys))
    keys, owner = keys[order], owner[order]
    same = keys[1:] == keys[:-1]
    n = sizes[owner]
    close = same & (4 * n[:-1] >= 3 * n[1:])  # neighbours by size: if any two sizes are close enough, these are
    kept = np.r_[False, close] | np.r_[close, False]
    first = np.flatnonzero(np.r_[True, ~same])
    lo, hi = (f.reduceat(ids[owner], first) for f in (np.minimum, np.maximum))
    run = np.diff(np.r_[first, len(keys)])
    kept &= np.repeat(lo < hi, run)
    out = {"lo": np.repeat(lo, run)[kept], "id": ids[owner[kept]], "n": n[kept]}
    return pd.DataFrame(out).drop_duplicates(ignore_index=True)


def needed_blocks(blocks: DataFrame) -> DataFrame:
    """``blocks`` (lo, id, n) without those whose classes are all in one smaller block, where each of their pairs meets.

    The one tried is the smallest block of the class that the block is named after.
    """
    over = blocks.groupBy("id").agg(F.min("lo").alias("over")).where("over < id").select(F.col("id").alias("lo"), "over")
    over = small_or_plain(staged(over, "join-over"), 32)
    there = blocks.select(F.col("lo").alias("over"), "id").distinct()
    missing = blocks.join(over, "lo").select("lo", "over", "id").join(there, ["over", "id"], "left_anti").select("lo").distinct()
    gone = staged(over.select("lo").join(missing, "lo", "left_anti"), "join-gone")
    return blocks.join(small_or_plain(gone, 16), "lo", "left_anti")


def attach_least(rows: DataFrame, key: str, value: str, out: str, kind: str) -> DataFrame:
    """``rows`` with ``out``: the smallest ``value`` of their ``key``; keys of many rows are joined by broadcast."""
    least = staged(rows.groupBy(key).agg(F.min(value).alias(out), F.count("*").alias("__n")).where("__n > 1"), kind)
    total = rows.count()
    heavy = least.where(F.col("__n") * HEAVY_SHARE > total).drop("__n")  # fewer than HEAVY_SHARE rows
    light = least.where(F.col("__n") * HEAVY_SHARE <= total).select(key, F.col(out).alias("__light"))
    marked = rows.join(F.broadcast(heavy), key, "left")
    hot = marked.where(F.col(out).isNotNull())
    rest = marked.where(F.col(out).isNull()).drop(out).join(light, key, "left")
    return hot.unionByName(rest.withColumn(out, F.coalesce("__light", value)).drop("__light"))


def components(edges: DataFrame, kind: str) -> DataFrame:
    """``id, label``: the smallest id reachable over ``edges`` (a, b), for every id that has an edge."""
    edges = staged(edges.union(edges.select("b", "a")).distinct().toDF("id", "other"), kind)
    labels = staged(edges.groupBy("id").agg(F.least(F.min("other"), F.col("id")).alias("label")), kind)
    while True:
        near = edges.join(labels.select(F.col("id").alias("other"), F.col("label")), "other").select("id", "label")
        best = staged(near.union(labels).groupBy("id").agg(F.min("label").alias("label")), kind)
        jump = best.select(F.col("id").alias("label"), F.col("label").alias("far"))  # the label's own label
        fresh = staged(best.join(jump, "label", "left").select("id", F.least("label", F.coalesce("far", "label")).alias("label")), kind)
        if fresh.join(labels, ["id", "label"], "left_anti").isEmpty():
            return fresh
        labels = fresh


class _Outline:
    """Classes of one block by their finer vectors."""

    def __init__(self, ids, sizes, held, blocks):
        self.ids, self.sizes = np.array(ids, np.int64), np.array(sizes, np.int64)
        self.fine = list(held)
        self.vectors = np.stack([folded(v) for v in self.fine])


def tile_live(lo: int, a: _Outline, b: _Outline | None = None) -> pd.DataFrame:
    """The classes of ``a`` and ``b``, or ``a`` alone, that the bounds let link with another."""
    c = b or a
    live = [np.zeros(len(t.ids), bool) for t in ((a, b) if b else (a,))]
    for x, y in rtree_pairs(a.vectors, a.sizes, c.vectors, c.sizes):
        for p, q in zip(x, y):
            if a.ids[p] != c.ids[q] and not (live[0][p] and live[-1][q]) and 7 * fine_bound(a.fine[p], c.fine[q]) >= 3 * (a.sizes[p] + c.sizes[q]):
                live[0][p] = live[-1][q] = True
    ids = np.concatenate([t.ids[m] for t, m in zip((a, c), live)])
    return pd.DataFrame({"lo": lo, "id": ids})


class _Tile:
    """Classes of one block: ids, sets, and the blocks that each is in."""

    def __init__(self, ids, sizes, held, blocks):
        one = {(i, bytes(s)): b for i, s, b in zip(ids, held, blocks)}  # a repeated row counts once
        self.ids = np.array([i for i, _ in one], np.int64)
        self.sets = [np.frombuffer(s, np.int64) for _, s in one]
        self.blocks = list(one.values())
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        self.vectors = np.stack([count_vector(s) for s in self.sets])


def tile_links(lo: int, a: _Tile, b: _Tile | None = None) -> np.ndarray:
    """Rows (smaller id, larger id) of the links between ``a`` and ``b``, or within ``a``, that count in block ``lo``."""
    c = b or a
    found = list(rtree_pairs(a.vectors, a.sizes, c.vectors, c.sizes))
    x, y = (np.concatenate(z) for z in zip(*found)) if found else (np.zeros(0, int),) * 2
    keep = a.ids[x] != c.ids[y] if b else a.ids[x] < c.ids[y]
    x, y = x[keep], y[keep]
    if not len(x):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    flat = np.concatenate(c.sets)
    known, codes = np.unique(flat, return_inverse=True)
    starts = np.cumsum(c.sizes) - c.sizes
    mark = np.zeros(len(known) + 1, bool)  # the last one is for shingles that ``c`` lacks
    ok = np.zeros(len(x), bool)
    cuts = np.flatnonzero(np.diff(x, prepend=-1))
    for s, e in zip(cuts, [*cuts[1:], len(x)]):
        one = a.sets[x[s]]
        at = np.searchsorted(known, one)
        at[known[np.minimum(at, len(known) - 1)] != one] = len(known)
        mark[at] = True
        common = np.add.reduceat(mark[codes], starts, dtype=np.int64)[y[s:e]]
        ok[s:e] = 7 * common >= 3 * (len(one) + c.sizes[y[s:e]])
        mark[at] = False
    x, y = x[ok], y[ok]
    low_a, low_c = ([{k for k in t.blocks[i] if k < lo} for i in range(len(t.ids))] for t in (a, c))
    first = np.fromiter((low_a[p].isdisjoint(low_c[q]) for p, q in zip(x, y)), bool, len(x))
    ends = np.stack([a.ids[x[first]], c.ids[y[first]]], axis=1)
    return np.unique(np.sort(ends, axis=1), axis=0)


def tile_pairs(lo: int, a: _Tile, b: _Tile | None = None) -> pd.DataFrame:
    return pd.DataFrame(tile_links(lo, a, b), columns=["a", "b"])


def tile_members(lo: int, a: _Tile, b: _Tile | None = None) -> pd.DataFrame:
    """Each class of the tile's links, with their number and the smallest class connected to it here."""
    ids, at = np.unique(tile_links(lo, a, b), return_inverse=True)
    at = at.reshape(-1, 2)
    n = np.bincount(at.ravel(), minlength=len(ids))
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[at[:, 0]], label[at[:, 1]])
        fresh = label.copy()
        np.minimum.at(fresh, at[:, 0], low)
        np.minimum.at(fresh, at[:, 1], low)
        if (fresh == label).all():
            return pd.DataFrame({"id": ids, "least": ids[label], "n_links": n})
        label = fresh


def _small_blocks(kind, work):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("lo", kind="stable")
        lo = frame["lo"].to_numpy()
        columns = [frame[c].to_numpy() for c in ("id", "n", "held", "blocks")]
        cuts = np.flatnonzero(np.diff(lo)) + 1
        out = [work(lo[i], kind(*(c[i:j] for c in columns))) for i, j in zip([0, *cuts], [*cuts, len(lo)])]
        return pd.concat(out, ignore_index=True)

    return run


def _tile_pair(kind, work):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        one = left.iloc[0]
        a, b = (kind(*zip(*((r["id"], r["n"], r["held"], r["blocks"]) for r in x.iloc[0]))) for x in (left["members"], right["others"]))
        return work(one["lo"], a, None if one["same"] else b)

    return run


class Links(NamedTuple):
    pairs: DataFrame  # a, b: every link between two classes, by their smallest doc_ids, a < b; computed when read
    members: DataFrame  # doc_id, n_shingles, class_id, component_id, n_links: one row per row of the input


def _in_blocks(held: DataFrame, blocks: DataFrame, kind):
    """Function (work, schema) -> the rows of ``work`` in all blocks (lo, id, n), on tiles made by ``kind`` of ``held`` (id, held)."""
    step = F.floor(F.log(F.col("n")) / math.log(STEP)).cast("int").alias("step")
    sizes = staged(blocks.groupBy("lo", step).agg(F.count("*").alias("c"), F.sum("n").alias("s")), "join-sizes")
    whole = sizes.groupBy("lo").agg(F.sum("c").alias("cc"), F.sum("s").alias("ss")).withColumn("large", (F.col("cc") > TILE) | (F.col("ss") > BUDGET))
    tiles = F.greatest(F.ceil(F.col("c") / TILE), F.ceil(F.col("s") / BUDGET)).cast("int")
    plan = staged(sizes.join(whole.where("large").select("lo"), "lo", "left_semi").select("lo", "step", tiles.alias("tiles")), "join-plan")
    groups = 1 + (whole.where(~F.col("large")).agg(F.sum("ss")).first()[0] or 0) // BUDGET
    places = staged(blocks.groupBy("id", "n", step).agg(F.collect_set("lo").alias("blocks")), "join-places")
    places = F.broadcast(places) if blocks.count() * 64 <= BROADCAST_BYTES else places
    rows = held.join(places, "id").select("id", "n", "step", "held", "blocks", F.explode("blocks").alias("lo"))
    rows = rows.join(small_or_plain(plan, 32), ["lo", "step"], "left")
    small = rows.where("tiles IS NULL").withColumn("dealt", F.pmod(F.xxhash64("lo"), F.lit(groups))).select("dealt", "lo", "id", "n", "held", "blocks")
    cut = rows.where("tiles IS NOT NULL").withColumn("t", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    packed = staged(cut.groupBy("lo", "step", "t").agg(F.collect_list(F.struct("id", "n", "held", "blocks")).alias("members")), "join-tiles")
    there = packed.select("lo", "step", "t")  # hashing may leave a tile empty
    near = there.select(F.col("lo").alias("l"), F.col("step").alias("st"), F.col("t").alias("u"))
    meet = (F.col("lo") == F.col("l")) & (((F.col("step") == F.col("st")) & (F.col("t") <= F.col("u"))) | (F.col("step") + 1 == F.col("st")))
    pairs = there.join(near, meet).withColumn("same", (F.col("step") == F.col("st")) & (F.col("t") == F.col("u")))
    pairs = staged(pairs.drop("l"), "join-meet")
    key = ["lo", "step", "t", "st", "u"]
    left = packed.join(pairs, ["lo", "step", "t"]).select(*key, "same", "members")
    right = packed.select("lo", F.col("step").alias("st"), F.col("t").alias("u"), "members").join(pairs, ["lo", "st", "u"])
    right = right.select(*(F.col(k).alias(f"r_{k}") for k in key), F.col("members").alias("others"))

    def found(work, schema: str) -> DataFrame:
        inside = small.groupBy("dealt").applyInPandas(_small_blocks(kind, work), schema)
        across = left.groupBy(*key).cogroup(right.groupBy(*(f"r_{k}" for k in key))).applyInPandas(_tile_pair(kind, work), schema)
        return inside.unionByName(across)

    return found


def links(docs: DataFrame, text_col: str = "text") -> Links:
    """All links of ``docs``; ``n_links`` counts the classes that a row's class links with.

    A row without words is its own class and has no links; one without a doc_id has no class either.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n long, digest binary, slice int, counts binary"
    described = staged(docs.where(F.col("doc_id").isNotNull()).mapInPandas(_describe, schema), "join-sets")
    known = described.where("slice IS NULL").select("doc_id", "n", "digest")
    narrow = known.where("n > 0")
    classes = staged(attach_least(narrow, "digest", "doc_id", "rep", "join-classes").select("doc_id", "digest", F.coalesce("rep", "doc_id").alias("rep")).distinct(), "join-classes")
    own = small_or_plain(staged(classes.where("doc_id = rep").select("doc_id").distinct(), "join-own"), 16)
    ranks = slot_ranks(described.where("slice IS NOT NULL").select("slice", "counts"))
    shingles = narrow.agg(F.sum("n")).first()[0] or 0
    hot = int(4 * math.log2(1 + max(HOT, shingles // HOT_SHARE)))
    first = docs.join(own, "doc_id", "left_semi").mapInPandas(_dealt_keys(ranks, 1 + shingles // 4 // KEYS, hot), PACKED)
    first = staged(first, "join-first")
    rare = first.where("bucket IS NOT NULL").select("bucket", "ids", "sizes", "counts", "keys").groupBy("bucket")
    often = first.where("id IS NOT NULL").select("id", "n", F.explode("often").alias("key"))
    least = staged(often.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key", "lo"), "join-keys")
    met = often.join(small_or_plain(least, 32), "key").select("lo", "id", "n")
    blocks = staged(rare.applyInPandas(shared_keys, "lo long, id long, n long").unionByName(met).distinct(), "join-blocks")
    blocks = staged(needed_blocks(blocks), "join-blocks")
    some = small_or_plain(staged(blocks.select(F.col("id").alias("doc_id")).distinct(), "join-some"), 16)
    fine = staged(docs.join(some, "doc_id", "left_semi").mapInPandas(_fine, "id long, held binary").distinct(), "join-fine")
    live = _in_blocks(fine, blocks, _Outline)(tile_live, "lo long, id long")
    blocks = staged(blocks.join(staged(live.distinct(), "join-live"), ["lo", "id"], "left_semi"), "join-blocks")
    blocks = staged(needed_blocks(blocks), "join-blocks")
    wanted = small_or_plain(staged(blocks.select(F.col("id").alias("doc_id")).distinct(), "join-wanted"), 16)
    sets = staged(docs.join(wanted, "doc_id", "left_semi").mapInPandas(_sets, "id long, held binary"), "join-whole")
    found = _in_blocks(sets, blocks, _Tile)
    members_found = staged(found(tile_members, "id long, least long, n_links long"), "join-found")
    ends = staged(members_found.groupBy(F.col("id").alias("rep")).agg(F.sum("n_links").alias("n_links")), "join-counts")
    edges = members_found.where("least < id").select(F.col("least").alias("a"), F.col("id").alias("b"))
    labels = components(edges, "join-labels").withColumnRenamed("id", "rep").join(ends, "rep")
    mapped = classes.join(labels, "rep", "left").select("doc_id", "digest", F.col("rep").alias("class_id"), F.coalesce("label", "rep").alias("c"), "n_links")
    members = known.select("doc_id", "n", "digest").join(mapped, ["doc_id", "digest"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("c", "doc_id").alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )
    lost = docs.where(F.col("doc_id").isNull()).mapInPandas(_describe, schema).where("slice IS NULL")
    none = F.lit(None).cast("long")
    lost = lost.select("doc_id", F.col("n").alias("n_shingles"), none.alias("class_id"), none.alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return Links(found(tile_pairs, "a long, b long"), members.unionByName(lost))


def join(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id``."""
    return links(docs, text_col).members.select("doc_id", "n_shingles", "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    """op7: set size and component of every document."""
    return join(table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the document with the smallest id stays; columns as they are."""
    return without_ids(docs, join(docs).where("component_id <> doc_id").select("doc_id"), "near-copies")
