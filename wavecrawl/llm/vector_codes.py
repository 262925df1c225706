"""Vector code compression: product codes by exact integer k-means over anchors-hierarchy metric trees.

Each component x becomes floor(1024 * x); a vector is cut into ``PARTS`` equal consecutive parts
and each part position has a codebook of at most ``ENTRIES`` entries, which starts as that part of
the smallest vec_ids. ``ROUNDS`` rounds assign every part to its nearest entry (squared Euclidean
distance, ties to the lower index) and replace each used entry by the componentwise floored mean.

The work goes through metric trees, one for each part of a block of at most ``BLOCK`` vectors,
made once and staged. A tree is built middle-out: about sqrt(n) anchors are planted one after the
other, each at the point farthest from its anchor, and steal the points that are nearer to them
(a point closer than half the distance between two anchors is never looked at); anchors hold
sub-trees of the same make, and the balls that fit best are merged pairwise up to the root. Every
ball caches the sum and the count of its points. An assignment walks a tree from the root, level
by level, with a list of candidate entries that children inherit: an entry leaves the list once
another one is provably nearer to every point of the ball. A ball with one candidate left is
wholly owned: its cached sum and count are added and nothing below it is visited. Points of leaf
balls are held against their remaining candidates, exactly. So a round sends at most PARTS * ENTRIES
rows of sums from each task, and only the codebooks (PARTS * ENTRIES short rows) reach the driver.

Rows are dropped if the vector is null, holds null or non-finite components or one whose scaled
size is 2^28 or more (its squared distance leaves a long), is empty, has a length that is no
multiple of ``PARTS``, or another length than that of the smallest remaining vec_id. Repeated
vec_ids are rows of their own (for the first codebook in order of the vectors); a null vec_id is
coded but is in no first codebook, so a table of null vec_ids alone gives no rows. Equal vectors
get equal codes. Null labels are one group. Extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_or_plain, staged, table

PARTS, ENTRIES, ROUNDS = 4, 256, 4
SCALE = 1024
LARGEST = 1 << 28
BLOCK = 4096  # vectors under one set of trees
LEAF = 32  # points in a ball that is not split further


# --- trees --------------------------------------------------------------------


@dataclass
class Tree:
    """Balls in depth-first order; ball b holds ``points[start[b]:end[b]]`` (rows in the tree's own order)."""

    order: np.ndarray  # block row of each point
    points: np.ndarray
    pivot: np.ndarray
    radius: np.ndarray
    total: np.ndarray
    start: np.ndarray
    end: np.ndarray
    left: np.ndarray  # child balls, -1 for a leaf
    right: np.ndarray


def _plant(points: np.ndarray) -> list[np.ndarray]:
    """Row numbers of the points of about sqrt(n) anchors."""
    n = len(points)
    owner = np.zeros(n, np.int64)
    away = np.sqrt(((points - points[0]) ** 2).sum(axis=1))
    pivots = [0]
    while len(pivots) < max(2, int(n**0.5)):
        new = int(away.argmax())  # the point farthest from its anchor, over all anchors
        if away[new] == 0:
            break
        half = np.sqrt(((points[pivots] - points[new]) ** 2).sum(axis=1)) / 2
        maybe = np.flatnonzero(away >= half[owner])  # nearer ones keep their anchor, by the triangle inequality
        d = np.sqrt(((points[maybe] - points[new]) ** 2).sum(axis=1))
        taken = d < away[maybe]
        owner[maybe[taken]], away[maybe[taken]] = len(pivots), d[taken]
        pivots.append(new)
    return [g for g in (np.flatnonzero(owner == k) for k in range(len(pivots))) if len(g)]


def _grow(points: np.ndarray, rows: np.ndarray):
    """Nested balls: an array of rows (leaf) or a pair of balls."""
    if len(rows) <= LEAF:
        return rows
    groups = _plant(points[rows])
    if len(groups) < 2:  # equal points
        return rows
    balls = [_grow(points, rows[g]) for g in groups]
    weight = np.array([len(g) for g in groups], float)
    centre = np.array([points[rows[g]].mean(axis=0) for g in groups])
    radius = np.array([np.sqrt(((points[rows[g]] - c) ** 2).sum(axis=1).max()) for g, c in zip(groups, centre)])
    span = np.sqrt(((centre[:, None] - centre[None]) ** 2).sum(axis=2)) + radius[:, None] + radius[None]
    np.fill_diagonal(span, np.inf)
    for _ in range(len(balls) - 1):  # merge the two balls under the smallest common ball
        a, b = divmod(int(span.argmin()), len(balls))
        reach = span[a, b] / 2
        balls[a] = (balls[a], balls[b])
        centre[a] = (centre[a] * weight[a] + centre[b] * weight[b]) / (weight[a] + weight[b])
        weight[a] += weight[b]
        radius[a] = reach
        span[b], span[:, b] = np.inf, np.inf
        live = np.isfinite(span[a])
        live[a] = False
        span[a, live] = np.sqrt(((centre[live] - centre[a]) ** 2).sum(axis=1)) + radius[live] + reach
        span[live, a] = span[a, live]
    return balls[a]


def build_tree(points: np.ndarray) -> Tree:
    """The anchors hierarchy over integer points."""
    nested = _grow(points.astype(np.float64), np.arange(len(points)))
    leaves, balls, todo = [], [], [(nested, -1, 0)]
    at = 0
    while todo:  # depth first, so every ball is a stretch of the order
        ball, parent, side = todo.pop()
        if parent >= 0:
            balls[parent][2 + side] = len(balls)
        balls.append([at, at, -1, -1])
        if isinstance(ball, tuple):
            here = len(balls) - 1
            todo += [(ball[1], here, 1), (ball[0], here, 0)]
        else:
            leaves.append(ball)
            at += len(ball)
            balls[-1][1] = at
    for b in reversed(balls):
        if b[3] >= 0:
            b[1] = balls[b[3]][1]
    order = np.concatenate(leaves)
    own = points[order]
    start, end, left, right = (np.array(x, np.int32) for x in zip(*balls))
    before = np.vstack([np.zeros((1, own.shape[1]), np.int64), np.cumsum(own, axis=0, dtype=np.int64)])
    total = before[end] - before[start]
    pivot = total / (end - start)[:, None]
    radius = np.array([np.sqrt(((own[s:e] - p) ** 2).sum(axis=1).max()) for s, e, p in zip(start, end, pivot)])
    return Tree(order.astype(np.int32), own, pivot, radius, total, start, end, left, right)


def _squares(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances in float64: exact for integers if every sum stays below 2^53."""
    p, b = points.astype(np.float64), book.astype(np.float64)
    return (p**2).sum(axis=1)[:, None] - 2 * (p @ b.T) + (b**2).sum(axis=1)


def _exact_nearest(points: np.ndarray, book: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest nearest allowed entry of each integer point, and the squared distance, as int64."""
    largest = max(int(np.abs(points).max(initial=0)), int(np.abs(book).max(initial=0)))
    if points.shape[1] * (2 * largest) ** 2 < 1 << 53:
        d = np.where(allowed, _squares(points, book), np.inf)
        best = d.argmin(axis=1)
        return best, d[np.arange(len(d)), best].astype(np.int64)
    best, least = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
    for a in range(0, len(points), 64):
        gap = points[a : a + 64, None].astype(np.int64) - book[None].astype(np.int64)
        d = np.where(allowed[a : a + 64], (gap**2).sum(axis=2), np.iinfo(np.int64).max)
        best[a : a + 64] = d.argmin(axis=1)
        least[a : a + 64] = d.min(axis=1)
    return best, least


def assign(tree: Tree, book: np.ndarray, want_codes: bool):
    """Sums and counts by entry, visited balls, and with ``want_codes`` the entry of each block row."""
    sums, counts = np.zeros(book.shape, np.int64), np.zeros(len(book), np.int64)
    codes = np.zeros(len(tree.order), np.int64)
    first = np.zeros(len(book), bool)  # of equal entries only the lowest can win
    first[np.unique(book, axis=0, return_index=True)[1]] = True
    apart = np.sqrt(np.maximum(_squares(book, book), 0))
    largest = (book.astype(np.float64) ** 2).sum(axis=1).max()
    balls, listed, open_leaves, visited = np.array([0]), first[None], [], 0
    while len(balls):
        visited += len(balls)
        pivot = tree.pivot[balls]
        d = np.where(listed, _squares(pivot, book), np.inf)
        best = d.argmin(axis=1)
        near = d[np.arange(len(d)), best]
        # x.(c - best) varies by at most radius * |c - best| inside the ball; the slack covers rounding
        slack = 1e-6 + 1e-9 * ((pivot**2).sum(axis=1) + largest)
        never = d - near[:, None] > 2 * tree.radius[balls][:, None] * apart[best] + slack[:, None]
        listed = listed & ~never
        owned = listed.sum(axis=1) == 1
        mine, entry = balls[owned], best[owned]
        np.add.at(sums, entry, tree.total[mine])
        np.add.at(counts, entry, (tree.end - tree.start)[mine])
        if want_codes:
            for b, e in zip(mine, entry):
                codes[tree.order[tree.start[b] : tree.end[b]]] = e
        balls, listed = balls[~owned], listed[~owned]
        leaf = tree.left[balls] < 0
        open_leaves.append((balls[leaf], listed[leaf]))
        balls = np.stack([tree.left[balls[~leaf]], tree.right[balls[~leaf]]], axis=1).ravel()
        listed = np.repeat(listed[~leaf], 2, axis=0)
    leaves, listed = (np.concatenate(x) for x in zip(*open_leaves))
    size = (tree.end - tree.start)[leaves]
    for a, b in _stretches(size):
        rows = np.concatenate([np.arange(s, e) for s, e in zip(tree.start[leaves[a:b]], tree.end[leaves[a:b]])])
        best, _ = _exact_nearest(tree.points[rows], book, np.repeat(listed[a:b], size[a:b], axis=0))
        np.add.at(sums, best, tree.points[rows].astype(np.int64))
        counts += np.bincount(best, minlength=len(book))
        codes[tree.order[rows]] = best
    return sums, counts, visited, codes if want_codes else None


def _stretches(size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of leaves that hold about BLOCK points together."""
    a, held = 0, 0
    for k, s in enumerate(size):
        held += int(s)
        if held >= BLOCK:
            yield a, k + 1
            a, held = k + 1, 0
    if a < len(size):
        yield a, len(size)


# --- Spark --------------------------------------------------------------------


def _pack(trees: list[Tree]) -> bytes:
    return zlib.compress(pickle.dumps(trees, protocol=5), 1)


def _unpack(data: bytes) -> list[Tree]:
    return pickle.loads(zlib.decompress(data))


def _narrow(points: np.ndarray) -> np.ndarray:
    return points.astype(np.int16 if np.abs(points).max(initial=0) < 1 << 15 else np.int32)


def plant_trees(vectors: DataFrame, dim: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """One row for each block of at most ``BLOCK`` vectors: ids and labels (in row order) and the packed trees."""
    label = vectors.schema[label_col].dataType
    schema = T.StructType(
        [T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(label)), T.StructField("trees", T.BinaryType())]
    )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            while rows + batch.num_rows >= BLOCK:
                cut = BLOCK - rows
                yield block(held + [batch.slice(0, cut)])
                batch, held, rows = batch.slice(cut), [], 0
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
        if held:
            yield block(held)

    def block(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(batches).combine_chunks()
        x = t["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        points = np.floor(x.astype(np.float64) * SCALE).astype(np.int64)
        trees = [build_tree(_narrow(p)) for p in np.split(points, PARTS, axis=1)]
        ends = pa.array([0, len(points)], pa.int32())
        lists = [pa.ListArray.from_arrays(ends, t[c].combine_chunks()) for c in ("id", "label")]
        return pa.RecordBatch.from_arrays([*lists, pa.array([_pack(trees)], pa.binary())], ["ids", "labels", "trees"])

    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("x"))
    return own.mapInArrow(blocks, schema)


def _round(blocks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """One assignment of all parts, and the entries that follow from it."""
    width = books[0].shape[1]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [np.zeros(b.shape, np.int64) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for data in batch["trees"]:
                for k, tree in enumerate(_unpack(data.as_py())):
                    s, c, _, _ = assign(tree, books[k], want_codes=False)
                    sums[k] += s
                    counts[k] += c
        for k in range(PARTS):
            used = np.flatnonzero(counts[k])
            columns = [np.full(len(used), k), used, counts[k][used], *sums[k][used].T]
            names = ["part", "entry", "n", *(f"s{i}" for i in range(width))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    names = ["n", *(f"s{i}" for i in range(width))]
    got = blocks.select("trees").mapInArrow(partial, ", ".join(f"{c} long" for c in ["part", "entry", *names]))
    new = [b.copy() for b in books]
    # at most PARTS * ENTRIES rows
    for r in got.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in names]).collect():
        new[r.part][r.entry] = [r[f"s{i}"] // r.n for i in range(width)]
    return new


def _coded(blocks: DataFrame, books: list[np.ndarray], label: T.DataType) -> DataFrame:
    schema = T.StructType(
        [T.StructField("id", T.LongType()), T.StructField("label", label), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                trees = _unpack(batch["trees"][k].as_py())
                codes = np.zeros((len(trees[0].order), PARTS), np.uint8)
                error = np.zeros(len(codes), np.int64)
                for part, tree in enumerate(trees):
                    mine = assign(tree, books[part], want_codes=True)[3]
                    codes[:, part] = mine
                    gap = tree.points.astype(np.int64) - books[part][mine[tree.order]]
                    error[tree.order] += (gap**2).sum(axis=1)
                text = [c.tobytes().hex() for c in codes]
                columns = [batch["ids"][k].values, batch["labels"][k].values, pa.array(text, pa.string()), pa.array(error, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "label", "code", "error"])

    return blocks.mapInArrow(rows, schema)


def kept_vectors(df: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector can be coded (see the module's text), of whatever length."""
    x = F.col(vector_col)

    def bad(v):
        return v.isNull() | F.isnan(v) | (F.abs(v.cast("double") * SCALE) >= LARGEST)

    return df.where(x.isNotNull() & (F.size(x) > 0) & (F.size(x) % PARTS == 0)).where(~F.exists(x, bad))


@dataclass
class Compressed:
    rows: DataFrame  # vec id, label, code, error
    books: list[np.ndarray]  # PARTS arrays of entries

    def sha256(self) -> str:
        every = ",".join(str(v) for b in self.books for v in b.ravel().tolist())
        return hashlib.sha256(every.encode()).hexdigest()


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> Compressed | None:
    """Codes of all vectors of ``df`` and the codebooks; None if no vector can be coded."""
    kept = kept_vectors(df.select(id_col, vector_col, label_col), vector_col)
    named = kept.where(F.col(id_col).isNotNull())
    smallest = named.orderBy(id_col, vector_col).select(F.size(vector_col).alias("dim")).limit(1).collect()
    if not smallest:
        return None
    dim = smallest[0].dim
    kept = kept.where(F.size(vector_col) == dim)
    starts = named.where(F.size(vector_col) == dim).orderBy(id_col, vector_col).select(vector_col).limit(ENTRIES).collect()
    whole = np.floor(np.array([r[0] for r in starts], np.float64) * SCALE).astype(np.int64)
    books = np.split(whole, PARTS, axis=1)
    blocks = staged(plant_trees(kept, dim, id_col, vector_col, label_col), "vector-trees")
    for _ in range(ROUNDS):
        books = _round(blocks, books)
    rows = staged(_coded(blocks, books, df.schema[label_col].dataType), "vector-codes")
    return Compressed(rows.withColumnRenamed("id", id_col).withColumnRenamed("label", label_col), books)


def query(spark, sf_dir: str) -> DataFrame:
    """op11: codes of every embedding, errors, and their sums over equal labels."""
    schema = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    done = compress(table(spark, sf_dir, "embeddings"))
    if done is None:
        return spark.createDataFrame([], schema)
    sums = staged(done.rows.groupBy("label").agg(F.sum("error").alias("label_error")), "vector-labels")
    sums = small_or_plain(sums.withColumnRenamed("label", "of"), 64)
    joined = done.rows.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(done.sha256()).alias("codebooks_sha256"))
