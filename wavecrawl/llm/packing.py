"""Best-fit packing: a grouping genetic algorithm on islands, with migration of well-filled bins.

Documents become ids of the public byte-level vocabulary, then one end id. Longer ones are cut
into pieces of ``CAPACITY``, the first may be shorter. Whole pieces fill a sequence alone; the
others are dealt at random to groups of about ``GROUP`` pieces. ``ISLANDS`` islands search the
pieces of a group, each with its own seed and a small population of packings, first by best fit
on perturbed orders. A crossover takes whole well-filled bins of one parent, drops the other
parent's bins that hold the same pieces, and puts displaced pieces into the open bins by best
fit. After each round the elite of an island's best packing, its bins full to ``ELITE``, migrates
as copies to the next island of the group and crosses there with that island's best. The
island with the fewest sequences gives the group's packing. Its bins full to ``ELITE`` are final;
pieces of the rest are dealt to new, fewer groups in the next epoch, and the last epoch keeps all
its bins. So an island stays of bounded size, and all groups together waste at most one loose
bin each in the last epoch.

Ids are made with ``tiktoken``, which has the same vocabulary and is three times as fast; tests
hold them against ``tokenizers``, which takes over (its ``.json`` file beside the vocabulary)
where a text has blanks by the million in a row. Null and empty texts are the end id alone. Rows that repeat a
doc_id, or have none, are packed each. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import random
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, table

CAPACITY = 1024
END_ID = 2
GROUP = 3000
ISLANDS, ROUNDS = 2, 2  # islands that search the same pieces; searches with a migration between them
POPULATION, GENERATIONS = 4, 4
EPOCHS = 3
ELITE = 1020  # tokens in a bin from which it migrates, and is final before the last epoch
END_OF_TEXT = "<|endoftext|>"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def _encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: len(ranks)})


@lru_cache(maxsize=2)
def _library(path: str):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def encode(text: str, path: str) -> list[int]:
    """Ids of a whole text; ``tiktoken`` refuses very long runs of blanks, which the other library encodes."""
    try:
        return _encoder(path).encode(text, allowed_special="all")
    except ValueError:
        return _library(path.removesuffix(".tiktoken") + ".json").encode(text, add_special_tokens=False).ids


def cut(text: str | None, path: str) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32 of the ids) of a document's pieces."""
    ids = np.array(encode(text or "", path) + [END_ID], "<u4")
    first = len(ids) % CAPACITY or CAPACITY
    ends = [0, *range(first, len(ids) + 1, CAPACITY)]
    for k, (a, b) in enumerate(zip(ends, ends[1:])):
        yield k, a, b - a, zlib.crc32(ids[a:b].tobytes())


def best_fit(sizes, todo, bins: list[list[int]], rooms: list[int]) -> None:
    """Puts each piece of ``todo``, in order, into the fullest bin that takes it, else a new one."""
    at: list[list[int]] = [[] for _ in range(CAPACITY + 1)]
    mask = 0
    for k, room in enumerate(rooms):
        at[room].append(k)
        mask |= 1 << room
    for piece in todo:
        size = sizes[piece]
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            k = at[room].pop()
            if not at[room]:
                mask &= ~(1 << room)
            bins[k].append(piece)
        else:
            room, k = CAPACITY, len(bins)
            bins.append([piece])
            rooms.append(room)
        room -= size
        rooms[k] = room
        at[room].append(k)
        mask |= 1 << room


def fitness(bins, sizes) -> float:
    """Mean squared fill: better when bins are full or nearly empty."""
    return sum((sum(sizes[p] for p in b) / CAPACITY) ** 2 for b in bins) / max(len(bins), 1)


def crossover(a, b, sizes, rng: random.Random):
    """Whole well-filled bins of ``b`` go into ``a``; pieces that lose their bin are placed by best fit."""
    ranked = sorted(range(len(b)), key=lambda k: (-sum(sizes[p] for p in b[k]), rng.random()))
    taken = [list(b[k]) for k in ranked[: max(1, len(b) // 2)] if rng.random() < 0.7]
    inside = {p for x in taken for p in x}
    bins, displaced = taken, []
    for x in a:
        if inside.isdisjoint(x):
            bins.append(list(x))
        else:
            displaced += [p for p in x if p not in inside]
    rooms = [CAPACITY - sum(sizes[p] for p in x) for x in bins]
    best_fit(sizes, sorted(displaced, key=lambda p: (-sizes[p], p)), bins, rooms)
    return bins


def evolve(sizes: list[int], seed: int, own: list[list[int]] | None = None, elite: list[list[int]] | None = None) -> list[list[int]]:
    """The best packing found for pieces of the given sizes: lists of their indexes.

    ``own`` is the packing to go on from, and ``elite`` holds well-filled bins of another one.
    """
    rng = random.Random(seed)
    people = [] if own is None else [own]
    if own and elite:
        people.append(crossover(own, elite, sizes, rng))
    for k in range(len(people), POPULATION):
        noise = 0.02 * k * CAPACITY
        order = sorted(range(len(sizes)), key=lambda p: (-sizes[p] + (rng.random() * noise if k else 0), p))
        bins: list[list[int]] = []
        best_fit(sizes, order, bins, [])
        people.append(bins)
    people = [(fitness(x, sizes), x) for x in people]
    for _ in range(GENERATIONS):
        people.sort(key=lambda x: (len(x[1]), -x[0]))
        child = crossover(people[0][1], people[rng.randrange(1, len(people))][1], sizes, rng)
        people[-1] = (fitness(child, sizes), child)
    return min(people, key=lambda x: (len(x[1]), -x[0]))[1]


def _bins(frame: pd.DataFrame, at: dict[int, int]) -> list[list[int]]:
    """The bins of rows (uid, sequence_id, offset), as lists of pieces."""
    frame = frame.sort_values(["sequence_id", "offset"], kind="stable")
    return [[at[u] for u in x] for _, x in frame.groupby("sequence_id", sort=False)["uid"]]


def _island(key, frame: pd.DataFrame) -> pd.DataFrame:
    """One round of an island: rows of its pieces, with its packing so far, and of a neighbour's elite."""
    group, island, round_ = (int(k) for k in key)
    own = frame[~frame["migrant"]].sort_values("uid", kind="stable").reset_index(drop=True)
    uid, sizes = own["uid"].to_numpy(), own["length"].astype(int).tolist()
    at = {u: k for k, u in enumerate(uid.tolist())}
    start = _bins(own, at) if round_ else None
    best = evolve(sizes, (group * ISLANDS + island) * ROUNDS + round_, start, _bins(frame[frame["migrant"]], at))
    out = []
    for bin_ in best:
        offset, fill = 0, sum(sizes[p] for p in bin_)
        for p in bin_:
            out.append((p, bin_[0], offset, fill))
            offset += sizes[p]
    p, first, offset, fill = zip(*out)
    made = {"uid": uid[list(p)], "length": np.array(sizes)[list(p)], "sequence_id": uid[list(first)], "offset": offset, "fill": fill}
    return pd.DataFrame({"group": group, "island": island, **made, "bins": len(best), "loss": 1 - fitness(best, sizes)})


_FOUND = "group long, island long, uid long, length long, sequence_id long, offset long, fill long, bins long, loss double"


def grouped_search(pieces: DataFrame) -> DataFrame:
    """``uid, length, sequence_id, offset, fill``: the best island's packing of each group of ``pieces`` (uid, length, group)."""
    one = F.lit(None).cast("long")
    islands = F.explode(F.array(*(F.lit(k).cast("long") for k in range(ISLANDS)))).alias("island")
    rows = pieces.select("group", islands, "uid", "length", one.alias("sequence_id"), one.alias("offset"), F.lit(False).alias("migrant"))
    for round_ in range(ROUNDS):
        found = staged(rows.groupBy("group", "island", F.lit(round_).alias("round")).applyInPandas(_island, _FOUND), "pack-islands")
        kept = found.select("group", "island", "uid", "length", "sequence_id", "offset", F.lit(False).alias("migrant"))
        elite = found.where((F.col("fill") >= ELITE) & F.lit(ISLANDS > 1))
        rows = kept.unionByName(elite.select("group", ((F.col("island") + 1) % ISLANDS).alias("island"), "uid", "length", "sequence_id", "offset", F.lit(True).alias("migrant")))
    best = found.groupBy("group").agg(F.min(F.struct("bins", "loss", "island"))["island"].alias("island"))
    return found.join(best, ["group", "island"], "left_semi").select("uid", "length", "sequence_id", "offset", "fill")


def pack(docs: DataFrame, vocabulary: str | None = None, text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    path = vocabulary or default_vocabulary()

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(d, *x) for d, t in zip(frame["doc_id"], frame["text"]) for x in cut(t, path)]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    made = own.mapInPandas(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long")
    made = staged(made.withColumn("uid", F.monotonically_increasing_id()), "pack-pieces")
    left = made.where(F.col("length") < CAPACITY).select("uid", "length")
    placed = made.where(F.col("length") == CAPACITY).select("uid", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    for epoch in range(EPOCHS):
        groups = max(1, left.count() // GROUP)
        dealt = left.withColumn("group", F.pmod(F.xxhash64("uid", F.lit(epoch)), F.lit(groups)))
        done = staged(grouped_search(dealt.select("group", "uid", "length")), "pack-epoch")
        final = F.col("fill") >= (ELITE if epoch < EPOCHS - 1 else 0)
        placed = placed.unionByName(done.where(final).select("uid", "sequence_id", "offset"))
        left = done.where(~final).select("uid", "length")
    return made.join(placed, "uid").drop("uid")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: every document packed into sequences of at most 1024 tokens."""
    return pack(table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the given documents, packed."""
    return pack(docs)
