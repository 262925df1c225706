"""Benchmark decontamination with DataFrame functions only: SimHash of item-sized windows.

1. Words are runs without blanks, in lower case; shingles are ``SHINGLE`` words (an item with
   fewer words is one shingle). Windows have the item's number of words at every place, or are the
   whole text if shorter. Those that hold too few shingles of all items of their length to be
   similar to any one, wherever in the item the shingles lie, are not fingerprinted: at
   similarity 0.75 6 of 7 must be shared, so this loses no pair.
2. A window's and an item's 64-bit SimHash take the majority, bit by bit, of its shingles'
   hashes. The fingerprint is cut into ``RADIUS + 1`` blocks: two fingerprints within
   ``RADIUS`` differ in at most ``RADIUS`` bits, so at least one block is equal. Windows meet
   the items of their length through an equal block, and stay if the Hamming distance is
   within the radius. Blocks of 2 to 3 bits let most pairs of one length meet: the radius,
   then the exact similarity decide.
3. Weighted shingle similarity (sum of smaller counts over sum of larger counts) of at least
   ``SIMILARITY`` confirms.

Texts of any length are read whole. Null and empty texts, and items without words, match
nothing. Equal texts are searched once, for all their ids. Rows that repeat a doc_id with the same
or other text are searched each, and their matches count for the id. A null doc_id or item_id is a
value like others. No Python runs on the executors; the benchmark is broadcast only while its
counted shingles fit 32 MB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_or_plain, staged, table, without_ids

SHINGLE = 5
SIMILARITY = 0.75
BITS = 64
RADIUS = 27  # similarity 0.75 gives 11 differing bits on average
BLOCKS = RADIUS + 1


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+"), "")


def shingles_of(words: Column, k: int) -> Column:
    """Hashes of each ``k`` words in a row, in order; none if there are fewer words."""
    return F.when(
        F.size(words) >= k,
        F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(k)))),
    ).otherwise(F.array().cast("array<bigint>"))


def simhash(hashes: Column) -> Column:
    """Majority of each bit over the hashes; a tie is 0."""
    one = F.lit(1).cast("long")
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(BITS - 1)),
        F.lit(0).cast("long"),
        lambda fp, b: F.when(
            F.aggregate(hashes, F.lit(0), lambda n, h: n + F.getbit(h, b).cast("int")) * 2 > F.size(hashes),
            fp.bitwiseOR(F.call_function("shiftleft", one, b)),
        ).otherwise(fp),
    )


def blocks_of(fp: Column) -> Column:
    """The fingerprint's bits, cut into ``BLOCKS`` runs whose sizes differ by one at most."""
    cuts = [b * BITS // BLOCKS for b in range(BLOCKS + 1)]
    return F.array(*(F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (z - a)) - 1)).cast("int") for a, z in zip(cuts, cuts[1:])))


def weighted_similarity(a: Column, b: Column) -> Column:
    """Sum of the smaller counts over sum of the larger counts, of two arrays' values."""
    count = lambda values, x: F.size(F.filter(values, lambda y: y == x))
    common = F.aggregate(F.array_distinct(a), F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))
    return common / (F.size(a) + F.size(b) - common)


def starts_of(hits: DataFrame, k: int) -> DataFrame:
    """Window starts that can reach ``SIMILARITY``: ``body, length, runs`` (array of ``low`` to ``high``, each start once).

    ``hits`` has a text's number of words ``n`` and, in order, the places ``at`` of its shingles that items of ``length``
    words have. A window shares at most as many shingles with an item as it holds of these, and the similarity of sizes m
    and w needs ``SIMILARITY * (m + w) / (1 + SIMILARITY)`` shared ones. A start belongs to its window's first hit.
    """
    share = SIMILARITY / (1 + SIMILARITY)
    h = hits.withColumn("m", F.col("length") - (k - 1)).withColumn("last", F.greatest(F.lit(0), F.col("n") - F.col("length")))
    # less a little: a rounding error must not ask for one more
    h = h.withColumn("need", F.ceil(F.lit(share) * (F.col("m") + F.least("m", F.col("n") - (k - 1))) - 1e-6).cast("int"))
    h = h.where(F.size("at") >= F.col("need"))
    run = "struct(greatest(0, get(at, i - 1) + 1, get(at, i + need - 1) - m + 1) as low, least(get(at, i), last) as high)"
    runs = F.expr(f"filter(transform(sequence(0, size(at) - need), i -> {run}), r -> r.low <= r.high)")
    return h.select("body", "length", runs.alias("runs")).where(F.size("runs") > 0)


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document and benchmark item that it holds: ``doc_id, item_id, start, similarity``.

    ``start`` is the first word (from 0) of the most similar window, the earliest of equals.
    """
    w = words_of(F.col("text"))
    items = benchmark.select("item_id", w.alias("words")).where(F.size("words") > 0).distinct()
    items = items.withColumn("item", F.xxhash64("words")).withColumn("k", F.least(F.size("words"), F.lit(SHINGLE)))
    per_k = [
        items.where(F.col("k") == k).select("item_id", "item", "k", F.size("words").alias("length"), shingles_of(F.col("words"), k).alias("item_hashes"))
        for k in range(1, SHINGLE + 1)
    ]
    every = per_k[0]
    for more in per_k[1:]:
        every = every.unionByName(more)
    # staged step by step: merged into one projection, these nested lambdas take minutes to plan
    every = staged(staged(every, "decontam-shingles").withColumn("item_fp", simhash(F.col("item_hashes"))), "decontam-prints")
    every = staged(every.withColumn("item_blocks", blocks_of(F.col("item_fp"))), "decontam-items")
    sizes = [r["k"] for r in every.select("k").distinct().collect()]  # at most SHINGLE values
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("body", F.xxhash64("text"))
    laid = None
    for k in sorted(sizes) or [SHINGLE]:
        anchors = staged(every.where(F.col("k") == k).select("length", F.explode("item_hashes").alias("hash")).distinct(), "decontam-anchors")
        texts = own.withColumn("words", words_of(F.col("text"))).select("body", F.size("words").alias("n"), shingles_of(F.col("words"), k).alias("hashes"))
        # outer: else a filter on the array is pushed down, and splits the text anew for each shingle
        hits = texts.select("body", "n", F.posexplode_outer("hashes").alias("pos", "hash")).join(small_or_plain(anchors, 48), "hash")
        runs = starts_of(hits.groupBy("body", "n", "length").agg(F.sort_array(F.collect_set("pos")).alias("at")), k).withColumn("k", F.lit(k))
        laid = runs if laid is None else laid.unionByName(runs)
    laid = staged(laid, "decontam-runs")
    bodies = staged(laid.select("body").distinct(), "decontam-bodies")
    own = staged(own.join(small_or_plain(bodies, 16), "body", "left_semi"), "decontam-texts")
    texts = own.groupBy("body").agg(F.first("text").alias("text")).withColumn("words", words_of(F.col("text")))
    windows = None
    for k in sorted(sizes) or [SHINGLE]:
        w = texts.select("body", shingles_of(F.col("words"), k).alias("hashes")).join(laid.where(F.col("k") == k), "body")
        w = w.select("body", "length", "hashes", F.explode("runs").alias("run"))
        w = w.select("body", "length", "hashes", F.explode(F.sequence("run.low", "run.high")).alias("start"))
        w = w.select("body", "length", "start", F.expr(f"slice(hashes, start + 1, length - {k - 1})").alias("window"))
        windows = w if windows is None else windows.unionByName(w)
    # dealt by window: one long text's windows are many tasks' work
    windows = staged(windows.repartition("body", "length", "start"), "decontam-windows").withColumn("fp", simhash(F.col("window")))
    windows = staged(windows, "decontam-window-prints").withColumn("blocks", blocks_of(F.col("fp")))
    # The blocks find the items: any item of the window's length, not only those whose shingles laid the window.
    index = staged(every.select("item", "length", "item_fp", "item_blocks", F.posexplode("item_blocks").alias("block", "value")).dropDuplicates(["item", "block"]), "decontam-index")
    pairs = windows.select("*", F.posexplode("blocks").alias("block", "value")).join(small_or_plain(index, 64 + 8 * BLOCKS), ["length", "block", "value"])
    earlier = F.expr("exists(zip_with(slice(blocks, 1, block), slice(item_blocks, 1, block), (x, y) -> x = y), z -> z)")
    pairs = pairs.where((F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS) & ~earlier)  # each pair once
    pairs = pairs.select("body", "start", "window", "item").join(every.select("item", "item_hashes").dropDuplicates(["item"]), "item")
    pairs = pairs.withColumn("similarity", weighted_similarity(F.col("window"), F.col("item_hashes"))).where(F.col("similarity") >= SIMILARITY)
    best = pairs.groupBy("body", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best"))
    best = own.select("doc_id", "body").distinct().join(best, "body").groupBy("doc_id", "item").agg(F.max("best").alias("best"))
    ids = small_or_plain(staged(every.select("item", "item_id"), "decontam-ids"), 48)
    return best.join(ids, "item").select("doc_id", "item_id", (-F.col("best.back")).alias("start"), "best.similarity")


def query(spark, sf_dir: str) -> DataFrame:
    """op10: documents that hold a benchmark item, one row per document and item."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, columns as they are."""
    return without_ids(docs, find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id"), "leaked")
