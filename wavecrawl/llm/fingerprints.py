"""Document fingerprints with DataFrame functions only: invertible Bloom lookup sketches of paragraphs.

1. Paragraphs are lines; a line of more than ``LONG_LINE`` code points is cut after each
   ``.``, ``!`` or ``?`` before a blank. White space at both ends goes, empty ones too. A text's set is the distinct
   64-bit digests of its paragraphs.
2. A sketch has three tables of ``WIDTH`` cells. A digest lands in one cell of each; a cell holds
   the count, the xor of the digests and the xor of their check hashes. The fingerprint is the set's
   size and these cells, as text.
3. Two sketches are subtracted cell by cell. A cell whose count is 1 or -1 and whose check
   fits holds one differing digest; it is taken out of its three cells, until nothing is left.
4. If cells remain, the pair is tried again with a larger sketch: as many sketches of the same
   width as its sizes call for, each over the digests that a reseeded hash deals to it. Of those
   that fail again, each is dealt to four, under another seed, until all are recovered. Work and
   memory of one row stay bounded for any number of paragraphs.

Likeness is shared over all distinct paragraphs; 1 if neither text has any. Null texts count as
empty. Documents follow each other by doc_id, null first, and then by text hash; rows equal in
both count as one document, and each such row returns the same result. The last one is
followed by the first; a single document by itself. Other columns are ignored. An empty table
gives no rows. No Python runs on the executors and nothing but emptiness reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, table

LONG_LINE = 512
BLANKS = " \t\n\x0b\f\r"
WIDTH = 8  # cells in each of the three tables; a power of two
PER_SKETCH = 8  # differing digests that one sketch of a larger attempt expects at most
CELLS = 3 * WIDTH
_BITS = WIDTH.bit_length() - 1
_FIRST = -(1 << 63)  # stands for a null id in the order


def paragraphs_of(text: Column) -> Column:
    lines = F.split(text, "[\\r\\n]+")
    cut = F.flatten(F.transform(lines, lambda x: F.when(F.length(x) > LONG_LINE, F.split(x, "(?<=[.!?])\\s+")).otherwise(F.array(x))))
    return F.array_remove(F.transform(cut, lambda x: F.btrim(x, F.lit(BLANKS))), "")


def digests_of(text: Column) -> Column:
    """Distinct 64-bit digests of the text's paragraphs, sorted."""
    return F.array_sort(F.array_distinct(F.transform(paragraphs_of(text), lambda x: F.xxhash64(x))))


def _mask(digest: str, seed: int) -> str:
    """Bigint whose bit i is set if ``digest`` lands in cell number i of a sketch of this seed: one bit in each table."""
    mixed = f"xxhash64({digest}, {seed})"
    return " | ".join(f"shiftleft({1 << table * WIDTH}L, cast(shiftrightunsigned({mixed}, {_BITS * table}) & {WIDTH - 1} as int))" for table in range(3))


def cells_sql(digests: str, seed: int = 0, minus: str | None = None) -> str:
    """Cells ``struct<c int, k bigint, x int>`` of the sketch of an array of distinct digests.

    Those of ``minus``, if given, are subtracted: they land in the same cells with count -1. A digest's
    check hash and cells are computed once; the array of one element binds them.
    """
    signed = "transform({0}, d -> named_struct('c', {1}, 'k', d, 'x', hash(d), 'm', {2}))"
    every = [signed.format(ds, sign, _mask("d", seed)) for ds, sign in ((digests, 1), (minus, -1)) if ds]
    return (
        f"transform(array(concat({', '.join(every)})), ds -> transform(sequence(0, {CELLS - 1}), i -> "
        f"aggregate(ds, named_struct('c', 0, 'k', 0L, 'x', 0), (s, e) -> "
        f"if(getbit(e.m, i) = 1, named_struct('c', s.c + e.c, 'k', s.k ^ e.k, 'x', s.x ^ e.x), s))))[0]"
    )


def fingerprint_sql(digests: str) -> str:
    return (
        f"concat(hex(size({digests})), ';', array_join(transform({cells_sql(digests)}, "
        "s -> concat(hex(s.c), ':', hex(s.k), ':', hex(s.x))), ','))"
    )


def _pure(cells: str, seed: int) -> str:
    fits = f"array_distinct(filter({cells}, s -> abs(s.c) = 1 and hash(s.k) = s.x))"
    return f"transform({fits}, g -> named_struct('c', g.c, 'k', g.k, 'x', g.x, 'm', {_mask('g.k', seed)}))"


def peeled(df: DataFrame, seed: int) -> DataFrame:
    """Adds ``only_left``, ``only_right`` (recovered digests) and ``ok`` to rows of arrays ``left`` and ``right``.

    Each round that finds something empties a cell at least, so ``CELLS`` rounds suffice.
    """
    df = df.withColumn("cells", F.expr(cells_sql("left", seed, "right")))
    none = "cast(array() as array<struct<c:int,k:bigint,x:int,m:bigint>>)"
    taken = (
        "transform(st.cells, (cell, i) -> aggregate(st.pure, cell, (s, g) -> "
        "if(getbit(g.m, i) = 1, named_struct('c', s.c - g.c, 'k', s.k ^ g.k, 'x', s.x ^ g.x), s)))"
    )
    step = (  # the array of one element binds the new cells, so that they are computed once
        f"transform(array({taken}), n -> named_struct('cells', n, 'pure', {_pure('n', seed)}, 'found', concat(st.found, st.pure)))[0]"
    )
    start = f"named_struct('cells', cells, 'pure', {_pure('cells', seed)}, 'found', {none})"
    df = df.withColumn("peel", F.expr(f"aggregate(sequence(1, {CELLS}), {start}, (st, r) -> if(size(st.pure) = 0, st, {step}))"))
    return df.select(
        *[c for c in df.columns if c not in ("cells", "peel")],
        F.expr("transform(filter(peel.found, g -> g.c = 1), g -> g.k)").alias("only_left"),
        F.expr("transform(filter(peel.found, g -> g.c = -1), g -> g.k)").alias("only_right"),
        F.expr("forall(peel.cells, s -> s.c = 0 and s.k = 0 and s.x = 0)").alias("ok"),
    )


def _dealt(rows: DataFrame, key: list[str]) -> DataFrame:
    """Digest rows with their sketch's number to one row per sketch: bounded arrays ``left`` and ``right``."""
    side = lambda s: F.collect_list(F.when(F.col("side") == s, F.col("d")))
    return rows.groupBy(*key, "part").agg(side(0).alias("left"), side(1).alias("right"))


def recovered(pairs: DataFrame, key: list[str]) -> DataFrame:
    """Differing digests of each pair of digest sets, by sketch: rows ``key, only_left, only_right``, one or more of a pair.

    ``pairs`` has unique, non-null ``key`` columns and arrays ``left``, ``right`` of distinct digests. It is
    read more than once.
    """
    first = staged(peeled(pairs, 0).select(*key, "only_left", "only_right", "ok"), "iblt-0")
    done = [first.where("ok")]
    failed = first.where("not ok").select(*key)
    parts = f"cast(greatest(2, ceil((size(left) + size(right)) / {PER_SKETCH})) as bigint)"
    rows = pairs.join(failed, key, "left_semi").select(*key, F.expr(parts).alias("parts"), "left", "right")
    rows = rows.select(*key, "parts", F.explode(F.expr("array(named_struct('side', 0, 'ds', left), named_struct('side', 1, 'ds', right))")).alias("s"))
    rows = rows.select(*key, "parts", F.col("s.side").alias("side"), F.explode("s.ds").alias("d"))
    rows = rows.select(*key, "side", "d", F.expr("pmod(shiftrightunsigned(xxhash64(d, 1), 24), parts)").alias("part"))
    seed = 1
    while not failed.isEmpty():
        tried = peeled(_dealt(rows, key), seed)
        # digests stay with failed sketches only, as recovered ones do with others
        kept = [F.when(F.col("ok") == (c[:4] == "only"), F.col(c)).alias(c) for c in ("only_left", "only_right", "left", "right")]
        tried = staged(tried.select(*key, "part", "ok", *kept), f"iblt-{seed}")
        done.append(tried.where("ok").select(*key, "only_left", "only_right", "ok"))
        failed = tried.where("not ok")
        seed += 1
        again = F.explode(F.expr("array(named_struct('side', 0, 'ds', left), named_struct('side', 1, 'ds', right))"))
        rows = failed.select(*key, "part", again.alias("s")).select(*key, "part", F.col("s.side").alias("side"), F.explode("s.ds").alias("d"))
        rows = rows.withColumn("part", F.expr(f"part * 4 + pmod(shiftrightunsigned(xxhash64(d, {seed}), 24), 4)"))
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    return every.drop("ok")


def differences(pairs: DataFrame, key: list[str]) -> DataFrame:
    """``recovered`` with one row per pair."""
    joined = lambda c: F.flatten(F.collect_list(c)).alias(c)
    return recovered(pairs, key).groupBy(*key).agg(joined("only_left"), joined("only_right"))


def following(ids: DataFrame) -> DataFrame:
    """``ids`` (distinct ``id, h`` and more) with ``next_id, next_h`` of the next in order, the first after the last.

    Windows hold runs of 2^10 ids; what comes after a run is found among runs, then among runs
    of runs, so the last window has one row per 2^20 ids.
    """
    me = F.struct("id", "h")
    lead = lambda c, part, order: F.lead(c).over(Window.partitionBy(part).orderBy(*order))
    rows = ids.withColumn("b1", F.shiftright("id", 10)).withColumn("in_run", lead(me, "b1", ["id", "h"]))
    runs = ids.groupBy(F.shiftright("id", 10).alias("b1")).agg(F.min(me).alias("first")).withColumn("b2", F.shiftright("b1", 10))
    whole = Window.partitionBy(F.lit(0)).orderBy("b2")
    tops = runs.groupBy("b2").agg(F.min("first").alias("top"))
    tops = tops.select("b2", F.coalesce(F.lead("top").over(whole), F.first("top").over(whole)).alias("after_top"))
    runs = runs.withColumn("after_run", lead("first", "b2", ["b1"])).join(tops, "b2")
    runs = runs.select("b1", F.coalesce("after_run", "after_top").alias("after"))
    rows = rows.join(runs, "b1").withColumn("next", F.coalesce("in_run", "after"))
    return rows.select(*ids.columns, F.col("next.id").alias("next_id"), F.col("next.h").alias("next_h"))


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per input row; see the module. Columns as in ``query``, and the counts of differing paragraphs."""
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_FIRST)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).isNull().alias("no_id"))
    own = own.withColumn("h", F.xxhash64("text", "no_id"))
    ids = own.groupBy("id", "h").agg(F.first("no_id").alias("no_id"), F.first(F.length("text")).alias("n_chars"), F.count(F.lit(1)).alias("copies"))
    order = staged(following(staged(ids, "print-ids")), "print-order")
    texts = own.select("id", "h", "text")
    wanted = order.select(F.col("id").alias("for_id"), F.col("h").alias("for_h"), (F.col("n_chars") / 4).cast("int").alias("q"), F.col("next_id").alias("id"), F.col("next_h").alias("h"))
    heads = texts.join(wanted, ["id", "h"]).select(F.col("for_id").alias("id"), F.col("for_h").alias("h"), "q", F.expr("substring(text, 1, q)").alias("head"))
    heads = heads.groupBy("id", "h").agg(F.first("q").alias("q"), F.first("head").alias("head"))
    both = texts.join(heads, ["id", "h"]).groupBy("id", "h").agg(F.first("text").alias("text"), F.first("q").alias("q"), F.first("head").alias("head"))
    both = both.select("id", "h", "text", F.expr("concat(substring(text, 1, length(text) - q), head)").alias("edited"))
    sets = both.select("id", "h", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), digests_of(F.col("text")).alias("own"), digests_of(F.col("edited")).alias("edit"))
    sets = staged(sets, "print-sets")
    nexts = sets.select(F.col("id").alias("next_id"), F.col("h").alias("next_h"), F.col("own").alias("next"))
    trio = sets.join(order.select("id", "h", "next_id", "next_h"), ["id", "h"]).join(nexts, ["next_id", "next_h"])
    sides = F.explode(F.expr("array(named_struct('kind', 0, 'right', edit), named_struct('kind', 1, 'right', next))")).alias("p")
    pairs = trio.select("id", "h", F.col("own").alias("left"), sides).select("id", "h", F.col("p.kind").alias("kind"), "left", F.col("p.right").alias("right"))
    found = recovered(pairs, ["id", "h", "kind"])
    count = lambda k, side: F.expr(f"cast(sum(if(kind = {k}, size({side}), 0)) as int)")
    near = found.groupBy("id", "h").agg(*[count(k, side).alias(f"{k}_{name}") for k in (0, 1) for side, name in (("only_left", "gone"), ("only_right", "come"))])
    rows = sets.join(near, ["id", "h"]).join(order, ["id", "h"])
    likeness = "if(size(own) + `{k}_come` = 0, 1D, (size(own) - `{k}_gone`) / cast(size(own) + `{k}_come` as double))"
    rows = rows.withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
    return rows.select(
        F.when(~F.col("no_id"), F.col("id")).alias("doc_id"),
        F.col("n_chars").cast("long").alias("n_chars"),
        "edited_sha256",
        F.expr(fingerprint_sql("own")).alias("fingerprint"),
        F.expr(fingerprint_sql("edit")).alias("edited_fingerprint"),
        F.expr(likeness.format(k=0)).alias("near_edited"),
        F.expr(likeness.format(k=1)).alias("near_next"),
        F.col("0_gone").alias("edited_removed"),
        F.col("0_come").alias("edited_added"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op4: fingerprints of every document and its edited text, and their likeness."""
    return fingerprints(table(spark, sf_dir, "documents"))
