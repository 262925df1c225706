"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_state_root, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole Parquet table ``name`` of ``sf_dir``; Python workers can import this package afterwards."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def staged(df: DataFrame, kind: str) -> DataFrame:
    """``df`` written to the shared state folder and read back: a lineage cut that outlives executors."""
    spark = df.sparkSession
    path = f"{ensure_state_root(spark)}/llm/{kind}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text modulo ``folds`` (null ids count as the text '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def per_text(text: Column, fn: Callable[[str], tuple], schema: str, init: Callable[[], object] | None = None) -> Column:
    """Struct column: ``fn`` of each whole text (null counts as empty), run in Arrow batches.

    With ``init``, its result is made once in each task and passed as the second argument.
    """

    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    names = kind.fieldNames()

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        extra = (init(),) if init else ()
        for s in batches:
            rows = [fn(t if t is not None else "", *extra) for t in s]
            yield pd.DataFrame(rows, columns=names)

    return run(text)


def hashed_sample(df: DataFrame, rows: int, key: str = "doc_id") -> DataFrame:
    """At most ``rows`` rows of ``df``: those of the ``rows`` keys that come first by hash.

    The keys are picked on the key column alone; of a repeated key one row stays. The picked
    keys are ``rows`` longs at most, so the join broadcasts them.
    """
    keys = df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(F.xxhash64(key), key).limit(rows)
    return df.join(F.broadcast(keys), key, "left_semi").dropDuplicates([key])


BROADCAST_BYTES = 32 << 20  # proven size up to which a side is broadcast


def small_or_plain(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows of at most ``row_bytes`` fit ``BROADCAST_BYTES``, else as it is.

    ``df`` should be staged: it is counted here.
    """
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df.hint("shuffle_merge")


def without_ids(docs: DataFrame, ids: DataFrame, kind: str) -> DataFrame:
    """Rows of ``docs`` whose doc_id is not in ``ids`` (one column, doc_id); rows with a null id stay."""
    gone = staged(ids.where(F.col("doc_id").isNotNull()).distinct(), kind)
    return docs.join(small_or_plain(gone, 16), "doc_id", "left_anti").select(*docs.columns)
