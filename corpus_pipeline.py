"""Corpus pipeline: stages over ``documents``, each the operator of one step.

Every stage is a function ``(spark, docs, sf_dir) -> DataFrame``; its output is written as
Parquet and reread as the next stage's ``docs``.
"""

from __future__ import annotations

from wavecrawl.llm import decontaminate, jaccard_join, packing, secrets, toxicity
from wavecrawl.llm.common import staged, table

STAGES: list = [
    ("toxicity", toxicity.stage),
    ("ngram_jaccard_join", jaccard_join.stage),
    ("benchmark_decontamination", decontaminate.stage),
    ("secret_scans", secrets.stage),
    ("best_fit_packing", packing.stage),
]

ORACLE_SQL = None  # learned scores and tokenizers have no SQL form; tests hold the stages against brute force


def run(spark, sf_dir: str):
    """The last stage's rows for the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{name}")
    return docs
