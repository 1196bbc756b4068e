"""The corpus pipeline: toxicity, near-dedup, substring dedup, decontamination, then token ids.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor
kept. Between stages the documents are written to the shared folder and read
again, so a lost executor costs at most the stage it was in.

Defined cases: those of the stages; further columns, whatever their names, travel
through all stages but the last; rows of one doc_id stay or go together except where
only their toxicity differs; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import bpe, common, decontamination, near_dedup, substring_dedup, toxicity

STAGES = [
    ("toxicity", toxicity.stage),
    ("near_dedup", near_dedup.stage),
    ("substring_dedup", substring_dedup.stage),
    ("decontamination", decontamination.stage),
    ("byte_bpe", bpe.stage),
]
#: Scores of a trained model are beyond SQL; tests hold run() against a brute-force pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        before, docs = docs, common.written(stage(spark, docs, sf_dir), name)
        common.forget(before)
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
