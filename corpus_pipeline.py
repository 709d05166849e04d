"""A training corpus from raw documents, in five stages; each takes what the one before kept.

Toxic documents go, one document of each near-duplicate group stays, documents that hold benchmark items go, secrets are
blotted out, and the last stage mixes the sources to their target weights.

Defined results: null and empty texts hold nothing that a stage looks for and count no words, so they are kept until the
mix, which takes no copy of them; rows without doc_id are kept by the near-duplicate stage, of rows that share a doc_id it
keeps the one with the least text; an empty table gives no rows. All columns of the documents pass through the first four
stages unchanged, but for the redacted text and its n_chars; the mix adds its own and replaces columns of those names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docquery.llm import decontam, jaccard_join, mixing, secret_scan, toxicity
from docquery.llm.tables import Scratch, table

STAGES = [
    ("toxicity", toxicity.stage),
    ("jaccard_join", jaccard_join.stage),
    ("decontamination", decontam.stage),
    ("secret_scan", secret_scan.stage),
    ("mixing", mixing.stage),
]

#: Trained models and alignments aren't expressible in SQL; tests/llm holds each stage against a plain version on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
