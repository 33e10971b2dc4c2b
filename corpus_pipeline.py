"""From raw documents to token shards, by five of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs.  All but the last
return the columns of documents.
"""

from __future__ import annotations

from tidewater.llm import decontam, mixing, near_dup, quality, token_shards
from tidewater.llm.shared import materialise, scratch_path, table

#: Tokens and random choices can't be expressed in SQL.  Tests check subsets, columns and offsets only; a brute-force version is still to be written.
ORACLE_SQL = None


def quality_rules(spark, docs, sf_dir):
    """Documents that the current policy rejects go."""
    return quality.keep_good(docs)


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near duplicates stays (five words, a similarity of 0.8)."""
    return near_dup.keep_one(docs, words=5, percent=80)


def decontamination(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark, docs, sf_dir):
    """Documents repeat, or go, as their source's target asks."""
    return mixing.mix(docs)


def token_output(spark, docs, sf_dir):
    """Shards of token ids in the shared folder, and their index."""
    return token_shards.tokenise(docs, scratch_path(spark, "pipeline-shards"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, name)
    return docs
