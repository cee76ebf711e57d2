"""The corpus pipeline: each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spokewise.llm import decontaminate, line_dedup, near_dedup, piece_codec, toxicity
from spokewise.llm.common import tokenizer_path
from spokewise.llm.queries import is_held_out, table
from spokewise.storage import discard, names, stash


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go; the model is fitted to labels that aren't held out."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), is_held_out()))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines shared with earlier documents go, and documents of nothing else."""
    return line_dedup.drop_common_lines(docs, counts=False, keep_emptied=False)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates stays."""
    return near_dedup.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark window stands go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, and the text they decode to: ``doc_id, ids, decoded``."""
    return piece_codec.encode(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_common_lines),
    ("near dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("piece encoding", encode_pieces),
]

#: A kernel machine and alignments aren't SQL; tests/llm/test_pipeline.py holds run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; each one's rows are written before the next reads them, and then the
    steps that led to them are removed."""
    since = names(spark)
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = stash(docs, f"stage{n}")
            discard(spark, since, keep=docs)
    return docs
