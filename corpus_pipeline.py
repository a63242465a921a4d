"""The corpus pipeline: stages that each take all documents that the one before has kept.

Toxic documents go, one document of each group of near duplicates stays, secrets are masked, sources are mixed to
their target weights (documents are left out or repeated), and what is left is packed into sequences. All but
the last return the columns of documents.

Results: rows of null id take part in every stage; null and empty texts are neither toxic nor near duplicates nor secret,
and the mix leaves them out, as they have no words; repeated rows are near duplicates of each other if they have words; an
empty table gives an empty table; columns, of any name, stay as they are up to the last stage. Without labels nothing is
toxic. Each stage's result is written to the shared folder and read again, so that a lost executor costs no earlier stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgrid.llm import mixing, ngram_join, packing, secret_scan, toxicity
from quillgrid.llm.common import discard, stored, table, tokenizer_path, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine, trained on those of them that are labelled, doesn't reject."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates."""
    return ngram_join.drop_near_duplicates(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked."""
    return secret_scan.redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences that all documents are packed into."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack),
]
#: No SQL: a trained machine and draws by hash stand in the way; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents, each written and read again. What a stage has stored on its way goes when its result is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        before = written(spark)
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
            discard(spark, [f for f in written(spark)[:-1] if f == last or f not in before])
            last = written(spark)[-1]
    return docs
