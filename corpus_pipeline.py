"""The corpus pipeline: toxicity, near-duplicates, benchmark leaks, personal data, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitkit.llm import decontam, pii, simhash, toxicity
from fitkit.llm import piece_lattice as lattice
from fitkit.llm.common import Scratch, table
from fitkit.llm.queries import model_file


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: near fingerprints, or five-word shingles alike by 0.8."""
    return simhash.keep_first(docs, similar=0.8)


def leaks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def persons_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms of the same format."""
    return pii.without_pii(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether decoding gives its text again."""
    codec = lattice.Codec.fit(docs, model_file())
    rows = codec.encode(docs.select("doc_id", "text"), packed=True, verify=True)
    return rows.select(
        "doc_id",
        "ids",
        F.when(F.col("ids").isNotNull(), F.octet_length("ids") / codec.item_bytes).cast("long").alias("n_tokens"),
        "restored",
    )


STAGES = [
    ("toxicity", toxic_out),
    ("near-duplicates", copies_out),
    ("decontamination", leaks_out),
    ("pii", persons_out),
    ("sentencepiece", tokens),
]

#: The stages learn models, hash by XXH64 and run keyed permutations: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; tables between them lie in the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if k == len(STAGES) - 1 else scratch.keep(out)
    return docs
