"""A corpus pipeline: quality, line dedup, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
reread as the next stage's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edictum.llm import jaccard, line_templates, mixing, packing, queries, rule_ensemble
from edictum.llm.workspace import OWN, apart, materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go. Null texts are scored as empty ones; rows are kept or not by themselves, other columns stay as they are."""
    model = rule_ensemble.train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    scored = rule_ensemble.score_documents(apart(docs).select(OWN, F.col(f"{OWN}.text")), model)
    return scored.filter(F.col("score") >= queries.QUALITY).select(f"{OWN}.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go but in their first place; documents stay, if empty, and n_chars follows the text."""
    out = line_templates.dedup_lines(apart(docs).select(OWN, F.col(f"{OWN}.doc_id"), F.col(f"{OWN}.text")))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)}
    return out.select(*(new.get(c, F.col(f"{OWN}.`{c}`")).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, that of least doc_id.

    SimHash classes of 5-word shingles, widened so that no pair at a similarity of 0.8 or more is lost; each link is checked.
    """
    return jaccard.keep_one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those without words, with null texts too, go."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in packed sequences."""
    return packing.pack_documents(docs, queries._vocabulary("word_bpe_49k.json"), end_id=1, capacity=2048)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mix", mix), ("pack", pack)]

#: SQL can express neither the classifier nor the tokenizer: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
