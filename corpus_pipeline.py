"""The corpus pipeline: language ID, near-duplicates, benchmark decontamination, secret masking, packing.

Each stage takes what its predecessor kept and returns the columns of ``documents``; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mlframe.llm import decontamination, language_id, near_dedup, packing, secrets

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the language models reject; learns from the labelled documents that are not held out.

    Null texts, empty ones and those without letters are rejected; repeated rows are judged alike, and null ids do not matter. An empty table stays empty; without any label everything is rejected.
    """
    model = language_id.fit(docs.where(~language_id.held_out()))
    return language_id.keep_identified(docs, model).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of every near-duplicate group (five words, 0.8), and equal rows of it once.

    Null and empty texts are in no group and stay; so do rows without an id. An empty table stays empty.
    """
    return near_dedup.keep_one(docs).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item: 0.8 or more of its distinct five-word runs, or all its words in a row if it has fewer.

    Null texts and rows without an id contain none and stay; repeated rows go or stay together. An empty table, or an empty benchmark, changes nothing.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.contained(docs, items).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; n_chars follows where a text changed. All rows stay; null and empty texts stay as they are."""
    return secrets.mask(docs, secrets.fit_forest(secrets.labelled_findings(spark))).select(*COLUMNS)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 2048 tokens; null and empty texts are one closing token, repeated rows are packed each for itself, an empty table gives no pieces."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), digest=True)


STAGES = [
    ("language ID", identify_language),
    ("near-duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret masking", mask_secrets),
    ("packing", pack_documents),
]

#: No SQL can express the models and the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each one's result written and read again before the next."""
    from mlframe.llm.common import materialize

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
