"""A corpus, cleaned for training: quality, toxicity, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents. A document that an earlier stage rejected isn't
seen by a later one. Nulls and empty texts pass the filters as any document does, by their scores; a null text stays
null until it is redacted, where it becomes empty. Texts are whole at any length. Ties and repeated rows are scored
alike, and the near-duplicate stage keeps one row of them; rows without words it keeps all. Empty tables give no rows
in every stage. Columns of documents other than COLUMNS are dropped by the first stage, so no name can clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelake.llm import ngram_join, packing, pii, quality, toxicity
from wavelake.llm.common import store
from wavelake.llm.queries import table, tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores at 0.3 or more; the decision is a column of the same scan, without a join."""
    scored = quality.classify(docs, table(spark, sf_dir, "labels"), threshold=0.3, extra=("text", "lang", "source", "n_chars"))
    return scored.where("predicted = 1").select(*COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 for toxicity."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, ("lang", "source", "n_chars")).where("score < 0.5").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.8 or more: that of the smallest id.

    Decided row by row: where an id repeats, or is null, each row stays or goes by its own text.
    """
    return ngram_join.distinct_rows(docs, words=5, percent=80).select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; n_chars is that of the new text."""
    done = pii.redact(docs, ("lang", "source"))
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096 ids: where each piece of each document lies."""
    return packing.best_fit(docs, tokenizer("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: No stage's decisions are expressible in SQL (fitted models, hashed joins, packing); tests/llm/test_plain_versions.py holds each stage and run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
