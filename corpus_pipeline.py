"""Documents to training tokens: quality, toxicity, near-duplicates, mixing, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept.  All but the
last return the columns of documents, whatever else they are named; the last one returns a row of
token ids for each row.  Every stage gives an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe, mixing, quality, simhash, toxicity
from millrace.llm.common import Shared, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay if their counts pass and the CRF finds them to be mostly content.

    Null, empty and wordless texts go.  Repeated rows stay or go together.  Without labels every line
    counts as content.
    """
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay if they score below the threshold.

    Null and empty texts stay.  Repeated rows stay or go together.  Without labels of both classes all stay.
    """
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays: 5-word shingles, Jaccard similarity of 0.8 or more.

    It is the one with the smallest id; rows without an id go before any that has one.  Of repeated rows
    one stays.  Null and wordless texts are one component, texts of fewer than five words one shingle.
    """
    return simhash.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents appear as often as the mix takes them, up to twice.

    Null is a source of its own, the last one.  Texts without words add nothing and appear as often as
    their source's share says in whole.  Repeated rows share what they get together.
    """
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every row, and digests of them and of the text that they decode to.

    Null and empty texts have no tokens.  Repeated rows give a row each; other columns are left out.
    """
    return bpe.round_trip(docs, bpe.tokenizer_path(), ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", drop_toxic),
    ("near_duplicates", near_duplicates),
    ("mixing", mix_sources),
    ("bpe", tokens),
]

#: SQL can't express the learned stages; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read again."""
    shared = Shared.create(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = shared.table(docs, f"{k}-{name}")
            if k:
                shared.remove(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
