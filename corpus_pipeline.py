"""A corpus pipeline of five stages, each a Spark job on all that the one before kept.

quality classifier -> n-gram Jaccard join -> benchmark decontamination -> mixing -> token-ID output. Every stage takes
(spark, docs, sf_dir) and returns a DataFrame with the columns of ``documents``; the last returns, for each document of
the mix, its place in the token files. ``run`` writes each stage's result to the shared folder and reads it again.

Null texts and empty ones: the classifier judges them like any other; they are nobody's near-duplicate and can't be
contaminated; the mix takes no words from them, so they end there. Texts of any length are taken whole. Rows without a doc_id
stay until the mix takes them or not; of repeated rows the near-duplicates stage keeps one. An empty table passes through as
such. Further columns pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontam, jaccard, mixing, quality, tokens
from tessella.llm.columns import Through
from tessella.session import load, materialize, reach

#: Words a shingle and least similarity of near-duplicates, as num / den.
SHINGLE, NUM, DEN = 5, 80, 100


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    reach(spark)
    return quality.keep_good(docs, load(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id; of repeated rows one; rows without a doc_id stay."""
    reach(spark)
    through = Through(docs, "doc_id", "text")
    return through.back(_one_of_each(through.rows))


def _one_of_each(docs: DataFrame) -> DataFrame:
    groups = materialize(jaccard.jaccard_components(docs, SHINGLE, NUM, DEN), "pipeline-groups")
    gone = materialize(groups.where("component_id <> doc_id").select("doc_id").distinct(), "pipeline-gone")
    few = gone.count() <= jaccard.MOST_BROADCAST_IDS
    kept = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)
    again = groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return kept
    repeated = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns)
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(repeated)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    reach(spark)
    return decontam.contamination(docs, load(spark, sf_dir, "benchmark"), clean_only=True)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a document appears once for each epoch that takes words of it, with those words."""
    reach(spark)
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document of the mix, read from the files."""
    return tokens.tokenize(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("token_output", write_tokens),
]

#: SQL can express neither the classifier nor the tokenizer; tests compare the stages with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
