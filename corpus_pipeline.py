"""The corpus pipeline: stages over documents, each an operator of paperloom.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns of
documents, extra ones and clashing names included.

Defined cases. Null and empty texts: they have the score of no evidence, which keeps them
where label 1 prevails; near-dedup keeps one of each doc_id, decontamination all; in the
mix they have size 0 and go with their block; they get shards like any row. Rows with a
null doc_id stay in all stages. A row that is repeated is kept once by near-dedup; rows of
one doc_id with different texts are judged by their texts. Null sources mix as a source of
their own. An empty documents table gives an empty result at every stage; without labels
nothing is rejected, without benchmark items nothing is contaminated. Very long texts are
read whole by every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm.compression_quality import fit, score_quality
from paperloom.llm.hyperminhash import near_duplicates
from paperloom.llm.positional_index import decontaminate
from paperloom.llm.ring_sharding import ring_shard
from paperloom.llm.source_mixing import mix_sources
from paperloom.llm.store import drop_path, quoted, scratch
from paperloom.session import table


#: Jaccard index of five-word shingles from which the near-dedup stage links (op6's own contract is 0.85).
NEAR = 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).where("predicted = 1").select(*map(quoted, docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the least doc_id."""
    return near_duplicates(docs, threshold=NEAR).select(*map(quoted, docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).where("NOT contaminated").select(*map(quoted, docs.columns))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as shards of the mix draw it, written in the mix's shuffled order."""
    return mix_sources(docs).select(*map(quoted, docs.columns))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the mix with their shards and slots; a document's copies go to places of their own."""
    return ring_shard(docs, apart=True)


STAGES = [
    ("quality classifier", quality),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: SQL expresses none of the first two stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each result written to the shared folder and read again.

    A stage's table is deleted once the next stage is written; the last one stays for the result.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = scratch(spark, f"stage-{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                drop_path(spark, before)
            before = path
    return docs
