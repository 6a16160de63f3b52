"""A training-data pipeline over ``documents``: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import numbered_rows, quoted, shared_dir, table
from quarry.llm.decontaminate import leaks
from quarry.llm.mixing import mix
from quarry.llm.simhash import first_of_groups
from quarry.llm.tokens import token_output
from quarry.llm.toxicity import score_toxicity

#: Near duplicates: sets of five-word shingles of this Jaccard similarity or more.
SHINGLE, SIMILARITY = 5, 0.8


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic; each row is judged by its own text, whatever its id."""
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    carried = [f"_own{k}" for k in range(len(docs.columns))]
    both = docs.select("doc_id", "text", *(F.col(quoted(c)).alias(n) for c, n in zip(docs.columns, carried)))
    scored = score_toxicity(both, table(spark, sf_dir, "labels"), ~held, carry=tuple(carried))
    return scored.where("predicted = 0").select(*(F.col(n).alias(c) for c, n in zip(docs.columns, carried)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, null ids last, then the first in the files."""
    rows = numbered_rows(docs)
    kept = first_of_groups(rows.select("row", "own.doc_id", "own.text"), SHINGLE, SIMILARITY)
    # a hash of the row numbers: a merge would sort the whole rows, texts and all
    return rows.join(kept.hint("shuffle_hash"), "row", "left_semi").select("own.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover less than half the tokens of every benchmark item; each row goes by its own text, whatever its id."""
    rows = numbered_rows(docs)
    found = leaks(rows.select(F.col("row").alias("doc_id"), "own.text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("row")).distinct()
    return rows.join(found, "row", "left_anti").select("own.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the interleaved sources; the files' order is the order of the rows. A null source is one of its own, null and repeated ids keep their rows; no rows give none."""
    own, parts = docs.columns, int(spark.conf.get("spark.sql.shuffle.partitions"))
    return mix(docs).repartitionByRange(parts, "mix_slot", "mix_rank").sortWithinPartitions("mix_slot", "mix_rank").select(*map(quoted, own))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of all documents in the order of the files and rows of ``docs``; a digest of each document. A null text has the end id only; null and repeated ids keep their rows; no rows write no shard."""
    import public_tokenizers

    own = numbered_rows(docs).select("row", "own.doc_id", "own.text")
    return token_output(own, public_tokenizers.path("word_bpe_49k.json"), order=F.col("row"))


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", mixing),
    ("token_output", token_ids),
]

#: Fitted models, fingerprints and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: each is written as Parquet in the shared folder and read again. Columns besides doc_id, text and source are carried, whatever their names; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
