"""The corpus pipeline: documents in, training sequences out, one operator of isoloom.llm a stage.

toxicity      documents scored as toxic go (threshold of the operator)
quality       documents that the weighed rules reject go
near_copies   of each group of documents linked by word 5-grams at 0.8 the smallest doc_id stays
substrings    repeated strings of 100 bytes are cut out of the texts
packing       what is left is packed into sequences

Every stage but the last returns the columns of documents. Rows are judged each on its own, without a
join, but for near copies: there doc_id names a text, of rows that repeat one stays, and a row with a
null doc_id stays as nobody's copy. A text that is cut keeps only whole characters, and n_chars tells
its new length.
"""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoloom.llm import ngram_join, packing, quality, suffix_dedup, toxicity
from isoloom.runtime import discard, prepare, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Scores every document in the pass that filters it: nothing is joined."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score(docs, toxicity.train(docs, labels), keep=("doc_id", "lang", "source", "n_chars", "text"))
    return scored.where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.judged(docs, keep=COLUMNS).where("kept").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    first = ngram_join.joined(docs, n=5, num=80, den=100).where("doc_id = component_id").select("doc_id")
    return docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"]).unionByName(docs.where("doc_id IS NULL"))


def cut_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    cut = suffix_dedup.repeats(docs.select(*COLUMNS), extra=("lang", "source"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [suffix_dedup.without(t.as_py(), m.values) for t, m in zip(batch.column("b"), batch.column("marks"), strict=True)]
            out = [t.decode(errors="ignore") for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string()), batch.column("lang"), batch.column("source"), pa.array([len(t) for t in out], pa.int64())], names=list(COLUMNS))

    return cut.select("doc_id", "lang", "source", F.col("text").cast("binary").alias("b"), "marks").mapInArrow(run, "doc_id long, text string, lang string, source string, n_chars long")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("quality", keep_quality), ("near_copies", drop_near_copies), ("substrings", cut_substrings), ("packing", pack)]
#: Scores of a trained model and tokens are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each written and read again but the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
