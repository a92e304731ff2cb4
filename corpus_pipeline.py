"""The documents of a corpus, cleaned and encoded, in stages that each write their result.

Every stage takes ``(spark, docs, sf_dir)``. All but the last return the columns of ``documents``;
the last returns what the encoder says of each document that is left.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from runscope.llm import op4_decontaminate, op6_sentencepiece, op8_line_dedup, op9_jaccard_join, op10_toxicity
from runscope.llm.common import read
from runscope.llm.queries import tokenizer_model
from runscope.llm.tables import measured, without, written

#: Similarity in percent, and words of a shingle, of the near-duplicate stage.
NEAR_PERCENT, NEAR_WIDTH = 80, 5
#: What a text without any line holds.
BLANK = " \t\n\x0b\x0c\r"
ROW = "__near_duplicates_row"
#: Bytes of the batches that go to Python and back. Each is held several times over, by every task and its worker.
BATCH_BYTES = "4m"
#: Rows of the batches that Parquet files are read in. Spark's 4096 whole texts need arrays of up to 24 MB on the heap, and the heap that
#: grows for those doesn't shrink until the job's end.
BATCH_ROWS = 128

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_small_batches(stage: Stage) -> Stage:
    """The stage in a session that reads ``BATCH_ROWS`` and sends ``BATCH_BYTES`` to Python at a time.

    It stays so, as rows are read later.
    """

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't score as toxic; the model learns from the labels of two folds of three."""
    return op10_toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


@in_small_batches
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of templates that recur; ``n_chars`` follows the text."""
    out = op8_line_dedup.line_dedup(docs)
    return out.select([F.length("text").cast(kind).alias(c) if c == "n_chars" else f"`{c}`" for c, kind in docs.dtypes])


@in_small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of near-duplicates: wider shingles and less alike than the op9 query's.

    Documents are alike in the text that is left or in that of ``documents``: of copies, line dedup leaves
    little to compare. Those that it left nothing of go; the first of their lines stayed elsewhere.
    """
    row = F.xxhash64("doc_id", "text")
    given = read(spark, sf_dir, "documents").select("doc_id", "text")
    blank = F.trim("text", F.lit(BLANK)) == ""
    known = measured(given.select(row.alias("row")).distinct(), "given-rows")
    changed = written(
        docs.select("doc_id", row.alias("row"), blank.alias("blank")).join(known, "row", "left_anti"), "changed-rows"
    )
    emptied = measured(changed.where("blank").select("row").distinct(), "emptied-rows")
    left = docs.withColumn(ROW, row).join(emptied.withColumnRenamed("row", ROW), ROW, "left_anti").select(docs.columns)
    before = measured(changed.where("doc_id is not null and not blank").select("doc_id").distinct(), "changed-ids")
    texts = left.select("doc_id", "text").unionByName(given.join(before, "doc_id", "left_semi"))
    found = op9_jaccard_join.near_duplicates(texts, NEAR_PERCENT, NEAR_WIDTH)
    return without(left, found.where("component_id <> doc_id").select("doc_id"), "near-duplicates")


@in_small_batches
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't overlap with the benchmark."""
    return op4_decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


@in_small_batches
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digests of the tokens of each document."""
    return op6_sentencepiece.token_digests(docs, tokenizer_model())


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("sentencepiece", encoding),
]

#: A fitted model and the encoder are beyond SQL; a test compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
