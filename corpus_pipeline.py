"""The corpus pipeline: documents pass the STAGES in order; each stage's rows are written and read again.

toxicity      documents that the model rejects go; its labels are those of the tables' folder
near copies   of each group of near copies one row stays, one of least id (rows equal in id and text: the one whose
              other columns are least); rows without an id stay, as none of them can be named
passages      passages that repeat are cut but for their first occurrence; documents left empty go
mixing        documents are taken as often as the mix of sources says
encoding      token ids of what is left: token_ids() returns the ids, run() (the query) their number and digests

Every stage but the last returns the columns of documents; n_chars follows the text.  Null and empty texts are
clean documents to the first three stages; the mix takes them as it takes others of their source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, jaccard_join, mixing, suffix_dedup, toxicity
from tidemark.llm.common import SPACES, forget, maybe_in, release, table, written


#: Documents that are sent to Python at a time; the stages share workers with little memory.
BATCH = 1_000


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, name="__score").where(F.col("__score") < 0.5).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    c = jaccard_join.jaccard_components(docs, rows=True)
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    stay = c.where(~alone & (F.col("doc_id") == F.col("component_id"))).groupBy("component_id").agg(F.min("row").alias("row"))
    go = written(c.where(~alone).select("row").distinct().join(stay.select("row"), "row", "left_anti").withColumnRenamed("row", "__row"), "pipeline-copies")
    d = docs.withColumn("__row", suffix_dedup.row_key("doc_id", "text"))
    left = maybe_in(d, "__row", go, "left_anti").union(maybe_in(d, "__row", go).join(go, "__row", "left_anti").select(*d.columns))
    left = left.select(*docs.columns)
    if c.where(~alone).groupBy("row").count().where("count > 1").limit(1).count():  # rows repeated whole
        rest = [x for x in docs.columns if x not in ("doc_id", "text")]
        words = F.length(F.btrim(F.coalesce(F.col("text"), F.lit("")), F.lit(SPACES))) > 0
        once = left.where(words & F.col("doc_id").isNotNull()).groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("__r"))
        left = left.where(~words | F.col("doc_id").isNull()).union(once.select(*[F.col(x) if x in ("doc_id", "text") else F.col(f"__r.{x}").alias(x) for x in docs.columns]))
    return left


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    blank = lambda: F.length(F.btrim(F.coalesce(F.col("text"), F.lit("")), F.lit(SPACES))) == 0
    cut = suffix_dedup.remove_passages(docs.withColumn("__blank", blank()).withColumn("__chars", F.length("text")))
    left = cut.where(F.col("__blank") | ~blank())
    n_chars = F.when(F.length("text") == F.col("__chars"), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return left.withColumn("n_chars", n_chars).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document that is taken twice is two rows."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return bpe.encode(docs, bpe.default_path(), keys=("doc_id",), digest=True)


def encode_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids."""
    _small_batches(spark)
    return bpe.encode(docs, bpe.default_path(), keys=("doc_id",))


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("passages", cut_passages),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: SQL can express neither the classifier nor the encoder.
ORACLE_SQL = None


def _left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that all stages but the last leave."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        if last is not None:
            forget(spark, last)
        last = docs
        release(spark)
    return docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return STAGES[-1][1](spark, _left(spark, sf_dir), sf_dir)


def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training data: doc_id, ids."""
    return encode_ids(spark, _left(spark, sf_dir), sf_dir)
