"""The corpus pipeline: quality, near duplicates, decontamination, mixing and token output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; every one but the last returns the
columns of its documents. ``run`` writes each stage's rows as Parquet to the shared folder and
gives them to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithofig.llm.decontaminate import leak_verdict
from lithofig.llm.jaccard_join import BROADCAST_IDS, jaccard_join
from lithofig.llm.mixing import copies_of
from lithofig.llm.quality_crf import THRESHOLD, fit_line_field, quality_score
from lithofig.llm.shared import materialize
from lithofig.llm.token_records import token_records

END_ID = 1


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field predicts to be good. It is fitted on all labels at hand.

    Null and empty texts are judged by the share of good documents; without a usable label all
    stay. Repeated rows fare alike; an empty table stays empty; extra columns pass through,
    whatever their names.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    field = fit_line_field(docs, labels)
    return docs.where(quality_score(F.col("text"), field, spark) >= THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that the Jaccard join links: the one with the least id.

    Rows without an id come last in their group. Of rows that repeat an id one stays, as of rows
    that are equal; texts without words are alone. An empty table stays empty; extra columns pass
    through.
    """
    keyed = materialize(docs.withColumn("__row", F.monotonically_increasing_id()))
    groups = jaccard_join(keyed, id_col="__row").select(F.col("doc_id").alias("__row"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "__row")).alias("kept")
    named = materialize(keyed.select("doc_id", "__row").join(groups, "__row"))
    least = named.groupBy("component_id").agg(first).select("kept.*")
    kept = materialize(least.groupBy("doc_id", F.when(F.col("nameless"), F.col("__row"))).agg(F.min("__row").alias("__row")).select("__row"))
    # those that go are fewer as a rule, and are sent to the documents while they are few
    gone = materialize(named.select("__row").join(kept, "__row", "left_anti"))
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return keyed.join(gone, "__row", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a leaked benchmark item.

    Null and empty texts leak nothing and stay; repeated rows fare alike; without an item, or
    without documents, nothing goes. Extra columns pass through, whatever their names.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return docs.where(F.size(leak_verdict(F.col("text"), docs, benchmark)["items"]) == 0)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it.

    Repeated rows, and rows without an id, are taken each for itself; null and empty texts have
    no words and are taken with their epoch. An empty table stays empty; extra columns pass through.
    """
    taken = copies_of(docs).where("__copies > 0")
    return taken.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))).alias("__copy")).drop("__copy")


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token records of the mix, as they are read back.

    A null text is an empty one; repeated rows are each written; an empty table gives no record.
    """
    import public_tokenizers

    return token_records(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID, at_once=1 << 20, cached=80_000)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("token-ID output", token_output),
]

#: The field, the retrieval and the vocabulary are beyond SQL. Tests hold the stages after the first against plain versions, each on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
