"""A corpus from raw documents to tokens, in five stages.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor
kept; its result is written as Parquet and read again before the next one.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spiketide.llm import bpe, decontam, jaccard, ranking, secrets
from spiketide.llm.frames import load
from spiketide.session import stage

KEY = "_pipeline_key"
TOKENS = "byte_bpe_multi_50k.tiktoken"


def _own(*cols: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*cols), 1) * -1 - 1


def _keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """Adds a key that is never null and has one text: the id, or a negative number.

    That follows from the text where there is no id, and from id and text where an
    id has different texts; the second value says whether there are such ids.
    """
    keyed = docs.withColumn(KEY, F.coalesce(F.col("doc_id").cast("long"), _own("text")))
    hashes = keyed.select(KEY, F.xxhash64("text").alias("h")).groupBy(KEY).agg(F.min("h").alias("low"), F.max("h").alias("high"))
    mixed = stage(hashes.filter("low <> high").select(F.col(KEY).alias("doc")))
    if mixed.isEmpty():
        return keyed, False
    maybe = jaccard.only(keyed, mixed, KEY).join(mixed.select(F.col("doc").alias(KEY), F.lit(True).alias("_mixed")), KEY, "left")
    own = maybe.withColumn(KEY, F.when(F.col("_mixed"), _own(KEY, "text")).otherwise(F.col(KEY))).select(*keyed.columns)
    return jaccard.only(keyed, mixed, KEY, inside=False).unionByName(own), True


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranking accepts; it learns from labels outside its held-out fold."""
    learn = ranking.crc("doc_id") % 5 != 0
    fitted = ranking.fit(docs, load(spark, sf_dir, "labels"), learn)
    rated = ranking.featurise(docs.withColumn("_ranked", F.col("text")), *docs.columns, text_col="_ranked")
    return rated.filter(fitted.score("features") >= ranking.CUT).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies; equal texts of one id are one document."""
    keyed, mixed = _keyed(docs)
    found = stage(jaccard.similar(keyed, KEY).select(KEY, "component_id"))
    if mixed:  # keys of ids with different texts do not follow the order of the ids
        ids = keyed.filter((F.col(KEY) < 0) & F.col("doc_id").isNotNull()).select(KEY, F.col("doc_id").cast("long").alias("_id")).distinct()
        order = found.join(ids, KEY, "left").select("component_id", F.struct(F.coalesce("_id", KEY).alias("at"), F.col(KEY).alias("key")).alias("row"))
        first = order.groupBy("component_id").agg(F.min("row")["key"].alias("_first"))
        found = stage(found.join(first, "component_id").select(KEY, F.col("_first").alias("component_id")))
    copies = found.filter(F.col(KEY) != F.col("component_id")).select(F.col(KEY).alias("doc"))
    repeated = found.groupBy(KEY).agg(F.count("*").alias("n")).filter("n > 1").select(F.col(KEY).alias("doc"))
    repeated = repeated.join(copies, "doc", "left_anti")
    gone = stage(copies.union(repeated).distinct())
    once = stage(repeated)
    kept = jaccard.without(keyed, gone, KEY)
    rows = jaccard.only(keyed, once, KEY).join(once.withColumnRenamed("doc", KEY), KEY, "left_semi")
    first = rows.groupBy(KEY).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return kept.select(*docs.columns).union(first.select(*docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    keyed, _ = _keyed(docs)
    found = decontam.contamination(keyed, load(spark, sf_dir, "benchmark"), KEY)
    leaks = stage(found.filter("size(spans) > 0").select(F.col(KEY).alias("doc")).distinct())
    return jaccard.without(keyed, leaks, KEY).select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark and ``n_chars`` to match."""
    found = secrets.scan(docs, *docs.columns)
    changed = F.size("spans") > 0
    text = secrets.masked(F.col("text"), F.col("spans"))
    masked = found.select(*(c for c in docs.columns if c not in ("text", "n_chars")), changed.alias("_changed"), text.alias("text"), "n_chars")
    n_chars = F.when(F.col("_changed"), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return masked.withColumn("n_chars", n_chars).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids of each document, and digests of them and of what they decode to."""
    ranks = bpe.read_ranks(public_tokenizers.path(TOKENS))
    return bpe.digest(docs, ranks, public_tokenizers.PATTERN, keep_ids=True)


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", mask_secrets),
    ("byte-level BPE", tokens),
]

#: the fitted ranking and the tokenizer are beyond SQL; tests hold run() against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for _, fn in STAGES[:-1]:
        docs = stage(fn(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
