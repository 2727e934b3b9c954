"""From raw documents to tokens: language, near duplicates, personal data, mixing, BPE.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which :func:`run` writes as Parquet and reads again for the
next stage.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe, language, mixing, neardup, pii
from weftline.llm.common import documents, fresh, shared_folder, written
from weftline.llm.queries import tokenizer_path


#: Rows of an Arrow batch: whole documents are long, and a task holds a few batches at a time.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Batches of at most BATCH_ROWS rows from here on, unless the session asks for fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))  # 0 and less: no bound
    spark.conf.set(key, str(min(BATCH_ROWS, now) if now > 0 else BATCH_ROWS))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; texts without letters, and null texts, go.

    The language column becomes the prediction; where nothing can be learned, it stays as it is.
    """
    small_batches(spark)
    profiles = language.fit(docs)
    learned = any(profiles.values())
    (into,) = fresh(docs, "lang_pred")
    # predictions stay with their rows: no join by an id that may repeat; any profile tells texts with letters
    found = language.predict_rows(docs, profiles if learned else {"any": [0]}, into=into).where(F.col(into) != "und")
    return (found.withColumn("lang", F.col(into)) if learned else found).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of copies and near copies."""
    small_batches(spark)
    return neardup.deduplicated(docs)


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by a mask, and ``n_chars`` counted anew."""
    return pii.redact(docs).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their Poisson draws say, sources in proportion to the root of their size, in hashed order."""
    return mixing.mix(docs).select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each row, their number, and digests of the ids and of their decoding."""
    small_batches(spark)
    return bpe.digests(docs, tokenizer_path(), with_ids=True)


STAGES = [
    ("language", keep_known_languages),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", remove_personal_data),
    ("mixing", mix_sources),
    ("tokens", encode_tokens),
]

#: Rank-order profiles, signatures and BPE are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    base, docs = shared_folder(spark), documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name, base)
    return docs
