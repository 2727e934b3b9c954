"""The queries of this subpackage, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe, centroids, chroma, dac, decontaminate, imi, language, licences, mixing, neardup, pii, quality, runs
from weftline.llm.common import documents, written


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the tables hold no audio: the UTF-8 bytes of each text are taken as its recording, 8-bit PCM
    media = documents(spark, sf_dir).select("doc_id", F.col("text").cast("binary").alias("media"))
    return chroma.report(media, F.col("doc_id") % 100 == 0, frames=chroma.SHORT)


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(documents(spark, sf_dir))


def op3_dac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.round_trip(documents(spark, sf_dir), tokenizer_path())


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(documents(spark, sf_dir))


def op5_imi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imi.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), tokenizer_path())


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # whole documents are repeated, shuffled and written; the result lists that table by the columns of mix_sql()
    mixed = written(mixing.mix(documents(spark, sf_dir)), "mixed")
    listed = mixed.select("doc_id", "source", F.round("mix_rate", 9).alias("mix_rate"), "mix_copy", "mix_key")
    return listed.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "mix_key").sortWithinPartitions("mix_key")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(spark, sf_dir))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.report(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chroma": op1_chroma,
        "op2_licences": op2_licences,
        "op3_dac": op3_dac,
        "op4_neardup": op4_neardup,
        "op5_imi": op5_imi,
        "op6_quality": op6_quality,
        "op7_bpe": op7_bpe,
        "op8_language": op8_language,
        "op9_mixing": op9_mixing,
        "op10_pii": op10_pii,
        "op11_centroids": op11_centroids,
        "op12_decontaminate": op12_decontaminate,
        "op13_runs": op13_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_licences": licences.scan_sql(),
        "op9_mixing": mixing.mix_sql(),
        "op11_centroids": centroids.report_sql(),
        "op12_decontaminate": decontaminate.report_sql(),
    }
