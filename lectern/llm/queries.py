"""The queries of the training-data operators, over the whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.license_scan import license_notices

    return license_notices(_table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.token_count import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.decontaminate import benchmark_leaks

    return benchmark_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.toxicity import toxicity_scores

    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.pii import personal_data

    found = personal_data(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.token_files import token_digests, write_token_files

    path = new_path(spark, "token-files")
    write_token_files(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), path, end_id=1)
    return token_digests(spark, path)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.url_filter import url_verdicts

    return url_verdicts(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.packing import pack, piece_digests

    return piece_digests(pack(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), end_id=2))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.quality import quality_verdicts

    return quality_verdicts(_table(spark, sf_dir, "documents"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.sharding import read_shards, shard_digests, write_shuffled

    path = new_path(spark, "shards")
    write_shuffled(_table(spark, sf_dir, "documents"), path)
    return shard_digests(read_shards(spark, path))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.ranked_search import ranked

    return ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.periodic_runs import periodic_runs, planted, run_digests

    return run_digests(periodic_runs(planted(_table(spark, sf_dir, "documents"))))


def _oracle_sql() -> dict[str, str]:
    from lectern.llm import ranked_search, url_filter

    return {"op8_url_filter": url_filter.oracle_sql(), "op12_ranked_search": ranked_search.oracle_sql()}


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_token_counts, op3_decontaminate, op4_toxicity, op5_personal_data, op6_token_files, op7_near_dedup, op8_url_filter, op9_packing, op10_quality, op11_sharding, op12_ranked_search, op13_periodic_runs)}
ORACLE_SQL = _oracle_sql()
