"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score, train

    docs = _table(spark, sf_dir, "documents")
    return score(docs, train(docs, _table(spark, sf_dir, "labels"), strict=False))


def op2_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hilbert_shards import hilbert_shards

    return hilbert_shards(_table(spark, sf_dir, "documents"))


def op3_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import edited_prints

    return edited_prints(_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify_pages, train

    model = train(_table(spark, sf_dir, "documents"), strict=False)
    return identify_pages(_table(spark, sf_dir, "pages"), model).drop("posterior")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import packed

    return packed(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN).drop("ids")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import at_digest, store, with_features, with_headers
    from .shared import materialise

    rows, places = store(_table(spark, sf_dir, "documents"))
    told = materialise(with_features(with_headers(places)), "media-features")
    return at_digest(rows, told.drop("folder", "rows"), told.select("digest", "rows"))


def op7_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dups import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=2).drop("set_digest")


def op8_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(_table(spark, sf_dir, "conversations"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(_table(spark, sf_dir, "pages"))


def op10_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .word_bpe import decode, encode

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = encode(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return decode(ids, ranks).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_hilbert_shards": op2_hilbert_shards,
    "op3_merkle": op3_merkle,
    "op4_language_id": op4_language_id,
    "op5_packing": op5_packing,
    "op6_media": op6_media,
    "op7_chosen_path": op7_chosen_path,
    "op8_rotation": op8_rotation,
    "op9_html_text": op9_html_text,
    "op10_word_bpe": op10_word_bpe,
}

ORACLES: dict[str, str] = {"op8_rotation": chat.ORACLE}
