"""Queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _op1(spark, d):
    from .quality import op1

    return op1(_t(spark, d, "documents"), _t(spark, d, "labels"))


def _op2(spark, d):
    import public_tokenizers

    from .packing import op2

    return op2(_t(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def _op3(spark, d):
    from .secret_scan import op3

    return op3(_t(spark, d, "documents"))


def _op4(spark, d):
    from .pii import op4

    return op4(_t(spark, d, "documents"))


def _pii_collisions(spark, d):
    from .pii import collisions, session_key

    return collisions(_t(spark, d, "documents"), session_key(spark))


def _op5(spark, d):
    from .rules import op5

    return op5(_t(spark, d, "documents"))


def _op6(spark, d):
    from .chat import op6

    return op6(_t(spark, d, "conversations"))


def _op7(spark, d):
    import public_tokenizers

    from .bpe import op7

    return op7(_t(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def _op8(spark, d):
    from .minhash import op8

    return op8(_t(spark, d, "documents"))


def _op9(spark, d):
    from .embed import op9

    return op9(_t(spark, d, "embeddings"))


def _op10(spark, d):
    from .langid import op10

    return op10(_t(spark, d, "documents"))


def _op11(spark, d):
    import public_tokenizers

    from .token_files import op11

    return op11(_t(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def _op12(spark, d):
    import public_tokenizers as t

    from .align import op12

    return op12(_t(spark, d, "documents"), t.path("byte_bpe_50k.json"), t.path("piece_bpe_32k.model"))


def _op13(spark, d):
    from .whiten import op13

    return op13(_t(spark, d, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": _op1,
        "op2_packing": _op2,
        "op3_secrets": _op3,
        "op4_pii": _op4,
        "pii_collisions": _pii_collisions,
        "op5_rules": _op5,
        "op6_chat": _op6,
        "op7_bpe": _op7,
        "op8_minhash": _op8,
        "op9_embeddings": _op9,
        "op10_langid": _op10,
        "op11_token_files": _op11,
        "op12_alignment": _op12,
        "op13_whitening": _op13,
    }


def oracle_sql() -> dict[str, str]:
    from .chat import OP6_SQL

    return {"op6_chat": OP6_SQL}
