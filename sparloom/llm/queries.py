"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, lm, merkle, mixing, packing, pii, quality, resharding, simhash, sketches, substrings, trie, warc

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    """One query for each operator; `pipeline` where the repository's top has it."""
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_fingerprints": sketches.op2_fingerprints,
        "op3_resharding": resharding.op3_resharding,
        "op4_simhash": simhash.op4_simhash,
        "op5_cross_entropy": lm.op5_cross_entropy,
        "op6_warc": warc.op6_warc,
        "op7_bpe": bpe.op7_bpe,
        "op8_quality": quality.op8_quality,
        "op9_substrings": substrings.op9_substrings,
        "op10_pii": pii.op10_pii,
        "op11_prefix_trie": trie.op11_prefix_trie,
        "op12_merkle": merkle.op12_merkle,
        "op13_packing": packing.op13_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_warc": warc.SQL, "op8_quality": quality.SQL, "op9_substrings": substrings.SQL, "op11_prefix_trie": trie.SQL, "op12_merkle": merkle.SQL}
