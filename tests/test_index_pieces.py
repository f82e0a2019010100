"""The width of an index's stored vectors, and the pieces of stored tables that tasks index."""

import random

import numpy as np
import pyarrow as pa
import pytest

from sparloom.operators import lexical
from sparloom.sources.sharding import spread


@pytest.mark.parametrize("most,width", [(100, 1), (1_000, 2), (40_000, 4)])
def test_stored_vectors_are_as_wide_as_their_counts(most, width):
    found, n = lexical.text_tokens(pa.array(["red " * most, "blue sky"]))
    head = next(lexical._segment("s", np.arange(2), n, np.asarray(found.indices, np.int64), found.dictionary.to_pylist(), 16)).to_pylist()[0]
    assert len(head["vectors"]) == 2 * 16 * width
    assert (lexical.Segment(head, 1.5, 0.75, 2.0).vectors(16) != 0).sum(axis=1).tolist() == [1, 2] and abs(lexical.hashed_vectors(head["vectors"], 2, 16)).max() == most


def test_pieces_are_bounded_by_stored_bytes(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    r = random.Random(2)
    texts = [(i, "".join(r.choices("abcdefghijklmnop", k=2_000)), "x", "y", "z") for i in range(500)]
    spark.createDataFrame(texts, "id long, text string, a string, b string, c string").coalesce(1).write.parquet(path)
    size = sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet"))
    assert spread(spark.read.parquet(path).select("id", "text"), size // 40).rdd.getNumPartitions() >= 40
