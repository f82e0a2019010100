"""Result rows, run files and carried states, by hand."""

import pytest
from pyspark.sql import functions as F

from sparloom.operators import results as X
from sparloom.operators import states as K
from sparloom.sources import readers as R


def test_cells(spark):
    rows = spark.createDataFrame([("1.5", None, None), ("nan", "yes", "no"), ("", "", ""), ("Infinity", "false", None), (None, "1", "maybe")], "v string, a string, s string")
    out = rows.select(X.number(F.col("v")), X.usable(F.col("a"), F.col("s"))).collect()
    assert [tuple(r) for r in out] == [(1.5, True), (None, True), (None, False), (None, False), (None, False)]


def test_agreement_is_clamped_and_falls_back(spark):
    rows = spark.createDataFrame([("2", "false"), ("-1", None), ("", "true"), (None, "false"), (None, ""), (None, None)], "r string, e string")
    assert [r[0] for r in rows.select(X.agreement([F.col("r")], F.col("e"))).collect()] == [1.0, 0.0, 1.0, 0.0, None, None]


def test_cells_lose_control_characters(spark):
    rows = spark.createDataFrame([("a\x00b\tc",), (None,)], "v string")
    assert [r[0] for r in rows.select(X.cell(F.col("v"))).collect()] == ["a b\tc", ""]


def test_put_prefers_the_right_map(spark):
    row = spark.range(1).select(X.put(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3"))).alias("m")).first()
    assert row.m == {"a": "1", "b": "3"}


def test_references_fall_back_and_skip(spark):
    rows = spark.createDataFrame([(1, "ref", "w", 1, "2.0", ""), (2, "ref", "w", 1, "4.0", ""), (3, "x", "w", 1, "3.0", ""), (4, "x", "w", 9, "8.0", ""), (5, "x", "w", 1, "8.0", "true"), (6, "x", "v", 1, "8.0", "")], "row_id int, base string, wl string, ctx int, ttft_sec string, skipped string")
    out = X.beside_reference(rows, F.col("base") == "ref", ["wl", "ctx"], "wl").orderBy("row_id").collect()
    assert [(r.ref_ttft, r.speedup) for r in out] == [(2.0, 1.0), (2.0, 2.0), (2.0, 1.5), (2.0, 4.0), (2.0, 0.0), (None, 0.0)]


def test_run_rows_reads_known_shapes_only(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name, body in {"a.json": '{"metrics": {"ttft_sec": 1}}', "b.json": '{"ttft_sec": "2", "other": 5}', "deep/c.json": '{"runs": [], "ttft_sec": 3}', "d.json": "{", "deep/e.json": '{"other": 1}', "f.txt": '{"ttft_sec": 9}'}.items():
        (tmp_path / name).write_text(body)
    out = X.run_rows(spark, str(tmp_path), ["ttft_sec"], "*.json").collect()
    assert sorted((r.file.rsplit("/", 1)[1], r.ttft_sec) for r in out) == [("a.json", 1.0), ("b.json", 2.0)]


def test_states_that_were_not_sent_are_an_error(spark, tmp_path):
    sent = spark.createDataFrame([("s1", "n1")], "state_id string, owner_node string")
    K.send(sent, str(tmp_path / "s"))
    ask = lambda *ids: K.receive(spark, str(tmp_path / "s"), spark.createDataFrame([(i,) for i in ids], "state_id string"), sent.schema).collect()
    assert [tuple(r) for r in ask("s1")] == [("s1", "n1")]
    with pytest.raises(Exception, match="s2 has not been sent"):
        ask("s2")


def test_half_written_corpora_are_built_again(spark, tmp_path):
    build = lambda spark, n: spark.range(n)
    assert R.cached_corpus(spark, build, str(tmp_path), n=3).count() == 3
    (tmp_path / "n=3" / "_SUCCESS").unlink()
    assert not R.ready(spark, str(tmp_path / "n=3"))
    assert R.cached_corpus(spark, lambda spark, n: spark.range(n + 1), str(tmp_path), n=3).count() == 4
    assert R.cached_corpus(spark, build, str(tmp_path), n=3).count() == 4


def test_barriers_wait_for_all(spark, tmp_path):
    R.barrier(spark, str(tmp_path / "one"), 0, 1, 5)
    with pytest.raises(TimeoutError, match="rank=1"):
        R.barrier(spark, str(tmp_path / "two"), 0, 2, 0.1)


def test_text_tables(spark):
    rows = spark.createDataFrame([("a", 1), (None, 22)], "name string, n int")
    assert X.text_table(rows).split("\n") == ["name | n ", "-----+---", "a    | 1 ", "     | 22"]
    with pytest.raises(ValueError):
        X.text_table(rows, 1)
