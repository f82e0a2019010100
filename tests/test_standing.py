"""Where expected rows stand, against the lists of the best."""

import random

import pytest
from pyspark.sql import functions as F

from sparloom.functions.text import clean, first_words
from sparloom.operators import retrieval, standing

WORDS = ["red", "blue", "apple", "sky", "pie", "the", "of", "a1", "x_y", "tree"]


def made(spark):
    r = random.Random(11)
    held = [" ".join(r.choices([*WORDS, *(f"w{i}" for i in range(60))], [9] * 10 + [1] * 60, k=r.randint(0, 40))) for _ in range(240)]
    held += [*held[:30], "", None, "apple " * 300, "!"]  # copies tie, and the smaller id stands first
    rows = spark.createDataFrame(list(enumerate(held)), "id long, text string")
    asked = [(2 * i + 1, " ".join((held[i] or "").split()[:6]), i, held[i]) for i in range(0, len(held), 3)]
    asked += [(2 * i, "what of the apple", i, held[i]) for i in range(0, len(held), 20)]  # one text, many expected rows
    asked += [(10_001, "none", 0, held[0]), (10_003, "tree sky", 4, held[4])]
    return rows.repartition(3), spark.createDataFrame(asked, "qid long, text string, expected long, own string")


@pytest.mark.parametrize("k,block", [(5, 16_384), (2, 17)])
def test_ranks_are_those_of_the_lists(spark, monkeypatch, k, block):
    monkeypatch.setattr(standing, "BLOCK", block)
    rows, asked = made(spark)
    for rank, topk in ((standing.bm25_rank, retrieval.bm25_topk), (standing.hybrid_rank, retrieval.hybrid_topk)):
        told = topk(rows, asked.select("qid", "text"), k).join(asked.select("qid", "expected"), "qid").where("id = expected")
        told = sorted(map(tuple, told.select("qid", "id", "rank").collect()))
        assert sorted(map(tuple, rank(rows, asked, k).select("qid", "id", "rank").collect())) == told and len(told) > 30


def test_ranks_send_no_lists(spark, monkeypatch):
    """The expected row's score is known before the search: no k hits a task and query are made."""
    monkeypatch.setattr(retrieval, "_hits", None)
    monkeypatch.setattr(retrieval, "_searched", None)
    rows, asked = made(spark)
    assert standing.bm25_rank(rows, asked.where("qid % 2 = 1"), 5).count() > 30


def test_first_words(spark):
    texts = ["  a  b \t c\n d", "a", "", None, " 　x y z", "one two three"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(clean(first_words(F.col("t"), 3))).collect()
    assert [r[0] for r in got] == ["a b c", "a", "", "", "x y z", "one two three"]


def test_retrieval_eval_makes_no_lists(spark, monkeypatch):
    from sparloom.plans.retrieval import retrieval_eval

    monkeypatch.setattr(retrieval, "bm25_topk", None)
    assert retrieval_eval(spark, "/root/testdata/sf0.001").first()["cases"] > 0
