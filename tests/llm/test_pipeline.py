"""The pipeline on the small tables, stage by stage and whole."""

import collections

import corpus_pipeline
from sparloom.llm import bpe, common, mixing, pii, quality, simhash

from .fixtures import documents, empty, folder, prose


def test_stages_take_effect(spark, tmp_path):
    extra = [(100 + i, prose(100 + i, 90), "en", "a", 0) for i in range(12)]
    docs = documents(spark).select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long"))
    path = folder(docs, tmp_path)
    got = corpus_pipeline.run(spark, path).collect()
    kept = {r["doc_id"] for r in quality.judge(docs, ["doc_id"]).where("kept").collect()}
    passed = docs.where(docs["doc_id"].isin(*kept))
    groups = {r["doc_id"]: r["keeper"] for r in simhash.near_groups(passed).collect()}
    left = {i for i, k in groups.items() if i == k}
    clean = pii.redacted(passed.where(docs["doc_id"].isin(*left)).dropDuplicates(["doc_id"]))
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(common.materialize(clean, "t")).collect()}
    assert collections.Counter(r["doc_id"] for r in got) == {i: c for i, c in copies.items() if c}
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    codec = bpe.Codec.of(bpe.model_json(bpe.vocabulary()[0]), bpe.vocabulary()[1])
    for r in got:
        assert r["text"] == texts[r["doc_id"]] and r["n_chars"] == len(r["text"])
        assert r["ids"] == codec.encode(r["text"]).tolist() and r["n_tokens"] == len(r["ids"])


def test_stages_keep_the_columns(spark):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = documents(spark)
        assert stage(spark, df, "").columns == df.columns, name
        assert stage(spark, empty(spark), "").count() == 0


def test_stages_bound_arrow_batches(spark):
    from sparloom import session

    held = {name: spark.conf.get(name) for name in session.ARROW_BATCHES}
    try:
        for _, stage in corpus_pipeline.STAGES:
            for name in held:
                spark.conf.unset(name)
            stage(spark, empty(spark), "")
            assert {name: spark.conf.get(name) for name in held} == session.ARROW_BATCHES
    finally:
        session.bound_batches(spark)


def test_queries_equal_their_sql(spark):
    from sparloom.llm import queries

    from ..compare import differences

    for name, sql in queries.oracle_sql().items():
        assert differences(spark, name, queries.queries()[name], sql, "/root/testdata/sf0.001") is None
