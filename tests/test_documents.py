"""The document source, the table function of chunkers, and accumulators, on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from sparloom.functions import chunkers
from sparloom.operators import accumulators as A
from sparloom.sources.documents import DocumentReader, read_documents, read_question_files
from sparloom.sources.sharding import with_index


@pytest.fixture
def folder(tmp_path):
    put = lambda name, raw: (tmp_path / name).write_bytes(raw if isinstance(raw, bytes) else raw.encode())
    put("a.txt", b"caf\xc3\xa9 \xff ok\r\nline")
    put("b.jsonl", '{"text":"one","n":1,"ok":true}\n\n{"text":"two","x":{"y":[1]}}\n{broken\n{"text":"four"}\n')
    put("c.json", '[{"text":"l0"},5,{"query":"q2","text":"l2"}]')
    put("d.json", '{"text":"alone",\n"k":null}')
    put("e.csv", 'id,text,z\n1,"multi\nline",\n2,,q\n')
    put("f.tsv", "h1\th2\nv1\tv2\n")
    put("g.md", "")
    put("h.jsonl", "{nothing\n{at all\n")
    put("_hidden.txt", "no")
    (tmp_path / "sub.txt").mkdir()
    put("sub.txt/i.txt", "inner")
    return tmp_path


def rows(df):
    return sorted((r["path"].rsplit("/", 1)[-1], r["text"], tuple(sorted((k, v) for k, v in r["meta"].items() if k != "source_file"))) for r in df.collect())


ALL = [
    ("a.txt", "café  ok\nline", ()),
    ("b.jsonl", "one", (("line", "0"), ("n", "1"), ("ok", "True"))), ("b.jsonl", "two", (("line", "1"), ("x", "{'y': [1]}"))),
    ("c.json", "l0", (("index", "0"),)), ("c.json", "l2", (("index", "2"), ("query", "q2"))),
    ("d.json", "alone", (("k", "None"),)),
    ("e.csv", "multi\nline", (("id", "1"), ("row", "0"), ("z", "nan"))), ("e.csv", "nan", (("id", "2"), ("row", "1"), ("z", "q"))),
    ("f.tsv", "v1", (("h2", "v2"), ("row", "0"))),
]


def test_a_mixed_folder(spark, folder):
    got = read_documents(spark, str(folder))
    assert rows(got) == ALL and all(r["meta"]["source_file"] == r["path"] for r in got.collect())
    assert rows(read_documents(spark, str(folder), bad="skip"))[3] == ("b.jsonl", "two", (("line", "1"), ("x", "{'y': [1]}")))
    assert ("b.jsonl", "four", (("line", "3"),)) in rows(read_documents(spark, str(folder), bad="skip"))
    assert rows(read_documents(spark, str(folder), glob="*.json")) == [r for r in ALL if r[0].endswith(".json")]
    assert ("i.txt", "inner", ()) in rows(read_documents(spark, str(folder), recursive=True))
    assert rows(read_documents(spark, f"file://{folder}/e.csv")) == ALL[6:8]
    with pytest.raises(Exception, match="does not exist"):
        read_documents(spark, f"{folder}/none").collect()


def test_ranks_share_the_files(spark, folder):
    parts = [rows(read_documents(spark, str(folder), rank=r, world=3)) for r in range(3)]
    assert sorted(sum(parts, [])) == ALL and all(parts)


def test_a_filter_on_suffix_reaches_the_reader(spark, folder):
    assert rows(read_documents(spark, str(folder)).where("suffix = 'csv'")) == ALL[6:8]
    (folder / "z.csv").write_text("x\n" * 3)
    reader = DocumentReader({"path": str(folder)})
    from pyspark.sql.datasource import EqualTo

    assert list(reader.pushFilters([EqualTo(("suffix",), "tsv")])) == [] and [f[1] for f in reader.listed()] == ["tsv"]


def test_questions(spark, folder):
    (folder / "q.jsonl").write_text("\n".join([json.dumps({"query": " who? ", "text": "x"}), json.dumps({"query": "", "text": "what"}), "{bad", json.dumps({"query": "  "})]))
    got = {r["query_id"].rsplit("/", 1)[-1]: r["query"] for r in read_question_files(spark, str(folder), glob="[aq].*").collect()}
    assert got == {"a.txt": "café  ok\nline", "q.jsonl#line0": "who?", "q.jsonl#line1": "what"}


def test_chunkers_as_a_table_function(spark):
    chunkers.register(spark, "cut")
    spark.createDataFrame([(1, "abcdefg", "k"), (2, None, None), (3, "", "e"), (4, "a\n\n b\nc", "w")], "id long, body string, z string").createOrReplaceTempView("held")
    ask = lambda how: [tuple(r) for r in spark.sql(f"SELECT * FROM cut(rows => TABLE(held), text => 'body', how => {how}) ORDER BY id, chunk_idx").collect()]
    assert ask("'chars', size => 4, overlap => 1") == [(1, "k", 0, "abcd"), (1, "k", 1, "defg"), (4, "w", 0, "a\n\n "), (4, "w", 1, " b\nc")]
    assert ask("'words', size => 2, overlap => 0, most => 1") == [(1, "k", 0, "abcdefg"), (4, "w", 0, "a b")]
    assert [r[3] for r in ask("'delimiter', keep => 'all'")] == ["abcdefg", "a", " b", "c"]
    assert spark.sql("SELECT * FROM cut(rows => TABLE(held), text => 'body', how => 'chars', size => 3)").columns == ["id", "z", "chunk_idx", "chunk"]
    for wrong in ("'lines'", "'chars', size => 0", "'chars'"):
        with pytest.raises(Exception, match="chunker|size"):
            ask(wrong)


def test_states_merge_in_any_grouping(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), (F.col("id") % 7).alias("rank"), F.when(F.col("id") % 11 > 0, F.col("id").cast("double")).alias("x"), F.lit(None).cast("double").alias("none"))
    parts = A.accumulated(df, ["rank", "g"], ["x", "none"])
    once = A.merged(parts, ["g"], ["x", "none"])
    twice = A.merged(A.merged(parts.withColumn("half", F.col("rank") % 2), ["half", "g"], ["x", "none"]), ["g"], ["x", "none"])
    show = lambda s: s.select("g", A.mean("x").alias("m"), "x.least", "x.most", "x.n", A.quantile("x", 0.5).alias("q"), A.mean("none").alias("none")).orderBy("g").collect()
    for a, b in zip(show(once), show(twice), strict=True):
        xs = [i for i in range(3000) if i % 3 == a["g"] and i % 11]
        assert (a["m"], a["least"], a["most"], a["n"], a["none"]) == (pytest.approx(sum(xs) / len(xs)), min(xs), max(xs), len(xs), None)
        assert (b["m"], b["n"]) == (pytest.approx(a["m"]), a["n"])
        for r in (a, b):
            assert abs(sum(x <= r["q"] for x in xs) / len(xs) - 0.5) <= 2 * A.RANK_ERROR


def test_index_reads_its_input_once(spark):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("k"), F.monotonically_increasing_id().alias("x"))
    got = with_index(df, ["k"], "i")
    assert [(r["k"], r["i"]) for r in got.orderBy("k").collect()] == [(i, i) for i in range(500)] and got.columns == ["k", "x", "i"]
