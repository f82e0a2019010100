"""Readers, sinks, shards and streams."""

import json

from pyspark.sql import functions as F

from sparloom.operators import memory
from sparloom.sources import readers, sharding
from sparloom.streaming import memory as stream_memory
from sparloom.streaming import windows

SF = "/root/testdata/sf0.001"


def test_folder_of_mixed_files(spark, tmp_path):
    (tmp_path / "doc.txt").write_bytes(b"plain \xff text")
    (tmp_path / "one.json").write_text(json.dumps({"text": "single", "n": 1}))
    (tmp_path / "many.json").write_text(json.dumps([{"text": "first"}, {"text": "second", "tag": "t"}]))
    (tmp_path / "rows.jsonl").write_text('{"text": "l1", "k": "v"}\n{"text": "l2"}\nnot json\n')
    (tmp_path / "rows.csv").write_text("id,text\n1,c1\n2,\n")
    (tmp_path / "bare.csv").write_text("a,b\nx,y\n")
    (tmp_path / "rows.tsv").write_text("text\tn\nt1\t5\n")
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "sub").mkdir()
    got = {r["text"]: r["meta"] for r in readers.read_folder(spark, str(tmp_path)).collect()}
    assert set(got) == {"plain  text", "single", "first", "second", "l1", "l2", "c1", "x", "t1"}
    assert got["l1"]["k"] == "v" and got["x"]["b"] == "y" and got["second"]["tag"] == "t" and got["single"]["source_file"].endswith("one.json")


def test_queries_log_and_sinks(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"query": "a"}\n{"text": "b"}\nbroken\n{"query": " "}\n')
    assert sorted(r["query"] for r in readers.read_queries(spark, str(tmp_path / "q.jsonl")).collect()) == ["a", "b"]
    lines = spark.createDataFrame([("Mean TTFT (ms): 123.4",), ("Successful requests: 32",), ("Output token throughput (tok/s): 512",), ("noise",), ("x: y",)], "value string")
    assert {r["metric"]: round(r["value"], 6) for r in readers.read_log(lines).collect()} == {"ttft_sec": 0.1234, "requests": 32, "tokens_per_sec": 512}
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    readers.write_csv(df, str(tmp_path / "csv"))
    readers.write_jsonl(df, str(tmp_path / "json"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).where("b is null").count() == 1
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_shards_and_caches(spark, tmp_path):
    df = spark.range(103).select((F.col("id") * 7 % 103).alias("id"))
    assert sorted(r["i"] - r["id"] for r in sharding.with_index(df, ["id"], "i").collect()) == [0] * 103
    parts = [{r["id"] for r in readers.shard(df, ["id"], k, 4).collect()} for k in range(4)]
    assert [min(p) for p in parts] == [0, 1, 2, 3] and sum(map(len, parts)) == 103
    assert readers.shard(df, ["id"], 1, 4, cap=3).count() == 3
    build = lambda s, n: s.range(n)
    assert readers.cached_corpus(spark, build, str(tmp_path), n=5).count() == 5 == readers.cached_corpus(spark, None or build, str(tmp_path), n=5).count()


def test_stream_windows_equal_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    late = events.orderBy(F.desc("ts")).limit(1).withColumn("ts", F.col("ts") + F.expr("INTERVAL 400 DAYS"))
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = windows.tumbling(windows.read_files(spark, str(tmp_path / "in"), events, 8), late="1 hour")
    got = windows.run_once(stream, str(tmp_path / "ck"), str(tmp_path / "out"))
    told = windows.tumbling(events)
    assert got.exceptAll(told).count() == 0 and told.exceptAll(got).count() == 0


def test_stream_memory_equals_batch(spark, tmp_path):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    limits = memory.Limits(short=3, long=2, episodes=1)
    most = turns.agg(F.max("turn")).first()[0]
    for t in range(most + 1):  # one turn a micro-batch, so answers meet questions of earlier ones
        turns.where(F.col("turn") == t).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = stream_memory.store_stream(windows.read_files(spark, str(tmp_path / "in"), turns, 1), limits)
    got = windows.run_once(stream, str(tmp_path / "ck"), str(tmp_path / "out"))
    told = memory.store(turns, limits)
    assert got.exceptAll(told).count() == 0 and told.exceptAll(got).count() == 0 and told.count() == turns.count()


def test_metric_files_and_tables(spark, tmp_path):
    from sparloom.sources import runs

    (tmp_path / "m" / "rank0").mkdir(parents=True)
    (tmp_path / "m" / "rank0" / "metrics.json").write_text(json.dumps({"a": {"count": 2, "total_sec": 3.0}, "b": {"n": 1, "samples": [50, 70]}}))
    got = {r["metric"]: (r["count"], round(r["seconds"], 6)) for r in runs.read_metric_files(spark, str(tmp_path / "m")).collect()}
    assert got == {"a": (2, 3.0), "b": (1, 0.12)}
    df = spark.createDataFrame([("x_1", None, 2), ("y", "50%", 3)], "name string, note string, n int")
    assert runs.latex(df).count(r"\\") == 3 and r"x\_1" in runs.latex(df)
    assert runs.text_column(df) == "name" and runs.export_texts(df, str(tmp_path / "t"), "note") == 1
    assert runs.rank_world({"SLURM_PROCID": "5", "SLURM_NTASKS": "4"}) == (1, 4) and runs.rank_world({}) == (0, 1)


def test_blake_embedding(spark):
    import hashlib

    from sparloom.plans import runs

    got = runs.blake_rows(spark.createDataFrame([("é",), (None,)], "text string"), dim=70).collect()
    for r in got:
        digest = hashlib.blake2b((r["text"] or "").encode()).digest()
        assert [round(x, 5) for x in r["blake"]] == [round(digest[j % 64] / 127.5 - 1, 5) for j in range(70)]


def test_token_distance_against_a_plain_program(spark):
    import random

    from sparloom.operators.consistency import token_distance

    r = random.Random(3)
    rows = [([r.choice("abcdefgh") for _ in range(r.randint(0, 12))], [r.choice("abcdefgh") for _ in range(r.randint(0, 12))]) for _ in range(80)]
    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select("a", "b", token_distance(F.col("a"), F.col("b")).alias("d")).collect()
    for row in got:
        line = list(range(len(row["b"]) + 1))
        for i, x in enumerate(row["a"], 1):
            last, line[0] = line[0], i
            for j, y in enumerate(row["b"], 1):
                last, line[j] = line[j], min(line[j] + 1, line[j - 1] + 1, last + (x != y))
        assert row["d"] == line[-1]
