"""Stored indexes, keyed stores and the streams over them, against plain programs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparloom.functions.text import clean, solid, tokens
from sparloom.operators import lexical, nearness, retrieval, vector_index
from sparloom.operators.memory import embed
from sparloom.sources.store import KeyedStore
from sparloom.streaming import coalesce
from sparloom.streaming.cache import Cache

WORDS = ["red", "blue", "apple", "sky", "pie", "the", "of", "a1", "x_y", "tree"]


def texts(n, seed, most=30):
    r = random.Random(seed)
    return [" ".join(r.choices(WORDS, [1, 1, 1, 2, 2, 9, 9, 1, 1, 3], k=r.randint(0, most))) for _ in range(n)]


# ------------------------------------------------------------------ lexical index


def test_index_tokens_are_those_of_the_column(spark):
    rows = ["Ab, é_c 12", "İx K2 ǅ", None, "", "a" * 3000, "ß9\n_", "\U0001d7d8z"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id long, text string")
    told = {r["id"]: r["t"] for r in df.select("id", tokens(F.col("text")).alias("t")).collect()}
    found, n = lexical.text_tokens(pa.array(rows, pa.string()))
    flat, ends = found.to_pylist(), np.cumsum(n)
    assert [flat[e - k : e] for e, k in zip(ends, n, strict=True)] == [told[i] for i in range(len(rows))]


def plain_bm25(rows, query, k1=1.5, b=0.75):
    split = [t.split() for t in rows]
    mean = sum(map(len, split)) / len(split)
    out = {}
    for i, words in enumerate(split):
        score = 0.0
        for term in query.split():
            df = sum(term in w for w in split)
            tf = words.count(term)
            if tf:
                score += np.log(1 + (len(split) - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(words) / mean))
        if score > 0:
            out[i] = round(score, 6)
    return out


@pytest.mark.parametrize("block,rows", [(4, 37), (128, 16_384)])
def test_bm25_skips_blocks_safely(spark, tmp_path, monkeypatch, block, rows):
    monkeypatch.setattr(lexical, "ROW_BLOCK", block)
    held = texts(300, 1)
    whole = spark.createDataFrame([(i, t) for i, t in enumerate(held)], "id long, text string").repartition(3)
    path = f"file://{tmp_path}/index"
    lexical.append(whole.where("id < 200"), path)
    lexical.append(whole.where("id >= 200"), path)  # appended segments count in all statistics
    index = lexical.load(spark, path)
    asked = ["red pie", "the the of", "x_y tree sky", "none", "apple apple a1"]
    queries = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "qid long, text string")
    got = {}
    for r in retrieval.bm25_topk(index, queries, 5).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["id"], r["score"]))
    for q, text in enumerate(asked):
        told = sorted(plain_bm25(held, text).items(), key=lambda x: (-x[1], x[0]))[:5]
        assert [(i, s) for _, i, s in sorted(got.get(q, []))] == [(i, pytest.approx(s, abs=2e-6)) for i, s in told]


def test_blocks_that_cannot_reach_the_best_are_left_out():
    rows, n = ["rare rare rare"] + ["the of"] * 5_000 + ["the rare"], 5_002
    found, lengths = lexical.text_tokens(pa.array(rows))
    batches = list(lexical._segment("s", np.arange(n), lengths, np.asarray(found.indices, np.int64), found.dictionary.to_pylist(), 8))
    vocabulary = {"rare": 0, "the": 1}
    [segment] = lexical.segments(iter(batches[:1] + [b.filter(pa.array([t in vocabulary for t in b.column(0).to_pylist()])) for b in batches[1:]]), vocabulary, np.array([7.0, 0.01]), 2.0, 1.5, 0.75)
    at, _, skipped = segment.best([(0, 1), (1, 1)], 2, -np.inf)
    assert {0, n - 1} <= set(at.tolist()) and skipped > 30 and len(at) < 400


def test_index_is_built_once_for_its_content(spark, monkeypatch):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts(20, 5))], "id long, text string")
    first = lexical.stored(df).inputFiles()
    monkeypatch.setattr(lexical, "append", None)  # a second build would fail
    assert sorted(lexical.stored(df.repartition(4)).inputFiles()) == sorted(first)


def test_clean_and_solid(spark):
    rows = ["  a  b \t c\n", " 　 ", "", None, "x  y", "x y", "\x1c"]
    got = spark.createDataFrame([(t,) for t in rows], "t string").select(clean(F.col("t")), solid(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("a b c", True), ("", False), ("", False), ("", False), ("x y", True), ("x y", True), ("\x1c", True)]


# ------------------------------------------------------------------- near texts


@pytest.mark.parametrize("least,wide", [(0.99, 16), (0.9, 16), (0.99, 1)])
def test_near_earlier_equals_all_pairs(spark, monkeypatch, least, wide):
    monkeypatch.setattr(nearness, "MOST_GROUPS", wide)
    r = random.Random(least)
    held = [" ".join("".join(r.choice("abcdef") for _ in range(3)) for _ in range(r.choice([1, 2, 5, 30, 200]))) for _ in range(90)]
    for t in held[:40]:  # near copies
        words = t.split()
        words[r.randrange(len(words))] = "zzz"
        held.append(" ".join(words + [words[0]] * r.randint(0, 2)))
    held += held[:3] + ["", "", None, "!"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(held)], "id long, text string").repartition(4)
    got = {x["id"] for x in nearness.near_earlier(df, least).collect()}
    vectors = [embed(t or "") for t in held]
    told = {i for i in range(len(held)) if held[i] in held[:i] and held[i] is not None or any(round(float(vectors[i] @ vectors[j]), 6) >= least for j in range(i))}
    assert got == told and len(told) > 12


# ----------------------------------------------------------------- vector index


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_vector_index_gives_the_rows_of_a_full_search(spark, tmp_path, metric):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16)) * 6
    rows = [(i, (centres[i % 12] + rng.normal(size=16) * 0.3).astype(np.float32).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    path = f"file://{tmp_path}/index"
    vector_index.write(df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), path, 12)
    queries, visited = df.where("vec_id % 50 = 0"), []
    got = vector_index.search(spark, path, queries, 7, metric, visited=visited)
    told = retrieval.exact_topk(df, queries, 7, metric)
    assert sorted(map(tuple, got.select("qid", "id", "rank", "score").collect())) == sorted(map(tuple, told.select("qid", "id", "rank", "score").collect()))
    searched, all_ = map(sum, zip(*visited, strict=True))
    assert searched < all_ / 3  # clusters far apart
    assert vector_index.search(spark, path, queries.limit(0), 7, metric).count() == 0


# ------------------------------------------------------------------ keyed store


def test_upserts_touch_their_buckets_only(spark, tmp_path):
    store = KeyedStore(spark, f"file://{tmp_path}/store", "k", "at", 8)
    schema = "k long, at long, v string"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    assert store.read(schema).count() == 0 and store.upsert(frame([])) == -1
    assert store.upsert(frame([(i, 1, f"a{i}") for i in range(100)] + [(3, 2, "newer"), (None, 1, "none")])) == 0
    before = store.live()
    assert store.upsert(frame([(5, 2, "b5"), (7, 0, "older"), (9, 1, "same time"), (None, 2, "none again")])) == 1
    told = {i: (1, f"a{i}") for i in range(100)} | {3: (2, "newer"), 5: (2, "b5"), 9: (1, "same time"), None: (2, "none again")}
    assert {r["k"]: (r["at"], r["v"]) for r in store.read(schema).collect()} == told
    kept = {b for b, f in store.live().items() if before.get(b) == f}
    assert 8 - len(kept) <= 4 and kept
    assert {r["k"]: r["v"] for r in store.read(schema, 0).collect()}[5] == "a5"  # an earlier version still reads
    assert len(store.vacuum()) == 8 - len(kept) and {r["k"]: (r["at"], r["v"]) for r in store.read(schema).collect()} == told


def test_an_upsert_that_fails_leaves_nothing(spark, tmp_path):
    store = KeyedStore(spark, f"file://{tmp_path}/store", "k", "at", 2)
    store.upsert(spark.createDataFrame([(1, 1)], "k long, at long"))
    bad = spark.range(4).select(F.col("id").alias("k"), F.when(F.col("id") < 9, F.raise_error(F.lit("lost"))).cast("long").alias("at"))
    with pytest.raises(Exception, match="lost"):
        store.upsert(bad)
    assert [tuple(r) for r in store.read("k long, at long").collect()] == [(1, 1)] and store.version() == 0


# -------------------------------------------------------------------- the streams


def sequential(asked, threshold, ttl):
    """The cache one question after the other."""
    entries, exact, out = [], {}, {}
    for qid, at, text in asked:
        live = [(q, v) for q, v, end in entries if end >= at]
        vector = embed(text or "")
        scores = [(round(float(vector @ v), 6), -q) for q, v in live]
        if (text or "") in exact and exact[text or ""][1] >= at:
            out[qid] = "exact", exact[text or ""][0]
        elif scores and max(scores)[0] >= threshold:
            out[qid] = "near", -max(scores)[1]
        else:
            out[qid] = "miss", None
            entries.append((qid, vector, at + ttl))
            exact[text or ""] = qid, at + ttl
    return out


def test_cache_equals_a_sequential_program(spark, tmp_path):
    asked = [(0, 0, "red apple pie"), (1, 1, "pie apple red"), (2, 2, "blue sky"), (3, 3, "red apple pie"), (4, 30, "red apple pie"), (5, 31, "apple red pie"), (6, 32, None)]
    root = f"file://{tmp_path}/cache"
    for i, row in enumerate(asked):
        cache = Cache(spark, root, cells=2, ttl=20) if i in (0, 3) else cache  # a second one goes on from the stored state
        cache.arrive(spark.createDataFrame([row], "qid long, at long, text string"), i)
        cache.serve()
    got = {r["qid"]: (r["kind"], r["seq"]) for r in cache.verdicts().collect()}
    assert got == sequential(asked, 0.92, 20)
    answers = {r["qid"]: r["answer"] for r in cache.verdicts().collect()}
    assert answers[1] == answers[0] == answers[3] and answers[5] == answers[4] and len(answers) == 7


def test_coalescing_keeps_no_row_back(spark, tmp_path):
    rows = spark.range(100).select((F.col("id") % 2).cast("int").alias("shard"), F.lit(0).alias("piece"), "id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") + F.when(F.col("id") >= 60, 1_000).otherwise(0)).alias("ts"))
    root = f"file://{tmp_path}"
    rows.limit(0).write.parquet(f"{root}/rows/slice=-1")
    stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(f"{root}/rows")
    flushes = coalesce.coalesced(stream, 8, 500_000)
    last = spark.range(1).select(F.lit(-1).alias("shard"), F.lit(0).alias("piece"), F.lit(-1).cast("long").alias("id"), F.timestamp_seconds(F.lit(1_700_010_000)).alias("ts"))
    for i, part in enumerate([rows.where("id < 50"), rows.where("id >= 50"), last]):
        part.write.parquet(f"{root}/rows/slice={i}")
        coalesce.run(flushes, root)
    got = spark.read.option("recursiveFileLookup", True).parquet(f"{root}/flushes").where("shard >= 0").collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["shard"], r["flush"], r["place"])):
        by.setdefault((r["shard"], r["flush"], r["cause"]), []).append(r["id"])
    told = {}
    for shard in (0, 1):
        ids = list(range(shard, 100, 2))
        parts = [ids[i : i + 8] for i in range(0, 24, 8)] + [ids[24:30]] + [ids[i : i + 8] for i in range(30, 50, 8)]
        told |= {(shard, n, "full" if len(p) == 8 else "late"): p for n, p in enumerate(parts)}
    assert by == told


# ------------------------------------------------------- memory and calls, without Spark


class Told:
    """A state of a stateful stream that counts its calls."""

    def __init__(self, value=None):
        self.value, self.calls = value, 0

    def _called(self, out=None):
        self.calls += 1
        return out

    exists = lambda self: self.value is not None
    get = lambda self: self._called(self.value)
    iterator = lambda self: iter(self.value.items())
    containsKey = lambda self, key: False  # noqa: E731, N815

    def update(self, value):
        self.value = self._called(value)

    def clear(self):
        self.value = self._called([])

    def appendList(self, rows):  # noqa: N802
        self.value = self._called([*(self.value or []), *rows])

    def deleteTimer(self, at):  # noqa: N802
        self._called()

    registerTimer = deleteTimer  # noqa: N815


def test_best_holds_few_hits_of_a_large_product():
    from sparloom.operators import retrieval as R

    rng = np.random.default_rng(3)
    scores = rng.integers(0, 40, (2_000, 512)) / 8
    best = R.Best(2_000, 10)
    best.add(np.arange(512)[::-1].copy(), scores)
    assert best.size < 200_000
    q, ids, score = best.reduce()
    order = np.lexsort((np.broadcast_to(np.arange(512)[::-1], scores.shape), -scores), axis=1)[:, :10]
    assert (score.reshape(2_000, 10) == np.take_along_axis(scores, order, 1)).all()
    assert (ids.reshape(2_000, 10) == 511 - order).all()
    some = R.Best(2_000, 10)
    some.add(np.arange(512)[::-1].copy(), scores[7:9], np.array([7, 8]))
    assert (some.reduce()[1] == ids.reshape(2_000, 10)[7:9].ravel()).all()


def test_cache_unpacks_some_questions_at_a_time(monkeypatch):
    import pandas as pd

    from sparloom.streaming import cache

    rng, dim = np.random.default_rng(5), 16
    seqs = np.array([9, 4, 7, 2], np.int64)
    entries = rng.integers(1, 4, (4, dim)).astype(np.int32)
    entries[1] = entries[3]
    asked = np.concatenate((entries, rng.integers(1, 4, (6, dim)))).astype(np.int32)
    cell = cache.Cell(None, dim)
    cell.blocks, cell.exact = Told({(0,): (seqs.tobytes(), np.full(4, 100, np.int64).tobytes(), entries.tobytes())}), Told()
    rows = pd.DataFrame({"qid": range(10), "at": [5] * 9 + [101], "text": ["t"] * 10, "digest": ["d"] * 10, "vector": [v.tobytes() for v in asked]})
    whole = cell.ask(rows)
    held, unit = [], cell._unit
    monkeypatch.setattr(cache, "QUESTIONS", 3)
    cell._unit = lambda raw: held.append(len(raw) // (4 * dim)) or unit(raw)
    assert cell.ask(rows).equals(whole) and max(held) == 4 and held[1:] == [3, 3, 3, 1]
    assert whole["seq"].tolist()[:4] == [9, 2, 7, 2] and whole["score"].tolist()[9] == -2.0


def test_flushes_of_a_micro_batch_touch_state_once():
    import pandas as pd

    rng, target, patience = np.random.default_rng(6), 8, 300
    at = np.sort(rng.integers(0, 60_000, 3_000))
    told, held = [], []
    for i, t in enumerate(at.tolist()):
        if held and (len(held) == target or t - held[0][1] >= patience):
            told.append(held)
            held = []
        held.append((i, t))
    buffer = coalesce.Buffer(target, patience, 0)
    buffer.rows, buffer.told, buffer.handle = Told(), Told(), Told()
    out = [x for a, b in ((0, 5), (5, 1_999), (1_999, 3_000)) for x in buffer.handleInputRows((1, 0), iter([pd.DataFrame({"id": range(a, b), "at": at[a:b]})]), None)]
    got = pd.concat(out)
    assert [list(zip(g["id"], g["at"], strict=True)) for _, g in got.groupby("flush")] == told
    assert [c.iloc[0] for _, c in got.groupby("flush")["cause"]] == ["full" if len(x) == target else "late" for x in told]
    assert (got["place"] == got.groupby("flush").cumcount()).all() and buffer.rows.value == held
    assert buffer.told.value == (len(held), held[0][1], len(told)) and buffer.rows.calls + buffer.told.calls + buffer.handle.calls < 30
