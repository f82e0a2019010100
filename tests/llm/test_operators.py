"""Each operator against a plain program on small tables with nulls, empties, ties, repeats and long texts."""

import collections
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from sparloom.llm import bpe, common, lm, mixing, pii, quality, resharding, simhash, sketches, substrings, warc

from .fixtures import documents, empty, folder, plain, sha, words


@pytest.fixture(scope="module")
def docs(spark):
    return plain(spark).cache()


@pytest.fixture(scope="module")
def own(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


# ------------------------------------------------------------------ 1 mixing


def test_water_fill_reshares_what_limits_cut_off():
    assert mixing.water_fill([3, 1, 2], [10, 100, 100], 60) == pytest.approx([10, 50 / 3, 100 / 3])
    assert mixing.recipe({"": 10, "=b": 10, "=a": 10}, (3, 1, 2), 1.5, 2.0) == pytest.approx({"=a": 20, "=b": 25 / 3, "": 50 / 3})


def test_mixing_meets_targets(spark):
    rows = [(i, "w " * (1 + i * i % 97), f"s{i % 3}") for i in range(600)] + [(1000 + i, "x " * 7, None) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).join(df.select("doc_id", "source"), "doc_id").collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(lambda: [0, 0, 0])
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        by[r["source"]][0] += r["taken"]
        by[r["source"]][1] = r["target"]
        by[r["source"]][2] += r["size"]
    names = sorted(by, key=lambda s: (s is None, s or ""))
    total = sum(v[2] for v in by.values())
    told = mixing.water_fill([(3, 1, 2)[i % 3] for i in range(len(names))], [2.0 * by[n][2] for n in names], 1.5 * total)
    for n, target in zip(names, told, strict=True):
        assert by[n][1] == pytest.approx(target)
        assert abs(by[n][0] - target) <= 40
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(df.repartition(5)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}


def test_two_margins_balance_together(spark):
    rows = [(a, b, s, 10) for a in ("=x", "=y") for b in ("=u", "=v") for s in (10, 100)]
    cells = spark.createDataFrame(rows, "m0 string, m1 string, size long, n long")
    goals = {"m0": {"=x": 1500.0, "=y": 3000.0}, "m1": {"=u": 2500.0, "=v": 2000.0}}
    got = mixing.balance(cells, goals).collect()
    for m, told in goals.items():
        for v, goal in told.items():
            assert sum(r["n"] * r["size"] * r["rate"] for r in got if r[m] == v) == pytest.approx(goal, rel=1e-3)


def test_mixed_repeats_rows(spark, docs):
    told = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    assert collections.Counter(r["doc_id"] for r in got.collect()) == {k: v for k, v in told.items() if v}
    alike = spark.createDataFrame([(None if i % 2 else 1, f"a b {i} d e", "s") for i in range(37)] + [(100 + i, "x y z", "t") for i in range(40)], "doc_id long, text string, source string")
    told = collections.Counter()
    for r in mixing.mix(alike).collect():
        told[r["doc_id"]] += r["copies"]
    assert collections.Counter(r["doc_id"] for r in mixing.mixed(alike).collect()) == collections.Counter({k: v for k, v in told.items() if v}) and told[None] % 18
    assert max(collections.Counter(r["text"] for r in mixing.mixed(alike).where("source = 's'").collect()).values()) <= 2


def test_rates_are_the_point_of_least_entropy(spark):
    """Against a plain solver of the same convex problem: projected gradient ascent of the dual by bisection."""
    rng = np.random.default_rng(8)
    sizes = {m: rng.integers(1, 400, 30) for m in ("=a", "=b")}
    goals = {m: 0.6 * float(s.sum()) for m, s in sizes.items()}
    cells = spark.createDataFrame([(m, int(x), 1) for m, s in sizes.items() for x in s], "m0 string, size long, n long")
    got = collections.defaultdict(list)
    for r in mixing.balance(cells, {"m0": goals}).collect():
        got[r["m0"]].append((r["size"], r["rate"]))
    for m, pairs in got.items():
        x = np.array([p[0] for p in pairs], float)
        z, low, high = np.log2(1 + x) / 10, -50.0, 50.0
        while high - low > 1e-12:
            mid = (low + high) / 2
            low, high = (mid, high) if (x * 2 / (1 + np.exp(-z * mid))).sum() < goals[m] else (low, mid)
        assert np.allclose([p[1] for p in pairs], 2 / (1 + np.exp(-z * low)), atol=1e-4)
    with pytest.raises(ValueError, match="no rates"):
        both = spark.createDataFrame([("=x", "=u", 10, 5)], "m0 string, m1 string, size long, n long")
        mixing.balance(both, {"m0": {"=x": 20.0}, "m1": {"=u": 70.0}}).collect()


def test_small_targets_are_met_beside_huge_ones(spark):
    rows = [("=big", 1_000_000, 1_000_000), ("=fixed", 1_000_000, 1_000_000), ("=small", 3, 400), ("=small", 40, 30), ("=mid", 7, 90_000)]
    cells = spark.createDataFrame(rows, "m0 string, size long, n long")
    goals = {"=big": 7e11, "=fixed": 2e12, "=small": 1234.0, "=mid": 777_777.0}
    sums = collections.Counter()
    for r in mixing.balance(cells, {"m0": goals}).collect():
        sums[r["m0"]] += r["size"] * r["n"] * r["rate"]
    for value, goal in goals.items():
        assert sums[value] == pytest.approx(goal, rel=1e-3)


def test_mix_of_empty_and_clashing_tables(spark, docs):
    assert mixing.mixed(documents(spark)).count() >= mixing.mixed(docs).count()
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mixed(empty(spark)).count() == 0


# ------------------------------------------------------------------ 2 sketches


def _told(rows):
    """op2's columns by a plain program: rows (id, text) in order; sketches only as sets of their hex digits."""
    out = []
    for i, (k, text) in enumerate(rows):
        follow, n = rows[(i + 1) % len(rows)][1], len(text) // 4
        changed = text[: len(text) - n] + follow[:n]
        out.append((k, len(text), sha(changed), changed, follow))
    return out


def _likeness(a, b):
    a, b = ({x[i : i + 16] for i in range(0, len(x), 16)} for x in (a, b))
    return len(a & b) / min(len(a), len(b)) if a and b else float(a == b)


def _check_fingerprints(got, rows):
    """got: op2's rows in order; rows: (id, text) in the same order."""
    shown = {t: r["fingerprint"] for (_, t), r in zip(rows, got, strict=True)}
    for r, (k, n, digest, changed, follow) in zip(got, _told(rows), strict=True):
        assert (r["doc_id"], r["n_chars"], r["edited_sha256"]) == (k, n, digest)
        assert r["near_edited"] == _likeness(r["fingerprint"], r["edited_fingerprint"]) and r["near_next"] == _likeness(r["fingerprint"], shown[follow])
        assert changed not in shown or shown[changed] == r["edited_fingerprint"]
    for (_, t), r in zip(rows, got, strict=True):
        w = words(t)
        true = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        size = len(r["fingerprint"]) // 16
        assert abs(size - len(true) / 8) <= 4 * np.sqrt(len(true) / 8 + 1) + 1


def test_fingerprints(spark, docs, own):
    got = sorted(sketches.compared(docs).collect(), key=lambda r: r["doc_id"])
    _check_fingerprints(got, [(k, own[k] or "") for k in sorted(own)])
    assert got[0]["fingerprint"] == got[1]["fingerprint"] and got[0]["near_next"] == 1.0 and got[4]["fingerprint"] == ""
    plainly = {r["doc_id"]: r["fingerprint"] for r in sketches.fingerprints(docs).collect()}
    assert plainly == {r["doc_id"]: r["fingerprint"] for r in got}
    assert sketches.compared(documents(spark)).count() == len(own) + 1
    assert sketches.compared(empty(spark)).count() == 0


@pytest.mark.parametrize("ids", ["large", "strings", "null", "some null", "equal"])
def test_fingerprints_follow_any_ids(spark, monkeypatch, ids):
    monkeypatch.setattr(sketches, "BLOCK_ROWS", 40)
    texts = [" ".join(f"{i}w{j % 11}" for j in range(i % 23)) for i in range(300)]
    made = {"large": lambda i: (1 << 60) + i, "strings": lambda i: f"id{i:04}", "null": lambda i: None, "some null": lambda i: i if i % 3 else None, "equal": lambda i: i // 50}[ids]
    kind = "string" if ids == "strings" else "long"
    df = spark.createDataFrame([(made(i), t) for i, t in enumerate(texts)], f"doc_id {kind}, text string")
    h = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    rows = sorted(((made(i), t) for i, t in enumerate(texts)), key=lambda x: (x[0] is not None, x[0] if x[0] is not None else 0, h[x[1]]))
    edited = {digest: n for n, (_, _, digest, _, _) in enumerate(_told(rows))}
    got = sketches.compared(df.repartition(7)).collect()
    assert len(got) == len(rows)
    if ids in ("large", "strings"):
        _check_fingerprints(sorted(got, key=lambda r: r["doc_id"]), rows)
    assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == collections.Counter(x[:3] for x in _told(rows)) and edited


@pytest.mark.parametrize("kind", ["whole", "text", "mixed"])
def test_bounds_are_found_in_arrays_as_in_tuples(kind):
    import random

    r = random.Random(kind)
    key = {"whole": lambda: r.randint(-40, 40), "text": lambda: r.choice("abcäß"), "mixed": lambda: r.choice([None, 3, 5])}[kind]
    order = lambda p: (p[0] is not None, p[0] if p[0] is not None else 0, p[1])
    places = sorted({(key(), r.randint(-3, 3)) for _ in range(300)}, key=order)
    bounds = places[:: max(1, len(places) // 40)]
    find = sketches._numbers(bounds)
    got = find(pa.array([p[0] for p in places]), pa.array([p[1] for p in places], pa.int64())).to_pylist()
    for place, number in zip(places, got, strict=True):
        block = max(i for i, b in enumerate(bounds) if order(b) <= order(place))
        assert number == 2 * block + (bounds[block] == place)


def test_many_bounds_reach_tasks_at_once(spark, monkeypatch):
    import time

    monkeypatch.setattr(sketches, "BLOCK_ROWS", 1)
    monkeypatch.setattr(sketches, "MAX_BLOCKS", 2_000)
    df = spark.range(4_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b c d e "), "id").alias("text"))
    began = time.time()
    made = sketches.in_blocks(df, "doc_id", "text")
    assert time.time() - began < 25 and made.count() > 4_000


def test_sketches_merge_and_estimate():
    r = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(5000)]
    big = " ".join(r.choice(vocabulary, 20_000))
    small = " ".join(big.split()[1000:4000])
    a, b, both = (sketches.sketches(*sketches._packed([t]))[0] for t in (big, small, big + "\n" + small))
    assert abs(sketches.likeness(a, b) - 1) < 0.02
    assert len(np.setxor1d(sketches.merged(a, b), both)) <= 4


# ------------------------------------------------------------------ 3 resharding


def _cheapest(supply, capacity, cost):
    if not supply:
        return 0
    best = 10**9

    def split(j, left, room, paid):
        nonlocal best
        if j == len(capacity):
            if not left:
                best = min(best, paid + _cheapest(supply[1:], room, cost[1:]))
            return
        for x in range(min(left, room[j]) + 1):
            split(j + 1, left - x, [*room[:j], room[j] - x, *room[j + 1 :]], paid + x * cost[0][j])

    split(0, supply[0], list(capacity), 0)
    return best


def test_min_cost_flow():
    r = np.random.default_rng(3)
    for _ in range(60):
        m, n = r.integers(1, 4, 2)
        supply, capacity, cost = r.integers(0, 5, m).tolist(), r.integers(0, 5, n).tolist(), r.integers(0, 6, (m, n))
        capacity[0] += max(0, sum(supply) - sum(capacity))
        flow = resharding.min_cost_flow(supply, capacity, cost)
        assert flow.sum(1).tolist() == supply and (flow.sum(0) <= capacity).all() and (flow >= 0).all()
        assert (flow * cost).sum() == _cheapest(supply, capacity, cost.tolist())


def test_flows_of_equal_moves_are_of_least_cost():
    import random
    import time

    r = random.Random(3)
    for _ in range(40):
        old = {o: r.randint(0, 30) for o in r.sample(range(12), r.randint(1, 8))}
        n = r.randint(1, 9)
        room = [c + r.randint(0, 3) for c in resharding.even_capacities(sum(old.values()), n)]
        cost = (np.array(sorted(old))[:, None] != np.arange(n)[None, :]).astype(float)
        best = resharding.min_cost_flow([old[o] for o in sorted(old)], room, cost)
        arcs = resharding.stay_flow(old, room)
        assert sum(b for o, j, b in arcs if o != j) == (best * cost).sum()
        for o, size in old.items():
            assert sum(b for x, _, b in arcs if x == o) == size
        assert all(sum(b for _, y, b in arcs if y == j) <= room[j] for j in range(n))
    big = {o: r.randint(0, 10**12) for o in range(8_000)}
    began = time.time()
    blocks = resharding.transfers(big, resharding.even_capacities(sum(big.values()), 10_000))
    assert time.time() - began < 5 and sum(b - a for _, _, a, b in blocks) == sum(big.values()) and len(blocks) < 28_000


def test_resharding_is_even_gapless_and_moves_little(spark):
    rows = [(i, "t" * (i * 37 % 501), 0 if i % 3 else i % 5) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, old int")
    sized = resharding.sized(df, F.col("old"))
    got = resharding.slots(common.materialize(resharding.reshard(sized, 8), "t"), ["key"]).collect()
    assert len(got) == 3000
    load, slot, moved = collections.Counter(), collections.defaultdict(list), 0
    for r in got:
        load[r["shard"]] += r["size"]
        slot[r["shard"]].append(r["slot"])
        moved += r["size"] * (r["old_shard"] != r["shard"])
    assert sorted(load) == list(range(8)) and max(load.values()) - min(load.values()) < 1500
    assert all(sorted(v) == list(range(len(v))) for v in slot.values())
    old = collections.Counter()
    for r in got:
        old[r["old_shard"]] += r["size"]
    least = sum(max(0, v - sum(load.values()) / 8) for v in old.values())
    assert moved <= least * 1.01 + 1500


def test_resharding_edges(spark):
    df = documents(spark)
    got = resharding.slots(common.materialize(resharding.reshard(resharding.sized(df, F.pmod("doc_id", F.lit(3))), 4, order=("key", "text_crc32")), "t"), ["key"])
    assert got.count() == df.count()
    assert resharding.reshard(resharding.sized(empty(spark), F.lit(0)), 4).count() == 0


def test_resharding_query_against_a_plain_program(spark, tmp_path):
    import zlib

    rows = [(i, None if i % 7 == 0 else ("é" * (i % 40) + "x"), "hot" if i % 3 else f"s{i % 11}") for i in range(900)] + [(5, "same", "hot")] * 30 + [(None, "same", None)] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = resharding.op3_resharding(spark, folder(df, tmp_path)).collect()
    told = collections.Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == told
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append((r["slot"], r["size"]))
    assert sorted(by) == list(range(40)) and all(sorted(s for s, _ in v) == list(range(len(v))) for v in by.values())
    sizes = [sum(n for _, n in v) for v in by.values()]
    assert max(sizes) - min(sizes) <= 2 * max(n for v in by.values() for _, n in v)
    with pytest.raises(ValueError):
        resharding.rewrite(spark, "/x/y", "/x/y/", 3)


def test_rewrite_leaves_even_shards_alone(spark, tmp_path):
    rows = [(i, f"{i:0100d}", 0 if i < 300 else 1 if i < 500 else 2) for i in range(700)]
    spark.createDataFrame(rows, "doc_id long, text string, shard int").write.partitionBy("shard").parquet(f"{tmp_path}/old")
    where = {r["shard"]: r["path"] for r in resharding.rewrite(spark, f"{tmp_path}/old", f"{tmp_path}/new", 3).collect()}
    even = resharding.even_capacities(700 * 116, 3)
    assert len(where) == 3 and any("/new/" in p for p in where.values())
    back = [spark.read.parquet(p) for p in where.values()]
    ids = sorted(r["doc_id"] for b in back for r in b.select("doc_id").collect())
    assert ids == list(range(700)) and max(even) - min(even) <= 1


# ------------------------------------------------------------------ 4 SimHash


def simhash_of(text, k=3):
    found = (text or "").encode().lower().split()
    parts = [b" ".join(found[i : i + k]) for i in range(len(found) - k + 1)] or ([b" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(spark, own, docs):
    got = {r["doc_id"]: r for r in simhash.linked(docs).collect()}
    told = {i: simhash_of(t) for i, t in own.items()}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == told
    for i in told:
        reach, todo = {i}, [i]
        while todo:
            a = todo.pop()
            for b in told:
                if b not in reach and (told[a] ^ told[b]).bit_count() <= 2:
                    reach.add(b)
                    todo.append(b)
        assert got[i]["component_id"] == min(reach)
    assert simhash.linked(documents(spark)).count() == len(own) + 1
    assert simhash.linked(empty(spark)).count() == 0


def test_trees_find_every_link():
    r = np.random.default_rng(5)
    base = r.integers(0, 2**63, 2000, dtype=np.uint64)
    near = base[r.integers(0, 2000, 1500)]
    for k in range(3):
        near = near ^ (np.uint64(1) << r.integers(0, 64, 1500, dtype=np.uint64)) if k < 2 else near
    fp = np.unique(np.concatenate((base, near)))
    told = simhash.Forest(len(fp))
    simhash._tiles(fp, np.arange(len(fp)), np.arange(len(fp)), 2, told)
    assert (simhash.search(fp, np.ones(len(fp), bool), 2).root == told.root).all()
    shard, at, home = simhash.Tree(fp[::3], 4).deal(fp, 2)
    got = simhash.Forest(len(fp))
    for s in np.unique(shard):
        mine = shard == s
        got.join(at[mine], at[mine][simhash.search(fp[at[mine]], home[mine], 2).root])
    assert home.sum() == len(fp) and (got.root == told.root).all()


def test_near_groups(spark, docs, own):
    got = {r["doc_id"]: r["keeper"] for r in simhash.near_groups(docs).collect()}
    assert got[1] == got[2] == 0 and got[9] == 8 and got[16] == 16 and got[4] == got[5] == 3
    kept = simhash.deduplicated(documents(spark))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, k in got.items() if i == k)
    assert kept.columns == documents(spark).columns
    assert simhash.deduplicated(empty(spark)).count() == 0


def test_near_groups_search_fingerprints_by_trees(spark, monkeypatch):
    rng = np.random.default_rng(11)
    base = rng.integers(-(1 << 62), 1 << 62, 200)
    fp = np.concatenate((base, base[:60] ^ 5, base[:20], [0, 3]))
    rows = [(i, int(f)) for i, f in enumerate(fp)]
    got = simhash._near_fingerprints(spark.createDataFrame(rows, "t long, fp long"), 2).collect()
    forest = simhash.Forest(len(fp))
    forest.join(*np.array([(r["a"], r["b"]) for r in got]).T)
    near = np.bitwise_count(fp.view(np.uint64)[:, None] ^ fp.view(np.uint64)[None, :]) <= 2
    told = simhash.Forest(len(fp))
    told.join(*np.nonzero(near))
    assert (forest.root == told.root).all() and (told.root != np.arange(len(fp))).sum() == 81

    held, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda *a: held.append(a[1]) or links(*a))
    simhash.deduplicated(documents(spark))
    assert held == [2]


def test_near_dedup_keeps_texts_of_null_and_equal_ids(spark):
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(80)) for x in "abcde")
    rows = [(None, a), (None, b), (None, a.upper()), (7, c), (7, d), (8, c), (3, e), (3, d), (9, b)]
    got = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"].lower()) for r in got) == [(0, a), (3, d), (3, e), (7, c), (9, b)]


def chained(rng, n, kept):
    """Two texts of n and kept distinct words, the second a prefix: likeness (kept - 4) / (n - 4) of five-word shingles."""
    x = [f"{i}-{rng.integers(1 << 40)}" for i in range(n)]
    return " ".join(x), " ".join(x[:kept])


def test_internal_names_do_not_clash(spark):
    df = spark.createDataFrame([(1, "mail a@b.org now", "x", "y", "z", "e"), (2, "mail a@b.org now", "x", "y", "z", "e")], "doc_id long, text string, _tid string, _TID_ string, _places string, _email string")
    got = simhash.deduplicated(df)
    assert got.columns == df.columns and [tuple(r) for r in got.collect()] == [tuple(df.first())]
    spans = pii.all_spans(df)
    assert spans.columns == [*df.columns, "base", "spans"] and {r["_email"] for r in spans.collect()} == {"e"}


def test_near_groups_decides_long_texts_by_whole_sets(spark):
    rng, rows = np.random.default_rng(4), []
    for i in range(40):  # 2,000 shingles: likeness 0.8 and 0.7995
        rows += [(4 * i + j, x) for j, x in enumerate((*chained(rng, 2004, 1604), *chained(rng, 2004, 1603)))]
    got = {r["doc_id"]: r["keeper"] for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = [i for i in range(40) if got[4 * i + 1] == 4 * i]
    assert all(got[4 * i + 3] == 4 * i + 3 for i in range(40)) and len(linked) >= 30


def test_near_groups_links_texts_with_a_repeated_line(spark):
    rng, rows = np.random.default_rng(5), []
    for i in range(40):  # likeness over 0.9, the line's repeats turn the fingerprint
        x, line = (" ".join(f"{j}-{rng.integers(1 << 40)}" for j in range(n)) for n in (204, 10))
        rows += [(2 * i, x), (2 * i + 1, x + f" {line}" * 18)]
    got = {r["doc_id"]: r["keeper"] for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * i + 1] == 2 * i for i in range(40)) >= 39


def test_near_groups_links_pairs_without_a_common_lowest_hash(spark):
    rng = np.random.default_rng(6)
    while True:  # likeness 0.8, and none of the four lowest hashes is shared
        pair = chained(rng, 104, 84)
        low = [set(h[:4].tolist()) for h in simhash._shingles(pa.array(pair), 5)]
        if not low[0] & low[1]:
            break
    got = simhash.near_groups(spark.createDataFrame(list(enumerate(pair)), "doc_id long, text string")).collect()
    assert {r["keeper"] for r in got} == {0}


def test_near_groups_of_common_passages_equal_all_pairs(spark, monkeypatch):
    for name, value in {"SAMPLED": 1, "OFTEN": 3, "STARS": 2, "BLOCK": 4}.items():
        monkeypatch.setattr(simhash, name, value)
    rng = np.random.default_rng(7)
    passages = [[f"p{i}-{j}" for j in range(60)] for i in range(3)]
    texts = []
    for _ in range(150):
        x = passages[rng.integers(3)] + [f"o{rng.integers(1 << 40)}" for _ in range(rng.integers(2, 20))]
        texts += [x, x[: len(x) - rng.integers(0, 14)]][: rng.integers(1, 3)]
    sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in texts]
    told = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8 and told[i] != told[j]:
                told = [min(told[i], told[j]) if r in (told[i], told[j]) else r for r in told]
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["keeper"] for r in simhash.near_groups(df).collect()}
    assert [got[i] for i in range(len(texts))] == told and 10 < len(set(told)) < len(texts)


@pytest.mark.parametrize("n", [60, 1000, 5000])
def test_near_groups_recall_against_all_pairs(spark, n):
    rng, texts = np.random.default_rng(n), []
    for _ in range(30):
        x = [f"w{rng.integers(1 << 30)}" for _ in range(n)]
        y = list(x)
        for i in rng.choice(n, max(1, n // 60), replace=False):
            y[i] = f"v{rng.integers(1 << 30)}"
        texts += [x, y]
    sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in texts]
    told = {(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8}
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["keeper"] for r in simhash.near_groups(df).collect()}
    found = {(i, j) for i, j in told if got[i] == got[j]}
    print(f"{n} words: {len(found)} of {len(told)} pairs")
    assert found == told and len(told) >= 10 and len(set(got.values())) == len(texts) - len(told)


# ------------------------------------------------------------------ 5 language models


def test_losses_equal_a_plain_model(spark, monkeypatch):
    rows = [(i, " ".join("abcdefg"[(i * j + j) % 7] for j in range(i % 9)), i % 2 == 0) for i in range(40)] + [(99, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, good boolean")
    good = df.where("good").select("doc_id")
    monkeypatch.setattr(lm, "BATCH_BYTES", 30)  # several batches and slices
    monkeypatch.setattr(lm, "SLICE_GRAMS", 16)
    got = {r["doc_id"]: r for r in lm.score(df.repartition(3), good).collect()}
    size_of_all = len({w for _, t, _ in rows for w in words(t)})
    for i, text, is_good in rows:
        own = words(text)
        assert got[i]["n_words"] == len(own)
        if not own:
            assert got[i]["score"] is None
            continue
        bits = []
        for target in (True, False):
            uni, pair, starts = collections.Counter(), collections.Counter(), 0
            for j, t, g in rows:
                if (g or not target) and not (j == i):
                    w = words(t)
                    uni.update(w)
                    starts += bool(w)
                    pair.update(zip([None, *w], w))
            size = sum(len(words(t)) for _, t, g in rows if g)
            scale = 1.0 if target else size / sum(len(words(t)) for _, t, _ in rows)
            n = sum(uni.values()) * scale
            loss = 0.0
            for a, b in zip([None, *own], own):
                alone = (uni[b] * scale + 1) / (n + size_of_all)
                loss -= np.log2((pair[a, b] * scale + lm.BACKOFF * alone) / ((starts if a is None else uni[a]) * scale + lm.BACKOFF))
            bits.append(loss / len(own))
        assert got[i]["target_bits"] == pytest.approx(bits[0], rel=1e-5)
        assert got[i]["background_bits"] == pytest.approx(bits[1], rel=1e-5)
    assert lm.score(empty(spark), good).count() == 0 and lm.score(df, good.limit(0)).count() == len(rows)
    odd = lm.score(documents(spark).withColumn("doc_id", F.when(F.col("doc_id") > 3, F.col("doc_id"))), good)
    assert odd.count() == documents(spark).count() and odd.where("doc_id is null and score is not null").count() > 0


def test_scores_tell_held_out_documents_apart(spark):
    r = np.random.default_rng(2)
    a, b = [f"a{i}" for i in range(50)], [f"b{i}" for i in range(50)]
    rows = [(i, " ".join(r.choice(a if i % 2 else b, 40)), i % 2 == 1 and i < 100) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, good boolean")
    got = {x["doc_id"]: x["score"] for x in lm.score(df, df.where("good").select("doc_id")).collect()}
    held = [(got[i], i % 2) for i in range(100, 200)]
    assert min(s for s, y in held if y) > max(s for s, y in held if not y)


# ------------------------------------------------------------------ 6 WARC


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "u", "aa"), (2, None, "aa"), (3, "u\r\nx", None), (4, "v", ""), (5, "u", "b\r\n\r\nWARC/1.1"), (6, "u", "é" * 70_000), (7, "u", "aa")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.write(warc.to_records(df), path)
    got = {r["record_id"]: r for r in warc.read(spark, path).collect()}
    assert len(got) == 7
    for i, _, html in rows:
        r = got[f"<urn:page:{i}>"]
        first = min(j for j, _, h in rows if (h or "") == (html or ""))
        assert r["record_type"] == ("response" if i == first else "revisit")
        assert r["refers_to"] == (None if i == first else f"<urn:page:{first}>")
        assert r["payload_digest"] == "sha1:" + warc.digest_of((html or "").encode()) and r["payload_length"] == len((html or "").encode())
        assert i != first or bytes(r["payload"]) == (html or "").encode()
    part = warc.read(spark, path, "record_id string").where("record_id = '<urn:page:5>'")
    assert part.count() == 1
    assert warc.read(spark, path).where("target_uri like 'u%' and record_type in ('revisit')").count() == 1
    bigger = {r["record_id"]: r["record_type"] for r in warc.to_records(df, least_bytes=3).collect()}
    assert set(bigger.values()) == {"response"}
    warc.write(warc.to_records(df.limit(0)), f"file://{tmp_path}/none")
    assert warc.read(spark, f"file://{tmp_path}/none").count() == 0


def test_warc_keeps_payloads_of_pages_that_share_an_id(spark, tmp_path):
    rows = [(1, "A"), (2, "C"), (5, "A"), (5, "B"), (5, "C"), (5, "C"), (None, "A"), (None, "B"), (7, None), (8, "")]
    df = spark.createDataFrame([(i, "u", h, "sha", 1, "key") for i, h in rows], "page_id long, url string, html string, sha1 string, n long, key string")
    path = f"file://{tmp_path}/warc"
    warc.write(warc.to_records(df), path)
    got = warc.read(spark, path).collect()
    told = collections.Counter((r["record_id"], r["record_type"], r["refers_to"], r["payload_digest"]) for r in got)
    urn = lambda i: f"<urn:page:{'' if i is None else i}>"
    first = {"A": 1, "C": 2, "B": 5, "": 7}
    plain = collections.Counter()
    for i, h in rows:
        h = h or ""
        again = i is not None and i > first[h]
        plain[urn(i), "revisit" if again else "response", urn(first[h]) if again else None, "sha1:" + warc.digest_of(h.encode())] += 1
    assert told == plain
    assert {r["payload"] for r in warc.read(spark, path).where("record_type = 'response'").collect()} >= {b"A", b"B", b"C"}


def test_warc_reads_other_writers_files():
    import gzip
    import io

    said = [(f"<urn:page:{i}>", bytes([65 + i]) * (20_000 * i)) for i in range(5)]
    raw = [warc.record("response", i, p, "http://x/") for i, p in said]
    for packed in (b"".join(raw), b"".join(map(gzip.compress, raw)), b"".join(map(warc.member, raw))):
        assert [p for _, p in warc.records(io.BytesIO(packed), lambda h: (True, True))] == [p for _, p in said]
        assert [h["WARC-Record-ID"] for h, _ in warc.records(io.BytesIO(packed), lambda h: (h["WARC-Record-ID"] == "<urn:page:3>", False))] == ["<urn:page:3>"]


# ------------------------------------------------------------------ 7 BPE


def test_bpe_equals_tiktoken(spark, docs, own):
    import tiktoken

    path, pattern = bpe.vocabulary()
    told = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    got = {r["doc_id"]: r for r in bpe.round_trip(docs, path, pattern).collect()}
    full = {r["doc_id"]: r for r in bpe.decode(bpe.encode(docs, path, pattern), path, pattern).collect()}
    for i, text in own.items():
        ids = told.encode_ordinary(text or "")
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == sha(" ".join(map(str, ids))) and got[i]["decoded_sha256"] == sha(text or "")
        assert full[i]["ids"] == ids and full[i]["decoded_text"] == (text or "") and full[i]["text"] == text
        if ids and len(ids) < 400:
            _, starts = told.decode_with_offsets(ids)
            assert full[i]["starts"] == starts
    assert bpe.coded(empty(spark), path, pattern).count() == 0


# ------------------------------------------------------------------ 8 quality


def test_quality_counts_and_verdicts(spark, docs, own):
    got = {r["doc_id"]: r for r in quality.judge(docs, ["doc_id"]).collect()}
    for i, text in own.items():
        w, lines, seen, dup = words(text), (text or "").split("\n"), set(), 0
        for x in lines:
            if words(x):
                dup += x in seen
                seen.add(x)
        at = collections.defaultdict(list)
        for j in range(len(w) - 2):
            at[tuple(w[j : j + 3])].append(j)
        covered = {j + d for v in at.values() if len(v) > 1 for j in v for d in range(3)}
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered), failed)
        assert not (failed and r["kept"])
    kept = quality.passing(documents(spark))
    assert kept.columns == documents(spark).columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}
    assert quality.judge(empty(spark), ["doc_id"]).count() == 0


def test_quality_tells_junk_from_prose(spark):
    r = np.random.default_rng(4)
    common_words = ["the", "of", "and", "to", "in"]
    make = lambda: " ".join(r.choice(common_words) if r.random() < 0.4 else "".join(r.choice(list("etaoinshrd"), 6)) for _ in range(120))
    rows = [(i, make(), "en") for i in range(60)] + [(100, make().replace(" ", "### "), "en"), (101, make().upper(), "en"), (102, " ".join("".join(r.choice(list("etaoinshrd"), 6)) for _ in range(120)), "en")]
    got = {x["doc_id"]: x["kept"] for x in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), ["doc_id"]).collect()}
    assert all(got[i] for i in range(60)) and not any(got[i] for i in (100, 101, 102))


def test_jensen_shannon():
    assert quality.distances(np.array([[1.0, 0], [0, 3], [0, 0]]), np.array([1.0, 0])) == pytest.approx([0, 1, 0])


# ------------------------------------------------------------------ 9 substrings


def test_repeated_passages(spark, docs, own):
    got = {r["doc_id"]: r for r in substrings.without_repeats(docs, window=50).collect()}
    first = {}
    for i in sorted(own):
        w = words(own[i])
        keys = [tuple(w[j : j + 50]) for j in range(len(w) - 49)]
        gone = {j + d for j, key in enumerate(keys) if first.get(key, i) < i for d in range(50)}
        for key in keys:
            first.setdefault(key, i)
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"], got[i]["kept_text"]) == (len(w), len(gone), sha(kept), kept)
    assert got[1]["n_removed"] == got[1]["n_words"] and got[10]["n_removed"] == 70
    assert substrings.without_repeats(documents(spark)).count() == len(own) + 1
    assert substrings.without_repeats(empty(spark)).count() == 0


def test_count_min_never_undercounts(spark, monkeypatch):
    monkeypatch.setattr(substrings, "LOAD", 1)  # a crowded table
    monkeypatch.setattr(substrings, "SLICE", 64)
    rng = np.random.default_rng(9)
    keys = rng.integers(-(1 << 63), (1 << 63) - 1, 400)
    lists = [[int(keys[j]) for j in rng.integers(0, 400, rng.integers(0, 30))] for _ in range(60)]
    times = collections.Counter(k for x in lists for k in x)
    sketch = substrings.Sketch(sum(times.values()))
    told = {r["counter"] for r in sketch.repeated(spark.createDataFrame([(x,) for x in lists], "cells array<long>").repartition(7)).collect()}
    both = np.stack(sketch.counters(np.array(list(times), np.int64)))
    shown = spark.createDataFrame([(int(k),) for k in times], "cell long").select(*[c.alias(f"c{i}") for i, c in enumerate(sketch.columns("cell"))]).collect()
    assert [tuple(r) for r in shown] == [tuple(int(x) for x in both[:, i]) for i in range(len(times))]
    estimated = {k for i, k in enumerate(times) if all(int(x) in told for x in both[:, i])}
    assert {k for k, n in times.items() if n > 1} <= estimated
    exact = collections.Counter(int(x) for k, n in times.items() for x in np.concatenate(sketch.counters(np.array([k], np.int64))) for _ in range(n))
    assert told == {c for c, n in exact.items() if n > 1}


def test_repeats_of_a_hot_passage_and_null_ids(spark):
    r = np.random.default_rng(2)
    word = lambda n: [f"w{r.integers(1 << 30)}" for _ in range(n)]
    passage = word(60)
    rows = [(i if i > 2 else None, " ".join(word(30) + passage + word(int(r.integers(0, 30))))) for i in range(200)]
    got = substrings.without_repeats(spark.createDataFrame(rows, "doc_id int, text string"))
    removed = [x["n_removed"] for x in got.where("doc_id is not null").collect()]
    assert removed == [60] * 197 and [x["n_removed"] for x in got.where("doc_id is null").collect()] == [0] * 3
    with pytest.raises(TypeError):
        substrings.without_repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


# ------------------------------------------------------------------ 10 personal data

RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (c > "4") for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, rule) in enumerate(RULES.items()):
        for m in re.finditer(rule, text):
            d = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_personal_data(spark, docs, own, tmp_path):
    r = np.random.default_rng(6)
    mixed = ["".join(r.choice(list("a.@-_+ 0123456789()é😀xA%"), r.integers(0, 60))) for _ in range(400)]
    mixed += ["1.2.3.4.5.6.7.8", "999.1.2.3.4.5.6.7", "a@b.com_foo@bar.org", "4111-1111-1111-1111-", "1." * 4000, "+" * 3000 + "1 2" * 2000]
    df = spark.createDataFrame([(100 + i, t) for i, t in enumerate(mixed)] + list(own.items()), "doc_id long, text string").repartition(4)
    got = {x["doc_id"]: x for x in pii.op10_pii(spark, folder(df, tmp_path)).collect()}
    for i, t in [*((100 + i, t) for i, t in enumerate(mixed)), *own.items()]:
        told = base_spans(t or "")
        assert got[i]["base_sha256"] == sha(told), t
        assert set(told.split(",")) - {""} <= set(got[i]["spans"].split(","))
        assert got[i]["n_email"] == told.count("email:")
    assert "secret:7:39" in got[15]["spans"]
    assert pii.redacted(docs).where("doc_id = 14").first()["text"] == "mail [EMAIL], [IP] and [PHONE] or [CARD]"
    same = {x["doc_id"]: x["text"] for x in pii.redacted(docs).collect()}
    assert same[3] is None and same[0] == own[0] and pii.redacted(docs).columns == docs.columns
    assert pii.all_spans(empty(spark)).count() == 0


def test_many_matches_in_one_text(spark):
    import time

    secret = "0123456789abcdef0123456789abcdef"
    text = "".join(f'user{i}@example.org said token = "{secret}" é {i} ' for i in range(60_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.time()
    row = pii.redacted(df).select("text", F.size(pii.in_blocks(F.col("text"))).alias("n")).first()
    assert row["text"] == "".join(f'[EMAIL] said token = "[SECRET]" é {i} ' for i in range(60_000)) and time.time() - start < 60
    spans = pii.all_spans(df).select(F.size("base").alias("b"), F.size("spans").alias("s"), F.element_at("spans", -1)["end"].alias("e")).first()
    assert (spans["b"], spans["s"]) == (60_000, 120_000) and text[: spans["e"]].endswith(secret)


def test_running_sums_and_searches(spark):
    r = np.random.default_rng(1)
    values = r.integers(0, 50, 1000).tolist()
    df = spark.createDataFrame([(values, sorted(values)), ([], []), ([7], [7])], "v array<int>, s array<int>")
    got = df.select(pii.running(F.col("v"), lambda a, b: a + b).alias("sum"), pii.running(F.col("v"), F.greatest).alias("most"), F.transform(F.array(*map(F.lit, (0, 7, 25, 99))), lambda x: pii.below(F.col("s"), x)).alias("below")).collect()
    assert got[0]["sum"] == np.cumsum(values).tolist() and got[0]["most"] == np.maximum.accumulate(values).tolist()
    assert got[0]["below"] == [sum(x < y for x in values) for y in (0, 7, 25, 99)] and got[1]["sum"] == [] and got[1]["below"] == [0] * 4 and got[2]["below"] == [0, 0, 1, 1]
    text = "aé😀" * 2000
    cuts = spark.createDataFrame([(text, i, n) for i, n in ((0, 0), (0, 5), (1023, 2), (1024, 1024), (5000, 5000), (5999, 1), (6000, 3), (10, 4000))], "t string, i int, n int")
    assert all(x["c"] == text[x["i"] : x["i"] + x["n"]] for x in cuts.select("*", pii.cut(pii.in_blocks(F.col("t")), F.col("i"), F.col("n")).alias("c")).collect())


def test_long_and_letters_only_secrets_are_candidates(spark):
    r = np.random.default_rng(5)
    letters = "".join(r.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"), 40))
    long = "".join(r.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), 700))
    rows = [(1, f'api_key = "{letters}"'), (2, f"secret: {long} end"), (3, "the internationalization-of-telecommunications matters"), (4, None)]
    got = {x["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in x["spans"]] for x in pii.all_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [("secret", 11, 51)], 2: [("secret", 8, 708)], 3: [], 4: []}


def test_trees_hold_out(spark):
    trees, limit = pii.model(spark)
    said = pii.examples(600, seed=99)
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(said)], "i int, g int, v string, b string, a string, y int")
    parts = [rows.where(f"g = {g}").select("y", pii.scored(trees, pii.features(g, F.col("v"), F.col("b"), F.col("a"))).alias("s")) for g in range(3)]
    got = [(x["y"], x["s"] >= limit) for p in parts for x in p.collect()]
    chosen = [y for y, c in got if c]
    assert sum(chosen) / len(chosen) > 0.95 and sum(chosen) / sum(y for y, _ in got) > 0.8


# ------------------------------------------------------------------ what they share


def test_ranks_are_dense_in_hot_cells(spark, monkeypatch):
    monkeypatch.setattr(common, "BUCKET_ROWS", 50)
    monkeypatch.setattr(common, "LARGE_CELL", 100)
    df = spark.range(2000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('c', id % 40) END AS cell")
    got = collections.defaultdict(list)
    for r in common.ranked(df, ["cell"], ["id"]).collect():
        got[r["cell"]].append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in got.values())


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_word_hashes_tell_words_apart(monkeypatch):
    at, data = sketches._packed(["aa b\taa", "", "b ", "aab"])
    begin, end, first = common.words(at, data)
    h = common.word_hashes(data, begin, end)
    rng = np.random.default_rng(3)
    long = "".join(rng.choice(list("ab "), 5000)) + "z" * 1000 + " " + "z" * 999 + "y end"
    at2, data2 = sketches._packed([long])
    place = common.words(at2, data2)[:2]
    whole = common.word_hashes(data2, *place)
    monkeypatch.setattr(common, "_SPAN", 64)  # the same hashes from spans of any size, words beyond a span too
    assert (common.word_hashes(data2, *place) == whole).all()
    assert first.tolist() == [0, 3, 3, 4, 5] and h[0] == h[2] and h[1] == h[3] and len(set(h.tolist())) == 3
