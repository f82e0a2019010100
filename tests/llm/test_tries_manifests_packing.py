"""Prefix tries, Merkle manifests and packing against plain programs on small tables."""

import collections
import hashlib
import heapq
import itertools
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparloom.llm import merkle, packing, trie

from .fixtures import documents, empty, folder, sha, words

# ------------------------------------------------------------------- 11 trie

TURNS = "conv_id long, turn long, role string, text string, depth long, key string, units string, n_convs long, parent_conv_id long"


def plain_trie(rows):
    """Nodes of the rebuilt conversations: (depth, conv_id) and the rest, by the rules."""
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            unit = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0, unit), (role, text)))
    own = {c: [t for _, t in sorted(x)] for c, x in own.items()}
    convs = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - (c % 20 if c >= 0 else -(-c % 20))
        convs[c] = own.get(base, [])[:h] + turns[h:]
    members = collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for path, held in members.items():
        below = [p for p in members if p[: len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(q[:-1] == p for q in members if q)]
        saved = sum((len(members[p]) - 1) * len(words(p[-1][1])) for p in below if p)
        ends = ",".join(str(c) for c in sorted(held) if len(convs[c]) == len(path))
        out.append((min(held), len(path), min(members[path[:-1]]) if path else None, len(held), len(kids), len(leaves), saved, sha(ends)))
    return collections.Counter(out)


def conversations(seed):
    r = random.Random(seed)
    rows = [(7, None, None, None), (7, None, "user", "null turn"), (7, 1, "user", None), (41, 0, "a", "b c"), (41, 0, "ab", "c"), (41, 0, "a", "b c"), (None, 0, "user", "lost"), (-5, 0, "user", "minus one"), (-20, 0, "user", "minus base"), (900, 3, "user", "short"), (901, 3, "user", "other")]
    for c in [*range(100, 150), 203, 207, 208]:
        for t in range(r.randint(1, 6)):
            rows.append((c, t, r.choice(["user", "assistant"]) if t else "user", " ".join(r.choice(["x", "y"]) for _ in range(1 + t % 3))))
    for c in range(300, 330):  # copies
        rows += [(c, t, "user", f"same {t}") for t in range(4)]
    rows += [(500, t, "user", "w " * (t % 5)) for t in range(60)] + [(501, t, "user", "w " * (t % 5)) for t in range(50)]
    return rows


@pytest.mark.parametrize("range_bytes", [1, 300, 2_000, 1 << 20])
def test_trie_equals_a_plain_program(spark, tmp_path, monkeypatch, range_bytes):
    monkeypatch.setattr(trie.trie, "__defaults__", (range_bytes,))
    rows = conversations(range_bytes)
    df = spark.createDataFrame([(*r, 1, "k", "u", 2, 3) for r in rows], TURNS).repartition(5)
    got = trie.op11_prefix_trie(spark, folder(df, tmp_path, "conversations"))
    assert collections.Counter(map(tuple, got.collect())) == plain_trie(rows)


def test_trie_without_turns(spark, tmp_path):
    assert trie.op11_prefix_trie(spark, folder(spark.createDataFrame([], TURNS), tmp_path, "conversations")).count() == 0
    conv = next(c for c in range(901, 920) if zlib.crc32(str(c).encode()) % 4)  # its base is absent, its turn is replaced
    bare = spark.createDataFrame([(conv, 0, "user", "gone")], "conv_id long, turn long, role string, text string")
    got = trie.op11_prefix_trie(spark, folder(bare, tmp_path / "one", "conversations")).collect()
    assert [tuple(r) for r in got] == [(conv, 0, None, 1, 0, 1, 0, sha(str(conv)))]


def test_trie_names_many_alike_conversations_in_order(spark, monkeypatch):
    monkeypatch.setattr(trie, "RUN", 7)
    rows = spark.range(1000).select((F.col("id") * 20).alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("a b").alias("text"))
    got = trie.trie(trie.rebuilt(rows, F.lit(0), F.col("conv_id"), 1)).orderBy("depth").collect()
    ids = sha(",".join(str(20 * i) for i in range(1000)))
    assert [(r["depth"], r["n_convs"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in got] == [(0, 1000, 1, 1998, sha("")), (1, 1000, 1, 1998, ids)]


# ---------------------------------------------------------------- 12 manifest


def plain_leaf(row):
    return sha("".join("-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in merkle.FIELDS))


def plain_levels(nodes, arity=2):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + arity])) for i in range(0, len(levels[-1]), arity)])
    return levels


def plain_path(levels, at, arity=2):
    out = []
    for level in levels[:-1]:
        first = at - at % arity
        out.append(("".join(level[first:at]), "".join(level[at + 1 : first + arity])))
        at //= arity
    return out


def plain_manifest(rows, arity=2):
    groups = collections.defaultdict(list)
    for row in rows:
        groups[row["lang"]].append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
        trees[g] = plain_levels([plain_leaf(r) for r in groups[g]], arity)
    top = plain_levels([trees[g][-1][0] for g in names], arity)
    out = []
    for i, g in enumerate(names):
        for at, row in enumerate(groups[g]):
            path = plain_path(trees[g], at, arity) + plain_path(top, i, arity)
            given = dict(row)
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0 and row["n_chars"] is not None:
                given["n_chars"] += 1
            folded = plain_leaf(given)
            for left, right in path:
                folded = sha(left + folded + right)
            out.append((row["doc_id"], plain_leaf(row), trees[g][-1][0], top[-1][0], sha("".join(itertools.chain(*path))), folded, folded == top[-1][0]))
    return collections.Counter(out)


DOCS = "doc_id long, source string, lang string, n_chars long, text string, grp string, idx long, n long, hash string, payload string, proof string, root string"


def manifest_rows(n, seed=0):
    r = random.Random(seed)
    rows = [(i if r.random() < 0.95 else None, r.choice([None, "a", "ä:"]), r.choices([None, "", "en", "fr", "Ω"], [1, 1, 20, 4, 1])[0], r.choice([None, i, 0]), r.choice([None, "", f"text {i}", "日本"])) for i in range(n)]
    return rows + rows[:3]  # repeated rows


@pytest.mark.parametrize("n", [1, 33, 150])
def test_manifest_equals_a_plain_program(spark, tmp_path, n):
    rows = manifest_rows(n)
    df = spark.createDataFrame([(*r, "g", 1, 2, "h", "p", "q", "r") for r in rows], DOCS).repartition(4)
    got = merkle.op12_merkle(spark, folder(df, tmp_path)).collect()
    told = plain_manifest([dict(zip(merkle.FIELDS, r, strict=True)) for r in rows])
    assert collections.Counter(map(tuple, got)) == told
    assert n < 33 or len({r["verified"] for r in got}) == 2


@pytest.mark.parametrize("arity,span", [(2, 2), (3, 2)])
def test_any_arity_and_span(spark, arity, span):
    rows = [dict(zip(merkle.FIELDS, r, strict=True)) for r in manifest_rows(90, 5)]
    df = spark.createDataFrame([tuple(r[f] for f in merkle.FIELDS) for r in rows], "doc_id long, source string, lang string, n_chars long, text string")
    got = merkle.verified(merkle.manifest(df, "lang", "doc_id", merkle.FIELDS, arity=arity, span=span)).collect()
    told = collections.Counter((x[1], x[2], x[3], x[4]) for x in plain_manifest(rows, arity).elements())
    assert collections.Counter((r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) for r in got) == told
    assert all(r["verified"] and r["folded_root"] == r["root"] for r in got)


def test_manifest_of_an_empty_table(spark, tmp_path):
    assert merkle.op12_merkle(spark, folder(empty(spark), tmp_path)).count() == 0


def test_many_groups_are_joined(spark, monkeypatch):
    monkeypatch.setattr(merkle, "MOST_GROUPS", 3)
    rows = [(i, "s", f"g{i % 37:02}", i, "t") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = merkle.verified(merkle.manifest(df, "lang", "doc_id", merkle.FIELDS)).collect()
    assert len(got) == 200 and len({r["root"] for r in got}) == 1 and all(r["verified"] for r in got)


# ----------------------------------------------------------------- 13 packing


def textbook(sizes, k):
    """Karmarkar-Karp as told: merge the two partial partitions of greatest difference until one is left."""
    heap = [(-s, i, [s] + [0] * (k - 1)) for i, s in enumerate(sorted(sizes, reverse=True))]
    heapq.heapify(heap)
    tick = itertools.count(len(heap))
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        merged = sorted((x + y for x, y in zip(sorted(a, reverse=True), sorted(b), strict=True)), reverse=True)
        heapq.heappush(heap, (merged[-1] - merged[0], next(tick), merged))
    return sorted(heap[0][2])


@pytest.mark.parametrize("seed", range(12))
def test_differencing_equals_the_textbook(seed):
    r = random.Random(seed)
    sizes = r.sample(range(1, 4000), r.randint(1, 60))  # distinct, so that no tie is broken another way
    k = r.randint(1, 12)
    placed = packing.differenced(np.array(sizes), k)
    got = np.bincount(placed, sizes, k)
    assert sorted(got.astype(int).tolist()) == textbook(sizes, k)


@pytest.mark.parametrize("sizes", [[512] * 800 + [440] * 100, [1], [511] * 9, list(range(1, 513)) * 3, [300] * 2000, [7] * 5])
def test_windows_hold_no_more_than_their_capacity(sizes):
    placed = packing.filled(np.array(sizes))
    sums = np.bincount(placed, sizes)
    assert sums.max() <= packing.CAPACITY and sums.sum() == sum(sizes)
    assert len(sums) <= 1.07 * -(-sum(sizes) // packing.CAPACITY) + 1


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.vocabulary())


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aZ é'sSt09½ǅßİ\x1c\x85\xa0 ́<|endoftext|>\n\t_-.²")), max_size=40))
def test_ids_are_those_of_the_library(library, text):
    tokens = packing.Tokens.of(open(packing.vocabulary(), encoding="utf-8").read())
    got = np.frombuffer(tokens.encode(np.frombuffer(text.encode(), np.uint8)), "<u4").tolist()
    assert got == library.encode(text, add_special_tokens=False).ids


def check_packing(rows, texts, library):
    """rows: of the result; texts: of all documents."""
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append(r)
    for held in by.values():
        held.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in held] == list(itertools.accumulate([0, *[r["length"] for r in held[:-1]]]))
        assert sum(r["length"] for r in held) <= packing.CAPACITY
    told = collections.Counter()
    for key, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, packing.END]
        at = 0
        for n in packing.lengths(len(ids)):
            told[key, at, n, zlib.crc32(struct.pack(f"<{n}I", *ids[at : at + n])), len(ids)] += 1
            at += n
        assert at == len(ids)
    assert collections.Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == told


def test_packing_equals_the_library(spark, tmp_path, library):
    docs = documents(spark)
    got = packing.op13_packing(spark, folder(docs, tmp_path)).collect()
    check_packing(got, [(r["doc_id"], r["text"]) for r in docs.collect()], library)


def test_packing_in_many_blocks(spark, library):
    docs = spark.range(400).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.repeat(F.lit("some words 12 "), (F.col("id") % 90 * 9).cast("int")).alias("text"))
    made = packing.packed(packing.pieces(docs, packing.vocabulary(), with_ids=True).withColumnRenamed("key", "doc_id"), windows=8).cache()
    got = made.collect()
    check_packing(got, [(r["doc_id"], r["text"]) for r in docs.collect()], library)
    whole = {r["sequence_id"]: r for r in packing.assembled(made).collect()}
    assert sum(r["length"] for r in got) == sum(len(r["ids"]) for r in whole.values())
    for r in got:
        assert zlib.crc32(np.array(whole[r["sequence_id"]]["ids"][r["offset"] : r["offset"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
    assert len(whole) * packing.CAPACITY < 1.1 * sum(r["length"] for r in got)


def test_packing_of_an_empty_table(spark, tmp_path):
    assert packing.op13_packing(spark, folder(empty(spark), tmp_path)).count() == 0


def test_another_vocabulary_goes_through_the_library():
    import public_tokenizers

    tokens = packing.Tokens(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    assert not tokens.by_word
    assert np.frombuffer(tokens.encode(np.frombuffer(b"two words", np.uint8)), "<u4").tolist() == tokens.whole.encode("two words").ids
