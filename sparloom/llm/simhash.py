"""SimHash near-duplicates over vantage-point trees.

A fingerprint has 64 bits: bit b is 1 if b is set in over half the XXH64 hashes
of the text's k-word shingles, repeats included.  Fingerprints link at `radius`
differing bits or fewer, and links join documents to components.

Search.  Equal fingerprints are grouped first, so copies cost one entry.  A
vantage-point tree over a bounded, documented sample of fingerprints deals all
of them into shards: inside or outside a vantage point's median distance.  By
the triangle inequality a pair on both sides of a boundary has its inner point
within `radius` of it; such points visit the outer shard too, and visitors
branch wherever their ball crosses a boundary.  Each shard then searches its
own fingerprints and its visitors exactly with a local tree, and hands out a
spanning forest of the links, not all pairs.  Nothing but the sample, counts and
the tree (24 bytes a shard, MAX_DEPTH bounds it) reaches the driver.

Wide radius.  near_groups() links by a Jaccard likeness of 0.8.  The trees search
the fingerprints of its five-word shingles first, at `radius` bits as above, and
what they find is linked before anything else.  But at that likeness fingerprints
differ in up to 18 bits, and no triangle bound prunes at that radius: nearly all
distances lie within 32 +- 12.  An exact check follows, a prefix filter: of n
shingles in a shared order, common ones last, the first n - ceil(0.8 n) + 1 are a
text's keys, and two texts of likeness 0.8 share a key.  Every link, of the trees
and of the filter, is decided by the two whole shingle sets (64-bit hashes), for
fingerprints count repeats.  Texts are not shuffled for it: only keys, and the
sets of texts in a candidate pair, are.

Defined cases: null and empty texts have fingerprint 0 and link like any other
in components(); near_groups() groups texts without words with each other only;
repeated rows and equal ids are separate rows; an empty table stays empty.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, components, discard, lowered, materialize, read_table, steps, unused, utf8
from .sketches import shingles

#: Fingerprints from which vantage points are chosen, the lowest by hash: so many for each shard, within these bounds.
SAMPLE_A_SHARD, SAMPLE, MOST_SAMPLE = 128, 8_192, 1 << 20
#: Fingerprints that a shard is meant to hold (a local tree searches it), and levels of the shared tree.
SHARD, MIN_DEPTH, MAX_DEPTH = 1 << 19, 3, 16
#: Of so many sampled points of a node, that with the fewest others near its median becomes its vantage point.
TRIED = 16
LEAF = 256


# ------------------------------------------------------------------ fingerprints


def _shingle_digests(text: str | None, k: int) -> bytes:
    """8-byte big-endian XXH64 digests, seed 42, of the lower-cased text's shingles."""
    found = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return b""
    digest = xxhash.xxh64_digest
    if len(found) <= k:
        return digest(b" ".join(found), 42)
    line = b" ".join(found)
    size = np.fromiter(map(len, found), np.int64, len(found)) + 1
    end = np.cumsum(size) - 1
    begin = end + 1 - size
    return b"".join([digest(line[i:j], 42) for i, j in zip(begin[: len(found) - k + 1].tolist(), end[k - 1 :].tolist(), strict=True)])


def fingerprint_of(digests: bytes) -> int:
    if not digests:
        return 0
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(bits)).tobytes(), "big")


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3) -> DataFrame:
    """(key, fp long) of each row; fp holds the 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, "text"):
                fp = [_signed(fingerprint_of(_shingle_digests(t.as_py(), k))) for t in step.column("text")]
                yield pa.RecordBatch.from_arrays([step.column("key"), pa.array(fp, pa.int64())], ["key", "fp"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, fp long")


# ------------------------------------------------------------ vantage-point trees


class Tree:
    """A balanced tree kept by levels: vantage point and median distance of each node."""

    def __init__(self, sample: np.ndarray, depth: int, radius: int = 2) -> None:
        self.depth = depth
        self.point = np.zeros(1 << depth, np.uint64)
        self.median = np.full(1 << depth, -1, np.int64)
        groups = {1: sample}
        for node in range(1, 1 << depth):
            mine = groups.pop(node, sample[:0])
            if len(mine):
                tried = mine[np.linspace(0, len(mine) - 1, min(TRIED, len(mine))).astype(np.int64)]
                apart = np.bitwise_count(tried[:, None] ^ mine[None, :]).astype(np.int64)
                middle = np.median(apart, axis=1).astype(np.int64)
                edge = (np.abs(apart - middle[:, None]) < radius).sum(axis=1) + (apart <= middle[:, None]).all(axis=1) * len(mine)
                best = int(np.argmin(edge))  # few points visit both sides
                self.point[node], self.median[node], d = tried[best], middle[best], apart[best]
                inner = d <= self.median[node]
                groups[2 * node], groups[2 * node + 1] = mine[inner], mine[~inner]

    def deal(self, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shard, place in fp and home (or visitor) of every entry."""
        node, at, home = np.ones(len(fp), np.int64), np.arange(len(fp)), np.ones(len(fp), bool)
        for _ in range(self.depth):
            d = np.bitwise_count(fp[at] ^ self.point[node]).astype(np.int64)
            m = self.median[node]
            inner = np.where(home, d <= m, d <= m + radius)
            outer = np.where(home, d > m, d >= m + 1 - radius)
            crosses = home & inner & (d >= m + 1 - radius)
            node = np.concatenate((2 * node[inner], 2 * node[outer] + 1, 2 * node[crosses] + 1))
            home = np.concatenate((home[inner], home[outer], np.zeros(int(crosses.sum()), bool)))
            at = np.concatenate((at[inner], at[outer], at[crosses]))
        return node - (1 << self.depth), at, home


class Forest:
    """Joins places by links; roots are the smallest places."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.root[a], self.root[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while (self.root != (up := self.root[self.root])).any():
                self.root = up


def _tiles(fp: np.ndarray, own: np.ndarray, other: np.ndarray, radius: int, forest: Forest) -> None:
    for i in range(0, len(own), 512):
        left = own[i : i + 512]
        for j in range(0, len(other), 8192):
            right = other[j : j + 8192]
            near = np.bitwise_count(fp[left][:, None] ^ fp[right][None, :]) <= radius
            x, y = np.nonzero(near)
            if len(x):
                forest.join(left[x], right[y])


def search(fp: np.ndarray, home: np.ndarray, radius: int) -> Forest:
    """Links among homes and from visitors to homes, by a local vantage-point tree."""
    forest = Forest(len(fp))
    heap = [(np.flatnonzero(home), np.flatnonzero(~home), 0)]
    while heap:
        own, guests, level = heap.pop()
        if not len(own):
            continue
        split = None
        if len(own) > LEAF and level < 48:
            for t in range(4):
                d = np.bitwise_count(fp[own] ^ fp[own[(len(own) * (2 * t + 1)) // 8]]).astype(np.int64)
                m = int(np.median(d))
                inner = d <= m
                if not inner.all():
                    split = own[(len(own) * (2 * t + 1)) // 8], d, m, inner
                    break
        if split is None:
            _tiles(fp, own, own, radius, forest)
            _tiles(fp, own, guests, radius, forest)
            continue
        point, d, m, inner = split
        g = np.bitwise_count(fp[guests] ^ fp[point]).astype(np.int64)
        heap.append((own[inner], guests[g <= m + radius], level + 1))
        heap.append((own[~inner], np.concatenate((guests[g >= m + 1 - radius], own[inner & (d >= m + 1 - radius)])), level + 1))
    return forest


def links(distinct: DataFrame, radius: int, n: int) -> DataFrame:
    """Edges (a, b) of a spanning forest of all links of distinct fingerprints (fp)."""
    depth = int(np.clip(np.ceil(np.log2(max(n, 1) / SHARD)), MIN_DEPTH, MAX_DEPTH))
    wanted = int(np.clip(SAMPLE_A_SHARD << depth, SAMPLE, MOST_SAMPLE))
    sample = np.array([r[0] for r in distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(wanted).collect()], np.int64).view(np.uint64)
    tree = distinct.sparkSession.sparkContext.broadcast(Tree(sample, depth, radius))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column(0)).astype(np.int64)
            shard, at, home = tree.value.deal(fp.view(np.uint64), radius)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(fp[at]), pa.array(home)], ["shard", "fp", "home"])

    def find(rows: pa.Table) -> pa.Table:
        fp = np.asarray(rows.column("fp")).astype(np.int64)
        root = search(fp.view(np.uint64), np.asarray(rows.column("home")).astype(bool), radius).root
        tied = np.flatnonzero(root != np.arange(len(fp)))
        return pa.table({"a": pa.array(fp[tied]), "b": pa.array(fp[root[tied]])})

    return distinct.select("fp").mapInArrow(deal, "shard int, fp long, home boolean").groupBy("shard").applyInArrow(find, "a long, b long")


def linked(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3, radius: int = 2) -> DataFrame:
    """key, fingerprint (16 hex digits) and component_id (smallest key reachable) of each row."""
    rows = materialize(fingerprints(docs, key, text, k), "simhash")  # texts are read once
    groups = materialize(rows.groupBy("fp").agg(F.min("key").alias("least")), "simhash-groups")
    found = components(links(groups, radius, groups.count()), "simhash-links")
    told = found.join(groups, found["node"] == groups["fp"]).select("node", "root", "least")
    least = materialize(told.groupBy("root").agg(F.min("least").alias("component")), "simhash-least")
    named = told.join(least, "root").select(F.col("node").alias("fp"), "component")
    # written, so that a fingerprint of many rows meets its name in a join that Spark can split
    all_named = materialize(groups.join(named, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id")), "simhash-named")
    discard(groups)
    return rows.join(all_named, "fp").select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(read_table(spark, sf_dir, "documents"))


# ------------------------------------------- groups by shingle likeness (wide radius)

#: One of so many texts tells which shingles are common: those of so many sampled texts, the most common so many.
SAMPLED, OFTEN, MOST_COMMON = 16, 16, 200_000
#: Bits of a text's parity map that goes with each key, and at least of that which goes with pairs (a power of two, its shingles or more).
MAP_BITS, WIDE_BITS = 256, 1_024
#: Texts of a key beyond which they are first linked along the key, and beyond which they are compared in blocks.
STARS, BLOCK = 32, 2_048
#: Texts of each key and size class with which the others are compared first.
LEADERS = 3
#: Bits of the filter by which tasks know texts of candidate pairs, at most; texts let through by mistake are dropped later.
MOST_FILTER_BITS = 1 << 29


def _text_id(text: F.Column) -> F.Column:
    """MD5 of the text with A-Z as a-z; the same of all texts without words."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(text.rlike(WORD), F.md5(lowered)).otherwise("")


def _all_shingles(column: pa.Array, k: int) -> list[np.ndarray]:
    """Shingle hashes of each row, repeats included."""
    at, data = utf8(column)
    value, first = shingles(at, lowered(data), k)
    return [value[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]


def _shingles(column: pa.Array, k: int) -> list[np.ndarray]:
    """Distinct shingle hashes of each row, ascending."""
    return [np.unique(h) for h in _all_shingles(column, k)]


def _hash_lists(made: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(h) for h in made]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*made, np.zeros(0, np.uint64)]).view(np.int64)))


def _needed(n: np.ndarray, similarity: float) -> np.ndarray:
    """Shingles of a set of n that any set of the similarity shares at least."""
    return np.ceil(similarity * n - 1e-9).astype(np.int64)


def _parity(h: np.ndarray, size: int) -> bytes:
    """Bit i: whether an odd number of hashes fall on i.  Maps of two sets differ in no more bits than the sets in hashes."""
    return np.packbits(np.bincount((h % np.uint64(size)).astype(np.int64), minlength=size) & 1).tobytes()


def _common(texts: DataFrame, k: int) -> np.ndarray:
    """Common shingles, ascending, from a bounded sample; they only order keys and change no link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, "text"):
                yield pa.RecordBatch.from_arrays([_hash_lists(_shingles(step.column("text"), k)).flatten()], ["h"])

    some = texts.where(F.pmod(F.xxhash64("tid"), F.lit(SAMPLED)) == 0).dropDuplicates(["tid"]).select("text")
    often = some.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") >= OFTEN)
    return np.sort(np.array([x[0] for x in often.orderBy(F.desc("c"), "h").limit(MOST_COMMON).collect()], np.int64).view(np.uint64))


def _keys(h: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set, common ones last: so many that two sets of the similarity share one of theirs."""
    if len(common) and len(h):
        seen = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h
        h = np.concatenate((h[~seen], h[seen]))
    return h[: len(h) - int(_needed(len(h), similarity)) + 1]


def _signatures(k: int, common, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, "text"):
                every = _all_shingles(step.column("text"), k)
                fp = [_signed(fingerprint_of(h.astype(">u8").tobytes())) for h in every]
                made = [np.unique(h) for h in every]
                keys = _hash_lists([_keys(h, common.value, similarity) for h in made])
                bits = [_parity(h, MAP_BITS) for h in made]
                wide = [_parity(h, max(WIDE_BITS, 1 << (len(h) - 1).bit_length())) if len(h) else b"" for h in made]
                yield pa.RecordBatch.from_arrays([step.column("key"), step.column("tid"), keys, pa.array(bits, pa.binary()), pa.array(wide, pa.binary()), pa.array([len(h) for h in made], pa.int32()), pa.array(fp, pa.int64())], ["key", "tid", "keys", "bits", "wide", "n", "fp"])

    return run


def _pairs(similarity: float):
    """Streams rows sorted by shard and size, and hands out pairs of one shard that may have the similarity.

    Pairs of one component, of too different sizes, or whose parity maps differ in
    more bits than sets of the similarity can, go; nothing else does.
    """
    most = (1 - similarity) / (1 + similarity)

    def found(t: np.ndarray, root: np.ndarray, n: np.ndarray, bits: np.ndarray, shard: np.ndarray) -> pa.RecordBatch:
        out, i, d = [], np.arange(len(t)), 1
        while len(i):
            i = i[i + d < len(t)]
            i = i[shard[i] == shard[i + d]]
            i = i[n[i] >= _needed(n[i + d], similarity)]  # later ones are larger still
            j = i + d
            x = i[(root[i] != root[j]) & (t[i] != t[j])]
            x = x[np.bitwise_count(bits[x] ^ bits[x + d]).sum(axis=1) <= most * (n[x] + n[x + d]) + 1e-6]
            y = x + d
            swap = t[x] > t[y]
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            out.append(np.stack((t[x], t[y], n[x], n[y])))
            d += 1
        pairs, keys = np.unique(np.concatenate(out, axis=1), axis=1, return_counts=True) if out else (np.zeros((4, 0), np.int64),) * 2
        return pa.RecordBatch.from_arrays([*(pa.array(x) for x in pairs), pa.array(keys if out else pairs[0], pa.int64())], ["a", "b", "n_a", "n_b", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            shard, t, root, n = (np.asarray(batch.column(c)) for c in ("shard", "t", "root", "n"))
            bits = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint64).reshape(-1, MAP_BITS // 64)
            now = [t, root, n.astype(np.int64), bits, shard]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            if len(held[-1]):
                whole = int(np.flatnonzero(held[-1] != held[-1][-1])[-1]) + 1 if (held[-1] != held[-1][-1]).any() else 0
                yield found(*(x[:whole] for x in held))
                held = [x[whole:] for x in held]
        if held is not None:
            yield found(*held)

    return run


def _possible(pairs: DataFrame, maps: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) without those whose sizes or wide maps (t, n, wide) rule the similarity out."""
    most = (1 - similarity) / (1 + similarity)

    def differ(x: bytes, y: bytes) -> int:
        """Bits in which two maps differ, the larger folded onto the smaller: no more than the sets differ in hashes."""
        x, y = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
        if len(y) > len(x):
            y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
        return int(np.bitwise_count(x ^ y).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [np.asarray(batch.column(c)).astype(np.int64) for c in ("n_a", "n_b")]
            keep = np.minimum(*n) >= _needed(np.maximum(*n), similarity)
            apart = np.array([differ(x.as_py(), y.as_py()) for x, y in zip(batch.column("wide_a"), batch.column("wide_b"), strict=True)])
            yield batch.select(["a", "b"]).filter(pa.array(keep & (apart <= most * (n[0] + n[1]) + 1e-6)))

    one, two = (maps.select(F.col("t").alias(x), F.col("n").alias(f"n_{x}"), F.col("wide").alias(f"wide_{x}")) for x in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "n_a", "n_b", "wide_a", "wide_b").mapInArrow(run, "a long, b long")


def _filter(asked: DataFrame) -> np.ndarray:
    """A bitmap over the low bits of asked ids (t): tasks send their bits by slices, equal slices are joined by OR."""
    bits = 1 << int(np.clip(np.ceil(np.log2(16 * max(1, asked.count()))), 16, np.log2(MOST_FILTER_BITS)))
    slices = max(1, bits >> 20)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(bits, bool)
        for batch in batches:
            seen[np.asarray(batch.column(0)).astype(np.int64) & (bits - 1)] = True
        for i, piece in enumerate(np.split(seen, slices)):
            if piece.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(np.packbits(piece).tobytes(), 1)], pa.binary())], ["slice", "body"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, body in zip(batch.column("slice").to_pylist(), batch.column("body"), strict=True):
                piece = np.frombuffer(zlib.decompress(body.as_py()), np.uint8)
                held[i] = held[i] | piece if i in held else piece
        for i, piece in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(piece.tobytes(), 1)], pa.binary())], ["slice", "body"])

    out = np.zeros((slices, bits // slices // 8), np.uint8)
    for i, body in asked.select("t").mapInArrow(own, "slice int, body binary").repartition("slice").mapInArrow(joined, "slice int, body binary").toLocalIterator():
        out[i] = np.frombuffer(zlib.decompress(body), np.uint8)
    return out.ravel()


def _links(texts: DataFrame, pairs: DataFrame, k: int, similarity: float) -> DataFrame:
    """Pairs (a, b: hashes of text ids) as links (a, b: text ids), decided by whole shingle sets of their texts (t, tid, text)."""
    asked = materialize(pairs.select(F.explode(F.array("a", "b")).alias("t")).distinct(), "near-asked")
    known = texts.sparkSession.sparkContext.broadcast(_filter(asked))  # MOST_FILTER_BITS / 8 bytes at most

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = 8 * len(known.value) - 1
        for batch in batches:
            low = np.asarray(batch.column("t")).astype(np.int64) & mask
            kept = batch.filter(pa.array((known.value[low >> 3] >> (7 - (low & 7)).astype(np.uint8)) & 1 == 1))
            for step in steps(kept, "text"):
                yield pa.RecordBatch.from_arrays([step.column("t"), step.column("tid"), _hash_lists(_shingles(step.column("text"), k))], ["t", "tid", "set"])

    made = texts.select("t", "tid", "text").mapInArrow(sets, "t long, tid string, set array<long>")
    whole = materialize(made.join(asked, "t", "left_semi").dropDuplicates(["t", "tid"]), "near-sets")
    one, two = (whole.select(F.col("t").alias(f"t{x}"), F.col("tid").alias(x), F.col("set").alias(f"set_{x}")) for x in "ab")
    full = pairs.select(F.col("a").alias("ta"), F.col("b").alias("tb")).join(one, "ta").join(two, "tb").select("a", "b", "set_a", "set_b")
    both = F.size(F.array_intersect("set_a", "set_b"))  # native: whole sets of a batch of pairs are never held together
    out = materialize(full.where(both / (F.size("set_a") + F.size("set_b") - both) >= similarity).select("a", "b"), "near-links")
    discard(asked, whole)
    return out


def _near_fingerprints(maps: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b) of texts (t, fp) that the trees link: each with the least text of its fingerprint, and these along the trees' links."""
    groups = materialize(maps.groupBy("fp").agg(F.min("t").alias("least")), "near-fingerprints")
    one, two = (groups.select(F.col("fp").alias(x), F.col("least").alias(f"t{x}")) for x in "ab")
    apart = links(groups, radius, groups.count()).join(one, "a").join(two, "b").select(F.col("ta").alias("t"), F.col("tb").alias("o"))
    pairs = apart.union(maps.select("fp", "t").join(groups, "fp").where("t <> least").select("t", F.col("least").alias("o")))
    found = materialize(pairs.select(F.least("t", "o").alias("a"), F.greatest("t", "o").alias("b")), "near-trees")
    discard(groups)
    return found


def _stars(shared: DataFrame) -> DataFrame:
    """Pairs (a, b) of each text of a common key (h, t, n, c) with the leaders of the key's texts of its size."""
    size = F.floor(F.log("n") / np.log(1.1)).alias("size")
    hot = shared.where(F.col("c") > STARS).select("h", "t", size)
    lead = [F.min_by("t", F.xxhash64("t", F.lit(i))) for i in range(LEADERS)]
    leaders = materialize(hot.groupBy("h", "size").agg(F.array_distinct(F.array(*lead)).alias("leaders")), "near-leaders")
    pairs = hot.join(leaders, ["h", "size"]).select("t", F.explode("leaders").alias("o")).where("t <> o")
    return pairs.select(F.least("t", "o").alias("a"), F.greatest("t", "o").alias("b")).distinct()


def _candidates(maps: DataFrame, shared: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of different components (t, root) that share a key (h, t, n, c).

    Keys whose texts are one component already go, however many texts they have;
    other keys of many texts are compared block against block.
    """
    rooted = materialize(shared.join(roots, "t", "left").select("h", "t", "c", F.coalesce("root", "t").alias("root")), "near-rooted")
    open_ = materialize(rooted.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("h"), "near-open")
    blocks = F.ceil(F.col("c") / F.lit(BLOCK))
    mine = F.pmod("t", blocks)
    other = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    dealt = rooted.join(open_, "h").withColumn("other", other).withColumn("mine", mine)
    shard = F.when(F.col("c") > BLOCK, F.xxhash64("h", F.least("mine", "other"), F.greatest("mine", "other"))).otherwise(F.col("h"))
    rows = dealt.select(shard.alias("shard"), "t", "root").join(maps, "t")
    made = rows.repartition("shard").sortWithinPartitions("shard", "n", "t").mapInArrow(_pairs(similarity), "a long, b long, n_a long, n_b long, keys long")
    made = made.groupBy("a", "b", "n_a", "n_b").agg(F.sum("keys").alias("keys"))
    behind = F.ceil(similarity * F.greatest("n_a", "n_b") - 1e-9) - 1  # shingles behind the keys; those before them are among the keys
    return made.where(F.col("keys") + behind >= similarity / (1 + similarity) * (F.col("n_a") + F.col("n_b")) - 1e-6).select("a", "b").distinct()


def _groups(docs: DataFrame, key: str, text: str, k: int, similarity: float, radius: int) -> tuple[DataFrame, DataFrame]:
    """(key, tid) of each row, and (tid, keeper: key and tid of the first row of the group) of each text."""
    kind = docs.schema[key].dataType.simpleString()
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), _text_id(F.col(text)).alias("tid"))
    common = docs.sparkSession.sparkContext.broadcast(_common(texts.where("tid <> ''"), k))  # MOST_COMMON hashes
    rows = materialize(texts.mapInArrow(_signatures(k, common, similarity), f"key {kind}, tid string, keys array<long>, bits binary, wide binary, n int, fp long"), "near")
    ids = materialize(rows.select("key", "tid"), "near-ids")
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "tid"))
    least = materialize(ids.groupBy("tid").agg(first.alias("least")), "near-texts")
    some = materialize(rows.where("n > 0").drop("key").dropDuplicates(["tid"]).withColumn("t", F.xxhash64("tid")), "near-distinct")
    discard(rows)
    texts = texts.where("tid <> ''").select(F.xxhash64("tid").alias("t"), "tid", "text")
    keyed = some.select("t", "n", F.explode("keys").alias("h"))
    often = materialize(keyed.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), "near-often")
    shared = materialize(keyed.join(often, "h").select("h", "t", "n", "c"), "near-keys")
    narrow = materialize(some.select("t", "n", "bits", "wide", "fp").dropDuplicates(["t"]), "near-maps")
    discard(often, some)
    trees = _near_fingerprints(narrow, radius)
    stars = materialize(_possible(trees.union(_stars(shared)).distinct(), narrow.drop("bits"), similarity), "near-stars")
    edges = _links(texts, stars, k, similarity)
    found = components(edges, "near-first-links")
    roots = materialize(found.select(F.xxhash64("node").alias("t"), F.xxhash64("root").alias("root")), "near-roots")
    pairs = materialize(_candidates(narrow.drop("wide", "fp"), shared, roots, similarity), "near-candidates")
    discard(shared, stars, trees)
    pairs = materialize(_possible(pairs, narrow.drop("bits"), similarity), "near-pairs")
    found = components(edges.union(_links(texts, pairs, k, similarity)), "near-groups")
    told = found.join(least, found["node"] == least["tid"]).select("node", "root", "least")
    kept = materialize(told.groupBy("root").agg(F.min("least").alias("keeper")), "near-keepers")
    named = told.join(kept, "root").select(F.col("node").alias("tid"), "keeper")
    named = materialize(least.join(named, "tid", "left").select("tid", F.coalesce("keeper", "least").alias("keeper")), "near-named")
    discard(least, narrow, roots, pairs, edges)
    return ids, named


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, similarity: float = 0.8, radius: int = 2) -> DataFrame:
    """(key, tid, keeper, keeper_tid): each row's text id, and key and text id of the first row of its near-duplicate group.

    Texts whose fingerprints the trees link at `radius` bits, and those that share a key, are candidates.  Those of keys of many texts are first
    linked along the key, so that a large group of near-copies is one component
    before its pairs are looked at; then all pairs of different components are.
    """
    ids, named = _groups(docs, key, text, k, similarity, radius)
    return ids.join(named, "tid").select(F.col("key").alias(key), "tid", F.col("keeper.key").alias("keeper"), F.col("keeper.tid").alias("keeper_tid"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, similarity: float = 0.8, radius: int = 2) -> DataFrame:
    """One row of each near-duplicate group: that with the smallest (key, text id), null keys last."""
    ids, named = _groups(docs, key, text, k, similarity, radius)
    kept = materialize(named.select(F.col("keeper.key").alias("_key"), F.col("keeper.tid").alias("_keeper")).distinct(), "near-kept")
    discard(ids, named)
    tid, [own] = _text_id(docs[text]), unused(docs, "_tid")
    mine = docs.withColumn(own, tid).join(kept, docs[key].eqNullSafe(kept["_key"]) & (tid == kept["_keeper"]), "left_semi")
    return mine.dropDuplicates([key, own]).drop(own)
