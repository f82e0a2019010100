"""Cross-entropy difference of two matched n-gram models.

The target model is counted over the documents that a label calls good, the
background model over all documents, scaled to the target's size, so both are
matched.  Both share one vocabulary: all words of all documents.  A model gives

    P(w | v) = (c(v w) + BACKOFF * P(w)) / (c(v) + BACKOFF),
    P(w)     = (c(w) + 1) / (N + V),

and a document's score is the mean over its words of log P_target - log
P_background, in bits: higher is closer to the target.  The first word of a
document follows an empty word.  A document is scored without its own counts, so
that those in the target are not favoured for having been counted.

Counting.  Every word and word pair of every document is counted under its own
56-bit hash (two of 10^9 n-grams share one with a chance of about 1 in 10^8); counts stay distributed and grow with the input, and only two totals and the size
of the vocabulary reach the driver.  Documents are cut into batches of
BATCH_BYTES of text, written once as token numbers.  A batch sends its n-grams,
each once with its counts, to slices of the hash range; a slice adds up what all
batches sent and answers each batch with the totals of its own n-grams; batches
meet their answers and score their documents.  So texts are read once and never
shuffled, a frequent n-gram is one entry a batch, and tasks hold one slice or
batch at a time.

Defined cases: null and empty texts have no words and score null; null ids carry
no label; documents without label count for the background only; an empty target
leaves a uniform target model; a label of several rows is good if one row of the
given keys says so; repeated rows count each; an empty table stays empty; other
columns of the input take no part.
"""

from __future__ import annotations

import itertools
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, mix, read_table, steps, utf8, word_hashes, words

BACKOFF = 8.0
#: Text bytes of a batch, and n-grams that all batches together send to a slice (about), and slices at least (256: see _sent).
BATCH_BYTES, SLICE_GRAMS, LEAST_SLICES = 4 << 20, 1 << 20, 256
#: Good documents whose numbers are broadcast to the batches; more meet them in a join.
MOST_BROADCAST = 4_000_000
GRAM_BITS = 56
_EMPTY = np.uint64(0x5851F42D4C957F2D)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each BATCH_BYTES of texts: keys, words of each, vocabulary (ascending hashes) and packed token numbers."""
    held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
    size = 0

    def told() -> pa.RecordBatch:
        keys, n, hashes = zip(*held, strict=True)
        vocabulary, token = np.unique(np.concatenate(hashes), return_inverse=True)
        n, keys = np.concatenate(n), pa.concat_arrays(keys)
        cell = lambda x, kind: pa.array([x], kind)
        lists = pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), keys)
        return pa.RecordBatch.from_arrays([cell(uuid.uuid4().int >> 65, pa.int64()), lists, cell(n, pa.list_(pa.int32())), cell(vocabulary.tobytes(), pa.binary()), cell(_pressed(token.astype(np.int32)), pa.binary())], ["batch", "keys", "n", "vocabulary", "tokens"])

    for batch in batches:
        for step in steps(batch, "text", BATCH_BYTES):
            at, data = utf8(step.column("text"))
            begin, end, first = words(at, data)
            held.append((step.column("key"), np.diff(first).astype(np.int32), word_hashes(data, begin, end)))
            size += len(data)
            if size >= BATCH_BYTES:
                yield told()
                held.clear()
                size = 0
    if held:
        yield told()


class Batch:
    """One batch's tokens and n-grams; `grams` ascend, words have an even hash and pairs an odd one."""

    def __init__(self, n, vocabulary: bytes, tokens: bytes, good) -> None:
        self.n = np.asarray(n, np.int64)
        names = np.frombuffer(vocabulary, np.uint64)
        token = _loosened(tokens, np.int32)
        self.row = np.repeat(np.arange(len(self.n)), self.n)
        marked = np.zeros(len(self.n), bool)
        marked[np.asarray(good if good is not None else [], np.int64)] = True
        self.good = marked
        h = names[token]
        before = np.concatenate(([_EMPTY], h[:-1])) if len(h) else h
        starts = (np.cumsum(self.n) - self.n)[self.n > 0]
        before[starts] = _EMPTY
        word = mix(np.append(names, _EMPTY)) >> np.uint64(64 - GRAM_BITS) & ~np.uint64(1)
        pair = mix(before * np.uint64(0x9E3779B97F4A7C15) + h) >> np.uint64(64 - GRAM_BITS) | np.uint64(1)
        self.grams, at = np.unique(np.concatenate((word, pair)), return_inverse=True)
        #: Of each token: the place of its word, of the word before it, and of the pair.
        self.word, self.pair = at[token], at[len(word) :]
        self.before = np.concatenate(([at[len(names)]], self.word[:-1])) if len(h) else self.word
        self.before[starts] = at[len(names)]
        self.starts = starts

    def counts(self, mask: np.ndarray) -> np.ndarray:
        """Occurrences of each n-gram among masked tokens; the empty word counts once a document."""
        size, first = len(self.grams), np.zeros(len(mask), bool)
        first[self.starts] = True
        return np.bincount(self.word[mask], minlength=size) + np.bincount(self.pair[mask], minlength=size) + np.bincount(self.before[mask & first], minlength=size)

    def losses(self, all_: np.ndarray, good: np.ndarray, totals: tuple[int, int], size: int) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each token under target and background, both without the token's own document."""
        own = [_own(self.row, have, ask) for have, ask in ((self.word, self.word), (self.word, self.before), (self.pair, self.pair))]
        own[1] = own[1] + np.isin(np.arange(len(self.row)), self.starts)  # the empty word stands once in each document
        length, in_target = self.n[self.row], self.good[self.row]
        out = []
        for table, total, counted, scale in ((good, totals[1], in_target, 1.0), (all_, totals[0], np.ones(len(self.row), bool), totals[1] / totals[0] if totals[0] and totals[1] else 1.0)):
            left = [(table[at] - counted * mine) * scale for at, mine in zip((self.word, self.before, self.pair), own, strict=True)]
            alone = (left[0] + 1) / ((total - counted * length) * scale + size)
            out.append(-np.log2((left[2] + BACKOFF * alone) / (left[1] + BACKOFF)))
        return out[0], out[1]


def _own(row: np.ndarray, have: np.ndarray, ask: np.ndarray) -> np.ndarray:
    """How often each `ask` is among the `have` of the same row."""
    if not len(row):
        return np.zeros(0)
    wide = np.int64(1 << 32)
    cell, times = np.unique(row * wide + have, return_counts=True)
    key = row * wide + ask
    at = np.minimum(np.searchsorted(cell, key), len(cell) - 1)
    return np.where(cell[at] == key, times[at], 0)


def _sent(grams: np.ndarray) -> bytes:
    """Six bytes of each n-gram; the upper eight bits are the slice's, which has them in common."""
    return np.ascontiguousarray(grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _got(body: bytes) -> np.ndarray:
    out = np.zeros((len(body) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(body, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _pressed(numbers: np.ndarray) -> bytes:
    """Whole numbers by planes of their bytes, of which the upper ones are nearly empty, compressed."""
    return zlib.compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), -1).T).tobytes(), 1)


def _loosened(body: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(body), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _packed(*counts: np.ndarray) -> bytes:
    return _pressed(np.concatenate(counts).astype(np.int64))


def _unpacked(body: bytes) -> np.ndarray:
    """Two rows: counts in all and in good documents."""
    return _loosened(body, np.int64).reshape(2, -1)


def _decoded(batch: pa.RecordBatch) -> Iterator[tuple[dict, Batch]]:
    for i in range(batch.num_rows):
        said = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
        yield said, Batch(said["n"], said["vocabulary"], said["tokens"], said["good"])


def _asks(bits: int):
    """Of each batch: its n-grams of each slice (their upper bits) and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for said, held in _decoded(rows):
                counts = held.counts(np.ones(len(held.row), bool)), held.counts(held.good[held.row])
                number = (held.grams >> np.uint64(GRAM_BITS - bits)).astype(np.int64)
                cuts = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1], [True])))  # slices that are present
                spans = [(int(number[a]), a, b) for a, b in itertools.pairwise(cuts.tolist())] if len(number) else []
                yield pa.RecordBatch.from_arrays([
                    pa.array([i for i, _, _ in spans], pa.int32()),
                    pa.array([said["batch"]] * len(spans), pa.int64()),
                    pa.array([_sent(held.grams[a:b]) for _, a, b in spans], pa.binary()),
                    pa.array([_packed(counts[0][a:b], counts[1][a:b]) for _, a, b in spans], pa.binary()),
                ], ["slice", "batch", "grams", "counts"])

    return run


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of slices: the totals of each row's n-grams over its slice; `words` on a slice's first row."""

    def told(at: int, ids: list[int], grams: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        found, place = np.unique(np.concatenate(grams), return_inverse=True)
        total = np.stack([np.bincount(place, weights=c, minlength=len(found)) for c in np.concatenate(counts, axis=1)])
        ends = np.cumsum([len(g) for g in grams])
        bodies = [_packed(*total[:, place[b - len(g) : b]]) for b, g in zip(ends, grams, strict=True)]
        n_words = [int((found & np.uint64(1) == 0).sum()), *[0] * (len(ids) - 1)]
        return pa.RecordBatch.from_arrays([pa.array([at] * len(ids), pa.int32()), pa.array(ids, pa.int64()), pa.array(bodies, pa.binary()), pa.array(n_words, pa.int64())], ["slice", "batch", "counts", "words"])

    at, ids, grams, counts = None, [], [], []
    for rows in batches:
        for number, batch, gram, count in zip(*(rows.column(c) for c in ("slice", "batch", "grams", "counts")), strict=True):
            if number.as_py() != at:
                if at is not None:
                    yield told(at, ids, grams, counts)
                at, ids, grams, counts = number.as_py(), [], [], []
            ids.append(batch.as_py())
            grams.append(_got(gram.as_py()))
            counts.append(_unpacked(count.as_py()))
    if at is not None:
        yield told(at, ids, grams, counts)


def _scores(totals: tuple[int, int], size: int, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for said, held in _decoded(rows):
                answers = [_unpacked(x["counts"]) for x in said["answers"] or []]  # in order of slices, hence of grams
                all_, good = np.concatenate(answers, axis=1) if answers else np.zeros((2, len(held.grams)), np.int64)
                first = np.concatenate(([0], np.cumsum(held.n)))
                with np.errstate(invalid="ignore"):
                    sums = [np.concatenate(([0.0], np.cumsum(x))) for x in held.losses(all_, good, totals, size)]
                    means = [(s[first[1:]] - s[first[:-1]]) / held.n for s in sums]
                columns = [pa.array(said["keys"], kind), pa.array(held.n, pa.int64()), *(pa.array(x, pa.float64(), mask=held.n == 0) for x in means)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "n_words", "target_bits", "background_bits"])

    return run


def score(docs: DataFrame, good: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, target_bits, background_bits (a word) and score of each row.

    good: keys (a column named key) of the documents that the target model counts.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[key].dataType
    shown = kind.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    held = materialize(rows.mapInArrow(_batches, f"batch long, keys array<{shown}>, n array<int>, vocabulary binary, tokens binary"), "lm-batches")
    each = held.select("batch", F.posexplode(F.arrays_zip("keys", "n")).alias("at", "d")).select("batch", "at", F.col("d.keys").alias("key"), F.col("d.n").alias("n"))
    marked = materialize(each.join(good.select(F.col(key).alias("key")).distinct(), "key", "left_semi"), "lm-good")
    totals = tuple(int(f.agg(F.sum("n")).first()[0] or 0) for f in (each, marked))
    lists = marked.groupBy("batch").agg(F.collect_list("at").alias("good"))
    few = marked.count() <= MOST_BROADCAST  # else batches are shuffled once more; the same rows either way
    told = held.join(F.broadcast(lists) if few else lists, "batch", "left")
    bits = int(np.ceil(np.log2(max(LEAST_SLICES, 2 * totals[0] / SLICE_GRAMS))))
    asked = told.mapInArrow(_asks(bits), "slice int, batch long, grams binary, counts binary")
    answers = asked.repartition("slice").sortWithinPartitions("slice").mapInArrow(_answers, "slice int, batch long, counts binary, words long")
    answers = materialize(answers, "lm-answers")
    size = max(1, int(answers.agg(F.sum("words")).first()[0] or 0) - 1)  # without the empty word
    discard(answers.limit(0))  # the sent n-grams' shuffle files are no longer needed
    mine = answers.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("slice", "counts"))).alias("answers"))
    made = told.join(mine, "batch", "left").mapInArrow(_scores(totals, size, to_arrow_type(kind)), f"key {shown}, n_words long, target_bits double, background_bits double")
    out = materialize(made, "lm-scores")
    discard(held, marked, answers)
    return out.select(F.col("key").alias(key), "n_words", "target_bits", "background_bits", (F.col("background_bits") - F.col("target_bits")).alias("score"))


def op5_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled of good quality and not toxic; background: all documents."""
    labels = read_table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    return score(read_table(spark, sf_dir, "documents"), labels.where("good").select("doc_id"))
