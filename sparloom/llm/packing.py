"""Packing texts into windows of bounded length by Karmarkar-Karp differencing.

A document is its token ids and an end id.  As many whole windows as it fills are
windows of their own; the rest is cut into pieces of CUT ids at most, which are
dealt into blocks of about WINDOWS windows.  In a block the pieces are partitioned
into windows of near-equal sums: the two partial partitions of greatest difference
are merged, the largest window of one meeting the smallest of the other, until one
is left.  The count of windows begins at the least that could hold the block and
rises whenever a window exceeds the capacity.

Ids are computed where a text is read and only pieces' places, lengths and
checksums go on, 50 bytes a piece, so texts are read once and never shuffled.
Blocks are dealt by row numbers, so equal documents spread over all blocks.

Defined cases: a null text counts as empty and is its end id alone; rows of equal
or null ids are separate documents; an empty table gives no piece; other columns
take no part, whatever their names.  A text is handled in spans of 1 MB, cut at
blanks, so that a long one needs memory for its ids and no more.
"""

from __future__ import annotations

import heapq
import itertools
import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, STEP_BYTES, arrow_type, materialize, read_table, steps, utf8

#: Ids that a window holds, ids that a piece holds at most, windows that a block is meant to fill.
CAPACITY, CUT, WINDOWS = 4096, 512, 1024
#: The id that ends a document.
END = 2
#: Words and pieces of words whose ids a worker keeps; beyond it a table is begun anew.
KEPT_WORDS, KEPT_PIECES = 500_000, 400_000

#: What the fast path restates of the vocabulary's own rules; another vocabulary goes through the library text by text.
FOLLOWED = (
    ["NFC", "Replace", "Lowercase"],
    r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
)
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
LATIN = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+").findall
#: Words with characters beyond Latin letters, which the library takes whole, as those with what may be a special token.
BEYOND = re.compile("[^\0-ɏ]").search


class Tokens:
    """Ids of texts as packed 32-bit numbers; one per worker process."""

    _held: dict[int, Tokens] = {}

    def __init__(self, said: str) -> None:
        from tokenizers import Tokenizer, models

        from .bpe import byte_alphabet

        self.whole = Tokenizer.from_str(said)
        told = json.loads(said)
        rules = [x["type"] for x in (told["normalizer"] or {}).get("normalizers", [])]
        splits = [x["pattern"]["Regex"] for x in (told["pre_tokenizer"] or {}).get("pretokenizers", []) if x["type"] == "Split"]
        self.by_word = (rules, *splits) == FOLLOWED
        if self.by_word:
            model = told["model"]
            merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
            self.model = models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=model["end_of_word_suffix"], cache_capacity=0)
        self.alphabet = byte_alphabet()
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    @classmethod
    def of(cls, said: str) -> Tokens:
        key = zlib.crc32(said.encode())
        if key not in cls._held:
            cls._held[key] = cls(said)
        return cls._held[key]

    def _by_library(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        if len(self.pieces) > KEPT_PIECES:
            self.pieces = {}
        shown = piece if piece.isascii() and piece.isalnum() else "".join([self.alphabet[b] for b in piece.encode()])
        ids = [t.id for t in self.model.tokenize(shown)]
        self.pieces[piece] = packed = struct.pack(f"<{len(ids)}I", *ids)
        return packed

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        low = text.lower()
        if b"<|" in word or not word.isascii() and (BEYOND(text) or BEYOND(low)):
            return self._by_library(text)
        known = self.pieces
        return b"".join([known.get(piece) or self._piece(piece) for piece in LATIN(low)])

    def _span(self, raw: bytes) -> bytes:
        found = raw.split()  # at blanks of ASCII, across which no piece reaches
        known = self.words
        try:
            return b"".join(map(known.__getitem__, found))
        except KeyError:
            if len(known) > KEPT_WORDS:
                known = self.words = {}
            for word in found:
                if word not in known:
                    known[word] = self._word(word)
            return b"".join(map(known.__getitem__, found))

    def encode(self, raw: np.ndarray) -> bytes:
        """Ids of a text, given as UTF-8 bytes."""
        if not self.by_word:
            return self._by_library(raw.tobytes().decode())
        out, at = [], 0
        while at < len(raw):
            end = min(len(raw), at + STEP_BYTES)
            while end < len(raw):  # up to the next blank
                blank = np.flatnonzero(SPACES[raw[end : end + STEP_BYTES]])
                end = end + int(blank[0]) if len(blank) else min(len(raw), end + STEP_BYTES)
                if len(blank):
                    break
            out.append(self._span(raw[at:end].tobytes()))
            at = end
        return b"".join(out)


def lengths(n: int, capacity: int = CAPACITY, cut: int = CUT) -> list[int]:
    """Lengths of a document's pieces: whole windows first, then cuts."""
    whole, rest = divmod(n, capacity)
    return [capacity] * whole + [cut] * (rest // cut) + [rest % cut] * (rest % cut > 0)


def pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, cut: int = CUT, end: int = END, with_ids: bool = False) -> DataFrame:
    """Each document's pieces: key, start, length, ids_crc32, doc_tokens, and with_ids their ids array<int>."""
    with open(path, encoding="utf-8") as file:
        said = docs.sparkSession.sparkContext.broadcast(file.read())  # a few MB, by the vocabulary
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if with_ids else "")
    keys, last = arrow_type(kind), np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens.of(said.value)
        for step in itertools.chain.from_iterable(steps(b, "text") for b in batches):
            at, data = utf8(step.column("text"))
            row, start, size, crc, whole, ids = [], [], [], [], [], []
            for i in range(step.num_rows):
                packed = memoryview(tokens.encode(data[at[i] : at[i + 1]]) + last)
                n, begin = len(packed) // 4, 0
                for length in lengths(n, capacity, cut):
                    part = packed[4 * begin : 4 * (begin + length)]
                    row.append(i), start.append(begin), size.append(length), crc.append(zlib.crc32(part)), whole.append(n)
                    if with_ids:
                        ids.append(np.frombuffer(part, "<i4"))
                    begin += length
            columns = [step.column("key").take(pa.array(row, pa.int64())).cast(keys), *(pa.array(x, pa.int64()) for x in (start, size, crc, whole))]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []), [f.split()[0] for f in schema.split(", ")])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)


# ------------------------------------------------------------------ differencing


def differenced(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each size: Karmarkar-Karp differencing into so many near-equal sums.

    A partial partition holds a sum and members for each window, in descending
    order of sums; its difference is the first sum less the last.  Single sizes
    that would be merged one after the other into an unfilled partition are
    taken together, which gives the same partition.
    """
    order = np.argsort(-sizes, kind="stable")
    single, at, heap, tick = sizes[order].tolist(), 0, [], itertools.count()

    def push(sums: np.ndarray, members: list[list[int]]) -> None:
        heapq.heappush(heap, (-int(sums[0] - sums[-1]), next(tick), sums, members))

    def next_is_single() -> bool:
        return at < len(single) and (not heap or single[at] >= -heap[0][0])

    while at < len(single) or len(heap) > 1:
        if next_is_single():
            first, bound = at, -heap[0][0] if heap else 0
            while at < len(single) and at - first < windows and single[at] >= bound:
                at += 1
            sums = np.zeros(windows, np.int64)
            sums[: at - first] = single[first:at]
            push(sums, [[i] for i in range(first, at)] + [[] for _ in range(windows - at + first)])
            continue
        _, _, sums, members = heapq.heappop(heap)
        if next_is_single():  # it joins the smallest window
            total, joined = sums[-1] + single[at], members.pop()
            joined.append(at)
            at += 1
            place = int(np.searchsorted(-sums[:-1], -total))
            sums = np.insert(sums[:-1], place, total)
            members.insert(place, joined)
        else:
            _, _, others, more = heapq.heappop(heap)
            sums = sums + others[::-1]
            for own, other in zip(members, reversed(more), strict=True):
                own.extend(other)
            down = np.argsort(-sums, kind="stable")
            sums, members = sums[down], [members[i] for i in down]
        push(sums, members)
    out = np.empty(len(sizes), np.int64)
    for window, held in enumerate(heap[0][3] if heap else []):
        out[order[held]] = window
    return out


def filled(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The window of each size, none over capacity; the count of windows rises until that holds."""
    total = int(sizes.sum())
    windows = max(1, -(-total // capacity))
    while len(sizes):
        placed = differenced(sizes, windows)
        most = int(np.bincount(placed, sizes, windows).max())
        if most <= capacity:
            return placed
        spread = min(most - total // windows, capacity - 1)
        windows += max(1, (-(-total // (capacity - spread)) - windows) // 2)
        windows = min(windows, len(sizes))  # then each has a window of its own
    return np.zeros(0, np.int64)


def packed(cut: DataFrame, capacity: int = CAPACITY, windows: int = WINDOWS) -> DataFrame:
    """Pieces (with a column length of at most capacity) with sequence_id and offset; other columns stay.

    A sequence is named by the row number of its first piece.  Blocks are dealt by
    row numbers, which the written pieces keep.
    """
    kept = [c for c in cut.columns if c not in ("sequence_id", "offset", "_row")]
    rows = materialize(cut.select(*kept, F.monotonically_increasing_id().alias("_row")), "pieces")
    open_ = rows.where(F.col("length") < capacity).select("_row", "length")
    total = open_.agg(F.sum("length")).first()[0] or 0
    blocks = max(1, round(total / (windows * capacity)))

    def block(table: pa.Table) -> pa.Table:
        table = table.sort_by("_row")
        row, length = table.column("_row").to_numpy(), table.column("length").to_numpy()
        window = filled(length, capacity)
        order = np.argsort(window, kind="stable")
        row, length, window = row[order], length[order], window[order]
        first = np.searchsorted(window, window)
        before = np.cumsum(length) - length
        return pa.table({"_row": row, "sequence_id": row[first], "offset": before - before[first]})

    placed = open_.withColumn("_block", F.pmod(F.xxhash64("_row"), F.lit(blocks))).groupBy("_block").applyInArrow(block, "_row long, sequence_id long, offset long")
    whole = rows.where(F.col("length") >= capacity).select("_row", F.col("_row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return rows.join(placed.union(whole), "_row").select(*kept, "sequence_id", "offset")


def assembled(pieces: DataFrame) -> DataFrame:
    """Sequences (sequence_id, length, ids) of packed pieces that carry their ids; a sequence has capacity ids at most."""
    of = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.flatten(F.transform(of, lambda p: p["ids"])).alias("ids"))


def vocabulary() -> str:
    """Path of the public 49k word vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(pieces(read_table(spark, sf_dir, "documents"), vocabulary()).withColumnRenamed("key", "doc_id"))
