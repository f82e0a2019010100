"""Byte-level BPE encoding and decoding over Arrow batches.

Ranks come from a public vocabulary file whose path is a parameter; nothing is
trained.  The `tokenizers` library does the merging, with a model built from the
ranks; a text is cut by the vocabulary's pattern first and each piece encoded
separately, so a worker keeps the ids of pieces that it has met (a bounded
table) and hands only new pieces to the library.

Defined cases: a null text counts as empty, an empty one has no ids and decodes
as empty; null keys stay null; repeated rows are coded each; columns named as
results are replaced; an empty table stays empty.  Batches are handled in steps
of about 1 MB of text, so memory does not grow with a batch; one longer text is
a step of its own.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, steps

#: Pieces whose ids a worker keeps; beyond it the table is begun anew.
KEPT_PIECES = 150_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte 0..255 in byte-level BPE.

    Printable Latin-1 bytes stand for themselves; the others take the code
    points from 256 on, in the order of the bytes.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = itertools.count(256)
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _halves(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two tokens whose merge makes this one: merging stops just before it."""
    parts, limit = [bytes([b]) for b in token], ranks[token]
    while len(parts) > 2:
        joined = [ranks.get(x + y, limit) for x, y in itertools.pairwise(parts)]
        k = min(range(len(joined)), key=joined.__getitem__)
        if joined[k] >= limit:
            raise ValueError(f"token {limit} is not made of lower ranks")
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return parts[0], parts[1]


def model_json(path: str) -> str:
    """The ranks as a model of the tokenizers library."""
    alphabet, ranks = byte_alphabet(), read_ranks(path)
    show = lambda token: "".join(alphabet[b] for b in token)
    longer = sorted((t for t in ranks if len(t) > 1), key=ranks.__getitem__)
    return json.dumps({
        "vocab": {show(t): r for t, r in ranks.items()},
        "merges": [tuple(map(show, _halves(t, ranks))) for t in longer],
    })


#: The byte-level pattern restated for texts of Latin characters (below U+0250),
#: whose classes are listed outright: the standard library's matcher is faster.
#: Alternatives begin with different characters, so their order may differ.
LATIN_OF = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
LATIN = re.compile(f" ?[{_L}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
BEYOND = re.compile("[^\0-\u024f]")


class Codec:
    """Encodes and decodes with one vocabulary; one per worker process."""

    _held: dict[str, Codec] = {}

    def __init__(self, model: str, pattern: str) -> None:
        from tokenizers import models

        said = json.loads(model)
        self.model = models.BPE(vocab=said["vocab"], merges=[tuple(m) for m in said["merges"]], ignore_merges=True)
        self.alphabet = byte_alphabet()
        back = {c: b for b, c in enumerate(self.alphabet)}
        table: list[bytes] = [b""] * (max(said["vocab"].values()) + 1)
        for token, rank in said["vocab"].items():
            table[rank] = bytes(back[c] for c in token)
        self.lengths = np.array([len(x) for x in table], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(table), np.uint8)
        self.shown = [str(i) for i in range(len(table))]
        self.find = regex.compile(pattern).findall
        self.latin = LATIN.findall if pattern == LATIN_OF else None
        #: By piece: its ids as packed 32-bit numbers, and as decimals.
        self.ids: dict[str, bytes] = {}
        self.decimals: dict[str, str] = {}

    @classmethod
    def of(cls, model: str, pattern: str) -> Codec:
        key = hashlib.md5((model + pattern).encode()).hexdigest()
        if key not in cls._held:
            cls._held[key] = cls(model, pattern)
        return cls._held[key]

    def cut(self, text: str) -> list[str]:
        return self.latin(text) if self.latin and not BEYOND.search(text) else self.find(text)

    def _learn(self, pieces: list[str], decimals: bool) -> None:
        """Ids of new pieces by the library, each after byte-to-character mapping."""
        alphabet, shown, tokenize = self.alphabet, self.shown, self.model.tokenize
        if len(self.ids) > KEPT_PIECES:
            self.ids, self.decimals = {}, {}
        for piece in pieces:
            if piece not in self.ids or decimals and piece not in self.decimals:
                got = [t.id for t in tokenize("".join([alphabet[b] for b in piece.encode()]))]
                self.ids[piece] = array("i", got).tobytes()
                if decimals:
                    self.decimals[piece] = " ".join([shown[i] for i in got])

    def _joined(self, text: str, shown: bool) -> tuple[bytes, str]:
        pieces = self.cut(text)
        for _ in range(2):
            try:
                packed = b"".join(map(self.ids.__getitem__, pieces))
                return packed, " ".join(map(self.decimals.__getitem__, pieces)) if shown else ""
            except KeyError:
                self._learn(list(set(pieces)), shown)  # all, for the table may begin anew
        raise AssertionError("a piece is missing after it was learned")

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self._joined(text, False)[0], np.int32)

    def encode_shown(self, text: str) -> tuple[np.ndarray, str]:
        """Ids, and the same as decimals joined by one blank."""
        packed, shown = self._joined(text, True)
        return np.frombuffer(packed, np.int32), shown

    def decode_bytes(self, ids) -> bytes:
        ids = np.asarray(ids, np.int64)
        n = self.lengths[ids]
        end = np.cumsum(n)
        return self.bytes[np.repeat(self.begins[ids] - end + n, n) + np.arange(end[-1] if len(end) else 0)].tobytes()

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end character of each token.

        A token that begins or ends inside a character covers that character,
        so tokens of one split character share it.
        """
        raw = np.frombuffer(text.encode(), np.uint8)
        lead = (raw & 0xC0) != 0x80
        at = np.concatenate(([0], np.cumsum(lead)))  # characters begun before each byte
        end = np.cumsum(self.lengths[ids])
        begin = end - self.lengths[ids]
        inside = np.concatenate((~lead, [False]))
        return at[begin] - inside[begin], at[end]


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", offsets: bool = True) -> DataFrame:
    """Adds ids array<int> and, with offsets, starts and ends array<int> in characters.

    Null texts count as empty; empty texts have no ids.  Rows, their order in a
    partition, repeats and other columns stay; columns named as the added ones
    are replaced.
    """
    added = "ids array<int>" + (", starts array<int>, ends array<int>" if offsets else "")
    names = [x.split()[0] for x in added.split(", ")]
    df = df.drop(*[n for n in names if n != text])
    model = df.sparkSession.sparkContext.broadcast(model_json(path))  # a few MB, by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(model.value, pattern)
        for batch in itertools.chain.from_iterable(steps(b, text) for b in batches):
            texts = [t or "" for t in batch.column(text).to_pylist()]
            ids = [codec.encode(t) for t in texts]
            columns = [pa.array(ids, pa.list_(pa.int32()))]
            if offsets:
                spans = [codec.offsets(t, i) for t, i in zip(texts, ids, strict=True)]
                columns += [pa.array([s[k].astype(np.int32) for s in spans], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names])

    return df.mapInArrow(run, _with(df, added))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Adds decoded binary and decoded_text string.

    decoded holds exactly the tokens' bytes; decoded_text replaces bytes that
    are no UTF-8 (a character cut by the end of the ids) by U+FFFD.  Null ids
    decode as empty.
    """
    df = df.drop(*[n for n in ("decoded", "decoded_text") if n != ids])
    model = df.sparkSession.sparkContext.broadcast(model_json(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(model.value, pattern)
        for batch in batches:
            raw = [codec.decode_bytes(i or []) for i in batch.column(ids).to_pylist()]
            columns = [pa.array(raw, pa.binary()), pa.array([r.decode("utf-8", "replace") for r in raw], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "decoded", "decoded_text"])

    return df.mapInArrow(run, _with(df, "decoded binary, decoded_text string"))


def _with(df: DataFrame, added: str):
    from pyspark.sql.types import StructType

    return StructType([*df.schema.fields, *StructType.fromDDL(added).fields])


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encodes and decodes each whole text and keeps digests of both.

    key, n_tokens long, ids_sha256 and decoded_sha256 string: the same work as
    encode() then decode(), in one pass, without shipping ids between workers.
    """
    model = df.sparkSession.sparkContext.broadcast(model_json(path))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, sha = Codec.of(model.value, pattern), hashlib.sha256
        for batch in itertools.chain.from_iterable(steps(b, "text") for b in batches):
            n, seen, back = [], [], []
            for value in batch.column("text"):
                ids, shown = codec.encode_shown(value.as_py() or "")
                n.append(len(ids))
                seen.append(sha(shown.encode()).hexdigest())
                back.append(sha(codec.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(n, pa.int64()), pa.array(seen, pa.string()), pa.array(back, pa.string())], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    made = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return made.withColumnRenamed("key", key)


def coded(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """df with ids array<int> and n_tokens long added and text decoded from the ids.

    Encodes and decodes in one pass; null texts count as empty.
    """
    model = df.sparkSession.sparkContext.broadcast(model_json(path))
    kept = df.drop("ids", "n_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(model.value, pattern)
        for batch in itertools.chain.from_iterable(steps(b, text) for b in batches):
            ids = [codec.encode(t.as_py() or "") for t in batch.column(text)]
            counts = [len(i) for i in ids]
            ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)])))
            back = pa.array([codec.decode_bytes(i).decode("utf-8", "replace") for i in ids], pa.string())
            columns = [back if n == text else c for n, c in zip(batch.schema.names, batch.columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, lists, pa.array(counts, pa.int64())], [*batch.schema.names, "ids", "n_tokens"])

    return kept.mapInArrow(run, _with(kept, "ids array<int>, n_tokens long"))


def vocabulary() -> tuple[str, str]:
    """Path and pattern of the public 50k byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = vocabulary()
    return round_trip(read_table(spark, sf_dir, "documents"), path, pattern)
