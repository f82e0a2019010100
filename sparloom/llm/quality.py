"""Quality rules: counts of a text, and how far it diverges from its language.

A language's reference is taken from all documents of that language: a histogram
of character classes, and one of its COMMON most frequent words plus all others.
A document's own histograms are held against them by Jensen-Shannon distance
(base 2, 0 to 1).  A text is rejected if the class distance is above CLASS_LIMIT
or the word distance above WORD_LIMIT.  Guards: texts under MIN_WORDS words fail
the base rules anyway; a language with under MIN_REFERENCE words gives no verdict,
and then the text is kept.

Classes follow Unicode's categories: small, capital and other letters, numbers,
line ends, blanks, marks of prose, symbols, and what remains.  Words of every
length are counted: each task adds up its words and sends each once (after
FLUSH_WORDS distinct ones anew), and sums meet by word.

Defined cases: a null text has no words; a null language is a language of its
own; rows are judged one by one, so repeats and ties get equal verdicts; an
empty table gives an empty result; columns of the input that are named like
results are not used.
"""

from __future__ import annotations

import collections
import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import mix, read_table, run_hashes, steps, utf8, word_hashes, words

COMMON = 40
CLASS_LIMIT, WORD_LIMIT = 0.30, 0.45
MIN_WORDS, MIN_REFERENCE = 50, 1_000
SYMBOLS = "#*$%&|<>"
MARKS = ".,;:!?'\"()-"
#: Languages whose references the driver holds, about 2 KB each; distinct words of a language that a task holds.
MAX_LANGUAGES, FLUSH_WORDS = 10_000, 200_000
CLASSES = ("lower", "upper", "letter", "digit", "newline", "blank", "symbol", "mark", "other")
#: Class of each Unicode category that has one as a whole.
OF_CATEGORY = {"Ll": "lower", "Lu": "upper", "Lt": "upper", "Lo": "letter", "Lm": "letter", "Mn": "letter", "Mc": "letter", "Me": "letter", "Nd": "digit", "Nl": "digit", "No": "digit", "Zs": "blank"}


@functools.cache
def _class_table() -> np.ndarray:
    """Class of each code point."""
    found = [CLASSES.index(OF_CATEGORY.get(unicodedata.category(chr(c)), "other")) for c in range(0x110000)]
    table = np.array(found, np.int8)
    for characters, name in (("\n", "newline"), (" \t", "blank"), (SYMBOLS, "symbol"), (MARKS, "mark")):
        table[[ord(c) for c in characters]] = CLASSES.index(name)
    return table


def _characters(at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each character of a step, its row, and the characters begun before each byte."""
    lead = (data & 0xC0) != 0x80
    before = np.concatenate(([0], np.cumsum(lead)))
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return _class_table()[points], np.repeat(np.arange(len(at) - 1), np.diff(before[at])), before


def _lang_ids(column: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Language numbers of a step's rows and their names, null: ''."""
    named = ["" if v is None else "=" + v for v in column.to_pylist()]
    names = sorted(set(named))
    at = {v: i for i, v in enumerate(names)}
    return np.array([at[v] for v in named], np.int64), names


def _references(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one task: counts of classes, words in all and words, by language."""
    classes: collections.Counter = collections.Counter()
    found: dict[str, dict[bytes, int]] = {}

    def told() -> Iterator[pa.RecordBatch]:
        for name, counts in found.items():
            yield _counted([(name, "word", w.decode("utf-8", "replace"), n) for w, n in counts.items()])
        found.clear()

    for batch in batches:
        for step in steps(batch, "text"):
            at, data = utf8(step.column("text"))
            lang, names = _lang_ids(step.column("lang"))
            kind, row, _ = _characters(at, data)
            by_class = np.bincount(lang[row] * len(CLASSES) + kind, minlength=len(names) * len(CLASSES)).reshape(-1, len(CLASSES))
            begin, end, first = words(at, data)
            word_lang = np.repeat(lang, np.diff(first))
            h, whole = word_hashes(data, begin, end), data.tobytes()
            for i, name in enumerate(names):
                for k, n in enumerate(by_class[i]):
                    classes[name, "class", CLASSES[k]] += int(n)
                mine = np.flatnonzero(word_lang == i)
                classes[name, "total", ""] += len(mine)
                _, at_word, n = np.unique(h[mine], return_index=True, return_counts=True)
                held = found.setdefault(name, {})
                for j, c in zip(mine[at_word].tolist(), n.tolist(), strict=True):
                    w = whole[begin[j] : end[j]]
                    held[w] = held.get(w, 0) + c
            if sum(map(len, found.values())) > FLUSH_WORDS:
                yield from told()
    yield from told()
    yield _counted([(*key, n) for key, n in classes.items() if n])


def _counted(rows: list[tuple[str, str, str, int]]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["lang", "kind", "item", "n"])


def references(docs: DataFrame, lang: str = "lang", text: str = "text") -> dict[str, tuple[np.ndarray, np.ndarray, list[str], int]]:
    """By language: class histogram, word histogram (last: all other words), common words, words in all.

    Counts cover all documents; only the COMMON words of each language reach the driver.
    """
    counts = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(_references, "lang string, kind string, item string, n long")
    counts = counts.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "item")
    rows = counts.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= COMMON).drop("_r").collect()
    found: dict[str, dict[str, dict[str, int]]] = {}
    for name, kind, item, n in rows:
        found.setdefault(name, {}).setdefault(kind, {})[item] = n
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"{len(found)} languages; {MAX_LANGUAGES} at most")
    out = {}
    for name, kinds in found.items():
        total = kinds.get("total", {}).get("", 0)
        common = sorted(kinds.get("word", {}), key=lambda w: (-kinds["word"][w], w))
        counted = np.array([kinds["word"][w] for w in common], float)
        classes = np.array([kinds.get("class", {}).get(c, 0) for c in CLASSES], float)
        out[name] = classes, np.append(counted, total - counted.sum()), common, total
    return out


def distances(own: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of each row of own to the reference; rows without counts: 0."""
    p = own / np.maximum(own.sum(axis=1, keepdims=True), 1)
    q = reference / max(reference.sum(), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0.0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / m), 0.0).sum(axis=1)
    return np.where(own.sum(axis=1) > 0, np.sqrt(np.clip((left + right) / 2, 0, 1)), 0.0)


def _repeats(h: np.ndarray, first: np.ndarray, k: int = 3) -> np.ndarray:
    """By row: words in windows of k words that the row holds twice or more."""
    n = len(first) - 1
    runs = run_hashes(h, k)
    if not len(runs):
        return np.zeros(n, np.int64)
    row = np.repeat(np.arange(n), np.diff(first))
    inside = row[: len(runs)] == row[k - 1 :]
    keyed = mix(runs + mix(row[: len(runs)].astype(np.uint64) + np.uint64(1)))
    # a run over a row's edge never counts: its key is set apart by its place
    keyed[~inside] = mix(np.arange(int((~inside).sum()), dtype=np.uint64) + np.uint64(1 << 40))
    _, which, times = np.unique(keyed, return_inverse=True, return_counts=True)
    twice = inside & (times[which] > 1)
    covered = np.zeros(len(h), bool)
    for i in range(k):
        covered[i : len(h) - k + 1 + i] |= twice
    return np.bincount(row[covered], minlength=n)


def _dup_lines(text: bytes) -> int:
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    return len(lines) - len(set(lines))


RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"


def _judge(held, extra: list[str], lang_at: str, text_at: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        references = held.value
        hashed = {}
        for name, (_, _, common, _) in references.items():
            raw = [w.encode() for w in common]
            ends = np.cumsum([len(w) for w in raw], dtype=np.int64)
            data = np.frombuffer(b"".join(raw), np.uint8)
            h = word_hashes(data, ends - np.array([len(w) for w in raw], np.int64), ends) if raw else np.zeros(0, np.uint64)
            order = np.argsort(h)
            hashed[name] = h[order], order
        for batch in batches:
            for step in steps(batch, text_at):
                at, data = utf8(step.column(text_at))
                lang, names = _lang_ids(step.column(lang_at))
                n = len(lang)
                kind, row, letters = _characters(at, data)
                classes = np.bincount(row * len(CLASSES) + kind, minlength=n * len(CLASSES)).reshape(n, -1).astype(float)
                begin, end, first = words(at, data)
                chars = np.concatenate(([0], np.cumsum(letters[end] - letters[begin])))
                h = word_hashes(data, begin, end)
                n_words = np.diff(first)
                repeated = _repeats(h, first)
                whole = data.tobytes()
                dup = np.array([_dup_lines(whole[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], np.int64)
                word_row = np.repeat(np.arange(n), n_words)
                class_d, word_d = np.zeros(n), np.zeros(n)
                for i, name in enumerate(names):
                    ref_class, ref_word, common, total = references.get(name, (np.zeros(len(CLASSES)), np.zeros(1), [], 0))
                    if total < MIN_REFERENCE:
                        continue
                    rows = np.flatnonzero(lang == i)
                    place = np.full(n, -1)
                    place[rows] = np.arange(len(rows))
                    mine = place[word_row] >= 0
                    table, order = hashed[name]
                    k = np.minimum(np.searchsorted(table, h[mine]), len(table) - 1)
                    slot = np.where(table[k] == h[mine], order[k], len(common))
                    own = np.bincount(place[word_row[mine]] * (len(common) + 1) + slot, minlength=len(rows) * (len(common) + 1)).reshape(len(rows), -1)
                    class_d[rows] = distances(classes[rows], ref_class)
                    word_d[rows] = distances(own.astype(float), ref_word)
                failed = (n_words < MIN_WORDS) | (100 * repeated > 50 * n_words)
                kept = ~failed & (class_d <= CLASS_LIMIT) & (word_d <= WORD_LIMIT)
                columns = [n_words, np.diff(chars[first]), classes[:, CLASSES.index("symbol")].astype(np.int64), dup, repeated, failed, kept, class_d, word_d]
                own = [step.column(c) for c in extra]
                yield pa.RecordBatch.from_arrays([*own, *map(pa.array, columns)], [*[f"_{i}" for i in range(len(extra))], *[x.split()[0] for x in RESULT.split(", ")]])

    return run


def _judged(docs: DataFrame, keep: list[str], lang: str, text: str) -> DataFrame:
    """Columns _0, _1, ... for `keep`, then RESULT's."""
    held = docs.sparkSession.sparkContext.broadcast(references(docs, lang, text))
    schema = ", ".join([*[f"`_{i}` {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)], RESULT])
    every = [*keep, *[c for c in (lang, text) if c not in keep]]  # a kept text is sent once
    internal = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(every)])
    return internal.mapInArrow(_judge(held, [f"k{i}" for i in range(len(keep))], f"k{every.index(lang)}", f"k{every.index(text)}"), schema)


def judge(docs: DataFrame, keep: list[str], lang: str = "lang", text: str = "text") -> DataFrame:
    """The columns `keep` of docs, then the counts, distances and verdict of each row."""
    return _judged(docs, keep, lang, text).select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], *[x.split()[0] for x in RESULT.split(", ")])


def passing(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    names = docs.columns
    return _judged(docs, names, lang, text).where("kept").select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(names)])


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(read_table(spark, sf_dir, "documents"), ["doc_id"])
    return judged.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def _count(characters: str) -> str:
    return f"length(regexp_replace(text, '[^{characters}]', '', 'g'))"


#: The classes of CLASSES as sets of characters; `other` is what remains.
_SETS = {"lower": r"\p{Ll}", "upper": r"\p{Lu}\p{Lt}", "letter": r"\p{Lo}\p{Lm}\p{M}", "digit": r"\p{N}", "newline": r"\n", "blank": r"\p{Zs}\t", "symbol": "#*$%&|<>", "mark": r".,;:!?''\"()\-"}
_DISTANCE = """sqrt(greatest(0, (sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) + sum(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END)) / 2))"""
SQL = f"""
WITH d AS (SELECT doc_id, coalesce('=' || lang, '') AS lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, lang, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM d),
totals AS (SELECT lang, sum(len(w)) AS n FROM d GROUP BY lang),
common AS (SELECT lang, x, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, x) AS r FROM (SELECT lang, x, count(*) AS n FROM words GROUP BY lang, x)) WHERE r <= {COMMON}),
word_ref AS (SELECT lang, x, common.n / totals.n AS q FROM common JOIN totals USING (lang) UNION ALL SELECT lang, NULL, 1 - coalesce(sum(common.n), 0) / any_value(totals.n) FROM totals LEFT JOIN common USING (lang) GROUP BY lang),
own AS (SELECT doc_id, c.x, count(*) AS n FROM words JOIN common c ON c.lang = words.lang AND c.x = words.x GROUP BY doc_id, c.x),
own_all AS (SELECT doc_id, x, n FROM own UNION ALL SELECT d.doc_id, NULL, len(w) - coalesce(s, 0) FROM d LEFT JOIN (SELECT doc_id, sum(n) AS s FROM own GROUP BY doc_id) USING (doc_id)),
word_d AS (SELECT doc_id, {_DISTANCE} AS v FROM (SELECT d.doc_id, coalesce(o.n, 0) / len(w) AS p, q FROM d JOIN word_ref r USING (lang) LEFT JOIN own_all o ON o.doc_id = d.doc_id AND o.x IS NOT DISTINCT FROM r.x WHERE len(w) > 0) GROUP BY doc_id),
counted AS (SELECT doc_id, lang, {", ".join(f"{_count(v)} AS {k}" for k, v in _SETS.items())}, length(text) AS len FROM d),
long AS (UNPIVOT (SELECT doc_id, lang, {", ".join(f"{k}::DOUBLE AS {k}" for k in _SETS)}, (len - {" - ".join(_SETS)})::DOUBLE AS other FROM counted) ON {", ".join(CLASSES)} INTO NAME class VALUE n),
class_ref AS (SELECT lang, class, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM long GROUP BY lang, class),
class_d AS (SELECT doc_id, {_DISTANCE} AS v FROM (SELECT doc_id, n / sum(n) OVER (PARTITION BY doc_id) AS p, q FROM long JOIN class_ref USING (lang, class)) GROUP BY doc_id HAVING sum(p) > 0),
lines AS (SELECT doc_id, count(*) - count(DISTINCT x) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
tri AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS n FROM (SELECT doc_id, i, w[i : i + 2] AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3))),
repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM tri, (SELECT unnest(range(3)) AS k) WHERE n > 1 GROUP BY doc_id),
base AS (SELECT doc_id, lang, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, {_count(_SETS["symbol"])}::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
 FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN repeated r USING (doc_id)),
judged AS (SELECT b.* EXCLUDE (lang), n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
 CASE WHEN t.n >= {MIN_REFERENCE} THEN coalesce(c.v, 0) ELSE 0 END AS class_distance, CASE WHEN t.n >= {MIN_REFERENCE} THEN coalesce(v.v, 0) ELSE 0 END AS word_distance
 FROM base b LEFT JOIN totals t USING (lang) LEFT JOIN class_d c USING (doc_id) LEFT JOIN word_d v USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND class_distance <= {CLASS_LIMIT} AND word_distance <= {WORD_LIMIT} AS kept, round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance FROM judged
"""
