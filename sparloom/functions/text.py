"""Columns and row-generating steps over texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

#: Tokens that say little about a text; fixed values.
STOPWORDS = (
    "the", "and", "for", "that", "with", "from", "this", "have", "were", "which",
    "their", "about", "would", "there", "after", "before", "into", "when", "what",
    "where", "while", "whose", "them", "they", "been", "also", "than", "then",
    "because", "could", "should", "such", "these", "those", "your", "over",
    "under", "between", "during", "through", "being", "it", "is", "a", "an", "of",
    "to", "in", "on", "as", "by", "or", "at", "be", "are", "was", "if", "but",
)


#: Unicode white space but the blank; fixed values.
_WHITE = r"\t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs of white space that are not one blank already, so that single blanks are left in place.
_RUNS = f"[{_WHITE}][ {_WHITE}]*| [ {_WHITE}]+"


def clean(text: Column) -> Column:
    """Runs of Unicode white space become one blank; ends are stripped; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), _RUNS, " "))


def first_words(text: Column, n: int) -> Column:
    """The text up to its n-th word, so that a long text is not cleaned for its beginning."""
    word, white = f"[^ {_WHITE}]+", f"[ {_WHITE}]"
    return F.regexp_extract(F.coalesce(text, F.lit("")), f"^{white}*({word}(?:{white}+{word}){{0,{n - 1}}})", 1)


def solid(text: Column) -> Column:
    """Whether clean(text) is not empty, without cleaning it."""
    return F.coalesce(text.rlike(f"[^ {_WHITE}]"), F.lit(False))


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0))


def blank_words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\n", " "), " "), lambda w: w != "")


def steps(length: Column, size: int, overlap: int) -> Column:
    """How many windows of size cover a length when each begins size - overlap later."""
    if size <= 0 or overlap < 0:
        raise ValueError("size must be above 0 and overlap at least 0")
    step = size - (overlap if overlap < size else 0)
    more = F.ceil((length - size) / F.lit(float(step))).cast("int")
    return F.when(length <= size, 1).otherwise(1 + more)


def _begin(overlap: int, size: int) -> int:
    return size - (overlap if overlap < size else 0)


def chunk_chars(df: DataFrame, text: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Explodes text into chunk_idx and chunk: windows of characters; empty texts have none."""
    step = _begin(overlap, size)
    at = F.sequence(F.lit(0), steps(F.length(text), size, overlap) - 1)  # a filter on the text would compute it twice
    cut = df.withColumn("chunk_idx", F.explode(F.when(F.length(text) > 0, at)))
    return cut.withColumn("chunk", F.substring(F.col(text), F.col("chunk_idx") * step + 1, F.lit(size))).drop(text)


def chunk_words(df: DataFrame, text: str, size: int = 160, overlap: int = 0) -> DataFrame:
    """Explodes text into chunk_idx and chunk: windows of blank-separated words."""
    step = _begin(overlap, size)
    cut = df.withColumn("_w", blank_words(F.col(text))).where(F.size("_w") > 0)
    cut = cut.withColumn("chunk_idx", F.explode(F.sequence(F.lit(0), steps(F.size("_w"), size, overlap) - 1)))
    return cut.withColumn("chunk", F.array_join(F.slice("_w", F.col("chunk_idx") * step + 1, F.lit(size)), " ")).drop("_w", text)


def chunk_delimited(df: DataFrame, text: str, delimiter: str = "\n", drop: str = "blank") -> DataFrame:
    """Explodes text at a delimiter; drop: 'blank' or only 'empty' parts."""
    parts = F.split(F.col(text), "\\Q" + delimiter + "\\E", -1)
    kept = F.filter(parts, (lambda x: F.trim(x) != "") if drop == "blank" else (lambda x: x != ""))
    return df.select(*[c for c in df.columns if c != text], F.posexplode(kept).alias("chunk_idx", "chunk"))


def html_text(html: Column) -> Column:
    """A page's text: scripts, styles and tags out, then white space as in clean()."""
    bare = html
    for pattern in (r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"(?s)<[^>]*>"):
        bare = F.regexp_replace(bare, pattern, " ")
    return clean(bare)


def token_rows(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """key..., pos, tok: one row a token."""
    return df.select(*key, F.posexplode(tokens(F.col(text))).alias("pos", "tok"))


def _counted(df: DataFrame, key: list[str], text: str, k: int | None = None, chosen: bool = False) -> DataFrame:
    """token_counts of rows whose keys are their own, made where a row is read: nothing is shuffled.

    k: only the k commonest tokens of a row, with their rank instead of first; chosen: of those that keywords() takes.
    """
    from ..operators.lexical import text_tokens

    names = [f"_{i}" for i in range(len(key))]
    kinds = [StructField(n, df.schema[c].dataType) for n, c in zip(names, key, strict=True)]
    last = "rank" if k else "first"
    schema = StructType([*kinds, StructField("tok", StringType()), StructField("n", LongType()), StructField(last, IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, lengths = text_tokens(batch.column(len(names)))
            token, width = np.asarray(found.indices, np.int64), max(1, len(found.dictionary))
            begin = np.cumsum(lengths) - lengths
            pairs, at, n = np.unique(np.repeat(np.arange(len(lengths)), lengths) * width + token, return_index=True, return_counts=True)
            row, token = np.divmod(pairs, width)
            first = at - begin[row]
            if chosen:
                said = found.dictionary.to_pylist()
                size = np.array([len(t) for t in said], np.int64)
                good = (size >= 5) & ~np.isin(np.array(said, object), STOPWORDS)
                has = np.zeros(len(lengths), bool)
                has[row[good[token]]] = True
                some = (size[token] >= 4) & (good[token] | ~has[row])
                row, token, first, n = row[some], token[some], first[some], n[some]
            if k:
                order = np.lexsort((first, -n, row))
                row, token, n = row[order], token[order], n[order]
                first = np.arange(len(row)) - np.searchsorted(row, row) + 1
                row, token, first, n = (x[first <= k] for x in (row, token, first, n))
            of = pa.array(row)
            tok = found.dictionary.take(pa.array(token)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(of) for c in range(len(names))), tok, pa.array(n.astype(np.int64)), pa.array(first.astype(np.int32))], schema.names)

    kept = df.select(*[F.col(c).alias(n) for n, c in zip(names, key, strict=True)], F.col(text).alias("_text"))
    return kept.mapInArrow(run, schema).select(*[F.col(n).alias(c) for n, c in zip(names, key, strict=True)], "tok", "n", last)


def _by_keys(df: DataFrame, key: list[str], text: str, alone, together) -> DataFrame:
    """alone() of the rows whose key no other row has, and together() of the others, if there are any."""
    from ..session import kept

    df = df.select(*key, text)
    names = [f"_{i}" for i in range(len(key))]
    shared = df.select(*[F.col(c).alias(n) for n, c in zip(names, key, strict=True)]).groupBy(*names).count().where("count > 1").drop("count")
    shared = kept(shared, "shared-keys")
    if shared.isEmpty():
        return alone(df)
    same = [df[c].eqNullSafe(shared[n]) for n, c in zip(names, key, strict=True)]
    return alone(df.join(shared, same, "left_anti")).unionByName(together(df.join(shared, same, "left_semi")))


def _grouped_counts(df: DataFrame, key: list[str], text: str) -> DataFrame:
    return token_rows(df, key, text).groupBy(*key, "tok").agg(F.count("*").alias("n"), F.min("pos").alias("first"))


def token_counts(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """key..., tok, n and first: how often a key's rows have a token, and where first."""
    return _by_keys(df, key, text, lambda rows: _counted(rows, key, text), lambda rows: _grouped_counts(rows, key, text))


def top_tokens(counts: DataFrame, key: list[str], k: int) -> DataFrame:
    """The k commonest tokens of each key, earlier ones first among equals."""
    best = Window.partitionBy(*key).orderBy(F.desc("n"), "first")
    return counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def top_terms(df: DataFrame, key: list[str], text: str, k: int) -> DataFrame:
    """key..., tok, n, rank: top_tokens of token_counts."""
    def together(rows: DataFrame) -> DataFrame:
        return top_tokens(_grouped_counts(rows, key, text), key, k).drop("first")

    return _by_keys(df, key, text, lambda rows: _counted(rows, key, text, k), together)


def keywords(df: DataFrame, key: list[str], text: str, k: int = 4) -> DataFrame:
    """Top tokens of five letters or more that are no stopwords; where a row has none, of all of four or more."""
    def together(rows: DataFrame) -> DataFrame:
        counts = _grouped_counts(rows, key, text).where(F.length("tok") >= 4)
        good = (F.length("tok") >= 5) & ~F.col("tok").isin(*STOPWORDS)
        has = F.max(good.cast("int")).over(Window.partitionBy(*key)) == 1
        return top_tokens(counts.withColumn("_has", has).where(good | ~F.col("_has")).drop("_has"), key, k).drop("first")

    return _by_keys(df, key, text, lambda rows: _counted(rows, key, text, k, chosen=True), together)


def bigrams(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """left, right, n over all rows."""
    follow = Window.partitionBy(*key).orderBy("pos")
    pairs = token_rows(df, key, text).withColumn("right", F.lead("tok").over(follow)).where("right is not null")
    return pairs.groupBy(F.col("tok").alias("left"), "right").agg(F.count("*").alias("n"))


def successors(pairs: DataFrame) -> DataFrame:
    """left, right, n: each token's likeliest follower, the greater token among equals."""
    best = pairs.groupBy("left").agg(F.max(F.struct("n", "right")).alias("b"))
    return best.select("left", F.col("b.right").alias("right"), F.col("b.n").alias("n"))
