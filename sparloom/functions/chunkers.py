"""The chunkers as one polymorphic table function, for SQL text.

    SELECT * FROM chunks(rows => TABLE(docs), text => 'text', how => 'chars', size => 1000, overlap => 200)

It returns the table's columns but the text, then chunk_idx and chunk.  how: 'chars'
(windows of characters), 'words' (windows of blank-separated words) or 'delimiter'
(parts between delimiters; keep => 'solid' drops blank parts, 'all' only empty ones).
most: so many chunks of a row at most, where above 0.  A null text has no chunk.  The
columns of functions.text do the same without Python; this is the form that SQL calls.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..session import by_value

by_value(__name__)


def pieces(text: str, how: str, size: int, overlap: int, delimiter: str, keep: str) -> Iterator[str]:
    if how == "delimiter":
        yield from (p for p in text.split(delimiter) if (p.strip(" ") if keep == "solid" else p))
        return
    held = text if how == "chars" else [w for w in text.replace("\n", " ").split(" ") if w]
    step, at = size - (overlap if overlap < size else 0), 0
    while held and (at == 0 or at - step + size < len(held)):
        yield held[at : at + size] if how == "chars" else " ".join(held[at : at + size])
        at += step


class Chunks:
    """The table function; its schema follows the table's."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, text: AnalyzeArgument, how: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None, delimiter: AnalyzeArgument | None = None, keep: AnalyzeArgument | None = None, most: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("rows must be a TABLE argument")
        if how.value not in ("chars", "words", "delimiter"):
            raise ValueError(f"no chunker {how.value}")
        if text.value not in rows.dataType.fieldNames():
            raise ValueError(f"the table has no column {text.value}")
        if how.value != "delimiter" and (size is None or size.value <= 0 or overlap is not None and overlap.value < 0):
            raise ValueError("size must be above 0 and overlap at least 0")
        kept = [f for f in rows.dataType.fields if f.name != text.value]
        return AnalyzeResult(StructType([*kept, StructField("chunk_idx", IntegerType()), StructField("chunk", StringType())]))

    def eval(self, rows: Row, text: str, how: str, size: int = 0, overlap: int = 0, delimiter: str = "\n", keep: str = "solid", most: int = 0) -> Iterator[tuple]:
        others = [v for k, v in rows.asDict().items() if k != text]
        for i, piece in enumerate(pieces(rows[text] or "", how, size, overlap, delimiter, keep)):
            if most and i == most:
                return
            yield (*others, i, piece)


def register(spark: SparkSession, name: str = "chunks") -> None:
    from pyspark.sql.functions import udtf

    spark.udtf.register(name, udtf(Chunks))
