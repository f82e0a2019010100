"""Queries over files and states that Spark writes from the tables first: mixed folders, questions, accumulators."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chunkers
from ..operators import accumulators as A
from ..registry import SQL, query, table
from ..session import shared_folder
from ..sources.documents import read_documents, read_question_files
from ..sources.sharding import spread
from .texts import cleaned


def _root(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("""SELECT suffix, count(*) AS docs, sum(CASE WHEN suffix = 'json' OR coalesce(text, '') <> '' THEN length(coalesce(text, '')) ELSE 3 END)::BIGINT AS chars, sum(doc_id)::BIGINT AS ids
FROM (SELECT *, CASE lang WHEN 'fr' THEN 'csv' WHEN 'de' THEN 'tsv' ELSE 'json' END AS suffix FROM documents) GROUP BY suffix""")
def document_source(spark, sf_dir):
    """Documents written as JSON lines, CSV and TSV by their language, and read back as one folder."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    root = _root(spark, "documents")
    kind = F.when(F.col("lang") == "fr", "csv").when(F.col("lang") == "de", "tsv").otherwise("json")
    docs.where(kind == "json").write.json(f"{root}/json")
    for name, sep in (("csv", ","), ("tsv", "\t")):
        tables = docs.where(kind == name).write.option("header", True).option("sep", sep).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        tables.option("quoteAll", True).csv(f"{root}/{name}")
    parts = [read_documents(spark, f"{root}/json")]
    for name in ("csv", "tsv"):  # Spark names its files .csv whatever their separator
        parts.append(read_documents(spark, f"{root}/{name}", separator="\t" if name == "tsv" else ",").withColumn("suffix", F.lit(name)))
    rows = functools.reduce(DataFrame.unionByName, parts)
    return rows.groupBy("suffix").agg(F.count("*").alias("docs"), F.sum(F.length("text")).cast("long").alias("chars"), F.sum(F.col("meta")["doc_id"].cast("long")).alias("ids"))


@query("SELECT md5(trim(text)) AS question, count(*) AS n FROM benchmark WHERE trim(coalesce(text, '')) <> '' GROUP BY 1")
def question_files(spark, sf_dir):
    """Benchmark items written as JSON lines, half of them under another field, and loaded as questions."""
    items = table(spark, sf_dir, "benchmark")
    root = _root(spark, "questions")
    odd = F.col("item_id") % 2 == 1
    items.select("item_id", F.when(odd, F.col("text")).alias("query"), F.when(~odd, F.col("text")).alias("text")).write.json(root)
    return read_question_files(spark, root).groupBy(F.md5("query").alias("question")).agg(F.count("*").alias("n"))


MEASURES = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax", "line": "l_linenumber", "charge": "l_extendedprice * (1 - l_discount)", "billed": "l_extendedprice * (1 - l_discount) * (1 + l_tax)"}


@query("SELECT l_returnflag AS engine, l_linestatus AS scenario, count(*) AS n, " + ", ".join(f"round(avg({x}), 4) AS mean_{c}" for c, x in MEASURES.items()) + ", min(l_quantity) AS least_quantity, max(l_quantity) AS most_quantity, TRUE AS p50_within, TRUE AS p95_within FROM lineitem GROUP BY 1, 2")
def metric_states(spark, sf_dir):
    """Every rank accumulates its line items, writes its states, and all ranks' states are merged: seven means, extremes, and whether the sketches' quantiles of prices keep their rank error."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("engine"), F.col("l_linestatus").alias("scenario"), (F.col("l_orderkey") % 8).alias("rank"), *[F.expr(x).alias(c) for c, x in MEASURES.items()])
    by, root = ["engine", "scenario"], _root(spark, "accumulators")
    A.accumulated(rows, ["rank", *by], list(MEASURES)).write.partitionBy("rank").parquet(root)
    states = A.merged(spark.read.parquet(root), by, list(MEASURES))
    told = states.select(*by, F.col("price.n").alias("n"), *[F.round(A.mean(c), 4).alias(f"mean_{c}") for c in MEASURES], F.col("quantity.least").alias("least_quantity"), F.col("quantity.most").alias("most_quantity"), A.quantile("price", 0.5).alias("_p50"), A.quantile("price", 0.95).alias("_p95"))
    held = rows.join(F.broadcast(told.select(*[F.col(c).alias(f"_{c}") for c in by], "_p50", "_p95")), F.col("engine").eqNullSafe(F.col("_engine")) & F.col("scenario").eqNullSafe(F.col("_scenario")))  # a row a group
    rank = held.groupBy(*by).agg(*[(F.avg((F.col("price") <= F.col(f"_{p}")).cast("int"))).alias(f"r_{p}") for p in ("p50", "p95")])
    near = lambda p, at: (F.abs(F.col(f"r_{p}") - at) <= 2 * A.RANK_ERROR + 1 / F.col("n")).alias(f"{p}_within")
    return told.join(rank, by).select(*[c for c in told.columns if not c.startswith("_")], near("p50", 0.5), near("p95", 0.95))


CHUNKED = "SELECT 'chars' AS how, doc_id, chunk_idx, md5(chunk) AS chunk FROM ({chars}) UNION ALL SELECT 'words', doc_id, chunk_idx, md5(chunk) FROM ({words}) WHERE chunk_idx < 5 UNION ALL SELECT 'delimiter', doc_id, chunk_idx, md5(chunk) FROM ({delim})"


@query(CHUNKED.format(chars=SQL["chunk_chars"], words=SQL["chunk_words"], delim=SQL["chunk_delim"]))
def chunk_functions(spark, sf_dir):
    """All chunkers called from SQL text as one polymorphic table function; of the word windows five a document, its cap."""
    chunkers.register(spark)
    views = {"cleaned_docs": cleaned(spark, sf_dir).withColumnRenamed("cleaned", "text"), "raw_docs": spread(table(spark, sf_dir, "documents").select("doc_id", "text"))}
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql("""
        SELECT 'chars' AS how, doc_id, chunk_idx, md5(chunk) AS chunk FROM chunks(rows => TABLE(cleaned_docs), text => 'text', how => 'chars', size => 1000, overlap => 200)
        UNION ALL SELECT 'words', doc_id, chunk_idx, md5(chunk) FROM chunks(rows => TABLE(raw_docs), text => 'text', how => 'words', size => 160, overlap => 32, most => 5)
        UNION ALL SELECT 'delimiter', doc_id, chunk_idx, md5(chunk) FROM chunks(rows => TABLE(raw_docs), text => 'text', how => 'delimiter')""")
