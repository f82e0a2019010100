"""Result rows of experiments: usable ones, families, speedups over a reference, run files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words that mean yes in a cell; fixed values.
YES = ("1", "true", "yes", "y")
#: Words that mean no in a cell; fixed values.
NO = ("", "0", "false", "no", "n")
#: What two rows of one experiment share; the reference row of a measured row has the same.
SAME = ("model_id", "backend", "context_tokens", "num_agents", "branch_factor")


def number(value: Column) -> Column:
    """A cell as a finite double; blank, unreadable, NaN and infinite cells are null."""
    x = value.cast("string").try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def truthy(value: Column) -> Column:
    """Whether a cell says yes; null says no."""
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin(*YES), F.lit(False))


def usable(available: Column, skipped: Column) -> Column:
    """Available where that is said at all, and skipped, where it is said, says no."""
    return (available.isNull() | truthy(available)) & (skipped.isNull() | F.lower(F.trim(skipped.cast("string"))).isin(*NO))


def family(backend: Column) -> Column:
    """The backend's family by its first letters, else the name in small letters."""
    low = F.lower(backend)
    out = low
    for name in ("hf", "vllm", "sglang"):
        out = F.when(low.startswith(name), name).otherwise(out)
    return out


def cell(value: Column) -> Column:
    """A cell for a table: null is empty, control characters but tabs and line ends are blanks."""
    return F.regexp_replace(F.coalesce(value, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", " ")


def agreement(rates: list[Column], exact: Column) -> Column:
    """The first rate that is a number, held within 0 and 1, else the exact flag as 1 or 0, else null."""
    rate = F.coalesce(*map(number, rates))
    said = F.when(exact.isNotNull() & (exact.cast("string") != ""), truthy(exact).cast("double"))
    return F.when(rate.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), rate))).otherwise(said)


def mean_or_zero(value: Column) -> Column:
    return F.coalesce(F.avg(number(value)), F.lit(0.0))


def speedups(rows: DataFrame, dense: str, measured: str, order: str = "row_id") -> DataFrame:
    """Usable `measured` rows with `speedup`: prefill of the last `dense` row that shares SAME over their own.

    A row's prefill is its prefill_sec, else its ttft_sec.  Rows without both numbers, or whose own is not positive, go.
    One row a key is left of the dense side before the join.
    """
    took = F.coalesce(number(F.col("prefill_sec")), number(F.col("ttft_sec")))
    good = rows.where(usable(F.col("available"), F.col("skipped"))).withColumn("_took", took)
    ref = good.where(F.col("workload_name") == dense).groupBy(*SAME).agg(F.max_by("_took", order).alias("_ref"))
    out = good.where(F.col("workload_name") == measured).join(ref, list(SAME))
    return out.where("_took > 0 and _ref is not null").withColumn("speedup", F.col("_ref") / F.col("_took")).drop("_took", "_ref")


def speedups_at(rows: DataFrame, x: str, metric: str, reference: str, order: str = "row_id") -> DataFrame:
    """(label, x, ratio): each usable row's metric over that of the last reference row of the same model, family, context, branch and x.

    Metrics that are not positive and rows without an x or a label are left out.
    """
    value, at = number(F.col(metric)), number(F.col(x))
    label = F.coalesce(F.nullif(F.trim("baseline_name"), F.lit("")), F.nullif(F.trim("workload_name"), F.lit("")))
    keys = ["model_id", "_family", "context_tokens", "branch_factor", "x"]
    good = rows.where(usable(F.col("available"), F.col("skipped"))).withColumn("_metric", value).withColumn("x", at).withColumn("_family", family(F.col("backend"))).withColumn("label", label)
    good = good.where("_metric > 0 and x is not null and label is not null")
    refs = good.where(F.col("label") == reference).groupBy(*keys).agg(F.max_by("_metric", order).alias("_ref"))
    return good.join(refs, keys).select(order, "label", "x", (F.col("_metric") / F.col("_ref")).alias("ratio"))


def beside_reference(rows: DataFrame, reference: Column, keys: list[str], fallback: str, order: str = "row_id") -> DataFrame:
    """Adds ref_ttft, of the first positive reference row with the same keys, else with the same `fallback`, and speedup.

    Without a reference, a number, or for skipped rows the speedup is 0.  References are reduced to one row a key first.
    """
    ttft = number(F.col("ttft_sec"))
    refs = rows.where(reference & (ttft > 0)).groupBy(*keys).agg(F.min_by(ttft, order).alias("_near"), F.min(order).alias("_at"))
    wide = refs.groupBy(fallback).agg(F.min_by("_near", "_at").alias("_far"))
    out = rows.join(refs.drop("_at"), keys, "left").join(wide, fallback, "left").withColumn("ref_ttft", F.coalesce("_near", "_far"))
    ratio = F.when((ttft > 0) & ~truthy(F.col("skipped")) & F.col("ref_ttft").isNotNull(), ttft / F.col("ref_ttft")).otherwise(0.0)
    return out.withColumn("speedup", ratio).drop("_near", "_far")


def run_rows(spark: SparkSession, path: str, fields: list[str], glob: str = "*") -> DataFrame:
    """(file, fields...) of every JSON run file below a folder: under `metrics` or at the top.

    Files that are no JSON object, that gather other runs, or that have none of the fields are left out.
    """
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    body = raw.select(F.col("_metadata.file_path").alias("file"), F.from_json("value", "map<string,string>").alias("top"))
    inner = F.try_element_at("top", F.lit("metrics"))
    one = body.where("top is not null").select("file", F.coalesce(F.from_json(inner, "map<string,string>"), F.col("top")).alias("run"))
    one = one.where(~F.map_contains_key("run", "runs")).select("file", *[number(F.try_element_at("run", F.lit(f))).alias(f) for f in fields])
    return one.where(F.coalesce(*fields).isNotNull())


def put(left: Column, right: Column) -> Column:
    """Two maps as one; the right one's values win."""
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right)


def in_order(nodes: DataFrame, levels: DataFrame) -> DataFrame:
    """Adds `place`: places in a graph so that each node comes behind all that it depends on, ties as they were told."""
    return nodes.join(levels, ["graph", "node_id"]).withColumn("place", F.row_number().over(Window.partitionBy("graph").orderBy("level", "pos")) - 1)


def text_table(rows: DataFrame, most: int = 200) -> str:
    """A small frame as lines of padded cells under a rule; more than `most` rows are an error."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows")
    cells = [rows.columns] + [["" if v is None else str(v) for v in r] for r in found]
    wide = [max(map(len, column)) for column in zip(*cells, strict=True)]
    lines = [" | ".join(v.ljust(w) for v, w in zip(r, wide, strict=True)) for r in cells]
    return "\n".join([lines[0], "-+-".join("-" * w for w in wide), *lines[1:]])
