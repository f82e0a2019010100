"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, the expected number of its copies.  Rates are the
point of least relative entropy (between 0 and `cap` copies, base: cap / 2) at
which each margin, such as each source, holds its target of words.  The dual of
that convex problem has one multiplier per margin value; the optimum is the
exponential tilt

    rate = cap / (1 + exp(-z * sum of the document's multipliers)),
    z = log2(1 + words) / 10,

and Newton steps find the multipliers: each step is one distributed sum of
gradient and curvature over the cells (margins, size) of the corpus, which are
exact sufficient statistics and need no further pass over documents.  z makes
an entropy unit lie between a document and a word: short documents are kept
more evenly than long ones when a source shrinks.

Rates become copies by exact counts: within each source, cells go from long to
short documents and carry the rounding error on, so a source ends within about
one short document of its target.  Which documents of a cell get the odd copy
follows from hashes of their ids, so reruns agree.

Targets that no rates can meet (margins that contradict each other) raise an error.

Defined cases: a null id is a value like any other; a null source is one source, last in order; a null text has size
0; documents without words take no part (0 copies); repeated rows count each;
an empty table gives an empty result; columns named as results are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, n_words, ranked, read_table

#: Margin values (sources, languages) that a recipe may name: of a single margin, whose curvature is
#: a diagonal, and of several together, whose curvature is a dense matrix on the driver (32 MB).
MAX_MARGIN_VALUES, MAX_JOINT_VALUES = 100_000, 2_000
#: Newton steps within which the targets must be met, and the relative gap that counts as met.
STEPS, TOLERANCE, ACCEPTED = 60, 1e-6, 1e-3


def water_fill(weights: list[float], limits: list[float], total: float) -> list[float]:
    """Shares of total by weight; what a limit cuts off is shared anew by weight."""
    out, free, left = [0.0] * len(weights), set(range(len(weights))), total
    while free:
        unit = left / sum(weights[i] for i in free)
        over = [i for i in sorted(free) if weights[i] * unit > limits[i]]
        for i in over or sorted(free):
            out[i] = limits[i] if over else weights[i] * unit
        if not over:
            break
        left -= sum(limits[i] for i in over)
        free -= set(over)
    return out


def recipe(sizes: dict[str, int], cycle: tuple[float, ...], share: float, cap: float) -> dict[str, float]:
    """Targets of sources: weights cycle over them in code-point order, '' (null) last."""
    names = sorted(sizes, key=lambda k: (k == "", k))
    weights = [cycle[i % len(cycle)] for i in range(len(names))]
    filled = water_fill(weights, [cap * sizes[k] for k in names], share * sum(sizes.values()))
    return dict(zip(names, filled, strict=True))


def _small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    if len(rows) > MAX_MARGIN_VALUES:
        raise ValueError(f"{len(rows)} margin values; {MAX_MARGIN_VALUES} at most")
    return F.broadcast(spark.createDataFrame(rows, schema))


def balance(cells: DataFrame, targets: dict[str, dict[str, float]], cap: float = 2.0) -> DataFrame:
    """Adds rate to cells (one column per margin, size, n); targets: words by margin and value.

    Margin values are strings.  A value whose target reaches cap times its size
    has the limit rate cap, one with target 0 rate 0; both leave the dual.
    """
    spark, margins = cells.sparkSession, list(targets)
    z = F.log2(F.col("size") + 1) / 10
    full = {m: {} for m in margins}
    for m in margins:
        for value, words in cells.groupBy(m).agg(F.sum(F.col("n") * F.col("size"))).collect():
            full[m][value] = float(words)
    index = {(m, v): i for i, (m, v) in enumerate((m, v) for m in margins for v in sorted(full[m]))}
    fixed = {}
    for (m, v), _ in index.items():
        goal = targets[m].get(v, 0.0)
        if goal >= cap * full[m][v] * (1 - 1e-12):
            fixed[m, v] = np.inf
        elif goal <= 0:
            fixed[m, v] = -np.inf
    if len(index) > (MAX_MARGIN_VALUES if len(margins) == 1 else MAX_JOINT_VALUES):
        raise ValueError(f"{len(index)} margin values; {MAX_MARGIN_VALUES} of one margin or {MAX_JOINT_VALUES} of several at most")
    goals = np.array([targets[m].get(v, 0.0) for m, v in index])
    free = np.array([k not in fixed for k in index], bool)
    share = np.clip([g / max(cap * full[m][v], 1e-9) for g, (m, v) in zip(goals, index, strict=True)], 1e-9, 1 - 1e-9)
    lam = np.log(share / (1 - share)) / len(margins)  # the optimum if z were 1 everywhere

    def with_rate() -> DataFrame:
        out = cells
        for m in margins:
            rows = [(v, float(np.clip(fixed.get((m, v), lam[index[m, v]]), -1e3, 1e3))) for v in full[m]]
            out = out.join(_small(spark, rows, f"`{m}` string, `_l_{m}` double"), m)
        eta = sum((F.col(f"_l_{m}") for m in margins[1:]), F.col(f"_l_{margins[0]}"))
        tilt = cap / (1 + F.exp(-z * eta))
        rate = F.when(eta > 400, F.lit(cap)).when(eta < -400, F.lit(0.0)).otherwise(tilt)
        return out.withColumn("rate", rate).drop(*[f"_l_{m}" for m in margins])

    gap, measure = np.inf, np.maximum(1.0, goals)  # each value's gap is held against its own target
    for _ in range(STEPS if free.any() else 0):
        words = F.col("n") * F.col("size")
        sums = with_rate().groupBy(*margins).agg(
            F.sum(words * F.col("rate")).alias("g"),
            F.sum(words * z * F.col("rate") * (1 - F.col("rate") / cap)).alias("h"),
        ).collect()
        gradient, diagonal = goals.copy(), np.zeros(len(index))
        curvature = np.zeros((len(index), len(index))) if len(margins) > 1 else None
        for *values, g, h in sums:
            at = [index[m, v] for m, v in zip(margins, values, strict=True)]
            gradient[at] -= g
            diagonal[at] += h
            if curvature is not None:
                curvature[np.ix_(at, at)] += h
        gap = float((np.abs(gradient) / measure)[free].max())
        if gap <= TOLERANCE:
            break
        if curvature is None:
            step = gradient[free] / np.maximum(diagonal[free], 1e-9)
        else:
            step = np.linalg.lstsq(curvature[np.ix_(free, free)] + 1e-9 * np.eye(int(free.sum())), gradient[free], rcond=None)[0]
        lam[free] += np.clip(step, -3, 3)
    if free.any() and gap > max(TOLERANCE, ACCEPTED):
        raise ValueError(f"no rates meet the targets: a value is {gap:.3%} of its target apart after {STEPS} Newton steps")
    return with_rate()


def _rounded(cap: float):
    """Of one source's cells: copies of each document (base) and how many get one more."""

    def run(table: pa.Table) -> pa.Table:
        size, n, rate = (np.asarray(table.column(c)) for c in ("size", "n", "rate"))
        order = np.lexsort((-rate, -size))
        carry, base, more = 0.0, [], []
        for s, count, r in zip(size[order].tolist(), n[order].tolist(), rate[order].tolist(), strict=True):
            limit = int(np.ceil(cap)) * count if s else 0
            copies = min(limit, max(0, round(r * count + carry / s))) if s else 0
            carry += (r * count - copies) * s
            base.append(copies // count)
            more.append(copies % count)
        return table.take(pa.array(order)).append_column("base", pa.array(base, pa.int64())).append_column("more", pa.array(more, pa.int64()))

    return run


def _margin(source) -> F.Column:
    return F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", cycle: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, _keep: bool = False) -> DataFrame:
    """key, size, source_size, target, rate, copies and taken (copies * size) of each row.

    Sources' weights cycle over them in code-point order; together they share
    `share` times all words, none above cap times its own.
    """
    tall = docs.select(F.col(key).alias("_id"), _margin(F.col(source)).alias("m0"), n_words(F.col(text)).alias("size"))
    tall = materialize(tall, "mixing")  # texts are read once
    cells = materialize(tall.groupBy("m0", "size").agg(F.count("*").alias("n")), "mixing-cells")
    sizes = {m: int(s) for m, s in cells.groupBy("m0").agg(F.sum(F.col("n") * F.col("size"))).collect()}
    if not sizes:
        return tall.select(F.col("_id").alias(key), "size", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0.0).alias("rate"), F.lit(0).cast("long").alias("copies"), F.lit(0).cast("long").alias("taken"), *([F.col("m0").alias("_m")] if _keep else []))
    goals = recipe(sizes, cycle, share, cap)
    rated = balance(cells, {"m0": goals}, cap)
    rounded = materialize(rated.select("m0", "size", "n", "rate").groupBy("m0").applyInArrow(_rounded(cap), "m0 string, size long, n long, rate double, base long, more long"), "mixing-copies")
    told = _small(docs.sparkSession, [(m, sizes[m], goals[m]) for m in sizes], "m0 string, source_size long, target double")
    placed = ranked(tall, ["m0", "size"], ["_id"], "_place")
    copies = F.col("base") + F.when(F.col("_place") < F.col("more"), 1).otherwise(0)
    return placed.join(rounded, ["m0", "size"]).join(told, "m0").select(F.col("_id").alias(key), "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *([F.col("m0").alias("_m")] if _keep else []))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken.

    Rows that share id, source and size take part in the group's copies in turn:
    together exactly as many as mix() says, and none over one more than another.
    """
    names = docs.columns
    taken = mix(docs, key, text, source, _keep=True, **how)
    taken = taken.groupBy(F.col(key).alias("_k"), F.col("_m").alias("_m"), F.col("size").alias("_size")).agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows"))
    taken = materialize(taken.where("_copies > 0"), "mixed")
    size, rest = n_words(docs[text]), F.col("_copies") % F.col("_rows")
    joined = docs.join(taken, docs[key].eqNullSafe(taken["_k"]) & _margin(docs[source]).eqNullSafe(taken["_m"]) & (size == taken["_size"]))
    times, cells = F.floor(F.col("_copies") / F.col("_rows")), [docs[c] for c in names]
    both = joined.where(rest == 0).select(*cells, times.cast("int").alias("_times"))
    if not taken.where(rest > 0).isEmpty():  # alike rows that share an odd number of copies; mostly there are none
        turn = F.row_number().over(Window.partitionBy("_k", "_m", "_size").orderBy(F.xxhash64(docs[text]))) - 1
        both = both.union(joined.where(rest > 0).select(*cells, (times + F.when(turn < rest, 1).otherwise(0)).cast("int").alias("_times")))
    return both.where("_times > 0").select(*names, F.explode(F.array_repeat(F.lit(0), F.col("_times"))).alias("_again")).drop("_again")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"))
