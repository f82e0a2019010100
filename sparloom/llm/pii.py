"""Personal data: base rules, candidate generators and boosted trees, in SQL alone.

Base spans are e-mail addresses, IPv4 addresses, payment cards (Luhn) and
international phone numbers, each by one leftmost scan.  Generators with high
recall propose further, overlapping spans of any length: long tokens, other chains
of digits, and spelled-out addresses.  Each candidate gets features of its
format and of the words around it; a small ensemble of boosted trees, written
out as one CASE expression, scores it; the threshold is calibrated on held-out
examples so that at least PRECISION of what passes is personal.  A candidate that
overlaps a base span is dropped, as is a selected one inside another; selected
ones may still overlap in part, and redaction replaces their union.

All of it is Catalyst expressions over one row at a time: no Python on the
executors, no shuffle.  A text of n characters and m matches costs about n + m
steps: places are running sums in blocks, overlaps are binary searches, and pieces
of the text are cut from its blocks of BLOCK characters.  The trees are fitted on
the driver on EXAMPLES generated, labelled examples (a fixed, bounded sample; same
seed, same trees), whose features come from the same expressions.

Positions count characters (code points), ends are exclusive.

Defined cases: a null text counts as empty in all_spans() and stays null in
redacted(); null ids and other columns stay as they are; equal spans are listed
once a kind; rows are judged one by one, so repeats agree; an empty table stays
empty; columns named as results are replaced.
"""

from __future__ import annotations

import functools
import random
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, unused

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Whole chains of digits with single separators, 14 to 19 digits: what a greedy scan would find and keep.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$"
KINDS = ("email", "ip", "card", "phone")

TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+"
CHAIN = r"(?<![0-9])[0-9](?:[\x20().-]{0,2}[0-9]){6,}+"
SPELLED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[({]\x20?(?:at|AT)\x20?[\])}]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[({]\x20?(?:dot|DOT)\x20?[\])}])\x20?[A-Za-z0-9-]++)++"
GENERATORS = {"secret": TOKEN, "number": CHAIN, "address": SPELLED}

#: Characters before and after a candidate that its features see.
CONTEXT = 24
EXAMPLES, HELD_OUT, SEED = 4_000, 2_000, 20
TREES, DEPTH, RATE = 24, 3, 0.3
PRECISION = 0.99

SPAN = "struct<start:int,rank:int,end:int,kind:string>"


# ------------------------------------------------------- linear steps over arrays

#: Items of a running sum that are extended one by one, and characters of a block of text (a power of two).
RUN, BLOCK_BITS = 128, 10
BLOCK = 1 << BLOCK_BITS


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """array<int> of the combinations of each item with all before it; 0 changes nothing.

    Arrays grow by copies, so they grow within runs of RUN items only; the runs'
    ends are combined the same way.
    """
    none = F.array().cast("array<int>")

    def extend(held: Column, x: Column) -> Column:
        return F.concat(held, F.array(combine(F.coalesce(F.try_element_at(held, F.lit(-1)), F.lit(0)), x).cast("int")))

    def over_runs(inner: Column) -> Column:
        before = F.aggregate(F.transform(inner, lambda r: F.element_at(r, -1)), F.array(F.lit(0)), extend)
        return F.flatten(F.zip_with(inner, F.slice(before, F.lit(1), F.size(inner)), lambda r, b: F.transform(r, lambda x: combine(x, b).cast("int"))))

    def cut_up(v: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / RUN).cast("int"))
        return F.transform(starts, lambda c: F.aggregate(F.slice(v, c * RUN + 1, F.lit(RUN)), none, extend))

    def whole(v: Column) -> Column:
        return F.when(F.size(v) <= RUN, F.aggregate(v, none, extend)).otherwise(_once(cut_up(v), over_runs))

    return _once(values, whole)


def below(sorted_: Column, value: Column) -> Column:
    """How many items of an ascending array (a bound value) are less than value, by binary search."""
    def step(at: Column, power: Column) -> Column:
        up = at + power
        return F.when((up <= F.size(sorted_)) & (F.get(sorted_, F.least(up, F.size(sorted_)) - 1) < value), up).otherwise(at)

    powers = F.transform(F.sequence(F.floor(F.log2(F.size(sorted_).cast("double"))).cast("int"), F.lit(0), F.lit(-1)), lambda i: F.call_function("shiftleft", F.lit(1), i))
    return F.when(F.size(sorted_) == 0, 0).otherwise(F.aggregate(powers, F.lit(0), step))


def in_blocks(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit(f"(?s).{{1,{BLOCK}}}+"), F.lit(0))


def cut(blocks: Column, start: Column, length: Column) -> Column:
    """Characters of a text kept in blocks; costs what it cuts and a block or two."""
    first = F.shiftright(start, BLOCK_BITS)
    some = F.slice(blocks, first + 1, F.shiftright(start + length, BLOCK_BITS) - first + 1)
    return F.when(length <= 0, "").otherwise(F.substring(F.array_join(some, ""), start - first * BLOCK + 1, length))


# ------------------------------------------------------------------ base spans


def _places(text: Column, pattern: str, unless: Column) -> Column:
    """array<struct<start, end, value>> of a pattern's matches, leftmost first.

    Lengths of the pieces between matches and of the matches add up to places.
    """
    found = F.when(unless, F.array().cast("array<string>")).otherwise(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def placed(f: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(f))
        ends = running(F.zip_with(f, gaps, lambda v, g: F.length(v) + F.length(g)), lambda a, b: a + b)
        return F.zip_with(f, ends, lambda v, e: F.struct((e - F.length(v)).alias("start"), e.alias("end"), v.alias("value")))

    return _once(found, lambda f: F.when(F.size(f) > 0, placed(f)).otherwise(empty))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """True if the digits of a value pass the Luhn sum."""
    back = F.reverse(digits(value))

    def worth(i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    places = F.sequence(F.lit(1), F.greatest(F.length(back), F.lit(1)))
    return F.aggregate(F.transform(places, worth), F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


def _kept(kind: str, x: Column) -> Column:
    if kind == "ip":
        return x["value"].rlike(OCTETS)
    if kind == "card":
        return luhn(x["value"])
    if kind == "phone":
        return F.length(digits(x["value"])).between(10, 15)
    return F.lit(True)


def _span(rank: int, kind: str, x: Column) -> Column:
    return F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"))


def _of_kind(kind: str, x: Column) -> Column:
    return x["kind"] == kind


def base_spans(docs: DataFrame, text: str, out: str = "base") -> DataFrame:
    """Adds out: array of spans of the four base kinds, by start, then kind as listed."""
    value = F.coalesce(F.col(text), F.lit(""))
    no_digit = ~value.rlike("[0-9]")
    unless = {"email": ~F.contains(value, F.lit("@")), "ip": no_digit, "card": no_digit, "phone": no_digit | ~F.contains(value, F.lit("+"))}
    patterns = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True))
    spans, own = [], unused(docs, *[f"_{k}" for k in KINDS])
    for rank, (kind, name) in enumerate(zip(KINDS, own, strict=True)):
        docs = docs.withColumn(name, _places(value, patterns[kind], unless[kind]))
        good = F.filter(F.col(name), functools.partial(_kept, kind))
        spans.append(F.transform(good, functools.partial(_span, rank, kind)))
    return docs.withColumn(out, F.array_sort(F.concat(*spans))).drop(*own)


# ----------------------------------------------------- candidates and their features

#: Words by which people mark what follows as secret, or as a number of a person.
SECRET_WORDS = "(?i)(?:token|secret|passw(?:or)?d|api.?key|key|auth|bearer|credential)"
NUMBER_WORDS = "(?i)(?:phone|tel|mobile|call|fax|ssn|social|passport|iban|account|card|tax)"
FEATURES = ("length", "digits", "letters", "separators", "changes", "hexadecimal", "upper", "distinct", "secret_word", "number_word", "assigned", "quoted", "plus", "grouped", "generator")


def features(kind: int, value: Column, before: Column, after: Column) -> Column:
    """struct of FEATURES as doubles: a candidate's format, and the words around it."""
    n = F.length(value)
    n_digits = F.length(digits(value))
    letters = F.length(F.regexp_replace(value, "[^A-Za-z]", ""))
    got = {
        "length": n,
        "digits": n_digits,
        "letters": letters,
        "separators": n - n_digits - letters,
        "changes": F.regexp_count(value, F.lit("[0-9][A-Za-z]|[A-Za-z][0-9]")),
        "hexadecimal": value.rlike("^[0-9a-fA-F]+$").cast("int"),
        "upper": F.length(F.regexp_replace(value, "[^A-Z]", "")),
        "distinct": F.size(F.array_distinct(F.split(F.substring(value, 1, 64), ""))),
        "secret_word": before.rlike(SECRET_WORDS).cast("int"),
        "number_word": before.rlike(NUMBER_WORDS).cast("int"),
        "assigned": before.rlike("[:=]\\s*[\"']?$").cast("int"),
        "quoted": (before.rlike("[\"']$") & after.rlike("^[\"']")).cast("int"),
        "plus": before.rlike("\\+$").cast("int"),
        "grouped": value.rlike("^\\(?[0-9]{2,4}\\)?[ .-]{1,2}[0-9]{2,4}[ .-][0-9]{3,4}$").cast("int"),
        "generator": F.lit(kind),
    }
    return F.struct(*[got[name].cast("double").alias(name) for name in FEATURES])


# ------------------------------------------------------------------ boosted trees


def examples(n: int, seed: int) -> list[tuple[int, str, str, str, int]]:
    """Generated candidates (generator, value, before, after, personal)."""
    r = random.Random(seed)
    plain = ["the report of", "and then", "see section", "in total", "was born in", "pages", "version", "about", "until", "order", "table"]
    hexa, alnum, num = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "0123456789"
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    word = lambda: pick("abcdefghijklmnopqrstuvwxyz", r.randint(4, 10))
    out = []
    for i in range(n):
        kind, lead, tail = i % 10, r.choice(plain) + " ", " " + word()
        if kind == 0:  # marked secrets
            value = pick(r.choice([hexa, alnum, hexa.upper()]), r.choice([20, 24, 32, 40, 64]))
            quote = r.choice(['"', "'", ""])
            mark = r.choice(["token", "api_key", "secret", "password", "KEY", "Bearer", "auth_token"])
            out.append((0, value, f"{word()} {mark}{r.choice([' = ', ': ', '='])}{quote}", quote + tail, 1))
        elif kind == 1:  # long names, identifiers and dates
            value = r.choice([f"{word()}-{word()}-{pick(num, r.randint(1, 4))}", f"{word()}_{word()}_{word()}{pick(num, 1)}", f"{pick(num, 4)}-{pick(num, 2)}-{pick(num, 2)}-{word()}", f"/{word()}/{word()}/{pick(num, 3)}", word() + word() + pick(num, 1), pick(num, r.randint(16, 30))])
            out.append((0, value, lead, tail, 0))
        elif kind == 2:  # unmarked hashes in prose: ambiguous, mostly harmless
            out.append((0, pick(hexa, r.choice([16, 32, 40])), r.choice(["commit ", "digest ", "revision ", lead]), tail, int(r.random() < 0.05)))
        elif kind == 3:  # phones and numbers of persons, marked
            value = r.choice([f"({pick(num, 3)}) {pick(num, 3)}-{pick(num, 4)}", f"{pick(num, 3)}-{pick(num, 2)}-{pick(num, 4)}", f"{pick(num, 3)}.{pick(num, 3)}.{pick(num, 4)}", pick(num, r.randint(9, 12))]).lstrip("(")
            out.append((1, value, r.choice(["phone: ", "tel. ", "call ", "SSN ", "mobile ", "account: ", "fax "]), tail, 1))
        elif kind == 4:  # plain numbers, failed cards, years and sums
            value = r.choice([pick(num, r.randint(7, 20)), f"{pick(num, 4)} {pick(num, 4)} {pick(num, 4)} {pick(num, 4)}", f"{pick(num, 4)}-{pick(num, 4)}", f"{pick(num, 1)}.{pick(num, 3)}.{pick(num, 3)}", f"{pick(num, 4)}-{pick(num, 2)}-{pick(num, 2)}"])
            out.append((1, value, lead, tail, 0))
        elif kind == 5:  # grouped like a phone but unmarked
            out.append((1, f"{pick(num, 3)} {pick(num, 3)} {pick(num, 4)}", lead, tail, int(r.random() < 0.3)))
        elif kind == 6:  # spelled-out addresses
            a, d = r.choice([("[at]", "[dot]"), ("(at)", "(dot)"), ("{at}", ".")])
            out.append((2, f"{word()} {a} {word()} {d} {r.choice(['com', 'org', 'net', 'de'])}", lead, tail, 1))
        elif kind == 7:  # marked secrets without digits, and very long ones
            value = pick(r.choice([alnum[:52], alnum[:26], alnum, alnum + "+/"]), r.choice([20, 24, 32, 40, 64, 200, 600]))
            quote = r.choice(['"', "'", ""])
            out.append((0, value, f"{word()} {r.choice(['token', 'api_key', 'secret', 'password', 'KEY', 'Bearer', 'auth_token'])}{r.choice([' = ', ': ', '='])}{quote}", quote + tail, 1))
        elif kind == 8:  # long words, and chains of words
            value = r.choice(["", "-", "_", "/"]).join(word() for _ in range(r.randint(3, 12)))
            out.append((0, r.choice([value, value.title(), value.upper()]), r.choice([lead, lead, f"{r.choice(['key', 'name', 'token', 'see'])}: ", f"{word()} "]), tail, 0))
        else:  # marked, but no secret: short or plain values
            out.append((0, f"{word()}-{word()}-{word()}{pick(num, 1)}", f"{r.choice(['key', 'name', 'file'])}: ", tail, 0))
    return out


def fit_trees(x: np.ndarray, y: np.ndarray) -> list[tuple]:
    """Boosted trees of logistic loss; a node is (feature, limit, left, right), a leaf a number."""
    score = np.zeros(len(y))

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        best, total_g, total_h = None, g[rows].sum(), h[rows].sum()
        if depth and len(rows) >= 20:
            for f in range(x.shape[1]):
                order = rows[np.argsort(x[rows, f], kind="stable")]
                left_g, left_h = np.cumsum(g[order])[:-1], np.cumsum(h[order])[:-1]
                apart = x[order[1:], f] > x[order[:-1], f]
                gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
                gain = np.where(apart, gain, -1.0)
                if len(gain) and (k := int(np.argmax(gain))) >= 0 and gain[k] > 1e-6 and (best is None or gain[k] > best[0] + 1e-12):
                    best = gain[k], f, float(x[order[k], f] + x[order[k + 1], f]) / 2
        if best is None:
            return float(RATE * total_g / (total_h + 1))
        _, f, limit = best
        low = x[rows, f] <= limit
        return f, limit, grow(rows[low], g, h, depth - 1), grow(rows[~low], g, h, depth - 1)

    trees = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        trees.append(grow(np.arange(len(y)), y - p, p * (1 - p), DEPTH))
        score += predict(trees[-1:], x)
    return trees


def predict(trees: list, x: np.ndarray) -> np.ndarray:
    def one(node, rows: np.ndarray, out: np.ndarray) -> None:
        if isinstance(node, float):
            out[rows] += node
            return
        f, limit, left, right = node
        low = x[rows, f] <= limit
        one(left, rows[low], out)
        one(right, rows[~low], out)

    out = np.zeros(len(x))
    for tree in trees:
        one(tree, np.arange(len(x)), out)
    return out


def calibrated(score: np.ndarray, y: np.ndarray) -> float:
    """The least threshold on held-out examples above which PRECISION are personal."""
    order = np.argsort(-score, kind="stable")
    precision = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    ends = np.append(score[order][1:] < score[order][:-1], True)
    good = np.flatnonzero(ends & (precision >= PRECISION))
    return float(score[order][good[-1]]) if len(good) else float("inf")


_models: dict[tuple, tuple[list, float]] = {}


def model(spark: SparkSession) -> tuple[list, float]:
    """Trees and threshold; the examples' features come from the expressions that score texts."""
    key = EXAMPLES, HELD_OUT, SEED
    if key not in _models:
        said = examples(EXAMPLES + HELD_OUT, SEED)
        quoted = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
        rows = ", ".join(f"({i}, {g}, {quoted(v)}, {quoted(b)}, {quoted(a)}, {y})" for i, (g, v, b, a, y) in enumerate(said))
        table = spark.sql(f"SELECT * FROM VALUES {rows} AS t(i, g, v, b, a, y)")
        f = features(0, F.col("v"), F.col("b"), F.col("a"))
        got = sorted(table.select("i", "y", "g", f.alias("f")).collect(), key=lambda r: r["i"])
        x = np.array([[*tuple(r["f"])[:-1], float(r["g"])] for r in got])
        y = np.array([r["y"] for r in got], float)
        trees = fit_trees(x[:EXAMPLES], y[:EXAMPLES])
        _models[key] = trees, calibrated(predict(trees, x[EXAMPLES:]), y[EXAMPLES:])
    return _models[key]


def scored(trees: list, f: Column) -> Column:
    """The ensemble's sum as one expression of a features struct."""

    def walk(node) -> Column:
        if isinstance(node, float):
            return F.lit(node)
        k, limit, left, right = node
        return F.when(f[FEATURES[k]] <= limit, walk(left)).otherwise(walk(right))

    total = walk(trees[0])
    for tree in trees[1:]:
        total = total + walk(tree)
    return total


def all_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds base and spans: base spans, and those with what the trees select."""
    docs = base_spans(docs, text)
    trees, limit = model(docs.sparkSession)
    value = F.coalesce(F.col(text), F.lit(""))
    unless = {"secret": F.lit(False), "number": ~value.rlike("[0-9]"), "address": ~value.rlike(r"[\[({]\x20?(?:at|AT)")}
    places = [_places(value, pattern, unless[kind]) for kind, pattern in GENERATORS.items()]
    [held] = unused(docs, "_places")
    docs = docs.withColumn(held, F.array(*places))

    def selected(known: Column, r: int, kind: str, found: Column) -> Column:
        """Of one generator's places: those free of base spans that the trees select."""
        def free(x: Column) -> Column:
            def clear(p: Column) -> Column:
                return (p == 0) | (F.get(known["reach"], p - 1) <= x["start"])

            return _once(below(known["starts"], x["end"]), clear)

        def made(x: Column) -> Column:
            from_ = F.greatest(x["start"] - CONTEXT, F.lit(0))
            before, after = cut(known["blocks"], from_, x["start"] - from_), cut(known["blocks"], x["end"], F.lit(CONTEXT))
            span = F.struct(x["start"].alias("start"), F.lit(len(KINDS) + r).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"))
            return F.struct(_once(features(r, x["value"], before, after), lambda f: scored(trees, f)).alias("score"), span.alias("span"))

        kept = F.filter(F.transform(F.filter(found, free), made), lambda c: c["score"] >= limit)
        return F.transform(kept, lambda c: c["span"])

    known = F.struct(F.transform("base", lambda b: b["start"]).alias("starts"), running(F.transform("base", lambda b: b["end"]), F.greatest).alias("reach"), in_blocks(value).alias("blocks"))
    def outermost(found: Column) -> Column:
        """Without spans that lie inside one before them."""
        before = F.slice(F.concat(F.array(F.lit(0)), running(F.transform(found, lambda s: s["end"]), F.greatest)), F.lit(1), F.size(found))
        told = F.zip_with(found, before, lambda s, b: F.struct(s.alias("span"), (s["end"] > b).alias("out")))
        return F.transform(F.filter(told, lambda t: t["out"]), lambda t: t["span"])

    added = _once(known, lambda k: F.array_sort(F.concat(*[selected(k, r, kind, F.get(held, r)) for r, kind in enumerate(GENERATORS)])))
    added = _once(added, outermost)
    some = F.exists(held, lambda p: F.size(p) > 0)
    return docs.withColumn("spans", F.when(some, F.array_sort(F.concat("base", added))).otherwise(F.col("base"))).drop(held)


def shown(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in brackets, such as [EMAIL]; overlapping spans as one.

    Null texts stay null; other columns, and their order, stay.
    """
    names = docs.columns
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(text).alias("_text"))
    found = all_spans(own, "_text")
    value = F.coalesce(F.col("_text"), F.lit(""))

    def clean(reach: Column) -> Column:
        """reach: the end of all spans so far, after each span."""
        def pieces(blocks: Column) -> Column:
            before = F.slice(F.concat(F.array(F.lit(0)), reach), F.lit(1), F.size("spans"))
            said = F.zip_with("spans", before, lambda s, at: F.when(s["start"] >= at, F.concat(cut(blocks, at, s["start"] - at), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(""))
            end = F.element_at(reach, -1)
            return F.concat(F.array_join(said, ""), cut(blocks, end, F.length(value) - end))

        return _once(in_blocks(value), pieces)

    ends = running(F.transform("spans", lambda s: s["end"]), F.greatest)
    text_of = F.when(F.size("spans") > 0, _once(ends, clean)).otherwise(F.col("_text"))
    return found.withColumn("_text", text_of).select(*[F.col("_text").alias(c) if c == text else F.col("_row")[c].alias(c) for c in names])


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = all_spans(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.filter("base", functools.partial(_of_kind, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return docs.select("doc_id", *counts, F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
