"""Small tables with every awkward case, and plain Python forms of the operators' rules."""

import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, fingerprint string, n_words long, key string, k int, h int, kept string, ids string, spans string, base string, shard string, copies string, _text string"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7))) for _ in range(n))


def texts():
    shared = prose(1, 70)
    near = shared.split()
    near[5] = "changed"
    return [
        prose(2, 120), prose(2, 120), prose(2, 120), None, "", " \n\t ", "one", "two words", shared, " ".join(near),
        prose(3, 60) + " " + shared + "\n" + prose(4, 30), shared + "  " + prose(5, 10), "ÄÖÜ 😀😀 \x1c x\x85y", "A b C " * 80,
        "mail a.b@c.org, 10.0.0.1 and +1 (212) 555-0100 or 4111 1111 1111 1111", 'key = "0123456789abcdef0123456789abcdef"',
        prose(6, 9000), "x" * 60_000, "7" * 30_000, "line\nline\nline\n" + prose(7, 55),
    ]


def documents(spark):
    rows = []
    for i, t in enumerate(texts()):
        rows.append((i, t, [None, "en", "fr"][i % 3], [None, "a", "b", "ä"][i % 4], len(t or ""), 5, "f", 6, "key", 1, 2, "no", "i", "s", "b", "x", "c", "t"))
    rows.append(rows[0])  # a repeated row
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def plain(spark):
    """The same without rows of equal ids."""
    return documents(spark).dropDuplicates(["doc_id"])


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")


def folder(df, path, name="documents"):
    df.write.parquet(f"{path}/{name}.parquet")
    return str(path)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
