"""Small tables with the odd cases every operator must stand, and brute-force versions."""

import random
import re

from pyspark.sql import types as T

# Columns that operators use inside themselves, given here as extra columns of the input.
CLASHING = ["row", "part", "ids", "queue", "bits", "group", "digest", "score", "found", "tokens", "start", "window", "text_md5",
            "blocks", "c0", "guest", "bucket", "position", "n_words", "__md5", "host", "key", "lettered", "redacted"]
DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    *(T.StructField(c, T.StringType()) for c in CLASHING)])


def prose(seed: int, words: int) -> str:
    own = random.Random(seed)
    return " ".join("".join(own.choice("aeioustrnlm") for _ in range(own.randint(2, 9))) for _ in range(words))


def documents(spark, rows):
    """rows: (doc_id, text, lang, source)."""
    full = [(i, t, lang, source, None if t is None else len(t), *("x" for _ in CLASHING)) for i, t, lang, source in rows]
    return spark.createDataFrame(full, DOCUMENTS).repartition(3)


def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    rows = [(i, prose(i, 30 + 7 * i), "en", f"s{i % 3}") for i in range(12)]
    rows += [
        (20, None, "en", "s0"), (21, "", None, None), (22, " \n\t ", "de", ""), (None, prose(90, 40), None, "s1"), (None, prose(91, 40), "en", None),
        (None, None, None, None), (30, prose(5, 65), "en", "s0"), (31, prose(5, 65), "en", "s1"), (31, prose(5, 65), "en", "s1"), (31, prose(92, 15), "fr", "s2"),
        (40, prose(93, 30_000), "en", "s0"), (41, "z" * 70_000, "en", "s0"), (42, "Ünï <|endoftext|> ß\r\n 日本語 " * 3, "de", "s1"),
        (43, "one two", "en", "s2"), (44, "12 34 !!", "en", "s2")]
    return rows


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def leaks(text, items, window=10):
    """(words hit, item ids as strings) by looking at every window of every item."""
    own, hit, found = words(text), set(), set()
    for item, item_text in items:
        theirs = words(item_text)
        size = min(window, len(theirs))
        runs = {tuple(theirs[i:i + size]) for i in range(len(theirs) - size + 1)} if size else set()
        for i in range(len(own) - size + 1):
            if tuple(own[i:i + size]) in runs:
                hit.update(range(i, i + size))
                found.add(item)
    return len(hit), sorted(str(i) for i in found if i is not None)


def groups(values, near):
    """The group number of each value under all pairs `near` accepts."""
    label = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label
