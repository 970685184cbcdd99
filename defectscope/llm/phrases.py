"""Document fingerprints by locally consistent parsing.

A text is parsed in levels. At each level, runs of one symbol become one symbol, and
deterministic coin tossing turns each symbol and its left neighbour into a small label:
twice the lowest bit in which they differ, plus that bit. After four tosses labels are
small, neighbours still differ, and a phrase starts wherever a label is a local maximum.
A phrase's name is a hash of its symbols, and names are the symbols of the next level. A
boundary depends on a few symbols around it alone, so equal substrings get equal phrases
at any offset, except near their ends. A fingerprint holds the smallest phrase names of
two levels; the likeness of two fingerprints is the mean of the Jaccard similarities they
estimate.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Levels whose phrases are kept: of about 9 and about 27 code points.
LEVELS = (2, 3)
# Phrase names kept of each level.
KEPT = 48
# Code points parsed at once (one text more may follow), and rows dealt to one bucket.
CODE_POINTS_AT_ONCE = 1 << 19
BUCKET_ROWS, MAX_BUCKETS = 2000, 4096

ODD_A, ODD_B, ODD_C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
LOWEST = np.array([0] + [(x & -x).bit_length() - 1 for x in range(1, 256)], np.uint8)


def mixed(x: np.ndarray) -> np.ndarray:
    """Hashes of 64-bit numbers."""
    x = x * ODD_A
    x ^= x >> np.uint64(29)
    x *= ODD_B
    x ^= x >> np.uint64(32)
    return x


def coins(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels under 16 in which neighbours differ; a text's first symbol has no left neighbour and a label of its own."""
    differing = symbols[1:] ^ symbols[:-1]
    differing &= ~differing + np.uint64(1)
    # A power of two has its exponent in the bits of a float.
    bit = (differing.astype(np.float64).view(np.uint64) >> np.uint64(52)) - np.uint64(1023)
    labels = np.empty(len(symbols), np.uint8)
    labels[1:] = (bit << np.uint64(1)) | (symbols[1:] >> bit) & np.uint64(1)
    labels[first] = 128
    for own in (16, 10, 8):
        bit = LOWEST[labels[1:] ^ labels[:-1]]
        labels[1:] = (bit << 1) | (labels[1:] >> bit) & 1
        labels[first] = own
    return labels


def parsed(symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The phrases of the next level: names and the number of the text each is from."""
    starts = np.empty(len(symbols), bool)
    starts[:1], starts[1:] = True, (symbols[1:] != symbols[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(starts)
    run = np.diff(at, append=len(symbols))
    symbols, owner = symbols[at], owner[at]
    long = run > 1
    symbols[long] = mixed(symbols[long] + run[long].astype(np.uint64) * ODD_C)
    first = np.empty(len(symbols), bool)
    first[:1], first[1:] = True, owner[1:] != owner[:-1]
    labels = coins(symbols, np.flatnonzero(first))
    starts = first
    starts[1:-1] |= (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:]) & (owner[1:-1] == owner[2:])
    at = np.flatnonzero(starts)
    place = np.arange(len(symbols)) - np.repeat(at, np.diff(at, append=len(symbols)))
    names = np.add.reduceat(mixed(symbols + (place + 1).astype(np.uint64) * ODD_C), at)
    return mixed(names), owner[at]


def fingerprints(texts: list[str]) -> list[tuple[np.ndarray, ...]]:
    """For each text, the smallest distinct phrase names (32 bits) of each kept level, sorted."""
    lengths = np.array([len(t) for t in texts])
    kept: list[list[np.ndarray]] = [[np.empty(0, np.uint32)] * len(LEVELS) for _ in texts]
    if lengths.sum():
        owner = np.repeat(np.arange(len(texts)), lengths)
        # surrogatepass: a lone surrogate is a code point like any other.
        symbols = mixed(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1))
        for level in range(1, max(LEVELS) + 1):
            symbols, owner = parsed(symbols, owner)
            if level in LEVELS:
                names = (symbols >> np.uint64(32)).astype(np.uint32)
                texts_here, at = np.unique(owner, return_index=True)
                for text, part in zip(texts_here.tolist(), np.split(names, at[1:])):
                    kept[text][LEVELS.index(level)] = np.unique(part)[:KEPT]
    return [tuple(k) for k in kept]


def likeness(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> float:
    """0 to 1; empty texts are like each other alone."""
    total = 0.0
    for x, y in zip(a, b):
        union = np.union1d(x, y)
        if max(len(x), len(y)) == KEPT:
            union = union[:KEPT]
        both = np.intersect1d(x, y, assume_unique=True)
        total += float(np.isin(both, union, assume_unique=True).sum()) / len(union) if len(union) else 1.0
    return total / len(LEVELS)


def shown(fingerprint: tuple[np.ndarray, ...]) -> str:
    return "-".join(level.astype(">u4").tobytes().hex() for level in fingerprint)


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by the beginning of the next one."""
    third = len(text) // 3
    return text[:len(text) - third] + following[:third]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of stretches of consecutive rows of a bucket; the last text is the next row's, for which no id is given."""
    ids, texts, bucket, size = [], [], None, 0
    for batch in batches:
        for own, guest, number, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "guest", "doc_id", "text"))):
            if guest or own != bucket:
                if guest and own == bucket and len(ids) == len(texts) and ids:
                    yield ids, [*texts, text]
                    ids, texts, size = [], [], 0
                if guest:
                    continue
                ids, texts, bucket, size = [], [], own, 0
            elif size > CODE_POINTS_AT_ONCE:
                yield ids, [*texts, text]
                ids, texts, size = [], [], 0
            ids.append(number)
            texts.append(text)
            size += len(text)


def _compared(id_type: pa.DataType):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _neighbours(batches):
            changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
            prints = fingerprints(texts + changed)
            own, new = prints[:len(texts)], prints[len(texts):]
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, id_type), pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]),
                pa.array(list(map(shown, own[:-1])), pa.string()), pa.array(list(map(shown, new)), pa.string()),
                pa.array(list(map(likeness, own, new)), pa.float64()), pa.array(list(map(likeness, own, own[1:])), pa.float64()),
            ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return compare


def fingerprint_neighbours(docs: DataFrame, *, bucket_rows: int = BUCKET_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The next document is the one with the next smaller id (nulls last, equal ids by text),
    after the last one the first. Ids are whole numbers; null text is empty; other columns are
    ignored; an empty table gives an empty result. Texts are shuffled once, into buckets of
    consecutive ids, and each bucket also gets the first text of the next one.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = rows.count()
    buckets = max(1, min(MAX_BUCKETS, -(-n // bucket_rows)))
    cuts = rows.select(F.percentile_approx("doc_id", [k / buckets for k in range(1, buckets)], 100 * buckets)).first()[0] if buckets > 1 else []
    # Bucket 0 has the largest ids; null ids come in a bucket of their own at the end.
    cuts = sorted(set(cuts or []))
    bucket = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(
        F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<bigint>"), lambda c: c > F.col("doc_id"))))
    rows = rows.select("doc_id", "text", bucket.alias("bucket"))
    # One row a bucket: at most MAX_BUCKETS + 2.
    firsts = [(r.bucket, r.first) for r in rows.groupBy("bucket").agg(F.max("doc_id").alias("first")).orderBy("bucket").collect()]
    before = [(firsts[k - 1][0], first) for k, (_, first) in enumerate(firsts)]
    ids = [first for _, first in before if first is not None]
    border = F.col("doc_id").isin(ids)
    if any(first is None for _, first in before):
        border = border | F.col("doc_id").isNull()
    guests = rows.where(border).groupBy("doc_id").agg(F.min("text").alias("text"))
    home = docs.sparkSession.createDataFrame(before, "bucket int, first bigint") if before else None
    dealt = rows.withColumn("guest", F.lit(False))
    if home is not None:
        guests = guests.join(F.broadcast(home), F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", "text", "bucket", F.lit(True).alias("guest"))
        dealt = dealt.unionByName(guests)
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket", "guest", F.desc_nulls_last("doc_id"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}[kind]
    return dealt.select("bucket", "guest", "doc_id", "text").mapInArrow(_compared(arrow), schema)
