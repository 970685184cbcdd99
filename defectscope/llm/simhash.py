"""SimHash fingerprints and their near-duplicate groups through BK-trees.

Fingerprints within r bits of one another agree in at least `blocks - r` of `blocks` blocks
of bits, so all links lie inside shards keyed by such a choice of blocks and their bits.
In each shard a BK-tree (children keyed by their integer Hamming distance to the parent)
holds the shard's fingerprints, and searches follow only edges within the radius of the
query's own distance. Distinct fingerprints have no size bound, so trees are not
broadcast: a shuffle brings each shard's fingerprints, of bounded number, to its tree. A
shard that near copies fill beyond the bound is dealt out in cells, each with the tree of
one piece and the queries of another. A cell returns a spanning forest of its links, not
all pairs; connected components of the forests are the groups.

Four bits find hardly any pair of likeness 0.8, and a radius that does would make trees
useless. `like_groups` therefore takes the forests as first candidates only, adds those of
MinHash bands over the same shingles, and links what has the likeness on full sets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectscope.llm.alike import alike_components, crowded_buckets
from defectscope.llm.components import Forest, components
from defectscope.llm.tables import bounded, unwrapped, wrapped
from defectscope.session import written

RADIUS = 4
# Fingerprints of one tree; a shard of over four times as many is dealt out in cells.
SHARD = 4096
# A tree's nodes with so few fingerprints below them keep those as a list.
LEAF = 32
# Shingles hashed, and pairs of fingerprints held, at once.
SHINGLES_AT_ONCE = 1 << 16
PAIRS_AT_ONCE = 1 << 21
# Likeness (Jaccard) in five-word shingles of near copies. A pair of just that much shares one
# of the bands with probability 1 - (1 - 0.8 ** 5) ** 24 = 0.9999.
LIKENESS = (4, 5)
BANDS, BAND_ROWS = 24, 5
MULTIPLIERS = np.random.default_rng(42).integers(0, 2**63, (BANDS * BAND_ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
HASHES_AT_ONCE = 1 << 12


def shingle_hashes(text: str, words_in_shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles, in parts; a text of fewer words is one shingle, one without words has none."""
    # On bytes, lower() changes A-Z alone and split() cuts at space and \x09-\x0D alone.
    words = text.encode().lower().split()
    if not words:
        return
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends[min(words_in_shingle, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(ends), SHINGLES_AT_ONCE):
        some = zip(starts[at:], ends[at:at + SHINGLES_AT_ONCE])
        yield np.array([digest(joined[a:b], 42) for a, b in some], "<u8")


def majority(hashes: Iterable[np.ndarray]) -> int:
    """The 64-bit fingerprint: a bit is set if it is in over half of the hashes."""
    ones, n = np.zeros(64, np.int64), 0
    for some in hashes:
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
        n += len(some)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint_of(text: str, words_in_shingle: int) -> int:
    return majority(shingle_hashes(text, words_in_shingle))


def fingerprint(text: Column, words_in_shingle: int = 4) -> Column:
    """Fingerprints as signed 64-bit numbers; null text has no words."""

    @F.pandas_udf("bigint")
    def fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint_of(t or "", words_in_shingle) for t in texts], np.uint64).view(np.int64))

    return fingerprints(text)


def text_key(text: Column) -> Column:
    """Tells rows of one id apart by their texts; null is empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def shown(bits: Column) -> Column:
    """16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


class BKTree:
    """Fingerprints under pivots: a child's key is its distance to the pivot."""

    def __init__(self, values: np.ndarray):
        self.values, self.root = values, None
        todo = [(np.arange(len(values)), None, 0)]
        while todo:
            rows, parent, key = todo.pop()
            if not len(rows):
                continue
            if len(rows) <= LEAF:
                node = rows
            else:
                node = (rows[0], {})
                distance = np.bitwise_count(values[rows[1:]] ^ values[rows[0]])
                order = np.argsort(distance, kind="stable")
                below, distance = rows[1:][order], distance[order]
                cuts = np.flatnonzero(np.diff(distance)) + 1
                for part, d in zip(np.split(below, cuts), distance[np.r_[0, cuts]].tolist()):
                    todo.append((part, node[1], d))
            if parent is None:
                self.root = node
            else:
                parent[key] = node

    def links(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query numbers, value numbers) within the radius, in batches of bounded size."""
        todo = [(self.root, np.arange(len(queries)))] if self.root is not None else []
        while todo:
            node, asked = todo.pop()
            if isinstance(node, tuple):
                pivot, children = node
                distance = np.bitwise_count(queries[asked] ^ self.values[pivot]).astype(np.int16)
                near = asked[distance <= radius]
                yield near, np.full(len(near), pivot)
                for key, child in children.items():
                    through = asked[np.abs(distance - key) <= radius]
                    if len(through):
                        todo.append((child, through))
            else:
                step = max(1, PAIRS_AT_ONCE // len(node))
                for at in range(0, len(asked), step):
                    some = asked[at:at + step]
                    q, v = np.nonzero(np.bitwise_count(queries[some][:, None] ^ self.values[node][None, :]) <= radius)
                    yield some[q], node[v]


def cell_forest(radius: int):
    def links(cell: pd.DataFrame) -> pd.DataFrame:
        """Spanning forest of the links between a cell's tree side and its query side."""
        values = cell["bits"].to_numpy(np.int64).view(np.uint64)
        i, j = cell["i"].iat[0], cell["j"].iat[0]
        trees = np.flatnonzero(cell["piece"].to_numpy() == i)
        asked = trees if i == j else np.flatnonzero(cell["piece"].to_numpy() == j)
        forest, held, size = Forest(len(values)), [], 0
        for q, v in BKTree(values[trees]).links(values[asked], radius):
            held.append((asked[q], trees[v]))
            size += len(q)
            if size > PAIRS_AT_ONCE:
                forest.link(*map(np.concatenate, zip(*held)))
                held, size = [], 0
        if held:
            forest.link(*map(np.concatenate, zip(*held)))
        child = np.flatnonzero(forest.labels != np.arange(len(values)))
        signed = values.view(np.int64)
        return pd.DataFrame({"a": signed[child], "b": signed[forest.labels[child]]})

    return links


def choices(radius: int, distinct: int, shard: int = SHARD) -> list[int]:
    """Masks of the bits that linked fingerprints share, one of them at least.

    The fewest blocks whose keys are fine enough that an ordinary shard needs few keys;
    any number of blocks gives the same links.
    """
    for blocks in range(radius + 1, 17):
        agree = blocks - radius
        if distinct >> (64 * agree // blocks) <= shard:
            break
    bounds = [64 * k // blocks for k in range(blocks + 1)]
    parts = [((1 << b) - (1 << a)) for a, b in zip(bounds, bounds[1:])]
    masks = [sum(c) for c in combinations(parts, agree)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def linked(distinct: DataFrame, count: int, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(a, b): forests whose components are those of all links among the distinct `bits`."""
    shards = max(1, -(-count // shard))
    keys = F.array(*(F.struct(F.lit(n).alias("choice"), F.pmod(F.xxhash64(F.lit(n), F.col("bits").bitwiseAND(F.lit(mask))), F.lit(shards)).alias("shard"))
                     for n, mask in enumerate(choices(radius, count, shard))))
    placed = distinct.select("bits", F.explode(keys).alias("key")).select("bits", "key.*")
    sizes = placed.groupBy("choice", "shard").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)
    sizes = written(sizes.select("choice", "shard", F.when(F.col("rows") > 4 * shard, F.ceil(F.col("rows") / shard)).otherwise(1).cast("int").alias("pieces")), "shards")
    piece = F.pmod(F.xxhash64(F.lit("piece"), "bits"), F.col("pieces")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
    cells = (placed.join(bounded(sizes, sizes.count()), ["choice", "shard"]).withColumn("piece", piece).withColumn("other", other)
             .select("choice", "shard", F.least("piece", "other").alias("i"), F.greatest("piece", "other").alias("j"), "piece", "bits"))
    return cells.groupBy("choice", "shard", "i", "j").applyInPandas(cell_forest(radius), "a bigint, b bigint")


def near_groups(docs: DataFrame, *, words_in_shingle: int = 4, radius: int = RADIUS, shard: int = SHARD,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_md5, fingerprint, group, component_id) of every row of `docs`.

    Texts are lower-cased in A-Z, cut at ASCII white space into words, and these into
    shingles (fewer words: one shingle of all; none, or null text: fingerprint zero, linked
    like any other). Documents within `radius` bits are linked; `group` is the smallest
    fingerprint and `component_id` the smallest id reachable. Null ids never count as
    smallest: it is null only where a whole group has no id. Equal ids are rows of their
    own, other columns are ignored, and an empty table gives an empty result.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(text).alias("text_md5"), fingerprint(text, words_in_shingle).alias("bits"))
    rows = written(rows, "fingerprints")
    distinct = written(rows.groupBy("bits").agg(F.min("doc_id").alias("first")), "distinct")
    groups = written(components(linked(distinct, distinct.count(), radius, shard), "a", "b"), "groups")
    firsts = groups.join(distinct, groups["node"] == distinct["bits"]).groupBy("component").agg(F.min("first").alias("component_id"))
    known = groups.join(firsts, "component").select(F.col("node").alias("bits"), "component", "component_id")
    # A group's smallest id is null only if all are, and then so is the fingerprint's own.
    named = distinct.join(known, "bits", "left").select("bits", F.coalesce("component", "bits").alias("group"), F.coalesce("component_id", "first").alias("component_id"))
    return rows.join(named, "bits").select("doc_id", "text_md5", shown(F.col("bits")).alias("fingerprint"), "group", "component_id")


def bands_of(hashes: list[np.ndarray]) -> list[int]:
    """Keys of the MinHash bands."""
    least = np.full(len(MULTIPLIERS), 2**64 - 1, np.uint64)
    for some in hashes:
        for at in range(0, len(some), HASHES_AT_ONCE):
            least = np.minimum(least, (MULTIPLIERS * some[at:at + HASHES_AT_ONCE]).min(1))
    return [xxhash.xxh64_intdigest(band.tobytes(), n) for n, band in enumerate(least.reshape(BANDS, BAND_ROWS))]


def sketch(text: Column, words_in_shingle: int) -> Column:
    """(bits, bands, size): the fingerprint, the keys of the bands and the number of distinct shingles."""

    @F.pandas_udf("bits bigint, bands array<bigint>, size bigint")
    def sketches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            hashes = [list(shingle_hashes(t or "", words_in_shingle)) for t in texts]
            yield pd.DataFrame({"bits": np.array([majority(h) for h in hashes], np.uint64).view(np.int64),
                                "bands": [np.array(bands_of(h), np.uint64).view(np.int64) for h in hashes],
                                "size": [len(np.unique(np.concatenate([np.empty(0, "<u8"), *h]))) for h in hashes]})

    return sketches(text)


def elements(text: Column, words_in_shingle: int) -> Column:
    """The set of a text's shingles, as sorted 64-bit hashes in bytes."""

    @F.pandas_udf("binary")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([np.unique(np.concatenate([np.empty(0, "<u8"), *shingle_hashes(t or "", words_in_shingle)])).tobytes() for t in texts], dtype=object)

    return made(text)


def like_groups(docs: DataFrame, *, words_in_shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_md5, group) of every row: components of the pairs of texts with the exact LIKENESS.

    Candidates are the links of the BK-trees and pairs that share a band; `alike_components`
    compares as many of them as the components need, on the full sets of shingles. Texts
    without words are alike, null text is empty, rows of equal or null ids are rows of their
    own, other columns are ignored, and an empty table gives an empty result.
    """
    text = F.col(text_col).cast("string")
    named = docs.select(F.col(id_col).alias("doc_id"), text_key(text).alias("text_md5"), text.alias("text"))
    rows = written(named.select("doc_id", "text_md5", sketch(F.col("text"), words_in_shingle).alias("sketch")).select("doc_id", "text_md5", "sketch.*"), "sketches")
    nodes = rows.groupBy("text_md5").agg(*(F.first(c).alias(c) for c in ("bits", "bands", "size")))
    # Numbers, fixed once they are written, are shorter than digests.
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    firsts = written(nodes.groupBy("bits").agg(F.min_by(F.struct("node", "size"), "node").alias("first")), "firsts")
    forest = linked(firsts.select("bits"), firsts.count())
    a, b = (firsts.select(F.col("bits").alias(n), F.col("first.node").alias(x), F.col("first.size").alias(f"{x}_size")) for n, x in (("a", "x"), ("b", "y")))
    same = nodes.join(firsts, "bits").where(F.col("node") != F.col("first.node")).select(
        F.col("first.node").alias("x"), F.col("first.size").alias("x_size"), F.col("node").alias("y"), F.col("size").alias("y_size"))
    pairs = written(forest.join(a, "a").join(b, "b").select("x", "x_size", "y", "y_size").union(same), "pairs")

    def sets_of(wanted: DataFrame) -> DataFrame:
        keys = written(nodes.join(wanted, "node").select("text_md5", "node"), "wanted")
        texts = named.select("text_md5", "text").join(bounded(keys, keys.count()), "text_md5").groupBy("node").agg(F.first("text").alias("text"))
        return texts.select("node", elements(F.col("text"), words_in_shingle).alias("elements"))

    labels = alike_components(crowded_buckets(nodes), sets_of, LIKENESS, pairs=pairs)
    grouped = written(labels.join(nodes, "node").select("text_md5", "component"), "labels")
    own = rows.select("doc_id", "text_md5").join(bounded(grouped, grouped.count()), "text_md5", "left")
    # A text without links is a group of its own.
    return own.select("doc_id", "text_md5", F.coalesce(F.hex(F.col("component")), F.concat(F.lit("md5:"), F.hex("text_md5"))).alias("group"))


def one_of_each_group(docs: DataFrame, *, grouped=near_groups, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` in its own columns, with the document of the smallest id of each group: without an id last, equal ids by text."""
    groups = written(grouped(docs, id_col=id_col, text_col=text_col, **options), "near")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_md5")
    stays = groups.groupBy("group").agg(F.min(order).alias("stays")).select("group", "stays.doc_id", "stays.text_md5")
    same = F.col("g.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("g.text_md5") == F.col("s.text_md5"))
    seen = groups.alias("g").join(stays.alias("s"), F.col("g.group") == F.col("s.group")).select("g.doc_id", "g.text_md5", same.alias("stays"))
    fates = written(seen.groupBy("doc_id", "text_md5").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("copies")), "fates")
    goes = fates.where(~F.col("stays")).select(F.col("doc_id").alias("gone_id"), F.col("text_md5").alias("gone_md5"))
    rows = wrapped(docs, doc_id=F.col(id_col), text_md5=text_key(F.col(text_col).cast("string")))
    kept = rows.join(goes, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("text_md5") == F.col("gone_md5")), "left_anti")
    if fates.where(F.col("stays") & (F.col("copies") > 1)).limit(1).count():
        # The same row given more than once.
        kept = kept.dropDuplicates(["doc_id", "text_md5"])
    return unwrapped(kept, docs)
