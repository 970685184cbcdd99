"""Merkle dataset manifest with inclusion proofs by pointer jumping.

Rows are leaves. The leaves of each language, by id, make a tree of pairs; the roots of
these trees, by language, make the tree of the whole dataset. Trees are hashed in blocks
of 2 ** `step` nodes, so a few grouped jobs build any number of levels.

Every node then holds a pointer to an ancestor and the segment of siblings on the way to
it, at first one level long. A self-join of the nodes on their pointers doubles the
distance and joins the segments, until every leaf reaches the root: rounds grow with the
logarithm of the height. After each round only leaves, the dataset's own tree and nodes
that leaves can still point to are kept: with jumps of 2, 4, 8 levels the other side of
the join shrinks from a half to a quarter, a sixteenth, a 256th of the leaves, so hot
pointers are few and their side is small enough, by its counted bytes, to be broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectscope.llm.tables import bounded, running_total
from defectscope.session import written

# Levels hashed by one task at once: a block has at most 2 ** `step` nodes.
STEP = 12
# Number of the tree over the subroots; those of the languages count from 0.
TOP = -1
# The smaller side of a jump may be broadcast up to so many bytes.
JUMP_BYTES = 1 << 20
# First byte of a sibling's entry in a segment, which its digest follows if there is one.
ALONE, RIGHT, LEFT = b"\0", b"\1", b"\2"
DIGEST = 32


def field(value: Column) -> Column:
    """`-` if null, else the number of UTF-8 bytes, a colon, and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    """SHA-256 of a row's fields, as bytes."""
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def parent_of(children: list[bytes]) -> bytes:
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def _height(nodes: int) -> int:
    """Levels above the leaves of a tree."""
    return (nodes - 1).bit_length()


NODES = "tree bigint, level int, idx bigint, digest binary, segment binary, up struct<tree: bigint, level: int, idx: bigint>"


def _block(step: int):
    def block_nodes(block: pd.DataFrame) -> pd.DataFrame:
        """The nodes of a block at all levels below its top, and its top without a segment."""
        block = block.sort_values("idx")
        tree, level, height = int(block.tree.iat[0]), int(block.level.iat[0]), int(block.height.iat[0])
        nodes, first, out = list(block.digest), int(block.idx.iat[0]), []
        for at in range(level, min(level + step, height)):
            above = []
            for k in range(0, len(nodes), 2):
                run = nodes[k:k + 2]
                above.append(parent_of(run))
                up = {"tree": TOP, "level": 0, "idx": tree} if tree != TOP and at + 1 == height else {"tree": tree, "level": at + 1, "idx": (first + k) >> 1}
                segments = (RIGHT + run[1], LEFT + run[0]) if len(run) == 2 else (ALONE,)
                out += [(tree, at, first + k + n, run[n], s, up) for n, s in enumerate(segments)]
            nodes, first, level = above, first >> 1, at + 1
        out += [(tree, level, first, nodes[0], None, None)]
        return pd.DataFrame(out, columns=["tree", "level", "idx", "digest", "segment", "up"])

    return block_nodes


def build(leaves: DataFrame, highest: int, step: int = STEP) -> tuple[DataFrame, DataFrame]:
    """Nodes (NODES) with their first segments, and the roots (tree, digest), of leaves (tree, idx, height, digest)."""
    current = leaves.withColumn("level", F.lit(0))
    built, roots = [], []
    while True:
        blocks = current.select("tree", "level", "idx", "height", "digest").groupBy("tree", "height", F.shiftright("idx", step).alias("block"))
        level = len(built) * step
        hashed = written(blocks.applyInPandas(_block(step), NODES), "nodes")
        built.append(hashed.where(F.col("up").isNotNull()))
        tops = hashed.where(F.col("up").isNull())
        if highest <= level + step:
            roots.append(tops)
            break
        # Trees that are finished have their root here already.
        heights = current.where(F.col("height") > level + step).groupBy("tree").agg(F.max("height").alias("height"))
        higher = tops.join(heights, "tree", "left")
        roots.append(higher.where(F.col("height").isNull()).select(tops.columns))
        current = written(higher.where(F.col("height").isNotNull()), "tops")
    nodes, tops = built[0], roots[0]
    for more in built[1:]:
        nodes = nodes.union(more)
    for more in roots[1:]:
        tops = tops.union(more)
    return nodes, tops.select("tree", "digest")


def jumped(nodes: DataFrame, highest: int) -> DataFrame:
    """Leaves (tree, idx, segment) with the siblings up to the root, of nodes with pointers."""
    current, reach = nodes.select("tree", "level", "idx", "segment", "up"), 1
    while reach < highest:
        # What a pointer over `reach` levels can meet: nodes at multiples of it, and the top tree.
        targets = current.where((F.col("level") > 0) | (F.col("tree") == TOP)).select(F.struct("tree", "level", "idx").alias("up"), F.col("segment").alias("more"), F.col("up").alias("next"))
        limit = JUMP_BYTES // ((DIGEST + 1) * reach + 48)
        targets = bounded(targets, targets.count(), limit)
        reach *= 2
        kept = current.where((F.col("tree") == TOP) | (F.col("level") % reach == 0))
        # Who has reached the root points to a place of its own that no node has.
        nowhere = F.struct(F.lit(TOP - 1).cast("bigint").alias("tree"), F.col("level").alias("level"), F.col("idx").alias("idx"))
        current = written(kept.join(targets, "up", "left").select(
            "tree", "level", "idx", F.concat("segment", F.coalesce("more", F.lit(b""))).alias("segment"), F.coalesce("next", nowhere).alias("up")), "jumped")
    return current.where(F.col("level") == 0).select("tree", "idx", "segment")


def entries(segment: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(kind, sibling) of each level."""
    at = 0
    while at < len(segment):
        kind = segment[at:at + 1]
        size = 0 if kind == ALONE else DIGEST
        yield kind, segment[at + 1:at + 1 + size]
        at += 1 + size


def folded(leaf: bytes, segment: bytes) -> bytes:
    """The root that a leaf and its siblings give."""
    for kind, other in entries(segment):
        leaf = parent_of([leaf] if kind == ALONE else [leaf, other] if kind == RIGHT else [other, leaf])
    return leaf


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        segments = [s or b"" for s in batch.column("segment").to_pylist()]
        proofs = [hashlib.sha256("".join(other.hex() for _, other in entries(s)).encode()).hexdigest() for s in segments]
        roots = [folded(leaf, s).hex() for leaf, s in zip(batch.column("found").to_pylist(), segments)]
        names = [n for n in batch.schema.names if n not in ("segment", "found")]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(proofs), pa.array(roots)], [*names, "proof_sha256", "folded_root"])


def manifest(docs: DataFrame, *, tampered: Column | None = None, step: int = STEP, id_col: str = "doc_id", source_col: str = "source",
             lang_col: str = "lang", length_col: str = "n_chars", text_col: str = "text") -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    `tampered` is a condition on the given columns: where it holds, the row that is
    verified has a length greater by one, while the proofs are those of the true rows. Null
    fields are `-`, the null language is a tree of its own and comes first, null ids come
    first in their tree. Rows of one id are ordered by their digests, so equal rows are
    leaves of their own, other columns are ignored, and an empty table gives no row.
    """
    columns = [F.col(c) for c in (id_col, source_col, lang_col, length_col, text_col)]
    longer = (columns[3].cast("decimal(38,0)") + 1)
    wrong = F.coalesce(tampered if tampered is not None else F.lit(False), F.lit(False)) & columns[3].isNotNull()
    leaves = docs.select(
        columns[0].alias("doc_id"), columns[2].cast("string").alias("lang"), digest(*columns).alias("digest"),
        F.when(wrong, digest(*columns[:3], longer, columns[4])).alias("wrong"))
    # One row each goes on, without its texts.
    leaves = written(leaves.withColumn("one", F.lit(1).cast("bigint")), "leaves")
    placed = written(running_total(leaves, [F.col("lang").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("digest")], "one", "place"), "placed")
    sizes = placed.groupBy("lang").agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("n"), F.lit(1).cast("bigint").alias("one"))
    trees = written(running_total(sizes, [F.col("start")], "one", "tree"), "trees").drop("one")
    count, largest = trees.agg(F.count(F.lit(1)), F.max("n")).first()
    root_height, highest = _height(count or 1), _height(largest or 1)
    height = F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0)
    known = bounded(trees.select(F.col("lang").alias("tree_lang"), "start", "tree", height.alias("height")), count)
    rows = written(placed.join(known, F.col("lang").eqNullSafe(F.col("tree_lang"))).select(
        "doc_id", "tree", (F.col("place") - F.col("start")).alias("idx"), "height", "digest", "wrong"), "rows")
    nodes, subroots = build(rows.select("tree", "idx", "height", "digest"), highest, step)
    subroots = written(subroots, "subroots")
    tops, roots = build(subroots.select(F.lit(TOP).cast("bigint").alias("tree"), F.col("tree").alias("idx"), F.lit(root_height).alias("height"), "digest"), root_height, step)
    root = roots.first()
    if root is None:
        root_text, proofs = "", rows.select("tree", "idx", F.lit(b"").alias("segment")).limit(0)
    else:
        root_text = root["digest"].hex()
        proofs = jumped(nodes.union(tops), highest + root_height)
    # The only row of a language is its subroot, so it is a leaf of the top tree itself.
    lone = F.col("height") == 0
    leaf = rows.select("doc_id", "digest", F.coalesce("wrong", "digest").alias("found"), F.col("tree").alias("own"), F.when(lone, F.lit(TOP).cast("bigint")).otherwise(F.col("tree")).alias("tree"), F.when(lone, F.col("tree")).otherwise(F.col("idx")).alias("idx"))
    named = bounded(subroots.select(F.col("tree").alias("own"), F.lower(F.hex("digest")).alias("subroot")), count)
    shown = leaf.join(proofs, ["tree", "idx"], "left").join(named, "own").select("doc_id", F.lower(F.hex("digest")).alias("leaf"), "subroot", "found", "segment")
    kind = docs.select(columns[0]).schema[0].dataType.simpleString()
    checked = shown.mapInArrow(_verify, f"doc_id {kind}, leaf string, subroot string, proof_sha256 string, folded_root string")
    return checked.select("doc_id", "leaf", "subroot", F.lit(root_text).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(root_text)).alias("verified"))


SQL = """
WITH RECURSIVE f AS (
  SELECT doc_id, lang, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') AS a, coalesce(strlen(source) || ':' || source, '-') AS b, coalesce(strlen(lang) || ':' || lang, '-') AS c,
         n_chars, coalesce(strlen(text) || ':' || text, '-') AS e FROM documents),
z AS (
  SELECT doc_id, lang, sha256(a || b || c || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || e) AS leaf,
         CASE WHEN xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
                lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, bit: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)), 4294967295) % 7 = 0 THEN sha256(a || b || c || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || e) END AS wrong FROM f),
r AS (SELECT *, dense_rank() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx FROM z),
t(tree, level, idx, h, n) AS (
  SELECT tree, 0, idx, leaf, count(*) OVER (PARTITION BY tree) FROM r
  UNION ALL
  SELECT tree, level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (max(n) + 1) // 2 FROM t WHERE n > 1 GROUP BY tree, level, idx // 2),
s AS (SELECT tree, h, level FROM t WHERE n = 1),
u(level, idx, h, n) AS (
  SELECT 0, tree, h, (SELECT count(*) FROM s) FROM s
  UNION ALL
  SELECT level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (max(n) + 1) // 2 FROM u WHERE n > 1 GROUP BY level, idx // 2),
root AS (SELECT h FROM u WHERE n = 1),
p(doc_id, tree, level, top, idx, proof, h, leaf) AS (
  SELECT doc_id, r.tree, 0, FALSE, r.idx, '', coalesce(r.wrong, r.leaf), r.leaf FROM r
  UNION ALL
  SELECT p.doc_id, p.tree, CASE WHEN NOT p.top AND own.n = 1 THEN 0 ELSE p.level + 1 END, p.top OR own.n = 1, CASE WHEN NOT p.top AND own.n = 1 THEN p.tree ELSE p.idx // 2 END,
         p.proof || coalesce(side.h, ''),
         CASE WHEN NOT p.top AND own.n = 1 THEN p.h WHEN side.h IS NULL THEN sha256(p.h) WHEN p.idx % 2 = 0 THEN sha256(p.h || side.h) ELSE sha256(side.h || p.h) END, p.leaf
  FROM p JOIN (SELECT FALSE AS top, tree, level, idx, h, n FROM t UNION ALL SELECT TRUE, -1, level, idx, h, n FROM u) own
         ON own.top = p.top AND own.level = p.level AND own.idx = p.idx AND own.tree = CASE WHEN p.top THEN -1 ELSE p.tree END
       LEFT JOIN (SELECT FALSE AS top, tree, level, idx, h FROM t UNION ALL SELECT TRUE, -1, level, idx, h FROM u) side
         ON side.top = p.top AND side.level = p.level AND side.idx = xor(p.idx, 1) AND side.tree = own.tree
  WHERE NOT (p.top AND own.n = 1)),
last AS (SELECT p.* FROM p JOIN u ON p.top AND u.level = p.level AND u.n = 1)
SELECT doc_id, leaf, s.h AS subroot, root.h AS root, sha256(proof) AS proof_sha256, last.h AS folded_root, last.h = root.h AS verified
FROM last JOIN s USING (tree) CROSS JOIN root
"""
