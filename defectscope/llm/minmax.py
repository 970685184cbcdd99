"""Min-max hashing: near duplicates by banded signatures of minima and maxima.

Under each permutation of the shingles' hashes both the least and the greatest one of a
document's set are kept. Each agrees in two documents with a probability of their Jaccard
likeness, and the two agree less often together than independent ones would by chance, so
a signature needs half the hash evaluations and has a lower variance. Bands of values are
bucket keys. Candidates that share a bucket are confirmed on their full sets of shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectscope.llm.alike import alike_components, crowded_buckets
from defectscope.llm.simhash import shingle_hashes, text_key
from defectscope.llm.tables import bounded
from defectscope.session import written

LIKENESS = (4, 5)
# A band has the minimum and maximum of three permutations. A pair of likeness 0.8 shares none
# of the bands with probability (1 - 0.8 ** 6) ** 40 = 0.000005, one of 4 in 5 shingles with 0.00006.
BANDS, PERMUTATIONS_IN_BAND = 40, 3
PERMUTATIONS = BANDS * PERMUTATIONS_IN_BAND
MULTIPLIERS = np.random.default_rng(13).integers(0, 2**63, (PERMUTATIONS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
HASHES_AT_ONCE = 1 << 12


def shingle_set(text: str, words_in_shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles: of all words, if there are fewer."""
    return np.unique(np.concatenate([np.empty(0, "<u8"), *shingle_hashes(text, words_in_shingle)]))


def signature(hashes: np.ndarray) -> np.ndarray:
    """(permutations, 2): the least and greatest permuted hash."""
    least, most = np.full(PERMUTATIONS, 2**64 - 1, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(hashes), HASHES_AT_ONCE):
        permuted = MULTIPLIERS * hashes[at:at + HASHES_AT_ONCE]
        least, most = np.minimum(least, permuted.min(1)), np.maximum(most, permuted.max(1))
    return np.stack([least, most], 1)


def bands(hashes: np.ndarray) -> list[int]:
    """The bucket keys of a set that is not empty."""
    values = signature(hashes).reshape(BANDS, -1)
    return [xxhash.xxh64_intdigest(band.tobytes(), n) for n, band in enumerate(values)]


def sketch(text: Column, words_in_shingle: int) -> Column:
    """(n_shingles, set_digest, bands) of each text; no bands without words."""

    @F.pandas_udf("n_shingles bigint, set_digest binary, bands array<bigint>")
    def sketches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                hashes = shingle_set(t or "", words_in_shingle)
                keys = np.array(bands(hashes) if len(hashes) else [], np.uint64).view(np.int64)
                rows.append((len(hashes), hashlib.sha256(hashes.tobytes()).digest()[:16], keys))
            yield pd.DataFrame(rows, columns=["n_shingles", "set_digest", "bands"])

    return sketches(text)


def elements(text: Column, words_in_shingle: int) -> Column:
    """The set of a text as bytes."""

    @F.pandas_udf("binary")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingle_set(t or "", words_in_shingle).tobytes() for t in texts], dtype=object)

    return made(text)


def near_duplicates(docs: DataFrame, *, words_in_shingle: int = 4, likeness: tuple[int, int] = LIKENESS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of `docs`.

    Documents are linked if their sets of shingles have the likeness, by exact comparison;
    `component_id` is the smallest id reachable, and `kept` says that it is the document's
    own. Documents of equal sets are compared once. Null and empty texts have no shingles
    and no links. Null ids never count as smallest: a null id's component is null only if
    nothing reachable has an id, and it is kept only then. Rows of one id are rows of their
    own, other columns are ignored, and an empty table gives an empty result.
    """
    text = F.col(text_col).cast("string")
    named = docs.select(F.col(id_col).alias("doc_id"), text_key(text).alias("text_md5"), text.alias("text"))
    rows = named.select("doc_id", "text_md5", sketch(F.col("text"), words_in_shingle).alias("s")).select("doc_id", "text_md5", "s.*")
    rows = written(rows, "signatures")
    alone = rows.where("n_shingles > 0").groupBy("set_digest").agg(
        F.first("n_shingles").alias("size"), F.first("bands").alias("bands"), F.first("text_md5").alias("text_md5"),
        F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    # Numbers, fixed once they are written, are shorter than digests.
    nodes = written(alone.withColumn("node", F.monotonically_increasing_id()), "nodes")

    def sets_of(wanted: DataFrame) -> DataFrame:
        keys = written(nodes.join(wanted, "node").select("text_md5", "node"), "wanted")
        texts = named.select("text_md5", "text").join(bounded(keys, keys.count()), "text_md5").groupBy("node").agg(F.first("text").alias("text"))
        return texts.select("node", elements(F.col("text"), words_in_shingle).alias("elements"))

    labels = written(alike_components(crowded_buckets(nodes), sets_of, likeness), "labels")
    firsts = labels.join(nodes, "node").groupBy("component").agg(F.min("first").alias("component_id"))
    linked = labels.join(firsts, "component").select("node", "component_id")
    # Texts of no copies and no links are their own components.
    groups = nodes.join(linked, "node", "left").where((F.col("copies") > 1) | F.col("component_id").isNotNull())
    groups = written(groups.select("set_digest", F.coalesce("component_id", "first").alias("component_id")), "groups")
    own = rows.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set_digest")).alias("set_digest"))
    found = own.join(bounded(groups, groups.count()), "set_digest", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
