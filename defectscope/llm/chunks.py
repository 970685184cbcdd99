"""Substring deduplication by content-defined chunks.

A gear hash rolls over the code points of a text. A text is cut at every word start whose
hash of the code points that follow is the lowest of some WINDOW consecutive word starts.
So cuts depend on the text around them alone, also in repeated lines, and are at most
WINDOW words apart; the variable chunks between them do not shift with what is inserted
elsewhere, and any two disjoint windows inside a passage hold a whole chunk of it.

Chunks are deduplicated by digest: one that stands in several documents belongs to the one
with the smallest id. Each run of such chunks is an anchor between two texts, which is
extended, code point by code point, to the true ends of what they share. Stretches of
enough words are repeated passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectscope.llm.simhash import text_key
from defectscope.llm.tables import bounded, wrapped
from defectscope.session import written

# Word starts of which one is a cut.
WINDOW = 20
# A chunk of fewer words is digested with the words after it, up to this number.
DIGEST_WORDS = 6
# Words of the shortest passage that is reported.
MIN_WORDS = 40
# Code points a hash looks at: in its low bits are those alone.
REACH = 16
# Places of the bitmap of shared digests: 16 MB at most, in rows of 4 kB.
BITMAP_BITS = 27
CODE_POINTS_AT_ONCE = 1 << 20
# Pairs of texts compared at once.
PAIRS_AT_ONCE = "1000"

GEAR = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(31)).astype(np.uint32)
SPACES = np.array([9, 10, 11, 12, 13, 32], np.uint32)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def rolling(points: np.ndarray) -> np.ndarray:
    """The gear hash after each code point: sum of GEAR shifted by the distance, over the last 32."""
    h = GEAR[(points ^ (points >> np.uint32(8))) & np.uint32(255)]
    for reach in (1, 2, 4, 8, 16):
        h[reach:] += h[:-reach] << np.uint32(reach)
    return h


def words_of(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words, which ASCII white space parts."""
    edges = np.diff(np.r_[True, np.isin(points, SPACES), True].astype(np.int8))
    return np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)


def cuts(points: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Numbers of the words that begin a chunk; the first word always does."""
    starts, _ = words_of(points)
    if not len(starts):
        return starts
    hashes = rolling(points)[np.minimum(starts + REACH - 1, len(points) - 1)] << np.uint32(32 - REACH)
    size = min(window, len(starts))
    # The last of the lowest in each window.
    lowest = np.lib.stride_tricks.sliding_window_view(hashes, size)[:, ::-1].argmin(1)
    return np.unique(np.r_[0, np.arange(len(lowest)) + size - 1 - lowest])


def chunks_of(points: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(start, end, end of what is digested) of the chunks of a text, which are all its words."""
    first = cuts(points, window)
    starts, ends = words_of(points)
    last = np.r_[first[1:], len(starts)] - 1
    digested = np.minimum(np.maximum(last, first + DIGEST_WORDS - 1), len(starts) - 1)
    return list(zip(starts[first].tolist(), ends[last].tolist(), ends[digested].tolist())) if len(first) else []


def _chunked(id_type: pa.DataType, window: int):
    schema = ["row", "doc_id", "text_md5", "start", "digest"]

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            counts = [len(h[3]) for h in held]
            at = np.repeat(np.arange(len(held)), counts)
            ids, keys = (pa.array([h[k] for h in held], kind).take(pa.array(at)) for k, kind in ((1, id_type), (2, pa.binary())))
            return pa.RecordBatch.from_arrays([
                pa.array(np.repeat([h[0] for h in held], counts)), ids, keys, pa.array(np.concatenate([h[3] for h in held]).astype(np.int32)),
                pa.array(np.concatenate([h[4] for h in held]).view(np.int64))], schema)

        for batch in batches:
            for number, key, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_md5", "text"))):
                row += 1
                if not text:
                    continue
                points = code_points(text)
                found = chunks_of(points, window)
                if not found:
                    continue
                digest = xxhash.xxh3_64_intdigest
                held.append((row, number, key, np.array([c[0] for c in found], np.int64),
                             np.array([digest(text[a:b].encode("utf-8", "surrogatepass")) for a, _, b in found], np.uint64)))
                size += len(points)
                if size > CODE_POINTS_AT_ONCE:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return chunk


def named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), text_key(text).alias("text_md5"), text.alias("text"))


def chunks(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, text_md5, start, digest): the chunks of every text; `row` tells rows apart."""
    rows = named(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType
    arrow = rows.limit(0).toArrow().schema.field("doc_id").type
    return rows.mapInArrow(_chunked(arrow, window), f"row bigint, doc_id {kind.simpleString()}, text_md5 binary, start int, digest bigint")


def shared_stretch(a: np.ndarray, b: np.ndarray, i: int, j: int) -> tuple[int, int]:
    """Where the stretch of `a` around i that `b` has around j begins and ends."""
    back, ahead, step = 0, 0, 256
    while back < min(i, j):
        size = min(step, i - back, j - back)
        differ = np.flatnonzero(a[i - back - size:i - back] != b[j - back - size:j - back])
        if len(differ):
            back += size - 1 - int(differ[-1])
            break
        back, step = back + size, 2 * step
    step = 256
    while ahead < min(len(a) - i, len(b) - j):
        size = min(step, len(a) - i - ahead, len(b) - j - ahead)
        differ = np.flatnonzero(a[i + ahead:i + ahead + size] != b[j + ahead:j + ahead + size])
        if len(differ):
            ahead += int(differ[0])
            break
        ahead, step = ahead + size, 2 * step
    return i - back, i + ahead


SPANS = "array<struct<start: bigint, end: bigint, first: bigint, last: bigint>>"


def extended(text: Column, owner_text: Column, anchors: Column, min_words: int) -> Column:
    """The stretches (SPANS, with first and last word) around (start, owner_start) that the owner's text has too; its text null means the same text."""

    @F.pandas_udf(SPANS)
    def spans(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, owners, pairs in batches:
            out = []
            for x, y, places in zip(texts, owners, pairs):
                a = code_points(x)
                starts, ends = words_of(a)
                b = a if y is None else code_points(y)
                found, seen = [], {}
                if y is None:
                    places = [{"start": int(starts[0]), "owner_start": int(starts[0])}]
                for p in sorted(places, key=lambda p: p["start"]):
                    i, j = int(p["start"]), int(p["owner_start"])
                    if i < seen.get(i - j, 0):
                        continue  # inside what an anchor before it has found, on the same way through both texts
                    if i >= len(a) or j >= len(b) or a[i] != b[j]:
                        continue  # another text of the digest
                    begin, end = shared_stretch(a, b, i, j)
                    seen[i - j] = end
                    first, last = int(np.searchsorted(starts, begin)), int(np.searchsorted(ends, end, side="right")) - 1
                    # Words must be whole in the owner too.
                    if first < len(starts) and starts[first] == begin and begin > i - j and b[begin - (i - j) - 1] not in SPACES:
                        first += 1
                    if last >= 0 and ends[last] == end and end - (i - j) < len(b) and b[end - (i - j)] not in SPACES:
                        last -= 1
                    if last - first + 1 >= min_words:
                        found.append((int(starts[first]), int(ends[last]), first, last))
                out.append([{"start": s, "end": e, "first": f, "last": n} for s, e, f, n in sorted(set(found))])
            yield pd.Series(out)

    return spans(text, owner_text, anchors)


def repeated_passages(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, start, end, n_words, kept_doc_ids): passages that stand in documents with smaller ids, in code points.

    Every passage of 48 words and more (two windows and a hash's reach) of equal code points is found,
    with its true ends, in whole words, in the owner of its chunks; shorter ones of `min_words` are, if they hold a
    chunk. `kept_doc_ids` are those of the owners of its chunks that hold `min_words` of it
    at least and are not inside what another owner holds. Repeats inside one document are
    not passages, and rows of one id count as one document. A document without an id keeps
    nothing: its passages are repeats of any document with one. Equal rows give their
    passages once. Null and empty texts have no chunks; other columns are ignored; an empty
    table gives an empty result.
    """
    return passages(docs, **options).drop("text_md5")


def passages(docs: DataFrame, *, min_words: int = MIN_WORDS, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`repeated_passages` with the text's digest, which tells rows of one id apart."""
    pieces = written(chunks(docs, window, id_col, text_col), "chunks")
    # All chunks of a row lie in one task, which leaves one row of them.
    rows = written(pieces.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("text_md5").alias("text_md5"), F.max("start").alias("reach")), "rows")
    # One row a digest and task leaves the first aggregate, however often a passage occurs.
    owners = pieces.groupBy("digest").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.max(F.col("doc_id").isNull()).alias("unnamed"))
    owners = owners.where((F.col("owner") < F.col("last")) | (F.col("unnamed") & F.col("owner").isNotNull())).select("digest", "owner")
    owners = written(owners, "owners")
    # Most chunks stand in one document: a bitmap keeps them out of the shuffle.
    own = F.coalesce(F.col("doc_id") == F.col("owner"), F.lit(False))
    likely = in_bitmap(pieces.select("row", "doc_id", "start", "digest"), owners.select("digest"))
    shared = written(likely.join(bounded(owners, owners.count()), "digest").select("row", "start", "digest", own.alias("own")), "shared")
    # The first and the last place in the owner: between them lie the others of a line that repeats.
    places = shared.where("own").groupBy("digest", "row").agg(F.min("start").alias("least"), F.max("start").alias("most"))
    places = places.groupBy("digest").agg(F.min(F.struct("row", "least", "most")).alias("place"))
    places = places.select("digest", F.col("place.row").alias("owner_row"), F.explode(F.array_distinct(F.array("place.least", "place.most"))).alias("owner_start"))
    places = written(places, "places")
    met = shared.where("NOT own").join(bounded(places, places.count()), "digest")
    # The anchors of one way through two texts, and all ways of two texts: one shuffle serves both.
    ways = met.repartition("row", "owner_row").groupBy("row", "owner_row", (F.col("start") - F.col("owner_start")).alias("way")).agg(F.sort_array(F.collect_set("start")).alias("starts"))
    anchors = F.flatten(F.collect_list(F.transform("starts", lambda s: F.struct(s.alias("start"), (s - F.col("way")).alias("owner_start")))))
    anchored = written(ways.groupBy("row", "owner_row").agg(anchors.alias("anchors")), "anchors")
    # Without the anchors, which are wide.
    known = bounded(rows, rows.count())
    theirs = known.select(F.col("row").alias("owner_row"), F.col("doc_id").alias("owner"), F.col("text_md5").alias("owner_md5"), F.col("reach").alias("owner_reach"))
    pairs = written(anchored.select("row", "owner_row").join(known, "row").join(theirs, "owner_row"), "pairs")
    texts = named(docs, id_col, text_col).select("text_md5", "text")
    wanted = pairs.select("text_md5").union(pairs.where(F.col("owner_md5") != F.col("text_md5")).select(F.col("owner_md5").alias("text_md5"))).distinct()
    wanted = written(wanted, "wanted")
    # One shuffle of these texts serves both joins: it is by their digest.
    texts = texts.join(bounded(wanted, wanted.count()), "text_md5", "left_semi").groupBy("text_md5").agg(F.first("text").alias("text"))
    sent = texts.select(F.col("text_md5").alias("sent_md5"), F.col("text").alias("sent_text"))
    home = texts.select(F.col("text_md5").alias("home_md5"), F.col("text").alias("home_text"))
    both = meetings(pairs).join(anchored, ["row", "owner_row"]).drop("row", "owner_row").join(sent, "sent_md5").join(home, "home_md5")
    own_sent, same = F.col("sent_md5") == F.col("text_md5"), F.col("owner_md5") == F.col("text_md5")
    text, owner_text = F.when(own_sent, F.col("sent_text")).otherwise(F.col("home_text")), F.when(own_sent, F.col("home_text")).otherwise(F.col("sent_text"))
    both = both.select("text_md5", "owner_md5", extended(text, F.when(~same, owner_text), F.col("anchors"), min_words).alias("spans"))
    spark, rows_at_once = docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows_at_once)
    # Two whole texts a row: few rows at once bound what a Python worker holds.
    spark.conf.set(rows_at_once, PAIRS_AT_ONCE)
    try:
        both = written(both.where(F.size("spans") > 0), "spans")
    finally:
        spark.conf.set(rows_at_once, before)
    found = pairs.select("doc_id", "text_md5", "owner", "owner_md5").join(bounded(both, both.count(), 20_000), ["text_md5", "owner_md5"])
    found = found.select("doc_id", "text_md5", "owner", F.inline("spans"))
    ordered = F.sort_array(F.collect_list(F.struct("start", (-F.col("end")).alias("back"), "first", "last", F.col("owner").alias("owner"))))
    kind = docs.select(F.col(id_col).alias("doc_id")).schema["doc_id"].dataType.simpleString()
    passage = f"array<struct<start: bigint, end: bigint, first: bigint, last: bigint, owners: array<{kind}>>>"

    def joined(spans: Column, x: Column) -> Column:
        """Passages so far, and the next one by start: inside the last, beyond it, or apart from it."""
        last = F.try_element_at(spans, F.lit(-1))
        end = -x["back"]
        new = F.struct(x["start"], end.alias("end"), x["first"], x["last"], F.array(x["owner"]).alias("owners"))
        wider = F.struct(last["start"], end.alias("end"), last["first"], x["last"], F.array_union(last["owners"], F.array(x["owner"])).alias("owners"))
        equal = F.struct(last["start"], last["end"], last["first"], last["last"], F.array_union(last["owners"], F.array(x["owner"])).alias("owners"))
        before = F.slice(spans, 1, F.greatest(F.size(spans) - 1, F.lit(0)))
        return (F.when(last.isNull() | (x["start"] >= last["end"]), F.concat(spans, F.array(new)))
                .when(end > last["end"], F.concat(before, F.array(wider)))
                .when((x["start"] == last["start"]) & (end == last["end"]), F.concat(before, F.array(equal))).otherwise(spans))

    merged = found.groupBy("doc_id", "text_md5").agg(ordered.alias("spans")).select(
        "doc_id", "text_md5", F.inline(F.aggregate("spans", F.array().cast(passage), lambda s, x: joined(s, x).cast(passage))))
    return merged.select("doc_id", "text_md5", "start", "end", (F.col("last") - F.col("first") + 1).alias("n_words"), F.array_sort("owners").alias("kept_doc_ids"))


def meetings(pairs: DataFrame) -> DataFrame:
    """(text_md5, owner_md5, row, owner_row, sent_md5, home_md5): each two texts of `pairs` once, with one pair of their rows.

    The text that ends earlier is sent to where the other one lies.
    """
    once = pairs.groupBy("text_md5", "owner_md5").agg(
        F.min(F.struct("row", "owner_row")).alias("rows"), F.first(F.col("reach") < F.col("owner_reach")).alias("shorter"))
    sent, home = (F.when(F.col("shorter"), F.col(x)).otherwise(F.col(y)) for x, y in (("text_md5", "owner_md5"), ("owner_md5", "text_md5")))
    return once.select("text_md5", "owner_md5", "rows.*", sent.alias("sent_md5"), home.alias("home_md5"))


def in_bitmap(chunks: DataFrame, digests: DataFrame) -> DataFrame:
    """Rows whose digest's place is taken by one of `digests`: all of those, and few others unless there are very many."""
    def place(kind: str) -> Column:
        return F.expr(f"{kind}(shiftrightunsigned(digest, {64 - BITMAP_BITS}) + 1)")

    taken = digests.groupBy(place("bitmap_bucket_number").alias("part")).agg(F.expr(f"bitmap_construct_agg(bitmap_bit_position(shiftrightunsigned(digest, {64 - BITMAP_BITS}) + 1))").alias("bits"))
    met = chunks.withColumn("part", place("bitmap_bucket_number")).withColumn("bit", place("bitmap_bit_position"))
    # At most 2 ** BITMAP_BITS bits.
    byte = F.conv(F.hex(F.expr("substring(bits, cast(bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return met.join(F.broadcast(written(taken, "bitmap")), "part").where(F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1).drop("part", "bit", "bits")


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` with repeated passages cut out of their texts; all rows stay, those without passages as they are."""
    spans = passages(docs, id_col=id_col, text_col=text_col, **options).groupBy("doc_id", "text_md5").agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans")).withColumnsRenamed({"doc_id": "span_id", "text_md5": "span_md5"})
    rows = wrapped(docs, doc_id=F.col(id_col), text_md5=text_key(F.col(text_col).cast("string")))
    joined = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("span_id")) & (F.col("text_md5") == F.col("span_md5")), "left")
    text = F.col("row").getField(text_col)
    state = F.aggregate(
        "spans", F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")),
        lambda s, x: F.struct(x["end"].alias("at"), F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))).alias("out")))
    cut = F.concat(state["out"], F.substring(text, (state["at"] + 1).cast("int"), F.length(text)))
    return joined.select(*(F.when(F.col("spans").isNull(), text).otherwise(cut).alias(c) if c == text_col else F.col("row").getField(c).alias(c)
                           for c in docs.columns))
