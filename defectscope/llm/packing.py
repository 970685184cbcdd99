"""Mixture-controlled packing of documents into sequences of a fixed number of tokens.

Every source is a queue of tokens, served by deficit round-robin: a window of the output
grants each queue its target share of the window's tokens, the fraction of a token a
queue could not be given is carried to the next window, and a queue that runs dry leaves
its share to the others. Written as running sums, what queue q has sent after k windows is

    B_q(k) = min(floor(p_q * v(k)), T_q)

where p_q is its share, T_q its tokens, and v(k) the point of the schedule at which all
queues together have sent k windows (v bends where a queue runs dry). So every task can
cut its own documents, and the deficits that cross windows and partitions are differences
of B. Windows in order, queues in order inside a window, and documents in order inside a
queue make one stream of tokens; sequences are its consecutive pieces, so that only the
last one is padded.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from defectscope.llm.tables import running_total
from defectscope.llm.tokens import batches_of, encoder
from defectscope.session import scratch_path

# Sequences of one mixture window: within so many sequences the target proportions hold.
WINDOW_SEQUENCES = 32

# Bytes of texts encoded at once: their units and ids take many times as much.
TEXT_BYTES = 1 << 21

TOKENS = "part bigint, row bigint, doc_id {id}, queue string, position bigint, doc_tokens bigint, ids binary"


def _tokenize(tokenizer_path: str, end_id: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, sent = TaskContext.get().partitionId(), 0, {}
        for whole in batches:
            for batch in batches_of(whole, "text", TEXT_BYTES):
                n = batch.num_rows
                ids, ends = encoder(tokenizer_path).ids(batch.column("text"))
                ids, counts = np.insert(ids, ends[1:], end_id), np.diff(ends) + 1
                positions = []
                for queue, size in zip(batch.column("queue").to_pylist(), counts.tolist()):
                    positions.append(sent.get(queue, 0))
                    sent[queue] = positions[-1] + size
                bounds = (4 * np.r_[0, np.cumsum(counts)]).astype(np.int64)
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part)), pa.array(np.arange(row, row + n)), batch.column("doc_id"),
                     batch.column("queue"), pa.array(positions, pa.int64()), pa.array(counts.astype(np.int64)), data.cast(pa.binary())],
                    ["part", "row", "doc_id", "queue", "position", "doc_tokens", "ids"])
                row += n

    return encode


class Schedule:
    """When each window of `size` tokens ends, for the queues of one corpus."""

    def __init__(self, total: int, size: int, points: list[tuple[float, float]]):
        """points: (v, tokens sent by all queues together), rising, from (0, 0) to the end."""
        self.size, self.windows = size, max(1, -(-total // size))
        self.v, self.sent = (np.array(x, float) for x in zip(*points))

    def bound(self, k: np.ndarray, share: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """B of a queue after k windows."""
        v = np.interp(k * float(self.size), self.sent, self.v)
        return np.where(k >= self.windows, tokens, np.minimum(np.floor(share * v).astype(np.int64), tokens))

    def window(self, x: np.ndarray, share: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """The window that sends token x of a queue."""
        sent = np.interp((x + 1) / share, self.v, self.sent)
        k = np.clip((sent // self.size).astype(np.int64), 0, self.windows - 1)
        while (late := (self.bound(k, share, tokens) > x) & (k > 0)).any():
            k = k - late
        while (early := (self.bound(k + 1, share, tokens) <= x) & (k + 1 < self.windows)).any():
            k = k + early
        return k

    def cut(self, documents: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The pieces of documents given as (part, row, queue, position, doc_tokens, share, queue_tokens)."""
        for d in documents:
            a, n = d.position.to_numpy(np.int64), d.doc_tokens.to_numpy(np.int64)
            share, tokens = d.share.to_numpy(float), d.queue_tokens.to_numpy(np.int64)
            first, last = self.window(a, share, tokens), self.window(a + n - 1, share, tokens)
            at = np.repeat(np.arange(len(d)), last - first + 1)
            k = first[at] + np.arange(len(at)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1)
            begin = np.maximum(self.bound(k, share[at], tokens[at]), a[at])
            end = np.minimum(self.bound(k + 1, share[at], tokens[at]), a[at] + n[at])
            out = pd.DataFrame({
                "part": d.part.to_numpy()[at], "row": d.row.to_numpy()[at], "queue": d.queue.to_numpy()[at], "window": k,
                "queue_position": begin, "start": begin - a[at], "length": end - begin})
            yield out[out.length > 0]


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Each document's ids and its place in its task's part of its queue, written once."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("queue"))
    path = scratch_path(docs.sparkSession, "tokens")
    schema = TOKENS.format(id=rows.schema["doc_id"].dataType.simpleString())
    rows.mapInArrow(_tokenize(tokenizer_path, end_id), schema).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def scheduled(parts: DataFrame, total: int, size: int, targets: Mapping[str, float] | None) -> tuple[DataFrame, Schedule]:
    """(queue, share, queue_tokens) and the schedule of the windows."""
    queues = parts.groupBy("queue").agg(F.sum("tokens").alias("queue_tokens"))
    if not targets:
        return queues.withColumn("share", F.col("queue_tokens") / F.lit(float(total))), Schedule(total, size, [(0, 0), (total, total)])
    # Only the listed queues come to the driver; the others keep their own proportions.
    listed = {r.queue: r.queue_tokens for r in queues.where(F.col("queue").isin(list(targets))).collect()}
    rest = total - sum(listed.values())
    weights = {q: float(targets[q]) for q in listed}
    if min(weights.values(), default=1) <= 0:
        raise ValueError("target weights must be positive")
    scale = sum(weights.values()) + rest / total
    flows = [(weights[q] / scale, t) for q, t in listed.items()] + ([(rest / total / scale, rest)] if rest else [])
    ends = sorted({t / p for p, t in flows})
    points = [(0.0, 0.0), *((v, float(sum(min(p * v, t) for p, t in flows))) for v in ends)]
    share = F.col("queue_tokens") / F.lit(float(total)) / F.lit(scale)
    for q, w in weights.items():
        share = F.when(F.col("queue") == q, F.lit(w / scale)).otherwise(share)
    return queues.withColumn("share", share), Schedule(total, size, points)


def pack(docs: DataFrame, tokenizer_path: str, *, sequence_tokens: int = 2048, end_id: int = 1,
         window_sequences: int = WINDOW_SEQUENCES, targets: Mapping[str, float] | None = None,
         id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset), each id in exactly one.

    A document is its tokens and then `end_id`; null text is empty, so its only token is
    `end_id`. `ids` are the piece's little-endian unsigned 32-bit ids. `targets` weighs
    queues; by default each window has the corpus's own proportions, and queues that are
    not named keep theirs. Null and empty sources share a queue. Rows with equal or null
    ids are packed one by one, other columns are ignored, and an empty table gives no piece.

    The ids are shuffled once, to meet the cuts; all else moves narrow rows. One task
    sorts, at most, the parts of a queue: a row for each task that wrote tokens.
    """
    tokens = tokenized(docs, tokenizer_path, end_id, id_col, text_col, source_col)
    parts = tokens.groupBy("queue", "part").agg(F.sum("doc_tokens").alias("tokens"))
    total = parts.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    queues, schedule = scheduled(parts, max(total, 1), sequence_tokens * window_sequences, targets)
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("queue", "part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("queue_start"))
    documents = (tokens.select("part", "row", "queue", "position", "doc_tokens").join(starts.join(queues, "queue"), ["queue", "part"])
                 .select("part", "row", "queue", (F.col("position") + F.col("queue_start")).alias("position"), "doc_tokens", "share", "queue_tokens"))
    pieces = documents.mapInPandas(
        schedule.cut, "part bigint, row bigint, queue string, window bigint, queue_position bigint, start bigint, length bigint")
    placed = running_total(pieces, [F.col("window"), F.col("queue"), F.col("queue_position")], "length", "at")
    size = F.lit(sequence_tokens)
    lone = placed.select("part", "row", "start", "length", "at", F.explode(F.sequence(
        F.expr(f"at div {sequence_tokens}"), F.expr(f"(at + length - 1) div {sequence_tokens}"))).alias("sequence_id"))
    begin = F.greatest(F.col("at"), F.col("sequence_id") * size)
    end = F.least(F.col("at") + F.col("length"), (F.col("sequence_id") + 1) * size)
    cuts = lone.select("part", "row", "sequence_id", (begin - F.col("sequence_id") * size).alias("offset"),
                       (F.col("start") + begin - F.col("at")).alias("start"), (end - begin).alias("length"))
    return tokens.select("part", "row", "doc_id", "doc_tokens", "ids").join(cuts.hint("shuffle_hash"), ["part", "row"]).select(
        "doc_id", "start", "length", F.expr("substring(ids, cast(4 * start + 1 as int), cast(4 * length as int))").alias("ids"),
        "doc_tokens", "sequence_id", "offset")
