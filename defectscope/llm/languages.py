"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are cut into segments of bytes; one network reads each segment forwards, one
backwards, and their states label every position with a language. A document's
probabilities are the mean over its letter positions. The network is trained here, in
numpy, by backpropagation through time, on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

UNDETERMINED = "und"
# Bytes of a segment, segments read at once, and states of each direction.
SEGMENT = 64
SEGMENTS_AT_ONCE = 4096
HIDDEN = 8
# The fit's bounds: documents of each language, characters of each, steps and segments of one.
DOCUMENTS_PER_LANGUAGE = 400
CHARACTERS = 512
STEPS, BATCH, RATE = 160, 192, 0.02
# Documents with a lower score have no language the network is sure of; of four languages, a guess scores 0.25.
MIN_SCORE = 0.35
# What pads a segment; it has no letter.
PAD = 0
# Positions that count: ASCII letters and all bytes of other characters.
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Network:
    """Weights of both directions: inputs by byte (256, 3h), recurrent (h, 3h), candidate bias (h), and the output layer."""

    languages: list[str]
    weights: dict[str, np.ndarray]

    @staticmethod
    def start(languages: list[str], hidden: int, random: np.random.Generator) -> Network:
        def normal(*shape, scale):
            return random.normal(0, scale, shape).astype(np.float32)

        weights = {}
        for way in "fb":
            weights |= {f"x{way}": normal(256, 3 * hidden, scale=0.3), f"u{way}": normal(hidden, 3 * hidden, scale=hidden ** -0.5),
                        f"c{way}": np.zeros(hidden, np.float32)}
        weights |= {"o": normal(2 * hidden, len(languages), scale=0.3), "d": np.zeros(len(languages), np.float32)}
        return Network(languages, weights)

    def _states(self, way: str, data: np.ndarray, keep: list | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(t, state) of each position of `data` (time, segments), in reading order; `keep` gets what the gradient needs."""
        x, u, c = (self.weights[f"{k}{way}"] for k in "xuc")
        hidden = len(u)
        h = np.zeros((data.shape[1], hidden), np.float32)
        for t in range(len(data)) if way == "f" else range(len(data) - 1, -1, -1):
            inputs, g = x[data[t]], h @ u
            gates = sigmoid(inputs[:, :2 * hidden] + g[:, :2 * hidden])
            z, r = gates[:, :hidden], gates[:, hidden:]
            own = g[:, 2 * hidden:] + c
            n = np.tanh(inputs[:, 2 * hidden:] + r * own)
            if keep is not None:
                keep.append((t, h, z, r, n, own))
            h = n + z * (h - n)
            yield t, h

    def probabilities(self, data: np.ndarray) -> np.ndarray:
        """(time, segments, languages) for bytes (time, segments)."""
        hidden = len(self.weights["uf"])
        out = np.empty((*data.shape, len(self.languages)), np.float32)
        for t, h in self._states("f", data):
            np.matmul(h, self.weights["o"][:hidden], out=out[t])
            out[t] += self.weights["d"]
        for t, h in self._states("b", data):
            out[t] += h @ self.weights["o"][hidden:]
        np.exp(out - out.max(-1, keepdims=True), out=out)
        out /= out.sum(-1, keepdims=True)
        return out

    def gradients(self, data: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over all positions, by backpropagation through time."""
        hidden, steps = len(self.weights["uf"]), len(data)
        kept: dict[str, list] = {"f": [], "b": []}
        states = np.empty((*data.shape, 2 * hidden), np.float32)
        for way, at in (("f", slice(0, hidden)), ("b", slice(hidden, None))):
            for t, h in self._states(way, data, kept[way]):
                states[t, :, at] = h
        logits = states @ self.weights["o"] + self.weights["d"]
        error = np.exp(logits - logits.max(-1, keepdims=True))
        error /= error.sum(-1, keepdims=True)
        error[:, np.arange(data.shape[1]), labels] -= 1
        error /= data.size
        out = {"o": np.tensordot(states, error, ([0, 1], [0, 1])), "d": error.sum((0, 1))}
        back = error @ self.weights["o"].T
        for way, at in (("f", slice(0, hidden)), ("b", slice(hidden, None))):
            u = self.weights[f"u{way}"]
            du, dc, dx = np.zeros_like(u), np.zeros(hidden, np.float32), np.empty((*data.shape, 3 * hidden), np.float32)
            later = np.zeros((data.shape[1], hidden), np.float32)
            for t, h, z, r, n, own in reversed(kept[way]):
                dh = back[t, :, at] + later
                dn = dh * (1 - z) * (1 - n * n)
                dz, dr, down = dh * (h - n) * z * (1 - z), dn * own * r * (1 - r), dn * r
                dg = np.concatenate([dz, dr, down], 1)
                later = dh * z + dg @ u.T
                du += h.T @ dg
                dc += down.sum(0)
                dx[t] = np.concatenate([dz, dr, dn], 1)
            flat, rows = data.reshape(steps * data.shape[1]), dx.reshape(-1, 3 * hidden)
            out |= {f"u{way}": du, f"c{way}": dc,
                    f"x{way}": np.stack([np.bincount(flat, rows[:, k], 256) for k in range(3 * hidden)], 1).astype(np.float32)}
        return out


def train(texts: list[bytes], labels: list[str], *, hidden: int = HIDDEN, steps: int = STEPS, batch: int = BATCH,
          rate: float = RATE, seed: int = 7) -> Network:
    """Fit by Adam on random segments, each language as often as any other."""
    random = np.random.default_rng(seed)
    languages = sorted(set(labels))
    network = Network.start(languages, hidden, random)
    by_language = [[t for t, own in zip(texts, labels) if own == lang] for lang in languages]
    first, second = ({k: np.zeros_like(w) for k, w in network.weights.items()} for _ in range(2))
    for step in range(1, steps + 1):
        wanted = random.integers(len(languages), size=batch)
        data = np.full((batch, SEGMENT), PAD, np.uint8)
        for row, lang in enumerate(wanted):
            text = by_language[lang][random.integers(len(by_language[lang]))]
            at = random.integers(max(1, len(text) - SEGMENT // 4))
            piece = np.frombuffer(text[at:at + SEGMENT], np.uint8)
            data[row, :len(piece)] = piece
        slope = network.gradients(np.ascontiguousarray(data.T), wanted)
        pace = rate * (1 if step < steps * 0.6 else 0.3)
        for k, g in slope.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            change = pace * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)
            network.weights[k] = (network.weights[k] - change).astype(np.float32)
    return network


def pooled(network: Network, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(documents, languages) mean probabilities over the letters of texts lying in `data`; zeros without letters."""
    segments = -(-lengths // SEGMENT)
    document = np.repeat(np.arange(len(lengths)), segments)
    number = np.arange(len(document)) - np.repeat(np.cumsum(segments) - segments, segments)
    begin = starts[document] + number * SEGMENT
    size = np.minimum(lengths[document] - number * SEGMENT, SEGMENT)
    sums, counts = np.zeros((len(lengths), len(network.languages))), np.zeros(len(lengths))
    for at in range(0, len(document), SEGMENTS_AT_ONCE):
        some = slice(at, at + SEGMENTS_AT_ONCE)
        place = np.arange(SEGMENT)[:, None]
        inside = place < size[some]
        values = data[np.minimum(begin[some] + place, len(data) - 1)]
        values[~inside] = PAD
        letters = LETTER[values]
        total = np.einsum("tsl,ts->sl", network.probabilities(values), letters.astype(np.float32))
        for k in range(total.shape[1]):
            sums[:, k] += np.bincount(document[some], total[:, k], len(lengths))
        counts += np.bincount(document[some], letters.sum(0), len(lengths))
    return sums / np.maximum(counts, 1)[:, None]


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(data, starts, lengths) of a string column without copying its texts; null is empty."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(1, np.uint8)
    return data, offsets[:-1], np.diff(offsets)


def label(network: Network | None, text: pa.Array, lettered: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(language, score) of each text; und and 0 without a letter or a network."""
    known = np.asarray(lettered.to_numpy(zero_copy_only=False), bool)
    if network is None or not len(text):
        return pa.array([UNDETERMINED] * len(text), pa.string()), pa.array(np.zeros(len(text)))
    means = pooled(network, *bytes_of(text))
    best = means.argmax(1)
    score = np.clip(means[np.arange(len(best)), best], 0, 1)
    names = np.where(known, np.array(network.languages, object)[best], UNDETERMINED)
    return pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0))


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        documents: int = DOCUMENTS_PER_LANGUAGE, characters: int = CHARACTERS) -> Network | None:
    """A network from at most `documents` texts of each language, `characters` of each from a hashed place.

    Rows with a null id, text or language, without a letter, and the held-out quarter
    (crc32 of the id mod 4 is 2) are never learned from. None if no row is left.
    """
    text = F.col(text_col).cast("string")
    order = F.xxhash64(F.col(id_col).cast("string"))
    place = F.lit(1) + F.pmod(F.xxhash64(F.lit("place"), F.col(id_col).cast("string")), F.greatest(F.lit(1), F.length(text) - characters))
    rows = (docs.where((F.crc32(F.col(id_col).cast("string")) % 4 != 2) & F.col(lang_col).isNotNull() & text.rlike("\\p{L}"))
            .select(F.col(lang_col).cast("string").alias("lang"), order.alias("order"), F.substring(text, place.cast("int"), F.lit(characters)).alias("piece")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("order", "piece"))
    sample = rows.withColumn("rank", rank).where(F.col("rank") <= documents).orderBy("lang", "rank").collect()
    return train([r.piece.encode() for r in sample], [r.lang for r in sample]) if sample else None


def identify(docs: DataFrame, network: Network | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, read whole, without a shuffle.

    `und` with score 0 where the text is null or has no letter, or nothing was learned. A
    null id is not held out. Ids may repeat, other columns are ignored, and an empty table
    gives an empty result.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False)).alias("held_out"),
                       F.coalesce(text, F.lit("")).alias("text"), F.coalesce(text.rlike("\\p{L}"), F.lit(False)).alias("lettered"))
    fields = [rows.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *label(network, batch.column(2), batch.column(3))],
                                             [f.name for f in fields])

    return rows.mapInArrow(labelled, T.StructType(fields))


def keep_languages(docs: DataFrame, network: Network | None, *, languages: list[str] | None = None, min_score: float = MIN_SCORE,
                   text_col: str = "text") -> DataFrame:
    """The rows of `docs`, in their own columns, with a language found: one of `languages` (None: any) by `min_score`."""
    text = F.col(text_col).cast("string")
    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)), F.coalesce(text, F.lit("")).alias("text"),
                       F.coalesce(text.rlike("\\p{L}"), F.lit(False)).alias("lettered"))
    width = len(docs.columns)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, score = label(network, batch.column(width), batch.column(width + 1))
            good = pc.and_(pc.not_equal(found, UNDETERMINED), pc.greater_equal(score, min_score))
            if languages is not None:
                good = pc.and_(good, pc.is_in(found, pa.array(languages, pa.string())))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(width)], [f"c{i}" for i in range(width)]).filter(good)

    plain = rows.drop("text", "lettered").schema
    return rows.mapInArrow(kept, plain).toDF(*docs.columns)
