"""Token ids as the public tokenizer libraries give them, encoded from few distinct words.

`WordEncoder` covers files of the `tokenizers` library whose normalizer turns white
space into separators and whose pre-tokenizer drops it (NFC, white space, lower case;
split by pattern; byte-level BPE with word ends). There a text's ids are the ids of its
white-space-separated chunks in order, and those of most chunks are a word's and its
marks'. Texts are cut and numbered in Arrow, distinct words and chunks are encoded once and
remembered, and ids are gathered by number. Any other file goes through its library text
by text.
"""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Words and chunks remembered by one Python worker; when more come, the memory starts anew.
MEMORY = 700_000
# Longer ones are encoded each time instead of being remembered.
REMEMBERED_LENGTH = 64

# A word of basic and Latin-1 letters and then ASCII punctuation: composed, of one case
# mapping, and split by the pre-tokenizer exactly between the two groups.
PLAIN_CHUNK = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]*)(?P<marks>[!-/:-@\[-`{-~]*)$"


def file_digest(path: str) -> str:
    """Names a tokenizer version: SHA-256 of its file."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def drops_white_space(path: str) -> bool:
    """Whether a text's tokens are those of its white-space-separated chunks (see above)."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    normalizers = (spec.get("normalizer") or {}).get("normalizers", [])
    split, *rest = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    return (
        [n["type"] for n in normalizers] == ["NFC", "Replace", "Lowercase"]
        and normalizers[1]["pattern"] == {"Regex": "\\s+"} and normalizers[1]["content"] == " "
        and split.get("type") == "Split" and split.get("behavior") == "Removed" and bool(split.get("invert"))
        and split["pattern"] == {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}
        and [r["type"] for r in rest] == ["ByteLevel"] and not rest[0]["add_prefix_space"] and not rest[0]["use_regex"]
        and not any(" " in a["content"] or a["single_word"] or a["normalized"] for a in spec["added_tokens"])
        and not (spec.get("post_processor") or spec.get("truncation") or spec.get("padding"))
    )


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return dict(zip(shown, map(chr, shown))) | {b: chr(256 + i) for i, b in enumerate(hidden)}


class LibraryEncoder:
    """Ids text by text from the file's own library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            self.pieces, self.library = None, Tokenizer.from_file(path)
            self.library.no_truncation()
            self.library.no_padding()

    def lists(self, texts: list[str]) -> list[list[int]]:
        if self.pieces is not None:
            return self.pieces.encode(texts, num_threads=1)
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        return [np.asarray(ids, "<u4").tobytes() for ids in self.lists(texts)]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and where those of each text begin; null is empty."""
        lists = self.lists([t or "" for t in texts.to_pylist()])
        ends = np.cumsum([0, *map(len, lists)])
        return np.concatenate([np.empty(0, "<u4"), *(np.asarray(x, "<u4") for x in lists)]), ends

    def counts(self, texts: pa.Array) -> np.ndarray:
        return np.diff(self.ids(texts)[1])


class WordEncoder(LibraryEncoder):
    """The same ids from remembered chunks."""

    def __init__(self, path: str):
        super().__init__(path)
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        # The bare merges, for words that are already normalized and written in byte letters.
        spec |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "WhitespaceSplit"}}
        self.merges = Tokenizer.from_str(json.dumps(spec))
        self.last = np.zeros(self.merges.get_vocab_size(), bool)
        for token, number in self.merges.get_vocab().items():
            self.last[number] = token.endswith("</w>")
        letters = _byte_letters()
        # Lower-case Latin-1 letters; what they are replaced by holds none of them.
        self.letters = [(chr(c), "".join(letters[b] for b in chr(c).encode())) for c in range(0xDF, 0x100)]
        # Ids of plain words and marks, and of other chunks.
        self.words: dict[str, bytes] = {"": b""}
        self.chunks: dict[str, bytes] = {}

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words that are one pre-token each, from one pass over all of them."""
        joined = " ".join(words)
        for letter, shown in self.letters:
            joined = joined.replace(letter, shown)
        ids = np.asarray(self.merges.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
        ends = 4 * (np.flatnonzero(self.last[ids]) + 1)
        if len(ends) != len(words):  # a vocabulary without some letter's word end
            return self._chunks(words)
        data = ids.tobytes()
        return dict(zip(words, (data[a:b] for a, b in zip([0, *ends[:-1]], ends))))

    def _chunks(self, chunks: list[str]) -> dict[str, bytes]:
        return dict(zip(chunks, super().encode(chunks)))

    @staticmethod
    def _known(names: pa.Array, memory: dict[str, bytes], learn) -> list[bytes]:
        """The ids of distinct names, remembered if they are short."""
        names = names.to_pylist()
        new = [n for n in names if n not in memory]
        if new:
            if len(memory) + len(new) > MEMORY:
                memory.clear()
                memory[""] = b""
                new = [n for n in names if n]
            memory.update(learn(new))
        out = [memory[n] for n in names]
        for n in new:
            if len(n) > REMEMBERED_LENGTH:
                del memory[n]
        return out

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Numbers of the units (a word, its marks) in order, where those of each text begin, and the ids of each number."""
        # ASCII white space alone: what else the tokenizer drops stays inside a chunk.
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        chunks = split.flatten().dictionary_encode()
        begins = split.offsets.to_numpy().astype(np.int64)
        parts = pc.extract_regex(chunks.dictionary, PLAIN_CHUNK)
        plain = parts.is_valid().to_numpy(zero_copy_only=False)
        words, marks = (pc.struct_field(parts, k).filter(pa.array(plain)).dictionary_encode() for k in ("word", "marks"))
        lowered = pc.utf8_lower(words.dictionary).dictionary_encode()
        other = chunks.dictionary.filter(pa.array(~plain))
        known = self._known(lowered.dictionary, self.words, self._words)
        known_marks = self._known(marks.dictionary, self.words, self._words)
        known_other = self._known(other, self.chunks, self._chunks)
        units = np.empty((len(plain), 2), np.int64)
        units[plain, 0] = lowered.indices.to_numpy()[words.indices.to_numpy()] if plain.any() else 0
        units[plain, 1] = marks.indices.to_numpy() + len(known)
        nothing = len(known) + len(known_marks) + len(known_other)
        units[~plain, 0] = np.arange(len(known_other)) + len(known) + len(known_marks)
        units[~plain, 1] = nothing
        numbers = chunks.indices.to_numpy()
        return units[numbers].ravel() if len(numbers) else np.empty(0, np.int64), 2 * (begins - begins[0]), [*known, *known_marks, *known_other, b""]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        numbers, begins, known = self._cut(texts)
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        data, places = np.frombuffer(b"".join(known), "<u4"), np.cumsum(sizes) - sizes
        lengths = sizes[numbers]
        ends = np.r_[0, np.cumsum(lengths)]
        # From the place of each unit's ids onward, as many as it has.
        at = np.arange(ends[-1]) + np.repeat(places[numbers] - ends[:-1], lengths)
        return data[at], ends[begins]

    def counts(self, texts: pa.Array) -> np.ndarray:
        numbers, begins, known = self._cut(texts)
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        return np.diff(np.r_[0, np.cumsum(sizes[numbers])][begins])

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, ends = self.ids(pa.array(texts, pa.string()))
        data = ids.tobytes()
        return [data[4 * a:4 * b] for a, b in zip(ends, ends[1:])]


def batches_of(batch: pa.RecordBatch, texts: str, size: int = 1 << 23, rows: int = 4096):
    """Slices of a batch with a bounded number of bytes in its texts, of one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(texts)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for k, n in enumerate(lengths.tolist()):
        if k > start and (held + n > size or k - start >= rows):
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += n
    if batch.num_rows:
        yield batch.slice(start)


_ENCODERS: dict[str, LibraryEncoder] = {}


def encoder(path: str) -> LibraryEncoder:
    """The encoder of a file, built once in each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = (WordEncoder if drops_white_space(path) else LibraryEncoder)(path)
    return _ENCODERS[path]
