"""Secrets in texts: named assignments, access keys, long hex runs, and random strings.

A string that a byte-pair vocabulary of ordinary text cannot compress is random: words
give three or more characters a token, keys and passwords under two. Runs of key
characters with a low ratio are therefore secrets too, after known digests (hexadecimal
runs of a digest's length) and identifiers (UUIDs, numbers and times, names joined from
words the vocabulary knows) are set aside. Paths and addresses are judged part by part.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectscope.llm.tables import wrapped

# The named kinds, in the order that breaks ties between spans.
KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
# A run of key characters and its padding; `=` parts a name from a value.
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_-])")
SHORTEST_RUN = 16
# What adjoins an access key or hexadecimal run without a sign between belongs to it; before it, if it is random and has so many characters.
GLUED = re.compile(r"[A-Za-z0-9]+")
SHORTEST_GLUED = 8
# In a list, parts between slashes are shorter than this.
LIST_PART = 8
ADDRESS = re.compile(r"\w://\S+")
DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}
DIGEST = re.compile(r"(?:(?:md5|sha-?\d+)[-:=])?([0-9a-f]+|[0-9A-F]+)", re.I | re.A)
UUID = re.compile(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.I | re.A)
# Digits, separators and the letters of times: numbers, cards, phones, dates.
NUMBER = re.compile(r"[-+_/=]*\d[\d+/_=TZ-]*")
# By its shape one word, capitalised or not, or several of them joined, with at most short numbers between.
WORDS = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|\d{1,4})(?:[-_/+=]+(?:[A-Z]?[a-z]+|[A-Z]+|\d{1,4}))*[-_/+=]*")
LETTERS = re.compile(r"[A-Za-z]+")
# Fewer characters a token than this is random.
MAX_RATIO = 2.0
# Names joined from words have so many letters a token, word by word, at least.
NAME_RATIO = 2.0
REDACTED = "[secret]"

RESULT = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_token bigint, redacted string"


def is_encoded_text(run: str) -> bool:
    """Whether it is base64 of readable text; encoded JSON, as in web tokens, does not count."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        decoded = base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except ValueError:
        return False
    return decoded[:1] != b"{" and all(32 <= c < 127 for c in decoded)


class Scanner:
    """Finds the spans of a text with one rank file."""

    _built: dict[tuple[str, str], Scanner] = {}

    def __init__(self, rank_path: str, pattern: str):
        import tiktoken

        with open(rank_path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.vocabulary = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def of(cls, rank_path: str, pattern: str) -> Scanner:
        """One for each Python worker."""
        if (rank_path, pattern) not in cls._built:
            cls._built[rank_path, pattern] = cls(rank_path, pattern)
        return cls._built[rank_path, pattern]

    def tokens(self, text: str) -> int:
        return len(self.vocabulary.encode_ordinary(text))

    def is_name(self, run: str, least: int = 2) -> bool:
        """Words, `least` of them at least, that have the shape and the ratio of names."""
        words = LETTERS.findall(run)
        return len(words) >= least and WORDS.fullmatch(run) is not None and sum(map(len, words)) >= NAME_RATIO * sum(map(self.tokens, words))

    def is_random(self, run: str, max_ratio: float) -> bool:
        digest = DIGEST.fullmatch(run)
        if digest and len(digest[1]) in DIGEST_LENGTHS or UUID.fullmatch(run) or NUMBER.fullmatch(run):
            return False
        return len(run) < max_ratio * self.tokens(run) and not self.is_name(run)

    def random_parts(self, text: str, max_ratio: float) -> Iterator[tuple[int, int]]:
        """Random runs: as a whole, or, of addresses, of lists, and of paths with names in them, those between slashes."""
        addresses = [m.span() for m in ADDRESS.finditer(text)] if "://" in text else []
        for m in RUN.finditer(text):
            while addresses and addresses[0][1] <= m.start():
                addresses.pop(0)
            inside = bool(addresses) and addresses[0][0] < m.start()
            around = text[max(0, m.start() - 1):m.start()] + text[m.end():m.end() + 1]
            if not around.isascii() and around.isalpha() and WORDS.fullmatch(m[0]):
                continue  # the ASCII letters of a longer word
            parts = m[0].split("/")
            a_list = len(parts) > 2 and max(map(len, parts)) < LIST_PART
            if not inside and not a_list and not (len(parts) > 1 and any(len(p) > 3 and self.is_name(p, 1) for p in parts)):
                parts = [m[0]]
            at = m.start()
            for part in parts:
                if len(part) >= SHORTEST_RUN and self.is_random(part, max_ratio) and not (inside and is_encoded_text(part)):
                    yield at, at + len(part)
                at += len(part) + 1

    def rest(self, text: str, start: int, end: int, max_ratio: float) -> Iterator[tuple[int, int]]:
        """What adjoins a key: all behind it, and a random string before it."""
        behind = GLUED.match(text, end)
        if behind:
            yield behind.span()
        at = start
        while at and text[at - 1].isascii() and text[at - 1].isalnum():
            at -= 1
        if start - at >= SHORTEST_GLUED and start - at < max_ratio * self.tokens(text[at:start]):
            yield at, start

    def spans(self, text: str, max_ratio: float) -> list[tuple[int, int, int]]:
        """(start, kind number, end) in code points, sorted."""
        found = []
        if ":" in text or "=" in text:
            found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        base = sorted((a, b) for a, _, b in found)
        more = [part for a, kind, b in found if kind for part in self.rest(text, a, b, max_ratio)]
        for start, end in [*self.random_parts(text, max_ratio), *more]:
            # Base spans stay as they are; what they leave of a random run is added.
            for a, b in base:
                if a < end and start < b:
                    if start < a:
                        found.append((start, 3, a))
                    start = max(start, b)
            if start < end:
                found.append((start, 3, end))
        return self.without_overlaps(found)

    @staticmethod
    def without_overlaps(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Sorted; of added spans, only what no earlier one has."""
        out, at = [], 0
        for start, kind, end in sorted(set(found)):
            if kind == 3:
                start = max(start, at)
                if start >= end:
                    continue
                at = end
            out.append((start, kind, end))
        return sorted(out)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each stretch of overlapping spans replaced."""
    pieces, at = [], 0
    for start, _, end in spans:
        if start >= at:
            pieces += [text[at:start], REDACTED]
        at = max(at, end)
    return "".join([*pieces, text[at:]])


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(text: Column, rank_path: str, pattern: str, max_ratio: float = MAX_RATIO) -> Column:
    """The struct RESULT of each text: counts, digest of the base spans, all spans, redacted text."""

    @F.pandas_udf(RESULT)
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner.of(rank_path, pattern)
        for texts in batches:
            rows = []
            for value in texts:
                value = value or ""
                spans = scanner.spans(value, max_ratio)
                kinds = [kind for _, kind, _ in spans]
                base = _joined([s for s in spans if s[1] < 3])
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(base.encode()).hexdigest(),
                             _joined(spans), kinds.count(3), redact(value, spans) if spans else None))
            yield pd.DataFrame(rows, columns=[field.split()[0] for field in RESULT.split(", ")])

    return scanned(text)


def find_secrets(docs: DataFrame, rank_path: str, pattern: str, *, max_ratio: float = MAX_RATIO,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_token) of every row.

    Row by row, without a shuffle. Null text is empty: no spans. Ids may be null or repeat,
    other columns are ignored, and an empty table gives an empty result.
    """
    found = docs.select(F.col(id_col).alias("doc_id"), scan(F.col(text_col).cast("string"), rank_path, pattern, max_ratio).alias("found"))
    return found.select("doc_id", *(f"found.{c}" for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_token")))


def redacted(docs: DataFrame, rank_path: str, pattern: str, *, max_ratio: float = MAX_RATIO,
             text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """`docs` with secrets replaced in the text, and the length column kept true; all rows stay."""
    rows = wrapped(docs, redacted=scan(F.col(text_col).cast("string"), rank_path, pattern, max_ratio)["redacted"])
    kept = F.col("redacted").isNull()
    columns = []
    for c in docs.columns:
        old = F.col("row").getField(c)
        if c == text_col:
            old = F.coalesce("redacted", old)
        elif c == length_col:
            old = F.when(kept, old).otherwise(F.length("redacted").cast(docs.schema[c].dataType))
        columns.append(old.alias(c))
    return rows.select(*columns)
