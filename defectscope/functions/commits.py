"""Column expressions over commits, repositories and file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from defectscope.functions.text import S

# Words that mark a bug-fix commit, matched as substrings.
BUGFIX_WORDS = ["fix", "bug", "issue", "error", "patch"]

# Commit defaults and the stored message length.
MESSAGE_LENGTH = 500
UNKNOWN_AUTHOR = "Unknown"

# Language of each file extension.
LANGUAGES = {
    ".py": "python", ".java": "java", ".js": "javascript", ".ts": "typescript",
    ".cpp": "cpp", ".c": "c", ".cs": "csharp", ".rb": "ruby", ".go": "go",
    ".rs": "rust", ".php": "php", ".kt": "kotlin", ".scala": "scala",
}

# Extensions the analysis accepts.
ANALYZABLE = [".py", ".java", ".js", ".ts", ".cpp", ".c", ".go"]


def is_bugfix(message: Column) -> Column:
    """True when the whole lower-cased message contains any bug-fix word."""
    return F.coalesce(F.lower(message).rlike("|".join(BUGFIX_WORDS)), F.lit(False))


def parse_iso(text: Column) -> Column:
    """ISO date to a zone-less timestamp; an offset is dropped, not applied; bad text is null."""
    bare = F.regexp_replace(text, "Z$", "")
    iso = r"^(\d{4}-\d\d-\d\d)(?:[T ](\d\d)(?::(\d\d)(?::(\d\d(?:\.\d{1,6})?))?)?(?:[+-]\d\d:?\d\d(?::?\d\d)?)?)?$"

    def piece(i: int) -> Column:
        found = F.regexp_extract(bare, iso, i)
        return F.when(found == "", F.lit("00")).otherwise(found)

    local = F.concat(F.regexp_extract(bare, iso, 1), F.lit(" "), piece(2), F.lit(":"), piece(3), F.lit(":"), piece(4))
    return F.when(bare.rlike(iso), local.try_cast("timestamp_ntz"))


def owner_of(url: Column) -> Column:
    return F.try_element_at(_url_pieces(url), F.lit(-2))


def repo_name_of(url: Column) -> Column:
    return F.regexp_replace(F.element_at(_url_pieces(url), -1), r"\.git", "")


def _url_pieces(url: Column) -> Column:
    return F.split(F.regexp_replace(url, "/+$", ""), "/")


def normalized_url(url: Column) -> Column:
    """Trim, then drop one `.git`, then one `/`, in that order."""
    trimmed = F.regexp_replace(url, rf"^{S}+|{S}+$", "")
    return F.regexp_replace(F.regexp_replace(trimmed, r"\.git$", ""), "/$", "")


def extension_of(path: Column) -> Column:
    """Last suffix of the file name, lower-cased; '' for no dot, a leading dot or a trailing dot."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1))


def language_of(path: Column) -> Column:
    by_extension = F.create_map(*[F.lit(v) for pair in LANGUAGES.items() for v in pair])
    return F.coalesce(F.try_element_at(by_extension, extension_of(path)), F.lit("unknown"))


def is_analyzable(extension: Column) -> Column:
    return extension.isin(ANALYZABLE)


def display_name(path: Column, length: int = 15) -> Column:
    """Last path piece cut at `length`; the whole path when that piece is empty."""
    short = F.substring(F.element_at(F.split(path, "/"), -1), 1, length)
    return F.when(short == "", path).otherwise(short)
