"""Line counts, declaration counts and smells as expressions over a `content` column.

One scan of a corpus evaluates them all; no row leaves the JVM. White space and word
characters are spelled as explicit classes, so that they mean the same set (the Unicode
one) in every regex engine the results are compared with.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space and word characters.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"\p{L}\p{N}_"

INLINE_SPACE = f"[{SPACE}&&[^\\n]]"
S, NOT_S, W, NOT_W = f"[{SPACE}]", f"[^{SPACE}]", f"[{WORD}]", f"[^{WORD}]"

# What counts as an import, a declaration, a parameter list and a body.
PYTHON_IMPORT = rf"(?m)^(?:from{S}+{NOT_S}+{S}+)?import{S}+[^\n]+$"
JAVA_IMPORT = rf"(?m)^import{S}+[{WORD}.]+;"
JAVA_CLASS = rf"(?:^|{NOT_W})(?:class|interface|enum){S}+{W}+"
JAVA_METHOD = rf"(?:public|private|protected){S}+{W}+{S}+{W}+{S}*\([^)]*\){S}*\{{"
PYTHON_DEF = rf"def{S}+{W}+{S}*\(([^)]+)\)"
BRACE_BODY = r"\{[^{}]*\}"

# Smell limits.
LARGE_FILE_LINES = 500
MAX_PARAMETERS = 5
GOD_CLASS_METHODS = 20
LONG_BODY_LINES = 50

# Our own list: tokens that open a branch, for the corpus-wide complexity estimate.
BRANCH_WORDS = ["if", "elif", "for", "while", "except", "case", "catch", "and", "or"]
BRANCH_SIGNS = ["&&", "||"]

SMELL = T.StructType([
    T.StructField("smell_type", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("line_start", T.IntegerType()),
    T.StructField("message", T.StringType()),
])


def _pattern(regex: str) -> Column:
    # Unix lines: only \n ends a line, as in the engines we agree with.
    return F.lit("(?d)" + regex)


def occurrences(content: Column, regex: str) -> Column:
    return F.regexp_count(content, _pattern(regex))


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def line_count(content: Column) -> Column:
    """Pieces between newlines, so a trailing newline adds an empty last line."""
    return newlines(content) + 1


def _lines_starting(content: Column, what: str) -> Column:
    """Lines with `what` after leading white space, counted in one pass without cutting lines."""
    return occurrences(content, rf"(?m)^{INLINE_SPACE}*+{what}")


def blank_lines(content: Column) -> Column:
    # `^` does not match behind a final newline, yet the empty piece there is a blank line.
    return _lines_starting(content, "$") + F.when(content.endswith("\n"), 1).otherwise(0)


def comment_lines(content: Column, language: Column) -> Column:
    """Python `#` lines, Java `//`, `/*` and `*` lines, none for other languages."""
    return (
        F.when(language == "python", _lines_starting(content, "#"))
        .when(language == "java", _lines_starting(content, r"(?://|/\*|\*)"))
        .otherwise(F.lit(0))
    )


def fan_out(content: Column, language: Column) -> Column:
    return (
        F.when(language == "python", occurrences(content, PYTHON_IMPORT))
        .when(language == "java", occurrences(content, JAVA_IMPORT))
        .otherwise(F.lit(0))
    )


def java_classes(content: Column) -> Column:
    return occurrences(content, JAVA_CLASS)


def java_methods(content: Column) -> Column:
    return occurrences(content, JAVA_METHOD)


def decision_points(content: Column) -> Column:
    """1 + branch tokens; a corpus-wide estimate, not a parser's cyclomatic complexity."""
    words = rf"(?<!{W})(?:{'|'.join(BRANCH_WORDS)})(?!{W})"
    signs = "|".join(s.replace("|", r"\|") for s in BRANCH_SIGNS)
    # Most positions start no token: a look at the first character settles them.
    first = "".join(sorted({w[0] for w in BRANCH_WORDS + BRANCH_SIGNS}))
    return 1 + occurrences(content, rf"(?=[{first}])(?:{words}|{signs})")


def imported_names(content: Column, language: Column) -> Column:
    """Modules a file imports: the `from` module, else each imported name, without its alias."""
    python_from = rf"(?m)^from{S}+({NOT_S}+){S}+import{S}+[^\n]+$"
    # Up to a comment or a second statement of the line.
    python_plain = rf"(?m)^import{S}+([^\n#;]+)"
    java = rf"(?m)^import{S}+([{WORD}.]+);"
    return (
        F.when(language == "python", F.concat(
            F.regexp_extract_all(content, _pattern(python_from), 1),
            F.array_compact(F.flatten(F.transform(
                F.regexp_extract_all(content, _pattern(python_plain), 1),
                lambda names: F.transform(F.split(names, ","), lambda name: F.get(F.regexp_extract_all(name, _pattern(rf"^{S}*([{WORD}.]+)"), 1), 0))))),
        ))
        .when(language == "java", F.regexp_extract_all(content, _pattern(java), 1))
        .otherwise(F.array().cast("array<string>"))
    )


def import_statements(content: Column, language: Column) -> Column:
    """(module, member) of each import: one for every name after `from module import`, member null for plain imports."""
    kind = "array<struct<module: string, member: string>>"
    none = F.lit(None).cast("string")
    # A list in brackets may run over several lines.
    from_pattern = _pattern(rf"(?m)^{INLINE_SPACE}*from{S}+([.{WORD}]+){S}+import{S}*(\([^)]*\)|{S}[^\n;#(]+)")
    modules, lists = F.regexp_extract_all(content, from_pattern, F.lit(1)), F.regexp_extract_all(content, from_pattern, F.lit(2))
    pairs = F.arrays_zip(modules.alias("module"), lists.alias("members"))

    def members(pair: Column) -> Column:
        bare = F.regexp_replace(pair["members"], r"#[^\n]*", "")
        names = F.filter(F.regexp_extract_all(bare, F.lit(rf"(?:^|[,(])[{SPACE}(]*([{WORD}]+|\*)"), F.lit(1)), lambda n: n != "")
        return F.transform(names, lambda n: F.struct(pair["module"].alias("module"), F.when(n != "*", n).alias("member")))

    plain_pattern = _pattern(rf"(?m)^{INLINE_SPACE}*import{S}+([^\n#;]+)")
    plain = F.flatten(F.transform(F.regexp_extract_all(content, plain_pattern, F.lit(1)), lambda line: F.regexp_extract_all(line, F.lit(rf"(?:^|,){S}*([{WORD}.]+)"), F.lit(1))))
    java = F.regexp_extract_all(content, _pattern(rf"(?m)^{INLINE_SPACE}*import{S}+(?:static{S}+)?([{WORD}.]+[{WORD}]){S}*;"), F.lit(1))

    def whole(names: Column) -> Column:
        return F.transform(names, lambda n: F.struct(n.alias("module"), none.alias("member")))

    return (
        F.when(language == "python", F.concat(F.flatten(F.transform(pairs, members)).cast(kind), whole(plain).cast(kind)))
        .when(language == "java", whole(java).cast(kind))
        .otherwise(F.array().cast(kind))
    )


def _smell(kind: str, severity: Column | str, line: Column | int | None, message: Column) -> Column:
    as_column = severity if isinstance(severity, Column) else F.lit(severity)
    start = line if isinstance(line, Column) else F.lit(line)
    return F.struct(
        F.lit(kind).alias("smell_type"), as_column.alias("severity"),
        start.cast("int").alias("line_start"), message.alias("message"),
    )


def _text(*parts: Column | str) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def smell_large_file(content: Column) -> Column:
    n = line_count(content)
    return F.when(n > LARGE_FILE_LINES, _smell(
        "large_file", "medium", 1, _text("File has ", n, f" lines (threshold: {LARGE_FILE_LINES})")))


def smell_god_class(content: Column) -> Column:
    n = java_methods(content)
    return F.when(n > GOD_CLASS_METHODS, _smell(
        "god_class", "high", 1, _text("Class has ", n, f" methods (threshold: {GOD_CLASS_METHODS})")))


def smells_long_method(content: Column) -> Column:
    """One smell per innermost brace body of more than 50 newlines."""
    bodies = F.regexp_extract_all(content, _pattern(BRACE_BODY), F.lit(0))
    long_ones = F.filter(bodies, lambda b: newlines(b) > LONG_BODY_LINES)
    return F.transform(long_ones, lambda b: _smell(
        "long_method", "medium", None, F.lit(f"Method body has more than {LONG_BODY_LINES} lines")))


def smells_too_many_parameters(content: Column) -> Column:
    """One smell per `def` with more than 5 parameters, at the line the `def` starts.

    A match does not tell its position, so the text is cut into pieces between matches and
    the newlines of everything before are carried along the pieces.
    """
    pattern = _pattern(PYTHON_DEF)
    heads = F.regexp_extract_all(content, pattern, F.lit(0))
    params = F.regexp_extract_all(content, pattern, F.lit(1))
    pieces = F.slice(F.split(content, "(?d)" + PYTHON_DEF), F.lit(1), F.size(heads))
    walk = F.arrays_zip(pieces.alias("piece"), heads.alias("head"), params.alias("params"))
    start = F.struct(
        F.lit(1).alias("line"), F.array().cast(T.ArrayType(SMELL)).alias("smells"))

    def step(state: Column, at: Column) -> Column:
        line = state["line"] + newlines(at["piece"])
        count = parameter_count(at["params"])
        smell = _smell("too_many_parameters", "low", line,
                       _text("Function has ", count, f" parameters (threshold: {MAX_PARAMETERS})"))
        return F.struct(
            (line + newlines(at["head"])).alias("line"),
            F.when(count > MAX_PARAMETERS, F.concat(state["smells"], F.array(smell).cast(T.ArrayType(SMELL))))
            .otherwise(state["smells"]).alias("smells"),
        )

    return F.aggregate(walk, start, step, lambda state: state["smells"])


def parameter_count(params: Column) -> Column:
    trimmed = F.transform(F.split(params, ","), lambda p: F.regexp_replace(p, rf"^{S}+|{S}+$", ""))
    return F.size(F.filter(trimmed, lambda p: (p != "") & (p != "self")))


def smells_of(content: Column, language: Column) -> Column:
    """All text smells of a file, in the order they are looked for."""
    none = F.array().cast(T.ArrayType(SMELL))
    large = F.array(smell_large_file(content))
    python = F.concat(F.array_compact(large), smells_too_many_parameters(content))
    java = F.concat(F.array_compact(F.array(smell_large_file(content), smell_god_class(content))),
                    smells_long_method(content))
    return F.when(language == "python", python).when(language == "java", java).otherwise(none)
