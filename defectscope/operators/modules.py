"""Which file an import means: an index of files by their dotted names, joined with the imports.

A file goes by every dotted suffix of its path (`src/pkg/mod.py` is `mod`, `pkg.mod` and
`src.pkg.mod`). Of the names an import statement can stand for, the longest one that some
file goes by wins; of several files of a name, the one whose path the name covers best, and
where two are covered equally well the import is ambiguous and counted as such, for no file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectscope.functions import text as tx
from defectscope.operators.metrics import with_language


def dotted_parts(path: Column, language: Column) -> Column:
    """A path's pieces as a module name has them; a package's own file stands for the package."""
    bare = F.regexp_replace(path, r"\.(py|java)$", "")
    parts = F.filter(F.split(bare, "/"), lambda p: (p != "") & (p != "."))
    package = (language == "python") & (F.try_element_at(parts, F.lit(-1)) == "__init__")
    return F.when(package, F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def module_index(sources: DataFrame) -> DataFrame:
    """(repo_id, language, name, uncovered, files, filepath): the best files of every name, `files` of them.

    `uncovered` is the number of leading path pieces that the name leaves out. Files of
    other languages, and null repositories or paths, have no names.
    """
    files = with_language(sources).where(F.col("language").isin("python", "java") & F.col("repo_id").isNotNull())
    files = files.select("repo_id", "language", "filepath", dotted_parts(F.col("filepath"), F.col("language")).alias("parts")).distinct()
    suffixes = files.where(F.size("parts") > 0).select(
        "repo_id", "language", "filepath", "parts", F.explode(F.sequence(F.lit(0), F.size("parts") - 1)).alias("uncovered"))
    names = suffixes.select("repo_id", "language", "filepath", "uncovered", F.array_join(F.slice("parts", F.col("uncovered") + 1, F.size("parts")), ".").alias("name"))
    covered = names.groupBy("repo_id", "language", "name", "uncovered").agg(F.count(F.lit(1)).alias("files"), F.min("filepath").alias("filepath"))
    best = F.min(F.struct("uncovered", "files", "filepath"))
    return covered.groupBy("repo_id", "language", "name").agg(best.alias("best")).select("repo_id", "language", "name", "best.*")


def import_names(sources: DataFrame) -> DataFrame:
    """(repo_id, filepath, language, number, names, whole): what each import of a file may mean, the longest name first.

    `from a import b` may mean module `a.b` or `a`; a plain or Java import the name itself
    or, for a member of it, the name without its last piece. A relative import is resolved
    against the file's own package, and must then be a whole path (`whole`).
    """
    content, language = F.col("content"), F.col("language")
    read = with_language(sources).where("repo_id is not null and filepath is not null").select(
        "repo_id", "filepath", "language", dotted_parts(F.col("filepath"), language).alias("parts"),
        F.col("filepath").rlike(r"(^|/)__init__\.py$").alias("is_package"), tx.import_statements(content, language).alias("statements"))
    one = read.select("repo_id", "filepath", "language", "parts", "is_package", F.posexplode("statements").alias("number", "s")).select(
        "repo_id", "filepath", "language", "parts", "is_package", "number", F.col("s.module").alias("module"), F.col("s.member").alias("member"))
    dots = F.length(F.regexp_extract("module", r"^(\.*)", 1))
    # One dot is the file's own package, each more its parent.
    kept = F.size("parts") - dots + F.when(F.col("is_package"), 1).otherwise(0)
    tail = F.regexp_replace("module", r"^\.+", "")
    base = F.when(dots > 0, F.concat_ws(".", F.array_join(F.slice("parts", 1, F.greatest(kept, F.lit(0))), "."), F.when(tail != "", tail))).otherwise(tail)
    base = F.regexp_replace(base, r"^\.|\.$", "")
    one = one.select("repo_id", "filepath", "language", "number", base.alias("base"), "member", (dots > 0).alias("whole"), (kept >= 0).alias("inside"))
    shorter = F.regexp_extract("base", r"^(.+)\.[^.]+$", 1)
    names = F.when(F.col("member").isNotNull(), F.array(F.concat_ws(".", F.when(F.col("base") != "", F.col("base")), F.col("member")), F.col("base"))).otherwise(F.array(F.col("base"), shorter))
    names = F.filter(names, lambda n: n != "")
    # A path above the repository's root is no module.
    names = F.when(F.col("whole") & ~F.col("inside"), F.array().cast("array<string>")).otherwise(names)
    return one.select("repo_id", "filepath", "language", "number", names.alias("names"), "whole")


def resolved_imports(sources: DataFrame) -> DataFrame:
    """(repo_id, filepath, number, target, files): the file that each import means; null where none (files 0) or several (files) fit."""
    wanted = import_names(sources)
    tried = wanted.select("repo_id", "language", "filepath", "number", "whole", F.posexplode_outer("names").alias("place", "name"))
    index = module_index(sources).withColumnRenamed("filepath", "target")
    # The index has one row a name; a name that very many files import is split by AQE.
    met = tried.join(index, ["repo_id", "language", "name"], "left")
    fits = F.col("files").isNotNull() & (~F.col("whole") | (F.col("uncovered") == 0))
    best = F.min(F.when(fits, F.struct("place", "files", "target")))
    return met.groupBy("repo_id", "filepath", "number").agg(best.alias("best")).select(
        "repo_id", "filepath", "number", F.when(F.col("best.files") == 1, F.col("best.target")).alias("target"),
        F.coalesce("best.files", F.lit(0)).cast("bigint").alias("files"))


def file_dependency_degrees(sources: DataFrame) -> DataFrame:
    """(repo_id, filepath, fan_out, fan_in, unresolved, ambiguous) of every file.

    Degrees count other files, each once; imports of no file of the repository are
    `unresolved`, those that several files fit equally well `ambiguous`. A file that imports
    nothing and is imported by nothing has zeros. Files without repository or path, and
    repeated rows of one path, are left out or counted once.
    """
    imports = resolved_imports(sources)
    edges = imports.where(F.col("target").isNotNull() & (F.col("target") != F.col("filepath"))).select("repo_id", "filepath", "target").distinct()

    def counts(df: DataFrame, path: Column | str, **columns: Column) -> DataFrame:
        zero = F.lit(0).cast("bigint")
        return df.select("repo_id", F.col(path).alias("filepath"), *(columns.get(c, zero).cast("bigint").alias(c) for c in ("fan_out", "fan_in", "unresolved", "ambiguous")))

    one = F.lit(1)
    files = sources.where("repo_id is not null and filepath is not null")
    rows = (counts(files, "filepath").union(counts(edges, "filepath", fan_out=one)).union(counts(edges, "target", fan_in=one))
            .union(counts(imports, "filepath", unresolved=(F.col("files") == 0).cast("bigint"), ambiguous=(F.col("files") > 1).cast("bigint"))))
    # Partial sums in each task absorb a file that very many others import.
    return rows.groupBy("repo_id", "filepath").agg(*(F.sum(c).alias(c) for c in ("fan_out", "fan_in", "unresolved", "ambiguous")))
