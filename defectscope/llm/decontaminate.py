"""Benchmark decontamination with DataFrame functions alone.

Test items become windows of ten words (a shorter item is one window). A window that
occurs in a document covers a whole block of five of the document's words, counted from
its start, so one scan writes the hashes of each document's blocks, and a join with the
hashed blocks of the windows leaves the documents where an occurrence is possible. Only
their windows are then looked up, as text, in the broadcast set of windows: hits are
exact, and the hashes decide nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectscope.llm.tables import bounded, unwrapped, wrapped
from defectscope.session import written

WINDOW = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def ascii_lower(text: Column) -> Column:
    """Lower case for A-Z alone; text of ASCII only takes the fast function."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Words of lower-cased text; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), SEPARATORS), "")


def block_size(window: int) -> int:
    """The largest block of which each run of `window` words has a whole one."""
    return (window + 1) // 2


def _blocks(tokens: Column, size: int, step: int) -> Column:
    """Hashes of the runs of `size` tokens that start at multiples of `step`."""
    last = F.floor((F.size(tokens) - size) / step)
    runs = F.transform(F.sequence(F.lit(0), last.cast("int")), lambda i: F.xxhash64(F.lit(size), F.slice(tokens, i * step + 1, size)))
    return F.when(F.size(tokens) >= size, runs).otherwise(F.array().cast("array<bigint>"))


def _grams(tokens: Column, size: Column) -> Column:
    """(position, gram) of each run of `size` tokens."""
    runs = F.transform(
        F.sequence(F.lit(0), F.size(tokens) - size),
        lambda i: F.struct(size.alias("size"), i.cast("bigint").alias("position"), F.array_join(F.slice(tokens, i + 1, size), " ").alias("gram")))
    return F.when(F.size(tokens) >= size, runs)


def windows(benchmark: DataFrame, window: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(size, gram, items) of the distinct windows of the items."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("tokens")).where(F.size("tokens") > 0)
    size = F.least(F.size("tokens"), F.lit(window))
    runs = items.select("item", size.alias("size"), F.explode(_grams(F.col("tokens"), size)).alias("run"))
    return runs.groupBy("size", F.col("run.gram").alias("gram")).agg(F.collect_set("item").alias("items"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, text_md5, n_words, n_hit, n_items, items_sha256, spans, contaminated) of every row of `docs`.

    `n_hit` counts the document's words inside any occurrence of a window, `spans` are the
    occurrences as (position, size) in words. Null text has no words; a null item id is
    left out of the items, but its windows count. Equal and null document ids are told
    apart by their texts; other columns are ignored; an empty table on either side leaves
    no hit. The set of windows is broadcast while it is within the bound of broadcasts, and
    shuffled beyond it.
    """
    grams = written(windows(benchmark, window, item_col, item_text_col), "windows")
    sizes = sorted(r[0] for r in grams.select("size").distinct().collect())  # at most `window` numbers
    n_grams = grams.count()
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("text_md5"), words(text).alias("tokens"))
    steps = sorted({block_size(s) for s in sizes})
    blocks = F.array_distinct(F.concat(*(_blocks(F.col("tokens"), b, b) for b in steps))) if steps else F.array().cast("array<bigint>")
    scanned = written(rows.select("doc_id", "text_md5", F.size("tokens").cast("bigint").alias("n_words"), blocks.alias("blocks")), "blocks")
    split = F.split("gram", " ")
    parts = [grams.where(F.col("size") == s).select(F.explode(_blocks(split, block_size(s), 1)).alias("block")) for s in sizes]
    keyed = scanned.select("doc_id", "text_md5", "n_words")
    if parts:
        known = written(reduce(DataFrame.union, parts).distinct(), "item-blocks")
        possible = scanned.select("doc_id", F.explode("blocks").alias("block")).join(bounded(known, known.count()), "block", "left_semi")
        possible = written(possible.select(F.col("doc_id").alias("possible_id")).distinct(), "possible")
        rows = rows.join(bounded(possible, possible.count()), F.col("doc_id").eqNullSafe(F.col("possible_id")), "left_semi")
    found = F.flatten(F.array(*(F.coalesce(_grams(F.col("tokens"), F.lit(s)), F.array()) for s in sizes))) if sizes else None
    if found is None:
        hits = rows.where(F.lit(False)).select("doc_id", "text_md5", F.lit(None).cast("array<struct<position:bigint,size:int>>").alias("starts"),
                                               F.lit(None).cast("array<string>").alias("items"))
    else:
        runs = rows.select("doc_id", "text_md5", F.explode(found).alias("run")).select("doc_id", "text_md5", "run.*")
        hits = runs.join(bounded(grams, n_grams), ["size", "gram"]).groupBy("doc_id", "text_md5").agg(
            F.array_sort(F.collect_set(F.struct("position", "size"))).alias("starts"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    covered = F.aggregate(
        "starts", F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n")),
        lambda s, x: F.struct(
            F.greatest(s["end"], x["position"] + x["size"]).alias("end"),
            (s["n"] + F.greatest(F.lit(0).cast("bigint"), x["position"] + x["size"] - F.greatest(s["end"], x["position"]))).alias("n")))["n"]
    hits = hits.select(F.col("doc_id").alias("hit_id"), F.col("text_md5").alias("hit_md5"), covered.alias("n_hit"), "starts", "items")
    joined = keyed.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_md5") == F.col("hit_md5")), "left")
    return joined.select(
        "doc_id", "text_md5", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        F.col("starts").alias("spans"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` without a hit, in their own columns."""
    leaks = find_leaks(docs, benchmark, id_col=id_col, text_col=text_col, **options).where("contaminated")
    leaks = leaks.select(F.col("doc_id").alias("leak_id"), F.col("text_md5").alias("leak_md5")).distinct()
    rows = wrapped(docs, doc_id=F.col(id_col), text_md5=F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))))
    clean = rows.join(leaks, F.col("doc_id").eqNullSafe(F.col("leak_id")) & (F.col("text_md5") == F.col("leak_md5")), "left_anti")
    return unwrapped(clean, docs)


SQL = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM bi),
ks AS (SELECT DISTINCT k FROM bw),
dk AS (SELECT doc_id, w, k FROM d, ks WHERE len(w) >= k),
di AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dk),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM di),
h AS (SELECT dw.doc_id, dw.k, dw.i, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
p AS (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS place FROM h),
n AS (SELECT doc_id, count(*) AS n_hit FROM p GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS items_sha256 FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, coalesce(t.items_sha256, sha256('')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""
