"""Merkle fixity audit of web-archive replicas.

A replica is a table of records with their offsets, lengths and digests. Records are
hashed, in order, into ranges of offsets; ranges into nodes of `fanout` children; and so
on up to one root. Two replicas with equal roots are equal. Otherwise only the branches
that differ are descended, and only the records of the ranges at their ends are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectscope.llm.tables import running_total
from defectscope.session import written

RANGE_BYTES = 1 << 20
FANOUT = 16


def record(url: Column, html: Column) -> Column:
    """A page as a WARC resource record."""
    html = F.coalesce(html.cast("string"), F.lit(""))
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(url.cast("string"), F.lit("")),
                    F.lit("\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"), html, F.lit("\r\n\r\n"))


def listing(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(record_id, offset, length, digest) of the archive that holds the pages in order of their ids."""
    text = record(F.col(url_col), F.col(html_col))
    rows = pages.select(F.col(id_col).alias("record_id"), text.alias("record"))
    rows = rows.select("record_id", F.octet_length("record").cast("bigint").alias("length"), F.sha2("record", 256).alias("digest"))
    return running_total(rows, [F.col("record_id"), F.col("digest")], "length", "offset").select("record_id", "offset", "length", "digest")


def _placed(records: DataFrame, range_bytes: int) -> DataFrame:
    """Versions of each record by range and offset; repeated rows are versions of one record."""
    known = records.where(F.col("offset").isNotNull()).select(F.expr(f"offset div {range_bytes}").alias("node"), "offset", "record_id", "length", "digest")
    return known.groupBy("node", "offset", "record_id").agg(F.array_sort(F.collect_list(F.struct("length", "digest"))).alias("versions"))


def tree(records: DataFrame, range_bytes: int, fanout: int, levels: int) -> list[DataFrame]:
    """(node, hash) of each level: 0 has the offset ranges, the last one the root.

    A range holds at most as many records as bytes, a node at most `fanout` children.
    """
    order = F.array_sort(F.collect_list(F.struct("offset", F.col("record_id").cast("string").alias("id"), F.to_json("versions").alias("versions"))))
    nodes = [written(_placed(records, range_bytes).groupBy("node").agg(F.sha2(F.to_json(order), 256).alias("hash")), "ranges")]
    for _ in range(levels):
        parent = nodes[-1].select(F.expr(f"node div {fanout}").alias("parent"), "node", "hash")
        children = F.to_json(F.array_sort(F.collect_list(F.struct("node", "hash"))))
        nodes.append(written(parent.groupBy(F.col("parent").alias("node")).agg(F.sha2(children, 256).alias("hash")), "nodes"))
    return nodes


def audit(primary: DataFrame, replica: DataFrame, *, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """(record_id, offset, status, lengths, replica_lengths, digests, replica_digests) of the records that differ.

    Status: `changed`, `missing` (only in the primary) or `extra` (only in the replica).
    Both tables have the columns record_id, offset, length, digest; others are ignored.
    Repeated rows count as versions of one record, compared as a sorted list. Rows without
    an offset lie in no range and are not audited; null ids, lengths and digests are values
    like others. Equal or empty replicas give no row.
    """
    last = primary.select("offset").union(replica.select("offset")).agg(F.max("offset")).first()[0] or 0
    levels, nodes = 0, last // range_bytes + 1
    while nodes > 1:
        levels, nodes = levels + 1, -(-nodes // fanout)
    left, right = (tree(t, range_bytes, fanout, levels) for t in (primary, replica))
    differing = None
    for ours, theirs in zip(reversed(left), reversed(right)):
        a, b = ours.select("node", F.col("hash").alias("a")), theirs.select("node", F.col("hash").alias("b"))
        if differing is not None:  # below a branch that differs
            above = differing.withColumnRenamed("node", "parent")
            a, b = (t.withColumn("parent", F.expr(f"node div {fanout}")).join(above, "parent", "left_semi").drop("parent") for t in (a, b))
        differing = a.join(b, "node", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("node")
    differing = written(differing, "differing")
    ours, theirs = (_placed(t, range_bytes).join(differing, "node", "left_semi") for t in (primary, replica))
    ours = ours.select("offset", F.to_json(F.struct("record_id")).alias("key"), "record_id", F.col("versions").alias("mine"))
    theirs = theirs.select("offset", F.to_json(F.struct("record_id")).alias("key"), F.col("record_id").alias("their_id"), F.col("versions").alias("yours"))
    found = ours.join(theirs, ["offset", "key"], "full").where(~F.col("mine").eqNullSafe(F.col("yours")))
    status = F.when(F.col("yours").isNull(), "missing").when(F.col("mine").isNull(), "extra").otherwise("changed")
    return found.select(
        F.coalesce("record_id", "their_id").alias("record_id"), "offset", status.alias("status"),
        F.col("mine.length").alias("lengths"), F.col("yours.length").alias("replica_lengths"),
        F.col("mine.digest").alias("digests"), F.col("yours.digest").alias("replica_digests"))


def damaged(pages: DataFrame) -> DataFrame:
    """The pages as a replica with known damage has them: overwritten, cut short, or lost."""
    html = F.col("html")
    worn = (F.when(F.col("page_id") % 97 == 13, F.concat(F.lit("#"), F.substring(html, 2, 2**31 - 1)))
            .when(F.col("page_id") % 307 == 7, F.substring(html, F.lit(1), F.expr("length(html) div 2").cast("int"))).otherwise(html))
    return pages.where(F.coalesce(F.col("page_id") % 211 != 5, F.lit(True))).withColumn("html", worn)


SQL = """
WITH r AS (SELECT page_id, url, html, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
             || 'Content-Length: ' AS head, chr(13) || chr(10) || chr(13) || chr(10) AS gap,
             CASE WHEN page_id % 97 = 13 THEN '#' || substring(html, 2) WHEN page_id % 307 = 7 THEN substring(html, 1, length(html) // 2) ELSE html END AS worn FROM pages),
d AS (SELECT page_id, head || strlen(html) || gap || html || gap AS rec, head || strlen(worn) || gap || worn || gap AS bad FROM r),
o AS (SELECT page_id, rec, bad, CAST(sum(strlen(rec)) OVER (ORDER BY page_id) - strlen(rec) AS BIGINT) AS place FROM d)
SELECT page_id AS record_id, place AS "offset", CASE WHEN page_id % 211 = 5 THEN 'missing' ELSE 'changed' END AS status, CAST(strlen(rec) AS BIGINT) AS length,
       CAST(CASE WHEN page_id % 211 = 5 THEN NULL ELSE strlen(bad) END AS BIGINT) AS replica_length, sha256(rec) AS digest,
       CASE WHEN page_id % 211 = 5 THEN NULL ELSE sha256(bad) END AS replica_digest
FROM o WHERE page_id % 211 = 5 OR rec <> bad
"""
