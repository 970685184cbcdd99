"""Nearest neighbours and oversampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.ranking import LABELED
from checks.registry import query
from checks.relational import changes
from defectscope.operators import balance as bal
from defectscope.operators import changes as ch
from defectscope.operators import features as ft
from defectscope.schemas import METRIC_COLUMNS
from defectscope.session import written


def labeled(t):
    # Read several times by what follows: joined and written once, with the columns that are used.
    rows = ft.fill_metrics(ch.with_bug_labels(t.fx_file_metrics, changes(t)))
    return written(rows.select("repo_id", "id", "filepath", *METRIC_COLUMNS, "is_buggy"), "labeled")


DISTANCE = " + ".join(f"(a.{c} - b.{c}) ** 2" for c in METRIC_COLUMNS)
MINORITY = f"""
{LABELED}, filled AS (SELECT repo_id, id, is_buggy, {', '.join(f'CAST(coalesce({c}, 0) AS DOUBLE) AS {c}' for c in METRIC_COLUMNS)} FROM labeled),
facts AS (SELECT repo_id, sum(is_buggy) AS pos, count(*) - sum(is_buggy) AS neg FROM filled GROUP BY repo_id),
use AS (SELECT repo_id, CASE WHEN pos <= neg THEN 1 ELSE 0 END AS minority, least(pos, neg) AS m, abs(pos - neg) AS lacking, least(5, pos - 1) AS k
        FROM facts WHERE pos >= 2 AND neg >= 2 AND pos <> neg AND least(pos, neg) > least(5, pos - 1)),
rows AS (SELECT f.*, m, lacking, k FROM filled f JOIN use u ON u.repo_id = f.repo_id AND u.minority = f.is_buggy),
near AS (SELECT a.repo_id, a.id, b.id AS neighbour, {DISTANCE} AS d2,
                row_number() OVER (PARTITION BY a.repo_id, a.id ORDER BY {DISTANCE}, b.id) AS place
         FROM rows a JOIN rows b ON a.repo_id = b.repo_id AND a.id <> b.id QUALIFY place <= 5)"""


@query("minority_neighbours", f"WITH {MINORITY} SELECT repo_id, id, place, neighbour, d2 FROM near")
def _(t):
    return bal.minority_knn(bal.minority_rows(labeled(t), 5, 5), METRIC_COLUMNS, 5)


@query("embedding_neighbours", """
WITH v AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS repo_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT a.repo_id, a.id, b.id AS neighbour, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.e, b.e), b.id) AS place
FROM v a JOIN v b ON a.repo_id = b.repo_id AND a.id <> b.id QUALIFY place <= 3""")
def _(t):
    width = len(t.embeddings.select("embedding").first()[0])
    rows = t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").cast("bigint").alias("repo_id"),
                               *[F.col("embedding")[i].alias(f"e{i}") for i in range(width)])
    return bal.minority_knn(rows, [f"e{i}" for i in range(width)], 3).drop("d2")


DRAW = "CAST(('0x' || substr(md5(concat(CAST(id AS STRING), '|', CAST(copy AS STRING), '|42{kind}')), 1, 8)) AS BIGINT)"


@query("synthetic_rows", f"""
WITH {MINORITY},
placed AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY md5(concat(CAST(id AS STRING), '|42')), id) AS rn FROM rows),
copies AS (SELECT *, unnest(range(1, CAST(lacking // m + CASE WHEN rn <= lacking % m THEN 1 ELSE 0 END + 1 AS BIGINT))) AS copy FROM placed),
drawn AS (SELECT *, {DRAW.format(kind='n')} % k + 1 AS pick, {DRAW.format(kind='g')} / 4294967296e0 AS gap FROM copies)
SELECT d.repo_id, d.id AS base, copy, n.neighbour, d.is_buggy, {', '.join(f'round(d.{c} + gap * (r.{c} - d.{c}), 6) AS {c}' for c in METRIC_COLUMNS)}
FROM drawn d JOIN near n ON n.repo_id = d.repo_id AND n.id = d.id AND n.place = d.pick JOIN rows r ON r.repo_id = d.repo_id AND r.id = n.neighbour""")
def _(t):
    out = bal.synthetic_rows(labeled(t), METRIC_COLUMNS)
    return out.withColumns({c: F.round(c, 6) for c in METRIC_COLUMNS})


@query("balanced_class_sizes", f"""
WITH {MINORITY} SELECT f.repo_id, b AS is_buggy, CAST(greatest(pos, neg) AS BIGINT) AS n FROM facts f JOIN use u ON u.repo_id = f.repo_id, (VALUES (0), (1)) c(b)""")
def _(t):
    out = bal.smote(labeled(t), METRIC_COLUMNS, renumber=True)
    return out.groupBy("repo_id", "is_buggy").agg(F.countDistinct("file_id").alias("n"))
