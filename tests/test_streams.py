"""Streams give the batch result over several micro-batches, with repeats and late rows."""

import json
import re
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from defectscope.streaming import commits as sc
from defectscope.streaming import history as sh


def land(folder, name, shas, message="Fix it"):
    folder.mkdir(exist_ok=True)
    with open(folder / name, "w") as out:
        for sha in shas:
            out.write(json.dumps({"repo_id": 1, "sha": sha, "commit": {"message": message, "author": {"name": "a", "email": None, "date": "2024-01-02T03:04:05Z"}}}) + "\n")


def test_commits_are_inserted_once(spark, tmp_path):
    landing, table, progress = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "progress")

    def drain():
        sc.stream_commits(spark, str(landing), table, progress, files_per_batch=1).awaitTermination()

    land(landing, "1.json", ["a", "b", "a"])
    land(landing, "2.json", ["b", "c"], message="later")
    drain()
    assert sorted((r.sha, r.is_bugfix) for r in sc.read_table(spark, table).collect()) == [("a", True), ("b", True), ("c", False)]
    land(landing, "3.json", ["c", "d", "a"])
    drain()
    assert sorted(r.sha for r in sc.read_table(spark, table).collect()) == ["a", "b", "c", "d"]
    # The same batch once more leaves the table as it is.
    again = sc.read_table(spark, table).where("sha = 'd'")
    sc.insert_batch(again, 99, table)
    assert sc.read_table(spark, table).count() == 4
    assert sc.read_table(spark, str(tmp_path / "none")).count() == 0


def test_a_batch_writes_one_file_a_month(spark, tmp_path, monkeypatch):
    """State keeps adaptive execution off, so that months must be brought together without it; large ones still go to several files."""
    landing, table = tmp_path / "in", tmp_path / "table"
    landing.mkdir()
    with open(landing / "1.json", "w") as out:
        for i in range(400):
            date = f"2024-{i % 4 + 1:02d}-02T03:04:05Z"
            out.write(json.dumps({"repo_id": i % 3, "sha": f"s{i}", "commit": {"message": "m", "author": {"name": "a", "email": None, "date": date}}}) + "\n")
    sc.stream_commits(spark, str(landing), str(table), str(tmp_path / "progress")).awaitTermination()
    assert len(list(table.rglob("*.parquet"))) == 4 and sc.read_table(spark, str(table)).count() == 400
    monkeypatch.setattr(sc, "FILE_ROWS", 30)
    sc.stream_commits(spark, str(landing), str(tmp_path / "other"), str(tmp_path / "more")).awaitTermination()
    files = len(list((tmp_path / "other").rglob("*.parquet")))
    assert 4 < files <= 16 and sc.read_table(spark, str(tmp_path / "other")).count() == 400


def test_other_checkpoints_and_sources_keep_stored_commits(spark, tmp_path):
    table = str(tmp_path / "table")

    def drain(source, progress):
        sc.stream_commits(spark, str(tmp_path / source), table, str(tmp_path / progress), files_per_batch=1).awaitTermination()
        return sorted(r.sha for r in sc.read_table(spark, table).collect())

    land(tmp_path / "in", "1.json", ["a", "b"])
    land(tmp_path / "in", "2.json", ["c", "d"])
    assert drain("in", "p1") == ["a", "b", "c", "d"]
    assert drain("in", "p2") == ["a", "b", "c", "d"]  # a new checkpoint over a filled table
    land(tmp_path / "other", "1.json", ["d", "e"])
    assert drain("other", "p3") == ["a", "b", "c", "d", "e"]  # a second source
    batch = sc.read_table(spark, table).where("sha IN ('a', 'e')")
    for _ in range(2):  # a batch run again
        sc.insert_batch(batch.withColumn("sha", F.concat("sha", F.lit("x"))), 7, table, "s")
        assert sorted(r.sha for r in sc.read_table(spark, table).collect()) == ["a", "ax", "b", "c", "d", "e", "ex"]
    sc.compact(spark, table, str(tmp_path / "new"))
    assert sorted(r.sha for r in sc.read_table(spark, str(tmp_path / "new")).collect()) == ["a", "ax", "b", "c", "d", "e", "ex"]


def land_months(folder, name, months, each=40):
    folder.mkdir(exist_ok=True)
    with open(folder / name, "w") as out:
        for m in months:
            for k in range(each):
                date = f"20{10 + m // 12}-{m % 12 + 1:02d}-{k % 28 + 1:02d}T00:00:00Z"
                out.write(json.dumps({"repo_id": k % 3, "sha": f"{m}-{k}", "commit": {"message": "m", "author": {"name": "a", "email": "e", "date": date}}}) + "\n")


def test_repeats_end_in_state_and_lookups_read_their_months(spark, tmp_path, monkeypatch):
    landing, table, progress = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "progress")
    batches, read = [], []
    insert, keys = sc.insert_batch, sc.stored_keys

    def counted(batch, *rest):
        batch = batch.persist()
        batches.append(batch.count())
        insert(batch, *rest)

    monkeypatch.setattr(sc, "insert_batch", counted)

    def looked_up(spark, table, months, *rest):
        found = keys(spark, table, months, *rest)
        read.append([months, found._jdf.queryExecution().executedPlan().toString(), found.columns])
        return found

    monkeypatch.setattr(sc, "stored_keys", looked_up)

    def drain(checkpoint=progress):
        query = sc.stream_commits(spark, str(landing), table, checkpoint, files_per_batch=1)
        query.awaitTermination()
        return sum(s["numRowsTotal"] for s in query.lastProgress["stateOperators"])

    land_months(landing, "1.json", range(24))
    assert drain() == 24 * 40
    land_months(landing, "2.json", [22, 23, 24])  # two known months again, and a new one
    assert drain() == 25 * 40
    assert [b for b in batches if b] == [24 * 40, 40]  # the repeats went no further than the state
    months, plan, columns = read[-1]
    # Files of that month alone are read, and of them the keys.
    assert months == ["2012-01"] and columns == sc.KEY
    assert re.search(r"PartitionFilters: \[.*month#\d+ = 2012-01", plan) and re.search(r"ReadSchema: struct<repo_id:bigint,sha:string>", plan)
    # Without the state, over the same table: every row is looked up, in its own month.
    batches.clear()
    drain(str(tmp_path / "other"))
    assert sum(batches) == 25 * 40 and sc.read_table(spark, table).count() == 25 * 40


def test_state_expires_and_the_table_still_holds(spark, tmp_path):
    landing, table, progress = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "progress")

    def drain():
        query = sc.stream_commits(spark, str(landing), table, progress, files_per_batch=1, remembered="1 seconds")
        query.awaitTermination()
        return sum(s["numRowsTotal"] for s in query.lastProgress["stateOperators"])

    sizes = []
    for k in range(4):
        land_months(landing, f"{k}.json", [k, k + 1])  # half of them known, by then forgotten
        sizes.append(drain())
        time.sleep(1.5)
    assert max(sizes) <= 4 * 40 and sc.read_table(spark, table).count() == 5 * 40


def test_a_batch_that_failed_is_run_again(spark, tmp_path, monkeypatch):
    """Restart after the rows were written, but before the batch was committed."""
    landing, table, progress = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "progress")
    land_months(landing, "1.json", [1, 2])
    real = sc.insert_batch

    def fails(batch, *rest):
        real(batch, *rest)
        raise RuntimeError("lost")

    monkeypatch.setattr(sc, "insert_batch", fails)
    query = sc.stream_commits(spark, str(landing), table, progress, files_per_batch=1)
    with pytest.raises(Exception, match="lost"):
        query.awaitTermination()
    monkeypatch.setattr(sc, "insert_batch", real)
    assert sc.read_table(spark, table).count() == 80
    land_months(landing, "2.json", [2, 3])
    sc.stream_commits(spark, str(landing), table, progress, files_per_batch=1).awaitTermination()
    rows = sc.read_table(spark, table)
    assert rows.count() == 120 and rows.select("sha").distinct().count() == 120


SCHEMA = "repo_id int, metric_name string, metric_value double, recorded_at timestamp_ntz"


def test_windows_close_and_late_rows_drop(spark, tmp_path):
    start = datetime(2024, 1, 1)
    source, target, progress = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "progress")

    def land_days(days):
        rows = [(1, "risk", float(v), start + timedelta(days=d, hours=h)) for d, h, v in days]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        sh.stream_metric_windows(stream, target, progress, delay="1 day").awaitTermination()
        return {r.window_start.day: (r.n, r.avg_value, r.min_value, r.max_value, r.last_value) for r in spark.read.schema(
            "window_start timestamp_ntz, n bigint, avg_value double, min_value double, max_value double, last_value double").parquet(target).collect()}

    assert land_days([(0, 1, 5), (0, 9, 2), (1, 3, 4)]) == {}
    assert land_days([(0, 2, 8), (3, 0, 1)]) == {1: (3, 5.0, 2.0, 8.0, 2.0), 2: (1, 4.0, 4.0, 4.0, 4.0)}
    # Day 1 is closed by now: its late row changes nothing.
    assert land_days([(0, 3, 100), (9, 0, 7)]) == {1: (3, 5.0, 2.0, 8.0, 2.0), 2: (1, 4.0, 4.0, 4.0, 4.0), 4: (1, 1.0, 1.0, 1.0, 1.0)}


def test_windows_do_not_depend_on_the_session_zone(spark):
    df = spark.createDataFrame([(1, "m", 2.0, datetime(2024, 3, 10, 23, 30))], SCHEMA)
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        row = sh.metric_windows(df).select(F.col("window_start").cast("string"), F.col("window_end").cast("string")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert tuple(row) == ("2024-03-10 00:00:00", "2024-03-11 00:00:00")


def sliding(history, size="30 days", slide="1 day"):
    out = {}
    for r in history:
        day = datetime(r[3].year, r[3].month, r[3].day)
        for k in range(30):
            out.setdefault((r[0], r[1], day - timedelta(days=k)), []).append(r)
    return {k: (len(v), sum(r[2] for r in v) / len(v), min(r[2] for r in v), max(r[2] for r in v), max(v, key=lambda r: (r[3], r[2]))[2]) for k, v in out.items()}


def history_rows(days=70):
    start = datetime(2024, 1, 1)
    return [(k % 3, f"m{k % 2}", float(k * 37 % 101), start + timedelta(hours=k * 7 % (24 * days), minutes=k % 60)) for k in range(900)]


def test_sliding_windows_of_panes_match_rows(spark):
    rows = history_rows()
    found = sh.metric_windows(spark.createDataFrame(rows, SCHEMA), "30 days", "1 day").collect()
    got = {(r.repo_id, r.metric_name, r.window_start): (r.n, r.avg_value, r.min_value, r.max_value, r.last_value) for r in found}
    want = sliding(rows)
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k][0] == v[0] and abs(got[k][1] - v[1]) < 1e-9 and got[k][2:] == v[2:]
    # Sizes that are no multiple of the slide are not paned, and give the windows of the rows.
    odd = sh.metric_windows(spark.createDataFrame(rows[:50], SCHEMA), "36 hours", "1 day")
    assert odd.agg(F.sum("n")).first()[0] == sum(2 if r[3].hour < 12 else 1 for r in rows[:50])
    empty = spark.createDataFrame([(1, "m", None, datetime(2024, 1, 1))], SCHEMA)
    assert {(r.n, r.avg_value, r.last_value) for r in sh.metric_windows(empty, "2 days", "1 day").collect()} == {(1, None, None)}


def test_only_panes_are_copied_to_windows(spark):
    """The copies of the plan come after the aggregate of the rows."""
    plan = sh.metric_windows(spark.createDataFrame(history_rows(), SCHEMA), "30 days", "1 day")._jdf.queryExecution().sparkPlan().toString().split("\n")
    copies = [i for i, line in enumerate(plan) if "Expand" in line or "Generate" in line]
    sums = [i for i, line in enumerate(plan) if "Aggregate" in line]
    assert len(copies) == 1 and any(i > copies[0] for i in sums) and any(i < copies[0] for i in sums)


def test_streamed_sliding_windows_over_batches(spark, tmp_path):
    rows = sorted(history_rows(), key=lambda r: r[3])
    source, target, progress = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "progress")
    for at in range(0, len(rows), 300):
        spark.createDataFrame(rows[at:at + 300], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        sh.stream_metric_windows(spark.readStream.schema(SCHEMA).parquet(source), target, progress, "30 days", "1 day").awaitTermination()
    late = max(r[3] for r in rows) - timedelta(days=1)
    want = {k: v for k, v in sliding(rows).items() if k[2] + timedelta(days=30) <= late}
    got = {(r.repo_id, r.metric_name, r.window_start): (r.n, round(r.avg_value, 6)) for r in spark.read.parquet(target).collect()}
    assert got == {k: (v[0], round(v[1], 6)) for k, v in want.items()}
