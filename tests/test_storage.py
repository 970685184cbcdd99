"""Merges, registration, deletes, datasets, registry, exports: round trips and repeats."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from defectscope.operators import dashboards
from defectscope.operators import selection as sel
from defectscope.sources import datasets as ds
from defectscope.sources import export, landing, registry, upserts


def test_insert_if_absent_is_idempotent_and_keeps_the_first(spark):
    schema = "repo_id int, sha string, v int"
    old = spark.createDataFrame([(1, "a", 0)], schema)
    new = spark.createDataFrame([(1, "a", 9), (1, "b", 3), (1, "b", 2), (2, "a", 5)], schema)
    once = upserts.insert_ignore(old, new, ["repo_id", "sha"], F.col("v"))
    assert sorted(map(tuple, once.collect())) == [(1, "a", 0), (1, "b", 2), (2, "a", 5)]
    twice = upserts.insert_ignore(once, new, ["repo_id", "sha"], F.col("v"))
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))


METRICS = "repo_id int, filepath string, commit_sha string, cyclomatic_complexity double, wmc double, cbo double, code_smells_count int, rfc double"


def test_upsert_changes_only_four_metrics(spark):
    old = spark.createDataFrame([(1, "a", "HEAD", 1.0, 1.0, 1.0, 1, 1.0), (1, "b", "s", 2.0, 2.0, 2.0, 2, 2.0)], METRICS)
    new = spark.createDataFrame([(1, "a", None, 9.0, 9.0, None, 9, 9.0, 1), (1, "c", None, 5.0, 5.0, 5.0, 5, 5.0, 2),
                                 (1, "c", None, 6.0, 6.0, 6.0, 6, 6.0, 3)], METRICS + ", seq int")
    once = upserts.upsert_file_metrics(old, new)
    assert sorted(map(tuple, once.collect())) == [
        (1, "a", "HEAD", 9.0, 9.0, None, 9, 1.0), (1, "b", "s", 2.0, 2.0, 2.0, 2, 2.0), (1, "c", "HEAD", 6.0, 6.0, 6.0, 6, 5.0)]
    again = upserts.upsert_file_metrics(once, new)
    assert sorted(map(str, again.collect())) == sorted(map(str, once.collect()))


def test_registration_prefers_what_exists(spark):
    old = spark.createDataFrame([(1, "x", "https://h/o/x.git"), (2, "y", "https://h/o/y")], "id int, name string, url string")
    new = spark.createDataFrame([(0, "x2", "https://h/o/x"), (1, "y2", " https://h/o/y.git "), (2, "z", "https://h/o/z/"), (3, "z2", "https://h/o/z")],
                                "pos int, name string, url string")
    out = landing.register_repos(old, new)
    assert sorted((r.name, r.url) for r in out.collect()) == [("x", "https://h/o/x.git"), ("y", "https://h/o/y"), ("z", "https://h/o/z")]


def test_purge_cascades_and_unlinks_models(spark):
    tables = {
        "repositories": spark.createDataFrame([(1,), (2,)], "id bigint"),
        "commits": spark.createDataFrame([(1, "a"), (2, "b")], "repo_id bigint, sha string"),
        "models": spark.createDataFrame([("m", 1, 7), ("n", 2, 8)], "model_id string, repo_id bigint, dataset_id bigint"),
        "policies": spark.createDataFrame([(5,)], "id bigint"),
    }
    out = upserts.purge_repos(tables, spark.createDataFrame([(1,)], "id bigint"))
    assert [r.id for r in out["repositories"].collect()] == [2]
    assert [r.sha for r in out["commits"].collect()] == ["b"]
    assert sorted(map(tuple, out["models"].collect())) == [("m", None, None), ("n", 2, 8)]
    assert out["policies"].count() == 1


def test_collection_report_stamps_only_seen_repositories(spark):
    repos = spark.createDataFrame([(1, None), (2, None)], "id int, last_collected_at timestamp")
    landed = spark.createDataFrame([(1, "a"), (1, "b")], "repo_id int, sha string")
    new = landed.where("sha = 'b'")
    stamped, report = upserts.collection_report(repos, landed, new, F.lit(datetime(2024, 5, 1)))
    assert {r.id: r.last_collected_at for r in stamped.collect()} == {1: datetime(2024, 5, 1), 2: None}
    assert [tuple(r) for r in report.collect()] == [(1, 2, 1)]


def test_datasets_on_disk(spark, tmp_path):
    rows = [(1, i, f"f{i}", float(i), i % 2, "train" if i < 8 else "test") for i in range(10)] + [(2, 50, "g", 1.0, 0, "train")]
    df = spark.createDataFrame(rows, "repo_id bigint, id bigint, filepath string, wmc double, is_buggy int, split string")
    path, catalog = str(tmp_path / "d"), str(tmp_path / "c")
    ds.save_dataset(df, path, catalog, 3, "none", True)
    ds.save_dataset(df.where("repo_id = 2"), path, catalog, 4, "none", False)
    ds.save_dataset(df, path, catalog, 3, "none", True)  # a retry changes nothing
    assert ds.read_split(spark, path, 3, "test").count() == 2
    assert ds.read_split(spark, path, 3, "train", repo_id=2).count() == 1
    plan = ds.read_split(spark, path, 3, "train", 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dataset_id" in plan
    listed = ds.list_datasets(spark.read.parquet(catalog)).collect()
    assert [r.id for r in listed] == [3, 3, 4] and len(listed[0].feature_names) == 20
    one = {r.repo_id: (r.train_samples, r.test_samples) for r in ds.get_dataset(spark.read.parquet(catalog), 3).collect()}
    assert one == {1: (8, 2), 2: (1, 0)}


def test_catalog_without_feature_names(spark):
    df = spark.createDataFrame([(1, 1, None, datetime(2024, 1, 1))], "id bigint, repo_id bigint, feature_names string, created_at timestamp")
    assert ds.list_datasets(df).first().feature_names == []


def test_csv_datasets(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.5, 3.0, 1, "train"), (2, "b", None, 4.0, 0, "train")], "file_id bigint, filepath string, wmc double, loc double, is_buggy int, split string")
    ds.save_csv(df, str(tmp_path), 7)
    train, test = ds.load_dataset(spark, str(tmp_path), 7)
    assert sorted(map(tuple, train.collect())) == [(1, "a", 1.5, 3.0, 1), (2, "b", None, 4.0, 0)]
    assert test.count() == 0
    with pytest.raises(FileNotFoundError):
        ds.load_dataset(spark, str(tmp_path), 8)
    (tmp_path / "train_9.csv").write_text("file_id,filepath,loc,is_buggy\n1,p,10,0\n")
    train, test = ds.load_dataset(spark, str(tmp_path), 9)
    assert test is None and [tuple(r) for r in train.collect()] == [(1, "p", 10.0, 0)]
    (tmp_path / "train_10.csv").write_text("file_id,filepath,loc,is_buggy\n9007199254740993,p,10,0.0\n4.0,q,1.5,1\n")
    train, _ = ds.load_dataset(spark, str(tmp_path), 10)
    assert sorted(map(tuple, train.collect())) == [(4, "q", 1.5, 1), (9007199254740993, "p", 10.0, 0)]


def test_purge_goes_through_datasets(spark):
    tables = {
        "repositories": spark.createDataFrame([(1,), (2,)], "id bigint"),
        "datasets": spark.createDataFrame([(10, 1), (20, 2)], "id bigint, repo_id bigint"),
        "feature_vectors": spark.createDataFrame([(10, "a"), (20, "b")], "dataset_id bigint, filepath string"),
        "models": spark.createDataFrame([("m", 1, 10), ("n", 2, 10), ("o", 2, 20)], "model_id string, repo_id bigint, dataset_id bigint")}
    left = upserts.purge_repos(tables, spark.createDataFrame([(1,)], "id bigint"))
    assert [r.filepath for r in left["feature_vectors"].collect()] == ["b"]
    assert [r.id for r in left["datasets"].collect()] == [20]
    assert sorted(map(tuple, left["models"].collect())) == [("m", None, None), ("n", 2, None), ("o", 2, 20)]


def test_runs_keep_the_whole_plan_in_pages(spark, tmp_path):
    rows = [(1, i, f"T{i}", "m", 0.5, 10.0, 1.0, 0.0, False, False) for i in range(25)]
    df = sel.with_priority_score(spark.createDataFrame(rows, "repo_id int, pos int, id string, module string, risk double, effort double, criticite double, coverage_gap double, mandatory boolean, excluded boolean"))
    plan = sel.with_reason(sel.greedy_select(df, 100), 100)
    path = str(tmp_path / "runs")
    for recording in ("one", "two", "one"):  # the third replaces the first
        registry.record_run(plan, path, 100, {"risk": 1.0}, plan_rows=10, recording=recording)
    runs = registry.decode_json(registry.read_runs(spark, path)).collect()
    assert sorted(r.id for r in runs) == ["one-1", "two-1"]
    assert {(r.items_total, r.items_selected, r.effort_total, r.effort_selected) for r in runs} == {(25, 10, 250.0, 100.0)}
    assert runs[0].weights == {"risk": 1.0}
    pages = registry.decode_json(registry.read_pages(spark, path)).where("run_id = 'one-1'").orderBy("page").collect()
    assert [len(r.plan) for r in pages] == [10, 10, 5]
    assert [i["rank"] for r in pages for i in r.plan] == list(range(1, 26))
    assert [r.id for r in dashboards.latest_runs(registry.read_runs(spark, path), 1).collect()] == ["one-1"]


def test_stored_confusion(spark):
    df = spark.createDataFrame([("m", '{"tn": 5, "fp": 1, "tp": 2}'), ("n", None)], "model_id string, confusion_matrix string")
    assert registry.model_confusion(df, "m").first().matrix == [[5, 1], [0, 2]]
    assert registry.model_confusion(df, "n").count() == 0


def test_csv_export_quotes_only_where_needed(spark, tmp_path):
    df = spark.createDataFrame([("a,b", True, 2.0, None), ('say "x"', False, 2.5, "m"), (" p ", None, None, "l1\nl2")],
                               "id string, selected boolean, effort double, module string").coalesce(1)
    export.export_plan_csv(df, {"id": "Test", "selected": "Selected", "effort": "Effort", "module": "Module"}, str(tmp_path / "x"))
    text = next((tmp_path / "x").glob("part-*.csv")).read_text()
    assert text == 'Test,Selected,Effort,Module\n"a,b",Yes,2,\n"say ""x""",No,2.5,m\n p ,,,"l1\nl2"\n'
