"""Records that cannot be read are set apart with their reason, and nothing is lost."""

import pytest

from defectscope.sources import datasets, landing

GOOD = '{"repo_id": 1, "sha": "a", "commit": {"message": "Fix", "author": {"name": "n", "email": null, "date": "2024-01-02T03:04:05Z"}}}'


def test_broken_commits(spark, tmp_path):
    lines = [GOOD, GOOD.replace('"a"', '"b"')[:50], GOOD.replace(": 1", ': "one"'), GOOD.replace('"repo_id": 1, ', ""), GOOD.replace('"sha": "a", ', ""), GOOD.replace('"sha": "a"', '"sha": ""'),
             '{"repo_id": 1, "sha": "c"}', '{"repo_id": 2, "sha": "d", "commit": {}}', "not json", "[1, 2]", ""]
    (tmp_path / "1.json").write_text("\n".join(lines))
    (tmp_path / "2.json").write_text(GOOD.replace('"a"', '"z"') + "\n{")
    commits, rejects = landing.read_commits_checked(spark, str(tmp_path))
    assert sorted(r.sha for r in commits.collect()) == ["a", "d", "z"]
    assert commits.schema == landing.read_commits(spark, str(tmp_path)).schema
    found = sorted((r.file[-6:], r.reason, r.record) for r in rejects.collect())
    assert [(f, why) for f, why, _ in found] == sorted(
        [("1.json", "unreadable")] * 4 + [("1.json", "no repository"), ("1.json", "no sha"), ("1.json", "no sha"), ("1.json", "no commit"), ("2.json", "unreadable")])
    assert ("1.json", "unreadable", "not json") in found and ("2.json", "unreadable", "{") in found
    assert {(r.file[-6:], r.reason, r.n) for r in landing.reject_counts(rejects).collect()} == {
        ("1.json", "unreadable", 4), ("1.json", "no repository", 1), ("1.json", "no sha", 2), ("1.json", "no commit", 1), ("2.json", "unreadable", 1)}


def test_all_sound_and_empty(spark, tmp_path):
    (tmp_path / "1.json").write_text(GOOD)
    commits, rejects = landing.read_commits_checked(spark, str(tmp_path))
    assert commits.count() == 1 and rejects.count() == 0
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "1.json").write_text("")
    commits, rejects = landing.read_commits_checked(spark, str(tmp_path / "none"))
    assert commits.count() == 0 and rejects.count() == 0


def test_broken_dataset_rows(spark, tmp_path):
    (tmp_path / "train_1.csv").write_text("file_id,filepath,loc,is_buggy\n1,a.py,3.0,1\n2,b.py,many,0\n3,c.py,,1\n4,d.py\n5,e.py,7,0,9\n9007199254740993,f.py,1e3,0\n")
    train, test, rejects = datasets.load_dataset_checked(spark, str(tmp_path), 1)
    assert test is None and [(r.file_id, r["loc"]) for r in train.collect()] == [(1, 3.0), (3, None), (9007199254740993, 1000.0)]
    assert sorted((r.reason, r.record) for r in rejects.collect()) == [
        ("unreadable", "4,d.py"), ("unreadable", "5,e.py,7,0,9"), ("unreadable number", '{"file_id":"2","filepath":"b.py","loc":"many","is_buggy":"0"}')]
    (tmp_path / "test_1.csv").write_text("file_id,filepath,loc,is_buggy\nx,a.py,3.0,1\n")
    train, test, rejects = datasets.load_dataset_checked(spark, str(tmp_path), 1)
    assert test.count() == 0 and rejects.count() == 4
    with pytest.raises(FileNotFoundError):
        datasets.load_dataset_checked(spark, str(tmp_path), 2)
