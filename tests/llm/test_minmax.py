"""Min-max hashing and exact components in buckets, against all pairs."""

import numpy as np
import pytest

from defectscope.llm import alike, minmax
from tests.llm.cases import documents, groups, odd_rows, prose


def shingles(text, k=4):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def by_hand(rows, k=4):
    sets = [shingles(t, k) for _, t, *_ in rows]
    label = groups(sets, lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b))
    first = {g: min((r[0] for r, own in zip(rows, label) if own == g and r[0] is not None), default=None) for g in set(label)}
    return [(r[0], len(s), first[g], r[0] == first[g]) for r, s, g in zip(rows, sets, label)]


def near_copies():
    own = np.random.default_rng(11)
    rows = odd_rows()
    for k in range(40):  # pairs from just below to far above the likeness
        base = prose(3000 + k, 60 + 5 * k).split()
        copy = list(base)
        for at in own.choice(len(base), max(1, int(len(base) * (0.005 + 0.002 * k))), replace=False):
            copy[at] = "changed"
        rows += [(200 + 2 * k, " ".join(base), "en", "s"), (201 + 2 * k, " ".join(copy).upper(), "en", "s")]
    chain = prose(4000, 300).split()
    for k in range(15):
        chain = chain[8:] + prose(4100 + k, 8).split()
        rows.append((500 + k, " ".join(chain), "en", "s"))
    # A group whose members are near its middle but not near one another, and ones near nothing.
    base = prose(4500, 200).split()
    for k in range(90):
        copy = list(base)
        for at in own.choice(len(base), 2 + k % 14, replace=False):
            copy[at] = prose(4600 + k % 25, 1)
        rows.append((600 + k, " ".join(copy), "en", "s"))
    rows += [(800 + k, prose(5000 + k, 40) + " " + prose(6000, 30), "en", "s") for k in range(40)]  # a common passage
    return rows + [(900, "a b c d e f g h", "en", "s"), (901, "a b c d e f g", "en", "s"), (902, "A  b", "en", "s"), (903, "a B", "en", "s")]


def test_near_duplicates_match_all_pairs(spark):
    rows = near_copies()
    found = minmax.near_duplicates(documents(spark, rows)).collect()
    assert sorted([tuple(r) for r in found], key=repr) == sorted(by_hand(rows), key=repr)
    assert minmax.near_duplicates(documents(spark, rows).limit(0)).count() == 0
    texts = spark.createDataFrame([("b", "one two three"), ("a", "one two three"), (None, "")], "doc_id string, text string")
    assert {tuple(r) for r in minmax.near_duplicates(texts).collect()} == {("b", 1, "a", False), ("a", 1, "a", True), (None, 0, None, True)}


@pytest.mark.parametrize("pivots,piece", [(0, 1024), (0, 7), (3, 7)])
def test_components_in_buckets_match_all_pairs(spark, pivots, piece):
    """All in one bucket, so that cells of few members and of many settle what pivots leave."""
    sets = [minmax.shingle_set(t, 4) for _, t, *_ in near_copies() if t and t.strip()]
    frame = spark.createDataFrame([(0, k, len(s), s.tobytes()) for k, s in enumerate(sets)], "bucket bigint, node bigint, size bigint, elements binary")
    found = alike.alike_components(frame.drop("elements"), lambda wanted: frame.select("node", "elements").join(wanted, "node"), (4, 5), pivots=pivots, piece=piece)
    label = dict(map(tuple, found.collect()))
    want = groups([set(s.tolist()) for s in sets], lambda a, b: 5 * len(a & b) >= 4 * len(a | b))
    got = [label.get(k, k) for k in range(len(sets))]
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_comparisons_grow_with_the_rows_of_a_group(spark, monkeypatch):
    """A group of near copies of one text needs about a comparison a member."""
    for n in (200, 800):
        base = prose(77, 300).split()
        rows = [(0, " ".join(base), "en", "s")]
        own = np.random.default_rng(n)
        for k in range(n):
            copy = list(base)
            for at in own.choice(300, 4, replace=False):
                copy[at] = f"w{k}x{at}"
            rows.append((k + 1, " ".join(copy), "en", "s"))
        frames = []
        written = alike.written
        monkeypatch.setattr(alike, "written", lambda df, name: frames.append((name, written(df, name))) or frames[-1][1])
        found = minmax.near_duplicates(documents(spark, rows))
        assert found.where("component_id = 0").count() == n + 1
        monkeypatch.setattr(alike, "written", written)
        compared = [f.count() for name, f in frames if name == "found"]
        cells = [f.count() for name, f in frames if name == "buckets"]
        assert sum(compared) <= 1.5 * n and sum(cells) == 0


def test_common_elements():
    own = np.random.default_rng(1)
    sets = [np.unique(own.integers(0, 400, own.integers(0, 300)).astype("<u8")) for _ in range(150)] + [np.empty(0, "<u8")]
    assert alike.common(sets).tolist() == [[len(np.intersect1d(a, b)) for b in sets] for a in sets]


def test_signatures_estimate_the_likeness_without_bias():
    """Minima and maxima agree as often as the sets are alike, and vary less than as many minima would."""
    own = np.random.default_rng(2)
    estimates, true = [], []
    for _ in range(300):
        common, a, b = (own.integers(0, 2**63, n).astype("<u8") for n in (80, 10, 10))
        one, two = (minmax.signature(np.unique(np.r_[common, x])) for x in (a, b))
        estimates.append((one == two).mean())
        true.append(0.8)
    error = np.array(estimates) - true
    assert abs(error.mean()) < 0.01 and error.var() < 1.1 * 0.8 * 0.2 / (2 * minmax.PERMUTATIONS)
