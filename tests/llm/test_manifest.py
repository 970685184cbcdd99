"""Proofs of the dataset manifest against a tree built node by node."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from defectscope.llm import manifest
from tests.llm.cases import documents, odd_rows, prose


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climbed(leaves):
    """The root and each leaf's siblings, in order."""
    proofs, at = [[] for _ in leaves], list(range(len(leaves)))
    while len(leaves) > 1:
        for n, k in enumerate(at):
            if k ^ 1 < len(leaves):
                proofs[n].append(leaves[k ^ 1])
        leaves, at = [h(*leaves[k:k + 2]) for k in range(0, len(leaves), 2)], [k >> 1 for k in at]
    return leaves[0], proofs


def by_hand(rows):
    """rows: (doc_id, text, lang, source, n_chars); (doc_id, leaf, subroot, root, proof) of each."""
    trees = {}
    for i, text, lang, source, n in rows:
        trees.setdefault(lang, []).append((i, h(*map(field, (i, source, lang, n, text)))))
    trees = {lang: sorted(t, key=lambda r: (r[0] is not None, r[0] or 0, r[1])) for lang, t in trees.items()}
    order = sorted(trees, key=lambda lang: (lang is not None, (lang or "").encode()))
    roots = {lang: climbed([leaf for _, leaf in trees[lang]]) for lang in order}
    root, above = climbed([roots[lang][0] for lang in order])
    return [(i, leaf, roots[lang][0], root, h(*below, *top)) for lang, top in zip(order, above)
            for (i, leaf), below in zip(trees[lang], roots[lang][1])]


@pytest.mark.parametrize("step", [12, 2])
def test_manifest_by_hand(spark, step):
    rows = odd_rows() + [(1000 + i, prose(i, 3 + i % 9), ("en", "de", "fr", "é", "")[i % 5 % (1 + i % 4)], f"s{i % 3}") for i in range(150)]
    rows += [(2000, "only one", "xx", "s"), (2001, "x", "y", "s"), (2002, "x", "y", "s")]
    docs = documents(spark, rows)
    found = manifest.manifest(docs, tampered=F.crc32(F.col("doc_id").cast("string")) % 7 == 0, step=step).collect()
    full = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]
    assert sorted([(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256) for r in found], key=repr) == sorted(by_hand(full), key=repr)
    changed = {i for i, t, *_ in rows if i is not None and t is not None and zlib.crc32(str(i).encode()) % 7 == 0}
    assert changed and {r.doc_id for r in found if not r.verified} == changed
    assert all((r.folded_root == r.root) == r.verified for r in found)


def test_manifest_of_few_rows(spark):
    rows = [(1, "a", "en", "s"), (2, "b", "de", "s"), (3, None, None, None)]
    for n in range(4):
        found = manifest.manifest(documents(spark, rows[:n]) if n else documents(spark, rows).limit(0)).collect()
        full = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows[:n]]
        want = by_hand(full) if n else []
        assert sorted([(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256) for r in found], key=repr) == sorted(want, key=repr)
        assert all(r.verified for r in found)


def test_rounds_grow_with_the_logarithm_of_the_height(spark, monkeypatch):
    """Many rows of one language and many languages of one row; four levels a join round are two rounds."""
    names = []
    real = manifest.written
    monkeypatch.setattr(manifest, "written", lambda df, name: names.append(name) or real(df, name))
    rows = [(i, str(i), "en", "s") for i in range(1000)] + [(5000 + i, str(i), f"l{i}", "s") for i in range(60)]
    found = manifest.manifest(documents(spark, rows)).collect()
    assert len(found) == 1060 and all(r.verified for r in found)
    assert names.count("jumped") == 4  # heights 10 and 6: jumps of 2, 4, 8 and 16 levels
