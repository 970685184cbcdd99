"""Imports resolved to files."""

from defectscope.operators import changes as ch
from defectscope.operators import modules as md

FILES = [
    (1, "src/pkg/__init__.py", ""),
    (1, "src/pkg/a.py", "import os, pkg.b as x\nfrom pkg import c, d\nfrom . import b\nfrom .sub import deep\nfrom ..other import *  # note\n"),
    (1, "src/pkg/b.py", "from pkg.a import thing\nimport pkg\n"),
    (1, "src/pkg/c.py", "from pkg.sub.deep import (one,  # first\n    two)\nfrom .... import far\nfrom nowhere import c\n"),
    (1, "src/pkg/d.py", "    from pkg.sub import deep\nimport util\nimport a\nfrom pkg import *\n"),
    (1, "src/pkg/sub/__init__.py", "from . import deep\nfrom .. import b\n"),
    (1, "src/pkg/sub/deep.py", "import src.pkg.sub.deep\n"),
    (1, "src/other.py", "notimport pkg\n# import pkg.a\n"),
    (1, "x/util.py", ""), (1, "y/util.py", ""),
    (1, "a.py", None),
    (1, "java/com/x/A.java", "package com.x;\nimport com.x.B;\nimport static com.x.C.call;\nimport java.util.List;\nimport com.x.*;\n"),
    (1, "java/com/x/B.java", "import com.x.A ;\nimport com.x.A;\n"), (1, "java/com/x/C.java", ""),
    (1, "web/a.js", "import pkg.a"),
    (2, "pkg/a.py", "import pkg.b\n"), (2, "pkg/a.py", "import pkg.b\n"),
    (None, "pkg/b.py", "import pkg.a\n"), (2, None, "import pkg.a\n"),
]


def sources(spark, rows=FILES):
    return spark.createDataFrame([(r, k, p, c) for k, (r, p, c) in enumerate(rows)], "repo_id bigint, file_id bigint, filepath string, content string")


def targets(spark):
    out = {}
    for r in md.resolved_imports(sources(spark)).collect():
        out.setdefault((r.repo_id, r.filepath), []).append((r.number, r.target, r.files))
    return {k: [v[1:] for v in sorted(v)] for k, v in out.items()}


def test_longest_name_and_best_covered_file_win(spark):
    found = targets(spark)
    p = "src/pkg/"
    assert found[1, p + "a.py"] == [(p + "c.py", 1), (p + "d.py", 1), (p + "b.py", 1), (p + "sub/deep.py", 1), ("src/other.py", 1), (None, 0), (p + "b.py", 1)]
    assert found[1, p + "b.py"] == [(p + "a.py", 1), (p + "__init__.py", 1)]
    assert found[1, p + "c.py"] == [(p + "sub/deep.py", 1), (p + "sub/deep.py", 1), (None, 0), (None, 0)]
    # `a` is the file at the root, not the one deeper in the tree; `util` is two files.
    assert found[1, p + "d.py"] == [(p + "sub/deep.py", 1), (p + "__init__.py", 1), (None, 2), ("a.py", 1)]
    assert found[1, p + "sub/__init__.py"] == [(p + "sub/deep.py", 1), (p + "b.py", 1)]
    assert found[1, p + "sub/deep.py"] == [(p + "sub/deep.py", 1)]
    assert (1, "src/other.py") not in found and (1, "a.py") not in found
    j = "java/com/x/"
    assert found[1, j + "A.java"] == [(j + "B.java", 1), (j + "C.java", 1), (None, 0)]
    assert found[2, "pkg/a.py"] == [(None, 0)]


def test_degrees_of_files(spark):
    found = {(r.repo_id, r.filepath): (r.fan_out, r.fan_in, r.unresolved, r.ambiguous) for r in md.file_dependency_degrees(sources(spark)).collect()}
    assert len(found) == 16
    p = "src/pkg/"
    assert found[1, p + "a.py"] == (5, 1, 1, 0)
    assert found[1, p + "b.py"] == (2, 2, 0, 0)
    assert found[1, p + "sub/deep.py"] == (0, 4, 0, 0)  # its own import of itself is no edge
    assert found[1, p + "d.py"] == (3, 1, 0, 1)
    assert found[1, "x/util.py"] == (0, 0, 0, 0) and found[1, "web/a.js"] == (0, 0, 0, 0)
    assert found[1, "java/com/x/A.java"] == (2, 1, 1, 0) and found[1, "java/com/x/B.java"] == (1, 1, 0, 0)
    assert found[2, "pkg/a.py"] == (0, 0, 1, 0)
    assert md.file_dependency_degrees(sources(spark).limit(0)).count() == 0


def test_module_degrees_are_as_before(spark):
    edges = spark.createDataFrame([(1, "x", "m"), (1, "y", "m")], "repo_id bigint, source string, target string")
    assert {(r.node, r.fan_out, r.fan_in) for r in ch.dependency_degrees(edges).collect()} == {("x", 1, 0), ("y", 1, 0), ("m", 0, 2)}


def test_no_python_and_no_pair_joins(spark):
    plan = md.file_dependency_degrees(sources(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "CartesianProduct", "NestedLoop"))
