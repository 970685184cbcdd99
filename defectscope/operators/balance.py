"""Exact nearest neighbours inside a class, and oversampling between neighbours.

Neighbours of a small group are found in one task. A large group is cut into boxes by median
splits (a k-d tree over a sample). A row's neighbours in its own box bound its distance, and it
only visits the boxes within that bound, so neither all rows nor all pairs of a group ever meet
in one place; boxes are compared by matrix products. Many copies of one vector are
harmless: only the k + 1 copies with the smallest ids can be anybody's neighbours.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from defectscope.operators.features import SEED, shuffled
from defectscope.operators.ranking import ranked, small_side, split_hot, top_rows
from defectscope.session import cut_lineage

# Distinct vectors of one group compared inside one task, and rows of one block of a cell.
GROUP_LIMIT = 5_000
BLOCK_ROWS = 10_000
# Rows of a cell, on average, and of the sample that cells are cut by: of a group at least, and of each cell.
CELL_ROWS = 4_096
SAMPLE_ROWS = 4_096
SAMPLE_CELL_ROWS = 16
# Copies of one row made by one task at a time.
COPIES_BLOCK = 10_000

# Neighbours used for oversampling and the size it needs.
NEIGHBOURS = 5
SMOTE_MIN_ROWS = 5

_NEAR = "repo_id bigint, q bigint, id bigint, d2 double"
_LIST = "repo_id bigint, q bigint, near array<struct<d2: double, id: bigint>>"


def minority_knn(df: DataFrame, cols: Sequence[str], k: int, group_limit: int = GROUP_LIMIT,
                 block_rows: int = BLOCK_ROWS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(repo_id, id, place, neighbour, d2): the k nearest other rows by squared Euclidean
    distance, ties by id, within each repository. Rows are read once more where a vector has many copies."""
    vec = F.array(*[F.col(c).cast("double") for c in cols])
    rows = df.select("repo_id", "id", vec.alias("vec")).withColumn("hash", F.xxhash64("vec"))
    # The hash comes first, so that sorting seldom compares vectors. One copy more than can be anybody's neighbour tells that there may be others.
    same = ["hash", "repo_id", "vec"]
    ranks = top_rows(rows, same, [F.asc("id")], k + 2, rank="copy")
    copies = Window.partitionBy(*same)
    known = cut_lineage(ranks.select(
        *same, "id", "copy", F.min(F.struct("copy", "id")).over(copies)["id"].alias("q"), (F.max("copy").over(copies) > k + 1).alias("more")))
    members = known.where(F.col("copy") <= k + 1).select("repo_id", "id", "vec", (F.col("copy") == 1).alias("head"))
    small, large, _ = split_hot(members, ["repo_id"], group_limit)
    near = _spread(small.drop("head"), "repo_id").groupBy("repo_id").applyInPandas(_all_in_one_task(k), _NEAR)
    settled, open_ = _by_cells(large, k, block_rows, cell_rows) if large is not None else (None, None)
    # `near` answers for the smallest id of each vector; every copy shares that answer.
    answered = known.where("NOT more").select("repo_id", "id", "q")
    crowded = known.where("more AND copy = 1").select(*same, "q")
    if not crowded.isEmpty():
        answered = answered.unionByName(rows.join(crowded, same).select("repo_id", "id", "q"))
    by_query, order = ["repo_id", "q"], [F.asc("d2"), F.asc("id")]
    if not answered.groupBy("repo_id", "id").count().where("id IS NOT NULL AND count > 1").isEmpty():
        # Rows of one id share their places.
        if large is not None:
            found = settled.select(*by_query, F.inline("near")).select(*by_query, "id", "d2").unionByName(open_)
            near = near.unionByName(top_rows(found, by_query, order, k + 1))
        pairs = (
            answered.join(near.select("repo_id", "q", F.col("id").alias("neighbour"), "d2"), by_query)
            .where(F.col("id") != F.col("neighbour")))
        return top_rows(pairs, ["repo_id", "id"], [F.asc("d2"), F.asc("neighbour")], k, rank="place").drop("q")
    if large is not None:
        near = near.unionByName(top_rows(open_, by_query, order, k + 1))
    near = near.groupBy(*by_query).agg(F.array_sort(F.collect_list(F.struct("d2", "id"))).alias("near"))
    if large is not None:
        near = cut_lineage(near.unionByName(settled))
    others = answered.where(F.col("id") != F.col("q"))
    kinds = {c: df.schema[c].dataType for c in ("repo_id", "id")}
    lists = near.where("repo_id IS NOT NULL AND q IS NOT NULL").select(F.col("repo_id").cast(kinds["repo_id"]), F.col("q").cast(kinds["id"]).alias("id"), "near")
    lists = lists.unionByName(small_side(others, others.count()).join(near, by_query).select("repo_id", "id", "near"))
    places = lists.select("repo_id", "id", F.posexplode(F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)).alias("place", "x"))
    return places.select("repo_id", "id", F.col("x.id").alias("neighbour"), F.col("x.d2").alias("d2"), (F.col("place") + 1).cast("bigint").alias("place"))


def _nearest():
    """The kernel of every task: the n nearest members of each query, ties by id."""
    import numpy as np

    def nearest(q, members, ids, n):
        """(row of q, id, squared distance) of the n nearest members of every row."""
        n = min(n, len(ids))
        for start in range(0, len(q), 256):
            part = q[start:start + 256]
            d2 = np.zeros((len(part), len(ids)))
            for c in range(members.shape[1]):
                d2 += (part[:, c, None] - members[None, :, c]) ** 2
            # Everything up to the n-th distance, equal ones included; then ties by id.
            i, j = np.nonzero(d2 <= np.partition(d2, n - 1, axis=1)[:, n - 1, None])
            d, near = d2[i, j], ids[j]
            order = np.lexsort((near, d, i))
            i, d, near = i[order], d[order], near[order]
            place = np.arange(len(i)) - np.searchsorted(i, i, side="left")
            keep = place < n
            yield start + i[keep], near[keep], d[keep]

    return nearest


def _frame():
    import numpy as np
    import pandas as pd

    def frame(repo, q_ids, rows, ids, d2):
        return pd.DataFrame({"repo_id": np.full(len(rows), repo), "q": q_ids[rows], "id": ids, "d2": d2})

    return frame


def _all_in_one_task(k: int):
    nearest, frame = _nearest(), _frame()

    def search(pdf):
        import numpy as np
        import pandas as pd

        vecs, ids = np.array(pdf["vec"].tolist(), dtype=float), pdf["id"].to_numpy()
        keys = pdf["vec"].map(tuple)
        heads = pdf.groupby(keys)["id"].idxmin().to_numpy()
        place = pdf.index.get_indexer(heads)
        repo = pdf["repo_id"].iloc[0]
        return pd.concat([frame(repo, ids[place], *found) for found in nearest(vecs[place], vecs, ids, k + 1)])

    return search


# A row is a cell: ids, vectors and heads (the queries) of its members, the queries' bounds so far, and what they found in their own cell.
_CELL = "repo_id bigint, cell bigint, n int, ids binary, vecs binary, q binary, at binary, bound binary, near_q binary, near_id binary, near_d2 binary, low binary, high binary"


def _by_cells(members: DataFrame, k: int, block_rows: int, cell_rows: int) -> tuple[DataFrame, DataFrame]:
    """The k + 1 nearest members of every head (smallest id of a vector), over cells of about `cell_rows`: lists (`_LIST`)
    for heads whose own cell has them all, and rows (`_NEAR`) for the others, in which there are further members too.

    Cells are boxes: a tree of median splits of a sample. A query first searches its own
    cell, which bounds its distance, and then visits the cells whose boxes lie within it.
    """
    sizes = cut_lineage(members.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n")))
    # One row a group: large groups are few.
    groups = sizes.count()
    sized = members.join(small_side(sizes, groups), "repo_id")
    # At least 4,096 rows of a group on average, more for more cells; only balance depends on it.
    sampled = sized.where(F.pmod(F.xxhash64("id"), F.col("n")) < F.greatest(F.lit(SAMPLE_ROWS), F.floor(F.col("n") * SAMPLE_CELL_ROWS / cell_rows)))
    trees = cut_lineage(sampled.select("repo_id", "n", "vec").groupBy("repo_id").applyInPandas(_tree(cell_rows), "repo_id bigint, axes binary, splits binary"))
    blocks = sizes.select("repo_id", F.ceil(F.col("n") / block_rows).alias("blocks"))
    blocked = members.join(small_side(blocks, groups), "repo_id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).drop("blocks")
    for_every_block = blocks.join(trees, "repo_id", "left").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).drop("blocks")
    pieces = cut_lineage(
        _spread(blocked, "repo_id", "block").groupBy("repo_id", "block")
        .cogroup(_spread(_renewed(for_every_block), "repo_id", "block").groupBy("repo_id", "block"))
        .applyInPandas(_assign(), "repo_id bigint, block bigint, cell bigint, n int, ids binary, vecs binary, heads binary"))
    # A cell that ties of values overfill is cut into parts by block.
    parts = pieces.groupBy("repo_id", "cell").agg(F.ceil(F.sum("n") / (2 * cell_rows)).alias("parts"))
    part = F.pmod(F.xxhash64("block"), F.col("parts"))
    cells = cut_lineage(
        _spread(pieces.join(parts, ["repo_id", "cell"]).withColumn("cell", F.col("cell") + F.shiftleft(part, 32)), "repo_id", "cell")
        .groupBy("repo_id", "cell").applyInPandas(_own_cell(k), _CELL))
    boxes = cells.select("repo_id", "cell", "low", "high").groupBy("repo_id").agg(F.collect_list(F.struct("cell", "low", "high")).alias("boxes"))
    sides = ["repo_id", "cell", "q", "at", "bound", "low", "high"]
    boxes = small_side(boxes, groups)
    visits = cells.select(*sides).join(boxes, "repo_id").mapInPandas(_visits(), "repo_id bigint, cell bigint, q binary, at binary, bound binary")
    meeting = visits.join(cells.select("repo_id", "cell", "ids", "vecs"), ["repo_id", "cell"])
    elsewhere = _spread(meeting, "repo_id", "cell", "q").mapInPandas(_meet(k), _NEAR)
    own = cut_lineage(cells.select(*sides, "near_q", "near_id", "near_d2").join(boxes, "repo_id").mapInArrow(_lists(), f"{_LIST}, settled boolean"))
    rest = own.where("NOT settled").select("repo_id", "q", F.inline("near")).select("repo_id", "q", "id", "d2")
    return own.where("settled").drop("settled"), rest.unionByName(elsewhere)


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partitioning that AQE does not coalesce: few bytes here mean a lot of arithmetic."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _renewed(df: DataFrame) -> DataFrame:
    """Same columns under new ids: both sides of a cogroup stem from one frame."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _tree(cell_rows: int):
    def tree(pdf):
        """Median splits of the widest axis, as a heap: children of node i are 2 i + 1 and 2 i + 2."""
        import numpy as np
        import pandas as pd

        vecs = np.array(pdf["vec"].tolist(), dtype=float)
        vecs = vecs[np.isfinite(vecs).all(axis=1)]
        depth = max(0, int(np.ceil(np.log2(pdf["n"].iloc[0] / cell_rows))))
        # A leaf of fewer sampled rows would not be balanced.
        depth = min(depth, int(np.log2(max(1, len(vecs) / 8))))
        axes, splits, held = np.zeros(2**depth - 1, np.int32), np.full(2**depth - 1, np.inf), {0: vecs}
        for i in range(len(axes)):
            mine = held.pop(i)
            left = np.ones(len(mine), bool)
            if len(mine):
                axes[i] = (mine.max(axis=0) - mine.min(axis=0)).argmax()
                values = mine[:, axes[i]]
                middle = np.median(values)
                if middle == values.max():  # ties at the top: they go right together
                    below = values[values < middle]
                    middle = below.max() if len(below) else middle
                splits[i], left = middle, values <= middle
            held[2 * i + 1], held[2 * i + 2] = mine[left], mine[~left]
        return pd.DataFrame({"repo_id": pdf["repo_id"].iloc[:1].to_numpy(), "axes": [axes.tobytes()], "splits": [splits.tobytes()]})

    return tree


def _assign():
    def assign(rows, trees):
        """The rows of one block by cell, packed."""
        import numpy as np
        import pandas as pd

        if not len(rows):
            return pd.DataFrame(columns=["repo_id", "block", "cell", "n", "ids", "vecs", "heads"])
        vecs, ids = np.array(rows["vec"].tolist(), dtype=float), rows["id"].to_numpy("int64")
        heads = rows["head"].to_numpy(bool)
        known = len(trees) and trees["axes"].iloc[0] is not None
        axes, splits = (np.frombuffer(trees["axes"].iloc[0], np.int32), np.frombuffer(trees["splits"].iloc[0])) if known else (np.zeros(0, np.int32), np.zeros(0))
        node, every = np.zeros(len(rows), "int64"), np.arange(len(rows))
        for _ in range(len(axes).bit_length()):
            node = 2 * node + 1 + ~(vecs[every, axes[node]] <= splits[node])
        order = np.argsort(node, kind="stable")
        cells, first = np.unique(node[order], return_index=True)
        out = [(int(c), len(own), ids[own].tobytes(), vecs[own].tobytes(), heads[own].tobytes()) for c, own in zip(cells, np.split(order, first[1:]))]
        packed = pd.DataFrame(out, columns=["cell", "n", "ids", "vecs", "heads"])
        packed.insert(0, "block", rows["block"].iloc[0])
        packed.insert(0, "repo_id", rows["repo_id"].iloc[0])
        return packed

    return assign


def _search():
    """Kernel of the cells: products of matrices find all rows within a bound and a rounding error, whose distances are then summed as defined."""
    import numpy as np

    def search(q, bound, members, ids, n):
        """(rows of q, ids, squared distances) of the n nearest members within each row's bound, ties by id, in batches."""
        n = min(n, len(ids))
        finite = np.isfinite(members).all() and np.isfinite(q).all()
        if finite:
            center = members.mean(axis=0)
            m = members - center
            m2 = (m * m).sum(axis=1)
            # One product gives m2 + p2 - 2 p m.
            m = np.column_stack([m, np.ones(len(m)), m2]).T.copy()
        for start in range(0, len(q), 256):
            part, limit = q[start:start + 256], bound[start:start + 256]
            if finite:
                p = part - center
                p2 = (p * p).sum(axis=1)
                about = np.column_stack([-2 * p, p2, np.ones(len(p))]) @ m
                slack = 4 * (members.shape[1] + 10) * np.finfo(float).eps * (p2 + m2.max())
            else:
                with np.errstate(invalid="ignore"):
                    about = sum((part[:, c, None] - members[None, :, c]) ** 2 for c in range(members.shape[1]))
                about, slack = np.where(np.isnan(about), np.inf, about), np.zeros(len(part))
            if not np.isfinite(limit).all():
                limit = np.minimum(limit, np.partition(about, n - 1, axis=1)[:, n - 1] + 2 * slack)
            i, j = np.divmod(np.flatnonzero(about <= (limit + slack)[:, None]), len(ids))
            d = np.zeros(len(i))
            with np.errstate(invalid="ignore"):
                for c in range(members.shape[1]):
                    d += (part[i, c] - members[j, c]) ** 2
            near = ids[j]
            order = np.lexsort((near, d, i))
            order = order[~np.isnan(d[order])]
            i, d, near = i[order], d[order], near[order]
            place = np.arange(len(i)) - np.searchsorted(i, i, side="left")
            keep = place < n
            yield start + i[keep], near[keep], d[keep]

    return search


def _own_cell(k: int):
    search = _search()

    def own_cell(pieces):
        import numpy as np
        import pandas as pd

        ids = np.concatenate([np.frombuffer(b, "int64") for b in pieces["ids"]])
        vecs = np.concatenate([np.frombuffer(b) for b in pieces["vecs"]]).reshape(len(ids), -1)
        heads = np.concatenate([np.frombuffer(b, bool) for b in pieces["heads"]])
        q, at = ids[heads], vecs[heads]
        found = list(search(at, np.full(len(q), np.inf), vecs, ids, k + 1))
        rows, near, d2 = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), ids[:0], np.zeros(0))
        # The last of k + 1 neighbours found here bounds what is looked for elsewhere.
        bound, counts = np.full(len(q), np.inf), np.bincount(rows, minlength=len(q))
        full = counts > k
        bound[full] = d2[np.cumsum(counts)[full] - 1]
        low, high = np.fmin.reduce(vecs), np.fmax.reduce(vecs)
        row = (pieces["repo_id"].iloc[0], pieces["cell"].iloc[0], len(ids), ids.tobytes(), vecs.tobytes(), q.tobytes(), at.tobytes(), bound.tobytes(),
               q[rows].tobytes(), near.tobytes(), d2.tobytes(), low.tobytes(), high.tobytes())
        return pd.DataFrame([row], columns=[c.split()[0] for c in _CELL.split(", ")])

    return own_cell


def _reached():
    import numpy as np

    def reached(cell, q, at, boxes):
        """(number of another cell, which queries) for every other cell whose box is not beyond the queries' bounds."""
        others = [b for b in boxes if b["cell"] != cell["cell"]]
        if not len(q) or not others:
            return
        # Rounding of a sum of squares, relative.
        reach = np.frombuffer(cell["bound"]) * (1 + 1e-9)
        low, high = (np.array([np.frombuffer(b[side]) for b in others]) for side in ("low", "high"))
        with np.errstate(invalid="ignore"):
            apart = np.maximum(np.maximum(low - np.frombuffer(cell["high"]), np.frombuffer(cell["low"]) - high), 0)
            for b in np.flatnonzero(~((apart**2).sum(axis=1) > reach.max())):
                own = ~((np.maximum(np.maximum(low[b] - at, at - high[b]), 0) ** 2).sum(axis=1) > reach)
                if own.any():
                    yield others[b]["cell"], own

    return reached


def _lists():
    reached = _reached()

    def lists(batches):
        """What each query found in its own cell, in order, and whether no other cell can have more."""
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for number in range(batch.num_rows):
                cell = batch.slice(number, 1).to_pylist()[0]
                q = np.frombuffer(cell["q"], "int64")
                settled = np.ones(len(q), bool)
                for _, own in reached(cell, q, np.frombuffer(cell["at"]).reshape(len(q), -1) if len(q) else None, cell["boxes"]):
                    settled &= ~own
                near_q = np.frombuffer(cell["near_q"], "int64")
                # The rows found are by query, in the order of the queries.
                first = np.flatnonzero(np.r_[True, near_q[1:] != near_q[:-1]]) if len(near_q) else np.zeros(0, int)
                if len(first) == len(q) and (near_q[first] == q).all():
                    whole = settled
                else:  # a query that found nothing, or an id that repeats: to be ranked
                    whole = np.zeros(len(first), bool)
                found = pa.StructArray.from_arrays([pa.array(np.frombuffer(cell["near_d2"])), pa.array(np.frombuffer(cell["near_id"], "int64"))], ["d2", "id"])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(near_q)].astype(np.int32)), found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(first), cell["repo_id"], "int64")), pa.array(near_q[first]), lists, pa.array(whole)], ["repo_id", "q", "near", "settled"])

    return lists


def _visits():
    reached = _reached()

    def visits(frames):
        """The queries of a cell for every other cell whose box is not beyond their bounds, a row a cell."""
        import numpy as np
        import pandas as pd

        for frame in frames:
            for cell in frame.to_dict("records"):
                q, bound = np.frombuffer(cell["q"], "int64"), np.frombuffer(cell["bound"])
                at = np.frombuffer(cell["at"]).reshape(len(q), -1) if len(q) else None
                for other, own in reached(cell, q, at, cell["boxes"]):
                    yield pd.DataFrame({"repo_id": [cell["repo_id"]], "cell": [other], "q": [q[own].tobytes()], "at": [at[own].tobytes()], "bound": [bound[own].tobytes()]})

    return visits


def _meet(k: int):
    search, frame_of = _search(), _frame()

    def meet(frames):
        import numpy as np

        for frame in frames:
            for r in frame.itertuples():
                q, ids = np.frombuffer(r.q, "int64"), np.frombuffer(r.ids, "int64")
                at, vecs = np.frombuffer(r.at).reshape(len(q), -1), np.frombuffer(r.vecs).reshape(len(ids), -1)
                for found in search(at, np.frombuffer(r.bound), vecs, ids, k + 1):
                    if len(found[0]):
                        yield frame_of(r.repo_id, q, *found)

    return meet


def _draw(*parts: Column) -> Column:
    """A repeatable number in [0, 2^32) from the given columns."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def smote_facts(df: DataFrame, k: int, min_rows: int, label: str = "is_buggy") -> DataFrame:
    """Per repository: the smaller class, its size, how many rows it lacks, neighbours to use, all rows.

    Repositories that stay as they are (a class below two rows, too few rows in all, or a
    smaller class without enough neighbours) are left out.
    """
    pos = F.sum(F.col(label).cast("bigint"))
    sized = df.groupBy("repo_id").agg(pos.alias("pos"), (F.count(F.lit(1)) - pos).alias("neg"))
    return sized.select(
        "repo_id", F.when(F.col("pos") <= F.col("neg"), 1).otherwise(0).alias("minority"),
        F.least("pos", "neg").alias("m"), F.abs(F.col("pos") - F.col("neg")).alias("lacking"),
        F.least(F.lit(k).cast("bigint"), F.col("pos") - 1).alias("k"), (F.col("pos") + F.col("neg")).alias("rows"),
        ((F.col("pos") >= 2) & (F.col("neg") >= 2) & (F.col("pos") + F.col("neg") > min_rows)).alias("ok"),
    ).where(F.col("ok") & (F.col("lacking") > 0) & (F.col("m") > F.col("k"))).drop("ok")


def _few(facts: DataFrame) -> DataFrame:
    """A row a repository, written once; broadcast where they are few, so that no row moves to meet them."""
    facts = cut_lineage(facts)
    return small_side(facts, facts.count())


def minority_rows(df: DataFrame, k: int = NEIGHBOURS, min_rows: int = SMOTE_MIN_ROWS, label: str = "is_buggy") -> DataFrame:
    """The rows of the smaller class of each repository that has enough of both, with its `smote_facts`."""
    facts = _few(smote_facts(df, k, min_rows, label))
    return df.join(facts, "repo_id").where(F.col(label) == F.col("minority"))


def synthetic_rows(df: DataFrame, cols: Sequence[str], label: str = "is_buggy", k: int = NEIGHBOURS,
                   seed: int = SEED, min_rows: int = SMOTE_MIN_ROWS, **knn_limits) -> DataFrame:
    """New minority rows on segments between a row and one of its neighbours.

    Every minority row serves as a base equally often (the first in hash order once more);
    neighbour and position come from hashes, so a lost task rebuilds the same rows.
    """
    facts = _few(smote_facts(df, k, min_rows, label))
    return _synthetic(df, cols, facts, label, k, seed, knn_limits).drop("number", "rows")


def _synthetic(df: DataFrame, cols: Sequence[str], facts: DataFrame, label: str, k: int, seed: int, knn_limits) -> DataFrame:
    """`synthetic_rows` with `number`, their place in their repository by copy and id, from 1, and the repository's `rows`.

    A base carries its neighbours' vectors, so that its copies are made where it lies. With
    q = lacking div m copies of each of m bases, copy c <= q of the i-th base by id is number
    (c - 1) m + i; the copies q + 1 follow, in the order of their bases' ids.
    """
    values = [F.col(c).cast("double").alias(c) for c in cols]
    minority = cut_lineage(
        df.join(facts, "repo_id").where(F.col(label) == F.col("minority"))
        .select("repo_id", "id", label, *values, "m", "lacking", "k", "rows"))
    near = minority_knn(minority, cols, k, **knn_limits)
    ends = minority.select("repo_id", F.col("id").alias("neighbour"), F.array(*cols).alias("at"))
    listed = near.join(ends, ["repo_id", "neighbour"]).groupBy("repo_id", "id").agg(
        F.array_sort(F.collect_list(F.struct("place", "neighbour", "at"))).alias("near"))
    hashed = ranked(minority.withColumn("__h", shuffled(F.col("id"), seed)), ["repo_id"], [F.asc("__h"), F.asc("id")], rank="__rn")
    extra = F.when(F.col("__rn") <= F.col("lacking") % F.col("m"), 1).otherwise(0)
    placed = ranked(cut_lineage(hashed.withColumn("extra", extra).drop("__h", "__rn")), ["repo_id"], [F.asc("id")],
                    rank="place", running={"extras": F.col("extra")})
    each = F.floor(F.col("lacking") / F.col("m"))
    # Searched once: what follows reads the result.
    shares = cut_lineage(placed.withColumn("each", each).withColumn("copies", F.col("each") + F.col("extra")).where("copies > 0").join(listed, ["repo_id", "id"]))
    # A class of a few rows may need very many copies of each: blocks of copies are spread
    # over the cluster before they are unrolled.
    blocks = shares.withColumn(
        "first", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"), F.lit(COPIES_BLOCK).cast("bigint"))))
    drawn = _draw(F.col("id"), F.col("copy"), F.lit(f"{seed}n")) % F.col("k") + 1
    bases = (
        blocks.repartition("repo_id", "id", "first")
        .withColumn("copy", F.explode(F.sequence(
            F.col("first"), F.least(F.col("copies"), F.col("first") + (COPIES_BLOCK - 1)))))
        .withColumn("to", F.try_element_at("near", drawn.cast("int")))
        .withColumn("gap", _draw(F.col("id"), F.col("copy"), F.lit(f"{seed}g")) / F.lit(4294967296.0)))
    number = F.when(F.col("copy") <= F.col("each"), (F.col("copy") - 1) * F.col("m") + F.col("place")).otherwise(F.col("each") * F.col("m") + F.col("extras"))
    return bases.select(
        "repo_id", F.col("id").alias("base"), "copy", F.col("to.neighbour").alias("neighbour"), label,
        *[(F.col(c) + F.col("gap") * (F.col("to.at")[i] - F.col(c))).alias(c) for i, c in enumerate(cols)], number.alias("number"), "rows")


def smote(df: DataFrame, cols: Sequence[str], label: str = "is_buggy", k: int = NEIGHBOURS, seed: int = SEED,
          min_rows: int = SMOTE_MIN_ROWS, renumber: bool = False, **knn_limits) -> DataFrame:
    """Rows of both classes in equal numbers per repository: the originals and `synthetic_rows`.

    `renumber` gives balanced repositories fresh `file_id`s from 0 and `synthetic_<i>` paths,
    originals first; repositories left as they are keep theirs. Originals are numbered by
    id, synthetic rows by formula: only the originals are ever sorted.
    """
    facts = _few(smote_facts(df, k, min_rows, label))
    new = _synthetic(df, cols, facts, label, k, seed, knn_limits).withColumnRenamed("base", "id").drop("neighbour")
    kept = df.select("repo_id", "id", label, *[F.col(c).cast("double").alias(c) for c in cols],
                     *[c for c in ("filepath",) if c in df.columns]).withColumn("copy", F.lit(0).cast("bigint"))
    if not renumber:
        return kept.unionByName(new.drop("number", "rows"), allowMissingColumns=True)
    fresh = F.col("rows") + F.col("number") - 1
    new = new.withColumn("file_id", fresh).withColumn("filepath", F.concat(F.lit("synthetic_"), fresh.cast("string"))).drop("number", "rows")
    numbered = ranked(kept, ["repo_id"], [F.asc("id")], rank="__rn").join(facts.select("repo_id", F.lit(True).alias("__balanced")), "repo_id", "left")
    balanced, place = F.coalesce("__balanced", F.lit(False)), F.col("__rn") - 1
    old = numbered.withColumns({
        "file_id": F.when(balanced, place).otherwise(F.col("id")),
        "filepath": F.when(balanced, F.concat(F.lit("synthetic_"), place.cast("string"))).otherwise(F.col("filepath")),
    }).drop("__rn", "__balanced")
    return old.unionByName(new, allowMissingColumns=True)
