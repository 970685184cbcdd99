"""Operators that look across rows: fingerprints, passages, packing, leaks, near copies, audits, URL classes, the pipeline."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from defectscope.llm import decontaminate, fixity, languages, packing, phrases, simhash, url_filters
from defectscope.llm.components import components
from defectscope.llm.queries import URL_RULES, WORD_TOKENIZER
from defectscope.llm.tables import running_total
from defectscope.llm.tokens import LibraryEncoder
from tests.llm.cases import documents, groups, leaks, odd_rows, prose, words


def test_fingerprints_of_neighbours(spark):
    rows = [r for r in odd_rows() if r[0] != 40] + [(500 + i, prose(i % 7, 40 + i), "en", "s") for i in range(40)]
    for bucket_rows in (4, 1000):
        found = phrases.fingerprint_neighbours(documents(spark, rows), bucket_rows=bucket_rows).collect()
        order = sorted([(i, t or "") for i, t, *_ in rows], key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
        want = []
        for (i, text), (_, following) in zip(order, [*order[1:], order[0]]):
            third = len(text) // 3
            new = text[:len(text) - third] + following[:third]
            own, changed, other = (phrases.fingerprints([t])[0] for t in (text, new, following))
            want.append((i, len(text), hashlib.sha256(new.encode()).hexdigest(), phrases.shown(own), phrases.shown(changed),
                         phrases.likeness(own, changed), phrases.likeness(own, other)))
        assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
    assert phrases.fingerprint_neighbours(documents(spark, rows).limit(0)).count() == 0
    one = phrases.fingerprint_neighbours(documents(spark, [(1, "abc def", "en", "s")])).collect()
    assert [r.near_next for r in one] == [1.0]


def test_likeness_follows_shared_text():
    text = prose(1, 400)
    same, moved, half, other = (phrases.fingerprints([t])[0] for t in (text, "new start " + text, text[:len(text) // 2], prose(2, 400)))
    assert phrases.likeness(same, same) == 1
    assert phrases.likeness(same, moved) > 0.85
    assert 0.3 < phrases.likeness(same, half) < 0.8
    assert phrases.likeness(same, other) < 0.1


def check_packing(rows, pieces, size):
    library = LibraryEncoder(WORD_TOKENIZER)
    want = Counter((i, tuple([*ids, 1])) for i, ids in zip([r[0] for r in rows], library.lists([r[1] or "" for r in rows])))
    rows_left = {}
    for r in sorted(pieces, key=lambda r: (repr(r.doc_id), r.start)):
        rows_left.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    got = Counter()
    for (i, n), parts in rows_left.items():
        assert sum(p.length for p in parts) % n == 0
        if sum(p.length for p in parts) == n:
            ids = []
            for p in parts:
                assert p.start == len(ids) and p.length * 4 == len(p.ids)
                ids += np.frombuffer(bytes(p.ids), "<u4").tolist()
            got[i, tuple(ids)] += 1
    repeated = {k for k in want if sum(c for (i, ids), c in want.items() if (i, len(ids)) == (k[0], len(k[1]))) > 1}
    assert {k: c for k, c in want.items() if k not in repeated} == got
    filled = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert sorted(filled) == list(range(len(filled)))
    assert all(filled[s] == size for s in range(len(filled) - 1)) and filled[len(filled) - 1] <= size
    assert sum(filled.values()) == sum(len(ids) * c for (_, ids), c in want.items())


@pytest.mark.parametrize("targets", [None, {"s0": 1.0, "s1": 5.0}])
def test_packing_places_each_id_once(spark, targets):
    rows = odd_rows() + [(1000 + i, prose(i, 20 + i % 90), "en", f"s{i % 5}") for i in range(150)]
    pieces = packing.pack(documents(spark, rows), WORD_TOKENIZER, sequence_tokens=256, window_sequences=4, targets=targets).collect()
    check_packing(rows, pieces, 256)
    assert packing.pack(documents(spark, rows).limit(0), WORD_TOKENIZER, targets=targets).count() == 0


def test_packing_keeps_proportions_in_every_window(spark):
    rows = [(i, prose(i, 50 + i % 40), "en", "big" if i % 4 else "small") for i in range(400)]
    source = {r[0]: r[3] for r in rows}

    def mix(**options):
        pieces = packing.pack(documents(spark, rows), WORD_TOKENIZER, sequence_tokens=128, window_sequences=4, **options).collect()
        table = pd.DataFrame([(r.sequence_id // 4, source[r.doc_id], r.length) for r in pieces], columns=["window", "source", "n"])
        return table.pivot_table(index="window", columns="source", values="n", aggfunc="sum", fill_value=0)

    table = mix()
    share = table["small"].sum() / table.to_numpy().sum()
    full = table.iloc[:-1]
    assert (abs(full["small"] - share * 512) <= 2).all()  # a token of rounding at either end of a window
    table = mix(targets={"small": 1, "big": 1})
    both = table[table["small"].cumsum() < table["small"].sum() - 512].iloc[:-1]
    assert len(both) > 10 and (abs(both["small"] - 256) <= 2).all()


def test_leaks_match_brute_force(spark):
    items = [(i, prose(700 + i, 8 + 3 * i)) for i in range(8)] + [(8, "Short one, here"), (9, None), (10, " . "), (11, prose(700, 8)), (None, prose(710, 14)), (8, "again short")]
    rows = odd_rows()
    for i in range(30):
        inside = words(items[i % 8][1])
        rows.append((500 + i, f"{prose(i, i)} {', '.join(inside[i % 4:]).upper()} {prose(i + 50, 9)} {' '.join(inside)}", "en", "s"))
    rows += [(600, "short ONE here", "en", "s"), (601, "short one", "en", "s"), (602, prose(710, 14), "en", "s"), (603, ("again short " * 9), "en", "s")]
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("size", F.lit(1)).withColumn("gram", F.lit("x"))
    docs = documents(spark, rows)
    found = decontaminate.find_leaks(docs, bench).collect()
    want = []
    for i, text, *_ in rows:
        hit, ids = leaks(text, items)
        want.append((i, len(words(text)), hit, len(ids), hashlib.sha256(",".join(sorted(set(ids))).encode()).hexdigest(), hit > 0))
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    clean = decontaminate.without_leaks(docs, bench)
    assert clean.schema == docs.schema
    assert Counter(map(repr, ((r.doc_id, r.text) for r in clean.collect()))) == Counter(repr((i, t)) for i, t, *_ in rows if not leaks(t, items)[0])
    for d, b in ((docs, bench.limit(0)), (docs.limit(0), bench), (docs.limit(0), bench.limit(0))):
        assert decontaminate.find_leaks(d, b).where("n_hit > 0").count() == 0
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == len(rows)


def test_bk_tree_finds_all_links():
    own = np.random.default_rng(2)
    centres = own.integers(0, 2**63, 40, dtype=np.uint64)
    values = np.unique(np.concatenate([c ^ np.bitwise_or.reduce(np.uint64(1) << own.integers(0, 64, (60, 3)).astype(np.uint64), axis=1) for c in centres]))
    pairs = {(int(q), int(v)) for a, b in simhash.BKTree(values).links(values, 4) for q, v in zip(a, b)}
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 4
    assert pairs == set(zip(*map(np.ndarray.tolist, np.nonzero(near))))


@pytest.mark.parametrize("shard", [4096, 16])
def test_linked_components_match_all_pairs(spark, shard):
    own = np.random.default_rng(3)
    centres = own.integers(0, 2**63, 30, dtype=np.uint64)
    flips = [np.bitwise_or.reduce(np.uint64(1) << own.integers(0, 64, 5).astype(np.uint64)) for _ in range(300)]
    values = np.unique(np.array([centres[k % 30] ^ f for k, f in enumerate(flips)] + [centres[0] ^ np.uint64(k) for k in range(64)] + [0, 2**63], np.uint64))
    frame = spark.createDataFrame(pd.DataFrame({"bits": values.view(np.int64)}))
    edges = simhash.linked(frame, len(values), shard=shard)
    found = {r.node: r.component for r in components(edges, "a", "b").collect()}
    want = groups(values.tolist(), lambda a, b: (a ^ b).bit_count() <= 4)
    label = [found.get(v, v) for v in values.view(np.int64).tolist()]
    assert len(set(zip(label, want))) == len(set(label)) == len(set(want))


def test_choice_of_blocks_keeps_all_links():
    for distinct in (0, 10**6, 10**9, 10**12):
        masks = simhash.choices(4, distinct)
        own = np.random.default_rng(1)
        for _ in range(300):
            flipped = sum(1 << int(b) for b in own.choice(64, 4, replace=False))
            assert any(flipped & m & (2**64 - 1) == 0 for m in masks)


def near_copies():
    rows = odd_rows()
    base = prose(800, 900).split()
    for i in range(25):
        copy = list(base)
        copy[i * 7] = "changed"
        rows.append((700 + i, " ".join(copy), "en", "s"))
    return rows + [(None, " ".join(base), "en", "s")]


def test_near_groups_match_all_pairs(spark):
    rows = near_copies()
    found = simhash.near_groups(documents(spark, rows)).collect()
    bits = [simhash.fingerprint_of(t or "", 4) for _, t, *_ in rows]
    label = groups(bits, lambda a, b: (a ^ b).bit_count() <= 4)
    first = {g: min((r[0] for r, own in zip(rows, label) if own == g and r[0] is not None), default=None) for g in set(label)}
    want = [(r[0], f"{b:016x}", first[g]) for r, b, g in zip(rows, bits, label)]
    assert sorted([(r.doc_id, r.fingerprint, r.component_id) for r in found], key=repr) == sorted(want, key=repr)
    kept = simhash.one_of_each_group(documents(spark, rows))
    assert kept.schema == documents(spark, rows).schema
    stays = {g: min(((r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).digest()), r[:2]) for r, own in zip(rows, label) if own == g)[1] for g in set(label)}
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=repr) == sorted(stays.values(), key=repr)
    assert simhash.near_groups(documents(spark, rows).limit(0)).count() == 0


def test_near_copies_of_likeness_are_one_group(spark):
    """Pairs with single words changed, from just below to far above 0.8, and a chain of them."""
    own = np.random.default_rng(9)
    rows, near = [(10_000, None, "en", "s"), (10_001, " ", "en", "s")], []
    for k in range(60):
        base = prose(3000 + k, 200 + 5 * k).split()
        copy = list(base)
        for at in own.choice(len(base), max(1, int(len(base) * (0.005 + 0.0006 * k))), replace=False):
            copy[at] = "changed"
        a, b = ({tuple(t[i:i + 5]) for i in range(len(t) - 4)} for t in (base, copy))
        near.append(5 * len(a & b) >= 4 * len(a | b))
        rows += [(2 * k, " ".join(base), "en", "s"), (2 * k + 1, " ".join(copy).upper(), "en", "s")]
    chain = prose(4000, 300).split()
    for k in range(30):
        chain = chain[8:] + prose(4100 + k, 8).split()
        rows.append((5000 + k, " ".join(chain), "en", "s"))
    assert 20 < sum(near) < 55
    kept = {r.doc_id for r in simhash.one_of_each_group(documents(spark, rows), grouped=simhash.like_groups).collect()}
    want = {2 * k for k in range(60)} | {2 * k + 1 for k in range(60) if not near[k]} | {5000, 10_000}
    assert kept == want


def test_fingerprint_by_its_definition():
    import xxhash

    for text in ("", "One", "a b c d e", prose(3, 200), "É\tx\x0by\x0cz\r\nÄ ß"):
        own = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if w]
        shingles = [" ".join(own[i:i + 4]) for i in range(max(1, len(own) - 3))] if own else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if own else 0
        assert simhash.fingerprint_of(text, 4) == want


def test_components(spark):
    own = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in own.integers(0, 400, (250, 2))] + [(k, k + 1) for k in range(1000, 1100)] + [(2000, k) for k in range(2001, 2200)] + [(5, 5), (None, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(pairs, "x bigint, y bigint"), "x", "y").collect()}
    parent = {n: n for p in pairs for n in p if n is not None}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        if a is not None and a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    linked = {n for a, b in pairs if a is not None and a != b for n in (a, b)}
    assert found == {n: root(n) for n in linked}
    assert components(spark.createDataFrame([], "x string, y string"), "x", "y").count() == 0


def test_components_of_few_edges_fill_few_files(spark):
    """With a part for each shuffle partition, rounds over few edges would write mostly files."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = components(spark.createDataFrame([(k, k + 1) for k in range(0, 400, 2)] + [(1, 2)], "x bigint, y bigint"), "x", "y")
        assert len(found.inputFiles()) == 1
        assert found.count() == 400 and found.agg(F.sum("component")).first()[0] == sum(range(4, 400, 2)) * 2
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_running_total(spark):
    frame = spark.range(0, 5000, 1, 7).select(F.pmod(F.xxhash64("id"), F.lit(100)).alias("k"), "id", (F.col("id") % 13).alias("n"))
    rows = sorted(running_total(frame, [F.col("k"), F.col("id")], "n", "at").collect(), key=lambda r: (r.k, r.id))
    assert [r["at"] for r in rows] == np.cumsum([0, *(r.n for r in rows[:-1])]).tolist()


def archive(spark, rows):
    return spark.createDataFrame(rows, "record_id bigint, offset bigint, length bigint, digest string")


def test_audit_locates_all_damage(spark):
    rows = [(i, i * 700, 700, f"d{i}") for i in range(3000)] + [(None, 2_100_000, 5, "x"), (7, 7 * 700, 700, "d7"), (9, None, 1, "y")]
    bad = [r for r in rows if r[0] != 1234]
    bad = [(i, o, n, "bad") if i in (5, 6, 2999) else (i, o, n, d) for i, o, n, d in bad] + [(5000, 10, 1, "z"), (None, None, None, None)]
    bad[2] = (2, 2 * 700, None, "d2")
    for size, fanout in ((1 << 12, 2), (1 << 20, 16)):
        found = fixity.audit(archive(spark, rows), archive(spark, bad), range_bytes=size, fanout=fanout).collect()
        assert {(r.record_id, r.status) for r in found} == {(1234, "missing"), (5, "changed"), (6, "changed"), (2999, "changed"), (5000, "extra"), (2, "changed")}
    assert fixity.audit(archive(spark, rows), archive(spark, rows[::-1])).count() == 0
    # A copy lost among repeated rows is a difference too.
    assert [r.record_id for r in fixity.audit(archive(spark, rows), archive(spark, [r for k, r in enumerate(rows) if k != 3001])).collect()] == [7]
    empty = archive(spark, [])
    assert fixity.audit(empty, empty).count() == 0
    assert fixity.audit(archive(spark, rows[:5]), empty).where("status = 'missing'").count() == 5


def test_listing_offsets(spark):
    rows = [(3, "http://a/b", "<p>é</p>"), (1, None, "x"), (2, "u", None), (None, None, None), (2, "u", None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit(1)).withColumn("length", F.lit(2))
    found = sorted(fixity.listing(pages).collect(), key=lambda r: r.offset)
    assert [r.record_id for r in found] == [None, 1, 2, 2, 3]
    assert [r.offset for r in found] == np.cumsum([0, *(r.length for r in found[:-1])]).tolist()


def test_url_verdicts(spark):
    link = '<LINK rel="canonical" HREF="{}">'
    rows = [
        (1, "http://Sub.Example.ORG/es/1?q#f", ""), (2, "https://example.org/en/1", None), (3, "https://example.org/en/2", None), (4, "https://notexample.org", ""),
        (5, "http://x.com/fr/a", ""), (6, "http://x.com/de/a", ""), (7, "x.com/de/", ""), (8, None, None), (9, "://com/de/", ""), (10, "ftp://com?/de/", ""),
        # aliases: 11 -> 6 blocked; 12 -> 11 by redirect; 13 allowed by its rule; 14 -> 3, which is allowed
        (11, "http://alias.net/1#top", f"<head>{link.format('http://x.com/de/a#x')}</head>"),
        (12, "http://alias.net/2", '<meta http-equiv="refresh" content="0; url=/1">'),
        (13, "http://good.org/x", link.format("http://alias.net/1")), (14, "http://alias.net/3", link.format("//example.org/en/2")),
        (15, "http://alias.net/4/a", link.format("b")), (16, "http://alias.net/5", link.format("")), (11, "http://alias.net/1#top", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("key", F.lit(1)).withColumn("host", F.lit("h")).withColumn("node", F.lit(1))
    extra = spark.createDataFrame([("http://alias.net/4/b", "http://com/de/z")], "from_url string, to_url string")
    found = {r.page_id: r for r in url_filters.judge(pages, URL_RULES, redirects=extra).collect()}
    assert url_filters.judge(pages, URL_RULES, redirects=extra).count() == len(rows)
    assert {i: (r.host, r.path, r.rule) for i, r in found.items() if i <= 10} == {
        1: ("sub.example.org", "/es/1", "example.org/es/"), 2: ("example.org", "/en/1", "example.org/en/1"), 3: ("example.org", "/en/2", "org/"),
        4: ("notexample.org", "", None), 5: ("x.com", "/fr/a", "com/fr/"), 6: ("x.com", "/de/a", "com/de/"), 7: ("", "", None), 8: ("", "", None),
        9: ("com", "/de/", "com/de/"), 10: ("com", "", None)}
    verdicts = {i: r.verdict for i, r in found.items()}
    assert verdicts == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "block", 7: "allow", 8: "allow", 9: "block", 10: "allow",
                        11: "block", 12: "block", 13: "allow", 14: "allow", 15: "block", 16: "allow"}
    assert url_filters.judge(pages.limit(0), URL_RULES).count() == 0


def test_native_operators_run_no_python(spark):
    docs, bench = documents(spark, odd_rows()), spark.createDataFrame([(1, prose(3, 20))], "item_id bigint, text string")
    pages = spark.createDataFrame([(1, "http://a.com/de/", "")], "page_id bigint, url string, html string")
    for frame in (decontaminate.find_leaks(docs, bench), url_filters.judge(pages, URL_RULES)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_pipeline_stages(spark, tmp_path):
    items = [(1, prose(900, 30))]
    rows = near_copies() + [(1000 + i, prose(i, 50), "en", "s0") for i in range(30)] + [
        (2000, prose(71, 30) + " " + prose(900, 30), "en", "s1"), (2001, prose(72, 60) + " password=abcdefgh12345", "en", "s1")]
    docs = documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "secret_scan", "packing"]
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES[:4]:
        tables.append(stage(spark, tables[-1], str(tmp_path)).cache())
        assert tables[-1].schema == docs.schema
    known, single, clean, safe = ([(r.doc_id, r.text) for r in t.collect()] for t in tables[1:])
    nothing = [(r[0], r[1]) for r in rows if not any(c.isalpha() for c in r[1] or "")]
    network = languages.fit(docs)
    unsure = languages.identify(docs, network).where(f"score < {languages.MIN_SCORE}").count()
    assert len(known) == len(rows) - unsure and not {repr(x) for x in nothing} & {repr(x) for x in known}
    sets = [{tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for _, t in known]
    label = groups(sets, lambda a, b: 5 * len(a & b) >= 4 * len(a | b))
    stays = {g: min(((i is None, i or 0, hashlib.md5((t or "").encode()).digest()), (i, t)) for (i, t), own in zip(known, label) if own == g)[1] for g in set(label)}
    assert sorted(single, key=repr) == sorted(stays.values(), key=repr)
    assert sorted(clean, key=repr) == sorted([(i, t) for i, t in single if not leaks(t, items)[0]], key=repr)
    assert (2000 not in [i for i, _ in clean]) and (2000 in [i for i, _ in single])
    assert dict(safe)[2001] == prose(72, 60) + " [secret]" and [t for i, t in safe if i != 2001].sort() == [t for i, t in clean if i != 2001].sort()
    pieces = corpus_pipeline.packed(spark, tables[-1], str(tmp_path)).collect()
    check_packing([(i, t) for i, t in safe], pieces, 2048)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sum(r.length for r in whole.collect()) == sum(p.length for p in pieces)
    assert zlib.crc32(bytes(pieces[0].ids)) == [r.c for r in whole.select(F.crc32("ids").alias("c"), "doc_id", "start").where(
        (F.col("doc_id") == pieces[0].doc_id) & (F.col("start") == pieces[0].start)).collect()][0]


def test_pipeline_on_empty_tables(spark, tmp_path):
    docs = documents(spark, odd_rows()).select("doc_id", "text", "lang", "source", "n_chars").limit(0)
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
