"""Repeated passages by content-defined chunks, against all pairs of documents."""

import re

import numpy as np
from pyspark.sql import functions as F

from defectscope.llm import chunks
from tests.llm.cases import documents, odd_rows, prose

SURE = 50


def stretches(a, b, least):
    """(start, end) in a of the longest runs of whole words, with all between them, that b has too."""
    words = [m.span() for m in re.finditer(r"[^\x20\x09-\x0d]+", a)]
    out, i = [], 0
    while i + least <= len(words):
        if a[words[i][0]:words[i + least - 1][1]] not in b:
            i += 1
            continue
        j = i + least - 1
        while j + 1 < len(words) and a[words[i][0]:words[j + 1][1]] in b:
            j += 1
        out.append((words[i][0], words[j][1]))
        i += 1
    return out


def check(rows, found):
    """All stretches of SURE words are covered; what is found is in its owners, of the length that is said."""
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(i, []).append(t or "")
    spans = {}
    for r in found:
        spans.setdefault(r.doc_id, []).append(r)
    for i, own in texts.items():
        for text in own:
            if len(text) > 20_000:
                continue  # long texts are looked at by what is found in them
            for o, others in texts.items():
                if o is None or (i is not None and o >= i):
                    continue
                for other in others:
                    if len(other) > 20_000:
                        continue
                    for start, end in stretches(text, other, SURE):
                        # A document that is not the owner may share a word more at either end by chance.
                        inner = [start + m.start() for m in re.finditer(r"[^\x20\x09-\x0d]+", text[start:end])]
                        assert any(r.start <= inner[2] and inner[-2] <= r.end for r in spans.get(i, [])), (i, o, start, end, spans.get(i))
    for i, own in spans.items():
        for r in own:
            assert any(len(t[r.start:r.end].split()) == r.n_words >= chunks.MIN_WORDS for t in texts[i])
            if len(r.kept_doc_ids) == 1:
                assert i is None or r.kept_doc_ids[0] < i
                pieces = [t[r.start:r.end] for t in texts[i]]
                assert any(p in t for p in pieces for t in texts[r.kept_doc_ids[0]])


def test_repeated_passages_match_all_pairs(spark):
    own = np.random.default_rng(8)
    rows = odd_rows()
    for k in range(60):
        passage = prose(7000 + k, SURE + k % 9) if k < 40 else " ".join([prose(7000 + k, (4, 8, 12)[k % 3])] * 30)
        before, after = own.integers(0, 90, (2, 2))
        rows.append((1000 + k, f"{prose(8000 + k, before[0])} {passage} {prose(8300 + k, after[0])}", "en", "s"))
        rows.append((2000 + k, f"{prose(8600 + k, before[1])}\n{passage}\t{prose(8900 + k, after[1])}", "en", "s"))
        if k < 12:  # smaller documents with the halves, and one more with all
            w = passage.split()
            rows += [(100 + 2 * k, f"{prose(9200 + k, 9)} {' '.join(w[:25])} {prose(9300 + k, 9)}", "en", "s"),
                     (101 + 2 * k, f"{prose(9400 + k, 9)} {' '.join(w[25:50])} {prose(9500 + k, 9)}", "en", "s"), (3000 + k, passage, "en", "s")]
    rows += [(4000 + k, f"{prose(5000 + k, 30)} {prose(6000, 60)} {prose(5500 + k, 10)}", "en", "s") for k in range(60)]  # a very common one
    rows += [(5000, "same words here " * 50, "en", "s"), (None, prose(7000, 50), None, None), (2000, prose(7001, 50), "en", "s"), (6000, prose(93, 30_000)[5000:90_000], "en", "s")]
    docs = documents(spark, rows)
    found = chunks.repeated_passages(docs).collect()
    check(rows, found)
    by = {r.doc_id: r for r in found if r.doc_id is not None and 2000 <= r.doc_id < 2060}
    assert set(by) >= {2000 + k for k in range(1, 60)}
    assert [by[2000 + k].kept_doc_ids for k in range(12, 60)] == [[1000 + k] for k in range(12, 60)]
    assert not {r.doc_id for r in found} & ({1000 + k for k in range(12, 60)} | {5000, 4000, 40, 41, 43, 44})
    assert chunks.repeated_passages(docs.limit(0)).count() == 0
    cut = [(r.doc_id, r.text) for r in chunks.without_repeats(docs).collect()]
    assert len(cut) == len(rows)
    assert [(r.start, r.end, r.kept_doc_ids) for r in found if r.doc_id == 6000] == [(r.start, r.end, [40]) for r in found if r.doc_id == 6000 and r.n_words > 13_000]
    left = {i: t for i, t in cut if i is not None and 2012 <= i < 2060}
    for i, t in left.items():
        text = dict((r[0], r[1]) for r in rows)[i]
        assert t == text[:by[i].start] + text[by[i].end:]
    assert {i: t for i, t in cut if i in (40, 41, 43, 22)} == {i: t for i, t, *_ in rows if i in (40, 41, 43, 22)}


def test_the_shorter_text_of_a_pair_is_sent(spark):
    """Each two texts meet once, where the longer one lies."""
    rows = [(1, 9, b"a", b"b", 10, 700), (2, 9, b"a", b"b", 10, 700), (3, 9, b"c", b"b", 900, 700), (4, 9, b"b", b"b", 700, 700)]
    pairs = spark.createDataFrame(rows, "row bigint, owner_row bigint, text_md5 binary, owner_md5 binary, reach int, owner_reach int")
    found = {(bytes(r.text_md5), bytes(r.owner_md5), r.row, r.owner_row, bytes(r.sent_md5), bytes(r.home_md5)) for r in chunks.meetings(pairs).collect()}
    assert found == {(b"a", b"b", 1, 9, b"a", b"b"), (b"c", b"b", 3, 9, b"b", b"c"), (b"b", b"b", 4, 9, b"b", b"b")}


def test_text_ids_and_true_ends(spark):
    passage = prose(1, 70)
    rows = [("b", f"x{passage} end"), ("c", f"start {passage}y"), ("a", "nothing here"), (None, passage), ("c", f"start {passage}y")]
    found = {(r.doc_id, r.start, r.end, r.n_words, tuple(r.kept_doc_ids)) for r in chunks.repeated_passages(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    # The first word of b and the last one of c are other words; the text without an id has all but one from either.
    inner = passage[passage.index(" ") + 1:]
    core = inner[:inner.rindex(" ")]
    assert ("c", 6 + passage.index(" ") + 1, 6 + passage.index(" ") + 1 + len(core), 68, ("b",)) in found and len(found) == 2
    # By b alone from its second word on, or by c as well.
    assert found & {(None, passage.index(" ") + 1, len(passage), 69, ("b",)), (None, 0, len(passage), 70, ("b", "c"))}


def test_chunks_partition_the_words():
    for text in (prose(1, 3000), "a " * 500, "one", " two  words\n", "é" * 4000, ""):
        points = chunks.code_points(text)
        found = chunks.chunks_of(points)
        words = [m.span() for m in re.finditer(r"[^\x20\x09-\x0d]+", text)]
        assert [w for a, b, _ in found for w in words if a <= w[0] and w[1] <= b] == words
        assert all(a < b <= c for a, b, c in found) and [f[0] for f in found] == sorted({f[0] for f in found})
        assert all(len(text[a:b].split()) <= chunks.WINDOW for a, b, _ in found)
        assert all(len(text[a:c].split()) >= chunks.DIGEST_WORDS or c == words[-1][1] for a, _, c in found)


def test_cuts_do_not_shift_with_insertions():
    text = prose(1, 3000)
    one, two = (chunks.cuts(chunks.code_points(t)) for t in (text, "seven more words than there were before " + text))
    assert len(np.intersect1d(one, two - 7)) > 0.99 * len(one)
    words = text.split()
    middle = chunks.cuts(chunks.code_points(" ".join([*words[:1500], "put", "in", *words[1500:]])))
    same = set(one[one < 1450]) | set(one[one > 1550] + 2)
    assert same <= set(middle)


def test_any_48_words_hold_a_whole_chunk():
    """At any offset, also of one-letter words and of lines that repeat."""
    own = np.random.default_rng(4)
    for k in range(300):
        kind = k % 4
        if kind == 0:
            passage = " ".join(own.choice(list("abcdefg"), 48))
        elif kind == 1:
            passage = " ".join(([*prose(6000 + k, 4 + k % 11).split()] * 48)[:48])
        else:
            passage = prose(6000 + k, 48)
        digests = []
        for n in (0, 1):
            text = f"{prose(6300 + 2 * k + n, 3 + 7 * n + k % 13)} {passage} {prose(7000 + 2 * k + n, 20)}"
            at = text.index(passage)
            digests.append({text[a:c] for a, b, c in chunks.chunks_of(chunks.code_points(text)) if at <= a and c <= at + len(passage)})
        assert digests[0] & digests[1], k
