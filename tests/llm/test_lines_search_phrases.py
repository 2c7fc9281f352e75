"""Line dedup, lexical search and collocations against brute force, on edge rows and on empty tables."""

import collections
import hashlib
import math
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bladewatch.llm import collocations, lexical_search, line_dedup

WHITE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, keep string, keeper string, n_lines string, _ld_id string, head string"


@pytest.fixture(scope="module")
def rows():
    """Common lines in many documents, spans over partitions, nulls in any column, repeated rows and ids, long texts."""
    rng = random.Random(3)
    words = [f"{a}{b}" for a in ("ta", "ri", "né", "ke", "Lu") for b in ("n", "ra", "lo", "日")] + ["the", "of"] * 8
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) + rng.choice((".", ", ok", ";", "", "  "))
    shared = [line() for _ in range(12)] + ["A line that very many of the documents hold."]
    out = []
    for i in range(120):
        lines = [rng.choice(shared) if rng.random() < 0.4 else line() for _ in range(rng.randint(1, 12))]
        if i % 3:
            lines.append(f" \t{shared[-1].upper() if i % 2 else shared[-1]}\r")
        out.append((i, "\n".join(lines), rng.choice(("en", "fr", None, "x y"))))
    out += [out[5], out[5], (7, "another text of document 7\n" + shared[-1], "en"), (None, shared[-1] + "\n" + shared[0], "en"),
            (None, None, None), (200, "", "en"), (201, " \n\t\n", "en"), (202, None, "fr"), (203, "\n".join(shared) * 300, "en"),
            (204, "naïve Straße\x1cΣΑΣ 日本 the of \x00 of the tan", "en")]
    return [(i, t, lang, "a", "b", "c", "d", "e") for i, t, lang in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


def kept_lines(rows):
    """(id, number of lines, lines kept) of every row."""
    key = lambda x: x.strip(WHITE).translate(LOWER)
    holders = collections.defaultdict(set)
    for i, text, *_ in rows:
        for x in (text or "").split("\n"):
            if len(key(x)) >= 20:
                holders[key(x)].add(-1 << 63 if i is None else i)
    common = {k: max(ids) for k, ids in holders.items() if len(ids) >= 3}
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        yield i, len(lines), [x for x in lines if common.get(key(x), i) == i]


def test_lines_of_many_documents_go(docs, rows):
    got = collections.Counter(tuple(r) for r in line_dedup.line_digests(docs).select(
        "doc_id", "n_lines", "n_dropped", "kept_sha256").collect())
    want = collections.Counter(
        (i, n, n - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()) for i, n, kept in kept_lines(rows))
    assert got == want and sum(n for (_, _, n, _), _ in want.items()) > 200


@pytest.mark.parametrize("parts", [1, 64])
def test_a_line_may_span_partitions(spark, docs, rows, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = collections.Counter((r["doc_id"], r["n_dropped"]) for r in line_dedup.line_digests(docs).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == collections.Counter((i, n - len(kept)) for i, n, kept in kept_lines(rows))


def test_runs_cut_anywhere_give_the_same_lines():
    """The stream over every cut of one run into partitions and batches."""
    order = [(1, 1, 50, 0, 0), (1, 2, 9, 0, 1), (1, 2, 9, 0, 4), (1, 2, 7, 0, 0), (1, 2, 7, 1, 3), (1, 2, 3, 0, 2), (1, 2, 1, 0, 2),
             (2, 0, 8, 0, 0), (2, 0, 6, 0, 0), (3, 0, 4, 0, 1), (3, 0, 2, 0, 1), (3, 0, 1, 0, 1)]
    want = {r[2:] for r in order if r[:2] == (1, 2) and r[2] != 9 or r[0] == 3 and r[2] != 4}
    for a in range(1, len(order)):
        for b in range(a, len(order)):
            sure, open_, seen = set(), [], collections.defaultdict(set)
            for part in (order[:a], order[a:b], order[b:]):
                batches = [pa.RecordBatch.from_arrays([pa.array([v]) for v in (*x, 9)], line_dedup._LINE.names) for x in part]
                for out in line_dedup._runs(3)(iter(batches)):
                    for r in out.to_pylist():
                        key = (r["high"], r["low"])
                        if r["docs"] is not None:
                            seen[key] |= set(r["docs"])
                        elif r["edge"]:
                            open_.append((key, (r["doc"], r["digest"], r["at"])))
                        else:
                            sure.add((r["doc"], r["digest"], r["at"]))
            late = {x for key, x in open_ if len(seen[key]) >= 3 and x[0] != max(seen[key])}
            assert sure | late == want, (a, b)


def test_bitmaps_stand_for_lines(docs, rows):
    texts = {r["_ld_text"]: r for r in line_dedup.keep_bitmaps(docs).collect()}
    assert texts and all(len(line_dedup.kept_places(r["keep"], r["n_lines"])) == r["n_lines"] - r["n_dropped"] for r in texts.values())


def test_rows_without_common_lines_keep_their_columns(docs, rows):
    out = line_dedup.without_common_lines(docs)
    assert out.columns == docs.columns
    got = collections.Counter(tuple(r) for r in out.collect())
    assert got == collections.Counter(
        (i, None if r[1] is None else "\n".join(kept), *r[2:]) for r, (i, _, kept) in zip(rows, kept_lines(rows)))


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked(rows, items, top):
    found = [(i, collections.Counter(terms(t))) for i, t, *_ in rows]
    found = [(i, c) for i, c in found if c]
    n_docs, n_terms = len(found), sum(sum(c.values()) for _, c in found)
    df = collections.Counter(t for _, c in found for t in c)
    by_item = collections.defaultdict(set)
    for i, t, *_ in items:
        by_item[i] |= set(terms(t))
    for item, wanted in by_item.items():
        scores = []
        for i, c in found:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            scores.append((-sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in wanted if c[t]), i is None, i))
        yield from ((item, k, i, -s) for k, (s, _, i) in enumerate(sorted(x for x in scores if x[0])[:top], 1))


ITEMS = [(1, "the TAN of ri, riRA."), (2, "Straße ΣΑΣ"), (2, "日本 naïve"), (3, "not found at all"), (4, None), (5, ""), (None, "of the of"),
         (6, "tan"), (7, "the of"), (1, "the TAN of ri, riRA.")]


@pytest.mark.parametrize("block", [200_000, 3])
def test_ranked_search(spark, docs, rows, block):
    items = spark.createDataFrame([(*x, "clash") for x in ITEMS], "item_id long, text string, score string")
    got = [tuple(r) for r in lexical_search.search(docs, items, top=7, pairs_per_block=block).collect()]
    assert sorted(got, key=repr) == sorted(ranked(rows, ITEMS, 7), key=repr) and len(got) > 20


def test_overlapping_guards_count_every_term():
    machine = lexical_search.automaton(["a", "aa", "é"])
    found = [v for _, v in machine.iter(lexical_search.plain("A a aa-a é,éa É").decode("latin-1"))]
    assert sorted(found) == [0, 0, 0, 1, 2]


def mined(rows, longest, least, top):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, *words[i:i + m]) for m in range(1, longest + 1) for i in range(len(words) - m + 1))
    out = collections.defaultdict(list)
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    for (lang, *w), a in candidates.items():
        held = [b for (l2, *v), b in candidates.items() if l2 == lang and len(v) > len(w) and any(
            v[i:i + len(w)] == w for i in range(len(v) - len(w) + 1))]
        if any(100 * b >= 50 * a for b in held):
            continue
        cuts = [(10**6 * a * a // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k, f[(lang, *w[:k])], f[(lang, *w[k:])]) for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return {(lang, k, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items()
            for k, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)}


@pytest.mark.parametrize("longest,least,top", [(3, 10, 2000), (2, 4, 15), (4, 5, 2000)])
def test_collocations(docs, rows, longest, least, top):
    got = [tuple(r) for r in collocations.collocations(docs, longest, least, top).collect()]
    want = mined(rows, longest, least, top)
    assert len(got) == len(want) > 20 and set(got) == want


def test_hot_heads_change_no_count(docs, monkeypatch):
    want = {tuple(r) for r in collocations.phrase_counts(docs, 3, 5).collect()}
    monkeypatch.setattr(collocations, "frequent_words", lambda texts, least: None)  # no filter: every word counts as frequent
    assert {tuple(r) for r in collocations.phrase_counts(docs, 3, 5).collect()} == want
    monkeypatch.setattr(collocations, "HOT_SHARE", 1.0)
    assert {tuple(r) for r in collocations.phrase_counts(docs, 3, 5).collect()} == want
    monkeypatch.setattr(collocations, "HOT_SHARE", 1 / 50)
    monkeypatch.setattr(collocations, "CHUNK_CHARS", 50)
    assert {tuple(r) for r in collocations.phrase_counts(docs, 3, 5).collect()} == want


def test_products_beyond_64_bits(spark):
    frame = spark.createDataFrame([(9 * 10**14, 10**15 - 1, 10**15 - 1)], "a long, l long, r long")
    for c in "alr":
        frame = frame.withColumn(f"{c}_", collocations._exact(c))
    got = frame.select(F.expr("(a_ * a_ * 1000000BD) div (l_ * r_)")).first()[0]
    assert got == 10**6 * (9 * 10**14) ** 2 // (10**15 - 1) ** 2


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    blank = spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")
    assert line_dedup.line_digests(none).count() == 0 and line_dedup.without_common_lines(none).count() == 0
    assert lexical_search.search(none, items).count() == 0 and lexical_search.search(blank, items).count() == 0
    assert lexical_search.search(blank, items.limit(0)).count() == 0 and collocations.collocations(none).count() == 0
