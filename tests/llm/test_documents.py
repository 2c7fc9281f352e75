"""Operators on documents against brute force, on edge rows and on empty tables."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bladewatch.llm import license_scan, mixing, ngram_join, packing, sentence_spans, suffixes, weak_rules
from bladewatch.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_quality_measures(edges, edge_rows):
    got = collections.Counter(tuple(r) for r in weak_rules.quality(edges).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    want = collections.Counter()
    for i, text, *_ in edge_rows:
        words = WORD.findall(text or "")
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        windows = collections.Counter(tuple(words[k:k + 3]) for k in range(len(words) - 2))
        covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k:k + 3])] > 1 for j in range(3)}
        n = len(words)
        want[(i, n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
              len(covered), n < 50 or 100 * len(covered) > 50 * n)] += 1
    assert got == want


def test_quality_verdicts_follow_the_posterior(edges):
    rows = {r["doc_id"]: r for r in weak_rules.quality(edges).collect()}
    assert rows[1]["kept"] and rows[8]["kept"] and not rows[10]["kept"] and not rows[4]["kept"]
    assert not any(r["kept"] and r["base_failed"] for r in rows.values())


def test_accuracies_are_found(spark):
    """Votes drawn from known accuracies: the estimate comes near them, and a rule that always agrees weighs nothing."""
    rng = np.random.default_rng(5)
    good = rng.random(20_000) < 0.7
    right = {"a": 0.95, "b": 0.85, "c": 0.75}
    votes = {r: np.where(rng.random(len(good)) < p, good, ~good) * 2 - 1 for r, p in right.items()}
    votes["always"] = np.ones(len(good), int)
    counts = collections.Counter(zip(*votes.values()))
    frame = spark.createDataFrame(
        [(*map(int, k), n) for k, n in counts.items()], ", ".join(f"_v_{r} int" for r in votes) + ", _n long")
    accuracy, prior = weak_rules.estimate(frame, rounds=60)
    assert abs(prior - 0.7) < 0.05
    assert all(abs(accuracy[r][k] - p) < 0.06 for r, p in right.items() for k in (0, 1))
    assert accuracy["always"] == (0.95, 0.05)


def test_documents_that_rules_keep_have_their_columns(edges, no_docs):
    out = weak_rules.kept_documents(edges)
    assert out.columns == edges.columns and out.filter("doc_id = 1").count() == 1
    assert weak_rules.kept_documents(no_docs).count() == 0 and weak_rules.quality(no_docs).count() == 0


def expected_mix(sizes):
    """Water-filling by resharing the excess round after round."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, target, capped = sum(sizes.values()), {}, set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        target = {s: 3 * sizes[s] if s in capped else left * weight[s] / sum(weight[f] for f in free) for s in names}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


def test_mix_targets_and_budgets(edges, edge_rows, no_docs):
    rows = mixing.mix(edges).collect()
    assert len(rows) == len(edge_rows) and mixing.mix(no_docs).count() == 0
    sizes, taken = collections.Counter(), collections.Counter()
    for r in rows:
        assert r["size"] == len(WORD.findall(r["text"] or "")) and 0 <= r["taken"] <= 3 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    want = expected_mix(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
    assert all(abs(taken[s] - want[s]) <= 2 for s in sizes)  # a repeated row at the edge may lose a word


def test_mix_is_the_same_for_any_partitioning(edges):
    def seen(df):
        return collections.Counter((r["doc_id"], r["taken"]) for r in mixing.mix(df).collect())

    assert seen(edges) == seen(edges.repartition(7, "source"))


def test_mixed_rows_hold_what_was_taken(edges):
    taken = collections.Counter()
    for r in mixing.mix(edges).collect():
        taken[r["doc_id"]] += r["taken"]
    out = mixing.mixed_rows(edges)
    assert out.columns == edges.columns
    held = collections.Counter()
    for r in out.collect():
        held[r["doc_id"]] += len(WORD.findall(r["text"] or ""))
    assert +held == +taken


def shingle_set(text, n):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[k:k + n]) for k in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


def component_of(sets, share):
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            both = len(sets[x] & sets[y])
            if x < y and sets[x] and sets[y] and 100 * both >= share * (len(sets[x]) + len(sets[y]) - both):
                a, b = root(x), root(y)
                label[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_jaccard_components(edges, edge_rows, no_docs):
    sets = {i: shingle_set(t, 4) for i, t, *_ in edge_rows if i is not None}
    want = component_of(sets, 85)
    rows = ngram_join.jaccard_components(edges).collect()
    assert len(rows) == len(edge_rows)
    for r in rows:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]])
    assert ngram_join.jaccard_components(no_docs).count() == 0


@pytest.mark.parametrize("crowded,cell_rows", [(2, 7), (4, 1000), (10**9, 1000)])
def test_jaccard_in_a_crowded_block(spark, monkeypatch, crowded, cell_rows):
    """Copies with a few changed words each, most of which link only through others, and strangers among them."""
    import random

    from conftest import prose

    rng, base, rows = random.Random(3), prose(120, 7).split(), []
    for i in range(60):
        words = list(base)
        for at in rng.sample(range(len(words)), rng.choice((1, 2, 3, 4))):
            words[at] = f"w{i}x{at}"
        rows.append((i * 3 + 1, " ".join(words)))
    rows += [(1000 + i, prose(120, 50 + i)) for i in range(20)]
    monkeypatch.setattr(ngram_join, "CROWDED", crowded)
    monkeypatch.setattr(ngram_join, "CELL_ROWS", cell_rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = component_of({i: shingle_set(t, 4) for i, t in rows}, 85)
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(df).collect()} == want


def test_overlaps_and_spanning_links():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40))) for _ in range(40)] + [np.arange(30)] * 30
    got = ngram_join.overlaps(sets[:25], sets[10:])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[10:]] for a in sets[:25]]
    linked = rng.random((50, 50)) < 0.03
    linked |= linked.T
    links = ngram_join.spanning_links(linked)
    want = component_of_links(range(50), zip(*np.nonzero(linked)))
    assert component_of_links(range(50), links) == want and len(links) == 50 - len(set(want.values()))


def component_of_links(nodes, links):
    root = {n: n for n in nodes}
    for _ in range(len(root)):
        for a, b in (links := list(links)):
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_equal_ids_with_other_texts_are_judged_by_their_own(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(14)) for c in "ab")
    rows = [(1, a), (5, f"{a} more"), (5, b), (7, f"{b} more"), (9, "alone in the world with these words"), (9, b)]
    df = spark.createDataFrame([(i, t, "own", 3) for i, t in rows], "doc_id long, text string, mark string, cls int")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(df).collect())
    assert got == [(1, 11, 1), (5, 11, 5), (5, 12, 1), (7, 12, 5), (9, 4, 9), (9, 11, 5)]
    kept = ngram_join.one_per_component(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted([rows[0], rows[2], rows[4]])


def test_one_document_of_each_component_stays(edges):
    out = ngram_join.one_per_component(edges, words=5, threshold=80)
    assert out.columns == edges.columns
    ids = sorted((r["doc_id"] for r in out.collect()), key=lambda i: (i is None, i))
    assert ids == [1, 4, 5, 6, 7, 8, 9, 10, 11, 13, 14, 15, None]


def test_columns_met_again_are_dealt_out_once(spark, monkeypatch):
    """Blocks are written once and columns shuffled once, packed; those of several rows come out with all their rows."""
    rng, labels, saved = np.random.default_rng(4), [], ngram_join.saved
    tokens = [np.r_[rng.integers(-2**63, 2**63 - 1, 30), np.arange(k % 5) << 40] for k in range(40)]
    rows = [(k + (k % 3 << 33), len(t), (t >> 24).astype(">i8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()) for k, t in enumerate(tokens)]
    df = spark.createDataFrame(rows, "cls long, n long, block binary").repartition(3)
    monkeypatch.setattr(ngram_join, "PACKED", 100)
    got = collections.Counter((r["token"], r["cls"], r["n"], r["m"]) for r in ngram_join.shared_columns(df, 1000).collect())
    assert got == collections.Counter((k << 16, c, n, 8 * (4 - k)) for c, n, _ in rows for k in range((n - 30)))
    monkeypatch.setattr(ngram_join, "saved", lambda df, label: labels.append((label, dict(df.dtypes))) or saved(df, label))
    ngram_join.jaccard_components(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f g")], "doc_id long, text string"))
    assert [label for label, kinds in labels if "block" in kinds] == ["ngram-blocks"] and dict(labels)["ngram-blocks"]["block"] == "binary"


def test_texts_that_no_pair_needs_are_not_shuffled(spark, edges, monkeypatch):
    """Above the number of ids that may be broadcast, a filter is, and the rows are the same."""
    from conftest import prose

    rows = [(i, prose(80, i // 2 if i < 20 else i) + f" end{i}") for i in range(300)] + [(5, prose(80, 2) + " end5"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    base = ngram_join._texts(df, "doc_id", "text")
    needed = ngram_join.saved(base.filter("doc_id < 12").select("doc_id", "mark").distinct(), "needed")
    want = [sorted(map(str, f(x).collect())) for f, x in ((ngram_join.jaccard_components, df), (ngram_join.one_per_component, edges))]
    monkeypatch.setattr(ngram_join, "NEEDED_IDS", 1)
    assert [sorted(map(str, f(x).collect())) for f, x in ((ngram_join.jaccard_components, df), (ngram_join.one_per_component, edges))] == want
    seen = spark.sparkContext.accumulator(0)
    mark = F.udf(lambda t: (seen.add(1), t)[1], "string").asNondeterministic()
    picked = ngram_join._picked(base, needed).withColumn("text", mark("text"))
    assert picked.count() == 13 and seen.value <= 13
    few = ngram_join._maybe(base, needed, ["doc_id", "mark"], "maybe").groupBy("maybe").count().collect()
    assert {r["maybe"]: r["count"] for r in few} == {True: 13, False: 289}


def brute_removals(docs, run=2, least=100, long_words=50):
    """(id, text) -> (places of sentences that go, first ids), by the definition of spans over plain strings."""
    breaks = re.compile(r"(?<=[.!?])[\x20\x09-\x0D]+|[\x20\x09\x0D]*\n[\x20\x09-\x0D]*")
    places = collections.defaultdict(list)
    for i, text in sorted(set(docs)):
        said = breaks.split(text.strip(" \t\n\x0b\x0c\r"))
        size = lambda a, b: len(" ".join(said[a:b]))
        found = set()
        for k in range(len(said)):
            found.update([(k, next((e for e in range(k + run, len(said) + 1) if size(k, e) >= least), None))])
            found.update([(next((a for a in range(k + 1 - run, -1, -1) if size(a, k + 1) >= least), None), k + 1)])
            if len(WORD.findall(said[k])) >= long_words:
                found.add((k, k + 1))
        for a, e in found:
            if a is not None and e is not None:
                places[tuple(said[a:e])].append((i, text, a, e))
    out = collections.defaultdict(lambda: (set(), set()))
    for found in places.values():
        first, *others = sorted(found)
        for i, text, a, e in others:
            out[i, text][0].update(range(a, e))
            out[i, text][1].add(first[0])
    return {k: (sorted(a), sorted(b)) for k, (a, b) in out.items()}


def test_sentence_spans_against_brute_force(spark):
    rng = random.Random(12)
    pool = [" ".join(rng.choice(("ab", "cde", "fghi", "é")) for _ in range(rng.randint(1, 12))) + rng.choice((".", "!", "?"))
            for _ in range(25)] + [" ".join(["long"] * 50) + ".", " ".join(["long"] * 49) + "."]
    docs = []
    for i in range(120):
        said = []
        while len(said) < rng.randint(1, 14):
            at = rng.randrange(len(pool))
            said += pool[at:at + rng.randint(1, 4)] if rng.random() < 0.5 else [f"own {i} {len(said)} {rng.random()}."]
        docs.append((i, rng.choice(("", " ", "\n")) + "".join(x + rng.choice((" ", "  ", "\n", " \n\t")) for x in said)))
    docs.append(docs[7])
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["removed"], r["first_docs"]) for r in sentence_spans.repeated_passages(df).collect()}
    want = {i: v for (i, _), v in brute_removals(docs).items()}
    assert got == want and len(want) > 20


def test_sentence_spans(edges, no_docs):
    rows = {r["doc_id"]: r for r in sentence_spans.repeated_passages(edges).collect()}
    assert rows[2]["first_docs"] == [1] and 1 in rows[3]["first_docs"]
    assert rows[9]["n_removed"] >= 5 and rows[9]["first_docs"] == [8] and 8 not in rows and 7 not in rows
    assert sentence_spans.repeated_passages(no_docs).count() == 0


def test_texts_without_repeats(edges, edge_rows):
    out = sentence_spans.without_repeats(edges)
    assert out.columns == edges.columns
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    before = {r[0]: r[1] for r in edge_rows}
    assert 2 not in texts and all(texts[i] == before[i] for i in (1, 4, 5, 6, 7, 8, 11))
    assert before[9].startswith(texts[9]) and 100 < len(texts[9].split()) < 160


def test_long_sentences_and_runs_of_short_ones(spark):
    """A passage that is one long sentence, and passages of lines too short for two of them to count, lose all of them."""
    lone = " ".join(f"w{k}" for k in range(55)) + "."
    lines = [f"line {k} x{k}." for k in range(20)]
    mixed = ["A first sentence of the passage that is long enough to count with any other one.", "So.", "No.", "Yes."]
    rows = [(1, f"Start one. {lone} End one."), (2, f"Start two. {lone} End two."),
            (3, "\n".join(["top three", *lines, "tail three"])), (4, "\n".join(["top four", *lines, "tail four"])),
            (5, " ".join(["Five begins.", *mixed, "Five ends."])), (6, " ".join(["Six begins.", *mixed, "Six ends."]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["removed"], r["first_docs"]) for r in sentence_spans.repeated_passages(df).collect()}
    assert got == {2: ([1], [1]), 4: (list(range(1, 21)), [3]), 6: ([1, 2, 3, 4], [5])}


def exact_repeats(rows, n=50):
    places = collections.defaultdict(set)
    for i, text in rows:
        words = (text or "").encode().split()
        for k in range(len(words) - n + 1):
            places[tuple(words[k:k + n])].add((i, k))
    out = collections.defaultdict(set)
    for found in places.values():
        if len(found) > 1:
            for i, k in found:
                out[i] |= set(range(k, k + n))
    return out


def test_sparse_suffixes(edges, edge_rows, no_docs):
    rows = suffixes.repeated_passages(edges).collect()
    got = collections.defaultdict(set)
    for r in rows:
        got[r["doc_id"]] |= set(range(r["start_word"], r["start_word"] + r["n_words"]))
    want = exact_repeats({(r[0], r[1]) for r in edge_rows if r[0] is not None})
    assert got == want
    assert {r["doc_id"] for r in rows if r["has_earlier"]} >= {2, 3, 9}
    assert suffixes.repeated_passages(no_docs).count() == 0


def test_passages_that_end_in_a_common_phrase(spark):
    """Pairs share 20 words and then a phrase that all documents share: the words to the left decide, far from the order."""
    rng = np.random.default_rng(3)

    def some(n):
        return [f"w{k}" for k in rng.integers(0, 1 << 40, n)]

    phrase, rows = some(30), []
    for pair in range(120):
        head = some(20)
        rows += [(2 * pair + k, " ".join(some(30) + head + phrase + some(30))) for k in (0, 1)]
    rows += [(1000 + k, " ".join(some(40) + phrase + some(40))) for k in range(100)]
    got = collections.defaultdict(set)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in suffixes.repeated_passages(df).collect():
        got[r["doc_id"]] |= set(range(r["start_word"], r["start_word"] + r["n_words"]))
        assert r["other_docs"] == [r["doc_id"] ^ 1] and r["has_earlier"] == (r["doc_id"] % 2 == 1)
    assert got == exact_repeats(rows) and len(got) == 240


def test_the_earliest_of_all_copies_is_known(spark):
    """A passage repeated inside a document between equal words, and in an earlier document between others."""
    from conftest import prose

    middle, around = prose(60, 71), prose(60, 72)
    later = f"{around} {middle} {around} " + prose(20, 73)
    rows = [(1, f"{prose(70, 74)} {middle} {prose(70, 75)}"), (5, f"{later} {later}"), (9, prose(200, 76))]
    found = suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    spot = 200 + 60 + 5  # in the middle of the second copy
    over = [r for r in found if r["doc_id"] == 5 and r["start_word"] <= spot < r["start_word"] + r["n_words"]]
    assert over and all(r["has_earlier"] and 1 in r["other_docs"] for r in over)
    assert not any(r["has_earlier"] for r in found if r["doc_id"] == 1)


def test_kept_places_depend_on_content_alone():
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 1 << 62, 200).astype(np.uint64)
    a = np.concatenate([rng.integers(0, 1 << 62, 70).astype(np.uint64), shared])
    b = np.concatenate([rng.integers(0, 1 << 62, 13).astype(np.uint64), shared])
    inner = {int(p) - 70 for p in suffixes.kept_places(a) if p >= 70 + 24}
    assert inner == {int(p) - 13 for p in suffixes.kept_places(b) if p >= 13 + 24} and len(inner) > 5


def test_packing_is_an_exact_round_trip(edges, edge_rows, no_docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    wanted = collections.defaultdict(list)
    for i, text, *_ in edge_rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        wanted[i].append(np.array(ids, "<u4"))
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in packing.pack(edges, tokenizer_path(), open_windows=3).collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, copies in wanted.items():
        ids = copies[0]
        for r in pieces[i]:
            part = ids[r["start"]:r["start"] + r["length"]]
            assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(part.tobytes())
        assert sum(r["length"] for r in pieces[i]) == len(ids) * len(copies)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(no_docs, tokenizer_path()).count() == 0


def test_words_are_tokenized_once_and_met_ones_stay(monkeypatch):
    """Letter case and marks make no further calls of the model; a full cache keeps the words that are met again."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids = lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    monkeypatch.setattr(packing, "_caches", {})
    encode = packing.word_encoder(tokenizer_path())
    held, calls = packing._caches[tokenizer_path()], []
    model = held.tokenizer.model.tokenize
    held.tokenize = lambda piece: calls.append(piece) or model(piece)
    text = "Grüße grüße, GRÜSSE zyxwvut Zyxwvut. ZYXWVUT, (zyxwvut) it's 12 <|x|>ZY\u017f İstanbul"
    for part in (text[:52], text, "\x1c" + text[:30], "ÀÉ\u0300 ñandú"):
        assert encode(part) == ids(part)
    assert calls.count("zyxwvut") == 1
    monkeypatch.setattr(packing, "CACHED_WORDS", 8)
    for k in range(40):
        word = "".join(chr(97 + int(c)) for c in str(1000 + k))
        assert encode(f"often {word}") == ids(f"often {word}")
    assert calls.count("often") == 1 and len(held) + len(held.older) <= 8 + 40


def test_merging_fills_windows_and_ends_in_powers_of_two():
    pieces = [(d, 0, bytes(4 * n), n) for d, n in enumerate((5, 9, 30, 7, 2))]
    out = list(packing.merge_pieces(pieces, 16, last=True))
    sizes = [sum(len(p[2]) // 4 for p in taken) for _, taken in out]
    assert sizes == [16, 16, 16, 4, 1] and all(closed for closed, _ in out)
    assert [c for c, _ in packing.merge_pieces(pieces, 16, last=False)] == [True, True, True, False]


def brute_licenses(text):
    """(license, different words) by place: every template at every place, the nearest first; what it covers is taken out."""
    words = re.findall(r"\w+(?:[.-]\w+)*", text.lower())
    templates = {name: re.findall(r"\w+(?:[.-]\w+)*", t.lower()) for name, t in license_scan.TEMPLATES.items()}
    found = []
    while True:
        hits = []
        for name, t in templates.items():
            for at in range(len(words) - len(t) + 1):
                different = sum(a != b for a, b in zip(t, words[at:at + len(t)]))
                if different <= license_scan.MOST_DIFFERENT * len(t):
                    hits.append((different / len(t), -len(t), at, name, different))
        if not hits:
            return [(name, different) for _, name, different in sorted(found)]
        _, size, at, name, different = min(hits)
        found.append((at, name, different))
        words[at:at - size] = [None] * -size


def test_licenses_against_brute_force(spark):
    """Every notice with none, as many as allowed, and one more of its words changed, the first and the last among them."""
    from conftest import prose

    rng, rows = random.Random(4), []
    for k, (name, template) in enumerate(license_scan.TEMPLATES.items()):
        words = template.split()
        most = int(license_scan.MOST_DIFFERENT * len(re.findall(r"\w+(?:[.-]\w+)*", template)))
        for changed in sorted({0, most, most + 1}):
            own = list(words)
            for at in [0, len(own) - 1, *rng.sample(range(1, len(own) - 1), len(own) - 2)][:changed]:
                own[at] = f"other{at}"
            rows.append((len(rows), f"{prose(60, 3 * k)} {' '.join(own)} {prose(90, 3 * k + 1)}"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.defaultdict(list)
    for r in sorted(license_scan.scan(df).collect(), key=lambda r: (r["doc_id"], r["start"])):
        got[r["doc_id"]].append((r["license"], r["n_different"]))
    want = {i: found for i, text in rows if (found := brute_licenses(text))}
    assert dict(got) == want and len(want) > 20


def test_licenses(edges, no_docs):
    found = {(r["doc_id"], r["license"], r["n_different"]) for r in license_scan.scan(edges).collect()}
    assert found == {(15, "MIT-notice", 0), (15, "CC-BY-NC-4.0-notice", 0)}
    assert license_scan.scan(no_docs).count() == 0


def test_license_wording_tells_versions_apart():
    def of(text):
        return [(f[0], f[3]) for f in license_scan.find_licenses(text, tuple(license_scan.TEMPLATES.items()))]

    text = license_scan.TEMPLATES["GPL-2.0-header"]
    assert of(f"word {text} word")[0] == ("GPL-2.0-header", 0)
    assert of(text.replace("any later", "any newer"))[0] == ("GPL-2.0-header", 1)
    assert of("A license to drive and the permission of the owner are needed.") == []
    whole = license_scan.TEMPLATES["MIT"]
    start, end = license_scan.find_licenses("x y. " + whole, (("MIT", whole),))[0][1:3]
    assert (start, end) == (5, 5 + len(whole.rstrip(".")))


def test_a_notice_beside_relatives_that_no_template_confirms():
    """The relatives take the best places by compression; the notice is found all the same."""
    from conftest import prose

    templates = tuple(license_scan.TEMPLATES.items())
    relatives = ("Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free "
                 "Documentation License, Version 1.3 or any later version published by the Free Software Foundation.",
                 "This work is licensed under CC BY-NC-SA 4.0.")
    for seed in range(20):
        for name in ("MIT-notice", "Apache-2.0-notice"):
            text = " ".join((prose(40, seed), relatives[0], prose(9, seed + 50), relatives[1], prose(9, seed + 90),
                             license_scan.TEMPLATES[name], prose(40, seed + 130)))
            assert name in [f[0] for f in license_scan.find_licenses(text, templates)], (seed, name)
