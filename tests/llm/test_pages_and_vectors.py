"""Operators on pages and vectors against brute force, on edge rows and on empty tables."""

import base64
import collections
import hashlib

import numpy as np

from bladewatch.llm import url_graph, vector_graph, warc
from bladewatch.llm.queries import URL_RULES

PAGES = "page_id long, url string, html string, host string, verdict string"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", None) for r in rows], PAGES)


def test_hosts_paths_and_rules(spark):
    cases = {
        1: ("https://WWW.Example.com/en/x?y#z", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        2: ("http://m.example.com/en/", "m.example.com", "/en/", "example.com/en/", "block"),
        3: ("http://a.net/es/1#x", "a.net", "/es/1", "net/es/", "block"), 4: ("http://c.net?/es/", "c.net", "", None, "allow"),
        5: ("x.com/", "", "", None, "allow"), 6: (None, "", "", None, "allow"), 7: ("://", "", "", None, "allow"),
        8: ("ftp://b.com/EN", "b.com", "/EN", "com/", "allow"), 9: ("http://xcom/en", "xcom", "/en", None, "allow"),
        10: ("http://b.com#/x", "b.com", "", None, "allow"), 11: ("a://b.net/fr/://c", "b.net", "/fr/://c", "net/fr/", "block"),
    }
    df = pages_of(spark, [(k, v[0], None) for k, v in cases.items()])
    got = {r["page_id"]: tuple(r)[1:5] for r in url_graph.judge_urls(df, URL_RULES).collect()}
    assert got == {k: v[1:] for k, v in cases.items()}
    assert url_graph.judge_urls(pages_of(spark, []), URL_RULES).count() == 0


def test_scores_follow_the_links(spark):
    """Personalised PageRank against a dense solution; who links to a blocked host is blocked, who is linked is not."""
    link = '<a href="http://{}/x">x</a>'.format
    rows = [
        (1, "http://bad.net/es/1", link("victim.org")), (2, "http://linker.org/1", link("bad.net") + link("bad.net")),
        (3, "http://good.com/1", link("friend.org") + "<a href='//victim.org/'>"), (4, "http://friend.org/1", None),
        (5, "http://victim.org/1", ""), (6, "http://sub.linker.org/", '<a href="/own">'), (7, "http://linker.org/2", None)]
    got = {r["page_id"]: r for r in url_graph.judge_urls(pages_of(spark, rows), URL_RULES).collect()}
    assert {k: r["verdict"] for k, r in got.items()} == {
        1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "block", 7: "block"}
    hosts = ["bad.net", "linker.org", "good.com", "friend.org", "victim.org", "sub.linker.org"]
    w = np.zeros((6, 6))
    for a, b in ((0, 4), (1, 0), (2, 3), (2, 4), (1, 5), (5, 1)):
        w[a, b] = 1

    def rank(m, seed):
        m = m / np.maximum(m.sum(1, keepdims=True), 1)
        r = seed.copy()
        for _ in range(url_graph.ROUNDS):
            r = seed + url_graph.DAMPING * (m.T @ r)
        return r

    trust, distrust = rank(w, np.eye(6)[2]), rank(w.T, np.eye(6)[0])
    for r in got.values():
        k = hosts.index(r["host"])
        assert abs(r["trust"] - trust[k]) < 1e-9 and abs(r["distrust"] - distrust[k]) < 1e-9


def test_many_linkers_of_a_blocked_host(spark):
    """Who links to a blocked host alone is blocked, however many others do; who does so with few of its links is not."""
    link = '<a href="http://{}/x">x</a>'.format
    rows = [(1, "http://bad.net/es/1", None)]
    rows += [(10 + k, f"http://linker{k}.org/", link("bad.net")) for k in range(10)]
    rows += [(30 + k, f"http://s{k}.bad.net/", None) for k in range(8)]
    rows += [(50 + k, f"http://s{k}.linker0.org/", None) for k in range(8)]
    rows += [(70, "http://mostly.org/", link("bad.net") + "".join(link(f"fine{k}.org") for k in range(9)))]
    rows += [(71 + k, f"http://fine{k}.org/", None) for k in range(9)]
    got = {r["page_id"]: r["verdict"] for r in url_graph.judge_urls(pages_of(spark, rows), URL_RULES).collect()}
    assert {k for k, v in got.items() if v == "block"} == {1, *range(10, 20), *range(30, 38), *range(50, 58)}


def test_warc_round_trip(spark, tmp_path):
    big = "é\r\n\r\n" * 50_000
    rows = [(1, "http://a/", "same"), (2, "http://b/", "same"), (3, None, None), (4, "u", ""), (5, "u", big), (6, "u", big),
            (7, "u", "x\r\n\r\n\r\n"), (8, "u\r\nX: y", "WARC/1.1\r\nContent-Length: 3\r\n\r\n"), (9, "u", "\r\n\r\n"),
            (9, "u", "\r\n\r\n"), (None, "u", "lost")]
    got = collections.Counter(tuple(r) for r in warc.archive_round_trip(
        pages_of(spark, rows).repartition(2), str(tmp_path / "w"), chunk_bytes=1000).collect())
    last = {}
    for i, _, t in rows:
        last[t or ""] = max(i or 0, last.get(t or "", 0))
    want = collections.Counter()
    for i, _, t in rows:
        data, first = (t or "").encode(), last[t or ""]
        revisit = i is not None and i < first
        want[(i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
              "revisit" if revisit else "response", first if revisit else None)] += 1
    assert got == want
    assert warc.archive_round_trip(pages_of(spark, []), str(tmp_path / "none")).count() == 0


def test_small_payloads_are_all_responses(spark, tmp_path):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")]
    got = {r["page_id"]: r["record_type"] for r in warc.archive_round_trip(
        pages_of(spark, rows), str(tmp_path / "w"), least_bytes=5).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_chunks_carry_digests_of_all_before(spark):
    html = "".join(chr(65 + k % 26) for k in range(2500))
    rows = sorted(warc.chunk_table(warc.record_types(pages_of(spark, [(1, "u", html)])), 1000).collect(),
                  key=lambda r: r["chunk_no"])
    assert [len(r["chunk"]) for r in rows] == [1000, 1000, 500]
    for k, r in enumerate(rows):
        assert r["digest"] == base64.b32encode(hashlib.sha1(html[:1000 * (k + 1)].encode()).digest()).decode()


def vectors_with_groups(rng):
    x = rng.normal(size=(400, 16))
    x[100:140] = x[0] + 0.05 * rng.normal(size=(40, 16))
    x[200:230] = x[1] * rng.uniform(0.5, 2, (30, 1))
    x[300:310] = x[2]
    return x


def test_near_vectors(spark):
    rng = np.random.default_rng(2)
    x = vectors_with_groups(rng)
    rows = [(int(i), [float(c) for c in v], "x") for i, v in enumerate(x)]
    odd = [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] + [1.0] * 15), (1004, [None] + [1.0] * 15),
           (1005, [float("inf")] * 16), (1006, [1.0, 2.0]), (1007, [2.0, 4.0]), (1008, [1e200] * 16), (1009, [1e-200] * 16)]
    df = spark.createDataFrame(rows + [(i, v, "x") for i, v in odd], "vec_id long, embedding array<double>, node string")
    got = {r["vec_id"]: r for r in vector_graph.near_vectors(df).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    found = sum(got[i]["n_links"] for i in range(len(x)))
    assert 0.95 * near.sum() <= found <= near.sum()
    assert all(got[i]["n_links"] <= near[i].sum() for i in range(len(x)))
    assert {got[i]["component_id"] for i in (0, *range(100, 140))} == {0}
    assert {got[i]["component_id"] for i in range(300, 310)} == {2} and got[300]["n_links"] == 10
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (1000, 1001, 1002, 1003, 1004, 1005))
    assert got[1006]["n_links"] == got[1007]["n_links"] == 1 and got[1007]["component_id"] == 1006
    assert got[1009]["component_id"] == 1008 and not got[1009]["kept"]
    assert vector_graph.near_vectors(df.limit(0)).count() == 0


def test_a_crowded_shard_is_cut_without_losing_links(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=16) + 0.02 * rng.normal(size=(300, 16))
    df = spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(vector_graph, "CELL", 70)
    rows = vector_graph.near_vectors(df).collect()
    assert {r["component_id"] for r in rows} == {0} and sum(r["n_links"] for r in rows) >= 0.95 * 300 * 299


def test_a_large_group_does_not_hide_lost_links(spark):
    """All links of a group of near-equal vectors are found and none of 40 pairs."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 32))
    x[:200] = x[0] + 0.01 * rng.normal(size=(200, 32))
    x[240:280] = x[200:240] + 0.01 * rng.normal(size=(40, 32))
    df = spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    _, nodes = vector_graph.nodes_of(df, "vec_id", "embedding")

    def links(pairs):
        return spark.createDataFrame(
            [(i, 199 if i < 200 else pairs if i < 280 else 0, i) for i in range(400)], "node long, links long, root long")

    assert vector_graph.audited_recall(nodes, links(1), 0.9, 32) == 1.0
    assert vector_graph.audited_recall(nodes, links(0), 0.9, 32) < 0.5


def test_no_result_below_the_recall(spark, monkeypatch):
    import pytest

    x = np.random.default_rng(8).normal(size=(30, 8))
    df = spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    tried = []
    monkeypatch.setattr(vector_graph, "audited_recall", lambda *a: tried.append(a) or 0.9)
    with pytest.raises(RuntimeError):
        vector_graph.near_vectors(df)
    assert len(tried) == 2
