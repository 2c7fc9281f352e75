"""Near-duplicate vectors by a robust-pruned flat graph, built on overlapping shards and searched by range.

Equal vectors are one node with a multiplicity. Nodes are dealt to the shards of their two nearest cluster centres; in
each shard every node gets neighbours by robust pruning, and the lists of a node from its shards are united. Every node
is then searched for in its nearest shards: a greedy search from the shard's medoid (and from the node itself where it
lives) with a beam, which goes on from every node in range until none is left. A link counts where its target has its
first shard, so none counts twice. Every similarity is computed in double precision.

Recall is audited against brute force over all rows, for a bounded sample of nodes of every group size; as long as it is
too low, the search is repeated with more shards and a wider beam, at last with all pairs of all shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from bladewatch.llm.common import bounded, components, saved

SIMILARITY = 0.9
SHARD_NODES = 1500  # nodes per cluster centre
CELL = 3000  # nodes, or queries, of a shard that one task takes
FITTED_ON = 20_000  # vectors that the centres are fitted on; all vectors are indexed
MOST_CENTRES = 2_000
NEAREST, RANDOM, DEGREE, ALPHA = 48, 16, 20, 1.2
SLACK = 0.05  # how far below the range a node is still expanded
PROBES, BEAM = 4, 24
AUDITED, AUDITED_EACH = 400, 100  # nodes without a link found, and of each size of the links found
STRATUM = 20  # audited nodes with links that a recall is taken of, at least
RECALL = 0.95
ALL = 1 << 31  # a beam that takes all pairs
_STEP = 40_000  # (query, node) pairs expanded at once


def nodes_of(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): rows are (vec_id, node, copies), node null for unusable vectors; nodes (node, copies, dim, v)."""
    v = F.col(vector_col)
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(
        F.coalesce(usable, F.lit(False)) & F.col(id_col).isNotNull(), v.cast("array<double>")).alias("v"))
    nodes = saved(rows.filter("v IS NOT NULL").groupBy("v").agg(
        F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies")).withColumn("dim", F.size("v")), "vectors")
    placed = rows.join(nodes.select("v", "node", "copies"), "v", "left").select("vec_id", "node", "copies")
    return placed, nodes


def _unit(column) -> np.ndarray:
    x = np.stack(column).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_centres(nodes: DataFrame, count: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means on FITTED_ON nodes, the first by a digest of their ids."""
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(FITTED_ON).select("v").toPandas()
    x = _unit(sample["v"])
    k = max(1, min(-(-count // SHARD_NODES), MOST_CENTRES, len(x)))
    centres = x[np.random.default_rng(7).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = np.concatenate([(x[i:i + 4096] @ centres.T).argmax(1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-300), centres)
    return centres


def _routed(nodes: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """(node, copies, v, shards): the nearest shards of each node, nearest first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(batch.column("v").to_numpy(zero_copy_only=False))
            near = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("copies"), pa.array(list(x), pa.list_(pa.float64())),
                 pa.array(list(near), pa.list_(pa.int32()))], ["node", "copies", "v", "shards"])

    return nodes.select("node", "copies", "v").mapInArrow(
        run, "node long, copies long, v array<double>, shards array<int>")


def robust_pruned(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, seed: int = 0) -> list[np.ndarray]:
    """Neighbours of each row: from its nearest and some random rows, the nearest one first, and then none that a
    chosen neighbour is ``alpha`` times nearer to than the row itself. Reverse edges are added up to the degree again."""
    n = len(x)
    rng = np.random.default_rng(seed)
    out: list[np.ndarray] = []
    for low in range(0, n, 512):
        block = x[low:low + 512] @ x.T
        block[np.arange(len(block)), np.arange(low, low + len(block))] = -2.0
        take = min(NEAREST, n - 1)
        near = np.argpartition(-block, take - 1, axis=1)[:, :take] if take > 0 else np.zeros((len(block), 0), int)
        for r in range(len(block)):
            pool = np.unique(np.concatenate([near[r], rng.integers(0, n, RANDOM)]))
            pool = pool[pool != low + r]
            pool = pool[np.argsort(-block[r, pool], kind="stable")]
            far = np.sqrt(np.maximum(2.0 - 2.0 * block[r, pool], 0.0))
            between = np.sqrt(np.maximum(2.0 - 2.0 * (x[pool] @ x[pool].T), 0.0))
            alive, chosen = np.ones(len(pool), bool), []
            while len(chosen) < degree and alive.any():
                c = int(alive.argmax())
                chosen.append(c)
                alive &= alpha * between[c] > far
                alive[c] = False
            out.append(pool[chosen])
    back: list[list[int]] = [[] for _ in range(n)]
    for i, own in enumerate(out):
        for j in own:
            if len(back[j]) < degree:
                back[j].append(i)
    return [np.unique(np.concatenate([own, np.array(b, own.dtype)])) for own, b in zip(out, back)]


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("node")
    ids = pdf["node"].to_numpy()
    lists = robust_pruned(_unit(pdf["v"])) if len(pdf) > 1 else [np.zeros(0, int)]
    return pd.DataFrame({"node": ids, "edges": [ids[e] for e in lists]})


def range_search(x: np.ndarray, table: np.ndarray, starts: list[np.ndarray], queries: np.ndarray, similarity: float,
                 beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs found with a similarity of at least ``similarity``.

    ``table`` holds the neighbours of each row, padded with -1. A query expands its best ``beam`` rows, best first,
    and every row within SLACK of the range, until nothing is left to expand. With a beam of ALL no pair is left out.
    """
    m, q = len(x), len(queries)
    if beam >= ALL:
        return np.nonzero(queries @ x.T >= similarity)
    sims = np.full((q, m), -2.0)
    expanded = np.zeros((q, m), bool)

    def visit(a: np.ndarray, b: np.ndarray) -> None:
        new = sims[a, b] < -1.5
        a, b = a[new], b[new]
        sims[a, b] = np.einsum("ij,ij->i", queries[a], x[b])

    for s in starts:
        own = np.flatnonzero(s >= 0)
        visit(own, s[own])
    wide = min(beam, m)
    while True:
        top = np.argpartition(-sims, wide - 1, axis=1)[:, :wide]
        a = np.repeat(np.arange(q), wide)
        b = top.ravel()
        open_ = ~expanded[a, b] & (sims[a, b] > -1.5)
        a, b = a[open_], b[open_]
        near_a, near_b = np.nonzero((sims >= similarity - SLACK) & ~expanded)
        a, b = np.concatenate([a, near_a]), np.concatenate([b, near_b])
        if not len(a):
            break
        expanded[a, b] = True
        for at in range(0, len(a), _STEP):
            rows = table[b[at:at + _STEP]]
            owner = np.repeat(a[at:at + _STEP], rows.shape[1])
            target = rows.ravel()
            real = target >= 0
            pair = np.unique(owner[real].astype(np.int64) * m + target[real])
            visit(pair // m, pair % m)
    return np.nonzero(sims >= similarity)


def _search(similarity: float, beam: int):
    """Rows (node, links, root): a count per query and the edges of a forest over the links found in the cell."""
    def run(key: tuple, members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(members) or not len(queries):
            return pd.DataFrame({"node": [], "links": [], "root": []}, dtype="int64")
        members, queries = members.sort_values("node"), queries.sort_values("node")
        ids, asked = members["node"].to_numpy(), queries["node"].to_numpy()
        x, y = np.stack(members["v"]), np.stack(queries["v"])
        first, copies = members["first"].to_numpy(), members["copies"].to_numpy()
        lists = []
        for e in members["edges"]:
            e = np.unique(np.asarray(e, np.int64))
            at = np.minimum(np.searchsorted(ids, e), len(ids) - 1)
            lists.append(at[ids[at] == e])
        table = np.full((len(ids), max(1, max(map(len, lists)))), -1, np.int64)
        for i, e in enumerate(lists):
            table[i, :len(e)] = e
        medoid = int((x @ x.mean(axis=0)).argmax())
        at = np.minimum(np.searchsorted(ids, asked), len(ids) - 1)
        own = np.where(ids[at] == asked, at, -1)
        links, pairs = np.zeros(len(asked), np.int64), []
        for low in range(0, len(asked), 256):
            part = slice(low, low + 256)
            a, b = range_search(x, table, [np.full(len(asked[part]), medoid), own[part]], y[part], similarity, beam)
            other = ids[b] != asked[part][a]
            a, b = a[other], b[other]
            np.add.at(links, low + a, np.where(first[b], copies[b], 0))
            pairs.append((asked[low + a], ids[b]))
        return _cell_result(asked, links, *(np.concatenate(p) for p in zip(*pairs)))

    return run


def _cell_result(asked, links, pairs_a, pairs_b) -> pd.DataFrame:
    """Counts per query, and a spanning forest of the links found, so that rows stay linear in the nodes."""
    names, inverse = np.unique(np.concatenate([pairs_a, pairs_b]), return_inverse=True)
    parent = np.arange(len(names))
    half = len(pairs_a)
    left, right = inverse[:half], inverse[half:]
    while True:  # labels fall to the smallest of a neighbourhood, then jump to their label's label
        low = np.minimum(parent[left], parent[right])
        new = parent.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == parent).all():
            break
        parent = new
    tree = pd.DataFrame({"node": names, "links": 0, "root": names[parent]})
    return pd.concat([pd.DataFrame({"node": asked, "links": links, "root": asked}), tree], ignore_index=True)


def _cells(routed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, queries): who is kept in and who is asked of each cell (shard, sub, chunk).

    A shard with more nodes than a cell takes is cut into parts by a digest of the node, and its queries into chunks:
    each chunk is asked of each part, so a crowded shard spreads over many tasks and no pair is left out.
    """
    asked = routed.select("node", "copies", "v", F.posexplode("shards").alias("rank", "shard"))
    sizes = saved(asked.groupBy("shard").agg(
        F.ceil(F.count_if(F.col("rank") < 2) / CELL).cast("int").alias("subs"),
        F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("chunks")), "shard-sizes")
    dealt = asked.join(bounded(sizes), "shard")
    digest = F.xxhash64("node")
    members = dealt.filter("rank < 2").withColumn("first", F.col("rank") == 0).withColumn(
        "sub", F.pmod(digest, F.col("subs")).cast("int"))
    queries = dealt.withColumn("chunk", F.pmod(digest, F.col("chunks")).cast("int"))
    return members, queries


def _linked(routed: DataFrame, similarity: float, beam: int) -> DataFrame:
    members, queries = _cells(routed)
    members, queries = saved(members, "vectors-members"), saved(queries, "vectors-queries")
    lists = members.groupBy("shard", "sub").applyInPandas(_with_key(_build), "node long, edges array<long>")
    graph = lists.groupBy("node").agg(F.flatten(F.collect_list("edges")).alias("edges"))  # at most two lists each
    kept = members.join(graph, "node").withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "shard", "sub", "chunk", "node", "copies", "v", "first", "edges")
    asked = queries.withColumn("sub", F.explode(F.sequence(F.lit(0), F.greatest("subs", F.lit(1)) - 1))).select(
        "shard", "sub", "chunk", "node", "v")
    kept, asked = saved(kept, "vectors-kept"), saved(asked, "vectors-asked")
    cell = ["shard", "sub", "chunk"]
    return saved(kept.groupBy(*cell).cogroup(asked.groupBy(*cell)).applyInPandas(
        _search(similarity, beam), "node long, links long, root long"), "vector-links")


def _with_key(build):
    return lambda key, pdf: build(pdf)


def _stratum(links: Column) -> Column:
    return F.when(links > 0, F.floor(F.log2(links) / 2).cast("int") + 1).otherwise(F.lit(0))


def audited_recall(nodes: DataFrame, found: DataFrame, similarity: float, dim: int) -> float:
    """The least mean share of a node's true links that was found, over strata of nodes by their true links; 1 without any.

    Audited are nodes of every size of links found, by a digest of their ids, each weighted by the nodes it stands for.
    So a large group, which has nearly all links, does not hide what is lost elsewhere. Strata (powers of four) with
    few audited nodes are taken together with the next.
    """
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    sized = nodes.select("node", "v").join(counts, "node", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    sizes = {r["s"]: r["n"] for r in sized.groupBy(_stratum(F.col("links")).alias("s")).agg(
        F.count(F.lit(1)).alias("n")).collect()}
    share = {s: min(1.0, (AUDITED_EACH if s else AUDITED) / n) for s, n in sizes.items()}
    drawn, stratum = F.lit(0.0), _stratum(F.col("links"))
    for s, x in share.items():
        drawn = F.when(stratum == s, F.lit(x)).otherwise(drawn)
    sample = sized.withColumn("s", stratum).filter(
        F.pmod(F.xxhash64("node"), F.lit(1_000_003)) < drawn * 1_000_003).toPandas()
    if not len(sample):
        return 1.0
    ids, x = sample["node"].to_numpy(), _unit(sample["v"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            y, copies = _unit(batch.column("v").to_numpy(zero_copy_only=False)), batch.column("copies").to_numpy()
            hit = (x @ y.T >= similarity) & (ids[:, None] != batch.column("node").to_numpy()[None, :])
            total += (hit * copies).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["node", "n"])

    true = nodes.select("node", "copies", "v").mapInArrow(count, "node long, n long").groupBy("node").agg(
        F.sum("n").alias("n")).toPandas()
    rows = sample.drop(columns="v").merge(true, on="node").query("n > 0")
    drawn_of = sample.groupby("s").size()
    weight = rows["s"].map(lambda s: sizes[s] / drawn_of[s]).to_numpy(float)
    recall = (np.minimum(rows["links"], rows["n"]) / rows["n"]).to_numpy(float)
    kind = np.floor(np.log2(np.maximum(rows["n"].to_numpy(float), 1)) / 2)
    groups, held = [], np.zeros(len(rows), bool)
    for k in np.unique(kind):
        held = held | (kind == k)
        if held.sum() >= STRATUM:
            groups.append(held)
            held = np.zeros(len(rows), bool)
    if held.any():
        groups.append(groups.pop() | held if groups else held)
    return min((float(np.average(recall[g], weights=weight[g])) for g in groups), default=1.0)


def near_vectors(vectors: DataFrame, similarity: float = SIMILARITY, id_col: str = "vec_id",
                 vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Vectors that are null, empty or zero, or hold null or non-finite components, and rows without an id, link with
    nothing. Vectors of different lengths link with none of each other. Rows with equal vectors all link; repeated
    ids count as rows. Extra columns are left out; no rows give no rows. No result has an audited recall below RECALL.
    """
    rows, nodes = nodes_of(vectors, id_col, vector_col)
    found = None
    for dim, count in [tuple(r) for r in nodes.groupBy("dim").count().orderBy("dim").collect()]:
        own = nodes.filter(F.col("dim") == dim)
        centres, probes, beam = fit_centres(own, count), PROBES, BEAM
        while True:
            routed = saved(_routed(own, centres, probes), "vectors-routed")
            links = _linked(routed, similarity, beam)
            recall = audited_recall(own, links, similarity, dim)
            if recall >= RECALL:
                break
            if beam >= ALL:
                raise RuntimeError(f"a recall of {recall:.3f} with all pairs of all shards")
            probes, beam = 3 * probes, 2 * beam if probes < len(centres) else ALL
        found = links if found is None else found.unionByName(links)
    plain = rows.select("vec_id", "node", (F.coalesce("copies", F.lit(1)) - 1).alias("own"))
    if found is None:
        out = plain.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    else:
        counts = found.groupBy("node").agg(F.sum("links").alias("links"))
        labels = components(found.filter("node <> root"), "node", "root")
        out = plain.join(counts, "node", "left").join(labels, "node", "left").select(
            "vec_id", (F.col("own") + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "node", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
