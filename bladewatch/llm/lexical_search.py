"""Ranked lexical search of a set of items by scanning the documents, without an index of them.

All terms of the items form one Aho-Corasick automaton that is broadcast. Each term stands between two guards, and so
do the terms of a text, so that the automaton finds whole terms only and its outputs count them. Corpus statistics are
sums over the counts of all documents; the scores of a document are one product of its terms with the items' terms.
"""

from __future__ import annotations

import collections
import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from bladewatch.llm.common import ascii_lower, saved

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 10
PAIRS_PER_BLOCK = 200_000  # of items and their terms; more items are searched in further blocks
GUARD = 0x20
CELLS = 8_000_000  # matches that a task scores at once
# bytes of a text: separators become guards, A-Z lower case, all others stay
_PLAIN = bytes(
    c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else GUARD for c in range(256))


def plain(text: str) -> bytes:
    """The text's terms between guards, as UTF-8 bytes."""
    return b" " + text.encode().translate(_PLAIN) + b" "


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term), each once: rows of equal id are one item with the terms of all of them."""
    terms = F.regexp_extract_all(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(TERM), F.lit(0))
    return items.select(F.col(id_col).cast("long").alias("item_id"), F.explode(F.array_distinct(terms)).alias("term")).distinct()


def automaton(terms: list[str]) -> ahocorasick.Automaton:
    """Outputs the index of each term, found between its guards. One character stands for one byte of UTF-8."""
    machine = ahocorasick.Automaton()
    for k, term in enumerate(terms):
        machine.add_word((b" " + term.encode() + b" ").decode("latin-1"), k)
    machine.make_automaton()
    return machine


def count_terms(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, terms, tf) of every row with at least one term: all its terms, and those of the list with their counts."""
    machine = docs.sparkSession.sparkContext.broadcast(automaton(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = machine.value
        for batch in batches:
            rows, sizes, found = [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                data = plain(text)
                n = len(data.split())
                if n:
                    rows.append(k)
                    sizes.append(n)
                    found.append(sorted(collections.Counter(v for _, v in search.iter(data.decode("latin-1"))).items()))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(rows, pa.int32())), pa.array(sizes, pa.int64()),
                pa.array([[t for t, _ in f] for f in found], pa.list_(pa.int32())),
                pa.array([[c for _, c in f] for f in found], pa.list_(pa.int64()))], ["doc_id", "n", "terms", "tf"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<long>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _leading(score: np.ndarray, ids: np.ndarray, null: np.ndarray, top: int) -> tuple[np.ndarray, ...]:
    """The first ``top`` rows of each column by falling score, then by id, null last."""
    order = np.lexsort((ids, null, -score), axis=0)[:top]
    return tuple(np.take_along_axis(x, order, axis=0) for x in (score, ids, null))


def best(counted: DataFrame, pairs: list[tuple[int, int]], weights: list[int], n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(item_id, doc_id, score): the ``top`` rows of each task for each item.

    ``pairs`` are of an item's place and a term's index, as one sparse matrix of items by terms. A task holds ``top``
    rows an item, and scores so many documents at once that ``CELLS`` bounds their matches.
    """
    context = counted.sparkSession.sparkContext
    by_term = np.array(sorted((t, i) for i, t in pairs), np.int64)
    starts = np.searchsorted(by_term[:, 0], np.arange(len(weights) + 1))
    n_items = int(by_term[:, 1].max()) + 1
    matrix = context.broadcast((starts, by_term[:, 1], np.array(weights, np.int64)))
    rows_at_once = max(1, CELLS // len(pairs))

    def scores(sizes: list[int], terms: pa.ListArray, tf: pa.ListArray) -> np.ndarray:
        starts, holders, w = matrix.value
        t, f = terms.flatten().to_numpy(), tf.flatten().to_numpy()
        row = np.repeat(np.arange(len(sizes)), np.diff(terms.offsets.to_numpy()))
        m = np.array([10 + (90 * n * n_docs) // n_terms for n in sizes], np.int64)[row]
        gain = w[t] * ((1_000_000_000 * f) // (1000 * f + 8 * m))
        each = starts[t + 1] - starts[t]  # items that hold the term
        first = np.repeat(starts[t] - np.r_[0, np.cumsum(each)[:-1]], each)
        out = np.zeros((len(sizes), n_items), np.int64)
        np.add.at(out, (np.repeat(row, each), holders[first + np.arange(len(first))]), np.repeat(gain, each))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = tuple(np.zeros((0, n_items), k) for k in (np.int64, np.int64, bool))
        for whole in batches:
            for at in range(0, whole.num_rows, rows_at_once):
                batch = whole.slice(at, rows_at_once)
                ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
                null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
                got = scores(batch.column(1).to_pylist(), batch.column(2), batch.column(3))
                new = _leading(got, *(np.broadcast_to(x[:, None], got.shape) for x in (ids, null)), top)
                held = _leading(*(np.concatenate(x) for x in zip(held, new)), top)
        score, ids, null = held
        k, item = np.nonzero(score > 0)
        yield pa.RecordBatch.from_arrays([
            pa.array(item, pa.int64()), pa.array(ids[k, item], pa.int64(), mask=null[k, item]),
            pa.array(score[k, item], pa.int64())], ["item", "doc_id", "score"])

    return counted.mapInArrow(run, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, pairs_per_block: int = PAIRS_PER_BLOCK,
           id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score of the ``top`` documents of each item with a score above 0.

    Terms are runs of letters and digits and of all characters beyond ASCII; only A-Z are lower-cased. Null and empty
    texts have none and count for nothing, in documents as in items. Each row of the documents is a document, so repeated
    rows take a rank each. Rows of equal item id are one item with all their terms, as are those of a null id. A null
    document id comes after all others of its score. Very long texts are scanned whole. Extra columns are left out; no
    documents or no items give no rows.

    The items are the query set: they go through the documents in blocks of at most ``pairs_per_block`` terms (more only
    if one item alone has more), which bounds the automaton, its broadcast and what a task holds.
    """
    spark = docs.sparkSession
    pairs = saved(item_terms(items, item_col, item_text_col), "item-terms")
    n_blocks = -(-pairs.count() // pairs_per_block)
    out, totals = spark.createDataFrame([], "item_id long, doc_id long, score long"), None
    for block in range(n_blocks):
        here = pairs.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block).collect()
        terms = sorted({r["term"] for r in here})
        item_ids = sorted({r["item_id"] for r in here}, key=lambda i: (i is not None, i))
        if not terms:
            continue
        index, place = ({x: k for k, x in enumerate(xs)} for xs in (terms, item_ids))
        counted = saved(count_terms(docs, terms, id_col, text_col), "term-counts")
        totals = totals or counted.agg(F.count(F.lit(1)), F.sum("n")).first()  # the same for every block
        if not totals[0]:
            break
        df = dict(counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
        found = best(counted, [(place[r["item_id"]], index[r["term"]]) for r in here],
                     [weight(totals[0], df.get(k, 0)) for k in range(len(terms))], totals[0], totals[1], top)
        names = spark.createDataFrame(list(enumerate(item_ids)), "item long, item_id long")
        out = out.unionByName(found.join(F.broadcast(names), "item").select("item_id", "doc_id", "score"))
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select(
        "item_id", "rank", "doc_id", "score")
