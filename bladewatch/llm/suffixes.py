"""Repeated passages by sparse suffixes over words.

Suffixes are kept only at minimiser positions: places whose run of K words has the smallest digest among W neighbours,
so that two texts that share a passage keep the same places in it. Each window of LEAST words belongs to the place of the
smallest digest among its first W runs, which depends on the window's own words alone; two equal windows thus belong to
places that share the next NEXT words.

Suffixes whose next words occur once are done with. Those with the same surroundings on both sides hold the same
windows and are settled by one aggregation, so a large group of copies sends one of them on. Of the others every window
is compared by a digest, grouped over the whole table: no order of the suffixes and no limit of neighbours decides. A
word is in a repeated passage if one of the windows that hold it occurs elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from bladewatch.llm.common import bounded, saved

K, W = 8, 24
LEAST = 50
NEXT = 24
LEFT, RIGHT = 32, 50
NEEDED_IDS = 300_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(31)
_UPPER = np.uint64(0xFFFFFFFF00000000)


class _WordHashes(dict):
    """64-bit digests of words met so far; emptied when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hashes = _WordHashes()


def word_digests(text: str | None) -> np.ndarray:
    parts = (text or "").encode().split()
    return np.fromiter(map(_hashes.__getitem__, parts), np.uint64, len(parts))


def _mixed(*columns: np.ndarray) -> np.ndarray:
    out = np.full(len(columns[0]), len(columns), np.uint64)
    for c in columns:
        out = (out ^ c) * _MIX
        out ^= out >> _SHIFT
    return out


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours, in about log2(width) passes."""
    done, out = 1, x
    while 2 * done <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def _least_places(runs: np.ndarray, width: int = W) -> np.ndarray:
    """For each ``width`` neighbouring digests the place of the smallest, by its upper half; the first of equal ones."""
    if len(runs) < width:
        return np.zeros(0, np.int64)
    ranked = (runs & _UPPER) | np.arange(len(runs), dtype=np.uint64)
    return (_sliding_least(ranked, width) & ~_UPPER).astype(np.int64)


def kept_places(runs: np.ndarray, width: int = W) -> np.ndarray:
    """Places whose digest is the smallest of some ``width`` neighbouring ones."""
    return np.unique(_least_places(runs, width))


def _runs(own: np.ndarray) -> np.ndarray:
    return _mixed(*[own[j:len(own) - K + 1 + j] for j in range(K)])


def _near(runs: np.ndarray, at: np.ndarray) -> np.ndarray:
    return _mixed(*[runs[at + j] for j in range(0, NEXT, K)]).view(np.int64)


def kept_suffixes(own: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """Of a text's kept suffixes: places, digests of the next NEXT words, digests of the surroundings, words before and
    after within them, and how many words earlier its first and its last window starts."""
    n, reach = len(own), max(RIGHT, least)
    if n < least:
        return (np.zeros(0, np.int64),) * 7
    runs = _runs(own)
    at, start, windows = np.unique(_least_places(runs)[:n - least + 1], return_index=True, return_counts=True)
    inner = (at >= LEFT) & (at + reach <= n)
    around = np.zeros(len(at), np.uint64)
    p = at[inner]
    around[inner] = _mixed(*[runs[p + j] for j in (*range(-LEFT, reach - K, K), reach - K)])
    for i in np.flatnonzero(~inner):  # cut off by an end of the text
        low, high = max(0, at[i] - LEFT), min(n, at[i] + reach)
        data = own[low:high].tobytes() + int(at[i] - low).to_bytes(4, "big") + int(high - at[i]).to_bytes(4, "big")
        around[i] = xxhash.xxh64_intdigest(data, seed=1)
    return (at, _near(runs, at), around.view(np.int64), np.minimum(at, LEFT), np.minimum(n - at, reach), at - start,
            at - start - windows + 1)


def window_digests(own: np.ndarray, at: np.ndarray, early: np.ndarray, late: np.ndarray, least: int = LEAST) -> tuple:
    """(place, start, near, digest) of the windows that start ``early`` to ``late`` words before each place."""
    runs = _runs(own) if len(own) >= least else np.zeros(0, np.uint64)
    sizes = early - late + 1
    place = np.repeat(at, sizes)
    start = place - np.repeat(early, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    inside = (start >= 0) & (start + least <= len(own))  # another text of the same id may be shorter
    place, start = place[inside], start[inside]
    digest = _mixed(*[runs[start + j] for j in (*range(0, least - K, K), least - K)])
    return place, start, _near(runs, place), digest.view(np.int64)


def _batch(parts: list[tuple], names: list[str]) -> pa.RecordBatch:
    """The arrays of all ``parts``, (id, array, ...) each, below each other."""
    columns = [np.concatenate([np.full(len(p[1]), p[0], np.int64) for p in parts])] + [
        np.concatenate(c) for c in list(zip(*parts))[1:]] if parts else [np.zeros(0, np.int64)] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names)


def suffix_table(texts: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, at, near, around, before, after, early, late): the kept suffixes of all texts, as ``kept_suffixes``."""
    names = ["doc_id", "at", "near", "around", "before", "after", "early", "late"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([(doc, *kept_suffixes(word_digests(text.as_py()), least))
                          for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"))], names)

    return texts.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def windows(texts: DataFrame, places: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, at, start, near, digest): the windows of the places (doc_id, at, early, late)."""
    lists = places.groupBy("doc_id").agg(
        F.collect_list(F.struct("at", "early", "late")).alias("places"))  # bounded by the document
    lists = lists.select("doc_id", *[F.col(f"places.{c}").alias(c) for c in ("at", "early", "late")])
    ids = saved(lists.select("doc_id"), "suffix-ids")
    rows = texts.join(bounded(ids, NEEDED_IDS), "doc_id", "left_semi").join(lists, "doc_id")
    names = ["doc_id", "at", "start", "near", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, doc in enumerate(batch.column("doc_id").to_pylist()):
                at, early, late = (np.array(batch.column(c)[k].as_py(), np.int64) for c in ("at", "early", "late"))
                out.append((doc, *window_digests(word_digests(batch.column("text")[k].as_py()), at, early, late, least)))
            yield _batch(out, names)

    return rows.select("doc_id", "text", "at", "early", "late").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def window_matches(found: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, at, low, high, others, earliest) of the places with a window that occurs elsewhere.

    ``earliest`` is the smallest id of all documents with one of these windows. The windows of a place overlap, so their
    union is one span. A wording met once is dropped by an aggregation before the join; a common one is split by it.
    """
    place = F.struct("doc_id", "start")
    several = found.groupBy("near", "digest").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter(
        "first <> last").select("near", "digest", "first", F.col("last.doc_id").alias("last_doc"))
    return found.join(several, ["near", "digest"]).groupBy("doc_id", "at").agg(
        F.min("start").alias("low"), (F.max("start") + least).alias("high"),
        F.collect_set(F.when(place == F.col("first"), F.col("last_doc")).otherwise(F.col("first.doc_id"))).alias("others"),
        F.min("first.doc_id").alias("earliest"))


def repeated_passages(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start_word, n_words, other_docs, has_earlier: passages of at least ``least`` words that occur elsewhere.

    Words are split at ASCII white space and compared as they are. Passages of a document that overlap are one row.
    ``other_docs`` are documents found to share a part of it (not all of those that do), ``has_earlier`` says that a
    document with a smaller id holds one of its windows of ``least`` words; removing what has an earlier occurrence
    leaves the first. ``least`` may be raised, but not below the LEAST the kept places are made for. Null, empty and
    shorter texts have none, and so have rows without an id. Repeated rows of one id are one document. Extra columns are left out; no rows give no rows.
    """
    if least < LEAST:
        raise ValueError(f"passages shorter than {LEAST} words are not searched for")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter(
        "doc_id IS NOT NULL")
    table = saved(suffix_table(texts, least), "suffixes")
    place = F.struct("doc_id", "at")
    kinds = saved(table.groupBy("near", "around").agg(
        F.min(place).alias("first"), F.max(place).alias("last"),
        *[F.first(c).alias(c) for c in ("before", "after", "early", "late")]), "suffix-kinds")
    several = kinds.groupBy("near").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("near")
    places = saved(kinds.join(several, "near").select("first.doc_id", "first.at", "early", "late"), "suffix-places")
    found = saved(window_matches(saved(windows(texts, places, least), "suffix-windows"), least), "suffix-matches")
    # what the first place of a kind shares with other kinds, the other places of the kind share as well
    alike = kinds.filter("first <> last").join(
        found.select(F.struct("doc_id", "at").alias("first"), F.col("earliest").alias("elsewhere")), "first", "left").select(
        "near", "around", "first", "last", F.least("first.doc_id", "elsewhere").alias("earliest"))
    settled = table.join(alike, ["near", "around"]).select(
        "doc_id", (F.col("at") - F.col("before")).alias("low"), (F.col("at") + F.col("after")).alias("high"),
        F.array_compact(F.array(
            F.when(place == F.col("first"), F.col("last.doc_id")).otherwise(F.col("first.doc_id")),
            F.when(F.col("earliest") < F.col("doc_id"), F.col("earliest")))).alias("others"), "earliest")
    spans = settled.unionByName(found.drop("at")).groupBy("doc_id", "low", "high").agg(
        F.array_distinct(F.flatten(F.collect_list("others"))).alias("others"), F.min("earliest").alias("earliest"))
    before = Window.partitionBy("doc_id").orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("doc_id").orderBy("low", "high").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.when(F.col("low") < F.max("high").over(before), 0).otherwise(1)
    islands = spans.withColumn("opened", opened).withColumn("island", F.sum("opened").over(upto))
    return islands.groupBy("doc_id", "island").agg(
        F.min("low").alias("start_word"), (F.max("high") - F.min("low")).alias("n_words"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("others")))).alias("other_docs"),
        F.min("earliest").alias("earliest")).select(
        "doc_id", "start_word", "n_words", "other_docs", (F.col("earliest") < F.col("doc_id")).alias("has_earlier"))
