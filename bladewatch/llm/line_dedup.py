"""Lines that many documents hold: dropped everywhere but in one document.

Line hashes are range-partitioned with a secondary sort by document and position, each partition streams its runs of
equal hashes, and what comes back per document is a compressed bitmap of the lines to keep, not text. A very common line
spans several partitions: the runs at a partition's edges are settled from one short summary per edge.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from bladewatch.llm.common import own_row, saved

LEAST_CHARS = 20  # code points of a line's key; shorter ones repeat by chance
LEAST_DOCS = 3
WHITE = b" \t\n\x0b\x0c\r"
NO_ID = -(1 << 63)  # stands for a null id: before all others
_KEY = ["_ld_id", "_ld_text"]
_LINE = pa.schema([
    ("high", pa.int64()), ("low", pa.int64()), ("doc", pa.int64()), ("digest", pa.int64()), ("at", pa.int32()),
    ("n_lines", pa.int32())])
_RUN = pa.schema([*_LINE, ("edge", pa.bool_()), ("docs", pa.list_(pa.int64()))])
_DDL = "high long, low long, doc long, digest long, at int, n_lines int"


def _keys(id_col: str, text_col: str) -> list[Column]:
    """Equal rows (id and text) are one document with one result; a null text is an empty one."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_ld_id"),
            F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_ld_text")]


def line_key(line: bytes, least_chars: int) -> bytes | None:
    """The line without white space at its ends, A-Z in lower case; none if it is too short."""
    key = line.strip(WHITE).lower()
    if len(key) >= 4 * least_chars or len(key) >= least_chars and len(key.decode()) >= least_chars:
        return key
    return None


def line_hashes(docs: DataFrame, least_chars: int = LEAST_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(high, low, doc, digest, at, n_lines): the 128-bit hash and the place of every line whose key is long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, rows, places, totals = [], [], [], []
            for k, text in enumerate(batch.column(2).to_pylist()):
                lines = text.encode().split(b"\n")
                for at, line in enumerate(lines):
                    key = line_key(line, least_chars)
                    if key is not None:
                        hashes.append(xxhash.xxh3_128_digest(key))
                        rows.append(k)
                        places.append(at)
                        totals.append(len(lines))
            halves = np.frombuffer(b"".join(hashes), ">i8").astype(np.int64).reshape(-1, 2)
            at_row = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([
                pa.array(halves[:, 0]), pa.array(halves[:, 1]), batch.column(0).take(at_row), batch.column(1).take(at_row),
                pa.array(places, pa.int32()), pa.array(totals, pa.int32())], schema=_LINE)

    texts = docs.select(*_keys(id_col, text_col), F.col(text_col).alias("text"))
    return texts.filter(F.length("text") >= least_chars).mapInArrow(run, _DDL)


def _runs(least_docs: int):
    """Streams sorted lines: the lines to drop, and what the first and the last run of a partition leave open.

    A run is sorted by falling document, so the first document of a run keeps the line. The first run of a partition
    may have begun before it: its lines go out as ``edge``. The last one may go on after it: its lines are settled once
    ``least_docs`` documents were seen, and are ``edge`` before. Of both, a summary names the first documents.
    """

    def rows(held: list[np.ndarray], edge: bool) -> pa.RecordBatch:
        columns = np.concatenate(held, axis=1)
        n = columns.shape[1]
        return pa.RecordBatch.from_arrays([
            *(pa.array(c, f.type) for c, f in zip(columns, _LINE)), pa.array(np.full(n, edge)),
            pa.nulls(n, _RUN.field("docs").type)], schema=_RUN)

    def summary(key: tuple, docs: list[int]) -> pa.RecordBatch:
        one = [[key[0]], [key[1]], [None], [None], [None], [None], [True], [docs]]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(one, _RUN)], schema=_RUN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, seen, waiting = None, True, [], []  # of the open run; first: it is the partition's first
        for batch in batches:
            if not batch.num_rows:
                continue
            c = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(len(_LINE))])
            new_run = np.r_[True, (c[:2, 1:] != c[:2, :-1]).any(axis=0)]
            new_doc = new_run | np.r_[True, c[2, 1:] != c[2, :-1]]
            starts = np.flatnonzero(new_run)
            ends = np.r_[starts[1:], c.shape[1]]
            common = np.add.reduceat(new_doc.astype(np.int64), starts) >= least_docs
            common[[0, -1]] = True  # these may have begun or go on in other batches
            settled, open_ = [], []
            for k in np.flatnonzero(common).tolist():
                part = c[:, starts[k]:ends[k]]
                here = tuple(part[:2, 0].tolist())
                if here != key:
                    if key is not None and first:
                        yield summary(key, seen)
                        first = False
                    key, seen, waiting = here, [], []
                for doc in part[2, new_doc[starts[k]:ends[k]]][:least_docs + 1].tolist():
                    if len(seen) < least_docs and doc not in seen:
                        seen.append(doc)
                if first:
                    open_.append(part)
                    continue
                waiting.append(part)
                if len(seen) == least_docs:
                    settled += [x[:, x[2] != seen[0]] for x in waiting]
                    waiting = []
            if settled:
                yield rows(settled, False)
            if open_:
                yield rows(open_, True)
        if key is not None:
            yield summary(key, seen)
            if waiting:
                yield rows(waiting, True)

    return run


def dropped_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(doc, digest, at, n_lines): every line to drop.

    The ranges are cut by hash, document and place, so that no line, however common, has to fit one task. Summaries are
    at most two rows a partition, which bounds the broadcast.
    """
    spark = docs.sparkSession
    order = ["high", "low", F.col("doc").desc(), "at"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    lines = line_hashes(docs, least_chars, id_col, text_col).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    runs = saved(lines.mapInArrow(_runs(least_docs), f"{_DDL}, edge boolean, docs array<long>"), "line-runs")
    edges = runs.filter("docs IS NOT NULL").groupBy("high", "low").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("docs"))), asc=False).alias("seen"))
    common = edges.filter(F.size("seen") >= least_docs).select("high", "low", F.col("seen")[0].alias("keeper"))
    at_edges = runs.filter("docs IS NULL AND edge").join(F.broadcast(common), ["high", "low"]).filter("doc <> keeper")
    place = ["doc", "digest", "at", "n_lines"]
    return runs.filter("docs IS NULL AND NOT edge").select(*place).unionByName(at_edges.select(*place))


def bitmap(n_lines: int, dropped: list[int]) -> bytes:
    """The lines to keep as one bit each, compressed."""
    keep = np.ones(n_lines, bool)
    keep[dropped] = False
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def kept_places(keep: bytes, n_lines: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n_lines))


def keep_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(_ld_id, _ld_text, n_lines, n_dropped, keep) of every document that loses lines; the others keep all of theirs.

    A line's key is the line without white space at its ends, in lower case (A-Z). Documents are told apart by id:
    rows of equal id count as one document, and each has its own bitmap by its text. A null id is one id before all
    others; a null or empty text is one empty line. Bits stand for lines, so a very long text takes an eighth of a byte a line.
    """
    lost = dropped_lines(docs, least_chars, least_docs, id_col, text_col).groupBy(
        F.col("doc").alias("_ld_id"), F.col("digest").alias("_ld_text")).agg(
        F.max("n_lines").cast("long").alias("n_lines"), F.sort_array(F.collect_set("at")).alias("dropped"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, dropped = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array([len(d) for d in dropped], pa.int64()),
                pa.array([bitmap(*x) for x in zip(n, dropped)], pa.binary())],
                ["_ld_id", "_ld_text", "n_lines", "n_dropped", "keep"])

    return lost.mapInArrow(
        run, "_ld_id long, _ld_text long, n_lines long, n_dropped long, keep binary")


def _with_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str, text_col: str) -> DataFrame:
    marked = docs.select(own_row(docs, "_ld_row"), *_keys(id_col, text_col))
    return marked.join(bitmaps.select(*_KEY, "keep", F.col("n_lines").alias("_ld_n")), _KEY, "left")


def kept_text(text: str | None, keep: bytes | None, n_lines: int | None) -> str:
    if keep is None:
        return text or ""
    lines = text.split("\n")
    return "\n".join(lines[k] for k in kept_places(keep, n_lines).tolist())


def line_digests(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row, from its bitmap and its whole text.

    No rows give no rows; extra columns are left out.
    """
    bitmaps = keep_bitmaps(docs, least_chars, least_docs, id_col, text_col)
    rows = _with_bitmaps(docs.select(id_col, text_col), bitmaps, id_col, text_col).select(
        F.col("_ld_row")[id_col].cast("long").alias("doc_id"), F.col("_ld_row")[text_col].alias("text"), "keep", "_ld_n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, dropped, digests = [], [], []
            for text, keep, n in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                kept = kept_text(text, keep, n)
                total.append(n or (text or "").count("\n") + 1)
                dropped.append(0 if keep is None else n - len(kept_places(keep, n)))
                digests.append(hashlib.sha256(kept.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(digests, pa.string())],
                ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return rows.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def without_common_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS,
                         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows with their own columns, whatever their names, the text without its dropped lines."""
    bitmaps = keep_bitmaps(docs, least_chars, least_docs, id_col, text_col)

    @F.pandas_udf("string")
    def cut(text: pd.Series, keep: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else kept_text(t, k, None if k is None else int(m))
                          for t, k, m in zip(text, keep, n)], dtype=object)

    rows = _with_bitmaps(docs, bitmaps, id_col, text_col).withColumn(
        "_ld_cut", cut(F.col("_ld_row")[text_col], "keep", "_ld_n"))
    return rows.select(*(F.col("_ld_cut").alias(c) if c == text_col else F.col("_ld_row")[c].alias(c) for c in docs.columns))
