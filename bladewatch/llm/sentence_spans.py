"""Repeated passages by sliding spans of consecutive sentences.

From every sentence on, and up to every sentence, the shortest run of at least RUN sentences with enough characters is
hashed, and so is every sentence of LONG_WORDS words by itself. The first occurrence of a span, by document and place,
stays, and sentences covered by any other occurrence go.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from bladewatch.llm.common import let, own_row, saved

RUN = 2
LEAST_CHARS = 100  # of a span; two sentences of one common line often have fewer
SPANS_HELD = 10_000  # of one batch before they go out, some 2 MB; workers share what the JVM leaves of an executor
LONG_WORDS = 50  # a sentence of so many words is a span of its own
# between sentences: white space after sentence punctuation, or a line end with the white space around it
BREAK = r"(?<=[.!?])[\x20\x09-\x0D]+|[\x20\x09\x0D]*\n[\x20\x09-\x0D]*"
WHITE = " \t\n\x0b\x0c\r"
_DOC = ("_sp_id", "_sp_text")


def _trimmed(text: Column) -> Column:  # as str.strip(WHITE)
    return F.trim(F.coalesce(text, F.lit("")), F.lit(WHITE))


def sentences(text: Column) -> Column:
    """The sentences without the white space around them; one empty sentence for a blank or null text."""
    return F.split(_trimmed(text), BREAK)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A document is an id and a text digest: repeated rows are one document, equal ids with other texts are not."""
    return docs.withColumns({
        "_sp_id": F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))), "_sp_text": F.xxhash64(text_col)})


_BREAK = re.compile(BREAK)


def span_places(sentences_: list[str], run: int = RUN, least_chars: int = LEAST_CHARS) -> list[tuple[int, int]]:
    """(at, n) of the spans of one document, each once.

    Running sums of lengths give the end of the shortest run from every sentence on, and the beginning of the
    shortest one up to every sentence.
    """
    m = len(sentences_)
    sizes = np.fromiter(map(len, sentences_), np.int64, m)
    past = np.r_[0, np.cumsum(sizes + 1)]  # characters before a sentence, with one between two
    at = np.arange(m)
    end = np.maximum(np.searchsorted(past, past[:-1] + least_chars + 1), at + run)
    begin = np.minimum(np.searchsorted(past, past[1:] - least_chars - 1, "right") - 1, at + 1 - run)
    found = set(zip(at[end <= m].tolist(), (end - at)[end <= m].tolist()))
    found.update(zip(begin[begin >= 0].tolist(), (at + 1 - begin)[begin >= 0].tolist()))
    for k in np.flatnonzero(sizes >= 2 * LONG_WORDS - 1).tolist():
        if len(sentences_[k].encode().split()) >= LONG_WORDS:
            found.add((k, 1))
    return sorted(found)


def spans(docs: DataFrame, run: int = RUN, least_chars: int = LEAST_CHARS, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """(_sp_id, _sp_text, at, n, key): one row per span of ``n`` sentences from ``at`` on; ``key`` is 128 bits of its
    wording, a digest of the digests of its sentences."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, places, sizes, keys = [], [], [], []
            for k, text in enumerate(batch.column(2)):
                said = _BREAK.split(text.as_py().strip(WHITE))
                if len(said) < run and len(said[0]) < 2 * LONG_WORDS - 1:
                    continue
                own = [xxhash.xxh3_128_digest(x.encode()) for x in said]
                for at, n in span_places(said, run, least_chars):
                    of.append(k)
                    places.append(at)
                    sizes.append(n)
                    keys.append(xxhash.xxh3_128_digest(b"".join(own[at:at + n])))
                if len(of) >= SPANS_HELD:
                    yield rows_of(batch, of, places, sizes, keys)
                    of, places, sizes, keys = [], [], [], []
            yield rows_of(batch, of, places, sizes, keys)

    def rows_of(batch: pa.RecordBatch, of: list, at: list, n: list, key: list) -> pa.RecordBatch:
        of = pa.array(of, pa.int32())
        return pa.RecordBatch.from_arrays([
            batch.column(0).take(of), batch.column(1).take(of), pa.array(at, pa.int32()), pa.array(n, pa.int32()),
            pa.array(key, pa.binary())], [*_DOC, "at", "n", "key"])

    texts = _keyed(docs.select(id_col, text_col), id_col, text_col).select(*_DOC, F.col(text_col).alias("text"))
    return texts.filter(F.length("text") > 0).mapInArrow(hashed, "_sp_id long, _sp_text long, at int, n int, key binary")


def repeated(docs: DataFrame, run: int = RUN, least_chars: int = LEAST_CHARS, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """(_sp_id, _sp_text, at, n, first_id): spans that are not the first occurrence of their wording.

    First occurrences come from a pre-aggregated minimum per key; keys met once are dropped. What is left is written, so
    that the join is one of two plain exchanges, of which the adaptive join splits the rows of a very common passage.
    """
    all_spans = spans(docs, run, least_chars, id_col, text_col)
    place = F.struct(*_DOC, "at")
    first = all_spans.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter(
        "first <> last").drop("last")
    return all_spans.join(saved(first, "first-spans"), "key").filter(place != F.col("first")).select(
        *_DOC, "at", "n", F.col("first._sp_id").alias("first_id"))


def removals(docs: DataFrame, run: int = RUN, least_chars: int = LEAST_CHARS, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """One row per document that loses sentences: (_sp_id, _sp_text, removed, first_ids).

    ``removed`` are the places of its covered sentences, ``first_ids`` the documents where their wording comes first.
    Both are bounded by the document's own sentences.
    """
    covered = F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)
    return repeated(docs, run, least_chars, id_col, text_col).withColumn("s", F.explode(covered)).groupBy(*_DOC).agg(
        F.sort_array(F.collect_set("s")).alias("removed"), F.sort_array(F.collect_set("first_id")).alias("first_ids"))


def repeated_passages(docs: DataFrame, run: int = RUN, least_chars: int = LEAST_CHARS, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """doc_id, n_removed, removed, first_docs of every document that repeats a passage found earlier.

    Null and empty texts have no spans. Repeated rows (equal id and text) are one document, with one result. A
    null id comes before all others. Extra columns are left out; no rows give no rows.
    """
    no_id = F.lit(-(1 << 63))
    return removals(docs, run, least_chars, id_col, text_col).select(
        F.nullif("_sp_id", no_id).alias("doc_id"), F.size("removed").cast("long").alias("n_removed"), "removed",
        F.filter("first_ids", lambda x: x != no_id).alias("first_docs"))


def without_repeats(docs: DataFrame, run: int = RUN, least_chars: int = LEAST_CHARS, id_col: str = "doc_id",
                    text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """All documents, with their own columns, whatever their names, and without the repeated sentences; the rest keeps its
    white space.

    ``n_chars``, if there is one, is counted anew where the text changed. A document left without any word is dropped;
    one that had none before stays.
    """
    keyed = _keyed(docs.select(own_row(docs, "_sp_row"), F.col(id_col).alias("_sp_doc"), F.col(text_col).alias("_sp_said")),
                   "_sp_doc", "_sp_said")
    marked = keyed.join(removals(docs, run, least_chars, id_col, text_col), list(_DOC), "left")
    said, row, changed = F.col("_sp_said"), F.col("_sp_row"), F.col("removed").isNotNull()
    between = F.regexp_extract_all(_trimmed(said), F.lit(BREAK), F.lit(0))
    kept = let(sentences(said), lambda s: let(between, lambda b: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(s) - 1), F.col("removed")),
        lambda i: F.concat(F.get(s, i), F.coalesce(F.get(b, i), F.lit("")))), "")))
    out = marked.withColumn("_sp_said", F.when(changed, F.trim(kept, F.lit(WHITE))).otherwise(said))
    out = out.filter(~changed | said.rlike(r"[^\x20\x09-\x0D]"))
    new = {text_col: said}
    if chars_col in docs.columns:
        new[chars_col] = F.when(changed, F.length(said).cast("long")).otherwise(row[chars_col])
    return out.select(*[new.get(c, row[c]).alias(c) for c in docs.columns])
