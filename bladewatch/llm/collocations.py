"""Phrases whose words occur together far more often than by chance.

Only the longest windows are counted: lead columns of words, padded at the end of a piece. A task sums its own windows
before they are shuffled. Counts of all shorter phrases are sums over successively shorter prefixes of the windows,
which Spark's ROLLUP takes; no shorter phrase is ever listed by itself. Windows end before a rare word, of which no phrase
can be made, and before they are rolled up those too rare for a phrase give up their last words: neither changes a count
that a phrase needs, and little is left to roll up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from bladewatch.llm.common import saved

LONGEST = 3
LEAST = 10
TOP = 2000
SUBSUMED = 50  # percent of a phrase's occurrences that lie in one longer phrase
NO_LANG = "und"
CHUNK_CHARS = 8_000_000  # that a task counts at once
SAMPLE_DOCS = 2_000  # documents that tell which windows begin alike too often for one task; results don't depend on them
HOT_SHARE = 1 / 500
SALTS = 64
FILTER_BITS = 1 << 25  # of the filter of frequent words: 4 MB are broadcast
PARTS = 1024  # of the filter, each made by itself
CELLS = 1 << 20  # that windows are dealt to; a task takes many
_MIX = np.uint64(0x9E3779B97F4A7C15)
# bytes of a text: A-Z lower case, all marks that end a piece to line ends
_PLAIN = bytes(0x0A if c in b".,;:!?" or 0x0A <= c <= 0x0D else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col), F.lit(NO_LANG)).alias("lang"), F.col(text_col).alias("text")).filter(
        F.length("text") > 0)


def _pieces(texts: list[str], pads: int) -> list[bytes]:
    """The words of all pieces, with empty pads after each piece."""
    words, ends = [], [b""] * pads
    for text in texts:
        for piece in text.encode().translate(_PLAIN).split(b"\n"):
            if piece := piece.split():  # at spaces and tabs; all other white space ends a piece
                words += piece
                words += ends
    return words


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[str, list[str]]]:
    """The texts of a language, so many at a time that their characters stay near CHUNK_CHARS."""
    held, chars = {}, 0
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        held.setdefault(lang, []).append(text)
        chars += len(text)
        if chars >= CHUNK_CHARS:
            yield from held.items()
            held, chars = {}, 0
    yield from held.items()


def _hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh32_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def frequent_words(texts: DataFrame, least: int) -> np.ndarray:
    """A bit for each hash of a language and a word, set if words of that hash are found ``least`` times or more.

    It has FILTER_BITS bits whatever the words. A rare word that shares a bit with a frequent one counts as frequent, which
    costs rows and changes no result: so the filter is always right, and the less use the fuller it is.
    """
    width = FILTER_BITS // PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, chunk in _chunks(batch):
                column = pa.array(_pieces(chunk, 0), pa.binary()).dictionary_encode()
                n = np.bincount(column.indices.to_numpy(), minlength=len(column.dictionary)) if len(column) else np.zeros(0, int)
                bits = _hashes(lang, column.dictionary.to_pylist()) % np.uint64(FILTER_BITS)
                yield pa.RecordBatch.from_arrays([pa.array(bits.astype(np.int64)), pa.array(n.astype(np.int64))], ["bit", "n"])

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            bits = batch.column("bit").to_numpy()
            for part in np.unique(bits // width).tolist():
                found.setdefault(part, np.zeros(width, bool))[bits[bits // width == part] % width] = True
        yield pa.RecordBatch.from_arrays([
            pa.array(list(found), pa.int32()), pa.array([np.packbits(b).tobytes() for b in found.values()], pa.binary())],
            ["part", "bits"])

    often = texts.mapInArrow(count, "bit long, n long").groupBy("bit").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    rows = often.select("bit").repartition(F.floor(F.col("bit") / F.lit(width))).mapInArrow(set_bits, "part int, bits binary")
    out = np.zeros((PARTS, width // 8), np.uint8)
    for r in rows.collect():
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def _windows(words: list[bytes], order: int, rare) -> tuple[pa.Array, np.ndarray, list[np.ndarray], np.ndarray]:
    """(all words, their hashes, the words of each different window by column, its count).

    A window ends before a piece's end and before its first rare word; what it lacks are pads.
    """
    column = pa.array(words, pa.binary()).dictionary_encode()
    names, codes = column.dictionary, column.indices.to_numpy().astype(np.int64)
    pad = codes[-1]
    hashes, dropped = rare(names.to_pylist())
    dropped[pad] = True
    codes = np.where(dropped[codes], pad, codes) if dropped.sum() > 1 else codes
    real = column.indices.to_numpy() != pad
    parts = [np.r_[codes[k:], np.full(k, pad)][real] for k in range(order)]
    for k in range(1, order):
        parts[k] = np.where(parts[k - 1] == pad, pad, parts[k])
    key = parts[0]
    for x in parts[1:]:
        if int(key.max(initial=0)) >= (1 << 62) // len(names):  # codes of prefixes instead of the prefixes
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(names) + x
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    return names, hashes, [x[first] for x in parts], n


def windows(texts: DataFrame, order: int, frequent: np.ndarray | None = None, hot: frozenset = frozenset()) -> DataFrame:
    """(cell, lang, window, n): windows with their counts in one chunk of a task.

    ``window`` joins words by spaces, which no word holds; pads are empty. Windows that begin alike (all words but the last)
    have one cell; those of a ``hot`` beginning (lang, words) are spread over SALTS cells by their last word.
    """
    context = texts.sparkSession.sparkContext
    held = context.broadcast(np.full(FILTER_BITS // 8, 255, np.uint8) if frequent is None else frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, chunk in _chunks(batch):
                words = _pieces(chunk, order - 1)
                if not words:
                    continue

                def rare(names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
                    hashes = _hashes(lang, names)
                    bit = hashes % np.uint64(FILTER_BITS)
                    at = (bit >> np.uint64(3)).astype(np.int64)
                    return hashes, ((held.value[at] >> (np.uint8(7) - (bit & np.uint64(7)).astype(np.uint8))) & 1) == 0

                names, hashes, parts, n = _windows(words, order, rare)
                cell = np.full(len(n), xxhash.xxh64_intdigest(lang.encode()), np.uint64)
                for x in parts[:-1]:
                    cell = (cell ^ hashes[x]) * _MIX
                    cell ^= cell >> np.uint64(29)
                names = names.cast(pa.string())
                by_column = [pc.take(names, pa.array(x)) for x in parts]
                if own := sorted(h for l, h in hot if l == lang):
                    head = pc.binary_join_element_wise(*by_column[:-1], " ")
                    often = pc.is_in(head, value_set=pa.array(own, pa.string())).to_numpy(zero_copy_only=False)
                    cell = np.where(often, cell + hashes[parts[-1]] % np.uint64(SALTS), cell)
                yield pa.RecordBatch.from_arrays([
                    pa.array((cell % np.uint64(CELLS)).astype(np.int32)), pa.array([lang] * len(n), pa.string()),
                    pc.binary_join_element_wise(*by_column, " "), pa.array(n, pa.int64())], ["cell", "lang", "window", "n"])

    return texts.mapInArrow(run, "cell int, lang string, window string, n long")


def hot_heads(texts: DataFrame, order: int) -> frozenset:
    """Beginnings (lang, words) with more than HOT_SHARE of the windows of a bounded sample: at most 1 / HOT_SHARE of them.

    They only say how rows are dealt to tasks: every count is taken over all documents.
    """
    rows = texts.count()
    sample = texts.sample(min(1.0, SAMPLE_DOCS / max(rows, 1)), seed=7)
    head = F.substring_index("window", " ", order - 1).alias("head")
    seen = saved(windows(sample, order).groupBy("lang", head).agg(F.sum("n").alias("n")), "window-sample")
    total = seen.agg(F.sum("n")).first()[0] or 0
    return frozenset((r["lang"], r["head"]) for r in seen.filter(F.col("n") > max(1.0, total * HOT_SHARE)).collect())


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, text_col: str = "text",
                  lang_col: str = "lang") -> DataFrame:
    """(lang, size, phrase, f): every phrase of up to ``longest`` words found ``least`` times or more, with its count;
    size 0 holds all words of the language."""
    spark = docs.sparkSession
    texts = _texts(docs, text_col, lang_col)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    hot = hot_heads(texts, longest)
    counted = windows(texts, longest, frequent_words(texts, least), hot).repartition(parts, "cell").groupBy(
        "cell", "lang", "window").agg(F.sum("n").alias("n"))
    # whole windows are complete now: the rare ones lose their last word
    head = F.substring_index("window", " ", longest - 1)
    cut = counted.withColumn("window", F.when(F.col("n") >= least, F.col("window")).otherwise(F.concat(head, F.lit(" ")))).groupBy(
        "cell", "lang", "window").agg(F.sum("n").alias("n"))
    if longest > 2:  # so are beginnings, unless spread: the rare ones lose their last word, too
        cut = cut.withColumn("head", head)
        spread = F.concat_ws(" ", "head", "lang").isin(*(f"{h} {lang}" for lang, h in hot))
        often = (F.sum("n").over(Window.partitionBy("cell", "lang", "head")) >= least) | spread
        cut = cut.withColumn("window", F.when(often, F.col("window")).otherwise(
            F.concat(F.substring_index("head", " ", longest - 2), F.lit("  "))))
    names = [f"w{k}" for k in range(1, longest + 1)]
    words = F.split("window", " ", longest)
    folded = cut.groupBy("lang", "window").agg(F.sum("n").alias("n")).select(
        "lang", *(words[k].alias(c) for k, c in enumerate(names)), "n")
    rolled = folded.rollup("lang", *names).agg(F.sum("n").alias("f"))
    size = sum((F.col(c).isNotNull().cast("int") for c in names), F.lit(0))
    whole = ~F.coalesce(F.greatest(*(F.col(c) == "" for c in names)), F.lit(False))  # a prefix that ends in a pad is a shorter one
    return rolled.filter(F.col("lang").isNotNull() & whole).withColumn("size", size).filter(
        (F.col("size") == 0) | (F.col("f") >= least)).select("lang", "size", F.concat_ws(" ", *names).alias("phrase"), "f")


def _exact(column: str) -> Column:
    return F.col(column).cast("decimal(15,0)")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, text_col: str = "text",
                 lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases of 2 to ``longest`` words.

    A phrase's score is the lowest over its cuts in two of floor(10^6 a^2 / (l r)), in decimals that hold the products of
    counts up to 10^15. Phrases that a longer one holds for at least half of their occurrences are dropped. A null
    language is ``und``. Null, empty and blank texts hold no words. Repeated rows count each. Very long texts are read
    whole. Equal scores and counts are ordered by the phrase's bytes. Extra columns are left out; no rows give no rows.
    """
    f = saved(phrase_counts(docs, longest, least, text_col, lang_col), "phrases")
    found = f.filter("size >= 2").select("lang", "size", "phrase", F.col("f").alias("a"))
    k = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    cuts = found.select("lang", "size", "phrase", "a", k).withColumns({
        "left": F.expr("substring_index(phrase, ' ', k)"), "right": F.expr("substring_index(phrase, ' ', k - size)")})
    first = f.filter("size >= 1").select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    rest = f.filter("size >= 1").select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    scored = cuts.join(first, ["lang", "left"]).join(rest, ["lang", "right"]).withColumns(
        {"a_": _exact("a"), "l_": _exact("l"), "r_": _exact("r")}).withColumn(
        "score", F.expr("(a_ * a_ * 1000000BD) div (l_ * r_)")).groupBy("lang", "size", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("c"))
    # words from ``i`` on, ``m`` of them, of each longer phrase
    inner = found.filter("size > 2").select("lang", F.col("a").alias("held"), F.split("phrase", " ").alias("w"), "size").select(
        "lang", "held", "w", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m")).select(
        "lang", "held", "w", "m", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("i")).select(
        "lang", F.array_join(F.slice("w", F.col("i"), F.col("m")), " ").alias("phrase"), "held").groupBy("lang", "phrase").agg(
        F.max("held").alias("held"))
    kept = scored.join(inner, ["lang", "phrase"], "left").filter(
        F.coalesce(100 * F.col("held") < SUBSUMED * F.col("a"), F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.col("c.score").desc(), F.col("a").desc(), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    totals = f.filter("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select(
        "lang", "rank", "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), "n", F.col("c.score").alias("score"))
