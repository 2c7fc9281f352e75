"""Packing documents into training sequences with bounded-space online best-fit.

Each partition keeps a fixed number of open windows. A document's full windows are sequences at once; what remains of
it goes to the open window that it leaves the least room in. When none has room and no further window may be opened,
the fullest is emitted as it is. Windows still open at the end of a partition are merged: first over a few partitions,
then, as each merge leaves less than one window, over thousands, until one task closes the rest. Merging may cut
pieces, so it fills every sequence; the last tokens become sequences whose lengths are powers of two.

Only open windows are held in memory and only they are moved, so the cost of merging follows the number of partitions.
"""

from __future__ import annotations

import bisect
import operator
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from bladewatch.llm.common import stored

WINDOW = 4096
OPEN_WINDOWS = 64
END_ID = 2
MERGED_AT_FIRST, MERGED_LATER = 16, 4096  # partitions whose open windows one task merges
CACHED_WORDS = 800_000  # words and their pieces, in one cache
_OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, sequence long, offset long, " \
       "closed boolean, ids binary"
_NAMES = [c.split()[0] for c in _OUT.split(", ")]
_TYPES = [*[pa.int64()] * 8, pa.bool_(), pa.binary()]
_SPLIT = re.compile(r"[\t-\r ]+")
_NOT_WHITE = re.compile(r"[\x1c-\x1f]")  # white space to Python, not to the tokenizer
_caches: dict[str, "_Words"] = {}


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_letters() -> dict[int, int]:
    """Byte-level models write each byte as a letter: printable ones of Latin-1 as themselves, the rest from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in plain)}


_LETTERS = _byte_letters()
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
# Fixed value: how the tokenizer's file splits words after lower-casing them.
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

_TOKEN_ID = operator.attrgetter("id")
_PACKERS = [struct.Struct(f"<{n}I").pack for n in range(16)]


class _Words(dict):
    """Ids of words, and of the pieces of words, as little-endian 32-bit bytes.

    Words of Latin letters are split into pieces, whose ids come from the model, and most pieces are words as well. All
    other words, and those that could hold a special token, go through the tokenizer. At most CACHED_WORDS are held: when
    half of them are in, they become the older ones, and those before them go, so a word that is met again and again stays.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = _tokenizer(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED_WORDS // 2:
            self.older = dict(self)
            self.clear()
        value = self.older.get(word)
        if value is None:
            value = self.ids(word)
        self[word] = value
        return value

    def ids(self, word: str) -> bytes:
        if word.isascii() and word.isalpha() and word.islower():  # most of them
            return _packed([*map(_TOKEN_ID, self.tokenize(word))])
        if (word.isascii() or max(word) < "\u0250") and "<|" not in word and not _NOT_WHITE.search(word):
            lower = word.lower()
            if lower.isascii() or max(lower) < "\u0250":
                if lower.isalpha():  # the usual shapes, which need no pattern
                    return self.piece(lower) if lower == word else self[lower]
                letters = lower.rstrip(_MARKS)
                if letters.isalpha():
                    return self[letters] + self.mark(lower[len(letters):])
                return b"".join(self[p] if p.isalpha() else self.mark(p) for p in _PIECE.findall(lower))
        return _packed(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def mark(self, text: str) -> bytes:  # few of them differ
        key = " " + text  # no word
        if key not in self:
            self[key] = self.piece(text)
        return self[key]

    def piece(self, text: str) -> bytes:
        letters = text if text.isascii() else text.encode().decode("latin-1").translate(_LETTERS)
        return _packed([*map(_TOKEN_ID, self.tokenize(letters))])


def _packed(ids: list[int]) -> bytes:
    return _PACKERS[len(ids)](*ids) if len(ids) < len(_PACKERS) else struct.pack(f"<{len(ids)}I", *ids)


def _lowered(text: str) -> str:
    """The text in lower case where that changes no id, so that a word has fewer forms: the tokenizer lower-cases as well,
    and Latin-1 letters do so alone; special tokens are looked for before."""
    if "<|" in text:
        return text
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


def word_encoder(path: str) -> Callable[[str], bytes]:
    """Encodes a text to little-endian 32-bit ids, word by word.

    For a tokenizer that drops white space and never merges across it, the ids of a text are those of its words one
    after the other. Words repeat, so their ids are cached while the worker lives.
    """
    if path not in _caches:
        _caches[path] = _Words(path)
    lookup = _caches[path].__getitem__

    def encode(text: str) -> bytes:
        text = _lowered(text)
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # the quickest way to look for _NOT_WHITE
            return b"".join(map(lookup, (w for w in _SPLIT.split(text) if w)))
        return b"".join(map(lookup, text.split()))

    return encode


class _Row:
    """Collects result rows in columns."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def add(self, sequence: int, part: int, pieces: list[tuple], closed: bool) -> None:
        offset = 0
        for doc, start, ids, tokens in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), tokens, part, sequence, offset, closed, None if closed else ids))
            offset += n

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


class _Windows:
    """Open windows of one partition, ordered by the room left in them."""

    def __init__(self, window: int, most: int) -> None:
        self.window, self.most = window, most
        self.open: list[tuple[int, int]] = []  # (room, number)
        self.pieces: dict[int, list[tuple]] = {}
        self.next = 0

    def number(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, piece: tuple) -> Iterator[tuple[int, list[tuple]]]:
        """Puts a piece shorter than a window away; gives the window that this closes, if any."""
        need = len(piece[2]) // 4
        at = bisect.bisect_left(self.open, (need, -1))
        if at < len(self.open):
            room, number = self.open.pop(at)
        else:
            if len(self.open) >= self.most:
                _, fullest = self.open.pop(0)
                yield fullest, self.pieces.pop(fullest)
            room, number = self.window, self.number()
            self.pieces[number] = []
        self.pieces[number].append(piece)
        if room == need:
            yield number, self.pieces.pop(number)
        else:
            bisect.insort(self.open, (room - need, number))


def _pack(path: str, window: int, most: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, out, part = _Windows(window, most), _Row(), 0
        encode, end = word_encoder(path), struct.pack("<I", end_id)
        for batch in batches:
            docs = batch.column("doc_id").to_pylist()
            if docs:
                part = batch.column("part")[0].as_py()
            for doc, text in zip(docs, batch.column("text")):
                ids = encode(text.as_py()) + end
                tokens, size = len(ids) // 4, 4 * window
                whole = len(ids) - len(ids) % size
                for start in range(0, whole, size):
                    out.add(windows.number(), part, [(doc, start // 4, ids[start:start + size], tokens)], True)
                if whole < len(ids):
                    for number, pieces in windows.place((doc, whole // 4, ids[whole:], tokens)):
                        out.add(number, part, pieces, True)
            yield _batch(out.take())
        for _, number in windows.open:
            out.add(number, part, windows.pieces[number], False)
        yield _batch(out.take())

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], _NAMES)


def merge_pieces(pieces: list[tuple], window: int, last: bool) -> Iterator[tuple[bool, list[tuple]]]:
    """Joins pieces (doc, start, ids, tokens) one after the other and cuts the stream at full windows.

    The rest stays open, or, if ``last``, is cut into sequences of powers of two, largest first. Gives (closed, pieces).
    """
    total = sum(len(p[2]) for p in pieces) // 4
    sizes = [window] * (total // window)
    rest = total % window
    if rest:
        sizes += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1] if last else [rest]
    stream, at = iter(pieces), None
    for k, size in enumerate(sizes):
        taken, need = [], size
        while need:
            doc, start, ids, tokens = at or next(stream)
            n = min(need, len(ids) // 4)
            taken.append((doc, start, ids[:4 * n], tokens))
            at = (doc, start + n, ids[4 * n:], tokens) if 4 * n < len(ids) else None
            need -= n
        yield last or k < total // window, taken


def _merge(window: int, last: bool):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "sequence", "offset"])
        pieces = [(None if pd.isna(d) else int(d), int(s), bytes(i), int(t))
                  for d, s, i, t in zip(pdf["doc_id"], pdf["start"], pdf["ids"], pdf["doc_tokens"])]
        out = _Row()
        for number, (closed, taken) in enumerate(merge_pieces(pieces, window, last)):
            out.add(number, int(key[0]), taken, closed)
        frame = pd.DataFrame(out.take(), columns=_NAMES)
        return frame.astype({"doc_id": "Int64"})

    return run


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, open_windows: int = OPEN_WINDOWS,
         end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids followed by ``end_id``; a null or empty text is that id alone. Every id of every row lies in
    exactly one piece; rows with equal ids are packed each. Sequences are to be padded to ``window``, unless their
    length is a power of two. Extra columns are left out; no rows give no rows. The first pass is stored before its
    open windows are merged, so a lost executor cannot make the two disagree.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.spark_partition_id().cast("long").alias("part"))
    packed = stored(rows.mapInArrow(_pack(tokenizer_path, window, open_windows, end_id), _OUT))
    done, level = [_numbered(packed, 0)], 1
    parts = (packed.agg(F.max("part")).first()[0] or 0) + 1
    left = packed.filter("NOT closed")
    while True:
        group = MERGED_AT_FIRST if level == 1 else MERGED_LATER
        last = parts <= group
        merged = stored(left.groupBy(F.floor(F.col("part") / group).cast("long").alias("group")).applyInPandas(
            _merge(window, last), _OUT))
        done.append(_numbered(merged, level))
        if last:
            break
        left, parts, level = merged.filter("NOT closed"), -(-parts // group), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _numbered(rows: DataFrame, level: int) -> DataFrame:
    number = F.lit(level << 58) + F.shiftleft("part", 34) + F.col("sequence")
    return rows.filter("closed").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", number.cast("long").alias("sequence_id"), "offset")
