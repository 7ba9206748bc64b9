"""Words of whole texts with their neighbours, found in the bytes of a batch at once: what RuleSplitter and RuleTagger say of them.

Spark deals the texts and gathers what comes out; here is only the pass over one batch, for operators that need words in
millions and would spend most of their time in arrays of structs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatlas.session import ship

#: Bytes of texts that are scanned at once, if one text is not longer.
SLICE = 2_000_000
_LETTER, _END, _BLANK = 1, 2, 3
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[list(b".!?")] = _END
_KIND[[*range(9, 14), 32]] = _BLANK
#: White space beyond ASCII, as Java's \s of Unicode has it, in UTF-8.
_WIDE = [[int.from_bytes(chr(c).encode(), "big") for c in points] for points in ((0x85, 0xA0), (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))]


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of SLICE bytes of a text column, or of one row."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
        yield batch.slice(at, to - at)
        at = to


class Words:
    """The words of texts in order: row, index in the sentence, and ids in `vocabulary` (lower case; the last one is empty) of the word and its neighbours."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.string()), "")
        _, offsets, data = texts.buffers()
        edges = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        self.data = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data is not None else np.empty(0, np.uint8)
        self.edges = edges - edges[0]
        size, kind = len(self.data), _KIND[self.data]
        new_row = np.zeros(size + 1, bool)
        new_row[self.edges] = True
        starts, ends = self._runs(kind == _LETTER, new_row)
        sentence = new_row[:-1].copy()
        sentence[1:] |= (kind[:-1] == _END) & (kind[1:] != _END)
        self.sentences = np.append(np.flatnonzero(sentence), size)
        self.row = np.searchsorted(self.edges, starts, "right") - 1
        self.sentence = np.searchsorted(self.sentences, starts, "right") - 1
        letters = self.data[kind == _LETTER] | 32
        bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(letters)).dictionary_encode()
        self.ids = words.indices.to_numpy().astype(np.int64)
        self.vocabulary = pa.concat_arrays([words.dictionary, pa.array([""], pa.string())])
        n, none = len(starts), len(self.vocabulary) - 1
        first = np.ones(n, bool)
        first[1:] = self.sentence[1:] != self.sentence[:-1]
        at = np.arange(n)
        self.index = at - np.maximum.accumulate(np.where(first, at, 0)) if n else at
        self.left, self.right = np.full(n, none), np.full(n, none)
        self.left[1:] = np.where(first[1:], none, self.ids[:-1])
        self.right[:-1] = np.where(first[1:], none, self.ids[1:])

    @staticmethod
    def _runs(letter: np.ndarray, new_row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of letters; a run ends with its row."""
        start, end = letter & new_row[:-1], letter & new_row[1:]
        start[1:] |= letter[1:] & ~letter[:-1]
        start[:1] |= letter[:1]
        end[:-1] |= letter[:-1] & ~letter[1:]
        end[-1:] |= letter[-1:]
        return np.flatnonzero(start), np.flatnonzero(end) + 1

    def where(self, is_wanted: Callable[[str], bool]) -> np.ndarray:
        """The numbers of the words that are wanted."""
        return np.flatnonzero(np.array([w != "" and is_wanted(w) for w in self.vocabulary.to_pylist()], bool)[self.ids])

    def _shown(self) -> np.ndarray:
        """Places of the bytes that are no white space."""
        d = self.data
        blank = _KIND[d] == _BLANK
        for width, codes in enumerate(_WIDE, 2):
            at = np.flatnonzero((d >= (0xC2, 0xE1)[width - 2]) & (d <= (0xC2, 0xE3)[width - 2]))
            at = at[at + width <= len(d)]
            code = sum(d[at + i].astype(np.int64) << 8 * (width - 1 - i) for i in range(width))
            at = at[np.isin(code, codes)]
            for i in range(width):
                blank[at + i] = True
        return np.flatnonzero(~blank)

    def spans(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the sentences of some words: where they begin in their text, in characters; first byte and end of what is not white space at their edges."""
        shown, of = self._shown(), self.sentence[words]
        begin = shown[np.searchsorted(shown, self.sentences[of])] if len(of) else of
        end = shown[np.searchsorted(shown, self.sentences[of + 1]) - 1] + 1 if len(of) else of
        chars = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])
        return chars[begin] - chars[self.edges[self.row[words]]], begin, end


#: Bits (as a power of two) of marks, at least and at most: 128 KB to 16 MB.
LEAST_BITS, MOST_BITS = 20, 27


def _places(hashes: list[np.ndarray], bits: int) -> np.ndarray:
    """The bit of each key, from its columns' hashes."""
    mixed = np.zeros(len(hashes[0]), np.uint64)
    for h in hashes:
        mixed = (mixed ^ h) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - MOST_BITS) & np.uint64((1 << bits) - 1)


def _hashes(words: pa.Array) -> np.ndarray:
    """A number for each word (null: as the empty one), from its bytes and their places."""
    words = pc.fill_null(words, "")
    _, offsets, data = words.buffers()
    edges = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    size, out = np.diff(edges), np.zeros(len(words), np.uint64)
    there = np.flatnonzero(size)
    if len(there):
        own = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]].astype(np.uint64)
        place = np.arange(len(own)) - np.repeat(edges[:-1] - edges[0], size)
        powers = np.cumprod(np.full(int(size.max()), 0x100000001B3, np.uint64), dtype=np.uint64)
        out[there] = np.add.reduceat((own + np.uint64(1)) * powers[place], edges[there] - edges[0])
    return out


def _marks(place: np.ndarray) -> pa.RecordBatch:
    """Bits by words of 64: word, marks."""
    place = np.unique(place)
    word, first = np.unique(place >> np.uint64(6), return_index=True)
    marks = np.bitwise_or.reduceat(np.uint64(1) << (place & np.uint64(63)), first) if len(first) else place
    return pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(marks.view(np.int64))], ["word", "marks"])


def _sent(rows: DataFrame) -> tuple[Broadcast, int]:
    """Marks (word, marks of all tasks) for all workers, folded as long as there are 16 bits for each, and their bits."""
    found = rows.groupBy("word").agg(F.bit_or("marks").alias("marks")).toArrow()
    bits, table = MOST_BITS, np.zeros(1 << (MOST_BITS - 6), np.uint64)
    table[found.column("word").to_numpy()] = found.column("marks").to_numpy().view(np.uint64)
    n = int(np.bitwise_count(table).sum())
    while bits > LEAST_BITS and n * 32 <= 1 << bits:
        half = len(table) // 2
        bits, table = bits - 1, table[:half] | table[half:]
    return rows.sparkSession.sparkContext.broadcast(table), bits


def marked(wanted: DataFrame, keys: list[str]) -> tuple[Broadcast, int]:
    """Marks of the keys in a table, for trigram_counts."""
    ship(wanted.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _marks(_places([_hashes(c) for c in batch.columns], MOST_BITS))

    return _sent(wanted.select(*keys).mapInArrow(work, "word long, marks long"))


def marked_in_texts(docs: DataFrame, text_col: str, is_wanted: Callable[[str], bool]) -> tuple[Broadcast, int]:
    """Marks of what stands left and right of those words of texts that are wanted."""
    ship(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                found = Words(part.column(0))
                at = found.where(is_wanted)
                h = _hashes(found.vocabulary)
                yield _marks(_places([h[found.left[at]], h[found.right[at]]], MOST_BITS))

    return _sent(docs.select(text_col).mapInArrow(work, "word long, marks long"))


def trigram_counts(docs: DataFrame, text_col: str, keys: list[str], marks: tuple[Broadcast, int] | None) -> DataFrame:
    """keys (of left, right), word, c: how often the words of texts stand between these, counted by slices, so that rows may repeat.

    Keys without a mark are left out.
    """
    ship(docs.sparkSession)
    columns = [*keys, "word"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                found = Words(part.column(0))
                ids = [getattr(found, k) for k in keys]
                if marks:
                    own, bits = marks
                    h = _hashes(found.vocabulary)
                    place = _places([h[i] for i in ids], bits)
                    there = (own.value[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1)
                    at = np.flatnonzero(there)
                else:
                    at = np.arange(len(found.ids))
                size, (code, *more) = len(found.vocabulary), [i[at] for i in [*ids, found.ids]]
                for i in more:
                    if size > 1_000_000:  # numbers as small as there are keys, so that the next column has room
                        code = np.unique(code, return_inverse=True)[1]
                    code = code * size + i
                code, first, n = np.unique(code, return_index=True, return_counts=True)
                first = at[first]
                yield pa.RecordBatch.from_arrays([*(found.vocabulary.take(pa.array(i[first])) for i in [*ids, found.ids]), pa.array(n.astype(np.int64))], [*columns, "c"])

    return docs.select(text_col).mapInArrow(work, f"{', '.join(f'{c} string' for c in columns)}, c long")


#: Bytes of sentences that leave a worker at once, if one sentence is not longer.
_SENTENCE_BYTES = 8_000_000


def word_rows(docs: DataFrame, keys: list[str], text_col: str, is_wanted: Callable[[str], bool], sentence: bool = False) -> DataFrame:
    """keys, sent_start, token_index, surface_lower, left, right (and the sentence) of each word that is wanted, which is asked once for each distinct word of a slice."""
    ship(docs.sparkSession)
    given = docs.select(*keys, text_col)
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in given.schema[:-1]]
    n, names = len(keys), [*keys, "sent_start", "token_index", "surface_lower", "left", "right", *(["sentence"] if sentence else [])]
    more = ["sent_start long", "token_index int", "surface_lower string", "left string", "right string", *(["sentence string"] if sentence else [])]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, n):
                found = Words(part.column(n))
                at = found.where(is_wanted)
                start, begin, end = found.spans(at)
                cut = np.flatnonzero(np.diff(np.cumsum(end - begin) // _SENTENCE_BYTES)) + 1 if sentence else []
                for some in np.split(np.arange(len(at)), cut):
                    w = at[some]
                    rows = pa.array(found.row[w])
                    words = [found.vocabulary.take(pa.array(x[w])) for x in (found.ids, found.left, found.right)]
                    cells = [*(c.take(rows) for c in part.columns[:n]), pa.array(start[some]), pa.array(found.index[w].astype(np.int32)), *words]
                    if sentence:
                        cells.append(pa.array([found.data[a:b].tobytes().decode() for a, b in zip(begin[some], end[some], strict=True)], pa.string()))
                    yield pa.RecordBatch.from_arrays(cells, names)

    return given.mapInArrow(work, ", ".join(kinds + more))
