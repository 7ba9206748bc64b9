"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is halved until a leaf is short; leaves are encoded alone, and neighbours are joined. A join
re-encodes only a window around the boundary, and the window grows until the tokens outside it
provably keep their place:

* at a *cut* no match of the splitting pattern can span the position, whatever stands around it
  (a word character followed by white space, or an ASCII change of class). Left of a cut and right of
  a cut the tokens do not depend on each other, so a window between two cuts settles the join;
* inside one long run of letters (no cut for hundreds of characters) the window is counted in tokens.
  A sequence of tokens is the encoding of its bytes if and only if each adjacent pair is the encoding
  of its own bytes, so the join is settled as soon as both pairs at the window's edges are;
* when a window would reach the ends of its node, the node is encoded anew; so it is for a splitting pattern
  other than CUT_PATTERN, as the cuts are known for that one only.

Decoding cuts the ids into leaves and concatenates their bytes up the tree.

Defined cases: null text counts as empty (no ids); rows are independent, so repeated rows, ties and
clashing extra columns have no effect: only the two named columns are read. An empty table gives an
empty table.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatlas.session import ship, table

#: The splitting pattern whose cuts are known. Fixed value.
CUT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of texts after which a worker hands on what it has encoded.
FLUSH_BYTES = 4_000_000
#: A cut lies before the matched character: see the module's text. Unassigned and control characters
#: take no part, as their class may differ between versions of Unicode.
_CUT = regex.compile(
    r"(?<=[^\s\p{C}\p{Z}])[ \t\n\r\f\v]"
    r"|(?<=[A-Za-z])[0-9!-/:-@\[-`{-~]"
    r"|(?<=[0-9])[A-Za-z!-/:-@\[-`{-~]"
    r"|(?<=[!-&(-/:-@\[-`{-~])[A-Za-z0-9]"
    r"|(?<=[一-龥])[、。！，：；？]"
    r"|(?<=[、。！，：；？])[一-龥]"
)
_LETTERS = regex.compile(r"\p{L}+")
_CODECS: dict[tuple, BpeCodec] = {}


class BpeCodec:
    """Encodes and decodes whole texts by a file of ranks and a splitting pattern."""

    _cuts = True

    def __init__(self, rank_path: str, pattern: str, leaf_chars: int = 2048, leaf_ids: int = 4096):
        if leaf_chars < 2 or leaf_ids < 1:
            raise ValueError("leaf_chars must be 2 at least and leaf_ids 1")
        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self._base = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._leaf, self._leaf_ids = leaf_chars, leaf_ids
        self._cuts = pattern == CUT_PATTERN

    # -- encoding -----------------------------------------------------------------------------
    def encode(self, text: str | None) -> list[int]:
        return self._node(text, 0, len(text)) if text else []

    def _node(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self._leaf:
            return self._base.encode_ordinary(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._node(text, lo, mid), self._node(text, mid, hi))

    def _join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        encode = self._base.encode_ordinary
        if not self._cuts:
            return encode(text[lo:hi])
        size = 32
        while True:
            a, b = max(lo, mid - size), min(hi, mid + size)
            if _CUT.match(text, mid) and mid > lo:
                return left + right
            before = [m.start() for m in _CUT.finditer(text, a + 1, mid)]
            after = _CUT.search(text, mid + 1, b)
            p = before[-1] if before else lo if a == lo else None
            q = after.start() if after else hi if b == hi else None
            if p is not None and q is not None:
                break
            if size >= 512:
                joined = self._join_in_run(text, lo, mid, hi, left, right)
                if joined is not None:
                    return joined
            size *= 2
        keep = len(left) - len(encode(text[p:mid]))
        skip = len(encode(text[mid:q]))
        return left[:keep] + encode(text[p:q]) + right[skip:]

    def _join_in_run(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int] | None:
        """The join inside one run of letters, or None if the run is too short for a window to settle."""
        reach, piece, of = 512, self._base._encode_single_piece, self._base.decode_single_token_bytes
        while True:
            a, b = max(lo, mid - reach), min(hi, mid + reach)
            if not _LETTERS.fullmatch(text, a, b):
                return None
            # characters take a byte at least, so a window of fewer bytes stays inside the run
            left_room, right_room = mid - a - 16, b - mid - 16
            for n in (8, 16, 32, 64, 128, 256, 512, 1024):
                if n + 1 >= len(left) or n + 1 >= len(right):
                    break
                head, tail = b"".join(map(of, left[-n - 1 :])), b"".join(map(of, right[: n + 1]))
                if len(head) >= left_room or len(tail) >= right_room:
                    break
                outer_l, outer_r = left[-n - 1], right[n]
                middle = piece(head[len(of(outer_l)) :] + tail[: len(tail) - len(of(outer_r))])
                if piece(of(outer_l) + of(middle[0])) == [outer_l, middle[0]] and piece(of(middle[-1]) + of(outer_r)) == [middle[-1], outer_r]:
                    return left[:-n] + middle + right[n:]
            if a == lo or b == hi or reach >= 8192:
                return None
            reach *= 2

    # -- decoding -----------------------------------------------------------------------------
    def decode(self, ids: list[int]) -> bytes:
        parts = [self._base.decode_bytes(ids[i : i + self._leaf_ids]) for i in range(0, len(ids), self._leaf_ids)]
        while len(parts) > 1:
            parts = [b"".join(parts[i : i + 2]) for i in range(0, len(parts), 2)]
        return parts[0] if parts else b""


def codec(rank_path: str, pattern: str, leaf_chars: int = 2048) -> BpeCodec:
    """One codec for each Python worker. A rank_path without a folder names a file of the public tokenizers, wherever this machine has them."""
    key = (rank_path, pattern, leaf_chars)
    if key not in _CODECS:
        if not os.path.dirname(rank_path):
            import public_tokenizers

            rank_path = public_tokenizers.path(rank_path)
        _CODECS[key] = BpeCodec(rank_path, pattern, leaf_chars)
    return _CODECS[key]


#: What round_trip can return for each row, and how it follows from the ids and the decoded bytes.
OUTPUTS = {
    "n_tokens": ("long", pa.int64(), lambda ids, raw: len(ids)),
    "ids": ("array<int>", pa.list_(pa.int32()), lambda ids, raw: ids),
    "decoded": ("binary", pa.binary(), lambda ids, raw: raw),
    "ids_sha256": ("string", pa.string(), lambda ids, raw: hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()),
    "decoded_sha256": ("string", pa.string(), lambda ids, raw: hashlib.sha256(raw).hexdigest()),
}


def round_trip(
    df: DataFrame,
    rank_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded"),
    leaf_chars: int = 2048,
) -> DataFrame:
    """Encode each text and decode its ids again: id_col and the chosen OUTPUTS, a row for each row of df."""
    ship(df.sparkSession)
    picked = [(name, *OUTPUTS[name]) for name in outputs]
    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(rank_path, pattern, leaf_chars)
        for batch in batches:
            columns: list[list] = [[] for _ in picked]
            start, held = 0, 0
            for at, text in enumerate(batch.column(1), 1):
                ids = own.encode(text.as_py())
                raw = own.decode(ids)
                for column, (_, _, _, make) in zip(columns, picked, strict=True):
                    column.append(make(ids, raw))
                held += len(raw)
                if held >= FLUSH_BYTES or at == batch.num_rows:
                    arrays = [batch.column(0).slice(start, at - start)] + [pa.array(c, t) for c, (_, _, t, _) in zip(columns, picked, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, ["id", *outputs])
                    columns, start, held = [[] for _ in picked], at, 0

    return narrow.mapInArrow(work, ", ".join([f"id {kind}", *(f"{n} {t}" for n, t, _, _ in picked)])).withColumnRenamed("id", id_col)


def decode_ids(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and the decoded bytes of ids_col; null ids give null."""
    ship(df.sparkSession)
    narrow = df.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    kind = narrow.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(rank_path, pattern)
        for batch in batches:
            raw = [None if x.as_py() is None else own.decode(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["id", "decoded"])

    return narrow.mapInArrow(work, f"id {kind}, decoded binary").withColumnRenamed("id", id_col)


def tokenize_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes, by the public 50k vocabulary."""
    import public_tokenizers

    return round_trip(
        docs,
        "byte_bpe_50k.tiktoken",
        public_tokenizers.PATTERN,
        outputs=("n_tokens", "ids_sha256", "decoded_sha256"),
    )


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op1_bpe": op1_bpe}
ORACLE_SQL: dict[str, str] = {}
