"""Scalar functions on text columns. All are Column expressions, but for `ten_digits`, which Spark lacks."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks that subword vocabularies put before a word.
SUBWORD_MARKS = "Ġ▁"
#: Punctuation around a word that a spelling check leaves out.
WORD_EDGES = ".,!?;:\"'()[]{}"
ROW_ORD = "row_ord"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def filled(c: Column | str) -> Column:
    """Null cells count as empty."""
    return F.coalesce(as_column(c), F.lit(""))


def strip(c: Column | str) -> Column:
    """Without white space (of Unicode) at either end."""
    return F.regexp_replace(filled(c), r"(?U)^\s+|\s+$", "")


def unix_lines(c: Column | str) -> Column:
    """CR LF and CR become LF, as offsets are counted after that."""
    return F.regexp_replace(filled(c), "\r\n?", "\n")


def canonical_token(c: Column | str) -> Column:
    """Stripped, without subword marks in front, in lower case."""
    plain = as_column(c).rlike("^[0-9A-Za-z]+\\z")  # nothing to take away, as nearly always
    bare = F.regexp_replace(strip(c), f"^{SUBWORD_MARKS[0]}?{SUBWORD_MARKS[1]}?", "")
    return F.lower(F.when(plain, as_column(c)).otherwise(strip(bare)))


def word_characters(c: Column | str) -> Column:
    """Word characters only, in lower case: the key of the fused profile."""
    return F.lower(F.regexp_replace(filled(c), r"(?U)\W", ""))


def number(c: Column | str) -> Column:
    """A double, or null where the cell is none."""
    return strip(c).try_cast("double")


def whole_number(c: Column | str) -> Column:
    return F.when(strip(c).rlike(r"^[+-]?[0-9]+$"), strip(c)).try_cast("bigint")


def span(c: Column | str, separators: str = "-") -> Column:
    """start and end of `start-end`; null where it is no span. Internal data use integers; both `-` and `:` may be read."""
    kinds = "".join(re.escape(x) for x in separators)
    shape = rf"^\s*([0-9]+)\s*[{kinds}]\s*([0-9]+)\s*$"
    text = filled(c)
    start, end = (F.regexp_extract(text, shape, k).try_cast("int") for k in (1, 2))
    return F.when(text.rlike(shape) & (end >= start), F.struct(start.alias("start"), end.alias("end")))


def span_text(start: Column | str, end: Column | str) -> Column:
    return F.concat(as_column(start).cast("string"), F.lit("-"), as_column(end).cast("string"))


def masked(sentence: Column | str, start: Column | str, end: Column | str, mask: str = "<mask>") -> Column:
    """The sentence with the span replaced, stripped, behind one blank; null where the span leaves the sentence."""
    s, a, b = filled(sentence), as_column(start), as_column(end)
    made = F.concat(F.substring(s, F.lit(1), a), F.lit(mask), F.substring(s, b + 1, F.length(s)))
    return F.when((a >= 0) & (b >= a) & (b <= F.length(s)), F.concat(F.lit(" "), strip(made)))


def holds_word(text: Column | str, word: Column | str) -> Column:
    """Whether the text holds the word as a whole word, letter for letter."""
    return F.regexp_like(as_column(text), F.concat(F.lit(r"(?U)\b\Q"), F.replace(as_column(word), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\b")))


def cell_for_sheet(c: Column | str) -> Column:
    """Without the control characters that a sheet cannot hold."""
    return F.regexp_replace(filled(c), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")


def core_of_token(token: Column | str) -> Column:
    """The token without punctuation around it."""
    edge = "[" + "".join("\\" + x for x in WORD_EDGES) + "]"
    return F.regexp_replace(as_column(token), f"^{edge}+|{edge}+$", "")


#: Parts whose lengths are added up one by one, and blocks of them; beyond, sums of whole blocks are used.
_BLOCK, _WIDE = 16, 512


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, x: a + x)


def tiles(text: Column | str, pattern: str) -> Column:
    """All matches of a pattern that leaves nothing out, each with its start: array<struct<start, text>>."""

    def placed(parts: Column) -> Column:
        def sums(values: Column, of: int) -> Column:
            blocks = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(values) / float(of)).cast("int") - 1))
            return F.transform(blocks, lambda b: _total(F.slice(values, b * of + 1, of)))

        def by_blocks(lengths: Column) -> Column:
            """What stands before a part: whole wide blocks, whole blocks within that, single parts within that."""

            def starts(small: Column) -> Column:
                def within(wide: Column) -> Column:
                    before = lambda x, b: wide_before(wide, b) + _total(F.slice(small, F.floor(b / (_WIDE / _BLOCK)).cast("int") * (_WIDE // _BLOCK) + 1, b % (_WIDE // _BLOCK)))
                    return F.transform(small, before)

                return _let(sums(small, _WIDE // _BLOCK), within)

            wide_before = lambda wide, b: _total(F.slice(wide, F.lit(1), F.floor(b / (_WIDE / _BLOCK)).cast("int")))
            start = lambda first, i: F.get(first, F.floor(i / float(_BLOCK)).cast("int")) + _total(F.slice(lengths, F.floor(i / float(_BLOCK)).cast("int") * _BLOCK + 1, i % _BLOCK))
            return _let(_let(sums(lengths, _BLOCK), starts), lambda first: F.transform(parts, lambda x, i: F.struct(start(first, i).alias("start"), x.alias("text"))))

        return _let(F.transform(parts, lambda x: F.length(x)), by_blocks)

    return _let(F.regexp_extract_all(filled(text), F.lit(pattern), F.lit(0)), placed)


def ten_digits(c: Column | str) -> Column:
    """The number as C's %.10g writes it. An Arrow function, for sinks only."""

    @F.pandas_udf("string")
    def write(values: pd.Series) -> pd.Series:
        return values.map(lambda v: format(v, ".10g"), na_action="ignore")

    return write(as_column(c).cast("double"))


def printed_bytes(n: Column | str) -> Column:
    """human_bytes of a column of whole numbers."""
    c = as_column(n).cast("long")
    out = F.when(c < 1024, F.format_string("%d B", c))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        shown = F.format_string(f"%.1f {unit}", F.bround(c / F.lit(float(1024**k)), 1))
        out = out.when(c < 1024 ** (k + 1), shown) if unit != "TB" else out.otherwise(shown)
    return out


def share(done: Column | str, total: Column | str) -> Column:
    """percent of two columns."""
    d, t = as_column(done).cast("double"), as_column(total).cast("double")
    return F.when(t > 0, F.least(F.lit(100.0), 100.0 * d / t)).otherwise(0.0)


def title_for_sheet(c: Column | str) -> Column:
    """sheet_title of a column."""
    return F.substring(F.regexp_replace(filled(c), r"[\[\]:*?/\\]", "_"), 1, 31)


def listed_words(c: Column | str) -> Column:
    """word_arguments of a column: an array."""
    return F.array_distinct(F.filter(F.transform(F.split(filled(c), "[,\n]"), strip), lambda w: w != ""))


# -- on the driver --------------------------------------------------------------------------------
def sheet_title(text: str) -> str:
    return re.sub(r"[\[\]:*?/\\]", "_", text)[:31]


def human_bytes(n: float) -> str:
    """1536 -> 1.5 KB."""
    units = ["B", "KB", "MB", "GB", "TB"]
    k = min(len(units) - 1, int(math.log(n, 1024))) if n >= 1 else 0
    return f"{n / 1024**k:.1f} {units[k]}" if k else f"{int(n)} B"


def percent(done: float, total: float) -> float:
    return min(100.0, 100.0 * done / total) if total > 0 else 0.0


def word_arguments(text: str | Iterable[str]) -> list[str]:
    """Words of `a, b` or of several lines; blanks and repeats left out."""
    parts = re.split(r"[,\n]", text) if isinstance(text, str) else text
    return list(dict.fromkeys(p.strip() for p in parts if p.strip()))
