"""One consistent form for texts that look the same.

Code points are sorted once into stable and unstable ones with the quick-check property of NFC (No
or Maybe, or a combining class), plus those this module maps or drops. A text is scanned for runs of
unstable code points; each run is normalised together with the one stable starter before it, which
is all that can compose with it, and spliced into the text, whose other parts stay as they are.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters and signs of other scripts that look like a Latin one.
LOOK_ALIKES = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ѵ": "V",
    # Greek
    "ο": "o", "ν": "v", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    # Armenian and other Latin
    "օ": "o", "ս": "u", "հ": "h", "ց": "g", "Օ": "O", "Տ": "S", "Լ": "L", "ɡ": "g", "ɑ": "a", "ı": "i", "Ð": "Đ", "Ɖ": "Đ", "ɖ": "đ",
    # Cherokee, Lisu, and small capitals that are only the small letter's shape
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    "ꓮ": "A", "ꓐ": "B", "ꓚ": "C", "ꓓ": "D", "ꓰ": "E", "ꓝ": "F", "ꓖ": "G", "ꓧ": "H", "ꓲ": "I", "ꓙ": "J", "ꓗ": "K", "ꓡ": "L", "ꓟ": "M", "ꓠ": "N", "ꓳ": "O", "ꓑ": "P", "ꓣ": "R", "ꓢ": "S", "ꓔ": "T", "ꓴ": "U", "ꓦ": "V", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓜ": "Z",
    "ᴄ": "c", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s", "ӏ": "l", "ё": "ë", "Ё": "Ë",
    # Signs
    "‐": "-", "‑": "-", "−": "-", "˗": "-", "﹣": "-", "⁃": "-",
}
# Code points that show nothing.
UNSEEN = "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"
#: Where code points with a decomposition, a combining class or a blank can be; what lies between are ideographs, Hangul syllables, surrogates, private and unused planes.
BLOCKS = ((0x80, 0x3400), (0xA000, 0xAC00), (0xF900, 0x13000), (0x16000, 0x17000), (0x1B000, 0x20000), (0x2F800, 0x2FA20))
#: Kinds of compatibility forms that read as their plain form. Superscripts, fractions, circles and the like read differently and stay.
SAME_SHAPE = ("<wide>", "<narrow>", "<font>", "<noBreak>")


def _plain(c: str) -> str | None:
    """What a compatibility form reads as, or None if it has none or reads differently."""
    kind = unicodedata.decomposition(c).split(" ")[0]
    if unicodedata.category(c) == "Zs" and c != " ":
        return " "
    if kind in SAME_SHAPE:
        return unicodedata.normalize("NFKC", c)
    if kind == "<compat>":  # Roman numerals, ligatures
        p = unicodedata.normalize("NFKC", c)
        return p if p.isascii() and p.isalnum() else None
    return None


@lru_cache(maxsize=1)
def tables() -> tuple[re.Pattern, dict[int, str], frozenset[str]]:
    """The pattern of an unstable run with the starter before it, the map of single code points, and the unstable ones."""
    mapped = {ord(a): b for a, b in LOOK_ALIKES.items()} | {ord(c): "" for c in UNSEEN}
    unstable = set(mapped)
    for p in (p for block in BLOCKS for p in range(*block)):
        c = chr(p)
        if p not in mapped and (plain := _plain(c)) is not None:
            mapped[p] = plain
            unstable.add(p)
        d = unicodedata.decomposition(c)
        if unicodedata.combining(c) or (d and d[0] != "<" and unicodedata.normalize("NFC", c) != c):
            unstable.add(p)
        elif d and d[0] != "<" and " " in d:
            unstable.add(int(d.split(" ")[1], 16))  # it can compose with what stands before it
    unstable.update(range(0x1161, 0x1176), range(0x11A8, 0x11C3))
    ranges, points = [], sorted(unstable)
    for p in points:
        if ranges and p == ranges[-1][1] + 1:
            ranges[-1][1] = p
        else:
            ranges.append([p, p])
    inside = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)
    return re.compile(f"[^{inside}]?[{inside}]+"), mapped, frozenset(map(chr, points))


_PICTURES = re.compile("(?<=[\u2600-\u27bf\ufe0f\U0001f000-\U0001faff])\u200d(?=[\u2600-\u27bf\U0001f000-\U0001faff])")
_JOINED = "\ue000"  # a private letter stands for a joiner between pictures, which shows


def canonical(text: str) -> str:
    """The consistent form of one text."""
    pattern, mapped, unstable = tables()
    if text.isascii() or unstable.isdisjoint(text):
        return text
    if "\u200d" in text:
        text = _PICTURES.sub(_JOINED, text)
    out = pattern.sub(lambda m: _segment(m.group(), mapped), text)
    return out.replace(_JOINED, "\u200d")


@lru_cache(maxsize=100_000)
def _segment_cached(s: str) -> str:
    mapped = tables()[1]
    # Marks may stand on a look-alike, so it is mapped first; what composes may itself be one (none today).
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", s.translate(mapped)).translate(mapped))


def _segment(s: str, mapped: dict[int, str]) -> str:
    return _segment_cached(s) if len(s) <= 12 else _segment_cached.__wrapped__(s)


@F.arrow_udf(T.StringType())
def _canonical_udf(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else canonical(t) for t in texts.to_pylist()], pa.string())


def canonical_text(text: Column) -> Column:
    """The column's texts in one consistent form (NFC, plain letters, plain blanks, nothing unseen).

    Defined cases: null stays null, empty stays empty; case, accents, digits, punctuation and the
    number of blanks stay; superscripts, fractions and circled forms stay as they read differently;
    joiners between pictures stay; very long texts are processed whole; applied twice it changes nothing.
    """
    return _canonical_udf(text)


def with_canonical(df: DataFrame, text: str, form: str = "form") -> DataFrame:
    """The rows with the consistent form of a column, made exactly once.

    As an expression the optimizer may copy it, for instance into the not-null filter of a join on it;
    as a step of its own over Arrow batches it stays where it is.
    """
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([None if t is None else canonical(t) for t in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, made], [*b.schema.names, form])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{kinds}, `{form}` string")
