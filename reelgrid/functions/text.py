"""Tokens, accent folding and small text rules, all as JVM expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONGEST_TOKEN = 24
# Spellings that mean "no value".
NO_VALUE = ["", "nan", "none", "null"]
# A quotation that holds one of these was not read from the screen.
HEDGES = ["không rõ", "không thể", "không đọc", "không nhìn", "mờ", "bị che"]


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """All single letters with a canonical decomposition in the Latin blocks, and their base letters."""
    src, dst = ["đ", "Đ"], ["d", "D"]
    for p in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        c = chr(p)
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if base != c and len(base) == 1:
            src.append(c)
            dst.append(base)
    return "".join(src), "".join(dst)


@F.arrow_udf(T.StringType())
def nfc(texts: pa.Array) -> pa.Array:
    """Canonical composition, which Spark has no built-in for; already composed texts pass through."""
    return pa.array([t if t is None or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())


def fold(text: Column) -> Column:
    """Without accents: precomposed letters become their base letter and non-spacing marks go; đ becomes d."""
    src, dst = _accents()
    return F.regexp_replace(F.translate(text, src, dst), r"\p{Mn}+", "")


def tokenize(text: Column) -> Column:
    """Lower-case runs of letters, digits and _ of at most 24 characters; null gives an empty array."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{M}\p{N}_]+)"), F.lit(1))
    return F.filter(words, lambda t: F.length(t) <= LONGEST_TOKEN)


def token_index(token: Column) -> Column:
    """31-bit index of a token: CRC-32 of its UTF-8 bytes without the top bit."""
    return F.crc32(F.encode(token, "UTF-8")).bitwiseAND(F.lit(0x7FFFFFFF))


def clean(text: Column) -> Column:
    """Trimmed, and empty for the spellings of no value."""
    t = F.trim(text)
    return F.when(text.isNull() | F.lower(t).isin(NO_VALUE), "").otherwise(t)


def collapse_blanks(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def joined_texts(*texts: Column) -> Column:
    """Trimmed non-empty texts in order with a middle dot between; null if none."""
    return F.nullif(F.concat_ws(" · ", *[F.nullif(F.trim(t), F.lit("")) for t in texts]), F.lit(""))


def quoted_spans(text: Column) -> Column:
    """What stands in a pair of straight or of curly double quotes, 2 to 160 characters, once each in order, no hedges."""
    spans = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit('"[^"]{2,160}"|“[^”]{2,160}”'), F.lit(0))
    bare = F.transform(spans, lambda s: F.regexp_replace(F.substring(s, F.lit(2), F.length(s) - 2), r"^\s+|\s+$", ""))
    kept = F.filter(bare, lambda s: (F.length(s) >= 2) & ~F.exists(F.array(*map(F.lit, HEDGES)), lambda h: F.contains(F.lower(s), h)))
    return F.array_distinct(kept)


def event_markers(text: Column) -> Column:
    """The events of a text marked E1:, E2. and so on, in order; null with fewer than two or an empty one."""
    parts = F.split(text, r"(?i)(?<!\S)E\d+[:.]")
    events = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda e: F.trim(e))
    return F.when((F.size(events) >= 2) & F.forall(events, lambda e: e != ""), events)


def keep_region(text: Column, score: Column) -> Column:
    """Whether a screen-text region is kept: under 3 characters never, 3-4 with a score of 0.5, longer always."""
    n = F.length(F.trim(text))
    return F.coalesce(F.when(n < 3, False).when(n <= 4, score >= 0.5).otherwise(True), F.lit(False))


def snapshot_name(collection: Column) -> Column:
    """A file name made safe, with a part of the SHA-256 of the original so that two never meet."""
    return F.concat(F.regexp_replace(collection, r"[^A-Za-z0-9._-]+", "_"), F.lit("-"), F.substring(F.sha2(collection, 256), 1, 12))


def numbered_lines(text: Column, expected: Column | None = None) -> Column:
    """The lines "1. ...", "2) ...", "3: ..." of an answer in order of their number, after a last </think>.

    Null unless the numbers are exactly 1 to ``expected`` (to their count without it) and no line is
    empty; of a repeated number the last line counts. Quotes around a line go.
    """
    body = F.regexp_replace(text, r"(?s)^.*</think>", "")
    lines = F.filter(F.split(body, r"\r\n|\r|\n"), lambda l: F.rlike(l, F.lit(r"^\s*\d{1,9}\s*[.):].")))
    pairs = F.transform(lines, lambda l: F.struct(F.regexp_extract(l, r"^\s*(\d+)", 1).cast("int").alias("n"), F.regexp_replace(F.regexp_replace(l, r"^\s*\d+\s*[.):]\s*|\s+$", ""), "^[\"'“”]+|[\"'“”]+$", "").alias("t")))
    numbers = F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p["n"])))
    count = F.size(numbers) if expected is None else expected
    last = F.transform(numbers, lambda n: F.element_at(F.filter(pairs, lambda p: p["n"] == n), -1)["t"])
    whole = (count > 0) & (numbers == F.sequence(F.lit(1), F.greatest(count, F.lit(1)))) & F.forall(last, lambda t: t != "")
    return F.when(whole, last)


# Section headings of an answer about a picture, and the word for "no text".
TEXT_HEADINGS = ["CHỮ", "CHU"]
CAPTION_HEADINGS = ["MÔ TẢ", "MO TA"]
NO_TEXT = "KHÔNG"


def picture_sections(text: Column) -> Column:
    """STRUCT<text, caption> of an answer with the two sections; lines before the first heading belong to neither."""
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"), F.lit("").alias("caption"))

    def add(held: Column, line: Column, between: str) -> Column:
        return F.when(line == "", held).when(held == "", line).otherwise(F.concat(held, F.lit(between), line))

    def step(s: Column, raw: Column) -> Column:
        line = F.regexp_replace(raw, r"^\s+|\s+$", "")
        head = F.rtrim(F.upper(line), F.lit(":"))
        is_text, is_caption = head.isin(TEXT_HEADINGS), head.isin(CAPTION_HEADINGS)
        heading = is_text | is_caption
        at = F.when(is_text, 1).when(is_caption, 2).otherwise(s["at"])
        return F.struct(at.alias("at"), F.when(~heading & (s["at"] == 1), add(s["text"], line, "\n")).otherwise(s["text"]).alias("text"), F.when(~heading & (s["at"] == 2), add(s["caption"], line, " ")).otherwise(s["caption"]).alias("caption"))

    done = F.aggregate(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), state, step)
    return F.struct(F.when(F.startswith(F.upper(done["text"]), F.lit(NO_TEXT)), "").otherwise(done["text"]).alias("text"), done["caption"].alias("caption"))
