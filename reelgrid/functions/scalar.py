"""Scalar rules of the domain: ids, times, windows, vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A gap of this many seconds between two events costs exactly 1.
GAP_SCALE_SEC = 300.0


def point_id_hex(*parts: Column) -> Column:
    """First 16 hexadecimal digits of the SHA-1 of the parts joined by ':'."""
    return F.substring(F.sha1(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 16)


def point_id(*parts: Column) -> Column:
    """The same as an unsigned 64-bit number, DECIMAL(20,0) as it exceeds BIGINT."""
    return F.conv(point_id_hex(*parts), 16, 10).cast("decimal(20,0)")


def frame_to_sec(frame: Column, fps_num: Column, fps_den: Column) -> Column:
    """Null where the rate is zero."""
    return F.try_divide(frame * fps_den, fps_num)


def sec_to_frame(sec: Column, fps_num: Column, fps_den: Column) -> Column:
    """Half to even, as the frame numbers of the index are."""
    return F.bround(F.try_divide(sec * fps_num, fps_den)).cast("bigint")


def time_window(shot_start: Column, shot_end: Column, start: Column, end: Column, pts: Column, pad: float = 0.0) -> Column:
    """STRUCT<low, high>: the shot's range if it has a length, else the clip's, else the instant; null if none."""
    w = lambda a, b: F.struct((a - pad).alias("low"), (b + pad).alias("high"))
    return F.when(shot_start.isNotNull() & shot_end.isNotNull() & (shot_end > shot_start), w(shot_start, shot_end)).when(start.isNotNull() & end.isNotNull(), w(start, end)).when(pts.isNotNull(), w(pts, pts))


def representative_frame(original: Column, start_frame: Column) -> Column:
    return F.coalesce(original, start_frame, F.lit(0))


def gap_penalty(gap_sec: Column) -> Column:
    """0 for an unknown or non-positive gap, else log1p(gap) / log1p(300); not clamped."""
    return F.when(gap_sec > 0, F.log1p(gap_sec) / F.log1p(F.lit(GAP_SCALE_SEC))).otherwise(0.0)


def within_gap(gap_sec: Column, most: float) -> Column:
    return F.lit(True) if most <= 0 else gap_sec.isNull() | (gap_sec <= most)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def usable_vector(v: Column, dim: int) -> Column:
    """Of the right length, all numbers finite, not all zero."""
    return F.coalesce((F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(v: Column) -> Column:
    """The vector over its length; an error for one that has none."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(F.raise_error(F.lit("vector of no length")).cast("array<double>"))


def clip_range(start: Column, end: Column, center: Column, radius: Column, longest: int = 300) -> Column:
    """STRUCT<start, end> of a clip asked for by its bounds or by centre and radius; null where it is not valid."""
    a = F.coalesce(start, F.greatest(center - radius, F.lit(0)))
    b = F.coalesce(end, center + radius)
    one_way = (start.isNotNull() & end.isNotNull() & center.isNull() & radius.isNull()) | (start.isNull() & end.isNull() & center.isNotNull() & radius.isNotNull())
    return F.when(one_way & (a <= b) & (b - a + 1 <= longest), F.struct(a.alias("start"), b.alias("end")))


def rotation(matrix: Column) -> Column:
    """Degrees 0, 90, 180 or 270 of a display matrix given as an array (a, b, ...)."""
    return F.pmod(F.round(-F.degrees(F.atan2(F.element_at(matrix, 2), F.element_at(matrix, 1))) / 90) * 90, F.lit(360)).cast("int")


def feedback_vector(query: Column, liked: Column, disliked: Column, alpha: float = 1.0, beta: float = 0.75, gamma: float = 0.15) -> Column:
    """alpha x query + beta x the mean of the liked vectors - gamma x that of the disliked; arrays of arrays may be empty or null."""

    def mean(vectors: Column) -> Column:
        n = F.size(vectors)
        total = F.aggregate(vectors, F.transform(query, lambda x: F.lit(0.0)), lambda s, v: F.zip_with(s, v, lambda a, b: a + b.cast("double")))
        return F.when(vectors.isNotNull() & (n > 0), F.transform(total, lambda x: x / n)).otherwise(F.transform(query, lambda x: F.lit(0.0)))

    moved = F.zip_with(F.transform(query, lambda x: alpha * x.cast("double")), mean(liked), lambda q, m: q + beta * m)
    return F.zip_with(moved, mean(disliked), lambda q, m: q - gamma * m)


def caption_budget(texts: Column) -> Column:
    """Words a model may write for captions of an array of queries."""
    return 64 * F.size(texts) + 64


def clean_budget(texts: Column) -> Column:
    """Words a model may write to repeat an array of queries without their phrasing."""
    return F.floor(F.aggregate(texts, F.lit(0), lambda n, t: n + F.length(t)) / 2) + 32 * F.size(texts) + 64
