"""Personal data in free text: found by a conditional random field, replaced by typed placeholders.

Tokens are words, runs of digits and single signs. The field sees their shapes, the words of a small
lexicon around them, how the corpus writes a word (mostly small, mostly with a capital, rarely), what
the number around a digit looks like and the blank-separated piece they stand in; names are never in
the lexicon. It is trained here on a small labelled table of everyday sentences whose personal data
are invented, and decoded by Viterbi. Reading, features and decoding are numpy operations over the
code points of many texts at once.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.llm import pii_table
from reelgrid.llm.canonical import UNSEEN
from reelgrid.llm.crf import Crf
from reelgrid.llm.names import fold

KINDS = ["email", "phone", "id_number", "address", "person"]
LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in ("B", "I"))]
NUMBER = re.compile(r"(?:\(?\+?\(?\d+\)?)(?:[ .\-/]{0,2}\(?\d+\)?)*")
# Spoken digits, without accents.
DIGIT_WORDS = frozenset("khong mot hai ba bon tu nam lam sau bay tam chin linh le zero oh one two three four five six seven eight nine double".split())
TEMPLATES = 20
#: Characters that are read at once, and tokens that are decoded at once.
READ_CHARS, DECODE_TOKENS = 200_000, 500_000
#: Words of which the corpus tells how they are written: the most frequent ones; rarer ones count as unknown.
KNOWN_WORDS = 65_536
#: A word seen less often tells nothing.
LEAST_SEEN = 5
_UNSEEN = frozenset(UNSEEN)
_ODD = re.compile(f"[{''.join(map(re.escape, UNSEEN))}\u0300-\u036f]")
_TOKEN = re.compile(r"([^\W\d_]+|\d+|[^\w\s]|_)")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BETWEEN = "\x1e"  # a blank that stands between texts
_WORD, _DIGITS, _SIGN = 1, 2, 3


_DROP = {ord(c): None for c in UNSEEN}
_UNSEEN_POINTS = np.array(sorted(_DROP), np.uint32)
_MARKED = re.compile("[^\u0300-\u036f][\u0300-\u036f]+")


def plain_view(text: str) -> tuple[str, np.ndarray]:
    """The text without unseen code points and with composed letters, and where each of its code points stood."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kept = np.flatnonzero(~np.isin(points, _UNSEEN_POINTS))
    text = text.translate(_DROP)
    if unicodedata.is_normalized("NFC", text):
        return text, kept
    out, at, done = [], [], 0
    for m in _MARKED.finditer(text):  # what stands between has nothing to compose
        composed = unicodedata.normalize("NFC", m.group())
        out += [text[done : m.start()], composed]
        at += [np.arange(done, m.start()), np.full(len(composed), m.start())]
        done = m.end()
    return "".join([*out, text[done:]]), kept[np.concatenate([*at, np.arange(done, len(text))])]


@lru_cache(maxsize=200_000)
def _named(s: str) -> int:
    """A stable number for a string (Python's own hash changes with the process)."""
    h = 2166136261
    for c in s.encode():
        h = (h ^ c) * 16777619 & 0x3FFFFFFF
    return h | 1 << 30


def shape(token: str) -> int:
    """What a token looks like: x, xx, X, Xx, XX; a run of digits its length; a sign itself."""
    if token.isdecimal():
        return 10 + min(len(token), 14)
    if not token[0].isalnum():
        return _named(token)
    if len(token) == 1:
        return 3 if token.isupper() else 1
    return 5 if token.isupper() else 4 if token[0].isupper() else 2


class Vocabulary:
    """What is known of each different token; tokens of a text are numbers into it.

    ``lexicon``: the words of the training sentences; ``written``: how the corpus writes a word, by its
    small letters: 1 small, 2 both ways, 3 with a capital.
    """

    #: Different tokens that are remembered; when there are more, the table starts anew.
    MOST = 400_000

    def __init__(self, lexicon: dict[str, int], written: dict[str, int] | None = None):
        self.lexicon, self.written = lexicon, written or {}
        self.folded: dict[str, int] = {}
        for w, i in lexicon.items():
            self.folded.setdefault(fold(w), i)  # for texts typed without accents
        self._start()

    def _start(self) -> None:
        self.ids: dict[str, int] = {}
        self.rows: list[tuple] = []
        self.table = np.zeros((0, 6), np.int64)

    def _row(self, token: str) -> tuple:
        """(word, shape with how it is written, kind, is it a spoken digit, is it an at-sign, own number)."""
        s = shape(token)
        kind = _DIGITS if token.isdecimal() else _WORD if token[0].isalnum() else _SIGN
        small = token.lower()
        if kind == _WORD:
            s = s + 5 * self.written.get(small, 0)
        else:
            s += 10_000
        known = self.lexicon.get(small) or (self.folded.get(small) if small.isascii() else None)
        return known or s + 1_000_000, s, kind, int(kind == _WORD and fold(small) in DIGIT_WORDS), int(token in "@＠"), _named(small)

    def __call__(self, tokens: list[str]) -> np.ndarray:
        """The numbers of tokens."""
        if len(self.ids) > self.MOST:
            self._start()
        ids = self.ids
        try:
            return np.fromiter(map(ids.__getitem__, tokens), np.int64, len(tokens))
        except KeyError:
            for t in set(tokens) - ids.keys():
                ids[t] = len(ids)
                self.rows.append(self._row(t))
            if len(self.rows) > len(self.table):
                self.table = np.concatenate([self.table, np.array(self.rows[len(self.table) :], np.int64).reshape(-1, 6)])
            return np.fromiter(map(ids.__getitem__, tokens), np.int64, len(tokens))


class Read:
    """The tokens of many texts, one array for each thing known of them."""

    def __init__(self, texts: list[str]):
        self.maps: dict[int, np.ndarray] = {}
        joined = _BETWEEN.join(texts)
        odd = [m.start() for m in _ODD.finditer(joined)]
        if odd:
            ends = np.cumsum([len(t) + 1 for t in texts])
            texts = list(texts)
            for i in np.unique(np.searchsorted(ends, odd, "right")).tolist():
                texts[i], self.maps[i] = plain_view(texts[i])
            joined = _BETWEEN.join(texts)
        self.texts, self.joined = texts, joined
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begin = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        parts = _TOKEN.split(joined)  # gap, token, gap, ..., gap
        self.tokens = parts[1::2]
        self.n = len(self.tokens)
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        edge = np.cumsum(size)
        self.start, self.end = edge[0:-1:2], edge[1::2]
        self.size = size[1::2]
        owner = np.searchsorted(self.begin, self.start, "right") - 1
        self.counts = np.bincount(owner, minlength=len(texts))
        self.piece_first = size[0:-1:2] > 0  # something blank stands before it
        if self.n:
            self.piece_first[0] = True
        self.piece = np.cumsum(self.piece_first) - 1

    def numbers(self, kind: np.ndarray, spoken: np.ndarray) -> np.ndarray:
        """Each digit or sign of a longer number has what the number as a whole looks like, spoken ones too."""
        out = np.zeros(self.n, np.int64)
        # Only stretches of tokens with digits are looked at: a number is digits with a few signs and blanks between.
        spans = []
        near = np.flatnonzero(kind == _DIGITS)
        if len(near):
            a, z = self.start[near], self.end[near]
            cut = np.flatnonzero(np.concatenate([[True], a[1:] - z[:-1] > 6]))
            for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(near)]):
                if int((z[i:j] - a[i:j]).sum()) >= 6:
                    lo = max(0, int(a[i]) - 4)
                    spans += [(lo + m.start(), lo + m.end(), m.group()) for m in NUMBER.finditer(self.joined[lo : int(z[j - 1]) + 1]) if m.end() - m.start() >= 6]
        if spans:
            first = np.searchsorted(self.start, [a for a, _, _ in spans]).tolist()
            after = np.searchsorted(self.start, [b for _, b, _ in spans]).tolist()
            for i, j, (_, _, g) in zip(first, after, spans):
                digits = re.sub(r"\D", "", g)
                if len(digits) >= 6 and i < j:
                    marks = "".join(sorted(set(re.sub(r"\d", "", g))))
                    look = f"{min(len(digits), 15)}|{digits[:2] if digits[0] in '08' else digits[0]}|{marks}|"
                    out[i:j] = _named(look + "False")
                    out[i] = _named(look + "True")
        if spoken.any():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], spoken.astype(np.int8), [0]])))
            for i, j in zip(edge[::2].tolist(), edge[1::2].tolist()):
                if j - i >= 6:
                    out[i:j] = _named(f"spoken|{min(j - i, 12)}|False")
                    out[i] = _named(f"spoken|{min(j - i, 12)}|True")
        return out


def features(r: Read, known: np.ndarray) -> np.ndarray:
    """(templates, tokens) of hashed feature ids; what lies outside the text is 0. ``known``: the vocabulary's row of each token."""
    n = r.n
    w, s, kind, spoken, mail, own = np.ascontiguousarray(known.T)
    number = r.numbers(kind, spoken > 0)
    ends = np.cumsum(r.counts)[r.counts > 0]
    starts = ends - r.counts[r.counts > 0]

    def shift(x: np.ndarray, d: int) -> np.ndarray:
        """What stands d tokens further in the same text."""
        out = np.zeros_like(x)
        if d > 0:
            out[:-d] = x[d:]
            for k in range(d):
                out[np.maximum(ends - 1 - k, starts)] = 0
        else:
            out[-d:] = x[:d]
            for k in range(-d):
                out[np.minimum(starts + k, ends - 1)] = 0
        return out

    first = np.flatnonzero(r.piece_first)
    piece_size = np.add.reduceat(r.size, first)
    piece = np.where(piece_size < 12, np.add.reduceat(own, first), 7 + piece_size // 6)
    text = np.searchsorted(starts, first, "right")
    near = []
    for d in (1, 2):
        x = np.zeros_like(piece)
        if d < len(piece):
            x[:-d] = np.where(text[d:] == text[:-d], piece[d:], 0)
        near.append(x[r.piece])
    at = (np.maximum.reduceat(mail, first)[r.piece] * 2 + r.piece_first).astype(np.int64)
    w1, w2, v1, v2 = shift(w, -1), shift(w, -2), shift(w, 1), shift(w, 2)
    s1, z1, z2 = shift(s, -1), shift(s, 1), shift(s, 2)
    parts = [
        (w,), (w1,), (v1,), (w2,), (v2,), (w1, w), (w, v1), (w2, w1), (v1, v2), (w1, s, v1), (s, r.piece_first), (s1, s, z1), (number,), (number, w1),
        (at, s), (at, *near), (shift(w, -3), w2, w1, s), (s, z1, z2), (w2, w1, s, z1), (number, shift(number, -1), s),
    ]
    out = np.empty((TEMPLATES, n), np.int32)
    for i, p in enumerate(parts):
        h = np.full(n, 7919 * (i + 1), np.uint64)
        for x in p:
            h ^= x.astype(np.uint64)
            h *= _MIX
            h ^= h >> np.uint64(29)
        out[i] = (h & np.uint64(0xFFFF)).astype(np.int32)
    return out


class Finder:
    """The trained field with its lexicon."""

    def __init__(self, rows: int = 4000, seed: int = 5):
        table = pii_table.labelled_rows(rows, seed)
        # Words of the sentences, not of what was put into them.
        count = Counter(w for parts in table for text, kind in parts if kind == "" for w in re.findall(r"[^\W\d_]+", unicodedata.normalize("NFC", text.lower())))
        self.lexicon = {w: i + 100 for i, w in enumerate(sorted(w for w, n in count.items() if n >= 2))}
        texts, spans = zip(*(pii_table.joined(parts) for parts in table))
        r, words = Read(list(texts)), Vocabulary(self.lexicon)
        ids = words(r.tokens)
        rows = words.table[ids]
        rows[:, 1] = np.where(rows[:, 2] == _WORD, rows[:, 1] + 5 * self._as_written(r, rows[:, 2], spans, seed), rows[:, 1])
        rows[:, 0] = np.where(rows[:, 0] >= 1_000_000, rows[:, 1] + 1_000_000, rows[:, 0])
        made = features(r, rows)
        labels, split, k = [], [], 0
        for i, (row, n) in enumerate(zip(spans, r.counts)):
            a, b, y = r.start[k : k + n] - r.begin[i], r.end[k : k + n] - r.begin[i], np.zeros(n, np.int64)
            for lo, hi, kind in row:
                inside = np.flatnonzero((a >= lo) & (b <= hi))
                if len(inside):
                    y[inside] = LABELS.index(f"I-{kind}")
                    y[inside[0]] = LABELS.index(f"B-{kind}")
            labels.append(y)
            split.append(made[:, k : k + n])
            k += n
        self.crf = Crf(len(LABELS)).fit(split, labels)

    @staticmethod
    def _as_written(r: Read, kind: np.ndarray, spans: tuple, seed: int) -> np.ndarray:
        """How a corpus would write the words of the table: sentences' words small, those of names with a capital, some of either the other way or unknown."""
        rng = np.random.default_rng(seed)
        slot, k = np.zeros(r.n, bool), 0
        for i, (row, n) in enumerate(zip(spans, r.counts)):
            a = r.start[k : k + n] - r.begin[i]
            for lo, hi, what in row:
                slot[k : k + n] |= (a >= lo) & (a < hi) & (what in ("person", "address"))
            k += n
        # Outside the spans, a capital inside a sentence is a name too (of places and such).
        capital = np.array([t[0].isupper() and not (len(t) > 1 and t.isupper()) for t in r.tokens])
        slot |= capital & np.concatenate([[False], kind[:-1] == _WORD])
        draw = rng.random(r.n)
        small = np.choose(np.searchsorted([0.82, 0.87, 0.89], draw), [1, 2, 3, 0])
        large = np.choose(np.searchsorted([0.60, 0.70, 0.80], draw), [3, 2, 1, 0])
        unknown = np.repeat(rng.random(len(r.counts)) < 0.15, r.counts)  # rows of a corpus that tells nothing
        return np.where(unknown, 0, np.where(slot, large, small)).astype(np.int64)

    def find(self, texts: list[str], words: Vocabulary | None = None) -> list[list[tuple[str, int, int]]]:
        """(kind, start, end) of each place in each text, in code points of the text as given. ``words``: what is known of the corpus's words."""
        words = words or Vocabulary(self.lexicon)
        out: list[list[tuple[str, int, int]]] = []
        held: list[tuple[Read, np.ndarray]] = []
        for group in _groups(texts):
            r = Read(group)
            ids = words(r.tokens)
            held.append((r, self.crf.emissions(features(r, words.table[ids])) if r.n else np.zeros((0, len(LABELS)), np.float32)))
            if sum(r.n for r, _ in held) >= DECODE_TOKENS:
                out += self._decoded(held)
                held = []
        return out + self._decoded(held)

    def _decoded(self, held: list[tuple[Read, np.ndarray]]) -> list[list[tuple[str, int, int]]]:
        if not held:
            return []
        labels = self.crf.decode(np.concatenate([e for _, e in held]), np.concatenate([r.counts for r, _ in held]))
        out, k = [], 0
        for r, _ in held:
            out += self._places(r, labels[k : k + r.n])
            k += r.n
        return out

    @staticmethod
    def _places(r: Read, labels: np.ndarray) -> list[list[tuple[str, int, int]]]:
        out: list[list[tuple[str, int, int]]] = [[] for _ in r.texts]
        ends = np.cumsum(r.counts)
        for i in np.flatnonzero(labels % 2 == 1).tolist():
            t = int(np.searchsorted(ends, i, "right"))
            j = i + 1
            while j < ends[t] and labels[j] == labels[i] + 1:
                j += 1
            kind = KINDS[(labels[i] - 1) // 2]
            a, b = int(r.start[i] - r.begin[t]), int(r.end[j - 1] - r.begin[t])
            if plausible(kind, r.texts[t][a:b]):
                if t in r.maps:  # back to the text as it was given
                    a, b = int(r.maps[t][a]), int(r.maps[t][b - 1]) + 1
                out[t].append((kind, a, b))
        return out


def written_words(df: DataFrame, text: str, most: int = KNOWN_WORDS) -> dict[str, int]:
    """How all texts write their words: 1 (small), 2 (both ways) or 3 (with a capital) for each, by its small letters.

    Counted over all texts, batch by batch before the shuffle; the ``most`` frequent words come to the
    driver, a table of a bounded size. Words in capitals throughout don't count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count: Counter[str] = Counter()
            for group in _groups(b.column(0).to_pylist()):
                count.update(Read(group).tokens)
            words = [(t, n) for t, n in count.items() if t[0].isalpha() and (len(t) == 1 or not t.isupper())]
            large = [n if t[0].isupper() else 0 for t, n in words]
            yield pa.RecordBatch.from_arrays([pa.array([t.lower() for t, _ in words], pa.string()), pa.array([n for _, n in words], pa.int64()), pa.array(large, pa.int64())], ["word", "n", "large"])

    counted = df.select(F.col(f"`{text}`").alias("t")).where("t is not null").mapInArrow(run, "word string, n bigint, large bigint")
    total = counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("large").alias("large")).where(F.col("n") >= LEAST_SEEN)
    t = total.orderBy(F.desc("n"), "word").limit(most).toArrow().to_pydict()
    return {w: 3 if large > 0.8 * n else 2 if large > 0.4 * n else 1 for w, n, large in zip(t["word"], t["n"], t["large"])}


def _groups(texts: list[str | None], size: int = READ_CHARS) -> Iterator[list[str]]:
    """Texts of about ``size`` characters together."""
    group: list[str] = []
    chars = 0
    for t in texts:
        group.append(t or "")
        chars += len(group[-1])
        if chars > size:
            yield group
            group, chars = [], 0
    if group:
        yield group


def plausible(kind: str, s: str) -> bool:
    """The exact check after the field: what was found must have the least its kind needs."""
    digits = sum(c.isdigit() for c in s)
    if kind == "email":
        return bool(re.search(r"@|＠|\bat\b|c[oò]ng", s, re.IGNORECASE)) and len(s) >= 6
    if kind == "phone":
        return digits >= 7 or sum(fold(w) in DIGIT_WORDS for w in s.split()) >= 7
    if kind == "id_number":
        return digits >= 6
    if kind == "address":
        return s[0].isdigit() and any(c.isalpha() for c in s)
    return len(s.split()) >= 2


@lru_cache(maxsize=1)
def finder() -> Finder:
    """The finder, trained once per process."""
    return Finder()


def personal_data(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pii_kind, start_at, end_at): one row per place of personal data; positions are 0-based code points.

    All texts are read twice: first to count how they write their words, then to find the places.

    Defined cases: null, empty and blank texts give no row; very long texts are read whole; repeated
    rows give repeated places, which a distinct() removes; unseen code points inside a word don't
    hide it, and positions count them; other columns are not read.
    """
    f = df.sparkSession.sparkContext.broadcast((finder(), written_words(df, text)))  # at most KNOWN_WORDS words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, written = f.value
        words = Vocabulary(field.lexicon, written)
        for b in batches:
            keys, rows = b.column(0).to_pylist(), [[], [], [], []]
            for k, places in zip(keys, field.find(b.column(1).to_pylist(), words)):
                for kind, a, z in places:
                    for column, v in zip(rows, (k, kind, a, z)):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], b.column(0).type), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.int32())], ["key", "pii_kind", "start_at", "end_at"])

    src = df.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return src.mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, pii_kind string, start_at int, end_at int").withColumnRenamed("key", key)


def redact(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text): every row's text with its personal data replaced by <EMAIL>, <PHONE>, <ID_NUMBER>, <ADDRESS>, <PERSON>.

    Null stays null; the rest of a text stays as it is, and so do repeated rows.
    """
    f = df.sparkSession.sparkContext.broadcast((finder(), written_words(df, text)))  # at most KNOWN_WORDS words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, written = f.value
        words = Vocabulary(field.lexicon, written)
        for b in batches:
            out, texts = [], b.column(1).to_pylist()
            for t, places in zip(texts, field.find(texts, words)):
                for kind, a, z in reversed(places):
                    t = f"{t[:a]}<{kind.upper()}>{t[z:]}"
                out.append(t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["key", "text"])

    src = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return src.mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, text string").withColumnRenamed("key", key)
