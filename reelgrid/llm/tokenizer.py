"""Encoding a corpus with a public byte-level BPE vocabulary.

Words of a batch that have not been met before are laid out in one flat array of symbols. Each round
looks all neighbouring pairs up by binary search over the sorted pair keys, finds the lowest-ranked
pair of every word, merges all its occurrences in that word, and drops the words that are finished.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = "/opt/tokenizers"
#: Fixed value: the split of byte-level BPE before the merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words kept by a worker with their ids; when full, the table starts anew.
REMEMBERED = 400_000
#: A longer word is merged with a heap: rounds over it would be quadratic.
LONG_WORD = 2_000
NO_PAIR = np.iinfo(np.int64).max


class ByteBpe:
    """A byte-level BPE vocabulary read from its JSON file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.split = regex.compile(SPLIT)
        self.byte_ids = np.array([vocab[c] for c in _byte_letters()], np.int64)
        self.size = max(vocab.values()) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        self.known: dict[str, np.ndarray] = {}

    def rank_of(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NO_PAIR)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's begin; null and empty texts have none."""
        words = [self.split.findall(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list({w for ws in words for w in ws if w not in self.known})
        if new:
            self.known.update(zip(new, self._merge(new)))
        known = self.known
        found = [known[w] for ws in words for w in ws]
        lengths = np.fromiter((sum(len(known[w]) for w in ws) for ws in words), np.int64, len(words))
        return (np.concatenate(found) if found else np.empty(0, np.int32)), np.concatenate([[0], np.cumsum(lengths)])

    def _merge(self, words: list[str]) -> list[np.ndarray]:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        out: list[np.ndarray | None] = [None] * len(raw)
        short = []
        for i, b in enumerate(raw):
            if len(b) > LONG_WORD:
                out[i] = self._merge_long(b)
            else:
                short.append(i)
        sym = self.byte_ids[np.frombuffer(b"".join(raw[i] for i in short), np.uint8)]
        word = np.repeat(np.array(short, np.int64), [len(raw[i]) for i in short])
        done_sym, done_word = [], []
        while len(sym):
            inside = word[:-1] == word[1:]
            rank = np.full(len(sym), NO_PAIR, np.int64)
            rank[:-1][inside] = self.rank_of(sym[:-1][inside] * self.size + sym[1:][inside])
            begin = np.flatnonzero(np.concatenate([[True], ~inside]))
            least = np.minimum.reduceat(rank, begin)
            least = np.repeat(least, np.diff(np.append(begin, len(sym))))
            active = least != NO_PAIR
            if not active.all():
                done_sym.append(sym[~active])
                done_word.append(word[~active])
                sym, word, rank, least = sym[active], word[active], rank[active], least[active]
                if not len(sym):
                    break
            hit = rank == least
            # Of overlapping pairs (a run of hits) every second one is merged, from the left.
            first = hit & ~np.concatenate([[False], hit[:-1]])
            place = np.arange(len(hit))
            run = np.maximum.accumulate(np.where(first, place, 0))
            hit &= (place - run) % 2 == 0
            sym = np.where(hit, self.merged[np.where(hit, rank, 0)], sym)
            keep = ~np.concatenate([[False], hit[:-1]])
            sym, word = sym[keep], word[keep]
        if done_sym:
            s, w = np.concatenate(done_sym).astype(np.int32), np.concatenate(done_word)
            order = np.argsort(w, kind="stable")
            s, w = s[order], w[order]
            cut = np.flatnonzero(np.diff(w)) + 1
            for i, part in zip(w[np.concatenate([[0], cut])], np.split(s, cut)):
                out[i] = part
        return out

    def _merge_long(self, b: bytes) -> np.ndarray:
        """The same merges with a heap of pairs over a linked list."""
        sym = self.byte_ids[np.frombuffer(b, np.uint8)].tolist()
        n = len(sym)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        ranks = self.rank_of(np.array(sym[:-1]) * self.size + np.array(sym[1:]))
        heap = [(int(r), i, sym[i], sym[i + 1]) for i, r in enumerate(ranks) if r != NO_PAIR]
        heapq.heapify(heap)

        def push(i: int, j: int) -> None:
            r = int(self.rank_of(np.array([sym[i] * self.size + sym[j]]))[0])
            if r != NO_PAIR:
                heapq.heappush(heap, (r, i, sym[i], sym[j]))

        while heap:
            r, i, a, c = heapq.heappop(heap)
            j = right[i] if sym[i] == a else -1
            if j < 0 or sym[j] != c:
                continue
            sym[i], sym[j] = int(self.merged[r]), -1
            right[i] = right[j]
            if right[i] >= 0:
                left[right[i]] = i
                push(i, right[i])
            if left[i] >= 0:
                push(left[i], i)
        return np.array([x for x in sym if x >= 0], np.int32)


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary's file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


_LOADED: dict[str, ByteBpe] = {}


def load(path: str) -> ByteBpe:
    """The vocabulary, read once per worker process."""
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def encode_corpus(df: DataFrame, keys: list[str], text: str, vocabulary: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """``keys`` and ``ids`` (array<int>) of every row's text, without special tokens.

    Strings of special tokens inside a text are ordinary text. Defined cases: null and empty texts
    give an empty list; blank texts are encoded as they are; every row gives a row, repeated or not;
    very long texts and words are encoded whole; other columns are not read.
    """
    path = os.path.join(tokenizer_dir, f"{vocabulary}.json")
    src = df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text}`").alias("__text"))
    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), "ids array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for whole in batches:
            for b in _slices(whole, len(keys)):
                ids, begins = bpe.encode(b.column(len(keys)).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], lists], [*keys, "ids"])

    return src.mapInArrow(run, schema)


def _slices(b: pa.RecordBatch, text: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with few bytes of text each, so that long texts don't fill memory."""
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < b.num_rows:
        done = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, done + most, "right")))
        yield b.slice(start, end - start)
        start = end
