"""A linear-chain conditional random field over hashed features, in numpy."""

from __future__ import annotations

import numpy as np


#: The weight of a step that can't be.
NEVER = 1e4


class Crf:
    """Weights of ``size`` hashed features for each label, and of each pair of labels."""

    def __init__(self, labels: int, size: int = 1 << 16):
        self.labels, self.size = labels, size
        self.w = np.zeros((size, labels), np.float32)
        self.pair = np.zeros((labels, labels), np.float32)
        self.first = np.zeros(labels, np.float32)
        # Labels but 0 come in pairs: 2k + 1 begins a place of kind k, 2k + 2 goes on with one, and only after these two.
        inner = np.arange(2, labels, 2)
        self.pair[:, inner], self.first[inner] = -NEVER, -NEVER
        self.pair[inner - 1, inner] = self.pair[inner, inner] = 0

    def emissions(self, features: np.ndarray) -> np.ndarray:
        """(tokens, labels) from (templates, tokens) of feature ids."""
        out = np.empty((features.shape[1], self.labels), np.float32)
        part = np.empty((min(65_536, features.shape[1]), self.labels), np.float32)
        for i in range(0, features.shape[1], 65_536):  # a stretch at a time stays in the cache
            f, o = features[:, i : i + 65_536], out[i : i + 65_536]
            np.take(self.w, f[0], axis=0, out=o)
            for t in f[1:]:
                o += np.take(self.w, t, axis=0, out=part[: len(t)])
        return out

    def fit(self, features: list[np.ndarray], labels: list[np.ndarray], epochs: int = 5, batch: int = 48, rate: float = 0.25, decay: float = 1e-6, seed: int = 0) -> Crf:
        """Maximum likelihood by Adagrad over batches of padded sequences."""
        rng = np.random.default_rng(seed)
        fixed = [x <= -NEVER for x in (self.pair, self.first)]
        # Squared gradients so far.
        gw, gp, gf = np.full_like(self.w, 1e-2), np.full_like(self.pair, 1e-2), np.full_like(self.first, 1e-2)
        by_length = sorted(range(len(labels)), key=lambda i: len(labels[i]))
        groups = [by_length[i : i + batch] for i in range(0, len(by_length), batch)]
        for _ in range(epochs):
            for g in rng.permutation(len(groups)):
                rows = groups[g]
                n, t = len(rows), max(len(labels[i]) for i in rows)
                f = np.zeros((features[0].shape[0], n, t), np.int64)
                y = np.zeros((n, t), np.int64)
                mask = np.zeros((n, t), bool)
                for r, i in enumerate(rows):
                    m = len(labels[i])
                    f[:, r, :m], y[r, :m], mask[r, :m] = features[i], labels[i], True
                e = self.emissions(f.reshape(len(f), -1)).reshape(n, t, -1)
                single, double = self._marginals(e, mask)
                d = single
                d[np.arange(n)[:, None], np.arange(t)[None], y] -= 1
                d *= mask[:, :, None]
                used = mask.ravel()
                flat, at = d.reshape(-1, self.labels)[used], f.reshape(len(f), -1)[:, used].ravel()
                rows_used, at = np.unique(at, return_inverse=True)
                gradient = np.stack([np.bincount(at, np.tile(flat[:, k], len(f)), len(rows_used)) for k in range(self.labels)], 1) / n
                gradient += decay * self.w[rows_used]
                gw[rows_used] += gradient * gradient
                self.w[rows_used] -= rate * gradient / np.sqrt(gw[rows_used])
                both = mask[:, 1:]
                np.subtract.at(double, (y[:, :-1][both], y[:, 1:][both]), 1)
                for p, s, q, never in ((self.pair, gp, double / n, fixed[0]), (self.first, gf, d[:, 0].sum(0) / n, fixed[1])):
                    q = np.where(never, 0, q)
                    s += q * q
                    p -= rate * q / np.sqrt(s)
        return self

    def _marginals(self, e: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each token its label probabilities; of label pairs the expected counts."""
        n, t, k = e.shape
        a, b = np.zeros((n, t, k), np.float64), np.zeros((n, t, k), np.float64)
        a[:, 0] = e[:, 0] + self.first
        for i in range(1, t):
            s = a[:, i - 1, :, None] + self.pair[None]
            m = s.max(1)
            a[:, i] = np.where(mask[:, i, None], e[:, i] + m + np.log(np.exp(s - m[:, None]).sum(1)), a[:, i - 1])
        for i in range(t - 2, -1, -1):
            s = (e[:, i + 1] + b[:, i + 1])[:, None, :] + self.pair[None]
            m = s.max(2)
            b[:, i] = np.where(mask[:, i + 1, None], m + np.log(np.exp(s - m[:, :, None]).sum(2)), 0)
        m = a[:, -1].max(1)
        z = m + np.log(np.exp(a[:, -1] - m[:, None]).sum(1))
        single = np.exp(a + b - z[:, None, None])
        double = np.zeros((k, k))
        for i in range(1, t):
            p = np.exp(a[:, i - 1, :, None] + self.pair[None] + (e[:, i] + b[:, i])[:, None, :] - z[:, None, None])
            double += p[mask[:, i]].sum(0)
        return single, double

    def _may_gain(self, emissions: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Whether any run of one kind over a token might beat label 0 all along the run.

        A run's gain over label 0 is at most what its first token gives with the best way in, what each
        further token gives with the best step inside, and the best way out. The largest such sum over a
        token is that of the best run up to it and the best way on from it: differences of running sums
        and their running extremes.
        """
        p, n = self.pair.astype(np.float64), len(emissions)
        which = np.zeros(n, np.int64)
        which[starts[1:]] = 1
        which = np.cumsum(which)
        may = np.zeros(n, bool)
        for k in range(1, self.labels, 2):
            own, other = [k, k + 1], [x for x in range(self.labels) if x not in (k, k + 1)]
            e = emissions[:, own].astype(np.float64) - emissions[:, :1]
            way_in = np.maximum((p[np.ix_(other, own)] - p[other, :1]).max(axis=0), self.first[own] - self.first[0])
            way_out = max((p[np.ix_(own, other)] - p[:1, other]).max(), 0.0)
            start = (e + way_in).max(axis=1)
            inside = (e + p[np.ix_(own, own)].max(axis=0) - p[0, 0]).max(axis=1)
            apart = np.abs(inside).sum() + np.abs(start).max() + 1  # no run reaches over the edge of a sequence
            sums = np.cumsum(inside)
            up_to = sums + np.maximum.accumulate(start - sums + apart * which) - apart * which
            further = np.maximum.accumulate((sums - apart * which)[::-1])[::-1] + apart * which - sums
            may |= up_to + further + way_out > -1e-3
        return may

    def decode(self, emissions: np.ndarray, lengths: np.ndarray, cells: int = 200_000) -> np.ndarray:
        """The best labels of sequences laid one after another, by Viterbi.

        Labels but 0 come in pairs (2k + 1, 2k + 2), one kind each. First a bound is taken for every token:
        the most that any run of one kind over it could gain against label 0 all along. Where no run
        gains, the label is 0 in every best path, so only the stretches between are decoded, exactly. They
        are batched by length, at most ``cells`` tokens with what pads them, so one long sequence never
        pads many short ones.
        """
        n = len(emissions)
        out = np.zeros(n, np.int8)
        if not n:
            return out
        p, turned = self.pair, np.ascontiguousarray(self.pair.T)
        begin = np.zeros(n, bool)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])[lengths > 0]
        begin[starts] = True
        last = np.zeros(n, bool)
        last[np.append(starts[1:], n) - 1] = True
        sure = ~self._may_gain(emissions, starts)
        open_ = ~sure & (begin | np.concatenate([[True], sure[:-1]]))
        first = np.flatnonzero(open_)
        if not len(first):
            return out
        close = np.flatnonzero(~sure & (last | np.concatenate([sure[1:], [True]])))
        size = close - first + 1
        order = np.argsort(size, kind="stable")
        g = 0
        while g < len(order):
            # Sizes rise, so the batch's last one is what all are padded to.
            many = np.arange(1, len(order) - g + 1)
            take = max(1, int(np.searchsorted(many * size[order[g:]], cells, "right")))
            rows = order[g : g + take]
            g += take
            length, head = size[rows], first[rows]
            t = int(length.max())
            score = emissions[head] + np.where(begin[head, None], self.first, p[0])
            back = np.zeros((t, len(rows), self.labels), np.int8)
            whole = np.arange(len(rows))
            for i in range(1, t):
                live = whole[np.searchsorted(length, i, "right") :]  # the longer ones
                s = score[live][:, None, :] + turned  # to, from
                best = s.argmax(2)
                back[i, live] = best
                score[live] = np.take_along_axis(s, best[:, :, None], 2)[:, :, 0] + emissions[head[live] + i]
            tail = head + length - 1
            best = (score + np.where(last[tail, None], 0, p[:, 0])).argmax(1)
            for i in range(t - 1, -1, -1):
                here = whole[np.searchsorted(length, i, "right") :]
                out[head[here] + i] = best[here]
                if i:
                    best[here] = back[i, here, best[here]]
        return out
