"""A linear-chain conditional random field on sparse token features, in NumPy.

``features`` of a token are strings; those seen in training have a row of weights, others are ignored.  Sentences are
handled in padded batches: scores are ``emission + transition`` in the exponent, normalised by the forward-backward recursions.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


class ChainCRF:
    def __init__(self, labels: Sequence[str], l2: float = 0.02, steps: int = 60, rate: float = 0.2):
        self.labels, self.l2, self.steps, self.rate = list(labels), l2, steps, rate
        self.index: dict[str, int] = {}

    # -- batches ----------------------------------------------------------------------------------------------
    def _pack(self, sentences):
        """Rows of weights of all tokens (flat, with starts), and the length of each sentence."""
        get = self.index.get
        flat, starts = [], []
        for s in sentences:
            for feats in s:
                starts.append(len(flat))
                flat.append(len(self.index))  # the bias row
                flat.extend(i for f in feats if (i := get(f)) is not None)
        return np.array(flat, np.int64), np.array(starts, np.int64), np.array([len(s) for s in sentences], np.int64)

    def _recursions(self, e: np.ndarray, start: np.ndarray, size: np.ndarray, gamma: np.ndarray) -> np.ndarray:
        """Forward-backward over sentences, the longest first, of ``e`` (labels, tokens); writes their ``gamma`` and returns the expected transitions.

        At each place only the sentences that go on take part, and these are the first columns.
        """
        step, back, begin = (np.exp(x).astype(e.dtype) for x in (self.trans.T, self.trans, self.begin))
        longest = int(size[0])
        going = np.searchsorted(-size, -np.arange(longest), "left")
        alphas, cells, scales = [], [], []
        for i in range(longest):
            n = going[i]
            cell = e[:, start[:n] + i]
            a = cell * begin[:, None] if i == 0 else (step @ alphas[-1][:, :n]) * cell
            total = a.sum(0)
            a /= total
            alphas.append(a)
            cells.append(cell)
            scales.append(total)
        expected = np.zeros(back.shape)
        beta = None
        for i in range(longest - 1, -1, -1):
            n = going[i]
            b = np.ones((len(e), n), e.dtype)
            if beta is not None:
                m = beta.shape[1]
                right = cells[i + 1] * beta / scales[i + 1]
                b[:, :m] = back @ right
                expected += back * (alphas[i][:, :m] @ right.T)
            g = alphas[i] * b
            g /= g.sum(0)
            gamma[:, start[:n] + i] = g
            beta = b
        return expected

    # -- training -----------------------------------------------------------------------------------------------
    def fit(self, sentences, tags) -> ChainCRF:
        """Maximise the penalised likelihood of ``tags`` (label numbers) by Adam steps over all sentences."""
        for s in sentences:
            for feats in s:
                for f in feats:
                    self.index.setdefault(f, len(self.index))
        k, rows = len(self.labels), len(self.index) + 1
        self.weight = np.zeros((rows, k), np.float32)
        self.trans, self.begin = np.zeros((k, k)), np.zeros(k)
        flat, starts, lengths = self._pack(sentences)
        counts = np.diff(np.append(starts, len(flat)))
        by_feature = np.argsort(flat, kind="stable")
        owner = np.repeat(np.arange(len(starts)), counts)[by_feature]
        used, first_of = np.unique(flat[by_feature], return_index=True)
        gold = np.concatenate([np.asarray(x) for x in tags])
        one = np.eye(k, dtype=np.float32)[gold]
        first = np.cumsum(lengths) - lengths
        inner = np.ones(len(gold), bool)
        inner[first[lengths > 0]] = False
        at = np.flatnonzero(inner)
        gold_trans = np.zeros((k, k))
        np.add.at(gold_trans, (gold[at - 1], gold[at]), 1.0)
        order = np.argsort(-lengths, kind="stable")
        order = order[lengths[order] > 0]
        begins = first[order]
        params = [self.weight, self.trans, self.begin]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        gamma = np.zeros((k, len(gold)), np.float32)
        for step in range(1, self.steps + 1):
            score = np.add.reduceat(self.weight[flat], starts, axis=0).T
            e = np.exp(score - score.max(0))
            g_t = self._recursions(e, begins, lengths[order], gamma) - gold_trans
            diff = np.ascontiguousarray(gamma.T) - one
            g_w = np.zeros_like(self.weight)
            g_w[used] = np.add.reduceat(diff[owner], first_of, axis=0)
            g_b = diff[begins].sum(0)
            for n, (p, g) in enumerate(zip(params, (g_w, g_t, g_b))):
                g = g + self.l2 * p * 100
                m[n] = 0.9 * m[n] + 0.1 * g
                v[n] = 0.99 * v[n] + 0.01 * g * g
                p -= self.rate * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.99**step)) + 1e-8)
        return self

    # -- use ------------------------------------------------------------------------------------------------------
    def marginals_of(self, scores: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The probability of each label at each token, of sentences that lie one after another in ``scores`` (tokens, labels)."""
        lengths = np.asarray(lengths)
        e = np.array(scores.T, order="C")
        e -= e.max(0)
        np.exp(e, out=e)
        gamma = np.empty_like(e)
        order = np.argsort(-lengths, kind="stable")
        at = 0
        while at < len(order) and lengths[order[at]]:
            # batches are bounded in tokens of their longest
            part = order[at : at + max(1, 400_000 // int(lengths[order[at]]))]
            at += len(part)
            self._recursions(e, first[part], lengths[part], gamma)
        return gamma.T

    def marginals(self, sentences) -> list[np.ndarray]:
        """For each sentence of token features, the probability of each label at each token."""
        lengths = np.array([len(s) for s in sentences], np.int64)
        if not lengths.sum():
            return [np.zeros((0, len(self.labels))) for _ in sentences]
        flat, starts, _ = self._pack(sentences)
        first = np.cumsum(lengths) - lengths
        gamma = self.marginals_of(np.add.reduceat(self.weight[flat], starts, axis=0), first, lengths)
        return [gamma[a : a + n] for a, n in zip(first, lengths)]
