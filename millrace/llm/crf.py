"""A linear-chain conditional random field with two labels, in numpy: training and Viterbi decoding.

Label 1 has the score of its unit's features, label 0 has none; transitions, start and end have weights
of their own. Training maximises the penalised log-likelihood by Adam over all chains at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Chain:
    """trans[i, j]: from label i to j; start and end by label."""

    trans: np.ndarray
    start: np.ndarray
    end: np.ndarray


def viterbi(score: np.ndarray, lengths: np.ndarray, chain: Chain) -> np.ndarray:
    """Best labels of many chains laid end to end; score is that of label 1 for each unit."""
    n = len(lengths)
    labels = np.zeros(len(score), dtype=np.int8)
    if not n or not len(score):
        return labels
    begin = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    size, at = lengths[order], begin[order]
    steps = int(size[0])
    back = np.zeros((steps, len(order), 2), dtype=np.int8)
    best = np.zeros((len(order), 2))
    best[:] = chain.start
    best[:, 1] += score[at]
    for t in range(1, steps):
        live = int(np.searchsorted(-size, -t, side="left"))
        via = best[:live, :, None] + chain.trans[None]
        choice = via.argmax(axis=1)
        back[t, :live] = choice
        new = np.take_along_axis(via, choice[:, None, :], axis=1)[:, 0, :]
        new[:, 1] += score[at[:live] + t]
        best[:live] = new
    cur = (best + chain.end).argmax(axis=1).astype(np.int8)
    for t in range(steps - 1, -1, -1):
        live = int(np.searchsorted(-size, -t, side="left")) if t else len(size)
        labels[at[:live] + t] = cur[:live]
        if t:
            cur[:live] = back[t, np.arange(live), cur[:live]]
    return labels


def train(
    features: list[list[list[int]]], labels: list[list[int]], n_features: int, epochs: int = 150, rate: float = 0.1, l2: float = 0.3
) -> tuple[np.ndarray, Chain]:
    """features[page][unit] lists feature numbers; labels[page][unit] is 0 or 1."""
    units = [u for p in features for u in p]
    index = np.array([f for u in units for f in u], dtype=np.int64)
    sizes = np.array([len(u) for u in units])
    owner = np.repeat(np.arange(len(units)), sizes)
    y = np.array([v for p in labels for v in p], dtype=np.int64)
    lengths = np.array([len(p) for p in features])
    pages, steps = len(lengths), int(lengths.max())
    mask = np.arange(steps)[None, :] < lengths[:, None]
    grid = np.zeros((pages, steps))
    gold = np.zeros((pages, steps), dtype=np.int64)
    gold[mask] = y
    w = np.zeros(n_features + 8)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for epoch in range(1, epochs + 1):
        score = np.bincount(owner, weights=w[index], minlength=len(units))
        grid[mask] = score
        c = Chain(w[-8:-4].reshape(2, 2), w[-4:-2], w[-2:])
        emit = np.stack([np.zeros_like(grid), grid], axis=2)
        alpha = np.zeros((pages, steps, 2))
        beta = np.zeros((pages, steps, 2))
        alpha[:, 0] = c.start + emit[:, 0]
        for t in range(1, steps):
            a = np.logaddexp(alpha[:, t - 1, 0, None] + c.trans[0], alpha[:, t - 1, 1, None] + c.trans[1]) + emit[:, t]
            alpha[:, t] = np.where(mask[:, t, None], a, alpha[:, t - 1])
        last = lengths - 1
        beta[np.arange(pages), last] = c.end
        for t in range(steps - 2, -1, -1):
            nxt = emit[:, t + 1] + beta[:, t + 1]
            b = np.logaddexp(nxt[:, 0, None] + c.trans[:, 0], nxt[:, 1, None] + c.trans[:, 1])
            beta[:, t] = np.where((t < last)[:, None], b, beta[:, t])
        total = np.logaddexp(*(alpha[:, -1] + c.end).T)
        node = np.exp(alpha + beta - total[:, None, None]) * mask[:, :, None]
        g = np.zeros_like(w)
        unit_grad = node[:, :, 1][mask] - y
        g[:-8] = np.bincount(index, weights=np.repeat(unit_grad, sizes), minlength=n_features)
        both = mask[:, 1:]
        for i in range(2):
            for j in range(2):
                e = np.exp(alpha[:, :-1, i] + c.trans[i, j] + emit[:, 1:, j] + beta[:, 1:, j] - total[:, None]) * both
                g[n_features + 2 * i + j] = e.sum() - ((gold[:, :-1] == i) & (gold[:, 1:] == j) & both).sum()
        first, final = gold[:, 0], gold[np.arange(pages), last]
        for i in range(2):
            g[n_features + 4 + i] = node[:, 0, i].sum() - (first == i).sum()
            g[n_features + 6 + i] = node[np.arange(pages), last, i].sum() - (final == i).sum()
        g = g + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8)
    return w[:-8], Chain(w[-8:-4].reshape(2, 2), w[-4:-2], w[-2:])
