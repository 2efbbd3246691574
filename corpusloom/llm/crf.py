"""Linear-chain conditional random field with two labels.

Emission scores are linear in the features of an item, transition scores form
a 2x2 table.  Training maximises the L2-penalised log-likelihood by L-BFGS with
forward-backward expectations, all sequences at once; decoding is Viterbi.
Label 1 is content, label 0 boilerplate.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Model:
    """w: score of label 1 minus label 0 for each feature; t: transitions[from][to]; start: score of label 1 minus 0 at the first item."""

    w: tuple[float, ...]
    t: tuple[float, float, float, float]
    start: float

    @property
    def trained(self) -> bool:
        return any(self.w)


def untrained(features: int) -> Model:
    """Without labelled rows nothing is known: every item decodes as content."""
    return Model((0.0,) * features, (0.0,) * 4, 1.0)


def viterbi(e: list[float], m: Model) -> list[int]:
    """Best labels, given e = score of label 1 minus label 0 of each item.  On a tie content wins."""
    if not e:
        return []
    t00, t01, t10, t11 = m.t
    s0, s1 = 0.0, e[0] + m.start
    back = []
    for x in e[1:]:
        a, b, c, d = s0 + t00, s1 + t10, s0 + t01, s1 + t11
        back.append((b >= a, d >= c))
        s0, s1 = (b if b >= a else a), (d if d >= c else c) + x
    y = 1 if s1 >= s0 else 0
    out = [y]
    for f0, f1 in reversed(back):
        y = 1 if (f1 if y else f0) else 0
        out.append(y)
    out.reverse()
    return out


def _objective(theta, x, y, lengths, l2):
    """Negative log-likelihood and gradient.  Sequences are padded and sorted by falling length."""
    f = x.shape[2]
    w, t, start = theta[:f], theta[f : f + 4].reshape(2, 2), theta[f + 4]
    n, steps = y.shape
    e = np.zeros((n, steps, 2))
    e[:, :, 1] = x @ w
    e[:, 0, 1] += start
    live = [int(np.searchsorted(-lengths, -(k + 1), "right")) for k in range(steps)]
    alpha, beta = np.zeros((n, steps, 2)), np.zeros((n, steps, 2))
    alpha[:, 0] = e[:, 0]
    for k in range(1, steps):
        a = live[k]
        s = alpha[:a, k - 1, :, None] + t[None]
        top = s.max(1)
        alpha[:a, k] = top + np.log(np.exp(s - top[:, None]).sum(1)) + e[:a, k]
    for k in range(steps - 2, -1, -1):
        a = live[k + 1]
        s = t[None] + (e[:a, k + 1] + beta[:a, k + 1])[:, None, :]
        top = s.max(2)
        beta[:a, k] = top + np.log(np.exp(s - top[:, :, None]).sum(2))
    end = alpha[np.arange(n), lengths - 1]
    top = end.max(1)
    z = top + np.log(np.exp(end - top[:, None]).sum(1))
    mask = np.arange(steps)[None] < lengths[:, None]
    p1 = np.exp(np.clip(alpha[:, :, 1] + beta[:, :, 1] - z[:, None], -700, 0)) * mask
    gold = ((x @ w) * y * mask).sum() + (start * y[:, 0]).sum()
    diff = p1 - y * mask
    g = np.empty_like(theta)
    g[:f] = np.tensordot(diff, x, ([0, 1], [0, 1]))
    g[f + 4] = diff[:, 0].sum()
    gt = np.zeros((2, 2))
    for k in range(1, steps):
        a = live[k]
        if not a:
            break
        s = alpha[:a, k - 1, :, None] + t[None] + (e[:a, k] + beta[:a, k])[:, None, :] - z[:a, None, None]
        gt += np.exp(np.clip(s, -700, 0)).sum(0)
        np.subtract.at(gt, (y[:a, k - 1], y[:a, k]), 1)
        gold += t[y[:a, k - 1], y[:a, k]].sum()
    g[f : f + 4] = gt.ravel()
    return (z.sum() - gold) + 0.5 * l2 * theta @ theta, g + l2 * theta


def train(sequences: list[tuple[np.ndarray, np.ndarray]], features: int, l2: float = 1.0, steps: int = 60) -> Model:
    """Fits the field; sequences are (items x features, labels).  Fewer than two labels among them: untrained()."""
    sequences = sorted((s for s in sequences if len(s[1])), key=lambda s: -len(s[1]))
    if not sequences or len({int(v) for _, y in sequences for v in y}) < 2:
        return untrained(features)
    lengths = np.array([len(y) for _, y in sequences])
    x = np.zeros((len(sequences), lengths[0], features))
    y = np.zeros((len(sequences), lengths[0]), int)
    for i, (a, b) in enumerate(sequences):
        x[i, : len(b)], y[i, : len(b)] = a, b
    theta, memory = np.zeros(features + 5), []
    value, grad = _objective(theta, x, y, lengths, l2)
    for _ in range(steps):
        q, used = grad.copy(), []
        for s, d in reversed(memory):
            r = 1 / (d @ s)
            used.append((r, r * (s @ q), s, d))
            q -= used[-1][1] * d
        if memory:
            s, d = memory[-1]
            q *= (s @ d) / (d @ d)
        else:
            q /= max(1.0, np.abs(grad).sum())
        for r, a, s, d in reversed(used):
            q += s * (a - r * (d @ q))
        rate = 1.0
        for _try in range(20):
            new = theta - rate * q
            v, g = _objective(new, x, y, lengths, l2)
            if v <= value - 1e-4 * rate * (grad @ q):
                break
            rate /= 2
        else:
            break
        if (g - grad) @ (new - theta) > 1e-10:
            memory = [*memory[-7:], (new - theta, g - grad)]
        done = value - v < 1e-5 * max(1.0, abs(value))
        theta, value, grad = new, v, g
        if done:
            break
    theta = [float(v) for v in np.round(theta, 9)]
    return Model(tuple(theta[:features]), tuple(theta[features : features + 4]), theta[features + 4])
