"""Hashed byte-trigram profiles of whole texts and linear classifiers trained on the driver."""

from __future__ import annotations

import numpy as np

DIM = 4096
_CHUNK = 1 << 20
#: ASCII bytes other than letters become one class; bytes of longer code points stay.
_CLASS = np.arange(256, dtype=np.uint32)
_CLASS[:128] = 32
for _c in (*range(65, 91), *range(97, 123)):
    _CLASS[_c] = _c | 32


def has_letter(text: str | None) -> bool:
    """Whether a code point of category L occurs: numerals such as one half or a superscript two are none."""
    return bool(text) and next(filter(str.isalpha, text), None) is not None


def profile(text: str | None, keep_marks: bool = False) -> np.ndarray:
    """Square roots of the shares of the hashed trigrams: a vector of length one, zero for a text without any.

    ``keep_marks`` tells digits, punctuation and capitals apart. Long texts go by in chunks.
    """
    counts = np.zeros(DIM, np.int64)
    text = text or ""
    for i in range(0, len(text), _CHUNK):
        part = text[i : i + _CHUNK + 2]
        b = np.frombuffer((part if keep_marks else part.lower()).encode("utf-8", "replace"), np.uint8)
        c = b.astype(np.uint32) if keep_marks else _CLASS[b]
        if len(c) >= 3:
            h = (c[:-2] | c[1:-1] << 8 | c[2:] << 16) * np.uint32(2654435761)
            counts += np.bincount(h >> np.uint32(20), minlength=DIM)
    total = counts.sum()
    return np.sqrt(counts / total).astype(np.float32) if total else counts.astype(np.float32)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def fit_linear(x: np.ndarray, y: np.ndarray, loss: str = "hinge", reg: float = 1e-4, steps: int = 150) -> np.ndarray:
    """Weights (bias last) for y in {-1, 1} or, with loss "log", also soft targets in between: accelerated gradient descent.

    "hinge" is the squared hinge of a linear support vector machine. Classes weigh the same.
    """
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    pos = y > 0
    weight = np.where(pos, 0.5 / max(1, pos.sum()), 0.5 / max(1, (~pos).sum())).astype(np.float32)
    w = np.zeros(x.shape[1], np.float32)
    v, rate = w.copy(), 1.0 / (2.0 * float((weight * (x * x).sum(1)).sum()) + reg)
    for t in range(steps):
        f = x @ v
        if loss == "hinge":
            g = -2 * weight * y * np.maximum(0, 1 - y * f)
        else:
            g = weight * (sigmoid(f) - (y + 1) / 2)
        new = v - rate * (x.T @ g + reg * v)
        v = new + t / (t + 3) * (new - w)
        w = new
    return w


class OneVersusOne:
    """Linear support vector machines, one for each pair of classes; most votes, then the larger sum of margins."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, reg: float = 1e-4):
        self.classes = sorted(set(labels.tolist()))
        self.pairs = [(i, j) for i in range(len(self.classes)) for j in range(i)]
        w = []
        for i, j in self.pairs:
            of = (labels == self.classes[i]) | (labels == self.classes[j])
            w.append(fit_linear(x[of], np.where(labels[of] == self.classes[i], 1, -1).astype(np.float32), reg=reg))
        self.weights = np.array(w, np.float32).reshape(len(w), x.shape[1] + 1)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the class and a confidence between 0 and 1 for each row."""
        k = len(self.classes)
        if k == 1:
            return np.zeros(len(x), int), np.ones(len(x))
        margin = x @ self.weights[:, :-1].T + self.weights[:, -1]
        votes, total = np.zeros((len(x), k)), np.zeros((len(x), k))
        least = np.full((len(x), k), np.inf)
        for p, (i, j) in enumerate(self.pairs):
            m = margin[:, p]
            votes[:, i] += m > 0
            votes[:, j] += m <= 0
            for c, own in ((i, m), (j, -m)):
                total[:, c] += own
                least[:, c] = np.minimum(least[:, c], own)
        best = np.argmax(votes + np.tanh(total / 100) / 4, axis=1)
        return best, sigmoid(4 * least[np.arange(len(x)), best])
