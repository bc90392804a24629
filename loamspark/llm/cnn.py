"""A small byte convolutional network in numpy: embedding, filters of several widths, max pooling, softmax."""

from __future__ import annotations

import numpy as np

EMBED, WIDTHS, FILTERS = 8, (2, 3, 4), 16
WIDEST = max(WIDTHS)


class ByteCNN:
    """Classifies fixed-length byte windows (rows of a uint8 matrix)."""

    def __init__(self, classes: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        n = FILTERS * len(WIDTHS)
        self.emb = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.conv = rng.normal(0, 0.2, (WIDEST * EMBED, n)).astype(np.float32)
        self.mask = np.concatenate([np.repeat((np.arange(WIDEST * EMBED) < w * EMBED).astype(np.float32)[:, None], FILTERS, 1) for w in WIDTHS], 1)
        self.conv *= self.mask
        self.bias = np.zeros(n, np.float32)
        self.out = rng.normal(0, 0.1, (n, classes)).astype(np.float32)
        self.out_bias = np.zeros(classes, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.emb, self.conv, self.bias, self.out, self.out_bias]

    def _pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e = self.emb[x].reshape(len(x), -1)
        places = x.shape[1] - WIDEST + 1
        windows = np.lib.stride_tricks.as_strided(e, (len(x), places, WIDEST * EMBED), (e.strides[0], EMBED * e.itemsize, e.itemsize))
        return windows, (np.ascontiguousarray(windows).reshape(-1, WIDEST * EMBED) @ self.conv).reshape(len(x), places, -1)

    def log_probabilities(self, x: np.ndarray, batch: int = 256) -> np.ndarray:
        out = np.empty((len(x), self.out.shape[1]), np.float32)
        for i in range(0, len(x), batch):
            pooled = np.maximum(self._pooled(x[i : i + batch])[1].max(1) + self.bias, 0)
            z = pooled @ self.out + self.out_bias
            z -= z.max(1, keepdims=True)
            out[i : i + batch] = z - np.log(np.exp(z).sum(1, keepdims=True))
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, seed: int = 0, batch: int = 128, rate: float = 3e-3) -> ByteCNN:
        """Adam on cross entropy; gradients flow through each filter's best place."""
        rng, step = np.random.default_rng(seed), 0
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.parameters()]
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                rows = order[i : i + batch]
                step += 1
                for p, g, (m, v) in zip(self.parameters(), self._gradients(x[rows], y[rows]), moments, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        n = len(x)
        windows, conv = self._pooled(x)
        best = conv.argmax(1)
        raw = np.take_along_axis(conv, best[:, None, :], 1)[:, 0] + self.bias
        pooled = np.maximum(raw, 0)
        z = pooled @ self.out + self.out_bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(n), y] -= 1
        p /= n
        back = (p @ self.out.T) * (raw > 0)
        taken = windows[np.arange(n)[:, None], best]
        d_conv = np.einsum("nf,nfk->kf", back, taken) * self.mask
        d_taken = (back[:, :, None] * self.conv.T[None]).reshape(-1, EMBED)
        places = x[np.arange(n)[:, None, None], best[:, :, None] + np.arange(WIDEST)].reshape(-1)
        d_emb = np.zeros_like(self.emb)
        np.add.at(d_emb, places, d_taken)
        return [d_emb, d_conv, back.sum(0), pooled.T @ p, p.sum(0)]
