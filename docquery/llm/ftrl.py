"""FTRL-proximal learning of sparse (multinomial) logistic models with elastic-net penalties.

McMahan et al., "Ad Click Prediction: a View from the Trenches" (2013): every coordinate has its own
learning rate, and the L1 penalty keeps the weights of uninformative features at exactly zero.
"""

from __future__ import annotations

import numpy as np


class Ftrl:
    """One weight vector for each of k classes over `dim` hashed features; k = 1 is plain logistic regression."""

    def __init__(self, dim: int, k: int = 1, alpha: float = 0.1, beta: float = 1.0, l1: float = 1.0, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2, self.k = alpha, beta, l1, l2, k
        self.z, self.n = np.zeros((dim, k)), np.zeros((dim, k))

    def weights(self, idx: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[idx], self.n[idx]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def step(self, idx: np.ndarray, val: np.ndarray, label: int) -> None:
        """One example: distinct feature indices, their values, and its class (0 or 1 if k = 1)."""
        w = self.weights(idx)
        p = probabilities(val @ w)
        y = np.zeros(self.k)
        if self.k == 1:
            y[0] = label
        else:
            y[label] = 1
        g = val[:, None] * (p - y)
        new = self.n[idx] + g * g
        self.z[idx] += g - (np.sqrt(new) - np.sqrt(self.n[idx])) / self.alpha * w
        self.n[idx] = new


def probabilities(logits: np.ndarray) -> np.ndarray:
    """Sigmoid of one logit, softmax of several, over the last axis."""
    if logits.shape[-1] == 1:
        return 0.5 * (1 + np.tanh(0.5 * logits))
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The T that minimises the negative log-likelihood of softmax(logits / T), by golden-section search on log T."""
    if not len(labels):
        return 1.0

    def loss(u: float) -> float:
        p = probabilities(logits / np.exp(u))
        return -float(np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean())

    lo, hi, r = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        if loss(a) <= loss(b):
            hi = b
        else:
            lo = a
    return float(np.exp((lo + hi) / 2))
