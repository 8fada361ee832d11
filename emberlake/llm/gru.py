"""Bidirectional gated recurrent layers with attention pooling, forward and backward, in numpy."""

from __future__ import annotations

import numpy as np


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def run(x, valid, u, reverse: bool, keep: bool):
    """States of one direction. ``x``: (n, t, 3h) projected inputs; ``valid``: (n, t); ``u``: (h, 3h).

    Returns the states (n, t, h) and, if ``keep``, what the backward pass needs.
    """
    n, t, h3 = x.shape
    h = h3 // 3
    states = np.zeros((n, t, h), np.float32)
    state = np.zeros((n, h), np.float32)
    saved = []
    for i in range(t - 1, -1, -1) if reverse else range(t):
        a = state @ u
        xi = x[:, i]
        gates = sigmoid(xi[:, : 2 * h] + a[:, : 2 * h])
        z, r = gates[:, :h], gates[:, h:]
        new = np.tanh(xi[:, 2 * h :] + r * a[:, 2 * h :])
        m = valid[:, i, None]
        nxt = np.where(m, new + z * (state - new), state)
        if keep:
            saved.append((i, state, z, r, new, a[:, 2 * h :], m))
        states[:, i] = state = nxt
    return states, saved


def run_back(d_states, saved, u):
    """Gradients of ``x`` and ``u``."""
    n, t, h = d_states.shape
    dx = np.zeros((n, t, 3 * h), np.float32)
    du = np.zeros_like(u)
    carry = np.zeros((n, h), np.float32)
    for i, before, z, r, new, an, m in reversed(saved):
        d = d_states[:, i] + carry
        live = np.where(m, d, 0)
        dz = live * (before - new) * z * (1 - z)
        dn = live * (1 - z) * (1 - new * new)
        dr = dn * an * r * (1 - r)
        da = np.concatenate([dz, dr, dn * r], 1)
        dx[:, i] = np.concatenate([dz, dr, dn], 1)
        du += before.T @ da
        carry = np.where(m, d * z, d) + da @ u.T
    return dx, du


class Pooled:
    """A bidirectional layer with attention pooling over one axis; weights live in ``w`` under ``name``."""

    def __init__(self, w: dict, name: str, inputs: int, hidden: int, rng=None):
        self.w, self.name, self.hidden = w, name, hidden
        if rng is not None:
            init = lambda *s: (rng.normal(0, 1 / np.sqrt(s[0]), s)).astype(np.float32)
            w[name + ".in"], w[name + ".b"] = init(inputs, 6 * hidden), np.zeros(6 * hidden, np.float32)
            w[name + ".uf"], w[name + ".ub"] = init(hidden, 3 * hidden), init(hidden, 3 * hidden)
            w[name + ".att"], w[name + ".ab"] = init(2 * hidden, hidden), np.zeros(hidden, np.float32)
            w[name + ".v"] = init(hidden, 1)[:, 0] * 2

    def project(self, inputs):
        return inputs @ self.w[self.name + ".in"] + self.w[self.name + ".b"]

    def forward(self, x, valid, keep: bool = False):
        """``x``: (n, t, 6h) projected inputs. Returns the pooled states (n, 2h)."""
        w, k, h3 = self.w, self.name, 3 * self.hidden
        f, sf = run(x[:, :, :h3], valid, w[k + ".uf"], False, keep)
        b, sb = run(x[:, :, h3:], valid, w[k + ".ub"], True, keep)
        states = np.concatenate([f, b], 2)
        t = np.tanh(states @ w[k + ".att"] + w[k + ".ab"])
        e = np.where(valid, t @ w[k + ".v"], -1e9)
        p = np.exp(e - e.max(1, keepdims=True)) * valid
        p /= np.maximum(p.sum(1, keepdims=True), 1e-9)
        if keep:
            self.saved = (states, t, p, sf, sb)
        return np.einsum("nt,nth->nh", p, states)

    def backward(self, d, grads: dict):
        """Gradient of the projected inputs; adds those of weights to ``grads``."""
        w, k = self.w, self.name
        states, t, p, sf, sb = self.saved
        dp = np.einsum("nh,nth->nt", d, states)
        ds = p[:, :, None] * d[:, None, :]
        de = p * (dp - (p * dp).sum(1, keepdims=True))
        grads[k + ".v"] += np.einsum("nt,nth->h", de, t)
        dt = de[:, :, None] * w[k + ".v"] * (1 - t * t)
        grads[k + ".att"] += np.einsum("nti,ntj->ij", states, dt)
        grads[k + ".ab"] += dt.sum((0, 1))
        ds += dt @ w[k + ".att"].T
        h = self.hidden
        xf, uf = run_back(ds[:, :, :h], sf, w[k + ".uf"])
        xb, ub = run_back(ds[:, :, h:], sb, w[k + ".ub"])
        grads[k + ".uf"] += uf
        grads[k + ".ub"] += ub
        return np.concatenate([xf, xb], 2)

    def project_back(self, inputs, dx, grads: dict):
        grads[self.name + ".in"] += inputs.T @ dx
        grads[self.name + ".b"] += dx.sum(0)
        return dx @ self.w[self.name + ".in"].T


class Adam:
    def __init__(self, w: dict, rate: float):
        self.w, self.rate, self.t = w, rate, 0
        self.m, self.s = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))

    def step(self, grads: dict) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = min(1.0, 5.0 / (norm + 1e-9))
        for k, g in grads.items():
            g = g * scale
            self.m[k] += 0.1 * (g - self.m[k])
            self.s[k] += 0.01 * (g * g - self.s[k])
            rate = self.rate * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
            self.w[k] -= (rate * self.m[k] / (np.sqrt(self.s[k]) + 1e-6)).astype(self.w[k].dtype)
