"""Bidirectional gated recurrent encoders with attention pooling, in numpy."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


class Encoder:
    """Two gated recurrent passes, their states pooled by attention.

    Parameters live in one dict, so that a trainer or a broadcast handles them alike.
    """

    def __init__(self, inputs: int, hidden: int, attention: int, rng: np.random.Generator) -> None:
        g = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.h = hidden
        self.p = {"wa": g(2 * hidden, attention), "ba": np.zeros(attention, np.float32), "va": g(attention)}
        for d in "fb":
            self.p |= {f"w{d}": g(inputs, 3 * hidden), f"c{d}": np.zeros(3 * hidden, np.float32), f"u{d}": g(hidden, 3 * hidden)}

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Input parts of the gates, forward and backward; for a fixed vocabulary they can be kept."""
        return x @ self.p["wf"] + self.p["cf"], x @ self.p["wb"] + self.p["cb"]

    def _pass(self, xp: np.ndarray, mask: np.ndarray, u: np.ndarray, back: bool, tape: list | None) -> np.ndarray:
        steps, n, _ = xp.shape
        h, full = self.h, mask.all(axis=1)
        state, out = np.zeros((n, h), np.float32), np.empty((steps, n, h), np.float32)
        for t in range(steps - 1, -1, -1) if back else range(steps):
            rec = state @ u
            gates = xp[t, :, : 2 * h] + rec[:, : 2 * h]
            gates *= np.float32(0.5)
            np.tanh(gates, out=gates)
            gates *= np.float32(0.5)
            gates += np.float32(0.5)
            z, r = gates[:, :h], gates[:, h:]
            new = r * rec[:, 2 * h :]
            new += xp[t, :, 2 * h :]
            np.tanh(new, out=new)
            following = state - new
            following *= z
            following += new
            m = mask[t][:, None]
            if not full[t]:
                following = state + m * (following - state)
            if tape is not None:
                tape.append((t, state, z, r, new, rec[:, 2 * h :], m))
            state = following
            out[t] = state
        return out

    def pool(self, xf: np.ndarray, xb: np.ndarray, mask: np.ndarray, tape: dict | None = None) -> np.ndarray:
        """(steps, n, 3h) twice and (steps, n) -> (n, 2h)."""
        tf, tb = ([], []) if tape is not None else (None, None)
        states = np.concatenate([self._pass(xf, mask, self.p["uf"], False, tf), self._pass(xb, mask, self.p["ub"], True, tb)], axis=2)
        a = np.tanh(states @ self.p["wa"] + self.p["ba"])
        e = a @ self.p["va"] + (mask - 1) * np.float32(1e9)
        w = np.exp(e - e.max(axis=0))
        w /= w.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", w, states)
        if tape is not None:
            tape |= {"f": tf, "b": tb, "states": states, "a": a, "w": w, "pooled": pooled}
        return pooled

    def back(self, d: np.ndarray, tape: dict, x: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters and of the inputs, from that of the pooled states."""
        states, a, w = tape["states"], tape["a"], tape["w"]
        de = w * (np.einsum("nh,tnh->tn", d, states) - np.einsum("nh,nh->n", d, tape["pooled"]))
        da = de[:, :, None] * self.p["va"] * (1 - a * a)
        grads = {"va": np.einsum("tn,tna->a", de, a), "wa": np.einsum("tnh,tna->ha", states, da), "ba": da.sum(axis=(0, 1))}
        ds = w[:, :, None] * d[None] + da @ self.p["wa"].T
        dx = np.zeros(x.shape, np.float32)
        h = self.h
        for name, part in (("f", ds[:, :, :h]), ("b", ds[:, :, h:])):
            u, du = self.p[f"u{name}"], np.zeros_like(self.p[f"u{name}"])
            dxp = np.zeros((*x.shape[:2], 3 * h), np.float32)
            carry = np.zeros(part.shape[1:], np.float32)
            for t, state, z, r, new, rn, m in reversed(tape[name]):
                dh = carry + part[t]
                dnew = dh * m * (1 - z) * (1 - new * new)
                dz = dh * m * (state - new) * z * (1 - z)
                dr = dnew * rn * r * (1 - r)
                drec = np.concatenate([dz, dr, dnew * r], axis=1)
                du += state.T @ drec
                carry = dh * (1 - m * (1 - z)) + drec @ u.T
                dxp[t] = np.concatenate([dz, dr, dnew], axis=1)
            grads |= {f"u{name}": du, f"w{name}": np.einsum("tnd,tng->dg", x, dxp), f"c{name}": dxp.sum(axis=(0, 1))}
            dx += dxp @ self.p[f"w{name}"].T
        return grads, dx


class Adam:
    def __init__(self, rate: float) -> None:
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def step(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = np.float32(min(1.0, 5.0 / (norm + 1e-9)))
        for k, g in grads.items():
            g = g * scale
            m = self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * g
            v = self.v[k] = 0.999 * self.v.get(k, 0) + 0.001 * g * g
            params[k] -= (self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)).astype(np.float32)
