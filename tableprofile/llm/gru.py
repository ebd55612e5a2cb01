"""A gated recurrent layer over numbered inputs, with its gradients, in numpy."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    out = 0.5 * x
    np.tanh(out, out=out)
    out += 1
    out *= 0.5
    return out


def add_rows(into: np.ndarray, places: np.ndarray, rows: np.ndarray) -> None:
    """Add each row at its place; places may repeat."""
    order = np.argsort(places, kind="stable")
    places = places[order]
    begins = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]])[: len(places)])
    if len(begins):
        into[places[begins]] += np.add.reduceat(rows[order], begins)


class Gru:
    """h' = (1 - z) n + z h with z = s(a_z + h U_z), r = s(a_r + h U_r), n = tanh(a_n + r (h U_n)).

    ``inputs`` has a row [a_z, a_r, a_n] for each input number, ``states`` is [U_z, U_r, U_n].
    """

    def __init__(self, inputs: np.ndarray, states: np.ndarray):
        self.inputs, self.states = inputs, states
        self.size = states.shape[0]

    @classmethod
    def random(cls, n_inputs: int, size: int, rng: np.random.Generator) -> Gru:
        scale = 1 / np.sqrt(size)
        inputs = rng.normal(0, 0.3, (n_inputs, 3 * size)).astype(np.float32)
        return cls(inputs, rng.normal(0, scale, (size, 3 * size)).astype(np.float32))

    def step(self, ids: np.ndarray, h: np.ndarray) -> np.ndarray:
        n = self.size
        a, u = self.inputs[ids], h @ self.states
        a[:, : 2 * n] += u[:, : 2 * n]
        gates = sigmoid(a[:, : 2 * n])
        new, held = a[:, 2 * n :], u[:, 2 * n :]
        held *= gates[:, n:]
        new += held
        new = np.tanh(new)
        out = h - new
        out *= gates[:, :n]
        out += new
        return out

    def run(self, ids: np.ndarray, h: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, list]:
        """States after each of ``ids`` (steps, rows), and what the gradient needs.

        Where ``keep`` (steps, rows) is 0, a row starts from an empty state.
        """
        n, states, kept = self.size, [], []
        for t in range(len(ids)):
            if keep is not None:
                h = h * keep[t][:, None]
            a, u = self.inputs[ids[t]], h @ self.states
            gates = sigmoid(a[:, : 2 * n] + u[:, : 2 * n])
            z, r = gates[:, :n], gates[:, n:]
            new = np.tanh(a[:, 2 * n :] + r * u[:, 2 * n :])
            kept.append((h, z, r, new, u[:, 2 * n :]))
            h = new + z * (h - new)
            states.append(h)
        return np.stack(states), kept

    def gradients(
        self, ids: np.ndarray, kept: list, d_states: np.ndarray, keep: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of ``inputs`` and ``states`` from those of the states, back through time."""
        n, (steps, rows) = self.size, ids.shape
        h, z, r, new, u_n = (np.stack(part) for part in zip(*kept, strict=True))
        # What does not depend on the gradient that comes back is worked out for all steps at once.
        factors = np.empty((steps, rows, 3, n), h.dtype)  # of d_z, d_r, d_n
        f_z, f_r, f_n = (factors[:, :, i] for i in range(3))
        rest = 1 - z
        np.multiply(rest, 1 - new * new, out=f_n)
        np.multiply((h - new) * z, rest, out=f_z)
        np.multiply(u_n * r * (1 - r), f_n, out=f_r)
        through = factors.copy()
        through[:, :, 2] *= r
        back = np.ascontiguousarray(self.states.T)
        d_h = np.zeros_like(d_states[0])
        for t in range(steps - 1, -1, -1):
            d_h += d_states[t]
            factors[t] *= d_h[:, None]
            through[t] *= d_h[:, None]
            d_h *= z[t]
            d_h += through[t].reshape(rows, 3 * n) @ back
            if keep is not None:
                d_h *= keep[t][:, None]
        d_inputs = np.zeros_like(self.inputs)
        add_rows(d_inputs, ids.ravel(), factors.reshape(-1, 3 * n))
        return d_inputs, h.reshape(-1, n).T @ through.reshape(-1, 3 * n)


class ColumnGru(Gru):
    """The same layer with a line of memory for each unit, so that a step of many rows runs over whole lines."""

    def step_columns(self, gates: np.ndarray, state: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The next state of each column; ``gates`` has the columns of ``inputs``, and is written over."""
        n = self.size
        u = weights @ state
        both, new = gates[: 2 * n], gates[2 * n :]
        both += u[: 2 * n]
        both *= 0.5
        np.tanh(both, out=both)
        both += 1
        both *= 0.5
        held = u[2 * n :]
        held *= both[n:]
        new += held
        np.tanh(new, out=new)
        out = state - new
        out *= both[:n]
        out += new
        return out

    def before(self, ids: np.ndarray, h: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the state that each of ``ids`` (steps, rows) meets, the last states) as ``run`` has them."""
        weights, state = np.ascontiguousarray(self.states.T), np.ascontiguousarray(h.T)
        found = np.empty((*ids.shape, self.size), self.inputs.dtype)
        emptied = ~keep.all(1)
        for t in range(len(ids)):
            if emptied[t]:
                state = state * keep[t]
            found[t] = state.T
            state = self.step_columns(np.ascontiguousarray(self.inputs[ids[t]].T), state, weights)
        return found, state.T

    def run(self, ids: np.ndarray, h: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, tuple]:
        n, (steps, rows) = self.size, ids.shape
        weights, state = np.ascontiguousarray(self.states.T), np.ascontiguousarray(h.T)
        gates = np.empty((steps, 3 * n, rows), self.inputs.dtype)
        before, held, after = (np.empty((steps, n, rows), gates.dtype) for _ in range(3))
        emptied = np.zeros(steps, bool) if keep is None else ~keep.all(1)
        for t in range(steps):
            gates[t] = self.inputs[ids[t]].T
            np.multiply(state, keep[t] if emptied[t] else 1, out=before[t])
            u = weights @ before[t]
            both, new = gates[t, : 2 * n], gates[t, 2 * n :]
            both += u[: 2 * n]
            both *= 0.5
            np.tanh(both, out=both)
            both += 1
            both *= 0.5
            held[t] = u[2 * n :]
            u[2 * n :] *= both[n:]
            new += u[2 * n :]
            np.tanh(new, out=new)
            state = after[t]
            np.subtract(before[t], new, out=state)
            state *= both[:n]
            state += new
        return after.transpose(0, 2, 1), (before, gates, held)

    def gradients(
        self, ids: np.ndarray, kept: tuple, d_states: np.ndarray, keep: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        n, (steps, rows) = self.size, ids.shape
        before, gates, held = kept
        back = d_states.transpose(0, 2, 1)
        # A step at a time, so that what it works on stays near the processor.
        factors = np.empty((3 * n, steps, rows), gates.dtype)
        rest, through = np.empty((n, rows), gates.dtype), np.empty((3 * n, rows), gates.dtype)
        f_z, f_r, f_n = through[:n], through[n : 2 * n], through[2 * n :]
        d_h, d_weights = np.zeros((n, rows), gates.dtype), np.zeros((n, 3 * n), gates.dtype)
        emptied = np.zeros(steps, bool) if keep is None else ~keep.all(1)
        for t in range(steps - 1, -1, -1):
            z, r, new = gates[t, :n], gates[t, n : 2 * n], gates[t, 2 * n :]
            d_h += back[t]
            np.subtract(1, z, out=rest)
            rest *= d_h
            np.multiply(new, new, out=f_n)
            np.subtract(1, f_n, out=f_n)
            f_n *= rest
            np.subtract(before[t], new, out=f_z)
            rest *= z
            f_z *= rest
            np.subtract(1, r, out=f_r)
            f_r *= r
            f_r *= held[t]
            f_r *= f_n
            factors[:, t] = through
            f_n *= r
            d_weights += before[t] @ through.T
            d_h *= z
            d_h += self.states @ through
            if emptied[t]:
                d_h *= keep[t]
        flat = ids.ravel()
        d_inputs = np.empty_like(self.inputs)
        for i, own in enumerate(factors.reshape(3 * n, -1)):
            d_inputs[:, i] = np.bincount(flat, own, len(d_inputs))
        return d_inputs, d_weights


class Adam:
    """Steps of Adam on named arrays, in place."""

    def __init__(self, arrays: dict[str, np.ndarray], rate: float):
        self.arrays, self.rate, self.n = arrays, rate, 0
        self._first = {k: np.zeros_like(v) for k, v in arrays.items()}
        self._second = {k: np.zeros_like(v) for k, v in arrays.items()}

    def step(self, gradients: dict[str, np.ndarray]) -> None:
        self.n += 1
        length = sum(float(np.vdot(g, g)) for g in gradients.values()) ** 0.5
        scale = min(1.0, 5.0 / (length + 1e-9))
        rate = self.rate * (1 - 0.999**self.n) ** 0.5 / (1 - 0.9**self.n)
        for k, g in gradients.items():
            m, v = self._first[k], self._second[k]
            m *= 0.9
            m += (0.1 * scale) * g
            v *= 0.999
            square = g * g
            square *= 0.001 * scale * scale
            v += square
            down = np.sqrt(v, out=square)
            down += 1e-8
            np.divide(m, down, out=down)
            down *= rate
            self.arrays[k] -= down
