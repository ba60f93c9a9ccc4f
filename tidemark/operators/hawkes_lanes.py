"""Likelihoods, gradients and information of one series at a cost a few vector operations an event, whatever the decay.

A series is cut into lanes of equal numbers of events, laid side by side: row j holds the j-th event of every lane, and
the recurrence of the decayed states steps down the rows for all lanes at once. A first pass from empty states gives
what each lane adds, lanes are added up over their times, and a second pass starts each lane from what came before.
Only factors exp(-beta dt) <= 1 are formed, so neither short nor long decays overflow or fall back to loops over events.

The second derivatives are replaced by the information, the sum of outer products of the gradients of log intensities:
never negative, exact at the optimum of a linear intensity, and near it for series that follow the model.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

#: Lanes of a long series: their rows stay in a core's cache.
LANES = 4096
#: Rows whose intensities are multiplied before the logarithm is taken.
FACTORS = 8
#: A gradient so many times the information puts a parameter's optimum far below zero; how far its logarithm then goes in a step.
EDGE, LONG = 10.0, 5.0
#: The largest change of a logarithm in any other step.
STEP = 3.0
#: Squared standard errors, and units of log-likelihood, that tell optima apart.
NEAR = 0.1
#: A state that has decayed below this share is nothing.
NOTHING = 1e-18


class Lanes:
    """Events in time, with signs (1 and -1) of their marks where there are two."""

    def __init__(self, t: np.ndarray, end: float, mark: np.ndarray | None = None):
        self.n, self.end = len(t), end
        self.rows = -(-self.n // int(np.clip(self.n // 16, 1, LANES)))
        self.k = -(-self.n // self.rows)
        self.widths = np.full(self.rows, self.k)
        pad = self.k * self.rows - self.n
        if pad:
            self.widths[self.rows - pad :] -= 1
        self.gaps = self._laid(np.diff(t, prepend=t[0]))
        self.sign = None if mark is None else self._laid(1.0 - 2.0 * mark)
        self.last = t[np.minimum(np.arange(1, self.k + 1) * self.rows, self.n) - 1]
        self.after = float(end - t[-1])

    def _laid(self, x: np.ndarray) -> np.ndarray:
        whole = np.zeros(self.k * self.rows)
        whole[: self.n] = x
        return np.ascontiguousarray(whole.reshape(self.k, self.rows).T)

    def _before(self, fade: np.ndarray, beta: float, slopes: bool) -> tuple[list, list]:
        """The states after the last event before each lane, with their derivatives by beta; and those after the last event of all."""
        kinds = [None] if self.sign is None else [None, self.sign]
        state, slope = [np.zeros(self.k) for _ in kinds], [np.zeros(self.k) for _ in kinds]
        tmp = np.empty(self.k)
        for j, w in enumerate(self.widths):
            g, dt, x = fade[j, :w], self.gaps[j, :w], tmp[:w]
            for s, d, sign in zip(state, slope, kinds):
                s, d = s[:w], d[:w]
                s *= g
                if slopes:
                    d *= g
                    np.multiply(dt, s, out=x)
                    d -= x
                s += 1.0 if sign is None else sign[j, :w]
        step = 1
        while step < self.k:
            gap = self.last[step:] - self.last[:-step]
            f = np.exp(-beta * gap)
            if f.max() < NOTHING:
                break
            for s, d in zip(state, slope):
                d[step:] += f * (d[:-step] - gap * s[:-step])
                s[step:] += f * s[:-step]
            step *= 2
        for x in (*state, *slope):
            x[1:], x[0] = x[:-1].copy(), x[-1]
        done = [(float(s[0]), float(d[0])) for s, d in zip(state, slope)]
        for x in (*state, *slope):
            x[0] = 0.0
        return [state, slope], done

    def _mass(self, done: list, beta: float) -> tuple[float, float]:
        """The mass that all events have given by the end, and its derivative by beta."""
        s, d = done[0]
        f = math.exp(-beta * self.after)
        return self.n - f * s, -f * (d - self.after * s)

    def uni(self, theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Minus log-likelihood, gradient and information in the logs of (mu, branching, beta), as hawkes.uni_loglik."""
        mu, br, beta = np.exp(theta)
        a = br * beta
        fade = np.exp(-beta * self.gaps)
        ((s_,), (d_,)), done = self._before(fade, beta, True)
        mass, late = self._mass(done, beta)
        unit = self.n / self.end
        logs, sums, dots = _Logs(self.k), np.zeros(3), np.zeros((3, 3))
        x, lam = np.empty(self.k), np.empty(self.k)
        for j, w in enumerate(self.widths):
            g, s, d, y, r = fade[j, :w], s_[:w], d_[:w], x[:w], lam[:w]
            s *= g
            d *= g
            np.multiply(self.gaps[j, :w], s, out=y)
            d -= y
            np.multiply(s, a / unit, out=r)
            r += mu / unit
            logs.add(r)
            np.divide(mu / unit, r, out=r)  # the share of the baseline
            np.multiply(d, r, out=y)
            sums[0] += r.sum()
            sums[2] += y.sum()
            dots[0, 0] += r @ r
            dots[0, 2] += r @ y
            dots[2, 2] += y @ y
            s += 1.0
        # shares: the baseline's r, the excitation's 1 - r, and, by beta, 1 - r + c y
        c, n = a * beta / mu, self.n
        sums[1], dots[0, 1], dots[1, 1], dots[1, 2] = n - sums[0], sums[0] - dots[0, 0], n - 2 * sums[0] + dots[0, 0], sums[2] - dots[0, 2]
        dots += np.triu(dots, 1).T
        turn = np.array([[1.0, 0, 0], [0, 1, 0], [0, 1, c]])
        value = logs.total() + n * math.log(unit) - mu * self.end - br * mass
        return -value, np.array([mu * self.end, br * mass, a * late]) - turn @ sums, turn @ dots @ turn.T

    def sym(self, theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """As uni, in the logs of (mu0, mu1, self, cross, beta), as hawkes.sym_loglik without a given beta.

        With the signs of marks, the own and the other mark's states are half the sum and half the signed difference
        of the total state and the state of signs.
        """
        mu0, mu1, a, c, beta = np.exp(theta)
        unit = self.n / self.end
        base, tilt, p, q = (mu0 + mu1) / 2, (mu0 - mu1) / 2, (a + c) / 2, (a - c) / 2
        fade = np.exp(-beta * self.gaps)
        ((s_, u_), (d_, e_)), done = self._before(fade, beta, True)
        mass, late = self._mass(done, beta)
        logs, sums, dots = _Logs(self.k), np.zeros(5), np.zeros((5, 5))
        raw, tmp = np.empty((4, self.k)), np.empty(self.k)
        for j, w in enumerate(self.widths):
            g, dt, sign, y = fade[j, :w], self.gaps[j, :w], self.sign[j, :w], tmp[:w]
            s, u, d, e = s_[:w], u_[:w], d_[:w], e_[:w]
            for state, slope in ((s, d), (u, e)):
                state *= g
                slope *= g
                np.multiply(dt, state, out=y)
                slope -= y
            r, signed, turned, by = (x[:w] for x in raw)
            np.multiply(u, beta * q / unit, out=y)
            y += tilt / unit
            y *= sign
            np.multiply(s, beta * p / unit, out=r)
            r += base / unit
            r += y
            logs.add(r)
            np.divide(1.0, r, out=r)
            np.multiply(sign, r, out=signed)
            np.multiply(u, signed, out=turned)
            np.multiply(d, p, out=by)
            by *= r
            np.multiply(e, q, out=y)
            y *= signed
            by += y
            some = (r, signed, turned, by)
            for i, f in enumerate(some):
                sums[i] += f.sum()
                for m in range(i, 4):
                    if (i, m) != (1, 1):
                        dots[i, m] += f @ some[m]
            s += 1.0
            u += sign
        dots[1, 1] = dots[0, 0]
        dots[:4, :4] += np.triu(dots[:4, :4], 1).T
        # the last: the share of the total state is what the others leave
        taken = np.array([base, tilt, beta * q, 0.0]) / unit
        sums[4] = self.n - taken @ sums[:4]
        dots[4, :4] = dots[:4, 4] = sums[:4] - taken @ dots[:4, :4]
        dots[4, 4] = sums[4] - taken @ dots[:4, 4]
        turn = np.zeros((5, 5))
        turn[0, :2], turn[1, :2] = mu0 / 2, (mu1 / 2, -mu1 / 2)
        turn[2, 2], turn[3, 2] = a * beta / 2, -c * beta / 2
        turn /= unit
        turn[2, 4], turn[3, 4] = a / (a + c), c / (a + c)
        turn[4] = turn[2] + turn[3]
        turn[4, 3] = beta * beta / unit
        value = logs.total() + self.n * math.log(unit) - (mu0 + mu1) * self.end - (a + c) * mass
        given = np.array([mu0 * self.end, mu1 * self.end, a * mass, c * mass, (a + c) * beta * late])
        return -value, given - turn @ sums, turn @ dots @ turn.T

    def states(self, beta: float) -> list[np.ndarray]:
        """The state before each event, and for marks that of signs, in order."""
        fade = np.exp(-beta * self.gaps)
        (state, _), _ = self._before(fade, beta, False)
        out = [np.empty((self.rows, self.k)) for _ in state]
        for j, w in enumerate(self.widths):
            for i, s in enumerate(state):
                s = s[:w]
                s *= fade[j, :w]
                out[i][j, :w] = s
                s += 1.0 if i == 0 else self.sign[j, :w]
        return [x.T.reshape(-1)[: self.n] for x in out]


class _Logs:
    """The sum of the logarithms of rows, by their products over a few rows."""

    def __init__(self, k: int):
        self.product, self.count, self.sum = np.ones(k), 0, 0.0

    def add(self, row: np.ndarray) -> None:
        self.product[: len(row)] *= row
        self.count += 1
        if self.count == FACTORS:
            self._take()

    def _take(self) -> None:
        self.sum += float(np.log(self.product).sum())
        self.product[:], self.count = 1.0, 0

    def total(self) -> float:
        self._take()
        return self.sum


class Held:
    """Events of two marks with beta given: their intensities are linear in what is fitted, over states worked out once."""

    def __init__(self, own: np.ndarray, other: np.ndarray, mark: np.ndarray, end: float, beta: float, mass: float):
        self.end, self.beta, self.mass = end, beta, mass
        self.marks = [(own[mark == k], other[mark == k]) for k in (0, 1)]

    @classmethod
    def of(cls, t: np.ndarray, mark: np.ndarray, end: float, beta: float) -> Held:
        if not len(t):
            return cls(np.zeros(0), np.zeros(0), mark, end, beta, 0.0)
        total, signed = Lanes(t, end, mark).states(beta)
        signed *= 1.0 - 2.0 * mark
        mass = len(t) - math.exp(-beta * (end - t[-1])) * (total[-1] + 1)
        return cls((total + signed) / 2, (total - signed) / 2, mark, end, beta, float(mass))

    def sym(self, theta: np.ndarray, block: int = LANES) -> tuple[float, np.ndarray, np.ndarray]:
        """Minus log-likelihood, gradient and information in the logs of (mu0, mu1, self, cross)."""
        p = np.exp(theta)
        value, grad, info = -(p[0] + p[1]) * self.end - (p[2] + p[3]) * self.mass, np.array([p[0] * self.end, p[1] * self.end, p[2] * self.mass, p[3] * self.mass]), np.zeros((4, 4))
        x, lam = np.empty(block), np.empty(block)
        for k, (own, other) in enumerate(self.marks):
            n = len(own)
            if not n:
                continue
            unit = n / self.end
            logs, base, mine, r2, rx, x2 = _Logs(block), 0.0, 0.0, 0.0, 0.0, 0.0
            for lo in range(0, n, block):
                a, b = own[lo : lo + block], other[lo : lo + block]
                y, r = x[: len(a)], lam[: len(a)]
                np.multiply(a, self.beta * p[2] / unit, out=y)
                np.multiply(b, self.beta * p[3] / unit, out=r)
                r += y
                r += p[k] / unit
                logs.add(r)
                np.divide(1.0, r, out=r)
                y *= r
                r *= p[k] / unit
                base, mine = base + r.sum(), mine + y.sum()
                r2, rx, x2 = r2 + r @ r, rx + r @ y, x2 + y @ y
            # shares of the baseline, the own mark's and the other's events add up to 1
            value += logs.total() + n * math.log(unit)
            sums = np.array([base, mine, n - base - mine])
            dots = np.array([[r2, rx, base - r2 - rx], [rx, x2, mine - rx - x2], [base - r2 - rx, mine - rx - x2, n - 2 * (base + mine) + r2 + 2 * rx + x2]])
            at = [k, 2, 3]
            grad[at] -= sums
            info[np.ix_(at, at)] += dots
        return -value, grad, info


def score(f: Callable, x0: np.ndarray, steps: int = 200, fresh: int = 12, tol: float = 1e-7, known: list[tuple[np.ndarray, float]] = ()) -> tuple[np.ndarray, float]:
    """The descent of f giving (value, gradient, information), to a step that promises a gain of less than `tol`.

    x are logs of parameters. The first steps go by the information at each point; where these have not arrived, as with
    a series unlike the model, the last one is corrected by quasi-Newton updates from there on. A parameter whose best
    value is far below zero goes down in long steps. A descent whose next step leads to one of the optima in `known`,
    by a small part of a standard error, ends there.
    """
    x = np.asarray(x0, float)
    v, g, info = f(x)
    inverse = None
    for step in range(steps):
        if not np.isfinite(v):
            break
        edge = g > EDGE * np.diag(info)
        if inverse is None:
            # with logs of parameters, the gradient is a part of the curvature
            a = info + np.diag(np.maximum(g, 0.0))
            a += np.eye(len(x)) * (1e-12 * max(1.0, np.trace(a)))
            d = -np.linalg.solve(a, g)
            if step >= fresh:
                inverse = np.linalg.inv(a)
        else:
            d = -inverse @ g
        if not d @ g < 0:
            inverse, d = np.eye(len(x)), -g
        for at, value in known:
            miss = np.where(edge & (at < x), 0.0, x + d - at)
            if miss @ info @ miss < NEAR and abs(v + d @ g / 2 - value) < NEAR:
                return at, value
        d *= min(1.0, STEP / max(np.abs(d).max(), 1e-300))
        d[edge] = np.minimum(d[edge], -LONG)
        if -(d @ g) < tol:
            break
        t = 1.0
        while t > 1e-12:
            new, ng, ninfo = f(x + t * d)
            if np.isfinite(new) and new <= v + 1e-4 * t * (d @ g):
                break
            t /= 2
        else:
            break
        s, y = t * d, ng - g
        if inverse is not None and s @ y > 1e-12:
            r = 1 / (s @ y)
            e = np.eye(len(x)) - r * np.outer(s, y)
            inverse = e @ inverse @ e.T + r * np.outer(s, s)
        x, v, g, info = x + s, new, ng, ninfo
    return x, v


def fit(plan, parts: list[Callable]) -> dict:
    """The result of a hawkes.Plan for the pooled likelihood of parts, each a function giving (value, gradient, information)."""

    def pooled(x):
        each = [part(x) for part in parts]
        value, grad, info = (sum(e[i] for e in each) for i in range(3))
        v, g = plan.penalty(x, value, grad)
        if v > value:  # a squared excess: its curvature follows from its gradient
            info = info + np.outer(g - grad, g - grad) / (2 * (v - value))
        return v, g, info

    ends: list[tuple[np.ndarray, float]] = []
    for x in reversed(plan.starts):  # the last one is the nearest, if there is one
        ends.append(score(pooled, x, known=ends))
    return plan.best(ends)
