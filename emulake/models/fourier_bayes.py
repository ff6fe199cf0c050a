"""Bayesian regression on random Fourier features: a Gaussian process approximation that fits in one pass.

Frequencies are drawn from the kernel's spectral density (Rahimi & Recht, 2007). A sum of kernels is one block of features for
each, all in the same Gram matrix, which one pass sums over the cluster. The weight posterior, predictive deviation, log
evidence and the evidence's gradient over the variances of the blocks and of the noise are closed forms in that matrix, so
they are optimised without another pass. Each input may have a lengthscale of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emulake.models.base import REGISTRY, Model, numpy_scores
from emulake.models.sums import summed
from emulake.operators.scale import column_stats

KERNELS = ("rbf", "matern12", "matern32", "matern52", "exponential", "rational_quadratic")
# Degrees of freedom of each kernel's frequency distribution.
DOF = {"matern12": 1.0, "exponential": 1.0, "matern32": 3.0, "matern52": 5.0}
STRETCH = {"exponential": 2.0}  # fixed value: exp(-r / 2) is the first Matern kernel with twice the lengthscale
NOISES = (1e-4, 1e-3, 1e-2, 0.1, 0.3, 1.0)  # noise variances tried, in units of the output variance
LINEAR_VARIANCE = 0.1  # fixed value: variance of the added linear part
JITTER = 1e-10  # of the mean diagonal of the weight precision


class Features:
    """Fixed random features of unit variance over standardised inputs: one block for each of ``kernels``.

    ``lengthscale`` is one number or one for each input; the linear kernel has none. Each other kernel has ``n`` features.
    """

    def __init__(self, dim: int, kernels: Sequence[str], lengthscale: float | Sequence[float], n: int, seed: int, alpha: float = 1.0):
        rng = np.random.default_rng(seed)
        scale = np.broadcast_to(np.asarray(lengthscale, dtype=float), (dim,))
        if not (scale > 0).all():
            raise ValueError("lengthscales must be positive")
        self.kernels, self.blocks = list(kernels), []
        for kernel in kernels:
            if kernel == "linear":
                self.blocks.append(None)
                continue
            if kernel not in KERNELS:
                raise ValueError(f"unknown kernel {kernel!r}")
            w = rng.standard_normal((dim, n))
            if kernel in DOF:
                w = w / np.sqrt(rng.chisquare(DOF[kernel], n) / DOF[kernel])
            elif kernel == "rational_quadratic":
                w = w * np.sqrt(rng.gamma(alpha, 1.0 / alpha, n))
            self.blocks.append((w / (scale * STRETCH.get(kernel, 1.0))[:, None], rng.uniform(0, 2 * np.pi, n)))
        widths = [dim if b is None else n for b in self.blocks]
        self.width = sum(widths)
        self.owner = np.repeat(np.arange(len(widths)), widths)  # block of each feature

    def __call__(self, z: np.ndarray) -> np.ndarray:
        return np.concatenate([z if b is None else np.sqrt(2.0 / len(b[1])) * np.cos(z @ b[0] + b[1]) for b in self.blocks], axis=1)


def evidence(gram: np.ndarray, cross: np.ndarray, yy: float, n: float, noise: float, prior: float | np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(log evidence, weight mean, Cholesky factor of the weight precision); ``prior`` is the variance of all or of each weight."""
    d = len(gram)
    v = np.broadcast_to(np.asarray(prior, dtype=float), (d,))
    a = gram / noise + np.diag(1 / v)
    chol = np.linalg.cholesky(a + JITTER * np.trace(a) / d * np.eye(d))
    mean = np.linalg.solve(chol.T, np.linalg.solve(chol, cross / noise))
    fit = (yy - 2 * mean @ cross + mean @ gram @ mean) / noise + mean @ (mean / v)
    logdet = 2 * np.sum(np.log(np.diag(chol)))
    return float(-0.5 * (fit + logdet + np.sum(np.log(v)) + n * np.log(2 * np.pi * noise))), mean, chol


def evidence_gradient(gram: np.ndarray, cross: np.ndarray, yy: float, n: float, noise: float, variances: np.ndarray, owner: np.ndarray) -> tuple[float, np.ndarray]:
    """(log evidence, its gradient over the logarithms of the block variances and, last, of the noise)."""
    value, mean, chol = evidence(gram, cross, yy, n, noise, variances[owner])
    half = np.linalg.inv(chol)
    spread = np.sum(half**2, axis=0)  # posterior variance of each weight
    own = np.bincount(owner, weights=spread + mean**2, minlength=len(variances)) / variances
    over = 0.5 * (own - np.bincount(owner, minlength=len(variances)))
    rest = yy - 2 * mean @ cross + mean @ gram @ mean
    explained = np.sum((half @ gram) * half)
    return value, np.append(over, 0.5 * ((rest + explained) / noise - n))


def ascend(fn: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, low: float, high: float, steps: int = 200, tol: float = 1e-9) -> np.ndarray:
    """The point where quasi-Newton steps with halved lengths no longer raise ``fn`` (value, gradient) inside [low, high]."""
    x = np.clip(start, low, high)
    value, grad = fn(x)
    curve = np.eye(len(x))
    for _ in range(steps):
        step = curve @ grad
        if step @ grad <= 0:
            curve, step = np.eye(len(x)), grad
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-300))
        for _ in range(40):
            there = np.clip(x + step, low, high)
            new, new_grad = fn(there)
            if new > value + 1e-4 * grad @ (there - x):
                break
            step = step / 2
        else:
            return x
        s, y, gain = there - x, grad - new_grad, new - value
        x, value, grad = there, new, new_grad
        if s @ y > 1e-12:
            r = np.eye(len(x)) - np.outer(s, y) / (s @ y)
            curve = r @ curve @ r.T + np.outer(s, s) / (s @ y)
        if gain <= tol * (1 + abs(value)):
            return x
    return x


class FourierBayes(Model):
    """kernel or kernels (a sum; "linear" may be one of them), lengthscale (one, or one for each input), variance, linear_variance,
    n_features, noise (None picks it by evidence), linear (adds a linear part to a single kernel), optimize, seed.

    In a sum every kernel has ``variance`` and the linear one ``linear_variance``; a single kernel's ``variance`` multiplies
    the added linear part too. With ``optimize`` these variances and the noise are starting points: each output gets those
    that raise its log evidence most. ``optimize="lengthscales"`` first improves the lengthscales, input by input.
    """

    key = "fourier_bayes"
    aliases = ("gp", "gpr")
    has_std = True

    def _kernels(self, kernel: str | None = None) -> list[str]:
        p = self.params
        if p.get("kernels") and kernel is None:
            if len(set(p["kernels"])) < len(p["kernels"]):
                raise ValueError("a kernel is twice in the sum")
            return list(p["kernels"])
        kernel = kernel or p.get("kernel", "rbf")
        return [kernel, "linear"] if kernel != "linear" and p.get("linear", True) else [kernel]

    def _features(self, kernel: str | None = None, lengthscale: float | Sequence[float] | None = None) -> Features:
        p = self.params
        return Features(len(self.inputs), self._kernels(kernel), p.get("lengthscale", 1.0) if lengthscale is None else lengthscale,
                        int(p.get("n_features", 128)), int(p.get("seed", 42)))

    def _variances(self, kernels: Sequence[str]) -> np.ndarray:
        p = self.params
        own, line = float(p.get("variance", 1.0)), float(p.get("linear_variance", LINEAR_VARIANCE))
        return np.array([(line if p.get("kernels") else line * own) if k == "linear" else own for k in kernels])

    def _centre(self, train: DataFrame) -> None:
        got = column_stats(train, [*self.inputs, *self.outputs], {"m": F.avg, "s": F.stddev_pop})
        self.mx, self.my = (np.array([got[c]["m"] for c in cs]) for cs in (self.inputs, self.outputs))
        self.sx, self.sy = (np.array([got[c]["s"] or 1.0 for c in cs]) for cs in (self.inputs, self.outputs))

    def _grams(self, train: DataFrame, candidates: list[Features]) -> list[tuple]:
        """Gram, cross and output sums of every candidate feature map from one pass."""
        mx, sx, my, sy = self.mx, self.sx, self.my, self.sy
        q = len(self.outputs)

        def block(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            z, t = (x - mx) / sx, (y - my) / sy
            parts = [np.array([float(len(x))]), np.einsum("ij,ij->j", t, t)]
            for f in candidates:
                phi = f(z)
                parts += [(phi.T @ phi).ravel(), (phi.T @ t).ravel()]
            return np.concatenate(parts)

        flat = summed(train, {"x": self.inputs, "y": self.outputs}, block)
        if flat is None:
            raise ValueError("no training rows")
        n, yy, at, out = flat[0], flat[1:1 + q], 1 + q, []
        for f in candidates:
            d = f.width
            gram, at = flat[at:at + d * d].reshape(d, d), at + d * d
            cross, at = flat[at:at + d * q].reshape(d, q), at + d * q
            out.append((gram, cross, yy, n))
        return out

    def fit(self, train: DataFrame, val: DataFrame | None = None) -> FourierBayes:
        self._centre(train)
        if self.params.get("optimize") == "lengthscales":
            self.phi, sums = self._better_lengthscales(train)
        else:
            self.phi = self._features()
            sums = self._grams(train, [self.phi])[0]
        self._solve(*sums)
        return self

    def _solve(self, gram: np.ndarray, cross: np.ndarray, yy: np.ndarray, n: float) -> None:
        given, owner = self.params.get("noise"), self.phi.owner
        start = self._variances(self.phi.kernels)
        self.mean, self.chol, self.noise, self.log_evidence, self.variances = [], [], [], [], []
        for k in range(len(self.outputs)):
            c, y = cross[:, k], yy[k]
            _, noise = max((evidence(gram, c, y, n, s, start[owner])[0], s) for s in ([float(given)] if given else NOISES))
            variances = start
            if self.params.get("optimize"):
                best = ascend(lambda t: evidence_gradient(gram, c, y, n, np.exp(t[-1]), np.exp(t[:-1]), owner), np.log(np.append(start, noise)), *np.log([1e-8, 1e8]))
                variances, noise = np.exp(best[:-1]), float(np.exp(best[-1]))
            ev, mean, chol = evidence(gram, c, y, n, noise, variances[owner])
            self.mean.append(mean)
            self.chol.append(chol)
            self.noise.append(noise)
            self.log_evidence.append(ev)
            self.variances.append(variances)

    def _better_lengthscales(self, train: DataFrame) -> tuple[Features, tuple]:
        """Features and sums of the lengthscales from which neither half nor twice any input's raises the evidence.

        A round is one pass that sums the Grams of both choices of every input; the best one is taken. ``rounds`` bounds them.
        """
        dim = len(self.inputs)
        scale, best, tried = np.array(np.broadcast_to(self.params.get("lengthscale", 1.0), (dim,)), dtype=float), None, set()
        for _ in range(int(self.params.get("rounds", 12))):
            grid = [scale, *(scale * np.where(np.arange(dim) == j, f, 1.0) for j in range(dim) for f in (0.5, 2.0))]
            grid = [g for g in grid if tuple(g) not in tried]
            tried |= {tuple(g) for g in grid}
            before = best and best[0]
            maps = [self._features(None, g) for g in grid]
            for g, self.phi, sums in zip(grid, maps, self._grams(train, maps) if maps else []):
                self._solve(*sums)
                total = float(sum(self.log_evidence))
                if best is None or total > best[0]:
                    best = total, g, self.phi, sums
            if best[0] == before:
                break
            scale = best[1]
        self.params["lengthscale"] = [float(x) for x in best[1]]
        return best[2], best[3]

    def search(self, train: DataFrame, kernels: Sequence[str] = ("matern32", "matern52", "rbf", "exponential"),
               lengthscales: Sequence[float] = tuple(0.25 * i for i in range(1, 9)), variances: Sequence[float] = (0.5, 1.0, 1.5, 2.0)) -> list[dict]:
        """Try every kernel, lengthscale and variance, keep the best total log evidence; returns the table.

        All feature maps share one pass; variances and noises need none, they only rescale the prior. A kernel may be a sum,
        written ``rbf+linear``. The linear kernel alone has no lengthscale and is tried once for each variance.
        """
        self._centre(train)
        grid = [(k, ls) for k in kernels for ls in (lengthscales if k != "linear" else lengthscales[:1])]
        sums_of = {k: k.split("+") for k in kernels if "+" in k}

        def chosen(kernel: str) -> dict[str, Any]:
            return {"kernels": sums_of[kernel]} if kernel in sums_of else {"kernels": None, "kernel": kernel}

        maps = []
        for k, ls in grid:
            self.params.update(chosen(k))
            maps.append(self._features(None, ls))
        rows, best = [], None
        for (k, ls), f, sums in zip(grid, maps, self._grams(train, maps)):
            self.params.update(chosen(k))
            self.phi = f
            for v in variances:
                self.params["variance"] = v
                self._solve(*sums)
                total = float(sum(self.log_evidence))
                rows.append({"kernel": k, "lengthscale": float(ls), "variance": float(v), "log_evidence": total})
                if best is None or total > best[0]:
                    best = (total, k, ls, v, f, sums)
        _, k, ls, v, self.phi, sums = best
        self.params.update(chosen(k), lengthscale=float(ls), variance=float(v))
        self._solve(*sums)
        return rows

    def _predictors(self):
        phi, mx, sx, my, sy = self.phi, self.mx, self.sx, self.my, self.sy
        w = np.stack(self.mean, axis=1)
        factors = list(self.chol)

        def predict(x: np.ndarray) -> np.ndarray:
            return phi((x - mx) / sx) @ w * sy + my

        def std(x: np.ndarray) -> np.ndarray:
            f = phi((x - mx) / sx)
            return np.stack([np.sqrt(np.sum(np.linalg.solve(c, f.T) ** 2, axis=0)) * s for c, s in zip(factors, sy)], axis=1)

        return predict, std

    def predictor(self):
        return self._predictors()[0]

    def score(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        return numpy_scores(df, self.inputs, self.outputs, keep, self.predictor())

    def score_std(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        return numpy_scores(df, self.inputs, self.outputs, keep, *self._predictors())

    def sample_posterior(self, df: DataFrame, keep: Sequence[str], n: int, seed: int = 42) -> DataFrame:
        """(keep..., sample, output, y_pred): n functions drawn from the posterior, the same ones for every row."""
        rng = np.random.default_rng(seed)
        draws = [m[:, None] + np.linalg.solve(c.T, rng.standard_normal((len(m), n))) for m, c in zip(self.mean, self.chol)]
        phi, mx, sx, my, sy = self.phi, self.mx, self.sx, self.my, self.sy
        w = np.concatenate(draws, axis=1)
        shift, scale = np.repeat(my, n), np.repeat(sy, n)

        def predict(x: np.ndarray) -> np.ndarray:
            return phi((x - mx) / sx) @ w * scale + shift

        names = [f"{s}|{o}" for o in self.outputs for s in range(n)]
        long = numpy_scores(df, self.inputs, names, keep, predict)
        parts = F.split("output", r"\|", 2)
        return long.select(*keep, parts[0].cast("int").alias("sample"), parts[1].alias("output"), "y_pred")

    def size(self) -> dict[str, int]:
        return {"weights": int(sum(len(m) for m in self.mean))}

    def state(self) -> dict[str, Any]:
        return {"mx": self.mx, "sx": self.sx, "my": self.my, "sy": self.sy, "mean": self.mean, "chol": self.chol, "noise": self.noise,
                "variances": self.variances, "log_evidence": self.log_evidence}

    def restore(self, state: dict[str, Any]) -> FourierBayes:
        self.mx, self.sx, self.my, self.sy = (np.array(state[k]) for k in ("mx", "sx", "my", "sy"))
        self.mean, self.chol = ([np.array(v) for v in state[k]] for k in ("mean", "chol"))
        self.noise, self.log_evidence = list(state["noise"]), list(state["log_evidence"])
        self.variances = [np.array(v) for v in state["variances"]]
        self.phi = self._features()
        return self


REGISTRY.register(FourierBayes)
