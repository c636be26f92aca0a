"""Isolation forest and one-class SVM in numpy; fitted on a bounded sample, applied where the rows lie."""

from __future__ import annotations

import hashlib
import io
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .features import BY_NAME, PAIR_FEATURES, training_sample

#: Most rows of a sample, most rows of an SVM's sample, most MiB of a training matrix.
MOST_ROWS, MOST_SVM_ROWS, MOST_MIB = 200_000, 5_000, 512


class ModelError(ValueError):
    """A model can't be fitted or loaded."""


def prepare(x: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """A copy with infinities as NaN and ln(1 + max(x, 0)) on heavy-tailed columns."""
    x = np.where(np.isfinite(x), x, np.nan)
    x[:, heavy] = np.log1p(np.maximum(x[:, heavy], 0))
    return x


@dataclass
class Scaling:
    """Median imputation, then centre and scale; all learned from the sample."""

    fill: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, kind: str) -> Scaling:
        fill = np.nanmedian(x, axis=0)
        x = np.where(np.isnan(x), fill, x)
        zero, one = np.zeros(x.shape[1]), np.ones(x.shape[1])
        if kind == "standard":
            centre, scale = x.mean(axis=0), x.std(axis=0)
        elif kind == "robust":
            q = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
            centre, scale = q[1], q[2] - q[0]
        elif kind == "maxabs":
            centre, scale = zero, np.abs(x).max(axis=0)
        elif kind == "none":
            centre, scale = zero, one
        else:
            raise ModelError(f"unknown scaler {kind!r}")
        return cls(fill, centre, np.where(scale > 0, scale, 1.0))

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (np.where(np.isnan(x), self.fill, x) - self.centre) / self.scale


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    safe = np.maximum(n, 3)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2 * (np.log(safe - 1) + np.euler_gamma) - 2 * (safe - 1) / safe))


@dataclass
class IsolationForest:
    """Random splits isolate unusual points early; the score is 2^(-mean depth / expected depth), higher = more unusual."""

    feature: np.ndarray  # [trees, nodes]; -1 at leaves
    threshold: np.ndarray
    depth: np.ndarray  # of leaves, with the expected rest
    psi: int

    @classmethod
    def fit(cls, x: np.ndarray, n_estimators: int = 200, max_samples: int | float | str = "auto", max_features: float = 1.0, seed: int = 0, **_: object) -> IsolationForest:
        n, d = x.shape
        psi = min(n, 256) if max_samples == "auto" else min(n, max_samples if isinstance(max_samples, int) else max(1, int(max_samples * n)))
        limit = max(1, math.ceil(math.log2(max(psi, 2))))
        nodes = 2 ** (limit + 1) - 1
        feature, threshold, depth = np.full((n_estimators, nodes), -1), np.zeros((n_estimators, nodes)), np.zeros((n_estimators, nodes))
        width = max(1, int(round(max_features * d))) if isinstance(max_features, float) else min(d, max_features)
        for t in range(n_estimators):
            rng = np.random.default_rng([seed, t])
            rows = x[rng.choice(n, psi, replace=False)]
            columns = rng.choice(d, width, replace=False)
            stack = [(0, np.arange(psi), 0)]
            while stack:
                node, own, level = stack.pop()
                part = rows[own]
                low, high = part[:, columns].min(axis=0), part[:, columns].max(axis=0)
                open_ = np.flatnonzero(high > low)
                if level >= limit or len(own) <= 1 or not len(open_):
                    depth[t, node] = level + mean_path(len(own))
                    continue
                c = open_[rng.integers(len(open_))]
                cut = rng.uniform(low[c], high[c])
                feature[t, node], threshold[t, node] = columns[c], cut
                left = part[:, columns[c]] <= cut
                stack += [(2 * node + 1, own[left], level + 1), (2 * node + 2, own[~left], level + 1)]
        return cls(feature, threshold, depth, psi)

    def score(self, x: np.ndarray) -> np.ndarray:
        """All rows go down all trees level by level."""
        total = np.zeros(len(x))
        at_rows = np.arange(len(x))
        for f, cut, depth in zip(self.feature, self.threshold, self.depth, strict=True):
            node = np.zeros(len(x), int)
            for _ in range(int(np.log2(len(f) + 1))):
                own = f[node]
                inner = own >= 0
                go = 2 * node + 1 + (x[at_rows, np.maximum(own, 0)] > cut[node])
                node = np.where(inner, go, node)
            total += depth[node]
        return 2.0 ** (-(total / len(self.feature)) / max(float(mean_path(self.psi)), 1e-9))


@dataclass
class OneClassSVM:
    """nu-one-class SVM by sequential minimal optimisation with second-order working sets; score = -sum(alpha K), higher = more unusual."""

    vectors: np.ndarray
    alpha: np.ndarray
    kind: str
    gamma: float
    degree: int = 3
    coef0: float = 0.0

    def kernel(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.kind == "rbf":
            d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * a @ b.T
            return np.exp(-self.gamma * np.maximum(d, 0))
        dot = a @ b.T
        return dot if self.kind == "linear" else (self.gamma * dot + self.coef0) ** self.degree if self.kind == "poly" else np.tanh(self.gamma * dot + self.coef0)

    @classmethod
    def fit(cls, x: np.ndarray, nu: float = 0.05, kernel: str = "rbf", gamma: str | float = "scale", degree: int = 3, coef0: float = 0.0, tol: float = 1e-3, most_steps: int = 100_000, **_: object) -> OneClassSVM:
        n, d = x.shape
        if kernel not in ("rbf", "linear", "poly", "sigmoid"):
            raise ModelError(f"unknown kernel {kernel!r}")
        g = 1 / (d * x.var()) if gamma == "scale" and x.var() > 0 else 1 / d if isinstance(gamma, str) else float(gamma)
        m = cls(x, np.zeros(n), kernel, g, degree, coef0)
        whole = int(nu * n)
        m.alpha[:whole] = 1
        if whole < n:
            m.alpha[whole] = nu * n - whole
        diag = np.array([m.kernel(x[i : i + 1], x[i : i + 1])[0, 0] for i in range(n)])
        rows: dict[int, np.ndarray] = {}

        def row(i: int) -> np.ndarray:
            if i not in rows:
                if len(rows) >= 2000:
                    rows.pop(next(iter(rows)))
                rows[i] = m.kernel(x[i : i + 1], x)[0]
            return rows[i]

        grad = m.kernel(x, x[m.alpha > 0]) @ m.alpha[m.alpha > 0]
        for _ in range(most_steps):
            up, down = m.alpha < 1 - 1e-12, m.alpha > 1e-12
            i = int(np.argmin(np.where(up, grad, np.inf)))
            gap = np.where(down, grad - grad[i], -np.inf)
            if gap.max() < tol:
                break
            curve = np.maximum(diag[i] + diag - 2 * row(i), 1e-12)
            j = int(np.argmax(np.where(gap > 0, gap * gap / curve, -np.inf)))
            step = min(gap[j] / curve[j], 1 - m.alpha[i], m.alpha[j])
            m.alpha[i] += step
            m.alpha[j] -= step
            grad += step * (row(i) - row(j))
        kept = m.alpha > 1e-12
        m.vectors, m.alpha = x[kept], m.alpha[kept]
        return m

    def score(self, x: np.ndarray, block: int = 4096) -> np.ndarray:
        """In blocks of rows, which bounds the kernel matrix."""
        return np.concatenate([-(self.kernel(x[i : i + block], self.vectors) @ self.alpha) for i in range(0, len(x), block)]) if len(x) else np.zeros(0)


KINDS = {"iforest": IsolationForest, "ocsvm": OneClassSVM}


@dataclass(frozen=True)
class ModelSpec:
    """What to fit."""

    kind: str
    label: str = ""
    scaler: str = "robust"
    settings: dict = field(default_factory=dict)
    seed: int = 0

    @property
    def model_id(self) -> str:
        return f"{self.kind}{'_' + self.label if self.label else ''}"

    def params_hash(self) -> str:
        return hashlib.sha256(repr((self.kind, self.scaler, sorted(self.settings.items()), self.seed)).encode()).hexdigest()[:12]


@dataclass
class FittedModel:
    """A pipeline with its ordered inputs: log1p, median imputation, scaling, estimator."""

    spec: ModelSpec
    features: list[str]
    scaling: Scaling
    estimator: IsolationForest | OneClassSVM
    n_train: int

    def raw_scores(self, x: np.ndarray) -> np.ndarray:
        """Higher = more unusual."""
        return self.estimator.score(self.scaling.apply(prepare(np.asarray(x, float), heavy_columns(self.features))))

    def to_bytes(self) -> bytes:
        """An archive of arrays; reading it runs no code."""
        e = self.estimator
        arrays = {f"s_{k}": getattr(self.scaling, k) for k in ("fill", "centre", "scale")}
        arrays |= {f"e_{k}": np.asarray(v) for k, v in vars(e).items()}
        meta = np.array([self.spec.kind, self.spec.label, self.spec.scaler, repr(sorted(self.spec.settings.items())), str(self.spec.seed), str(self.n_train), *self.features])
        out = io.BytesIO()
        np.savez(out, meta=meta, **arrays)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes, sha256: str | None = None) -> FittedModel:
        """Refuses data that doesn't match its checksum."""
        if sha256 and hashlib.sha256(data).hexdigest() != sha256:
            raise ModelError("the model file was changed")
        import ast

        z = np.load(io.BytesIO(data), allow_pickle=False)
        kind, label, scaler, settings, seed, n_train, *features = z["meta"].tolist()
        kwargs = {k[2:]: (z[k] if z[k].ndim else z[k].item()) for k in z.files if k.startswith("e_")}
        return cls(ModelSpec(kind, label, scaler, dict(ast.literal_eval(settings)), int(seed)), features, Scaling(z["s_fill"], z["s_centre"], z["s_scale"]), KINDS[kind](**kwargs), int(n_train))


def heavy_columns(features: Sequence[str]) -> np.ndarray:
    return np.array([n in PAIR_FEATURES or BY_NAME[n].log1p for n in features])


def fit_model(table: DataFrame, features: Sequence[str], train, spec: ModelSpec, n_days: int, max_rows: int | None = None) -> FittedModel:
    """Fit on a deterministic, bounded sample of the training rows."""
    most = max_rows or (MOST_SVM_ROWS if spec.kind == "ocsvm" else 20_000)
    if most > (MOST_SVM_ROWS if spec.kind == "ocsvm" else MOST_ROWS):
        raise ModelError(f"{spec.kind}: a sample of {most} rows is too large")
    if most * len(features) * 32 / 2**20 > MOST_MIB:
        raise ModelError("the training matrix is too large")
    sample = training_sample(table, train, most, n_days, spec.seed).select("src_ip", "window_start", *[F.col(n).cast("double") for n in features]).toPandas()
    if sample.empty:
        raise ModelError("no training rows")
    sample = sample.sort_values(["src_ip", "window_start"])
    x = prepare(sample[list(features)].to_numpy(float), heavy_columns(features))
    scaling = Scaling.fit(x, spec.scaler)
    settings = dict(spec.settings) | ({"seed": spec.seed} if spec.kind == "iforest" else {})
    return FittedModel(spec, list(features), scaling, KINDS[spec.kind].fit(scaling.apply(x), **settings), len(x))


def score_table(table: DataFrame, models: Sequence[FittedModel]) -> DataFrame:
    """All columns of the table and <model>_raw for each model, in one Arrow pass that carries the features along."""
    ship(table.sparkSession)
    sc = table.sparkSession.sparkContext
    shared = sc.broadcast(list(models))  # fitted on bounded samples

    @F.pandas_udf("array<double>")
    def score(columns: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for frame in columns:
            made = [m.raw_scores(frame[m.features].to_numpy(float)) for m in shared.value]
            yield pd.Series(list(np.stack(made, axis=1)))

    inputs = list(dict.fromkeys(f for m in models for f in m.features))
    out = table.withColumn("__s", score(F.struct(*[F.col(n).cast("double").alias(n) for n in inputs])))
    return out.withColumns({f"{m.spec.model_id}_raw": F.col("__s")[i] for i, m in enumerate(models)}).drop("__s")
