"""Metrics that fit a model: likelihood and detection by sums over Arrow batches, attackers by ``pyspark.ml``."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from tabloom.fidelity.marginal import numeric_view
from tabloom.functions.order import numbered
from tabloom.functions.scalar import col, literal_array
from tabloom.functions.sums import cells, chunked, packed, summed, unpacked
from tabloom.operators.categorical import LabelEncoder, OneHotEncoder, sparse_vectors
from tabloom.operators.encoder import fit_all
from tabloom.operators.numeric import StandardEncoder
from tabloom.session import checkpoint

FOLDS = 3
TASK_ROWS = 20_000  # rows that are worth a task in each of a classifier's many passes while cores are idle
FULL_TASK_ROWS = 1_000_000  # rows that are worth a task where all cores are busy
FLOAT_STEP = 2.0**-52
TOLERANCE = 0.01  # change of the log-likelihood at which a mixture has settled
SAMPLES = 5       # rows that a component starts from
CURVE = 1_000     # bins of a curve
MEMORY = 10       # steps that the search directions remember
SEARCHES = 20     # points that one step may try


def _scaled(train: DataFrame, others: list[DataFrame], columns: list[str], keep: list[str] = ()) -> list[DataFrame]:
    """Standardise by the training side and assemble one feature vector per row."""
    encoders = fit_all(train, {c: StandardEncoder() for c in columns})
    assembler = VectorAssembler(inputCols=[f"{c}__value" for c in columns], outputCol="features", handleInvalid="error")
    out = []
    for df in [train, *others]:
        for c, e in encoders.items():
            df = e.encode(df, c, c)
        df = df.na.fill(0.0, [f"{c}__value" for c in columns])  # a missing number counts as the mean; no row is left out
        out.append(assembler.transform(df).select(*[col(k) for k in keep], "features"))
    return out


def linear_score(coefficients, intercept: float, features: str = "features") -> Column:
    """The linear form of a fitted model, as an expression.

    A model's own ``transform`` carries its training summary, and with it the
    session, which cannot be sent to tasks once the session has an Observation.
    """
    products = F.zip_with(vector_to_array(features), literal_array([float(c) for c in coefficients], "double"), lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v) + F.lit(float(intercept))


def _log_densities(x: np.ndarray, weights, gaussians) -> np.ndarray:
    """log w_k N(x; mu_k, S_k) of every row and component."""
    terms = []
    for w, (mean, cov) in zip(weights, gaussians):
        d = len(mean)
        whiten = np.linalg.inv(np.linalg.cholesky(cov + 1e-9 * np.eye(d)))
        const = math.log(max(w, 1e-300)) - 0.5 * d * math.log(2 * math.pi) + float(np.log(np.diag(whiten)).sum())
        terms.append(const - 0.5 * (((x - mean) @ whiten.T) ** 2).sum(axis=1))
    return np.stack(terms, axis=1)


def _standard_rows(train: DataFrame, columns: list[str], keep: list[str] = ()) -> tuple[DataFrame, dict]:
    """Packed rows of ``keep`` and the standardised columns, a missing number as the mean, and the encoders by column."""
    encoders = fit_all(train, {c: StandardEncoder() for c in columns})
    return packed(_standardised(train, encoders, keep)), encoders


def _standardised(df: DataFrame, encoders: dict, keep: list[str] = ()) -> DataFrame:
    for c, e in encoders.items():
        df = e.encode(df, c, c)
    df = df.na.fill(0.0, [f"{c}__value" for c in encoders])
    return df.select(*[col(k) for k in keep], *[col(f"{c}__value") for c in encoders])


class Mixture:
    """Expectation-maximisation of a mixture of normals with full covariances; every step takes sums over all rows."""

    def __init__(self, samples: np.ndarray, k: int):
        groups = np.array_split(samples, k)
        self.k, self.d = k, samples.shape[1]
        self.weights = np.full(k, 1 / k)
        self.means = np.array([g.mean(axis=0) for g in groups])
        self.covs = np.array([np.diag(g.var(axis=0)) for g in groups])
        self.likelihood, self.settled = -math.inf, False

    @property
    def size(self) -> int:
        return 1 + self.k * (1 + self.d + self.d**2)

    def whitening(self) -> list[tuple[np.ndarray, float]]:
        """Per component the matrix that whitens a gap, and the log of the density's constant; directions without variance count for nothing."""
        out = []
        for cov in self.covs:
            values, vectors = np.linalg.eigh(cov)
            used = values > FLOAT_STEP * max(values.max(), 0.0) * self.d
            if not used.any():
                raise ValueError("a component of the mixture has no variance")
            root = vectors[:, used] / np.sqrt(values[used])
            out.append((root, -0.5 * (self.d * math.log(2 * math.pi) + np.log(values[used]).sum())))
        return out

    def expected(self):
        """A function of rows: log-likelihood, and weight, sum and sum of products of every component."""
        parts = [(w, m, *r) for w, m, r in zip(self.weights, self.means, self.whitening())]

        def sums(x: np.ndarray) -> np.ndarray:
            p = np.stack([FLOAT_STEP + w * np.exp(u - 0.5 * (((x - m) @ root) ** 2).sum(axis=1)) for w, m, root, u in parts])
            total = p.sum(axis=0)
            p /= total
            products = np.concatenate([((x * r[:, None]).T @ x).ravel() for r in p])
            return np.concatenate([[np.log(total).sum()], p.sum(axis=1), (p @ x).ravel(), products])

        return sums

    def move(self, sums: np.ndarray) -> None:
        k, d = self.k, self.d
        n, x, xx = sums[1:k + 1], sums[k + 1:k + 1 + k * d].reshape(k, d), sums[k + 1 + k * d:].reshape(k, d, d)
        self.weights, self.means = n / n.sum(), x / n[:, None]
        self.covs = xx / n[:, None, None] - self.means[:, :, None] * self.means[:, None, :]
        self.settled, self.likelihood = abs(sums[0] - self.likelihood) <= TOLERANCE, float(sums[0])


def fit_mixture(rows: DataFrame, width: int, components, iterations: int, seed: int) -> tuple[list[Mixture], int]:
    """A mixture of packed rows for each number of components, all numbers in the same passes, and the number of rows."""
    wanted, parts = SAMPLES * sum(components), rows.rdd.getNumPartitions()

    def draw(batches):
        """The rows that come first in an order by chance."""
        rng, best, count = np.random.default_rng([seed, TaskContext.get().partitionId()]), np.zeros((0, 1 + width)), 0
        for chunk in chunked(batches):
            x = unpacked(chunk, width)
            best = np.concatenate([best, np.column_stack([rng.random(len(x)), x])])
            best, count = best[np.argsort(best[:, 0], kind="stable")[:wanted]], count + len(x)
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64()), pa.array([best.ravel()], pa.list_(pa.float64()))], names=["n", "x"])

    found = rows.mapInArrow(draw, "n bigint, x array<double>").collect()  # a few rows a partition
    count, drawn = sum(r["n"] for r in found), np.concatenate([np.array(r["x"]).reshape(-1, 1 + width) for r in found])
    drawn = drawn[np.argsort(drawn[:, 0], kind="stable")][:wanted, 1:]
    if not len(drawn):
        raise ValueError("a mixture needs rows")
    drawn = drawn[np.arange(wanted) % len(drawn)]  # of few rows some count again
    models = [Mixture(s, k) for s, k in zip(np.split(drawn, np.cumsum([SAMPLES * k for k in components])[:-1]), components)]
    for _ in range(iterations):
        live = [m for m in models if not m.settled]
        if not live:
            break
        steps = [m.expected() for m in live]

        def sums(chunk):
            x = unpacked(chunk, width)
            return np.concatenate([s(x) for s in steps])

        total = summed(rows, sums, sum(m.size for m in live), parts, 1)
        for m, own in zip(live, np.split(total, np.cumsum([m.size for m in live])[:-1])):
            m.move(own)
    return models, count


def mixture_log_likelihood(real: DataFrame, synthetic: DataFrame, columns: list[str],
                           components=(2, 4), iterations: int = 10, seed: int = 0) -> DataFrame:
    """Mean log-likelihood of synthetic rows under the best mixture (by BIC) of the real ones."""
    a, encoders = _standard_rows(real, columns)
    a = a.persist()
    try:
        d, best = len(columns), None
        models, rows = fit_mixture(a, d, components, iterations, seed)
        for model in models:
            k = model.k
            free = k - 1 + k * d + k * d * (d + 1) / 2
            bic = free * math.log(rows) - 2 * model.likelihood
            if best is None or bic < best[0]:
                best = (bic, model)
    finally:
        a.unpersist()
    model = best[1]
    gaussians = list(zip(model.means, model.covs))
    b = _standardised(synthetic, encoders)
    return mean_log_density(b.select(F.array(*[col(c) for c in b.columns]).alias("x")), model.weights, gaussians).withColumn("components", F.lit(model.k))


def mean_log_density(rows: DataFrame, weights, gaussians) -> DataFrame:
    """Mean log density of the arrays ``x`` under a mixture of (mean, covariance) with the given weights."""
    def total(batches):
        for chunk in chunked(batches):
            l = _log_densities(cells(chunk, "x"), weights, gaussians)
            top = l.max(axis=1)
            each = top + np.log(np.exp(l - top[:, None]).sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array([each.sum()]), pa.array([len(each)], pa.int64())], names=["l", "n"])

    sums = rows.select("x").mapInArrow(total, "l double, n bigint")
    return sums.agg((F.sum("l") / F.sum("n")).alias("log_likelihood"))


def lbfgs(size: int, iterations: int):
    """Minimises a function of ``size`` numbers from zero: yields points, is sent their value and gradient, returns the last point.

    Limited memory, with a backtracking search for steps that lower the value and flatten the slope (Nocedal and Wright, ch. 3 and 7).
    """
    x, past = np.zeros(size), []
    f, g = yield x
    for made in range(iterations):
        q, back = g.copy(), []
        for s, y in reversed(past):
            a = (s @ q) / (s @ y)
            back.append(a)
            q -= a * y
        if past:
            s, y = past[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(back)):
            q += s * (a - (y @ q) / (s @ y))
        slope, step = -(g @ q), 1.0 if made else 0.5 / max(np.linalg.norm(g), 1e-300)
        if slope > -1e-300:
            break
        for _ in range(SEARCHES):
            there, grad = yield x - step * q
            if there > f + 1e-4 * step * slope:
                step *= 0.5 if made else 0.1
            elif -(grad @ q) < 0.9 * slope:
                step *= 2.1
            else:
                break
        if there >= f:
            break
        s, y = -step * q, grad - g
        if s @ y > 0:
            past = [*past, (s, y)][-MEMORY:]
        x, before, f, g = x + s, f, there, grad
        if abs(before - f) <= 1e-6 * max(abs(f), 1e-6) or np.linalg.norm(g) <= 1e-6 * max(abs(f), 1e-8):
            break
    return x


def _labelled(chunk: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    block = unpacked(chunk, width + 2)
    return block[:, 0], block[:, 1], block[:, 2:]


def fit_separators(rows: DataFrame, folds: int, width: int, iterations: int, penalty: float, parts: int) -> list[tuple[np.ndarray, float]]:
    """A linear support vector classifier (coefficients, intercept) for the rows outside each fold, all folds in the same passes.

    ``rows`` are packed: label (0 or 1), fold, and ``width`` numbers. The mean hinge loss
    is taken over features standardised within the rows outside the fold, and the penalty is on their coefficients.
    """
    def moments(chunk):
        label, fold, x = _labelled(chunk, width)
        return np.concatenate([np.concatenate([[len(t)], t.sum(axis=0), (t * t).sum(axis=0)]) for t in (x[fold != k] for k in range(folds))])

    total = summed(rows, moments, folds * (1 + 2 * width), parts, 1).reshape(folds, -1)
    count, means = total[:, 0], total[:, 1:width + 1] / total[:, :1]
    spread = np.sqrt(np.maximum(total[:, width + 1:] / total[:, :1] - means**2, 0.0) * (count / np.maximum(count - 1, 1))[:, None])
    scale = np.where(spread > 1e-12, 1 / np.where(spread > 1e-12, spread, 1.0), 0.0)

    def losses(points: dict[int, np.ndarray]):
        linear = {k: (p[:width] * scale[k], p[width] - (p[:width] * scale[k]) @ means[k]) for k, p in points.items()}

        def sums(chunk):
            label, fold, x = _labelled(chunk, width)
            sign, out = 2 * label - 1, []
            for k, (w, c) in linear.items():
                gap = np.where(fold != k, 1 - sign * (x @ w + c), 0.0)
                push = np.where(gap > 0, -sign, 0.0)
                out += [[np.maximum(gap, 0.0).sum()], push @ x, [push.sum()]]
            return np.concatenate(out)

        found = summed(rows, sums, len(points) * (width + 2), parts, 1).reshape(len(points), -1)
        for (k, p), own in zip(points.items(), found):
            w, rest = p[:width], own[1:] / count[k]
            grad = (rest[:width] - means[k] * rest[width]) * scale[k] + penalty * w
            yield k, own[0] / count[k] + penalty / 2 * (w @ w), np.append(grad, rest[width])

    searches = {k: lbfgs(width + 1, iterations) for k in range(folds)}
    points, done = {k: next(s) for k, s in searches.items()}, {}
    while points:
        answers, points = list(losses(points)), {}
        for k, value, grad in answers:
            try:
                points[k] = searches[k].send((value, grad))
            except StopIteration as end:
                done[k] = end.value
    return [(done[k][:width] * scale[k], float(done[k][width] - (done[k][:width] * scale[k]) @ means[k])) for k in range(folds)]


def fold_aucs(rows: DataFrame, models: list[tuple[np.ndarray, float]], parts: int) -> list[float]:
    """The area under the curve of each fold's model on the fold, over about ``CURVE`` bins of equal numbers of rows.

    Rows of a bin count as ties; a value that many rows have is a bin of its own.
    """
    def margins(x: np.ndarray, fold: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for k, (w, c) in enumerate(models):
            out[fold == k] = x[fold == k] @ w + c
        return out

    def scored(batches):
        for chunk in chunked(batches, 1):
            _, fold, x = _labelled(chunk, width)
            yield pa.RecordBatch.from_arrays([pa.array(fold.astype(np.int32)), pa.array(margins(x, fold))], names=["fold", "m"])

    width = len(models[0][0])
    probs = [i / CURVE for i in range(CURVE + 1)]
    found = rows.mapInArrow(scored, "fold int, m double").groupBy("fold").agg(F.percentile_approx("m", probs, 20 * CURVE).alias("e")).collect()
    edges = {r["fold"]: np.unique(r["e"]) for r in found}
    size = 2 * CURVE + 3

    def counted(chunk):
        label, fold, x = _labelled(chunk, width)
        m, out = margins(x, fold), np.zeros((len(models), 2, size))
        for k, e in edges.items():
            mine = fold == k
            # a bin between two edges, and one at each edge
            place = np.searchsorted(e, m[mine], "left") + np.searchsorted(e, m[mine], "right")
            for side in (0, 1):
                out[k, side] = np.bincount(place[label[mine] == side], minlength=size)
        return out.ravel()

    no, yes = np.moveaxis(summed(rows, counted, len(models) * 2 * size, parts, 1).reshape(len(models), 2, size), 1, 0)
    above = yes.sum(axis=1, keepdims=True) - yes.cumsum(axis=1)
    return list((no * (above + yes / 2)).sum(axis=1) / (no.sum(axis=1) * yes.sum(axis=1)))


def detection(real: DataFrame, synthetic: DataFrame, columns: list[str], iterations: int = 10) -> DataFrame:
    """Score 1 - (2 max(AUC, 1/2) - 1) of a classifier that tells the tables apart, per fold.

    A fold holds the same share of each table's rows, so both sides of every
    split hold both tables. There are as many folds as the smaller table has
    rows where these are fewer than ``FOLDS``, and none below two rows.
    """
    tables = [numbered(t, "fold") for t in numeric_view(real, synthetic, columns)]
    sizes = [t.count() for t in tables]
    folds = min(FOLDS, *sizes)
    rows = []
    if folds > 1:
        both = tables[0].withColumn("label", F.lit(1.0)).unionByName(tables[1].withColumn("label", F.lit(0.0)))
        folded = both.withColumn("fold", F.pmod("fold", F.lit(folds)))
        # written once: the classifiers and their curves read the rows many times
        tasks = max(min(1 + sum(sizes) // TASK_ROWS, real.sparkSession.sparkContext.defaultParallelism), 1 + sum(sizes) // FULL_TASK_ROWS)
        scaled = checkpoint(_standard_rows(folded, columns, ["label", "fold"])[0].coalesce(tasks))
        parts = scaled.rdd.getNumPartitions()
        models = fit_separators(scaled, folds, len(columns), iterations, 0.01, parts)
        rows = [(k, float(auc), float(1 - (2 * max(auc, 0.5) - 1))) for k, auc in enumerate(fold_aucs(scaled, models, parts))]
    return real.sparkSession.createDataFrame(rows, "fold int, auc double, score double")


def attack_numeric(real: DataFrame, synthetic: DataFrame, keys: list[str], sensitive: str) -> DataFrame:
    """Train on synthetic, predict the sensitive number on real: mean error over its range."""
    train, test = _scaled(synthetic.fillna(0), [real.fillna(0)], keys, [sensitive])
    model = LinearRegression(labelCol=sensitive, regParam=0.01).fit(train)
    scored = test.withColumn("prediction", linear_score(model.coefficients, model.intercept))
    gap = F.avg(F.abs(F.col("prediction") - col(sensitive)))
    width = F.max(col(sensitive)) - F.min(col(sensitive))
    return scored.agg(F.least(F.lit(1.0), gap / width).alias("score"))


def attack_categorical(real: DataFrame, synthetic: DataFrame, keys: list[str], sensitive: str,
                       iterations: int = 10) -> DataFrame:
    """Train on synthetic, predict the sensitive category on real: one minus accuracy."""
    labels = LabelEncoder().fit(synthetic, sensitive)
    onehots = fit_all(synthetic, {k: OneHotEncoder() for k in keys})

    def prepare(df: DataFrame) -> DataFrame:
        for k, e in onehots.items():
            df = e.encode(df, k, k)
        df = labels.encode(df, sensitive, "_y")
        for k, e in onehots.items():
            if e.wide:
                df = sparse_vectors(df, f"{k}__value", e.width, f"{k}__vector")
        inputs = [o for k, e in onehots.items() for o in ([f"{k}__vector"] if e.wide else e.output_columns(k))]
        rows = VectorAssembler(inputCols=inputs, outputCol="features").transform(df)
        return rows.select("features", F.col("_y__value").cast("double").alias("label"))

    model = OneVsRest(classifier=LinearSVC(maxIter=iterations, regParam=0.01)).fit(prepare(synthetic))
    margins = F.array(*[linear_score(m.coefficients, m.intercept) for m in model.models])
    scored = prepare(real).select("label", margins.alias("m"))
    predicted = (F.array_position("m", F.array_max("m")) - 1).cast("double")
    # a real category that the synthetic table lacks cannot be predicted: it counts as wrong
    return scored.agg((1 - F.avg((predicted == F.coalesce("label", F.lit(-1.0))).cast("double"))).alias("score"))


def attack(real: DataFrame, synthetic: DataFrame, roles, sensitive: str) -> DataFrame:
    """The numeric or the categorical attacker, by the sensitive column's role."""
    if sensitive in roles.continuous:
        return attack_numeric(real, synthetic, [c for c in roles.continuous if c != sensitive], sensitive)
    return attack_categorical(real, synthetic, [c for c in roles.categorical if c != sensitive], sensitive)
