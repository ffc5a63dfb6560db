"""Regression models from distributed passes or sufficient statistics.

Only sums leave the cluster: cell tables, cross-products, and for mixed models one small matrix per
distinct group size. The last step, on those sums, is dense linear algebra.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axonframe.functions import dist
from axonframe.operators.ordered import cumulative
from axonframe.session import durable, spread

DENSE_LEVELS = 4000  # levels of the crossed factor, a dense block on the driver (128 MB)
DENSE_NUMBERS = 60_000_000  # numbers of its sums that may be brought to the driver (480 MB)
SIZE_GRID = 64  # points of the variance ratio that group sizes are described by
PROJECTION_TOLERANCE, PROJECTION_ROUNDS = 1e-12, 500


def dummies(c: str, levels: list) -> dict[str, Column]:
    """0/1 columns for all levels but the first (the reference)."""
    return {f"{c}{lv}": F.when(F.col(c) == F.lit(lv), 1.0).otherwise(0.0) for lv in levels[1:]}


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    clean = [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows]
    return spark.createDataFrame(clean, schema)


# --- analysis of variance --------------------------------------------------------------------------


def _projected_gain(cells: DataFrame, tolerance: float = PROJECTION_TOLERANCE, rounds: int = PROJECTION_ROUNDS) -> float:
    """Sum of squares that the levels of b explain beyond those of a.

    Effects of b solve ``(D_b - N' D_a^-1 N) x = r`` with the cell counts N. One application of the operator is a
    pair of projections (onto the levels of a, and back), each an aggregate over the cells; conjugate gradients
    combine them. The rounds end once a step adds less than ``tolerance`` of the gain; not getting there is an error.
    """
    na = cells.groupBy("a").agg(F.sum("n").alias("na"), F.sum("s").alias("sa"))
    linked = durable(cells.join(na, "a").select("a", "b", "n", "s", "na", "sa"))
    # r: sums of b without the means of a; d: the operator's diagonal
    start = linked.groupBy("b").agg(
        (F.sum("s") - F.sum(F.col("n") * F.col("sa") / F.col("na"))).alias("r"), (F.sum("n") - F.sum(F.col("n") * F.col("n") / F.col("na"))).alias("d"), F.sum("n").alias("nb")
    )
    z = F.when(F.col("d") > 1e-12 * F.col("nb"), F.col("r") / F.col("d")).otherwise(0.0)
    state = durable(start.withColumn("p", z))
    rz = float(state.agg(F.sum(F.col("r") * F.col("p"))).first()[0] or 0)
    scale, gain = max(rz, 1e-300), 0.0
    for _ in range(rounds):
        if rz <= tolerance * tolerance * scale:
            return gain
        at_a = linked.join(state.select("b", "p"), "b").groupBy("a").agg((F.sum(F.col("n") * F.col("p")) / F.first("na")).alias("m"))
        back = linked.join(at_a, "a").groupBy("b").agg(F.sum(F.col("n") * F.col("m")).alias("back"))
        state = durable(state.join(back, "b").withColumn("q", F.col("nb") * F.col("p") - F.col("back")).drop("back"))
        pq = float(state.agg(F.sum(F.col("p") * F.col("q"))).first()[0])
        if pq <= 0:  # the direction is explained by the levels of a
            return gain
        alpha = rz / pq
        step = alpha * rz  # what the step adds to r'x
        gain += step
        state = state.withColumn("r", F.col("r") - alpha * F.col("q")).drop("q")
        new = float(state.agg(F.sum(F.col("r") * z)).first()[0])
        if step <= tolerance * gain and new <= tolerance * scale:
            return gain
        state = state.withColumn("p", z + new / rz * F.col("p"))
        rz = new
    raise RuntimeError(f"projections did not converge in {rounds} rounds")


def two_way_anova(df: DataFrame, y: str, a: str, b: str) -> DataFrame:
    """Sequential two-way ANOVA with interaction: term, df, sumsq, meansq, f, p.

    Spark reduces the data to the A x B cell table, which stays there: what B adds to A is found by projections
    over the cells, and only sums leave the cluster. Both factors may have any number of levels. Degrees of freedom
    assume that the cells connect all levels.
    """
    cells = (
        df.dropna(subset=[y, a, b])
        .groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("s"), F.sum(F.col(y) * F.col(y)).alias("q"))
    )
    cells = durable(cells)
    n, total, q, full, k = (float(v or 0) for v in cells.agg(F.sum("n"), F.sum("s"), F.sum("q"), F.sum(F.col("s") * F.col("s") / F.col("n")), F.count(F.lit(1))).first())

    def levels(c: str) -> tuple[int, float]:
        per = cells.groupBy(c).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        count, ss = per.agg(F.count(F.lit(1)), F.sum(F.col("s") * F.col("s") / F.col("n"))).first()
        return count, float(ss or 0)

    (la, ss_a), (lb, _) = levels("a"), levels("b")
    gain = _projected_gain(cells) if min(la, lb) > 1 else (full - ss_a if la == 1 and lb > 1 else 0.0)
    one = total * total / n if n else math.nan
    rss, rdf = q - full, n - k
    terms = [(a, la - 1, ss_a - one), (b, lb - 1, gain), (f"{a}:{b}", k - la - lb + 1, full - ss_a - gain)]
    rows = []
    for name, d, ss in terms:
        ok = d > 0 and rdf > 0 and rss > 0
        f = (ss / d) / (rss / rdf) if ok else math.nan
        rows.append((name, float(d), ss, ss / d if d else math.nan, f, float(dist.f_sf(f, d, rdf)) if ok else math.nan))
    rows.append(("Residuals", rdf, rss, rss / rdf if rdf else math.nan, math.nan, math.nan))
    return _rows(df.sparkSession, rows, "term string, df double, sumsq double, meansq double, f double, p double")


# --- gamma regression ------------------------------------------------------------------------------


@dataclass(frozen=True)
class GammaFit:
    coefficients: DataFrame  # term, estimate, std_error, statistic, p_value
    dispersion: float
    aic: float
    deviance: float
    intercept: float
    slopes: dict[str, float]

    def linear_predictor(self) -> Column:
        return sum((F.col(f"`{k}`") * v for k, v in self.slopes.items()), F.lit(self.intercept))


def with_terms(df: DataFrame, factors: dict[str, list], numeric: list[str]) -> tuple[DataFrame, list[str]]:
    """Add dummy columns and list all predictor columns."""
    cols = {name: expr for c, levels in factors.items() for name, expr in dummies(c, levels).items()}
    return df.withColumns(cols), [*cols, *numeric]


def gamma_glm(df: DataFrame, y: str, factors: dict[str, list], numeric: list[str], max_iter: int = 100, tol: float = 1e-11) -> GammaFit:
    """Gamma GLM with log link. Rows with a missing value are left out; a response <= 0 is an error.

    The data are reduced to covariate patterns with n, sum, sum of squares and sum of logarithms of the response, in
    one pass. With this link the information matrix does not depend on the coefficients, so a scoring step needs one
    vector of sums over the patterns. No convergence within ``max_iter`` steps is an error.
    """
    used = df.dropna(subset=[y, *factors, *numeric])
    for c, levels in factors.items():
        used = used.filter(F.col(c).isin(levels))
    data, terms = with_terms(used, factors, numeric)
    data = data.select(F.col(y).cast("double").alias("_y"), *[F.col(f"`{t}`").cast("double").alias(f"x{i}") for i, t in enumerate(terms, 1)])
    xs = [f"x{i}" for i in range(len(terms) + 1)]
    patterns = data.withColumn("x0", F.lit(1.0)).groupBy(*xs).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("_y").alias("s"), F.sum(F.col("_y") * F.col("_y")).alias("q"), F.sum(F.log("_y")).alias("l"), F.count_if(F.col("_y") <= 0).alias("bad")
    )
    patterns = durable(patterns)
    p = len(xs)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    sums = patterns.agg(F.sum("bad"), F.sum("n"), F.sum("s"), F.sum("l"), *[F.sum(F.col("n") * F.col(xs[i]) * F.col(xs[j])) for i, j in pairs]).first()
    if sums[0]:
        raise ValueError(f"{sums[0]} rows have a response that is not positive")
    total = float(sums[1] or 0)
    if total <= p:
        raise ValueError(f"{int(total)} rows are too few for {p} coefficients")
    info = np.zeros((p, p))
    for (i, j), v in zip(pairs, sums[4:]):
        info[i, j] = info[j, i] = v
    inverse = np.linalg.inv(info)
    beta = np.zeros(p)
    beta[0] = math.log(sums[2] / total)
    mean = lambda: F.exp(sum((F.col(x) * float(v) for x, v in zip(xs, beta)), F.lit(0.0)))
    for _ in range(max_iter):
        pull = F.col("s") / mean() - F.col("n")
        score = np.array(patterns.agg(*[F.sum(F.col(x) * pull) for x in xs]).first(), float)
        step = inverse @ score
        beta = beta + step
        # the step is measured by the change of the linear predictor
        if float(step @ info @ step) <= tol * tol * total:
            break
    else:
        raise RuntimeError(f"the gamma regression did not converge in {max_iter} steps")
    m, n, s, q = mean(), F.col("n"), F.col("s"), F.col("q")
    pearson, gap, logs = patterns.agg(F.sum(q / (m * m) - 2 * s / m + n), F.sum(s / m - n), F.sum(n * F.log(m))).first()
    dispersion = pearson / (total - p)
    deviance = 2 * (logs - sums[3] + gap)
    d = deviance / total
    shape = 1 / d
    loglik = (shape - 1) * sums[3] - shape * (gap + total) - shape * logs - total * shape * math.log(d) - total * math.lgamma(shape)
    se = np.sqrt(dispersion * np.diag(inverse))
    rows = []
    for name, e, v in zip(["(Intercept)", *terms], beta, se):
        t = float(e / v)
        rows.append((name, float(e), float(v), t, float(dist.t_sf2(t, total - p))))
    coef = _rows(df.sparkSession, rows, "term string, estimate double, std_error double, statistic double, p_value double")
    return GammaFit(coef, dispersion, -2 * loglik + 2 + 2 * p, deviance, float(beta[0]), dict(zip(terms, map(float, beta[1:]))))


_GOLD, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
SIMULATED = 1 << 18  # draws made at once


def _uniform(key: np.ndarray, stream: int) -> np.ndarray:
    """A number in (0, 1) for every key and stream: a mixing function of the two, without a state."""
    x = key + np.uint64((stream + 1) * int(_GOLD) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    x = x ^ (x >> np.uint64(31))
    return ((x >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


def keyed_gamma(key: np.ndarray, shape: float) -> np.ndarray:
    """A gamma draw of unit scale for every key, by rejection (Marsaglia and Tsang) on keyed numbers."""
    boosted = shape if shape >= 1 else shape + 1
    d = boosted - 1 / 3
    c = 1 / math.sqrt(9 * d)
    out, todo, stream = np.empty(key.shape), np.arange(key.size), 1
    flat, result = key.ravel(), out.ravel()
    while todo.size:
        k = flat[todo]
        x = np.sqrt(-2 * np.log(_uniform(k, stream))) * np.cos(2 * math.pi * _uniform(k, stream + 1))
        v = (1 + c * x) ** 3
        ok = v > 0
        ok[ok] = np.log(_uniform(k[ok], stream + 2)) < 0.5 * x[ok] ** 2 + d - d * v[ok] + d * np.log(v[ok])
        result[todo[ok]] = d * v[ok]
        todo, stream = todo[~ok], stream + 3
    return result.reshape(key.shape) if shape >= 1 else result.reshape(key.shape) * _uniform(key, 0) ** (1 / shape)


def simulate(df: DataFrame, y: str, mu: Column, dispersion: float, key: str, n_sim: int = 250, seed: int = 0) -> DataFrame:
    """One pass of ``n_sim`` gamma draws a row; see :func:`residuals_of` and :func:`dispersion_of`.

    Every draw is a function of the row's key, its number and ``seed``, so partitioning does not change the result,
    and whole batches are drawn at once. Rows with a NULL response or prediction are left out.
    """
    data = df.select(F.col(key), F.col(y).cast("double").alias("observed"), mu.alias("fitted"))
    data = spread(data.dropna().withColumn("_seed", F.xxhash64(F.lit(seed), key)), key)
    number = np.arange(1, n_sim + 1, dtype=np.uint64) * _M2

    def draw(batches):
        squares, observed = np.zeros(n_sim), 0.0
        for pdf in batches:
            residual = np.empty(len(pdf))
            for at in range(0, len(pdf), max(1, SIMULATED // n_sim)):
                part = pdf.iloc[at : at + max(1, SIMULATED // n_sim)]
                o, m = part["observed"].to_numpy()[:, None], part["fitted"].to_numpy()[:, None]
                keys = (part["_seed"].to_numpy().view(np.uint64)[:, None] ^ number) * _M1
                sims = keyed_gamma(keys, 1 / dispersion) * (m * dispersion)
                residual[at : at + len(part)] = ((sims < o).sum(axis=1) + _uniform(keys[:, 0], -2)) / (n_sim + 1)
                squares += ((sims - m) ** 2).sum(axis=0)
                observed += float(((o - m) ** 2).sum())
            yield pdf.drop(columns="_seed").assign(residual=residual, sim=None, squares=None)
        yield pd.DataFrame({key: None, "observed": None, "fitted": None, "residual": None, "sim": np.arange(-1, n_sim), "squares": np.concatenate([[observed], squares])})

    kind = dict(data.dtypes)[key]
    return durable(data.mapInPandas(draw, f"`{key}` {kind}, observed double, fitted double, residual double, sim int, squares double"))


def residuals_of(simulated: DataFrame) -> DataFrame:
    """(key, observed, fitted, residual): share of the draws below the observed value."""
    return simulated.filter("sim IS NULL").drop("sim", "squares")


def dispersion_of(simulated: DataFrame) -> DataFrame:
    """Ratio of observed to simulated residual spread, with a two-sided simulation p. One row."""
    per_sim = simulated.filter("sim IS NOT NULL").groupBy("sim").agg(F.sum("squares").alias("ss"))
    drawn = F.col("sim") >= 0
    s = per_sim.agg(
        F.max(F.when(~drawn, F.col("ss"))).alias("_o"), F.avg(F.when(drawn, F.sqrt("ss"))).alias("_m"), F.collect_list(F.when(drawn, F.col("ss"))).alias("_all")
    )
    ge, le = F.size(F.filter("_all", lambda v: v >= F.col("_o"))), F.size(F.filter("_all", lambda v: v <= F.col("_o")))
    p = F.least(F.lit(1.0), 2.0 * (F.least(ge, le) + 1) / (F.size("_all") + 1))
    return s.select(F.try_divide(F.sqrt("_o"), F.col("_m")).alias("dispersion_ratio"), p.alias("p"))


def simulated_residuals(df: DataFrame, y: str, mu: Column, dispersion: float, key: str, n_sim: int = 250, seed: int = 0) -> DataFrame:
    """(key, observed, fitted, residual) of ``n_sim`` draws."""
    return residuals_of(simulate(df, y, mu, dispersion, key, n_sim, seed))


def uniformity_test(residuals: DataFrame, by: list[str], c: str = "residual") -> DataFrame:
    """Kolmogorov-Smirnov distance to the uniform distribution and its asymptotic p."""
    d = residuals.groupBy(*by, c).agg(F.count(F.lit(1)).alias("n"))
    ranked = cumulative(d, by, c)
    above = (F.col("cum_before") + F.col("n")) / F.col("total") - F.col(c)
    below = F.col(c) - F.col("cum_before") / F.col("total")
    s = ranked.groupBy(*by).agg(F.max(F.greatest(above, below)).alias("d"), F.max("total").alias("n"))
    lam = (F.sqrt("n") + 0.12 + 0.11 / F.sqrt("n")) * F.col("d")
    p = sum((F.lit(2.0 * (-1) ** (k - 1)) * F.exp(-2.0 * k * k * lam * lam) for k in range(1, 101)), F.lit(0.0))
    return s.withColumn("p", F.when(lam < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))))


def dispersion_test(df: DataFrame, y: str, mu: Column, dispersion: float, key: str, n_sim: int = 250, seed: int = 0) -> DataFrame:
    """Dispersion ratio and p of ``n_sim`` draws."""
    return dispersion_of(simulate(df, y, mu, dispersion, key, n_sim, seed))


# --- mixed models ----------------------------------------------------------------------------------


@dataclass
class MixedFit:
    """REML fit with random intercepts; DataFrames are made on request."""

    spark: SparkSession
    names: list[str]
    terms: dict[str, list[int]]
    beta: np.ndarray
    cov: np.ndarray
    sigma: float
    sd_groups: dict[str, float]
    n: int
    reml: float
    _df: object = field(repr=False)

    def _test(self, row: np.ndarray) -> tuple[float, float, float, float, float]:
        est, se = float(row @ self.beta), float(np.sqrt(row @ self.cov @ row))
        df = self._df(row)
        t = est / se
        return est, se, df, t, float(dist.t_sf2(t, df))

    def fixed_effects(self) -> DataFrame:
        rows = [(name, *self._test(np.eye(len(self.names))[i])) for i, name in enumerate(self.names)]
        return _rows(self.spark, rows, "term string, estimate double, std_error double, df double, t double, p double")

    def variance_components(self) -> DataFrame:
        rows = [(k, v, v * v) for k, v in {**self.sd_groups, "Residual": self.sigma}.items()]
        return _rows(self.spark, rows, "group string, sd double, variance double")

    def anova(self) -> DataFrame:
        """Type III F tests of the terms, Satterthwaite denominator degrees of freedom."""
        rows = []
        for term, idx in self.terms.items():
            lmat = np.eye(len(self.names))[idx]
            middle = lmat @ self.cov @ lmat.T
            lb = lmat @ self.beta
            q = len(idx)
            f = float(lb @ np.linalg.solve(middle, lb)) / q
            _, vec = np.linalg.eigh(middle)
            nus = np.array([self._df(v @ lmat) for v in vec.T])
            if q == 1:
                den = float(nus[0])
            else:
                e = float(np.sum(nus[nus > 2] / (nus[nus > 2] - 2)))
                den = 2 * e / (e - q) if e > q else math.nan
            rows.append((term, float(q), den, f, float(dist.f_sf(f, q, den)) if den > 0 else math.nan))
        return _rows(self.spark, rows, "term string, num_df double, den_df double, f double, p double")

    def contrasts(self, factor: str, levels: list) -> DataFrame:
        """All pairwise differences between the factor's levels: estimate, standard error, df, t, p."""
        at = {lv: (np.zeros(len(self.names)) if i == 0 else np.eye(len(self.names))[self.terms[factor][i - 1]]) for i, lv in enumerate(levels)}
        rows = [(str(a), str(b), *self._test(at[a] - at[b])) for a, b in combinations(levels, 2)]
        return _rows(self.spark, rows, "level_a string, level_b string, estimate double, std_error double, df double, t double, p double")


class SizeBasis:
    """Weights ``1 / (ratio + n)`` of groups of size n, for all ratios at once.

    As functions of n they span a space of few dimensions: the leading singular vectors of the weights at
    ``SIZE_GRID`` ratios describe those of every other ratio, to about twelve digits. So sums over groups
    are taken once per basis function, whatever the number of distinct sizes.
    """

    def __init__(self, least: float, most: float):
        self.most = most
        self.ratios = np.logspace(math.log10(least) - 2, math.log10(most) + 2, SIZE_GRID)
        self.sizes = np.unique(np.round(np.concatenate([np.geomspace(least, most, 400), np.arange(least, min(most, least + 200) + 1)])))
        u, d, v = np.linalg.svd(self._scaled(self.sizes[:, None], self.ratios[None, :]), full_matrices=False)
        k = int((d > 1e-14 * d[0]).sum())
        self.u, self.d, self.v = u[:, :k], d[:k], v[:k]

    def _scaled(self, n, ratio):
        """n / (ratio + n), the largest size being 1."""
        return n * (ratio + self.most) / (self.most * (ratio + n))

    def of(self, n: Column) -> list[Column]:
        """The basis functions of a group size."""
        grid = F.array(*[F.lit(float(x)) for x in self.ratios])
        at = F.transform(grid, lambda t: (t + self.most) / (self.most * (t + n)))
        return [F.aggregate(F.zip_with(at, F.array(*[F.lit(float(x)) for x in row]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) for row in self.v]

    def coefficients(self, ratio: float) -> np.ndarray:
        """What the basis functions are multiplied by to give ``1 / (ratio + n)``."""
        return (self.u.T @ self._scaled(self.sizes, ratio)) / self.d * self.most / (ratio + self.most)


def _level_sums(data: DataFrame, cols: list[str], levels: list[str]) -> tuple[np.ndarray, SizeBasis, list]:
    """([n, k] of group sizes, basis, sums): per basis function the sum over groups of the outer product of a
    group's column sums and level counts, in three parts.

    Counts of a level in a group stay sparse rows in Spark; they meet in pairs within their group and are
    summed per pair of levels there.
    """
    spark = data.sparkSession
    totals = data.groupBy("_g").agg(F.sum("_1").cast("long").alias("n"), *[F.sum(c).alias(c) for c in cols])
    totals = durable(totals)
    sizes = totals.groupBy("n").agg(F.count(F.lit(1)).alias("k")).toPandas()  # k distinct sizes need k^2 / 2 rows of data
    basis = SizeBasis(float(sizes["n"].min()), float(sizes["n"].max()))
    named = [f"f{r}" for r in range(len(basis.d))]
    groups = totals.withColumns(dict(zip(named, basis.of(F.col("n").cast("double")))))
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    own = groups.agg(*[F.sum(F.col(f) * F.col(cols[i]) * F.col(cols[j])) for f in named for i, j in pairs]).first()
    top = np.zeros((len(named), len(cols), len(cols)))
    for at, value in enumerate(own):
        f, (i, j) = at // len(pairs), pairs[at % len(pairs)]
        top[f, i, j] = top[f, j, i] = value
    if not levels:
        return sizes[["n", "k"]].to_numpy(float), basis, [top]
    number = F.broadcast(spark.createDataFrame(list(zip(levels, range(len(levels)))), "_h string, _i int"))
    seen = durable(data.groupBy("_g", "_h").agg(F.sum("_1").alias("c")).join(number, "_h").select("_g", "_i", "c"))
    side = seen.join(groups, "_g").groupBy("_i").agg(*[F.sum(F.col(f) * F.col("c") * F.col(c)) for f in named for c in cols]).toPandas().to_numpy(float)
    border = np.zeros((len(named), len(levels), len(cols)))
    border[:, side[:, 0].astype(int)] = side[:, 1:].reshape(len(side), len(named), len(cols)).transpose(1, 0, 2)
    other = seen.select("_g", F.col("_i").alias("_j"), F.col("c").alias("d"))
    met = seen.join(groups.select("_g", *named), "_g").join(other, "_g").filter("_i <= _j")
    met = durable(met.groupBy("_i", "_j").agg(*[F.sum(F.col(f) * F.col("c") * F.col("d")).alias(f) for f in named]))
    if met.count() * len(named) > DENSE_NUMBERS:
        raise ValueError(f"pairs of crossed levels that share a group need more than {DENSE_NUMBERS} numbers on the driver")
    inner = met.toPandas()
    return sizes[["n", "k"]].to_numpy(float), basis, [top, border, (inner["_i"].to_numpy(), inner["_j"].to_numpy(), inner[named].to_numpy(float))]


def mixed_model(
    df: DataFrame, y: str, factors: dict[str, list], numeric: list[str], group: str, crossed: str | None = None, nest: bool = False
) -> MixedFit:
    """Linear mixed model y ~ factors + numeric + (1|group) [+ (1|crossed)], fitted by REML.

    ``group`` may have any number of levels and sizes: it is absorbed in Spark (see :class:`SizeBasis`). ``crossed`` is
    a dense block of at most ``DENSE_LEVELS`` levels on the driver; with ``nest`` its levels are counted within ``group``.
    """
    spark = df.sparkSession
    used = df.dropna(subset=[c for c in (y, *factors, *numeric, group, crossed) if c])
    for c, levels in factors.items():
        used = used.filter(F.col(c).isin(levels))
    used, terms = with_terms(used, factors, numeric)
    names = ["(Intercept)", *terms]
    p = len(names)
    base = [F.lit(1.0).alias("_1"), *[F.col(f"`{t}`").cast("double").alias(f"_{i}") for i, t in enumerate(terms, 2)], F.col(y).cast("double").alias("_y")]
    cols = ["_1", *[f"_{i}" for i in range(2, p + 1)], "_y"]
    keys = [F.col(group).alias("_g")]
    if crossed:
        label = F.concat_ws("|", F.col(group).cast("string"), F.col(crossed).cast("string")) if nest else F.col(crossed).cast("string")
        keys.append(label.alias("_h"))
    data = used.select(*keys, *base)

    products = [F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]
    cross = data.agg(*products).first()
    w = p + 1
    levels: list[str] = []
    if crossed:
        per_level = data.groupBy("_h").agg(*[F.sum(c).alias(c) for c in cols])
        if per_level.limit(DENSE_LEVELS + 1).count() > DENSE_LEVELS:
            raise ValueError(f"the crossed factor has more than {DENSE_LEVELS} levels")
        table = per_level.toPandas().sort_values("_h")
        levels = table["_h"].tolist()
    q = len(levels)
    full = np.zeros((w + q, w + q))
    for i in range(w):
        for j in range(i, w):
            full[i, j] = full[j, i] = cross[f"{i}_{j}"]
    if crossed:
        block = table[cols].to_numpy(float)
        full[w:, :w], full[:w, w:], full[w:, w:] = block, block.T, np.diag(block[:, 0])
    by_size, basis, sums = _level_sums(data, cols, levels)
    n_of, k_of = by_size[:, 0], by_size[:, 1]
    total = float(full[0, 0])

    def reduce(t: np.ndarray) -> tuple[np.ndarray, float]:
        """[X y]'V^-1[X y] and log|V| for the relative deviations ``t``."""
        th1 = t[0] ** 2
        a = full.copy()
        if th1 > 0:
            weight = basis.coefficients(1 / th1)
            a[:w, :w] -= np.tensordot(weight, sums[0], axes=1)
            if q:
                a[w:, :w] -= np.tensordot(weight, sums[1], axes=1)
                a[:w, w:] = a[w:, :w].T
                i, j, value = sums[2]
                shared = value @ weight
                a[w + i, w + j] -= shared
                a[w + j, w + i] = a[w + i, w + j]
        logdet = float(np.sum(k_of * np.log1p(n_of * th1)))
        top = a[:w, :w]
        if q and t[1] != 0:
            th2 = t[1] ** 2
            inner = np.eye(q) + th2 * a[w:, w:]
            top = top - th2 * a[:w, w:] @ np.linalg.solve(inner, a[w:, :w])
            logdet += float(np.linalg.slogdet(inner)[1])
        return top, logdet

    def solve(t):
        top, logdet = reduce(t)
        beta = np.linalg.solve(top[:p, :p], top[:p, p])
        rss = float(top[p, p] - top[:p, p] @ beta)
        return top, logdet, beta, rss

    def deviance(t, sigma=None):
        top, logdet, _, rss = solve(t)
        dof = total - p
        s2 = rss / dof if sigma is None else sigma * sigma
        return dof * math.log(2 * math.pi * s2) + logdet + float(np.linalg.slogdet(top[:p, :p])[1]) + rss / s2

    t = np.abs(_simplex_minimum(deviance, np.full(2 if q else 1, 0.7)))
    t = np.array([0.0 if deviance(np.where(np.arange(len(t)) == i, 0.0, t)) <= deviance(t) + 1e-9 else v for i, v in enumerate(t)])
    top, _, beta, rss = solve(t)
    sigma = math.sqrt(rss / (total - p))

    def cov_at(par):
        return par[-1] ** 2 * np.linalg.inv(solve(par[:-1])[0][:p, :p])

    free = [i for i, v in enumerate(t) if v > 0]

    def expand(par):
        out = np.zeros(len(t) + 1)
        out[free], out[-1] = par[:-1], par[-1]
        return out

    at = np.array([*t[free], sigma])
    hess = _hessian(lambda v: deviance(expand(v)[:-1], v[-1]), at)
    var_par = 2 * np.linalg.inv(hess)

    def satterthwaite(row: np.ndarray) -> float:
        grad = np.zeros(len(at))
        for i in range(len(at)):
            h = 1e-4 * max(abs(at[i]), 1e-2)
            up, down = at.copy(), at.copy()
            up[i] += h
            down[i] -= h
            grad[i] = (row @ cov_at(expand(up)) @ row - row @ cov_at(expand(down)) @ row) / (2 * h)
        v = row @ cov_at(expand(at)) @ row
        return float(2 * v * v / (grad @ var_par @ grad))

    term_index, at_col = {}, 1
    for c, lv in factors.items():
        term_index[c] = list(range(at_col, at_col + len(lv) - 1))
        at_col += len(lv) - 1
    for c in numeric:
        term_index[c] = [at_col]
        at_col += 1
    sds = {group: float(t[0] * sigma)}
    if crossed:
        sds[crossed] = float(t[1] * sigma)
    return MixedFit(
        spark, names, term_index, beta, sigma**2 * np.linalg.inv(top[:p, :p]), sigma, sds, int(total), float(deviance(t)), satterthwaite
    )


def _simplex_minimum(f, start: np.ndarray, steps: int = 400) -> np.ndarray:
    """Nelder-Mead for one or two parameters; f is even in each of them."""
    pts = [start, *[start + 0.5 * np.eye(len(start))[i] for i in range(len(start))]]
    vals = [f(x) for x in pts]
    for left in range(steps, -1, -1):
        order = np.argsort(vals)
        pts, vals = [pts[i] for i in order], [vals[i] for i in order]
        if max(np.abs(pts[-1] - pts[0])) < 1e-9:
            break
        if not left:
            raise RuntimeError(f"the variance search did not converge in {steps} steps")
        centre = np.mean(pts[:-1], axis=0)
        trial = {s: centre + s * (pts[-1] - centre) for s in (-1.0, -2.0, 0.5)}
        r = f(trial[-1.0])
        if r < vals[0]:
            e = f(trial[-2.0])
            pts[-1], vals[-1] = (trial[-2.0], e) if e < r else (trial[-1.0], r)
        elif r < vals[-2]:
            pts[-1], vals[-1] = trial[-1.0], r
        else:
            c = f(trial[0.5])
            if c < vals[-1]:
                pts[-1], vals[-1] = trial[0.5], c
            else:
                pts = [pts[0], *[pts[0] + 0.5 * (x - pts[0]) for x in pts[1:]]]
                vals = [vals[0], *[f(x) for x in pts[1:]]]
    return pts[int(np.argmin(vals))]


def _hessian(f, at: np.ndarray) -> np.ndarray:
    n = len(at)
    h = 1e-3 * np.maximum(np.abs(at), 1e-2)
    out = np.zeros((n, n))
    for i in range(n):
        for j in range(i, n):
            acc = 0.0
            for a, b, s in ((1, 1, 1), (1, -1, -1), (-1, 1, -1), (-1, -1, 1)):
                x = at.copy()
                x[i] += a * h[i]
                x[j] += b * h[j]
                acc += s * f(x)
            out[i, j] = out[j, i] = acc / (4 * h[i] * h[j])
    return out


