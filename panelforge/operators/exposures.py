"""Style exposures: from descriptors to orthogonal standardised styles, all styles of all dates in a few passes.

A pass reads the rows once for their moments, a row for each date with what all styles need, and once more to apply them. What is linear
is carried by algebra: regressions on any number of styles come from cross products, and so do mean and deviation of
their residuals, without looking at these. A table in the shared folder ends each pass, so no plan reads more than a few tables.
Rows are never grouped in a task; a date may hold any number of them. Missing values are null.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.operators.crosssection import MAD_SCALE, combine, medians
from panelforge.sources.store import stored


@dataclass(frozen=True)
class StyleModel:
    """weights: descriptors of each style. cubes: styles that are another's cube. targets: styles that a style must be orthogonal to."""

    weights: Mapping[str, Mapping[str, float]]
    size: str
    cubes: Mapping[str, str] = field(default_factory=dict)
    targets: Mapping[str, Sequence[str]] = field(default_factory=dict)
    unclipped: Sequence[str] = ()
    error: float = 10.0
    clip: float = 3.0
    least: int = 30

    @property
    def descriptors(self) -> list[str]:
        return sorted({d for w in self.weights.values() for d in w})

    @property
    def styles(self) -> list[str]:
        return [*self.weights, *self.cubes]


def with_moments(df: DataFrame, by: Sequence[str], aggregates: Mapping[str, Column]) -> DataFrame:
    """df with aggregates of its key, of which there is a row for each date."""
    return df.join(df.groupBy(*by).agg(*(a.alias(n) for n, a in aggregates.items())), list(by))


def cross_sums(x: Sequence[str], w: Column, where: Column, tag: str) -> dict[str, Column]:
    """Aggregates {tag}n, {tag}w, {tag}s{i} and {tag}q{i}_{j} over rows of ``where`` that have all of x and w."""
    ok = where & w.isNotNull()
    for c in x:
        ok &= F.col(c).isNotNull()
    total = lambda v: F.coalesce(F.sum(F.when(ok, w * v)), F.lit(0.0))
    out = {f"{tag}n": F.count(F.when(ok, 1)), f"{tag}w": total(F.lit(1.0))}
    for i, a in enumerate(x):
        out[f"{tag}s{i}"] = total(F.col(a))
        out |= {f"{tag}q{i}_{j}": total(F.col(a) * F.col(x[j])) for j in range(i, len(x))}
    return out


def fitted(sums: DataFrame, tag: str, k: int) -> DataFrame:
    """sums with {tag}a and {tag}b1.. of the weighted fit of the first of k + 1 variables on the others and a constant.

    Elimination on the centred cross products, as columns. A regressor that the ones before explain has the coefficient 0;
    without more rows than coefficients all are null.
    """
    n = F.nullif(F.col(f"{tag}w"), F.lit(0.0))
    mean = lambda i: F.try_divide(F.col(f"{tag}s{i}"), n)
    centred = lambda i, j: F.try_divide(F.col(f"{tag}q{min(i, j)}_{max(i, j)}"), n) - mean(i) * mean(j)
    cell = lambda i, j: f"_m{i}_{j}"
    x = sums.withColumns({cell(i, j): centred(i, j) for i in range(1, k + 1) for j in range(k + 1)}).withColumns({f"_d{i}": centred(i, i) for i in range(1, k + 1)})
    good = lambda p: F.col(cell(p, p)) > 1e-10 * F.col(f"_d{p}")
    for p in range(1, k + 1):
        below = {}
        for i in range(p + 1, k + 1):
            f = F.when(good(p), F.try_divide(F.col(cell(i, p)), F.col(cell(p, p)))).otherwise(0.0)
            below |= {cell(i, j): F.col(cell(i, j)) - f * F.col(cell(p, j)) for j in [0, *range(p, k + 1)]}
        x = x.withColumns(below) if below else x
    for p in range(k, 0, -1):
        rest = sum((F.col(cell(p, j)) * F.col(f"_b{j}") for j in range(p + 1, k + 1)), F.lit(0.0))
        x = x.withColumn(f"_b{p}", F.when(good(p), F.try_divide(F.col(cell(p, 0)) - rest, F.col(cell(p, p)))).otherwise(0.0))
    enough = F.col(f"{tag}n") > k + 1
    a = mean(0) - sum((F.col(f"_b{j}") * mean(j) for j in range(1, k + 1)), F.lit(0.0))
    x = x.withColumns({f"{tag}a": F.when(enough, a), **{f"{tag}b{j}": F.when(enough, F.col(f"_b{j}")) for j in range(1, k + 1)}})
    return x.drop(*(cell(i, j) for i in range(1, k + 1) for j in range(k + 1)), *(f"_d{i}" for i in range(1, k + 1)), *(f"_b{i}" for i in range(1, k + 1)))


def residual(y: str, on: Sequence[str], tag: str) -> Column:
    """y less its fit; y itself where there was no fit; null where a regressor is."""
    fit = F.col(f"{tag}a") + sum((F.col(f"{tag}b{j}") * F.col(z) for j, z in enumerate(on, 1)), F.lit(0.0))
    return F.when(F.col(f"{tag}a").isNull(), F.col(y)).otherwise(F.col(y) - fit)


def of_residual(fit: str, over: str, k: int) -> tuple[Column, Column]:
    """Mean and deviation of the residual of ``fit`` under the sums ``over``, by algebra."""
    n = F.nullif(F.col(f"{over}w"), F.lit(0.0))
    none = F.col(f"{fit}a").isNull()
    c = [F.lit(1.0), *(F.when(none, 0.0).otherwise(-F.col(f"{fit}b{j}")) for j in range(1, k + 1))]
    mean = lambda i: F.try_divide(F.col(f"{over}s{i}"), n)
    linear = sum((c[i] * mean(i) for i in range(k + 1)), F.lit(0.0))
    cov = lambda i, j: F.try_divide(F.col(f"{over}q{min(i, j)}_{max(i, j)}"), n) - mean(i) * mean(j)
    variance = sum((c[i] * c[j] * cov(i, j) for i in range(k + 1) for j in range(k + 1)), F.lit(0.0))
    return linear - F.when(none, 0.0).otherwise(F.col(f"{fit}a")), F.sqrt(F.greatest(variance, F.lit(0.0)))


def orthogonalize_many(df: DataFrame, by: Sequence[str], targets: Mapping[str, Sequence[str]], w: str, where: Column, more: Mapping[str, Column] | None = None) -> DataFrame:
    """df with, for each style of targets, its coefficients ({style}_f_a, {style}_f_b1, ...) and the moments of its residual.

    One aggregate of cross products for all of them. {style}_f_m and _f_s are mean and deviation of the residual over ``where`` with equal
    weights, and for each name of ``more``, a weight, {style}_f_{name} is its weighted mean.
    """
    sums: dict[str, Column] = {}
    for s, on in targets.items():
        sums |= cross_sums([s, *on], F.col(w), where, f"{s}_f_")
        sums |= cross_sums([s, *on], F.lit(1.0), where, f"{s}_e_")
        for name, weight in (more or {}).items():
            sums |= cross_sums([s, *on], weight, where, f"{s}_{name}_")
    table = df.groupBy(*by).agg(*(a.alias(n) for n, a in sums.items()))
    kept = list(by)
    for s, on in targets.items():
        k = len(on)
        table = fitted(table, f"{s}_f_", k)
        m, sd = of_residual(f"{s}_f_", f"{s}_e_", k)
        means = {f"{s}_f_{name}": of_residual(f"{s}_f_", f"{s}_{name}_", k)[0] for name in more or {}}
        table = table.withColumns({f"{s}_f_m": m, f"{s}_f_s": sd, f"{s}_f_count": F.col(f"{s}_e_n"), **means})
        kept += [f"{s}_f_a", *(f"{s}_f_b{j}" for j in range(1, k + 1)), f"{s}_f_m", f"{s}_f_s", f"{s}_f_count", *means]
    return df.join(table.select(*kept), list(by))


def orthogonalized(df: DataFrame, by: Sequence[str], y: str, on: Sequence[str], w: str, fit: Column, name: str = "resid") -> DataFrame:
    """Residual of the weighted fit of y on a constant and any number of regressors over ``fit``, for all rows that have them."""
    return orthogonalize_many(df, by, {y: on}, w, fit).withColumn(name, residual(y, on, f"{y}_f_")).select(*df.columns, name)


def _clipped(x: Column, m: Column, s: Column, k: float, n: Column) -> Column:
    return F.when(x.isNull() | (n < 2), x).otherwise(F.least(F.greatest(x, m - k * s), m + k * s))


def _standard(x: Column, m: Column, s: Column, n: Column) -> Column:
    return F.when(x.isNull() | (n < 2), None).when(s == 0, 0.0).otherwise((x - m) / F.nullif(s, F.lit(0.0)))


def _mean(x: str, w: str, where: Column) -> Column:
    ok = where & F.col(x).isNotNull() & F.col(w).isNotNull()
    return F.try_divide(F.sum(F.when(ok, F.col(w) * F.col(x))), F.nullif(F.sum(F.when(ok, F.col(w))), F.lit(0.0)))


def clean(df: DataFrame, by: Sequence[str], model: StyleModel) -> tuple[DataFrame, DataFrame]:
    """df without descriptor values that are data errors (over ``error`` robust deviations off), and by, descriptor, n_error, n_valid. df is read several times."""
    names = model.descriptors
    own = df.filter("in_estu")
    med = medians(own, by, {f"_med_{d}": F.col(d) for d in names})
    robust = med.join(medians(own.join(med, list(by)), by, {f"_mad_{d}": F.abs(F.col(d) - F.col(f"_med_{d}")) for d in names}), list(by))
    bad = lambda d: F.coalesce(F.abs(F.col(d) - F.col(f"_med_{d}")) > model.error * MAD_SCALE * F.nullif(F.col(f"_mad_{d}"), F.lit(0.0)), F.lit(False))
    x = stored(df.join(robust, list(by), "left").withColumns({f"_bad_{d}": bad(d) for d in names}).drop(*robust.drop(*by).columns), "descriptors")
    counts = x.groupBy(*by).agg(F.array(*(F.struct(F.lit(d).alias("descriptor"), F.count_if(f"_bad_{d}").alias("n_error"), F.count(d).alias("n_valid")) for d in names)).alias("q"))
    cleaned = x.withColumns({d: F.when(~F.col(f"_bad_{d}"), F.col(d).cast("double")) for d in names}).drop(*(f"_bad_{d}" for d in names))
    return cleaned, counts.select(*by, F.inline("q"))


def imputed(df: DataFrame, by: Sequence[str], styles: Sequence[str], industry: str, size: str, w: str) -> DataFrame:
    """df with nulls of the styles filled and imp_{style}. From the fit on industries, and the size for others than the size itself.

    Sums over (date, industry) of all styles at once; by partialling out, the slope is pooled over industries. Rows without industry or
    size, and dates with fewer fitted rows than coefficients, get 0; an industry without fitted rows has the level 0.
    """
    flags = {f"imp_{s}": F.col(s).isNull() for s in styles}
    x = df.withColumns(flags)
    fit = F.col("in_estu") & F.col(w).isNotNull() & F.col(industry).isNotNull()
    groups = F.count_distinct(F.col(industry))
    ok = fit & F.col(size).isNotNull()
    level = x.groupBy(*by, industry).agg(_mean(size, w, ok).alias("_level"))
    dates = x.groupBy(*by).agg(F.count(F.when(ok, 1)).alias("_n"), groups.alias("_groups"))
    x = x.join(level.filter(F.col(industry).isNotNull()), [*by, industry], "left").join(dates, list(by))
    fill = F.when(F.col(industry).isNotNull() & (F.col("_n") > F.col("_groups")), F.coalesce("_level", F.lit(0.0)))
    x = stored(x.withColumn(size, F.coalesce(size, fill, F.lit(0.0))).drop("_level", "_n"), "sized")
    others = [s for s in styles if s != size]
    sums: dict[str, Column] = {}
    for s in others:
        has = fit & F.col(s).isNotNull()
        total = lambda v, has=has: F.coalesce(F.sum(F.when(has, F.col(w) * v)), F.lit(0.0))
        sums |= {f"{s}_n": F.count(F.when(has, 1)), f"{s}_w": total(F.lit(1.0)), f"{s}_x": total(F.col(s)), f"{s}_z": total(F.col(size)), f"{s}_zz": total(F.col(size) * F.col(size)), f"{s}_xz": total(F.col(s) * F.col(size))}
    own = x.groupBy(*by, industry).agg(*(a.alias(n) for n, a in sums.items()))
    part = lambda s, a, b: F.col(f"{s}_{a}{b}") - F.coalesce(F.try_divide(F.col(f"{s}_{a}") * F.col(f"{s}_{b}"), F.nullif(F.col(f"{s}_w"), F.lit(0.0))), F.lit(0.0))
    known = own.filter(F.col(industry).isNotNull())
    slopes = known.groupBy(*by).agg(*(F.struct(F.sum(f"{s}_n").alias("n"), F.try_divide(F.sum(part(s, "x", "z")), F.nullif(F.sum(part(s, "z", "z")), F.lit(0.0))).alias("b")).alias(f"{s}_fit") for s in others))
    mean = lambda s, c: F.coalesce(F.try_divide(F.col(f"{s}_{c}"), F.nullif(F.col(f"{s}_w"), F.lit(0.0))), F.lit(0.0))
    levels = known.select(*by, industry, *(F.struct(mean(s, "x").alias("x"), mean(s, "z").alias("z")).alias(f"{s}_at") for s in others))
    y = x.join(levels, [*by, industry], "left").join(slopes, list(by), "left")
    filled = {}
    for s in others:
        enough = F.col(f"{s}_fit.n") > F.col("_groups") + 1
        value = F.col(f"{s}_at.x") + F.coalesce(F.col(f"{s}_fit.b"), F.lit(0.0)) * (F.col(size) - F.col(f"{s}_at.z"))
        filled[s] = F.coalesce(s, F.when(enough, value), F.lit(0.0))
    return y.withColumns(filled).drop("_groups", *(f"{s}_at" for s in others), *(f"{s}_fit" for s in others))


def covered(rows: DataFrame, date: str, model: StyleModel) -> DataFrame:
    """Covered rows of the dates with ``least`` estimation rows, as a table: what comes before it is made once."""
    x = stored(rows, "rows")
    enough = x.filter("in_estu").groupBy(date).count().filter(F.col("count") >= model.least).select(date)
    return x.filter("in_cov").join(enough, date, "left_semi")


def descriptor_counts(rows: DataFrame, date: str, model: StyleModel) -> DataFrame:
    """The descriptors' counts of build_exposures, without the exposures."""
    return clean(covered(rows, date, model), [date], model)[1]


def build_exposures(rows: DataFrame, date: str, cap: str, weight: str, industry: str, model: StyleModel) -> tuple[DataFrame, DataFrame]:
    """date, the rows' other columns, each style and imp_{style} for covered rows; and the descriptors' counts.

    rows have in_cov and in_estu (booleans; estimation rows are covered), cap (mean weights), weight (regression weights), industry and the
    descriptors. Steps of a date: drop data errors, clip, standardise, combine (weights renormalised over what is there), standardise;
    cubes; orthogonalise, clip and standardise; impute; orthogonalise again and standardise. Means are weighted by cap, deviations are not, both over
    the estimation rows. Dates with under ``least`` estimation rows are left out.
    """
    by, estu = [date], F.col("in_estu")
    keep = [c for c in rows.columns if c not in model.descriptors]
    x, counts = clean(covered(rows, date, model), by, model)
    names = model.descriptors
    own = lambda c: F.when(estu, F.col(c))
    x = with_moments(x, by, {k: v for d in names for k, v in {f"_m_{d}": F.avg(own(d)), f"_s_{d}": F.stddev_pop(own(d)), f"_n_{d}": F.count(own(d))}.items()})
    x = x.withColumns({d: F.col(d) if d in model.unclipped else _clipped(F.col(d), F.col(f"_m_{d}"), F.col(f"_s_{d}"), model.clip, F.col(f"_n_{d}")) for d in names})
    x = stored(x.select(*keep, *names), "clipped")

    def standardized(df: DataFrame, columns: Sequence[str]) -> DataFrame:
        found = with_moments(df, by, {k: v for c in columns for k, v in {f"_m_{c}": _mean(c, cap, estu), f"_s_{c}": F.stddev_pop(own(c)), f"_n_{c}": F.count(own(c))}.items()})
        return found.withColumns({c: _standard(F.col(c), F.col(f"_m_{c}"), F.col(f"_s_{c}"), F.col(f"_n_{c}")) for c in columns}).select(*df.columns)

    x = standardized(x, names)
    x = stored(x.select(*keep, *(combine(dict(w)).alias(s) for s, w in model.weights.items())), "combined")
    x = standardized(x, list(model.weights)).withColumns({s: F.pow(F.col(base), F.lit(3.0)) for s, base in model.cubes.items()})
    x = stored(x, "styles")
    turned = {s: list(t) for s, t in model.targets.items() if t}
    if turned:
        y = orthogonalize_many(x, by, turned, weight, estu)
        y = y.withColumns({s: _clipped(residual(s, t, f"{s}_f_"), F.col(f"{s}_f_m"), F.col(f"{s}_f_s"), model.clip, F.col(f"{s}_f_count")) for s, t in turned.items()})
        x = stored(standardized(stored(y.select(*x.columns), "turned"), list(turned)), "styles")
    x = stored(imputed(x, by, model.styles, industry, model.size, weight), "imputed")
    plain = [s for s in model.styles if s not in turned]
    everything = turned | {s: [] for s in plain}
    # With all styles there, the last step is one pass: residuals and their moments come from the same cross products.
    y = orthogonalize_many(x, by, everything, weight, estu, {"cap": F.col(cap)})
    last = {}
    for s, t in everything.items():
        last[s] = _standard(residual(s, t, f"{s}_f_"), F.col(f"{s}_f_cap"), F.col(f"{s}_f_s"), F.col(f"{s}_f_count"))
    return y.withColumns(last).select(*x.columns), counts
