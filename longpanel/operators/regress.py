"""Least squares inside many groups at once.

Only sums of products leave the rows (combined map-side, so no group is ever collected); the
small normal equations are solved per group and the coefficients are joined back.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import is_finite
from ..functions.ordered import join_back, over_group


def _solve(gram: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Minimum-norm solution; scaled so that the cut-off does not depend on units."""
    d = np.sqrt(np.diag(gram))
    s = np.where(d > 0, d, 1.0)
    beta, *_ = np.linalg.lstsq(gram / np.outer(s, s), rhs / s, rcond=1e-12)
    return beta / s


def _packed_solver(m: int):
    """Pandas UDF over the upper triangle of an (m+1) x (m+1) moment matrix, y last."""

    def solve(sums: pd.Series) -> pd.Series:
        out = []
        for s in sums:
            full = np.zeros((m + 1, m + 1))
            full[np.triu_indices(m + 1)] = np.asarray(s, dtype=float)
            full = full + np.triu(full, 1).T
            out.append(_solve(full[:m, :m], full[:m, m]))
        return pd.Series(out)

    return F.pandas_udf(solve, T.ArrayType(T.DoubleType()))


def group_coefficients(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str],
                       out: str = "_beta") -> DataFrame:
    """One row per group: coefficients of ``y`` on ``xs`` without intercept, and the row count.

    Inputs are expected centred; rows with a NULL anywhere must carry NULL in every column.
    """
    cols = [*xs, y]
    sums = [F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0.0))
            for i, a in enumerate(cols) for b in cols[i:]]
    g = df.groupBy(*by).agg(F.count(y).alias("_n"), F.array(*sums).alias("_s"))
    return g.where(F.col("_n") > 0).select(
        *by, "_n", _packed_solver(len(xs))("_s").alias(out))


def group_residuals(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str], *,
                    dummies: Sequence[str] = (), min_rows: int = 10,
                    out: str = "_res") -> DataFrame:
    """Residual of ``y`` on an intercept, ``xs`` and category dummies, within each group.

    NULL on rows with a missing input and in groups with fewer than ``min_rows`` usable rows.
    """
    if dummies:
        return _dummy_residuals(df, y, xs, by, dummies, min_rows, out)
    ok = reduce(lambda a, b: a & b, [is_finite(F.col(c).cast("double")) for c in [y, *xs]])
    cols = [y, *xs]
    names = {c: f"_c{i}" for i, c in enumerate(cols)}
    df = df.withColumn("_use", ok)
    df = df.withColumns({n: F.when(F.col("_use"), F.col(c).cast("double"))
                         for c, n in names.items()})
    df = over_group(df, by, {f"_m{n}": F.avg(n) for n in names.values()})
    df = df.withColumns({n: F.col(n) - F.col(f"_m{n}") for n in names.values()})
    beta = group_coefficients(df, names[y], [names[x] for x in xs], by)
    df = join_back(df, beta, by)
    fitted = reduce(lambda a, b: a + b, [
        F.element_at("_beta", i + 1) * F.col(names[x]) for i, x in enumerate(xs)], F.lit(0.0))
    return df.withColumn(out, F.when(F.col("_n") >= min_rows, F.col(names[y]) - fitted)).drop(
        "_use", "_n", "_beta", *names.values(), *[f"_m{n}" for n in names.values()])


def _dummy_residuals(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str],
                     dummies: Sequence[str], min_rows: int, out: str) -> DataFrame:
    """Sparse normal equations: every row contributes the products of its few active columns."""
    ok = reduce(lambda a, b: a & b, [is_finite(F.col(c)) for c in [y, *xs]]
                + [F.col(d).isNotNull() for d in dummies])
    active = [F.struct(F.lit("1").alias("f"), F.lit(1.0).alias("v"))]
    active += [F.struct(F.concat(F.lit(f"{d}="), F.col(d).cast("string")).alias("f"),
                        F.lit(1.0).alias("v")) for d in dummies]
    active += [F.struct(F.lit(x).alias("f"), F.col(x).alias("v")) for x in xs]
    active += [F.struct(F.lit("~y").alias("f"), F.col(y).alias("v"))]
    terms = df.where(ok).select(*by, F.array(*active).alias("_a"))
    pairs = terms.select(*by, "_a", F.explode("_a").alias("_i")).select(
        *by, "_i", F.explode("_a").alias("_j"))
    gram = pairs.groupBy(*by, F.col("_i.f").alias("fi"), F.col("_j.f").alias("fj")).agg(
        F.sum(F.col("_i.v") * F.col("_j.v")).alias("s"))

    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}"
                           for f in df.select(*by).schema)
    keys = list(by)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="fi", columns="fj", values="s").fillna(0.0)
        names = [n for n in m.index if n != "~y"]
        n = m.at["1", "1"]
        beta = _solve(m.loc[names, names].to_numpy(), m.loc[names, "~y"].to_numpy())
        res = pd.DataFrame({"f": names, "beta": beta})
        for k in keys:
            res[k] = pdf[k].iloc[0]
        res["n"] = n
        return res[[*keys, "f", "beta", "n"]]

    # the group is the moment matrix of one timestamp: (levels + numeric columns) squared
    beta = gram.groupBy(*by).applyInPandas(solve, f"{key_schema}, f string, beta double, n double")
    coef = beta.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("f", "beta")))
                                 .alias("_b"), F.max("n").alias("_n"))
    df = join_back(df, coef, by)
    fitted = F.element_at("_b", F.lit("1"))
    for d in dummies:
        fitted = fitted + F.element_at("_b", F.concat(F.lit(f"{d}="), F.col(d).cast("string")))
    for x in xs:
        fitted = fitted + F.element_at("_b", F.lit(x)) * F.col(x)
    return df.withColumn(out, F.when(ok & (F.col("_n") >= min_rows), F.col(y) - fitted)
                         ).drop("_b", "_n")
