"""A factor pool that lives in a committed store: moments of pairs, and a log from which the pool follows.

For a new factor only its own row of the correlation table is computed, against each member of the pool: per timestamp
and pair the number of names both have and the moments of their ranks. The row is stored, so a later question about
any two factors is an aggregate over stored moments, not over the panel; moments of later timestamps add to those that are
there. The pool itself is a fold over the log, in the order of its entries; an entry is one commit, so two writers cannot
both make the same step, and a pool is as it was after any step.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import SYMBOL, TS, finite, require_columns
from ..functions.ordered import with_rank
from ..sources.store import NoCommit, Store
from .screen import orthogonalize, sample_digest

LOG = ("step bigint, factor string, verdict string, tested_against string, max_abs_corr double, most_correlated string, "
       "orthogonalized boolean, reason string, n_periods bigint, n_names bigint, sample_start timestamp_ntz, "
       "sample_end timestamp_ntz, sample_digest string")


def pair_moments(df: DataFrame, factor: str, others: Sequence[str], *, ts: str = TS, method: str = "spearman") -> DataFrame:
    """``(ts, other, n, sx, sy, sxx, syy, sxy)`` of ``factor`` and each of ``others`` on the names that have both.

    ``spearman`` takes moments of average ranks among those names. One pass over the panel, a row an ``other`` and name.
    """
    if method not in ("spearman", "pearson"):
        raise ValueError(f"no moments for {method!r}")
    require_columns(df, (ts, SYMBOL, factor, *others), "pair_moments")
    clean = lambda c: finite(F.col(c).cast("double"))
    pairs = F.array(*[F.struct(F.lit(o).alias("other"), clean(o).alias("_y")) for o in others])
    t = df.select(F.col(ts).alias(TS), clean(factor).alias("_x"), F.explode(pairs).alias("_p")).select(TS, "_x", "_p.other", "_p._y")
    t = t.where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    if method == "spearman":
        t = with_rank(with_rank(t, ["other", TS], "_x", "_rx"), ["other", TS], "_y", "_ry")
        t = t.select(TS, "other", F.col("_rx").alias("_x"), F.col("_ry").alias("_y"))
    x, y = F.col("_x"), F.col("_y")
    return t.groupBy(TS, "other").agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"),
                                      F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"))


def correlations(moments: DataFrame, by: Sequence[str], *, min_names: int = 20) -> DataFrame:
    """``by, rho, n_ts``: correlations of timestamps with at least ``min_names`` names, averaged over them."""
    n = F.col("n")
    vx, vy = n * F.col("sxx") - F.col("sx") * F.col("sx"), n * F.col("syy") - F.col("sy") * F.col("sy")
    spread = (vx > 1e-12 * n * F.col("sxx")) & (vy > 1e-12 * n * F.col("syy"))
    rho = F.when((n >= min_names) & spread, (n * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(vx * vy))
    return moments.groupBy(*by).agg(F.avg(rho).alias("rho"), F.count(rho).alias("n_ts"))


class FactorLedger:
    """The pool at ``path``: ``propose`` tests a factor, stores its moments and logs the verdict."""

    def __init__(self, spark: SparkSession, path: str, *, threshold: float = 0.7, reject_above: float = 0.95) -> None:
        if not 0.0 < threshold <= reject_above <= 1.0:
            raise ValueError(f"no order in the limits {threshold} and {reject_above}")
        self.spark, self.threshold, self.reject_above = spark, threshold, reject_above
        self.moments, self.entries = Store(spark, f"{path}/moments"), Store(spark, f"{path}/log")

    def log(self, step: int | None = None) -> DataFrame:
        """Every decision in order, or those up to a step."""
        try:
            return self.entries.read(version=step).select(*[c.split()[0] for c in LOG.split(", ")])
        except NoCommit:
            return self.spark.createDataFrame([], LOG)

    def factors(self, step: int | None = None) -> list[str]:
        """Members of the pool in order of admission: as many names as were ever admitted."""
        admitted = self.log(step).where(F.col("verdict") != "reject").orderBy("step").select("factor")
        return [r["factor"] for r in admitted.collect()]

    def correlation(self, *, min_names: int = 20) -> DataFrame:
        """``(f1, f2, rho, n_ts)`` of every pair that has been tested, from the stored moments."""
        m = self.moments.read().select(F.col("factor").alias("f1"), F.col("other").alias("f2"), "n", "sx", "sy", "sxx", "syy", "sxy")
        return correlations(m, ["f1", "f2"], min_names=min_names)

    def propose(self, df: DataFrame, factor: str, *, min_names: int = 20, ts: str = TS, method: str = "spearman",
                ortho_method: str = "schmidt") -> DataFrame:
        """Test one factor; returns the frame, with the factor's residual where the verdict is ``orthogonalize``."""
        pool = self.factors()
        if factor in pool:
            raise ValueError(f"{factor!r} is in the pool")
        step = (self.entries.versions() or [0])[-1] + 1
        worst = None
        if pool:
            m = pair_moments(df, factor, pool, ts=ts, method=method).withColumn("factor", F.lit(factor))
            # a partition a tested factor, so that a test that is run again replaces its row
            self.moments.write(m.withColumn("date", F.lit(f"{step:08d}-{factor}")))
            seen = correlations(self.moments.read(start=f"{step:08d}-{factor}", end=f"{step:08d}-{factor}"), ["other"], min_names=min_names)
            worst = seen.where(F.col("rho").isNotNull()).orderBy(F.abs("rho").desc(), "other").first()
        size = abs(worst["rho"]) if worst else 0.0
        against = worst["other"] if worst else None
        if not pool:
            verdict, reason = "admit", "pool is empty"
        elif worst is None:
            verdict, reason = "reject", "no timestamp had enough overlapping names"
        elif size >= self.reject_above:
            verdict, reason = "reject", f"duplicate of {against}"
        elif size >= self.threshold:
            verdict, reason = "orthogonalize", f"overlaps {against}"
        else:
            verdict, reason = "admit", "independent enough"
        known = self.spark.createDataFrame(
            [(step, factor, verdict, ", ".join(pool), size, against, verdict == "orthogonalize", reason)],
            "step bigint, factor string, verdict string, tested_against string, max_abs_corr double, most_correlated string, orthogonalized boolean, reason string")
        entry = known.join(sample_digest(df, ts=ts), how="cross").select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in LOG.split(", ")])
        if self.entries.write(entry.withColumn("date", F.lit(f"{step:08d}"))) != step:
            raise RuntimeError(f"step {step} was taken by another writer")
        return orthogonalize(df, factor, pool, method=ortho_method, ts=ts) if verdict == "orthogonalize" else df

    def propose_all(self, df: DataFrame, factors: Sequence[str], **options) -> DataFrame:
        """Test factors one after another on one frame; residuals of overlapping ones are put into the result."""
        if len(set(factors)) < len(factors):
            raise ValueError(f"a factor is proposed twice in {list(factors)}")
        return reduce(lambda out, f: self.propose(out, f, **options), factors, df)
