"""Trailing statistics of many windows over rows that lie in order, by Arrow batches.

Spark brings the rows of a key together and sorts them; a task then sees them as batches, and a window is the sum, the
largest, ... of ``n`` shifted copies of a column.  Only the rows that the longest window reaches back to are kept from one
batch to the next, so no group is held.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

KINDS = ("mean", "sum", "std", "max", "min", "corr", "below")


def _shifted(x: np.ndarray, n: int) -> list[np.ndarray]:
    """The last ``n`` values of every row but the first ``n - 1``, newest first."""
    return [x[n - 1 - k:len(x) - k] for k in range(n)]


def _central(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean above the newest value, and the newest value: exact for a constant window."""
    now = x[n - 1:]
    mean = np.zeros(len(now))
    for v in _shifted(x, n):
        mean += v - now
    return mean / n, now


def _deviation(x: np.ndarray, n: int) -> np.ndarray:
    mean, now = _central(x, n)
    total = np.zeros(len(now))
    for v in _shifted(x, n):
        total += (v - now - mean) ** 2
    return np.sqrt(total / (n - 1))


def _window(kind: str, n: int, x: np.ndarray, y: np.ndarray | None) -> np.ndarray:
    """The statistic of every full window; a missing value is NaN and makes it NaN."""
    if kind == "corr":
        x, y = np.where(np.isnan(y), np.nan, x), np.where(np.isnan(x), np.nan, y)
        (mx, nx), (my, ny) = _central(x, n), _central(y, n)
        total = np.zeros(len(nx))
        for a, b in zip(_shifted(x, n), _shifted(y, n)):
            total += (a - nx - mx) * (b - ny - my)
        spread = _deviation(x, n) * _deviation(y, n)
        return np.divide(total / (n - 1), spread, out=np.full(len(nx), np.nan), where=spread != 0)
    if kind == "std":
        return _deviation(x, n)
    if kind in ("max", "min"):
        out = x[n - 1:].copy()
        for v in _shifted(x, n)[1:]:
            (np.maximum if kind == "max" else np.minimum)(out, v, out=out)
        return out
    parts = _shifted(x, n)
    if kind == "below":
        whole = sum(parts)
        return np.where(np.isnan(whole), np.nan, sum((v < parts[0]).astype(float) for v in parts))
    total = np.zeros(len(parts[0]))
    for v in reversed(parts):
        total += v
    return total / n if kind == "mean" else total


def trailing_stats(df: DataFrame, row: str, specs: Mapping[str, tuple]) -> DataFrame:
    """``df`` with a double per entry of ``specs``: ``out -> (kind, column[, second column], n)``.

    ``row`` is the number of a row within its key, from 1, by a window function over that key: rows come as it left them,
    which is checked.  A window of fewer than ``n`` values is NULL; NaN counts as missing.  ``corr`` is NULL when a side is
    constant, ``below`` counts the values under the newest one.  A column may be an earlier entry of ``specs``, or
    ``(f, column, column)``: a function of arrays.
    """
    for kind, *_ in specs.values():
        if not (callable(kind) or kind in KINDS):
            raise ValueError(f"unknown statistic {kind!r}")
    used = list(dict.fromkeys(c for spec in specs.values() for c in spec[1:] if isinstance(c, str) and c not in specs))
    # an entry may look back over what another one looked back for
    reach = sum(sorted((spec[-1] for spec in specs.values() if not callable(spec[0])), reverse=True)[:2])
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in specs]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, np.ndarray] = {c: np.empty(0) for c in used}
        before = np.empty(0, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.concatenate([before, batch.column(row).to_numpy(zero_copy_only=False).astype(np.int64)])
            step = np.diff(at)
            if not (len(before) or at[0] == 1) or not ((step == 1) | (at[1:] == 1)).all():
                raise RuntimeError("rows of a key are not together and in order")
            cols = {c: np.concatenate([kept[c], batch.column(c).to_numpy(zero_copy_only=False).astype(float)]) for c in used}
            m, new = len(at), batch.num_rows
            with np.errstate(all="ignore"):
                for name, spec in specs.items():
                    if callable(spec[0]):
                        cols[name] = spec[0](*[cols[c] for c in spec[1:]])
                        continue
                    kind, *xs, n = spec
                    res = np.full(m, np.nan)
                    if m >= n:
                        res[n - 1:] = _window(kind, n, cols[xs[0]], cols[xs[1]] if len(xs) > 1 else None)
                    res[at < n] = np.nan  # the window starts before its key
                    cols[name] = res
            out = [pa.array(cols[n][m - new:], from_pandas=True) for n in specs]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, *specs])
            before, kept = at[-reach:], {c: cols[c][-reach:] for c in used}

    return df.mapInArrow(run, schema)
