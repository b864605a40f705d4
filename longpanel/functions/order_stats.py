"""Order statistics of trailing windows at a cost that does not grow with the window.

A window function that collects and sorts each window does ``rows x window`` work. Here rows pass a task in order, in
pieces at least as long as the window, each led by the rows the window reaches back to. Over the values of a piece
stands a wavelet matrix on their dense ranks: bit by bit, from the highest, the ranks are parted stably into zeros and
ones, and the running count of zeros is kept. It answers "the k-th smallest between two places" and "how many there are
below this value" with one look-up for each bit, for all rows of the piece at once.

Values keep their kind: whole numbers stay whole, all else is taken as double. NULL values are not counted, NaN is the
largest. Memory: about ``4 * log2(rows)`` bytes for each row of a piece.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Rows of a piece, where the window is not longer.
PIECE = 1 << 16
_WHOLE = ("tinyint", "smallint", "int", "bigint")


class WaveletMatrix:
    """Order statistics of any stretch of ``ranks``, which are below ``size``."""

    def __init__(self, ranks: np.ndarray, size: int) -> None:
        self.bits = max(1, int(size - 1).bit_length())
        self.zeros, x = [], ranks
        for bit in range(self.bits - 1, -1, -1):
            zero = (x >> bit) & 1 == 0
            self.zeros.append(np.concatenate((np.zeros(1, np.int32), np.cumsum(zero, dtype=np.int32))))
            x = np.concatenate((x[zero], x[~zero]))

    def kth(self, left: np.ndarray, right: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The ``k``-th smallest (from 0) of each stretch ``[left, right)``; ``k`` must be inside."""
        out = np.zeros(len(k), np.int64)
        for level, count in enumerate(self.zeros):
            a, b, all_ = count[left], count[right], count[-1]
            small = k < b - a
            k = np.where(small, k, k - (b - a))
            out |= np.where(small, 0, 1 << (self.bits - 1 - level))
            left, right = np.where(small, a, all_ + left - a), np.where(small, b, all_ + right - b)
        return out

    def below(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """How many of each stretch ``[left, right)`` are smaller than ``rank``."""
        out = np.zeros(len(rank), np.int64)
        for level, count in enumerate(self.zeros):
            a, b, all_ = count[left], count[right], count[-1]
            one = (rank >> (self.bits - 1 - level)) & 1 == 1
            out += np.where(one, b - a, 0)
            left, right = np.where(one, all_ + left - a, a), np.where(one, all_ + right - b, b)
        return out


def windowed(values: np.ndarray, null: np.ndarray, start: np.ndarray, stats: Mapping[str, tuple]) -> dict[str, np.ndarray]:
    """Statistics of the windows ``[start[i], i]``: name -> values, masked where the window has none.

    ``("count",)``, ``("below",)`` (values below the row's own; NULL if that is NULL), ``("quantile", q, how)`` with
    ``nearest``, ``lower`` or ``linear``.
    """
    sure = np.concatenate(([0], np.cumsum(~null)))
    left, right = sure[start], sure[1:]
    n = right - left
    distinct, ranks = np.unique(values[~null], return_inverse=True)
    waves = WaveletMatrix(ranks, len(distinct)) if len(distinct) else None
    some = n > 0
    a, b, m = left[some], right[some], n[some]

    def pick(k: np.ndarray) -> np.ndarray:
        return distinct[waves.kth(a, b, k)]

    def spread(x: np.ndarray, where: np.ndarray) -> np.ma.MaskedArray:
        out = np.ma.masked_all(len(n), x.dtype)
        out[where] = x
        return out

    out = {}
    for name, (kind, *how) in stats.items():
        if kind == "count":
            out[name] = np.ma.asarray(n)
        elif waves is None:
            out[name] = np.ma.masked_all(len(n), np.int64 if kind == "below" else values.dtype)
        elif kind == "below":
            own = ~null
            out[name] = spread(waves.below(left[own], right[own], ranks), own)
        else:
            q, method = how
            k = q * (m - 1)
            if method == "linear":
                low = np.floor(k).astype(np.int64)
                x, y = pick(low).astype(float), pick(np.minimum(low + 1, m - 1)).astype(float)
                out[name] = spread(np.where(k == low, x, x + (y - x) * (k - low)), some)
            else:
                out[name] = spread(pick(np.floor(k + 0.5 if method == "nearest" else k).astype(np.int64)), some)
    return out


def trailing_statistics(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, window: int,
                        stats: Mapping[str, tuple]) -> DataFrame:
    """``df`` with statistics of ``value`` over the last ``window`` rows of each group, the current one included.

    ``(keys, order)`` should identify a row. One Exchange on the keys; a group flows through its task in pieces.
    """
    for kind, *how in stats.values():
        if kind not in ("count", "below", "quantile") or (kind == "quantile" and how[1] not in ("nearest", "lower", "linear")):
            raise ValueError(f"unknown statistic {(kind, *how)!r}")
    whole = df.schema[value].dataType.simpleString() in _WHOLE
    kinds = {n: T.LongType() if k in ("count", "below") or (whole and how[1] != "linear") else T.DoubleType()
             for n, (k, *how) in stats.items()}
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in kinds.items()]])
    keys = list(keys)

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        names = [*keys, value]
        tail = None  # keys and values that later windows reach back to

        def finish(parts: list):
            nonlocal tail
            rows = pa.Table.from_batches(parts)
            seen = rows.select(names) if tail is None else pa.concat_tables([tail, rows.select(names)])
            n, lead = seen.num_rows, seen.num_rows - rows.num_rows
            new = np.zeros(n, bool)
            new[0] = True
            for k in keys:
                code = seen.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
                new[1:] |= code[1:] != code[:-1]
            at = np.arange(n)
            start = np.maximum(np.maximum.accumulate(np.where(new, at, 0)), at - (window - 1))
            x = seen.column(value).combine_chunks()
            null = x.is_null().to_numpy(zero_copy_only=False)
            fill = pc.fill_null(x.cast(pa.int64() if whole else pa.float64()), 0)
            found = windowed(fill.to_numpy(zero_copy_only=False), null, start, stats)
            tail = seen.slice(max(0, n - (window - 1)))
            for name, got in found.items():
                got = got[lead:]
                kind = pa.int64() if isinstance(kinds[name], T.LongType) else pa.float64()
                rows = rows.append_column(name, pa.array(got.filled(0), kind, mask=np.ma.getmaskarray(got)))
            return rows.combine_chunks().to_batches()

        parts, size = [], 0
        for batch in batches:
            if batch.num_rows:
                parts.append(batch)
                size += batch.num_rows
            if size >= max(PIECE, window):
                yield from finish(parts)
                parts, size = [], 0
        if parts:
            yield from finish(parts)

    dealt = df.repartition(*keys) if keys else df.repartition(1)
    return dealt.sortWithinPartitions(*keys, *order).mapInArrow(scan, schema)
