"""Sums of the kernel (x.y / d + 1)^3 over all pairs of two sets of vectors, from sums of features: work in proportion to the rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

#: Dimensions up to which third moments are taken (357,760 features), keys a task adds up at once, and partial sums of
#: a key before they are added up for good. Features go in pieces: up to degree 2, then ``PIECE`` at a time.
LARGEST, HELD, PARTIALS, PIECE = 128, 64, 64, 4096


@lru_cache(maxsize=2)
def places(d: int) -> tuple[np.ndarray, ...]:
    """Row, column (and depth) of the distinct entries of symmetric tensors of degree 2 and 3, and every feature's weight.

    The kernel (x.y / d + 1)^3 is the inner product of the monomials up to degree 3 with the square of these weights.
    """
    i2, j2 = np.triu_indices(d)
    i3, j3, k3 = (np.concatenate(c) for c in zip(*[(np.full((d - i) * (d - i + 1) // 2, i), *(t + i for t in np.triu_indices(d - i))) for i in range(d)]))
    orders2 = np.where(i2 == j2, 1, 2)
    equal = (i3 == j3).astype(int) + (j3 == k3) + (i3 == k3)
    orders3 = np.select([equal == 3, equal == 1], [1, 3], 6)
    weight = np.sqrt(np.concatenate([[1.0], np.full(d, 3 / d), 3 * orders2 / d**2, orders3 / d**3]))
    return i2, j2, i3, j3, k3, weight


def features(x: np.ndarray) -> np.ndarray:
    """The sum of the kernel's features over the rows of a matrix; ``features(x) @ features(y)`` is the sum over all pairs."""
    n, d = x.shape
    i2, j2, *_, weight = places(d)
    second = x.T @ x
    third = [((x * x[:, i : i + 1]).T @ x[:, i:])[i:] for i in range(d)]
    third = [t[np.triu_indices(d - i)] for i, t in enumerate(third)]
    return np.concatenate([[n], x.sum(axis=0), second[i2, j2], *third]) * weight


SUM_SQL = "piece int, diagonal double, features array<double>"
TYPES = {"passed": pa.bool_(), "piece": pa.int32(), "diagonal": pa.float64(), "features": pa.list_(pa.float64())}


def _rows(rows: list[tuple], names: Sequence[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, TYPES.get(n, pa.string())) for n, c in zip(names, zip(*rows))], names=list(names))


def taken(names: Sequence[str]):
    """A task's sums of features of ``v`` for each value of ``names``, in pieces. The kernel's diagonal goes with the first piece."""

    return lambda batches: _taken(batches, names)


def _taken(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple, list] = {}

    def emit() -> Iterator[pa.RecordBatch]:
        for key, (diagonal, f, d) in held.items():
            low = 1 + d + d * (d + 1) // 2
            cuts = [0, *range(low, len(f), PIECE), len(f)]
            yield _rows([(*key, i, 0.0 if i else diagonal, f[b:e]) for i, (b, e) in enumerate(zip(cuts, cuts[1:]))], (*names, "piece", "diagonal", "features"))
        held.clear()

    for batch in batches:
        x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        d = x.shape[1]
        if d > LARGEST:
            raise ValueError(f"vectors of {d} dimensions, at most {LARGEST} are taken")
        order: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(*(batch.column(k).to_pylist() for k in names))):
            order.setdefault(key, []).append(i)
        for key, own in order.items():
            part = x[own]
            entry = held.setdefault(key, [0.0, 0.0, d])
            entry[0] += float((((part**2).sum(axis=1) / d + 1) ** 3).sum())
            entry[1] = entry[1] + features(part)
        if len(held) > HELD:
            yield from emit()
    yield from emit()


def _folded(names: Sequence[str]):
    """Add up rows that come sorted by ``names`` and piece."""

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, diagonal, total, columns = None, 0.0, 0.0, (*names, "piece", "diagonal", "features")
        for batch in batches:
            out, f = [], batch.column("features")
            for i, (*key, d) in enumerate(zip(*(batch.column(n).to_pylist() for n in (*names, "piece", "diagonal")))):
                if key != now and now is not None:
                    out.append((*now, diagonal, total))
                if key != now:
                    now, diagonal, total = key, 0.0, 0.0
                diagonal, total = diagonal + d, total + f.slice(i, 1).flatten().to_numpy(zero_copy_only=False)
            if out:
                yield _rows(out, columns)
        if now is not None:
            yield _rows([(*now, diagonal, total)], columns)

    return folded


def added(rows: DataFrame, names: Sequence[str], sql: str, parts: int, *salt: Column) -> DataFrame:
    dealt = rows.select(*names, "piece", "diagonal", "features").repartition(parts, *names, "piece", *salt).sortWithinPartitions(*names, "piece")
    return dealt.mapInArrow(_folded(names), f"{sql}, {SUM_SQL}")
