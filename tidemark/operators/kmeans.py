"""Many k-means fits at once: every pass over the rows serves all fits that are still moving, so passes don't grow with starts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rounds of a fit at most, and the distance that its centres move at most in its last, as Spark's KMeans has them.
ROUNDS, TOLERANCE = 20, 1e-4


@dataclass
class Fit:
    """Centres of k clusters that start from a seed; cost, the sum of squared distances, and sizes are those at the last centres."""

    k: int
    seed: int
    centres: np.ndarray
    cost: float = 0.0
    sizes: tuple[int, ...] = ()


def _matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names])


def squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows from centres; exactly 0 where they are equal."""
    out = np.zeros((len(x), len(centres)))
    for j in range(x.shape[1]):
        out += np.subtract.outer(x[:, j], centres[:, j]) ** 2
    return out


def chances(keys: np.ndarray, seed: int, turn: int) -> np.ndarray:
    """Numbers between 0 and 1 that follow from a row's key, the seed and the turn alone (splitmix64)."""
    z = keys.view(np.uint64) + np.uint64(((seed << 8 | turn) * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _first_rung(fits: list[Fit], names: list[str], key: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per task and fit the row whose clock rings first, at the speed of its squared distance from the nearest centre."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[float, int, list[float]]] = {}
        for batch in batches:
            x, keys = _matrix(batch, names), batch.column(key).to_numpy()
            for i, fit in enumerate(fits if len(x) else ()):
                speed = squares(x, fit.centres).min(axis=1) if len(fit.centres) else np.ones(len(x))
                clocks = np.where(speed > 0, -np.log(chances(keys, fit.seed, len(fit.centres))) / np.where(speed > 0, speed, 1.0), np.inf)
                at = min(np.flatnonzero(clocks == clocks.min()), key=lambda p: keys[p])
                one = (float(clocks[at]), int(keys[at]), x[at].tolist())
                if np.isfinite(one[0]) and (i not in best or one[:2] < best[i][:2]):
                    best[i] = one
        rows = [(i, c, k, v) for i, (c, k, v) in best.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 4, (pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.float64())), strict=True)], ["fit", "clock", "key", "x"])

    return draw


def _nearest(fits: list[Fit], x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per fit the place of each row's nearest centre and the squared distance from it."""
    every, at = squares(x, np.concatenate([f.centres for f in fits])), 0
    for fit in fits:
        own = every[:, at : at + fit.k]
        near = own.argmin(axis=1)
        yield near, own[np.arange(len(x)), near]
        at += fit.k


def _gathered(fits: list[Fit], names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per task, fit and centre: rows nearest to it, the sum of their squared distances and the sums of their columns."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((f.k, 2 + len(names))) for f in fits]
        for batch in batches:
            x = _matrix(batch, names)
            for out, (near, far) in zip(total, _nearest(fits, x), strict=True):
                for j, weights in enumerate((None, far, *x.T)):
                    out[:, j] += np.bincount(near, weights, len(out))
        rows = [(i, c, *map(float, row)) for i, out in enumerate(total) for c, row in enumerate(out) if row[0]]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int32() if j < 2 else pa.float64()) for j in range(4 + len(names))], ["fit", "centre", "n", "cost", *(f"s{j}" for j in range(len(names)))])

    return gather


def _passed(rows: DataFrame, names: list[str], fits: list[Fit]) -> list[np.ndarray]:
    """Of each fit a row per centre: how many rows are nearest, their cost and sums. Sums of tasks are added by Spark."""
    sums = [f"s{j}" for j in range(len(names))]
    kinds = "fit int, centre int, n double, cost double, " + ", ".join(f"{s} double" for s in sums)
    found = rows.select(*names).mapInArrow(_gathered(fits, names), kinds).groupBy("fit", "centre").agg(*(F.sum(c).alias(c) for c in ("n", "cost", *sums)))
    out = [np.zeros((f.k, 2 + len(names))) for f in fits]
    for fit, centre, *values in found.collect():  # a row per centre
        out[fit][centre] = values
    return out


def fitted(rows: DataFrame, names: list[str], key: str, wanted: list[tuple[int, int]], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> list[Fit]:
    """A fit for each (k, seed), from k-means++ centres that the rows' keys decide, however the rows are partitioned.

    There must be k different rows at least. A centre that no row is nearest to stays where it is.
    """
    fits = [Fit(k, seed, np.zeros((0, len(names)))) for k, seed in wanted]
    while short := [f for f in fits if len(f.centres) < f.k]:
        drawn = rows.select(key, *names).mapInArrow(_first_rung(short, names, key), "fit int, clock double, key long, x array<double>").groupBy("fit").agg(F.min_by("x", F.struct("clock", "key")).alias("x")).collect()  # a row per fit
        if len(drawn) < len(short):
            raise ValueError("fewer different rows than clusters")
        for i, x in drawn:
            short[i].centres = np.vstack([short[i].centres, x])
    moving = fits
    for _ in range(rounds):
        if not moving:
            break
        found, still = _passed(rows, names, moving), []
        for fit, sums in zip(moving, found, strict=True):
            new = np.where(sums[:, :1] > 0, sums[:, 2:] / np.maximum(sums[:, :1], 1), fit.centres)
            if (((new - fit.centres) ** 2).sum(axis=1) > tolerance**2).any():
                still.append(fit)
            fit.centres = new
        moving = still
    for fit, sums in zip(fits, _passed(rows, names, fits), strict=True):
        fit.cost, fit.sizes = float(sums[:, 1].sum()), tuple(int(n) for n in sums[:, 0])
    return fits


def labelled(rows: DataFrame, names: list[str], fits: dict[str, Fit]) -> DataFrame:
    """The named columns with the place of the nearest centre of each fit, in a column of the fit's name."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [pa.array(at.astype(np.int32)) for at, _ in _nearest(list(fits.values()), _matrix(batch, names))]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *near], [*names, *fits])

    return rows.select(*names).mapInArrow(label, ", ".join([*(f"`{n}` double" for n in names), *(f"`{c}` int" for c in fits)]))


def agreements(rows: DataFrame, pairs: list[tuple[str, str]]) -> dict[tuple[str, str], float]:
    """The adjusted Rand index of each pair of label columns, as ``segmentation.adjusted_rand`` has it, in one pass for all."""
    if not pairs:
        return {}
    cells = F.array(*(F.struct(F.lit(i).alias("pair"), F.col(a).alias("a"), F.col(b).alias("b")) for i, (a, b) in enumerate(pairs)))
    counts: list[dict[tuple[int, int], int]] = [{} for _ in pairs]
    for pair, a, b, n in rows.select(F.inline(cells)).groupBy("pair", "a", "b").agg(F.count("*").alias("n")).collect():  # clusters squared for each pair
        counts[pair][a, b] = n
    out = {}
    for pair, found in zip(pairs, counts, strict=True):
        sides: tuple[dict[int, int], dict[int, int]] = ({}, {})
        for labels, n in found.items():
            for side, label in zip(sides, labels, strict=True):
                side[label] = side.get(label, 0) + n
        both, left, right, every = (sum(n * (n - 1) // 2 for n in ns) for ns in (found.values(), sides[0].values(), sides[1].values(), [sum(found.values())]))
        expected = left * right / every if every else 0.0
        most = (left + right) / 2
        out[pair] = round((both - expected) / (most - expected), 6) if every and most != expected else 1.0
    return out
