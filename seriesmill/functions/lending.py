"""What series lend to others that miss a value: a block of series against a block.

Every pair is compared, on every date that both have. Tiles of pairs are worked
through date by date, so memory follows the tile and the two blocks, not the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Series of a tile on either side, and dates at a time.
NEEDY, LENDERS, DATES = 128, 512, 256


class Points:
    """(row, date code, value) sorted by code."""

    def __init__(self, row: np.ndarray, at: np.ndarray, y: np.ndarray):
        order = np.argsort(at, kind="stable")
        self.row, self.at, self.y = row[order], at[order], y[order]

    def tile(self, first: int, n: int) -> Points:
        here = (self.row >= first) & (self.row < first + n)
        return Points(self.row[here] - first, self.at[here], self.y[here])

    def layers(self) -> list[Points]:
        """Points of a series at different dates; more than one layer only if a series has a date more than once."""
        order = np.lexsort((self.row, self.at))
        row, at = self.row[order], self.at[order]
        new = np.r_[True, (row[1:] != row[:-1]) | (at[1:] != at[:-1])][: len(row)]
        if new.all():
            return [self]
        start = np.flatnonzero(new)
        nth = np.arange(len(row)) - np.repeat(start, np.diff(np.r_[start, len(row)]))
        return [Points(row[nth == k], at[nth == k], self.y[order][nth == k]) for k in range(nth.max() + 1)]

    def among(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place among the sorted codes, value) of the points at these dates."""
        lo, hi = np.searchsorted(self.at, codes[0]), np.searchsorted(self.at, codes[-1], "right")
        at = self.at[lo:hi]
        k = np.searchsorted(codes, at)
        here = codes[k] == at
        return self.row[lo:hi][here], k[here], self.y[lo:hi][here]


def chunks(codes: np.ndarray) -> Iterator[np.ndarray]:
    return (codes[i : i + DATES] for i in range(0, len(codes), DATES))


def distances(g: list[Points], p: list[Points], shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """For each pair the sum of absolute differences on shared dates, and the number of these."""
    total, n, step = np.zeros(shape), np.zeros(shape), np.empty(shape)
    for a, b in ((a, b) for a in g for b in p):
        for codes in chunks(np.intersect1d(a.at, b.at)):
            left, right = np.full((len(codes), shape[0]), np.nan), np.full((len(codes), shape[1]), np.nan)
            for points, dense in ((a, left), (b, right)):
                row, k, y = points.among(codes)
                dense[k, row] = y
            has, lends = ~np.isnan(left), ~np.isnan(right)
            n += has.T.astype(float) @ lends.astype(float)
            few = (4 * has.sum(1) * lends.sum(1) < shape[0] * shape[1]) | (np.isinf(left).any(1) & np.isinf(right).any(1))
            for k in range(len(codes)):
                if few[k]:
                    r, c = np.flatnonzero(has[k]), np.flatnonzero(lends[k])
                    total[np.ix_(r, c)] += np.abs(left[k, r, None] - right[k, c])
                else:
                    np.subtract(left[k, :, None], right[k], out=step)
                    np.abs(step, out=step)
                    np.fmax(step, 0.0, out=step)  # a missing value adds nothing
                    np.add(total, step, out=total)
    return total, n


def weighted(weight: np.ndarray, pairs: np.ndarray, what: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Sums over the lenders of these pairs that have the date. An infinite or NaN weight or value reaches no other date or series."""
    if np.isfinite(weight).all() and np.isfinite(what).all():
        return weight @ what
    return np.array([np.where(pairs & t, weight * x, 0.0).sum(1) for x, t in zip(what.T, there.T, strict=True)]).T


def lend(g: Points, n_g: int, p: Points, n_p: int, cell_row: np.ndarray, cell_at: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each missing cell (needy row, date code) the lenders' weighted values, their weights, and values and number of those without a shared date; for each needy row the largest distance, -inf if there is none.

    own: for each needy row its row among the lenders or -1.
    """
    sums, largest = np.zeros((4, len(cell_row))), np.full(n_g, -np.inf)
    lenders = [(q, tile := p.tile(q, LENDERS), tile.layers()) for q in range(0, n_p, LENDERS)]
    for first in range(0, n_g, NEEDY):
        needy = g.tile(first, NEEDY).layers()
        cells = np.flatnonzero((cell_row >= first) & (cell_row < first + NEEDY))
        rows, wanted = cell_row[cells] - first, np.unique(cell_at[cells])
        for q, tile, layers in lenders:
            shape = min(NEEDY, n_g - first), min(LENDERS, n_p - q)
            total, n = distances(needy, layers, shape)
            far, other = n == 0, np.ones(shape, bool)
            mine = own[first : first + shape[0]] - q
            here = np.flatnonzero((mine >= 0) & (mine < shape[1]))
            other[here, mine[here]] = False
            near = ~far & other
            d = np.divide(total, n, out=np.full(shape, -np.inf), where=near)
            largest[first : first + shape[0]] = np.maximum(largest[first : first + shape[0]], d.max(1))
            w = np.divide(1.0, d + 1e-6, out=np.zeros(shape), where=near)
            far &= other
            for codes in chunks(wanted):
                row, k, y = tile.among(codes)
                place = row * len(codes) + k
                values, counts = (np.bincount(place, weights, shape[1] * len(codes)).reshape(shape[1], -1) for weights in (y, np.ones(len(y))))
                now = np.flatnonzero((cell_at[cells] >= codes[0]) & (cell_at[cells] <= codes[-1]))
                at = rows[now], np.searchsorted(codes, cell_at[cells[now]])
                for i, (weight, pairs, what) in enumerate(((w, near, values), (w, near, counts), (far.astype(float), far, values), (far.astype(float), far, counts))):
                    if i < 2 or far.any():
                        sums[i, cells[now]] += weighted(weight, pairs, what, counts > 0)[at]
    return sums, largest


def lend_blocks(left: pa.Table, right: pa.Table, keys: list[str], peers: list[str]) -> pa.Table:
    """A row for each missing cell of the left block (keys, have, missing): its keys and date and what the right block (peers, have) has for it."""
    have_g, missing, have_p = (t[c].combine_chunks() for t, c in ((left, "have"), (left, "missing"), (right, "have")))
    rows = [np.repeat(np.arange(len(x)), x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)) for x in (have_g, missing, have_p)]
    point_g, cell, point_p = have_g.flatten(), missing.flatten(), have_p.flatten()
    dates = pa.concat_arrays([point_g.field("at"), cell, point_p.field("at")])
    codes = dates.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    a, b, c = np.split(codes, [len(point_g), len(point_g) + len(cell)])
    y_g, y_p = (x.field("y").to_numpy(zero_copy_only=False) for x in (point_g, point_p))
    own = np.full(left.num_rows, -1)
    if left.num_rows and right.num_rows and left["block"][0].as_py() == right["block"][0].as_py():
        place = {k: i for i, k in enumerate(map(repr, zip(*(right[x].to_pylist() for x in peers), strict=True)))}
        own = np.array([place.get(k, -1) for k in map(repr, zip(*(left[x].to_pylist() for x in keys), strict=True))])
    with np.errstate(invalid="ignore"):  # infinite values
        sums, largest = lend(Points(rows[0], a, y_g), left.num_rows, Points(rows[2], c, y_p), right.num_rows, rows[1], b, own)
    most = largest[rows[1]]
    out = {x: left[x].take(pa.array(rows[1])) for x in keys} | {"__d": cell}
    out |= {x: pa.array(s) for x, s in zip(("wy", "w", "far_y", "far"), sums, strict=True)} | {"largest": pa.array(most, mask=most == -np.inf)}
    return pa.table(out)
