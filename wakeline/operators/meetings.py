"""Pairs of rows that are near in time and space, met in memory by blocks of vessels.

The rows of two groups of vessels come to one task as a sorted stream. There
each vessel's rows look up the rows around them, and what they find is put in
order, counted once and folded into runs before it leaves. So nothing is
shuffled or spilled that grows with the number of pairs, and a task holds its
rows and one lot of pairs. Functions are pickled by value, so that executors
need no copy of the library.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Candidates that are looked at together, and rows that small blocks are gathered to.
LOT, GATHER = 2_000_000, 200_000
_BITS = 23


@dataclass(frozen=True)
class Nearness:
    """Distance in metres, metres in a degree, reach of a cell's surroundings in degrees, cells in distances."""

    metres: float
    per_degree: float
    reach: float
    cell: int


@dataclass(frozen=True)
class Runs:
    gap_s: float
    min_s: int
    min_count: int


OBSERVATIONS = "mmsi_a long, mmsi_b long, at_a long, at_b long, lat_a double, lon_a double, source_a string, lat_b double, lon_b double, metres double"
MET = "mmsi long, other_mmsi long, began long, ended long, lat double, lon double, observations long, seconds double, metres double, source string"


def _wide(y: np.ndarray, near: Nearness) -> np.ndarray:
    """Degrees of longitude that a reach takes at most in the band ``y``."""
    height = near.cell * near.reach
    shortest = np.minimum(np.cos(np.radians(y * height - near.reach)), np.cos(np.radians((y + 1) * height + near.reach)))
    return np.where(shortest > 0.01, near.reach / np.where(shortest > 0.01, shortest, 1.0), 360.0)


def _cell(task: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """One number for a cell of a task; far cells may share it, and their rows are told apart by distance."""
    mask = (1 << _BITS) - 1
    return (task << (2 * _BITS)) | ((y.astype(np.int64) & mask) << _BITS) | (x.astype(np.int64) & mask)


def _spread(begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place in ``begin`` and the number itself, of all numbers of the ranges."""
    of = np.repeat(np.arange(len(begin)), count)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + begin[of]


class _Block:
    """Rows of some tasks, ordered by task, vessel, time, place and source."""

    def __init__(self, table: pa.Table, near: Nearness):
        column = lambda name: table.column(name).to_numpy()
        first, second, own = column("first"), column("second"), column("own")
        self.mmsi, self.at, self.lat, self.lon, self.bucket = (column(c) for c in ("mmsi", "at", "lat", "lon", "bucket"))
        self.source, self.near = table.column("source").combine_chunks(), near
        begins = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]
        self.task = np.cumsum(begins) - 1
        self.alone = first == second
        self.vessel = np.cumsum(begins | np.r_[True, self.mmsi[1:] != self.mmsi[:-1]]) - 1
        # rows of a vessel and time have one rank of that; times are ranked among all rows
        moment = np.r_[True, (self.vessel[1:] != self.vessel[:-1]) | (self.at[1:] != self.at[:-1])]
        self.moment, self.repeated = np.cumsum(moment) - 1, not moment.all()
        self.times, self.time = np.unique(self.at, return_inverse=True)
        self.left, self.right = np.flatnonzero(own == first), np.flatnonzero(own == second)
        self._index()

    def _index(self) -> None:
        near, rows = self.near, self.right
        y = np.floor(self.lat / (near.cell * near.reach))
        x = np.floor(self.lon / (near.cell * _wide(y, near)))
        cell = _cell(self.task, y, x)[rows]
        self.cells, dense = np.unique(cell, return_inverse=True)
        self.since, self.span = self.bucket.min() - 1, int(self.bucket.max() - self.bucket.min()) + 3
        if len(self.cells) * self.span >= 1 << 62:
            raise OverflowError("cells times buckets pass 62 bits")
        key = dense * self.span + (self.bucket[rows] - self.since)
        order = np.argsort(key, kind="stable")
        self.key, self.held = key[order], rows[order]

    def ranges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For rows of the left side and each cell that their surroundings touch: row, first place among the held, number."""
        near, rows, found = self.near, self.left, []
        lat, lon, height = self.lat[rows], self.lon[rows], near.cell * near.reach
        low, high = np.floor((lat - near.reach) / height), np.floor((lat + near.reach) / height)
        for y, fits in ((low, np.ones(len(rows), bool)), (high, high != low)):
            wide = _wide(y, near)
            west, east = np.floor((lon - wide) / (near.cell * wide)), np.floor((lon + wide) / (near.cell * wide))
            for x, also in ((west, fits), (east, fits & (east != west))):
                cell = _cell(self.task[rows], y, x)
                at = np.minimum(np.searchsorted(self.cells, cell), len(self.cells) - 1)
                held = np.flatnonzero(also & (self.cells[at] == cell))
                key = at[held] * self.span + (self.bucket[rows[held]] - self.since)
                begin, end = np.searchsorted(self.key, key - 1), np.searchsorted(self.key, key + 1, "right")
                found.append((rows[held], begin, end - begin))
        row, begin, count = (np.concatenate(x) for x in zip(*found, strict=True))
        some = np.flatnonzero(count)
        some = some[np.argsort(row[some], kind="stable")]
        return row[some], begin[some], count[some]

    def lots(self) -> Iterator[tuple[np.ndarray, ...]]:
        """Near rows a and b and their distance, all of a vessel of the left side and one of the right in the same lot."""
        if not len(self.held):
            return
        row, begin, count = self.ranges()
        total, at = np.cumsum(count), 0
        ends = np.flatnonzero(np.r_[self.vessel[row[1:]] != self.vessel[row[:-1]], True]) + 1 if len(row) else []
        while at < len(row):
            limit = (total[at - 1] if at else 0) + LOT
            fit = np.searchsorted(total[ends - 1], limit, "right")
            end = ends[max(fit - 1, np.searchsorted(ends, at, "right"))]
            # a vessel of more candidates than a lot meets parts of the others, one after another
            parts = -(-int(count[at:end].sum()) // LOT)
            for part in range(parts):
                yield self._near(row[at:end], begin[at:end], count[at:end], parts, part)
            at = end

    def _near(self, row: np.ndarray, begin: np.ndarray, count: np.ndarray, parts: int, part: int) -> tuple[np.ndarray, ...]:
        total, at, kept = np.cumsum(count), 0, []
        while at < len(row):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + LOT, "right")))
            of, place = _spread(begin[at:end], count[at:end])
            one, other = row[at:end][of], self.held[place]
            # within one group both orders are met, between two groups one
            fits = ~self.alone[one] | (self.mmsi[one] < self.mmsi[other])
            if parts > 1:
                fits &= self.mmsi[other] % parts == part
            one, other = one[fits], other[fits]
            swap = self.mmsi[one] > self.mmsi[other]
            a, b = np.where(swap, other, one), np.where(swap, one, other)
            near, lat_a, lat_b = self.near, self.lat[a], self.lat[b]
            north = (lat_a - lat_b) * near.per_degree
            east = (self.lon[a] - self.lon[b]) * near.per_degree * np.cos(np.radians((lat_a + lat_b) / 2))
            metres = np.sqrt(north * north + east * east)
            close = metres <= near.metres
            kept.append((a[close], b[close], metres[close]))
            at = end
        return tuple(np.concatenate(x) for x in zip(*kept, strict=True))

    def ordered(self, a: np.ndarray, b: np.ndarray, metres: np.ndarray) -> tuple[np.ndarray, ...]:
        """Pairs by vessels and time, one for each two moments: the first by position.  Last, where a pair of vessels begins."""
        vessels, times, moments = int(self.vessel[-1]) + 1, len(self.times), int(self.moment[-1]) + 1
        first = int(self.vessel[a].min())
        pair = (self.vessel[a] - first) * vessels + self.vessel[b]
        if (int(self.vessel[a].max()) - first + 1) * vessels * times >= 1 << 62:
            pair = np.unique(pair, return_inverse=True)[1]
        time = pair * times + np.minimum(self.time[a], self.time[b])
        moment = self.moment[a] * moments + self.moment[b]
        if self.repeated:
            order = np.lexsort((b, a, moment, time))
            once = np.r_[True, (moment[order][1:] != moment[order][:-1]) | (time[order][1:] != time[order][:-1])]
            order = order[once]
        else:
            order = np.lexsort((moment, time))
        pair = pair[order]
        return a[order], b[order], metres[order], np.r_[True, pair[1:] != pair[:-1]]

    def sources(self, rows: np.ndarray) -> pa.Array:
        return self.source.take(pa.array(rows))

    def observations(self, a, b, metres, _) -> list:
        return [self.mmsi[a], self.mmsi[b], self.at[a], self.at[b], self.lat[a], self.lon[a], self.sources(a), self.lat[b], self.lon[b], metres]

    def met(self, a, b, metres, begins, runs: Runs) -> list:
        time = np.minimum(self.at[a], self.at[b])
        begins = begins | np.r_[True, np.diff(time) / 1e6 > runs.gap_s]
        start = np.flatnonzero(begins)
        end = np.r_[start[1:], len(a)]
        count, seconds = end - start, np.floor((time[end - 1] - time[start]) / 1e6)
        total = lambda values: np.add.reduceat(values, start)
        lat, lon, mean = (total(v) / count for v in ((self.lat[a] + self.lat[b]) / 2, (self.lon[a] + self.lon[b]) / 2, metres))
        ended = np.maximum.reduceat(np.maximum(self.at[a], self.at[b]), start)
        k = np.flatnonzero((seconds >= runs.min_s) & (count >= runs.min_count))
        own = start[k]
        return [self.mmsi[a[own]], self.mmsi[b[own]], time[own], ended[k], lat[k], lon[k], count[k], seconds[k], mean[k], self.sources(a[own])]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches in order of (first, second) as tables of whole tasks, of ``GATHER`` rows or one task at least."""
    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held.append(table)
        if sum(t.num_rows for t in held) < GATHER:
            continue
        first, second = (np.asarray(table.column(c)) for c in ("first", "second"))
        before = held[-2] if len(held) > 1 else None
        changes = np.flatnonzero((first[1:] != first[:-1]) | (second[1:] != second[:-1])) + 1
        if len(changes):
            cut = int(changes[-1])
        elif before is not None and table.num_rows and (before["first"][-1].as_py(), before["second"][-1].as_py()) != (int(first[0]), int(second[0])):
            cut = 0
        else:
            continue
        yield pa.concat_tables([*held[:-1], table.slice(0, cut)])
        held = [table.slice(cut)]
    if sum(t.num_rows for t in held):
        yield pa.concat_tables(held)


def meet(near: Nearness, runs: Runs | None, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted rows to observations of pairs, or to their runs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(b for b in batches if b.num_rows):
            block = _Block(table, near)
            for a, b, metres in block.lots():
                if not len(a):
                    continue
                found = block.ordered(a, b, metres)
                made = block.met(*found, runs) if runs else block.observations(*found)
                out = pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in made], names)
                for i in range(0, out.num_rows, 100_000):
                    yield out.slice(i, 100_000)

    return work
