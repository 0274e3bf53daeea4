"""Heights along walls, as vectors over the bins of whole walls: where a wall usually starts, its doorways, medians over the bins around, the nearest bin that has both ends.

Spark deals the bins by wall and sorts them; a task reads its walls in order, several at once, and holds no more than a batch and one wall's bins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: So many bins have the values around them laid out at once.
BLOCK = 1 << 14


def _whole_walls(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches as tables of whole walls, and the number of each row's wall."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = pa.Table.from_batches([batch])
        number = _numbers(new)
        begins = int(np.searchsorted(number, number[-1]))
        goes_on = held and held[-1]["wall"][-1].as_py() == new["wall"][0].as_py()
        if begins or (held and not goes_on):
            done = pa.concat_tables([*held, new.slice(0, begins)])
            yield done, _numbers(done)
            held = []
        held.append(new.slice(begins))
    if held:
        done = pa.concat_tables(held)
        yield done, _numbers(done)


def _numbers(rows: pa.Table) -> np.ndarray:
    wall = rows["wall"].combine_chunks().dictionary_encode("encode")
    code = (wall.combine_chunks() if isinstance(wall, pa.ChunkedArray) else wall).indices.to_numpy(zero_copy_only=False)
    return np.cumsum(np.r_[0, code[1:] != code[:-1]])


def _values(rows: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers (0 where null) and whether they are known."""
    c = rows[name].combine_chunks()
    return c.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), c.is_valid().to_numpy(zero_copy_only=False)


def _at_share(value: np.ndarray, known: np.ndarray, group: np.ndarray, groups: int, part: int) -> tuple[np.ndarray, np.ndarray]:
    """Per group sorted[n div part] of its known values, and n."""
    value, group = value[known], group[known]
    n = np.bincount(group, minlength=groups)
    order = np.lexsort((value, group))
    if not len(order):
        return np.zeros(groups, np.int64), n
    return value[order][np.minimum(np.cumsum(n) - n + n // part, len(order) - 1)], n


def _median_around(rows: np.ndarray, value: np.ndarray, known: np.ndarray, bin_: np.ndarray, wall: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """For `rows` the upper median of the known values of the wall's bins up to `reach` away, and whether there is one."""
    out, has = np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
    for begin in range(0, len(rows), BLOCK):
        r = rows[begin : begin + BLOCK, None]
        near = r + np.arange(-reach, reach + 1)
        inside = np.clip(near, 0, len(value) - 1)
        ok = (near == inside) & known[inside] & (wall[inside] == wall[r]) & (np.abs(bin_[inside] - bin_[r]) <= reach)
        n = ok.sum(1)
        v = np.sort(np.where(ok, value[inside], np.iinfo(np.int64).max), 1)
        out[begin : begin + BLOCK], has[begin : begin + BLOCK] = v[np.arange(len(v)), np.minimum(n // 2, 2 * reach)], n > 0
    return out, has


def _profile(rows: pa.Table, wall: np.ndarray, voxel: float, least: float, high: float) -> list[pa.Array]:
    """Columns first, last, bottom, top for sorted bins of whole walls."""
    bin_ = rows["bin"].to_numpy().astype(np.int64)
    (bottom, floor), (low, held), (top, up) = (_values(rows, c) for c in ("bottom", "low", "high"))
    at, walls = np.arange(len(wall)), int(wall[-1]) + 1
    begin = np.searchsorted(wall, np.arange(walls))[wall]
    end = np.searchsorted(wall, np.arange(walls), "right")[wall]
    # doorways: runs of open bins that have others on both sides
    usual, n = _at_share(low, floor & held, wall, walls, 4)
    start = np.where(n[wall] > 0, np.maximum(usual[wall], bottom), bottom)
    is_open = ~floor | ~held | (low - start > math.floor(high / voxel + 0.5))
    follows = np.r_[False, is_open[:-1] & (wall[1:] == wall[:-1]) & (bin_[1:] == bin_[:-1] + 1)]
    firsts = np.flatnonzero(is_open & ~follows)
    lasts = np.flatnonzero(is_open & ~np.r_[is_open[1:] & follows[1:], False])
    wide = np.round((bin_[lasts] - bin_[firsts] + 1) * voxel, 9) >= least
    doors = wide & (bin_[firsts] > 0) & (bin_[lasts] < bin_[end[lasts] - 1])
    run = np.cumsum(is_open & ~follows) - 1
    in_door = is_open & doors[run] if len(doors) else is_open
    header, n = _at_share(low, in_door & floor & held, run, len(firsts), 2)
    # own ends, then the nearest bin's that has both
    reach = math.floor(0.4 / voxel + 0.5)
    tops, some_top = _median_around(at, top, floor & up, bin_, wall, reach)
    bare = np.flatnonzero(~floor)
    bottoms, some_bottom = bottom.copy(), floor.copy()
    bottoms[bare], some_bottom[bare] = _median_around(bare, bottom, floor, bin_, wall, reach)
    door = np.flatnonzero(in_door)
    bottoms[door], some_bottom[door] = header[run[door]], n[run[door]] > 0
    own = some_top & some_bottom
    before = np.maximum.accumulate(np.where(own, at, -1))
    after = np.minimum.accumulate(np.where(own, at, len(at))[::-1])[::-1]
    has_before, has_after = before >= begin, after < end
    lower = has_before & (~has_after | (bin_ - bin_[before] <= bin_[np.minimum(after, len(at) - 1)] - bin_))
    use = np.where(lower, before, np.minimum(after, len(at) - 1))
    none, outside = ~(has_before | has_after), ~in_door
    of_run = lambda ends: bin_[ends][run] if len(ends) else bin_
    return [pa.array(v, pa.int64(), mask=m) for v, m in ((of_run(firsts), outside), (of_run(lasts), outside), (bottoms[use], none), (tops[use], none))]


def profiles(stretches: DataFrame, voxel: float, least: float, high: float) -> DataFrame:
    """wall, bin and, or null, first and last bin of the doorway it is in, bottom and top of the slab (see `walls.doorways`, `walls.extents`). stretches: wall, bin, bottom, low, high."""
    rows = stretches.select("wall", "bin", *[stretches[c].cast("long").alias(c) for c in ("bottom", "low", "high")]).repartition("wall").sortWithinPartitions("wall", "bin")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, wall in _whole_walls(batches):
            found = _profile(part, wall, voxel, least, high)
            yield from pa.table([part["wall"], part["bin"], *found], ["wall", "bin", "first", "last", "bottom", "top"]).combine_chunks().to_batches()

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, f"wall {kinds['wall']}, bin {kinds['bin']}, first long, last long, bottom long, top long")
