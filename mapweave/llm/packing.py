"""Best-fit packing of tokenized documents into sequences, in bulk-synchronous rounds.

Map: each task encodes its documents, cuts those longer than a sequence (the first piece takes the remainder) and writes its pieces under numbers of their own in the shared folder.

Pieces are placed by falling length, a band of lengths at a time (`bands`); those of the first band, over half a sequence, open a sequence each. In a superstep the band's pieces and
the gaps (open sequences; one that could take several pieces of the band's mean length offers as many slots) are range-sorted together by falling size. Each task sweeps its range: a
gap waits on a stack, a piece takes its successor, the smallest gap that still waits. Pieces that find none in their range take, in order of their rank, the nearest gaps left in
earlier ranges (`carry`, over two counts a range). So no two pieces want one slot, as if one task had swept all. A gap's slots lie in one range; where the pieces at them are too long together,
those of the lowest ranks stay and the others go back. Then gaps shrink by what they got; a range sweeps its own pieces and gaps again at once, and the superstep over all ranges is repeated until
hardly a piece finds a gap; what is left opens sequences. When less than an eighth of a band is left, it goes on with the next band, ahead of its shorter pieces.

Defined results: null texts are empty and have one piece, the end id alone; very long texts are cut; repeated rows and ids are packed each;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import materialize, text_of

SEQUENCE, END_ID = 2048, 0
#: Pieces and slots that a range task sweeps on average.
RANGE_ROWS = 50_000
#: Bands of lengths of which a new sequence holds exactly k pieces, k up to this; below, lengths halve from band to band down to a SMALLEST-th of a sequence.
EXACT, SMALLEST = 4, 64
#: Sequences are opened when fewer than one in so many of the pieces left found a gap, or gaps are as few; in the band of the shortest pieces one in the square of that.
FEW = 8
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, pid long"


def cut(n: int, most: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than `most`."""
    first = n % most or most
    return [(0, min(first, n))] + [(s, most) for s in range(first, n, most)]


def pieces(docs: DataFrame, path: str | None = None, ranks: str | None = None, most: int = SEQUENCE, ids: bool = False) -> DataFrame:
    """The pieces as written in the shared folder; ids: their token ids too, as an array."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokens.shared(tokens.ByteBpe, path, ranks)
        pid, end = TaskContext.get().partitionId() << 40, np.array([END_ID], "<u4").tobytes()
        for b in batches:
            rows: list[list] = [[] for _ in range(6 + ids)]
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = np.frombuffer(bpe.encode(text), "<u2").astype("<u4").tobytes() + end
                for k, (s, n) in enumerate(cut(len(raw) // 4, most)):
                    own = raw[4 * s : 4 * (s + n)]
                    for to, v in zip(rows, (doc_id, k, s, n, zlib.crc32(own), pid, np.frombuffer(own, "<u4").astype(np.int32) if ids else None), strict=False):
                        to.append(v)
                    pid += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "pid", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, kinds, strict=False)], names[: 6 + ids])

    return materialize(docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(encode, PIECES + ", ids array<int>" * ids), "pieces")


def bands(most: int) -> list[tuple[int, int]]:
    """(lo, hi]: the lengths of each band, falling."""
    ends = [most // k for k in range(1, EXACT + 2)]
    while ends[-1] // 2 > most // SMALLEST:
        ends.append(ends[-1] // 2)
    return [(lo, hi) for hi, lo in zip(ends, [*ends[1:], 0], strict=True) if lo < hi]


def brackets(is_piece: np.ndarray) -> np.ndarray:
    """For rows by falling size, gaps before pieces: the row that each is matched with, -1 for none."""
    mate, stack = np.full(len(is_piece), -1), []
    for i, piece in enumerate(is_piece.tolist()):
        if not piece:
            stack.append(i)
        elif stack:
            j = stack.pop()
            mate[i], mate[j] = j, i
    return mate


def carry(counts: list[tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """counts: pieces and gaps left in each range, in order. Runs (r, i, q, j, n): pieces i .. i + n - 1 left in range r take gaps j, j - 1 .. left in range q."""
    stack: list[list[int]] = []
    runs = []
    for r, (left, gaps) in enumerate(counts):
        i = 0
        while i < left and stack:
            q, have = stack[-1]
            n = min(have, left - i)
            runs.append((r, i, q, have - 1, n))
            i, stack[-1][1] = i + n, have - n
            if have == n:
                stack.pop()
        if gaps:
            stack.append([r, gaps])
    return runs


#: What a row of a sweep's result is; place: a placed piece's offset, the room left in a slot's gap or in a gap.
PLACED, BACK, ALONE, SLOT, GAP = range(5)
SWEPT = "r int, what int, pid long, length long, seq long, place long, nth long"


def offered(room: np.ndarray, n: int, mean: int, lo: int, most: int) -> np.ndarray:
    """How many slots each gap offers to n pieces of that mean length: as many as could fit, or, where those are many, about two for each piece."""
    fit = np.where(room > lo, np.maximum(room // mean, 1), 0)
    usable = np.count_nonzero(fit)
    return fit if fit.sum() <= 2 * (n + usable) else np.minimum(fit, -(-2 * n // usable))


def _sweep(most: int, lo: int, hi: int, mean: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range. All slots of a gap are here, so pieces that meet at one are resolved here too, and the range is swept again with the rooms left while pieces find gaps."""
    t = pa.Table.from_batches([*batches]) if (batches := [*batches]) else None
    if t is None or not t.num_rows:
        return
    size, kind, a, slot, free = (t.column(c).to_numpy() for c in ("size", "kind", "a", "slot", "free"))
    is_gap = ((kind == 0) & (slot == 0)) | (kind == 2)
    order = np.argsort(a[is_gap], kind="stable")
    seq, room = a[is_gap][order], free[is_gap][order].astype(np.int64)
    pid, length = a[kind == 1], size[kind == 1].astype(np.int64)
    least = size[kind < 2].min() if (kind < 2).any() else most + 1
    at = np.searchsorted(seq, a[kind == 0])  # the gap of each slot
    placed = []
    while True:
        back = np.zeros(len(pid), bool)
        # slots, then pieces, by falling size: gaps before pieces, the rows' own order among equals
        key = np.r_[np.minimum(room[at], hi), length]
        by = np.lexsort((np.r_[seq[at], pid], -np.r_[room[at], np.zeros(len(pid), np.int64)], np.arange(len(key)) >= len(at), -key))
        found = brackets(by >= len(at))
        mate = np.full(len(key), -1)
        mate[by] = np.where(found >= 0, by[found], -1)
        own = mate[len(at) :]
        met = np.flatnonzero(own >= 0)
        if not len(met):
            break
        # of the pieces that met at a gap, those of the lowest ranks stay, as many as it holds
        g = at[own[met]]
        met = met[np.lexsort((pid[met], -length[met], g))]
        g = at[own[met]]
        end = np.cumsum(length[met])
        first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        end -= np.repeat(end[first] - length[met][first], np.diff(np.r_[first, len(met)]))
        stays = end <= room[g]
        took, to = met[stays], g[stays]
        placed.append((pid[took], length[took], seq[to], (most - room[to] + end[stays] - length[took])))
        room = room - np.bincount(to, length[took], len(room)).astype(np.int64)
        left = np.ones(len(pid), bool)
        left[took] = False
        back[met[~stays]] = True
        pid, length, back = pid[left], length[left], back[left]
        at = np.repeat(np.arange(len(seq)), offered(room, len(pid), mean, lo, most))
        if len(took) * FEW * FEW < len(pid):  # the rest waits for the next superstep
            break
    # slots that hold any piece of later ranges go on offer there
    rest = np.minimum(room[at], hi)
    idle = at[rest >= least]
    idle = idle[np.lexsort((seq[idle], -room[idle], -np.minimum(room[idle], hi)))]
    one = lambda n: np.full(n, -1)
    alone = np.flatnonzero(~back)
    alone = alone[np.lexsort((pid[alone], -length[alone]))]
    parts = [(PLACED, *(np.concatenate(x) for x in zip(*placed, strict=True)), one(sum(len(x[0]) for x in placed)))] if placed else []
    parts += [  # what, pid, length, seq, place, nth
        (BACK, pid[back], length[back], one(back.sum()), one(back.sum()), one(back.sum())),
        (ALONE, pid[alone], length[alone], one(len(alone)), one(len(alone)), np.arange(len(alone))),
        (SLOT, one(len(idle)), one(len(idle)), seq[idle], room[idle], np.arange(len(idle))),
        (GAP, one(len(seq)), one(len(seq)), seq, room, one(len(seq))),
    ]
    sizes = [len(x[1]) for x in parts]
    cols = [np.full(sum(sizes), TaskContext.get().partitionId(), np.int32), np.repeat(np.array([x[0] for x in parts], np.int32), sizes)]
    cols += [np.concatenate([x[i] for x in parts]).astype(np.int64) for i in range(1, 6)]
    yield from pa.Table.from_arrays([pa.array(x) for x in cols], ["r", "what", "pid", "length", "seq", "place", "nth"]).to_batches(100_000)


class _Left:
    """What the runs of `carry` say of the rows left: the number of the pair that a row belongs to, and the rank of pieces that have none."""

    def __init__(self, counts: list[tuple[int, int]]) -> None:
        runs = carry(counts)
        n = np.array([x[4] for x in runs], np.int64)
        base = np.cumsum(n) - n
        self.pairs = int(n.sum())
        by = lambda r, i: (np.array(r, np.int64) << 40) + np.array(i, np.int64)
        self.piece = (by([x[0] for x in runs], [x[1] for x in runs]), n, base)
        order = np.argsort(low := by([x[2] for x in runs], [x[3] - x[4] + 1 for x in runs]))
        self.gap = (low[order], n[order], base[order])
        taken = np.zeros(len(counts), np.int64)
        for r, *_, k in runs:
            taken[r] += k
        left = np.array([x[0] for x in counts], np.int64) - taken
        self.before, self.left = np.cumsum(left) - left - taken, int(left.sum())

    def pair(self, r: np.ndarray, nth: np.ndarray, gaps: bool) -> np.ndarray:
        low, n, base = self.gap if gaps else self.piece
        if not len(low):
            return np.full(len(r), -1)
        x = (r.astype(np.int64) << 40) + nth
        k = np.maximum(np.searchsorted(low, x, "right") - 1, 0)
        i = x - low[k]
        return np.where((i >= 0) & (i < n[k]), base[k] + (n[k] - 1 - i if gaps else i), -1)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r, nth = (b.column(c).to_numpy(zero_copy_only=False) for c in ("r", "nth"))
            gaps = b.column("what").to_numpy(zero_copy_only=False) == SLOT
            pair = np.where(gaps, self.pair(r, nth, True), self.pair(r, nth, False))
            rank = np.where(gaps | (pair >= 0), -1, self.before[r] + nth)
            out = pa.RecordBatch.from_arrays([*(b.column(c) for c in ("pid", "length", "seq", "place")), pa.array(pair), pa.array(rank)], ["pid", "length", "seq", "place", "pair", "rank"])
            yield out.filter(pa.array(~gaps | (pair >= 0)))  # slots that no piece takes say nothing


def _few(df: DataFrame, label: str, n: int) -> DataFrame:
    """Written by as many tasks as n rows need."""
    return materialize(df.coalesce(max(1, n // RANGE_ROWS)), label)


class _Step:
    """A superstep over one band: pieces placed, gaps after it, pieces left with and without a gap tried."""

    def __init__(self, todo: DataFrame, gaps: DataFrame, band: tuple[int, int], mean: int, each: int, ranges: int, most: int) -> None:
        lo, hi = band
        zero = F.lit(0).cast("long")
        many = F.greatest(F.least(F.expr(f"size div {mean}"), F.lit(each)), F.lit(1))
        usable = F.col("size") > lo
        slots = gaps.select(F.explode(F.sequence(zero, F.when(usable, many - 1).otherwise(zero))).alias("slot"), F.when(usable, F.least("size", F.lit(hi))).otherwise(F.col("size")).cast("long").alias("size"), F.when(usable, 0).otherwise(2).alias("kind"), F.col("seq").alias("a"), F.col("size").alias("free"))
        both = slots.unionByName(todo.select(F.col("length").alias("size"), F.lit(1).alias("kind"), F.col("pid").alias("a"), zero.alias("slot"), zero.alias("free")))
        order = [F.desc("size"), F.asc("kind"), F.desc("free"), F.asc("a")]  # without the slot: a gap's slots stay together
        dealt = both.repartitionByRange(ranges, *order).sortWithinPartitions(*order, "slot")
        swept = materialize(dealt.mapInArrow(lambda batches: _sweep(most, lo, hi, mean, batches), SWEPT), "swept")
        found: dict[tuple[int, int], tuple[int, int, int]] = {}  # five rows a range
        for r, what, n, length, least in swept.groupBy("r", "what").agg(F.count("*"), F.sum("length"), F.min("length")).collect():
            found[r, what] = (n, length, least)
        last = max((r for r, _ in found), default=-1)
        total = lambda what, i: sum(v[i] for (_, w), v in found.items() if w == what)
        self.got, self.got_tokens = total(PLACED, 0), total(PLACED, 1)
        self.rows = sum(v[0] for v in found.values())
        left = _Left([(found.get((r, ALONE), (0,))[0], found.get((r, SLOT), (0,))[0]) for r in range(last + 1)])
        self.placed = [swept.where(F.col("what") == PLACED).select("pid", F.col("seq").alias("sequence_id"), F.col("place").alias("offset"))]
        self.gaps = swept.where((F.col("what") == GAP) & (F.col("place") > 0)).select("seq", F.col("place").alias("size"))
        self.back = swept.where(F.col("what") == BACK).select("pid", "length")
        schema = "pid long, length long, seq long, place long, pair long, rank long"
        rows = swept.where(F.col("what") == ALONE).mapInArrow(left, schema)
        self.alone, self.n_alone = rows.where("rank >= 0").select("pid", "length", "rank"), left.left
        least = min((v[2] for (_, w), v in found.items() if w == ALONE), default=most)
        self.usable = swept.where((F.col("what") == GAP) & (F.col("place") >= least)).count() if left.left else 0  # gaps that another superstep could fill
        self.alone_tokens = total(ALONE, 1) * left.left // max(1, total(ALONE, 0))
        if left.pairs:  # these pieces are shorter than those that their gaps got in their own range, so they come after them
            free = swept.where(F.col("what") == SLOT).mapInArrow(left, schema).where("pair >= 0").select("seq", "place", "pair")
            end = F.sum("length").over(Window.partitionBy("seq").orderBy(F.desc("length"), "pid").rowsBetween(Window.unboundedPreceding, 0))
            met = _few(rows.where("pair >= 0").select("pid", "length", "pair").join(free, "pair").withColumn("end", end), "carried", left.pairs)
            stays = F.col("end") <= F.col("place")
            self.placed.append(met.where(stays).select("pid", F.col("seq").alias("sequence_id"), (most - F.col("place") + F.col("end") - F.col("length")).alias("offset")))
            n, length = met.where(stays).agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
            self.got, self.got_tokens = self.got + n, self.got_tokens + length
            self.back = self.back.unionByName(met.where(~stays).select("pid", "length"))
            taken = met.where(stays).groupBy("seq").agg(F.sum("length").alias("taken"))
            size = (F.col("size") - F.coalesce("taken", F.lit(0))).alias("size")
            self.gaps = _few(self.gaps.join(taken, "seq", "left").select("seq", size).where("size > 0"), "gaps", total(GAP, 0))


def places(found: DataFrame, most: int = SEQUENCE) -> DataFrame:
    """pid, sequence_id (the pid of a sequence's first piece) and offset of each piece (pid, length)."""
    spark = found.sparkSession
    all_pieces = found.select("pid", "length")
    have = {r[0]: r[1] for r in all_pieces.groupBy("length").count().collect()}  # at most `most` rows
    if any(n < 1 or n > most for n in have):
        raise ValueError(f"pieces have 1 to {most} tokens")
    gaps, n_gaps = spark.createDataFrame([], "seq long, size long"), 0
    placed, n, total, todo, top = [], 0, 0, None, 0
    for lo, hi in bands(most):
        own = all_pieces.where((F.col("length") > lo) & (F.col("length") <= hi))
        todo, top = (todo.unionByName(own), top) if n else (own, hi)
        n += sum(v for k, v in have.items() if lo < k <= hi)
        total += sum(k * v for k, v in have.items() if lo < k <= hi)
        start, shorter = n, any(k <= lo for k in have)
        if n and 2 * lo >= most - 1:
            placed.append(todo.select("pid", F.col("pid").alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
            gaps, n_gaps = todo.select(F.col("pid").alias("seq"), (most - F.col("length")).alias("size")).where("size > 0"), n
            n = total = 0
        fits = most // top if most // (lo + 1) == most // top else 0  # pieces of the band that a sequence holds, if that is one number
        while n and (n == start or n * FEW > start or not shorter):  # a few that are left go on with the next band
            mean = max(lo + 1, total // n)
            usable, offer = gaps.where(F.col("size") > lo).agg(F.count("*"), F.coalesce(F.sum(F.greatest(F.expr(f"size div {mean}"), F.lit(1))), F.lit(0))).first()
            each = most if offer <= 2 * (n + usable) else -(-2 * n // usable)  # else about two slots for each piece
            step = _Step(todo, gaps, (lo, top), mean, each, max(1, (n + n_gaps + min(offer, usable * each)) // RANGE_ROWS), most)
            placed += step.placed
            n, total = n - step.got, total - step.got_tokens
            gaps, alone, todo = step.gaps, step.alone, step.back
            if step.n_alone and (FEW if shorter else FEW * FEW) * min(step.got, step.usable) < step.n_alone:
                # by rank: so many in a row to a new sequence if it is known how many one holds, else the longest open one each
                row, new = max(fits, 1), -(-step.n_alone // fits) if fits else max(1, -(-step.alone_tokens // most))
                if fits > 1:
                    turn = Window.partitionBy(F.expr(f"rank div {row}")).orderBy("rank")
                    opened = alone.select("pid", "length", "rank", F.first("pid").over(turn).alias("seq"), F.sum("length").over(turn).alias("end"))
                else:
                    opened = alone.where(F.col("rank") < new).select("pid", "length", "rank", F.col("pid").alias("seq"), F.col("length").alias("end"))
                opened = _few(opened, "opened", step.n_alone if fits > 1 else step.rows)  # without a shuffle its tasks read the whole sweep
                placed.append(opened.select("pid", F.col("seq").alias("sequence_id"), (F.col("end") - F.col("length")).alias("offset")))
                got, got_tokens = opened.agg(F.count("*"), F.sum("length")).first()
                n, total, n_gaps = n - got, total - got_tokens, n_gaps + new
                final = (F.col("rank") % row == row - 1) | (F.col("rank") == step.n_alone - 1)
                gaps = gaps.unionByName(opened.where(final).select("seq", (most - F.col("end")).alias("size")).where("size > 0"))
                alone = alone.where(F.col("rank") >= row * new)
            if n:
                todo = todo.unionByName(alone.select("pid", "length"))
    if not placed:
        return all_pieces.select("pid", F.col("pid").alias("sequence_id"), F.col("pid").alias("offset"))
    out = placed[0]
    for part in placed[1:]:
        out = out.unionByName(part)
    return out


def pack(found: DataFrame, most: int = SEQUENCE) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces."""
    return found.join(places(found, most), "pid").select(*[found[f"`{c}`"] for c in found.columns if c != "pid"], "sequence_id", "offset")
