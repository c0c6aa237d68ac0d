"""Signal kernels over series of any length.

A series is cut into blocks of its order, one row each with an array of samples, and kernels run in numpy on a block. What
a block needs of others comes to it in one of three ways: a halo of their samples; a carry of small rows, one a block, such
as filter states or the nearest known value; or, where a peak's surroundings may reach anywhere, a stitch of summaries of
blocks. No task holds a series.

Series are named by key columns that aren't null; blocks number samples from 0 without gaps. Every block but the last has
`size` samples, the last up to twice as many, so that no block is a short rest.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.functions import dsp
from pulseframe.functions.values import is_finite
from pulseframe.operators.ordered import Carry, carried
from pulseframe.sources.tables import settled

BLOCK = 1 << 14
FADED = 1e-20  #: what a filter's state has faded to is no longer carried
PEAK_BLOCK = 1 << 20  #: samples whose peaks are thinned together
SEGMENTS = 512  #: parts between certain peaks that one group thins


def each(df: DataFrame, keep: list[str], take: list[str], run: Callable[..., tuple], out: dict[str, str]) -> DataFrame:
    """The kept columns of every row with what run makes of the taken ones: arrays come and go as numpy arrays."""
    types = dict(df.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keep), *(f"`{k}` {t}" for k, t in out.items())])

    def held(x: pa.Scalar):
        if not x.is_valid:
            return None
        return x.values.to_numpy(zero_copy_only=False) if isinstance(x, pa.ListScalar) and not pa.types.is_nested(x.values.type) else x.as_py()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(len(keep) + i) for i in range(len(take))]
            for row in range(batch.num_rows):
                found = run(*[held(c[row]) for c in columns])
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(row, 1) for i in range(len(keep))], *[_one(x, t) for x, t in zip(found, out.values())]], names=[*keep, *out])

    return df.select(*keep, *take).mapInArrow(go, schema)


_ARROW = {"double": pa.float64(), "long": pa.int64(), "int": pa.int32()}


def _one(value, kind: str) -> pa.Array:
    if kind.startswith("array<"):
        inner = _ARROW[kind[6:-1]]
        return pa.array([None if value is None else pa.array(value, inner)], pa.list_(inner)) if value is None else pa.ListArray.from_arrays(pa.array([0, len(value)], pa.int32()), pa.array(value, inner))
    return pa.array([value], _ARROW[kind])


def packed(signal: DataFrame, keys: list[str], size: int = BLOCK) -> DataFrame:
    """signal(keys, idx, value) -> keys, block, start (the first sample's number), x, n (samples of the series), last (its
    last block); written. Samples are numbered anew in the order of idx, which may have gaps where a filter took rows out:
    parts by idx are laid end to end and cut again at each `size` samples. Null values are NaN."""
    rows = signal.select(*keys, F.expr(f"idx div {size}").alias("part"), F.struct("idx", F.coalesce("value", F.lit(float("nan"))).alias("value")).alias("s"))
    parts = rows.groupBy(*keys, "part").agg(F.array_sort(F.collect_list("s")).alias("s")).select(*keys, "part", F.col("s.value").alias("x"))
    parts = settled(parts, "parts")
    counts = parts.select(*keys, "part", F.size("x").cast("long").alias("_n"))
    whole, before = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    places = counts.select(*keys, "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("at"), F.sum("_n").over(whole).alias("n"))
    met = parts.join(places, [*keys, "part"]).withColumns({"last": F.greatest(F.lit(0), F.expr(f"n div {size} - 1")), "end": F.col("at") + F.size("x")})
    sent = met.select("*", F.explode(F.sequence(F.least(F.expr(f"at div {size}"), "last"), F.least(F.expr(f"(end - 1) div {size}"), "last"))).alias("block"))
    low = F.greatest("at", F.col("block") * size)
    high = F.when(F.col("block") == F.col("last"), F.col("end")).otherwise(F.least("end", (F.col("block") + 1) * size))
    cut = F.struct(low.alias("low"), F.slice("x", (low - F.col("at") + 1).cast("int"), (high - low).cast("int")).alias("x"))
    blocks = sent.groupBy(*keys, "block").agg(F.flatten(F.array_sort(F.collect_list(cut))["x"]).alias("x"), F.max("n").alias("n"), F.max("last").alias("last"))
    return settled(blocks.select(*keys, "block", (F.col("block") * size).alias("start"), "x", "n", "last"), "blocks")


def with_halo(blocks: DataFrame, keys: list[str], column: str, before: Column | int, after: Column | int, size: int, keep: list[str] = ()) -> DataFrame:
    """Blocks whose array has up to so many samples more on either side: keys, block, start, n, last, `from` (number of the
    array's first sample), the array, and columns to keep."""
    before, after = (F.lit(x) if isinstance(x, int) else x for x in (before, after))
    end = F.col("start") + F.size(column)
    targets = F.sequence(F.greatest(F.lit(0), F.floor((F.col("start") - after) / size)).cast("long"), F.least(F.col("last"), F.floor((end - 1 + before) / size)).cast("long"))
    sent = blocks.withColumns({"_before": before, "_after": after}).select("*", F.explode(targets).alias("_to"))
    low = F.greatest(F.col("start"), F.col("_to") * size - F.col("_before"))
    high = F.least(end, F.when(F.col("_to") == F.col("last"), F.col("n")).otherwise((F.col("_to") + 1) * size + F.col("_after")))
    part = F.struct(low.alias("from"), F.slice(column, (low - F.col("start") + 1).cast("int"), F.greatest(F.lit(0), high - low).cast("int")).alias("x"))
    own = F.col("_to") == F.col("block")
    met = sent.groupBy(*keys, F.col("_to").alias("block")).agg(F.array_sort(F.collect_list(part)).alias("_parts"), *[F.max(F.when(own, F.col(c))).alias(c) for c in ("start", "n", "last", *keep)])
    parts = F.filter("_parts", lambda p: F.size(p["x"]) > 0)
    return met.select(*keys, "block", "start", "n", "last", F.get(parts, 0)["from"].alias("from"), F.flatten(parts["x"]).alias(column), *keep)


def filled(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Values that aren't finite, interpolated over the sample's number, constant beyond the first and last; series without
    a finite value have gone. Adds the block's sums: sx, and stx over numbers from the series' middle."""
    known = F.filter(F.transform("x", lambda v, i: F.struct((F.col("start") + i).alias("at"), v.alias("value"))), lambda s: is_finite(s["value"]))
    edges = blocks.select(*keys, "block", known.alias("k")).select(*keys, "block", F.get("k", 0).alias("first"), F.try_element_at("k", F.lit(-1)).alias("final"))
    w = Window.partitionBy(*keys).orderBy("block")
    edges = edges.withColumns({"left": F.last("final", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "right": F.first("first", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))})
    near = lambda s: F.when(F.col(s).isNotNull(), F.array(F.col(f"{s}.at").cast("double"), F.col(f"{s}.value")))
    met = blocks.join(edges.where("first IS NOT NULL OR left IS NOT NULL OR right IS NOT NULL").select(*keys, "block", near("left").alias("left"), near("right").alias("right")), [*keys, "block"])

    def run(start, n, x, left, right):
        at, good = np.arange(start, start + len(x), dtype=float), np.isfinite(x)
        places, values = at[good], x[good]
        for side, put in ((left, lambda a, v: np.concatenate(([v], a))), (right, lambda a, v: np.concatenate((a, [v])))):
            if side is not None:
                places, values = put(places, side[0]), put(values, side[1])
        clean = np.where(good, x, np.interp(at, places, values))
        t = at - (n - 1) / 2
        return clean, float(clean.sum()), float(t @ clean)

    return settled(each(met, [*keys, "block", "start", "n", "last"], ["start", "n", "x", "left", "right"], run, {"x": "array<double>", "sx": "double", "stx": "double"}), "filled")


def detrended(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """filled blocks less their series' least-squares line. Blocks' sums are added from the last to the first, so that the
    line is the same whatever order they come in."""
    n = F.col("n").cast("double")
    added = lambda c: F.aggregate(F.reverse("_sums"), F.lit(0.0), lambda s, b: s + b[c])
    lines = blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("block", "sx", "stx"))).alias("_sums"), F.max("n").alias("n"))
    lines = lines.select(*keys, "n", added("sx").alias("_sx"), added("stx").alias("_stx")).select(*keys, (F.col("_sx") / n).alias("_mean"), (F.col("_stx") / F.greatest(n * (n * n - 1) / 12, F.lit(1e-300))).alias("_slope"))
    middle = F.col("start") - (n - 1) / 2
    return blocks.join(lines, keys).select(*keys, "block", "start", "n", "last", F.transform("x", lambda v, i: v - F.col("_mean") - (middle + i) * F.col("_slope")).alias("x"))


class Filter:
    """A chain of sections (b0, b1, b2, a1, a2), each run by whole runs of STEP samples: outputs are a triangular matrix times the
    inputs plus what the state before the run adds, and states follow each other by one matrix."""

    STEP = 64

    def __init__(self, sections: tuple[tuple[float, ...], ...]):
        self.sections = sections
        self.poles = sum(2 if s[4] else 1 for s in sections)
        self.order = 2 * len(sections)
        self.pad = 3 * (self.poles + 1)
        self.parts = [self._matrices(*s) for s in sections]
        self.move = np.array([self.run(np.zeros(1), row)[1] for row in np.eye(self.order)]).T

    def _matrices(self, b0, b1, b2, a1, a2):
        move, push = np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0])
        powers = [np.eye(2)]
        for _ in range(self.STEP):
            powers.append(move @ powers[-1])
        pushed = np.array([p @ push for p in powers[:-1]])
        impulse = np.concatenate(([b0], pushed[:-1, 0]))
        lag = np.subtract.outer(np.arange(self.STEP), np.arange(self.STEP))
        seen = np.array([p[0] for p in powers[:-1]])
        return b0, move, push, powers[-1], np.where(lag >= 0, impulse[np.maximum(lag, 0)], 0.0), seen, pushed[::-1].T

    def steady(self, level: float) -> np.ndarray:
        """The state in the long run for a constant input."""
        out = []
        for b0, b1, b2, a1, a2 in self.sections:
            after = level * (b0 + b1 + b2) / (1 + a1 + a2)
            second = b2 * level - a2 * after
            out += [b1 * level - a1 * after + second, second]
            level = after
        return np.array(out)

    def after(self, samples: int) -> np.ndarray:
        """What becomes of a state in so many samples."""
        return np.linalg.matrix_power(self.move, samples)

    def reach(self) -> int:
        """Samples after which a state has faded."""
        radius = max(float(np.abs(np.roots([1.0, a1, a2])).max()) for *_, a1, a2 in self.sections)
        return math.ceil(math.log(FADED) / math.log(radius)) if 0 < radius < 1 else self.STEP

    def run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Outputs, and the state after."""
        ends = []
        for k, (b0, move, push, leap, triangle, seen, pushed) in enumerate(self.parts):
            own, runs = state[2 * k : 2 * k + 2], len(x) // self.STEP
            inputs = x[: runs * self.STEP].reshape(runs, self.STEP).T
            steps, states = pushed @ inputs, np.empty((2, runs))
            for r in range(runs):
                states[:, r] = own
                own = leap @ own + steps[:, r]
            out, rest = [(triangle @ inputs + seen @ states).T.ravel()], []
            for v in x[runs * self.STEP :].tolist():
                rest.append(b0 * v + own[0])
                own = move @ own + push * v
            x = np.concatenate((*out, rest))
            ends.append(own)
        return x, np.concatenate(ends)


def _entered(rows: DataFrame, keys: list[str], column: str, blocks: int, backward: bool) -> DataFrame:
    """keys, block, states: the column of so many blocks before (after, if backward), the nearest first, in one array."""
    w = Window.partitionBy(*keys).orderBy(F.col("block").desc() if backward else F.col("block"))
    near = F.reverse(F.collect_list(column).over(w.rowsBetween(-blocks, -1)))
    return rows.select(*keys, "block", F.flatten(near).alias("states"))


def zero_phase(blocks: DataFrame, keys: list[str], sections: tuple[tuple[float, ...], ...], size: int = BLOCK) -> DataFrame:
    """Blocks filtered by a chain of sections forwards and backwards, ends continued by odd reflection and started in the steady state; series that
    are too short for that stay as they are.

    The state before a block is a linear recurrence over blocks: what the block before ends with, started from nothing, plus
    the transition of a whole block times the same of those before it. As states fade, only a few blocks are asked."""
    filter_ = Filter(sections)
    pad, order, back = filter_.pad, filter_.order, -(-filter_.reach() // size)
    columns = [*keys, "block", "start", "n", "last"]
    blocks = blocks if hasattr(blocks, "_scratch") else settled(blocks.select(*columns, "x"), "unfiltered")  # read twice

    def opened(block, n, x):
        """The block's input with what lies before the first sample, and the state to start from, None if others give it."""
        if block:
            return x, None
        wide = np.concatenate((2 * x[0] - x[pad:0:-1], x))
        return wide, filter_.steady(wide[0])

    def state_of(states, given, samples):
        if given is not None:
            return given
        state, leap, total = np.zeros(order), filter_.after(size), np.eye(order)
        for row in np.asarray(states).reshape(-1, order) if states is not None else []:
            state, total = state + total @ row, total @ leap
        return state

    def ends(block, n, x):
        if n <= pad:
            return (np.zeros(order),)
        wide, state = opened(block, n, x)
        return (filter_.run(wide, np.zeros(order) if state is None else state)[1],)

    def closing(block, n, last, forward):
        """Backward: input and state, in falling order."""
        return forward[::-1], filter_.steady(forward[-1]) if block == last else None

    def forwards(block, n, last, x, states):
        if n <= pad:
            return x, np.zeros(order)
        wide, given = opened(block, n, x)
        if block == last:
            wide = np.concatenate((wide, 2 * x[-1] - x[-2 : -pad - 2 : -1]))
        y, _ = filter_.run(wide, state_of(states, given, size))
        y = y[pad:] if block == 0 else y
        turned, state = closing(block, n, last, y)
        return y, filter_.run(turned, np.zeros(order) if state is None else state)[1]

    def backwards(block, n, last, y, states):
        if n <= pad:
            return (y,)
        turned, given = closing(block, n, last, y)
        out, _ = filter_.run(turned, state_of(states, given, size))
        return ((out[pad:] if block == last else out)[::-1],)

    left = each(blocks, [*keys, "block"], ["block", "n", "x"], ends, {"state": "array<double>"})
    met = blocks.join(_entered(left, keys, "state", back, False), [*keys, "block"])
    ahead = settled(each(met, columns, ["block", "n", "last", "x", "states"], forwards, {"x": "array<double>", "state": "array<double>"}), "forwards")
    met = ahead.drop("state").join(_entered(ahead, keys, "state", back, True), [*keys, "block"])
    return settled(each(met, columns, ["block", "n", "last", "x", "states"], backwards, {"x": "array<double>"}), "filtered")


def samples(blocks: DataFrame, keys: list[str], column: str = "x") -> DataFrame:
    """Blocks -> keys, idx, value."""
    rows = blocks.select(*keys, "start", F.posexplode(column).alias("at", "value"))
    return rows.select(*keys, (F.col("start") + F.col("at")).alias("idx"), "value")


def _falling(x: np.ndarray, heights=(), lows=()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each sample the lowest from it back to, not with, the last higher one; and the heights that are still ahead of
    all after them, each with the lowest since the one before. heights, lows: those of what lies before x."""
    heights, lows, out = list(heights), list(lows), np.empty(len(x))
    for i, v in enumerate(x.tolist()):
        low = v
        while heights and heights[-1] <= v:
            heights.pop()
            low = min(low, lows.pop())
        heights.append(v)
        lows.append(low)
        out[i] = low
    return out, np.array(heights), np.array(lows)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and levels of runs of equal samples."""
    starts = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    return starts, np.append(starts[1:], len(x)) - 1, x[starts]


def _summary(start, x):
    starts, ends, level = _runs(x)
    inner = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
    _, up_h, up_l = _falling(x)
    _, down_h, down_l = _falling(x[::-1])
    border = np.array([level[0], ends[0] + start, level[min(1, len(level) - 1)], level[-1], starts[-1] + start, level[max(0, len(level) - 2)], len(level)], float)
    return start + (starts[inner] + ends[inner]) // 2, border, up_h, up_l, down_h, down_l


def _stitched(blocks: list[int], borders: np.ndarray, stacks: list[tuple[np.ndarray, np.ndarray]]):
    """In order of blocks: what of the heights before it each block overtakes."""
    heights, lows, out = [], [], []
    for own_h, own_l in stacks:
        seen_h, seen_l = [], []
        low = own_l[0]
        while heights and heights[-1] <= own_h[0]:
            seen_h.append(heights.pop())
            seen_l.append(lows.pop())
            low = min(low, seen_l[-1])
        out.append((seen_h[::-1], seen_l[::-1]))
        heights += own_h.tolist()
        lows += [low, *own_l[1:].tolist()]
    return out


def _border_peaks(borders: np.ndarray, starts: np.ndarray) -> list[int]:
    """Middles of maxima whose run touches a border of blocks. borders: of each block the first run's level and end, the
    level after it, the last run's level and start, the level before it, and the number of runs."""
    runs = []  # level, start, end, level before (None: another block's), level after
    for (first, first_end, second, final, final_start, before, count), start, end in zip(borders.tolist(), starts.tolist(), [*starts[1:].tolist(), None]):
        if count == 1:
            runs.append([first, start, first_end, None, None])
        else:
            runs += [[first, start, first_end, None, second], [final, final_start, None if end is None else end - 1, before, None]]
    peaks, at = [], 0
    while at < len(runs):
        stop = at
        while stop + 1 < len(runs) and runs[stop][4] is None and runs[stop + 1][3] is None and runs[stop + 1][0] == runs[at][0]:
            stop += 1
        level = runs[at][0]
        left = runs[at][3] if runs[at][3] is not None else (runs[at - 1][0] if at else None)
        right = runs[stop][4] if runs[stop][4] is not None else (runs[stop + 1][0] if stop + 1 < len(runs) else None)
        if left is not None and right is not None and left < level > right:
            peaks.append(int(runs[at][1] + runs[stop][2]) // 2)
        at = stop + 1
    return peaks


def maxima(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, idx, height, prominence of all local maxima: middles of plateaus lower on both sides, and how far they rise above
    the higher of the lowest samples on either side, up to a higher one or the end.

    Each block is summed up by its border runs and by the heights that nothing in it overtakes from either side; stitched in
    order, a row a block, these tell each block what its samples overtake outside."""
    names = {"peaks": "array<long>", "border": "array<double>", "up_h": "array<double>", "up_l": "array<double>", "down_h": "array<double>", "down_l": "array<double>"}
    summed = settled(each(blocks, [*keys, "block", "start"], ["start", "x"], _summary, names), "summaries")
    types = dict(blocks.dtypes)
    out = {"block": "bigint", "more": "array<bigint>", "left_h": "array<double>", "left_l": "array<double>", "right_h": "array<double>", "right_l": "array<double>"}

    def stitch(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        rows = table.to_pydict()
        arrays = lambda h, l: [(np.array(a), np.array(b)) for a, b in zip(rows[h], rows[l])]  # noqa: E731, E741
        borders, starts = np.array(rows["border"]), np.array(rows["start"])
        left = _stitched(rows["block"], borders, arrays("up_h", "up_l"))
        right = _stitched(rows["block"], borders, arrays("down_h", "down_l")[::-1])[::-1]
        more: list[list[int]] = [[] for _ in starts]
        for peak in _border_peaks(borders, starts):
            more[int(np.searchsorted(starts, peak, "right")) - 1].append(peak)
        found = {"block": rows["block"], "more": more, "left_h": [x[0] for x in left], "left_l": [x[1] for x in left], "right_h": [x[0] for x in right], "right_l": [x[1] for x in right]}
        lists = {"more": pa.list_(pa.int64())} | {c: pa.list_(pa.float64()) for c in ("left_h", "left_l", "right_h", "right_l")}
        return pa.table({k: [v.as_py()] * len(starts) for k, v in zip(keys, key)} | {c: pa.array(v, lists.get(c, pa.int64())) for c, v in found.items()})

    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), *(f"{c} {t}" for c, t in out.items())])
    stitched = summed.select(*keys, "block", "start", "border", "up_h", "up_l", "down_h", "down_l").groupBy(*keys).applyInArrow(stitch, schema)
    met = blocks.select(*keys, "block", "start", "x").join(summed.select(*keys, "block", "peaks"), [*keys, "block"]).join(stitched, [*keys, "block"])

    def measured(start, x, peaks, more, left_h, left_l, right_h, right_l):
        at = np.sort(np.concatenate((peaks, more)).astype(np.int64)) - start
        left = _falling(x, left_h, left_l)[0]
        right = _falling(x[::-1], right_h, right_l)[0][::-1]
        return at + start, x[at], x[at] - np.maximum(left[at], right[at])

    found = each(met, keys, ["start", "x", "peaks", "more", "left_h", "left_l", "right_h", "right_l"], measured, {"idx": "array<long>", "height": "array<double>", "prominence": "array<double>"})
    return settled(found.select(*keys, F.explode(F.arrays_zip("idx", "height", "prominence")).alias("p")).select(*keys, "p.*"), "maxima")


def thinned(peaks: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """maxima -> those that stay if from the highest down, of equal ones the last first, each drops those nearer than gap.

    A peak that is first among those nearer than gap stays for certain and drops them; nothing passes beyond it, so what is
    left between two such peaks is thinned on its own, many parts in a group."""
    block = F.expr(f"idx div {PEAK_BLOCK}")
    own = peaks.withColumns({"block": block, "halo": F.lit(False)})
    halos = [own.where(F.pmod("idx", F.lit(PEAK_BLOCK)) < gap).withColumns({"block": F.col("block") - 1, "halo": F.lit(True)}), own.where(F.pmod("idx", F.lit(PEAK_BLOCK)) >= PEAK_BLOCK - gap).withColumns({"block": F.col("block") + 1, "halo": F.lit(True)})]
    rank = F.struct("height", "idx")
    near = Window.partitionBy(*keys, "block").orderBy("idx").rangeBetween(-(gap - 1), gap - 1)
    both = own.unionByName(halos[0]).unionByName(halos[1]).withColumn("certain", F.max(rank).over(near) == rank)
    marked = both.where("NOT halo").drop("halo").withColumn("sure", F.when(F.col("certain"), F.struct("idx")))
    order = (F.col("idx"),)
    met = settled(carried(marked.drop("block"), keys, block, Carry("before", "sure", order), Carry("behind", "sure", order, backward=True)), "marked")
    far = F.coalesce(F.col("idx") - F.col("before.idx") >= gap, F.lit(True)) & F.coalesce(F.col("behind.idx") - F.col("idx") >= gap, F.lit(True))
    rest = met.where(~F.col("certain") & far).withColumn("part", F.coalesce("before.idx", F.lit(-1).cast("long")))
    columns = [*keys, "idx", "height", "prominence"]
    types = dict(peaks.dtypes)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("idx", "ascending")])
        part, idx, height = (table[c].to_numpy() for c in ("part", "idx", "height"))
        new = np.concatenate(([False], part[1:] != part[:-1])).cumsum()
        return table.select(columns).filter(pa.array(dsp.thinned(idx + new * gap, height, gap)))

    grouped = rest.withColumn("group", F.pmod(F.xxhash64("part"), F.lit(SEGMENTS))).select(*columns, "part", "group").groupBy(*keys, "group")
    left = grouped.applyInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in columns))
    return met.where("certain").select(*columns).unionByName(left)


def spectra(blocks: DataFrame, keys: list[str], rate: float, window: Column, points: Column, size: int, low: float, high: float) -> DataFrame:
    """keys, bin, freq, power: one-sided density by Welch's method at the frequencies from low to below high of a transform of
    `points` samples. window: samples of a Hann window, half over each other, each less its mean.

    Power sums over windows, from transforms of twice the window's length, give the sum of the windows' autocorrelations, and
    this gives the density at any frequency: so windows don't need transforms of the whole series' length."""
    hop = F.floor(window / 2).cast("long")
    wide = with_halo(blocks.withColumns({"_window": window.cast("long"), "_points": points.cast("long")}), keys, "x", 0, F.col("_window"), size, ["_window", "_points"])

    def powers(start, first, n, block, last, x, window):
        hop = window // 2
        hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(window) / window)
        stop = n if block == last else start + size
        begin = np.arange(-(-start // hop) * hop, stop, hop)
        begin = begin[begin + window <= n]
        total = np.zeros(window + 1)
        for at in range(0, len(begin), 64):
            parts = np.stack([x[b - first : b - first + window] for b in begin[at : at + 64]])
            parts = (parts - parts.mean(axis=1, keepdims=True)) * hann
            total += (np.abs(np.fft.rfft(parts, 2 * window, axis=1)) ** 2).sum(axis=0)
        return len(begin), total

    summed = each(wide, [*keys, "n", "_window", "_points"], ["start", "from", "n", "block", "last", "x", "_window"], powers, {"windows": "long", "total": "array<double>"})
    bins = summed.where("windows > 0").select(*keys, "_window", "_points", F.posexplode("total").alias("at", "power"), "windows")
    sums = bins.groupBy(*keys, "_window", "_points", "at").agg(F.sum("power").alias("power"), F.sum("windows").alias("windows"))
    whole = sums.groupBy(*keys, "_window", "_points").agg(F.array_sort(F.collect_list(F.struct("at", "power"))).alias("p"), F.max("windows").alias("windows")).select(*keys, "_window", "_points", F.col("p.power").alias("total"), "windows")
    first, stop = F.ceil(F.lit(low) * F.col("_points") / rate), F.least(F.ceil(F.lit(high) * F.col("_points") / rate), F.floor(F.col("_points") / 2) + 1)
    chunk = F.explode(F.sequence(F.floor(first / 4096), F.floor((stop - 1) / 4096)))
    chunks = whole.withColumns({"first": first.cast("long"), "stop": stop.cast("long")}).where("first < stop").select("*", chunk.alias("chunk"))

    def dense(window, points, total, windows, first, stop, chunk):
        lags = np.fft.irfft(total, 2 * window)[:window]
        bins = np.arange(max(first, chunk * 4096), min(stop, (chunk + 1) * 4096))
        hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(window) / window)
        weights = lags * np.where(np.arange(window) == 0, 1, 2)
        out = np.empty(len(bins))
        for at in range(0, len(bins), 256):
            turn = np.outer(bins[at : at + 256], np.arange(window)) % points
            out[at : at + 256] = np.cos(2 * np.pi * turn / points) @ weights
        out = out / windows / (rate * (hann @ hann))
        return bins, np.where((bins > 0) & (2 * bins != points), 2 * out, out)

    found = each(chunks.withColumn("points", F.col("_points")), [*keys, "points"], ["_window", "_points", "total", "windows", "first", "stop", "chunk"], dense, {"bin": "array<long>", "power": "array<double>"})
    rows = found.select(*keys, "points", F.explode(F.arrays_zip("bin", "power")).alias("p")).select(*keys, "points", "p.*")
    return settled(rows.select(*keys, "bin", (F.col("bin") * rate / F.col("points")).alias("freq"), "power"), "spectra")


def smoothed(x: np.ndarray, first: int, n: int, low: int, high: int, window: int, order: int) -> np.ndarray:
    """Samples low to high of a series of n smoothed by least-squares polynomials over centred windows; near its ends that of
    the first or last full window. x holds the series from `first` on, with a window around what is asked."""
    half = window // 2
    basis = np.vander(np.arange(-half, half + 1), order + 1, increasing=True).astype(float)
    fit = np.linalg.pinv(basis)
    out = np.empty(high - low)
    a, b = max(low, half), min(high, n - half)
    if a < b:
        out[a - low : b - low] = np.convolve(x[a - half - first : b + half - first], fit[0][::-1], "valid")
    if low < half:
        stop = min(high, half)
        out[: stop - low] = (basis @ (fit @ x[-first : window - first]))[low:stop]
    if high > n - half:
        begin = max(low, n - half)
        out[begin - low :] = (basis @ (fit @ x[n - window - first : n - first]))[window - (n - begin) : window - (n - high)]
    return out
