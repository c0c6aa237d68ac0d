"""Hard negatives by distributed radix selection.

Rows are vectors with a label; anchors are some of them. Components become floor(scale * x), scores are integer inner
products. Each anchor's positives are its first `positives` rows of the same label; for each the first `negatives` rows of
other labels are wanted whose score lies in a window below the positive's: low_percent of it, up to it. Higher scores come
first, ties by smaller id.

Anchors and rows are packed into blocks of bounded size, and a block of anchors meets each group of blocks of rows in one
task. Positives: a group sends its first few for each anchor. Negatives: in each round a group counts the scores of each
window in `radix` equal buckets; the counts, summed over the groups, tell the bucket that holds the last wanted score, which
is the next round's window, so a window is one score after the logarithm of its width to base `radix` many rounds. Then only
rows at or above that score are gathered; of rows tied at it, of which there may be any number, a group sends the first few.

Rows with a null id, label or vector, or with a component that is null or not finite, take no part. Of rows of one id the
least (by label, then vector) takes part. Vectors of different lengths meet in the components that both have. Scores beyond
64 bits are held at the ends of their range. A positive below zero has no window. Fewer rows than wanted: all. An empty
table gives an empty result. Only the three columns are read, so others and their names don't matter.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.llm.common import forget, written

BLOCK = 1024  #: anchors or rows of a block, on average
GROUP = 32  #: blocks of rows that a task takes at most, on average
LEAST_ROWS = 2048  #: rows of a task at least, unless there are fewer
CELLS = 1 << 21  #: scores of windows that are looked at together
END = (1 << 63) - 1
NONE = -END - 1  #: stands for a score that doesn't count


@dataclass(frozen=True)
class Rule:
    scale: int = 256
    positives: int = 5
    negatives: int = 5
    low_percent: int = 80
    radix: int = 256


def usable(rows: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """id, label, vector (array<double>) of the rows that take part, one for each id."""
    named = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    held = named.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()).where(~bad)
    return held.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row")).select("id", "row.*")


BLOCKS = "block long, ids binary, labels binary, kind string, width int, vectors binary"


def packed(rows: DataFrame, blocks: int, scale: int) -> DataFrame:
    """usable rows -> so many blocks of rows in order of ids, with vectors of whole numbers."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        vectors = [np.floor(scale * np.array(v, np.float64)) for v in table["vector"].to_pylist()]
        width = max(map(len, vectors))
        matrix = np.zeros((len(vectors), width))
        for row, v in zip(matrix, vectors):
            row[: len(v)] = v
        kind = "<i2" if not matrix.size or np.abs(matrix).max() < 1 << 15 else "<f8"
        columns = {"block": [key[0].as_py()], "ids": [table["id"].to_numpy().tobytes()], "labels": [table["label"].to_numpy().tobytes()], "kind": [kind], "width": [width], "vectors": [matrix.astype(kind).tobytes()]}
        return pa.table(columns, pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("labels", pa.binary()), ("kind", pa.string()), ("width", pa.int32()), ("vectors", pa.binary())]))

    return rows.withColumn("block", F.pmod(F.xxhash64("id", F.lit(blocks)), F.lit(blocks))).groupBy("block").applyInArrow(run, BLOCKS)


@dataclass
class Block:
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Block:
        ids, labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
        return cls(ids, labels, np.frombuffer(row["vectors"], row["kind"]).reshape(len(ids), row["width"]).astype(np.float64))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, held between -END and END."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = width * max(1.0, np.abs(a).max()) * max(1.0, np.abs(b).max())
    if most < 1 << 53:
        return (a @ b.T).astype(np.int64)
    if most < 1 << 62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object)
    return np.clip(whole(a) @ whole(b).T, -END, END).astype(np.int64)


def first_few(scores: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the `most` highest scores of each row but NONE; of equal ones the first columns."""
    if scores.shape[1] > most:
        least = np.partition(scores, -most, axis=1)[:, -most, None]
        rows, at = np.nonzero((scores >= least) & (scores > NONE))
    else:
        rows, at = np.nonzero(scores > NONE)
    order = np.lexsort((at, -scores[rows, at], rows))
    rows, at = rows[order], at[order]
    kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < most
    return rows[kept], at[kept]


def _merged(found: list[tuple], most: int) -> list[np.ndarray]:
    """Parts of (what it is for, id, score) -> the first few of each."""
    owner, ids, scores = (np.concatenate(x) for x in zip(*found)) if found else [np.empty(0, np.int64)] * 3
    order = np.lexsort((ids, -scores, owner))
    owner, ids, scores = owner[order], ids[order], scores[order]
    kept = np.arange(len(owner)) - np.searchsorted(owner, owner) < most
    return [owner[kept], ids[kept], scores[kept]]


def _met(anchors: pa.Table, rows: pa.Table) -> tuple[Block, dict, list[Block]]:
    one = anchors.to_pylist()
    return (Block.of(one[0]), one[0], [Block.of(r) for r in rows.to_pylist()]) if one else (None, {}, [])


def _positives(most: int, anchors: pa.Table, rows: pa.Table) -> pa.Table:
    mine, _, others = _met(anchors, rows)
    found = []
    for other in others:
        scores = products(mine.vectors, other.vectors)
        scores[(mine.labels[:, None] != other.labels) | (mine.ids[:, None] == other.ids)] = NONE
        owner, at = first_few(scores, most)
        found.append((owner, other.ids[at], scores[owner, at]))
    owner, ids, scores = _merged(found, most)
    return pa.table({"anchor_id": mine.ids[owner] if mine else owner, "positive_id": ids, "score": scores})


WINDOW = {"anchor_id": "long", "positive_id": "long", "low": "long", "high": "long"}


def _windows(mine: Block, row: dict) -> dict[str, np.ndarray]:
    """The block's windows, with the place of their anchor in it."""
    found = {c: np.array([w[c] for w in row["windows"] or []], np.int64) for c in WINDOW}
    return found | {"place": np.searchsorted(mine.ids, found["anchor_id"])}


def _in_windows(mine: Block, windows: dict[str, np.ndarray], other: Block):
    """Of a few windows at a time: their numbers, and their scores with the other block, NONE outside."""
    scores = products(mine.vectors, other.vectors)
    scores[mine.labels[:, None] == other.labels] = NONE
    step = max(1, CELLS // max(1, len(other.ids)))
    for at in range(0, len(windows["place"]), step):
        part = slice(at, at + step)
        held = scores[windows["place"][part]]
        yield np.arange(at, at + len(held)), np.where((held >= windows["low"][part, None]) & (held <= windows["high"][part, None]), held, NONE)


def _counted(radix: int, anchors: pa.Table, rows: pa.Table) -> pa.Table:
    mine, row, others = _met(anchors, rows)
    counts = np.zeros(0, np.int64)
    windows: dict = {}
    if mine:
        windows = _windows(mine, row)
        size = (windows["high"] - windows["low"]) // radix + 1
        counts = np.zeros(len(size) * radix, np.int64)
        for other in others:
            for number, scores in _in_windows(mine, windows, other):
                at, column = np.nonzero(scores > NONE)
                bucket = (scores[at, column] - windows["low"][number[at]]) // size[number[at]]
                counts += np.bincount(number[at] * radix + bucket, minlength=len(counts))
    full = np.flatnonzero(counts)
    none = np.empty(0, np.int64)
    return pa.table({c: windows[c][full // radix] if windows else none for c in ("anchor_id", "positive_id")} | {"bucket": full % radix, "n": counts[full]})


def _gathered(most: int, anchors: pa.Table, rows: pa.Table) -> pa.Table:
    mine, row, others = _met(anchors, rows)
    windows, found = _windows(mine, row) if mine else {}, []
    for other in others:
        for number, scores in _in_windows(mine, windows, other):
            owner, at = first_few(scores, most)
            found.append((number[owner], other.ids[at], scores[owner, at]))
    owner, ids, scores = _merged(found, most)
    none = np.empty(0, np.int64)
    return pa.table({c: windows[c][owner] if windows else none for c in ("anchor_id", "positive_id")} | {"negative_id": ids, "score": scores})


@dataclass
class Grid:
    """Blocks of anchors (block, ...) that meet groups of blocks of rows."""

    anchors: DataFrame
    rows: DataFrame
    anchor_blocks: int
    groups: int

    def each(self, anchors: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        number = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        left = anchors.withColumn("at", F.col("block")).withColumn("group", number(self.groups))
        right = self.rows.withColumn("group", F.pmod("block", F.lit(self.groups))).withColumn("at", number(self.anchor_blocks))
        return left.groupBy("at", "group").cogroup(right.groupBy("at", "group")).applyInArrow(run, schema)

    def with_windows(self, windows: DataFrame) -> DataFrame:
        """Blocks of anchors with their windows; blocks without any stay behind."""
        held = windows.withColumn("block", F.pmod(F.xxhash64(F.col("anchor_id"), F.lit(self.anchor_blocks)), F.lit(self.anchor_blocks)))
        return self.anchors.join(held.groupBy("block").agg(F.collect_list(F.struct(*WINDOW)).alias("windows")), "block")


def grid(rows: DataFrame, anchors: DataFrame, scale: int) -> Grid:
    spark = rows.sparkSession
    n, asking = rows.count(), anchors.count()
    blocks = -(-n // BLOCK)
    tasks = min(2 * spark.sparkContext.defaultParallelism, -(-n // LEAST_ROWS))
    anchor_blocks, groups = max(1, -(-asking // BLOCK)), max(1, -(-blocks // GROUP), tasks)
    return Grid(written(packed(anchors, anchor_blocks, scale), "anchor_blocks"), written(packed(rows, max(1, blocks), scale), "row_blocks"), anchor_blocks, groups)


def _ranked(found: DataFrame, keys: list[str], ident: str, most: int) -> DataFrame:
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), ident)))
    return ranked.where(F.col("rank") <= most)


def _narrowed(windows: DataFrame, counts: DataFrame, radix: int) -> DataFrame:
    """windows(anchor_id, positive_id, low, high, need) and counts of buckets -> the same, each the bucket that holds the
    last wanted score; where all scores of a window are wanted, its low end."""
    keys = ["anchor_id", "positive_id"]
    down = Window.partitionBy(*keys).orderBy(F.desc("bucket"))
    sums = counts.groupBy(*keys, "bucket").agg(F.sum("n").alias("n")).withColumn("above", F.sum("n").over(down) - F.col("n"))
    met = windows.join(sums, keys).where("above < need AND above + n >= need").select(*keys, "bucket", "above")
    size = F.expr(f"(high - low) div {radix} + 1")
    start = F.col("low") + F.col("bucket") * size
    some = F.col("bucket").isNotNull()
    return windows.join(met, keys, "left").select(
        *keys, "top", F.when(some, start).otherwise(F.col("low")).alias("low"), F.when(some, F.least("high", start + (size - 1))).otherwise(F.col("low")).alias("high"), (F.col("need") - F.coalesce("above", F.lit(0))).alias("need"),
    )


def mine(rows: DataFrame, is_anchor: Column, label: Column, rule: Rule = Rule(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. is_anchor: over `id`; label: over rows."""
    used = written(usable(rows, id_col, vector_col, label), "vectors")
    met = grid(used, used.where(is_anchor), rule.scale)
    few = "anchor_id long, positive_id long, score long"
    near = met.each(met.anchors, partial(_positives, rule.positives), few)
    positives = written(_ranked(near, ["anchor_id"], "positive_id", rule.positives).drop("rank"), "positives")
    away = 100 - rule.low_percent
    # away percent of the score, rounded down, without leaving 64 bits
    low = F.col("score") - F.expr(f"score div 100 * {away} + score % 100 * {away} div 100")
    now = written(positives.where("score >= 0").select("anchor_id", "positive_id", F.col("score").alias("top"), low.alias("low"), F.col("score").alias("high"), F.lit(rule.negatives).cast("long").alias("need")), "windows")
    while (now.agg(F.max(F.col("high") - F.col("low"))).first()[0] or 0) > 0:
        counts = met.each(met.with_windows(now), partial(_counted, rule.radix), "anchor_id long, positive_id long, bucket long, n long")
        last, now = now, written(_narrowed(now, counts, rule.radix), "windows")
        forget(last)
    wanted = now.select("anchor_id", "positive_id", "low", F.col("top").alias("high"))
    found = met.each(met.with_windows(wanted), partial(_gathered, rule.negatives), "anchor_id long, positive_id long, negative_id long, score long")
    ranked = _ranked(found, ["anchor_id", "positive_id"], "negative_id", rule.negatives)
    ranked = ranked.join(positives.withColumnRenamed("score", "positive_score"), ["anchor_id", "positive_id"])
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score"))
