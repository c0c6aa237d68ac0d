"""Ordered operations that split a long series.

A window over a whole series puts the series into one task. Here rows are cut into blocks of their order (`block` must
rise with the order), windows run inside blocks, and one small row per block carries what passes from block to block.
Keys, blocks and order columns must not be null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16  #: rows of a block where the order is a dense index


def _window(keys: list[str], order: list[str | Column]):
    return Window.partitionBy(*keys, "_block").orderBy(*order)


def _before(window):
    return window.rowsBetween(Window.unboundedPreceding, -1)


def number_rows(df: DataFrame, keys: list[str], order: list[str], block: Column, name: str = "idx") -> DataFrame:
    """Adds the place of each row in its series, from 0."""
    df = df.withColumn("_block", block)
    sizes = df.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(_before(Window.partitionBy(*keys).orderBy("_block"))), F.lit(0))
    within = df.withColumn("_within", F.row_number().over(_window(keys, order)) - 1)
    met = within.join(sizes.withColumn("_earlier", earlier).drop("_n"), [*keys, "_block"])
    return met.withColumn(name, F.col("_within") + F.col("_earlier")).drop("_within", "_earlier", "_block")


def with_previous(df: DataFrame, keys: list[str], idx: str, values: dict[str, str], block: int = BLOCK) -> DataFrame:
    """Adds values of the row before (new name -> column), for series with a dense index: the last row of a block also
    goes to the next one."""
    rows = df.withColumn("_block", F.expr(f"{idx} div {block}")).withColumn("_halo", F.lit(False))
    halo = rows.where(f"{idx} % {block} = {block - 1}").withColumn("_block", F.col("_block") + 1).withColumn("_halo", F.lit(True))
    w = _window(keys, [idx])
    both = rows.unionByName(halo)
    return both.withColumns({new: F.lag(old).over(w) for new, old in values.items()}).where("NOT _halo").drop("_block", "_halo")


@dataclass(frozen=True)
class Carry:
    """What `carried` adds as `name`: the last non-null `value` (a struct) at or before each row; backward: the first at
    or after it; exclusive: the row itself doesn't count."""

    name: str
    value: str
    order: tuple[Column, ...]
    backward: bool = False
    exclusive: bool = False

    def local(self, keys: list[str]) -> Column:
        window = _window(keys, [c.desc() if self.backward else c.asc() for c in self.order])
        return F.last(self.value, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, -1 if self.exclusive else 0))

    def edge(self) -> Column:
        """Of a block: the value that the blocks behind it see."""
        at = F.when(F.col(self.value).isNotNull(), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(self.order)]))
        return (F.min_by if self.backward else F.max_by)(F.col(self.value), at)

    def passed(self, keys: list[str], edge: str) -> Column:
        across = Window.partitionBy(*keys).orderBy(F.col("_block").desc() if self.backward else F.col("_block"))
        return F.last(edge, ignorenulls=True).over(_before(across))


def carried(df: DataFrame, keys: list[str], block: Column, *asked: Carry) -> DataFrame:
    """df with what is asked; all of it in one pass over rows dealt out by keys and block."""
    df = df.withColumn("_block", block)
    edges = df.groupBy(*keys, "_block").agg(*[c.edge().alias(f"_edge_{c.name}") for c in asked])
    edges = edges.select(*keys, "_block", *[c.passed(keys, f"_edge_{c.name}").alias(f"_passed_{c.name}") for c in asked])
    met = df.withColumns({f"_local_{c.name}": c.local(keys) for c in asked}).join(edges, [*keys, "_block"])
    found = met.withColumns({c.name: F.coalesce(f"_local_{c.name}", f"_passed_{c.name}") for c in asked})
    return found.drop("_block", *[f"_{kind}_{c.name}" for c in asked for kind in ("local", "passed")])
