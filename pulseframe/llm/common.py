"""Helpers shared by the text operators: written tables, word rules and a join that survives hot keys."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.sources.tables import forget, scratch_path
from pulseframe.sources.tables import settled as written

__all__ = ["forget", "scratch_path", "written"]

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
#: A key is hot when it holds more than this share of all rows, or more than HOT_ROWS of them: at most
#: 1 / HOT_SHARE + rows / HOT_ROWS keys are hot, and no task of the join of the others reads more than HOT_ROWS of a key.
HOT_SHARE, HOT_ROWS = 0.001, 1_000_000


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lookup(facts: DataFrame, dim: DataFrame, key: str, members: str, total: int) -> DataFrame:
    """Inner join of facts with dim (one row per key; its column `members` counts the facts of a key).

    Hot keys go through a broadcast, the others through a shuffle join. Both inputs should be written tables."""
    least = min(max(1000, int(total * HOT_SHARE)), HOT_ROWS)
    hot = F.broadcast(dim.where(F.col(members) > least))
    cold = facts.join(F.broadcast(dim.where(F.col(members) > least).select(key)), key, "left_anti")
    return facts.join(hot, key).unionByName(cold.join(dim.where(F.col(members) <= least), key))


def quoted(name: str) -> str:
    """A column's name as Spark takes it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ranked_sample(rows: DataFrame, id_col: str, most: int) -> DataFrame:
    """The `most` rows of least hash of their id: a sample that reruns agree on, in one top-k pass."""
    return rows.orderBy(F.xxhash64(F.col(id_col)), F.col(id_col)).limit(most)


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; -1 of a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % n, F.lit(-1).cast("long"))


def give_back() -> None:
    """Memory that this Python has freed goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hands batches on; at their end, freed memory is given back. Workers live on for other stages' tasks, and what one stage
    has left would count against the next."""
    yield from batches
    give_back()


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
