"""SimHash near-deduplication by multi-index hashing.

Fingerprints (64 bits, from 4-word shingles) link when at most 4 bits differ, and components of links are groups.
Equal fingerprints are one node. A fingerprint is cut into segments; by the pigeonhole principle two that link differ
by no more than a small radius in at least one segment, so enumerating that Hamming ball around each segment's value
and looking the values up among the exact ones of the same segment finds every link; full distances verify it. Of the
two that differ in a segment, only the one with 0 at the lowest differing bit asks, so each pair is met once.

A segment value that more than DENSE fingerprints share would give all pairs of them. All fingerprints that hold or
ask for such a value are linked another way, exact too: two fingerprints differ in at most 4 bits just when their
balls of radius 2 share a point, and a point is shared by 2,081 fingerprints at most. Each point links its
fingerprints to the smallest of them.

Wide fingerprints and their tables, for links by similarity, are used by near_copies.

Null and empty texts, and texts of white space, have the fingerprint zero and are linked like any other. Texts of
fewer than four words have one shingle. Repeated rows keep a row each. An empty table gives an empty result. Only id
and text are read, so other columns and their names don't matter. Texts are hashed whole, in blocks.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from pulseframe.llm.common import HOT_ROWS, forget, lookup, written
from pulseframe.llm.words import mix

SHINGLE, SEED, BITS, LINK = 4, 42, 64, 4
BLOCK = 1 << 15  #: shingles, times lanes, whose bits are counted at once
DENSE = 128  #: fingerprints with one segment value, above which pairs are not enumerated
#: (bits, radius) of the segments; the radii and the number of segments less one sum to LINK, so no link is missed.
LAYOUT = ((22, 1), (22, 1), (20, 0))
#: For more fingerprints than LAYOUT_LIMIT, wider segments: about 280 probes each, but next to no chance matches.
LAYOUT_LIMIT, WIDE_LAYOUT = 1 << 26, ((32, 2), (32, 1))
#: Of wide fingerprints.
SIMILAR = 0.8
LANES = 4  #: hashes of 64 bits in a wide fingerprint
RECALL = 0.98  #: of pairs just at SIMILAR, by the angle between sets of equal size; closer ones are met more often
SPARE_BITS = 2  #: key bits beyond those that number the documents
NEIGHBOURS = 3
WAVE = 32  #: tables whose keys are on disk at once
ROWS = 255  #: bits of so many rows add up in one byte


def _shingles(text: str | None, size: int = SHINGLE) -> list[int]:
    """The hashes of all runs of so many words, or of all words if there are fewer."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and the six ASCII white-space characters
    n = len(words) - size + 1
    if not words:
        return []
    if n < 1:
        return [xxh64_intdigest(b" ".join(words), SEED)]
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    return [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist())]


def fingerprint(text: str | None) -> int:
    hashes = _shingles(text, SHINGLE)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), BLOCK):
        block = np.array(hashes[at : at + BLOCK], ">u8")
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = counts * 2 > len(hashes)
    return int.from_bytes(np.packbits(bits).tobytes(), "big", signed=True)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = pa.array([fingerprint(x.as_py()) for x in batch.column(1)], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def ball(bits: range, radius: int) -> list[int]:
    """Masks of 0 to radius set bits within bits."""
    masks = level = [0]
    for _ in range(radius):
        level = [m | 1 << b for m in level for b in bits if m >> b == 0]
        masks = masks + level
    return masks


def _segments(layout: tuple) -> list[tuple[int, list[int]]]:
    """Of each segment: its mask, and the masks of its ball."""
    assert sum(r for _, r in layout) + len(layout) - 1 == LINK and sum(w for w, _ in layout) == BITS
    out, low = [], 0
    for width, radius in layout:
        out.append((((1 << width) - 1) << low, ball(range(low, low + width), radius)))
        low += width
    return out


def _flips(masks: list[int]) -> Column:
    """array of (mask, its lowest bit)"""
    rows = [{"mask": _signed(m), "low": _signed(m & -m)} for m in masks]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<mask: bigint, low: bigint>>")


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _keys(nodes: DataFrame, layout: tuple) -> tuple[DataFrame, DataFrame]:
    """Entries (seg, key, fp) and probes (seg, key, fp)."""
    fp = F.col("fp")

    def entry(seg: int, mask: int) -> Column:
        return F.struct(F.lit(seg).alias("seg"), fp.bitwiseAND(F.lit(_signed(mask))).alias("key"))

    def asked(seg: int, mask: int, masks: list[int]) -> Column:
        # the lowest bit of a flip: of a pair, the one that has 0 there asks
        mine = F.filter(_flips(masks), lambda f: fp.bitwiseAND(f["low"]) == 0)
        own = fp.bitwiseAND(F.lit(_signed(mask)))
        return F.transform(mine, lambda f: F.struct(F.lit(seg).alias("seg"), own.bitwiseXOR(f["mask"]).alias("key")))

    segments = list(enumerate(_segments(layout)))
    entries = nodes.select("fp", F.explode(F.array(*[entry(n, mask) for n, (mask, _) in segments])).alias("at")).select("at.*", "fp")
    probes = nodes.select("fp", F.explode(F.concat(*[asked(n, *x) for n, x in segments])).alias("at")).select("at.*", "fp")
    return entries, probes


def links(nodes: DataFrame, layout: tuple = LAYOUT, dense: int = DENSE) -> DataFrame:
    """nodes(fp), each once -> (a, b) with a > b: enough links that components are those of all links."""
    entries, probes = _keys(nodes, layout)
    crowded = written(entries.groupBy("seg", "key").agg(F.count("*").alias("n")).where(F.col("n") > dense).select("seg", "key"), "crowded")
    found = []
    rest = entries
    if not crowded.isEmpty():
        held = entries.join(crowded, ["seg", "key"], "left_semi").select("fp")
        asks = probes.join(crowded, ["seg", "key"], "left_semi").select("fp")
        close = written(held.union(asks).distinct(), "dense_fingerprints")
        points = close.select("fp", F.explode(_flips(ball(range(BITS), LINK // 2))).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip.mask")).alias("point"))
        met = points.groupBy("point").agg(F.min("fp").alias("b"), F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
        found.append(met.select(F.explode("fps").alias("a"), "b").where("a <> b").distinct())
        rest = entries.join(crowded, ["seg", "key"], "left_anti")
    asked = probes.select("seg", "key", F.col("fp").alias("a"))
    pairs = asked.join(rest.select("seg", "key", F.col("fp").alias("b")), ["seg", "key"]).where((F.col("a") != F.col("b")) & (distance(F.col("a"), F.col("b")) <= LINK))
    found.append(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    return reduce(DataFrame.union, found)


def _with_least(edges: DataFrame, total: int, hot: int) -> DataFrame:
    """edges(a, b) with m, the least b of a. A node of more than `hot` edges is no hot key."""
    if total <= hot:
        return edges.withColumn("m", F.min("b").over(Window.partitionBy("a")))
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("members"))
    return lookup(edges, written(least, "least"), "a", "members", total).drop("members")


def _each(rows: DataFrame, *edges: tuple[str, str]) -> DataFrame:
    """(a, b) by these columns, several of a row in one pass."""
    found = F.array(*[F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in edges])
    return rows.select(F.explode(found).alias("edge")).select("edge.*")


def components(edges: DataFrame, name: str = "components", hot: int = HOT_ROWS) -> DataFrame:
    """edges(a, b) -> (a, b) for each node a that isn't the smallest of its component b.

    Alternating large-star and small-star steps; every round is written, so a lost executor costs one round only, and
    the round before is removed. Up to `hot` edges a round is one short query of three shuffles: the driver keeps a thread
    and several plans for each shuffle and broadcast, so long plans of many rounds would cost it more than the edges do."""
    now, before = written(edges.where("a <> b").distinct(), name), None
    count = now.count()
    while count:
        both = _each(now, ("a", "b"), ("b", "a"))
        both = both if count <= hot else written(both, name)
        large = _with_least(both, 2 * count, hot).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        large = large if count <= hot else written(large.distinct(), name)  # repeated edges change no least one
        small = _with_least(large, count, hot)
        stars = _each(small, ("a", "m"), ("b", "m")).where("a <> b").distinct()
        last, now = now, written(stars, name)
        forget(last)
        count, *rest = now.agg(F.count("*"), F.expr("sum(xxhash64(a, b) % 1000000007)")).first()
        if (count, rest) == before:
            break
        before = count, rest
    return now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dense: int = DENSE) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint, component_id (smallest doc_id of the component)."""
    facts = written(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = written(facts.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("members")), "nodes")
    layout = LAYOUT if nodes.count() <= LAYOUT_LIMIT else WIDE_LAYOUT
    stars = components(links(nodes.select("fp"), layout, dense))
    rooted = nodes.join(stars.withColumnRenamed("a", "fp"), "fp", "left").select("fp", "first", "members", F.coalesce("b", "fp").alias("root"))
    # a root may stand for a large component: its smallest id is an aggregate, then joined to each fingerprint
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("fps"))
    named = written(lookup(rooted, written(ids, "roots"), "root", "fps", nodes.count()).select("fp", "component_id", "members"), "named")
    found = lookup(facts, named, "fp", "members", facts.count())
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def majorities(hashes: np.ndarray, lanes: int) -> bytes:
    """lanes x 64 bits of a set of shingles; where as many have a bit as don't, the least shingle decides."""
    counts = np.zeros(lanes * BITS, np.int64)
    if not len(hashes):
        return np.packbits(counts.astype(bool)).tobytes()
    steps = np.arange(lanes, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def bits(block: np.ndarray) -> np.ndarray:
        return np.unpackbits(mix(block[:, None] + steps).view(np.uint8).reshape(len(block), -1), axis=1)

    for at in range(0, len(hashes), ROWS):
        counts += bits(hashes[at : at + ROWS]).sum(axis=0, dtype=np.uint8)
    counts = 2 * counts - len(hashes)
    return np.packbits(np.where(counts == 0, bits(hashes[:1])[0] > 0, counts > 0)).tobytes()


def tables(n: int) -> np.ndarray:
    """For n documents: of each table, the bits of its key."""
    width = min(48, math.ceil(math.log2(max(n, 256))) + SPARE_BITS)
    agree = 1 - math.acos(2 * SIMILAR / (1 + SIMILAR)) / math.pi
    count = math.ceil(math.log(1 - RECALL) / math.log(1 - agree**width))
    rng = np.random.default_rng(5)
    return np.array([rng.choice(LANES * BITS, width, replace=False) for _ in range(count)])


def _table_keys(nodes: DataFrame, drawn: np.ndarray) -> DataFrame:
    """nodes(node, bits), each once -> key (of a table and its bits), node, fp (the first 64 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = 1 << np.arange(drawn.shape[1], dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                raw = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(part.num_rows, -1)
                bits = np.unpackbits(raw, axis=1).astype(np.int64)
                keys = np.stack([bits[:, t] @ powers * len(drawn) + k for k, t in enumerate(drawn)], axis=1)
                rows = np.repeat(np.arange(part.num_rows), len(drawn))
                first = np.ascontiguousarray(raw[:, :8]).view(np.int64).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), part.column(0).take(pa.array(rows)), pa.array(first[rows])], names=["key", "node", "fp"])

    return nodes.select("node", "bits").mapInArrow(run, "key long, node long, fp long")


def shared_keys(nodes: DataFrame, drawn: np.ndarray) -> DataFrame:
    """nodes(node, bits), each once -> node, others: of each key of the tables that several nodes have, each node with those
    among the first of the key and the NEIGHBOURS before it, and their distance in the first 64 bits."""
    held = _table_keys(nodes, drawn).withColumn("own", F.struct("node", "fp"))
    order = Window.partitionBy("key").orderBy("node")
    others = [F.first("own").over(order.rowsBetween(Window.unboundedPreceding, 0)), *[F.lag("own", k).over(order) for k in range(1, NEIGHBOURS + 1)]]
    met = held.select("node", "fp", F.filter(F.array(*others), lambda o: o["node"] < F.col("node")).alias("others")).where(F.size("others") > 0)
    return met.select("node", F.array_distinct(F.transform("others", lambda o: F.struct(distance(F.col("fp"), o["fp"]).alias("distance"), o["node"].alias("node")))).alias("others"))


def nearest(nodes: DataFrame, n: int) -> DataFrame:
    """nodes(node, bits), n of them, each once -> (a, b) with a > b: each node with the one nearest to it of its others in all
    keys; written. Keys are made for WAVE tables at a time, so their disk doesn't rise with the number of tables."""
    drawn, waves = tables(n), []
    best = F.min("best").alias("best")
    for at in range(0, len(drawn), WAVE):
        keys = shared_keys(nodes, drawn[at : at + WAVE]).select("node", F.array_min("others").alias("best"))
        waves.append(written(keys.groupBy("node").agg(best), "nearest_of_wave"))
    found = reduce(DataFrame.union, waves).groupBy("node").agg(best)
    pairs = written(found.select(F.col("node").alias("a"), F.col("best.node").alias("b")), "nearest")
    forget(*waves)
    return pairs
