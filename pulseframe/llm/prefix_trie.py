"""The trie of conversations' prefixes.

Turns are dealt into blocks of a conversation's order, and in each block a numpy scan makes the polynomial rolling
fingerprint of every prefix: sums of hash * BASE ** depth in two prime fields, which the sums of earlier blocks complete.
Prefixes of one depth and fingerprint are candidates of one node, with the smallest conversation as representative. Turn by
turn, by SHA-256 of role and text, members are compared with it. Fingerprints are sums, so if the last turns are equal and
the fingerprints too, the prefixes before have equal fingerprints, and comparing one turn at each depth is enough. Where
members differ, the candidates are split by their turn, and what follows in these conversations carries the splits along.

A node is known by its representative and depth; of a conversation, the nodes it represents are those from some depth on
to its end. So what a subtree sums to is the sum over the conversations in it of what their own nodes have, below the top:
it takes running sums along conversations and one grouping, however deep the trie.

Turns are ordered by turn (null first), ties by their digest. Null roles and texts count as empty. Rows without a
conversation's id take no part. A repeated turn counts as often as it comes. Empty tables have no node, not even a root.
Only four columns are read. Texts are read whole, once, for their digest and words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.llm.common import forget, lookup, word_count, written

BLOCK = 4096  #: turns of one conversation in a task
JOINED = 1 << 14  #: ids joined into one text of a digest
PRIMES = (2147483629, 2147483587)  #: below 2 ** 31, so two factors fit 63 bits and the pair of sums a long
BASES = (1103515245, 1566083941)
KEY = ["depth", "key", "splits"]


@dataclass(frozen=True)
class Fingerprint:
    primes: tuple[int, int] = PRIMES
    bases: tuple[int, int] = BASES


def digested(rows: DataFrame) -> DataFrame:
    """conversations -> conv_id, turn, digest of role and text, words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    # the length of the role keeps role and text apart
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    return rows.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), word_count(text).alias("words"))


def numbered(rows: DataFrame) -> DataFrame:
    """digested -> conv_id, place (from 0 in its conversation), digest, words; written.

    Ranges of the order are the blocks, so a conversation of any length, or many turns of one number, is dealt out."""
    order = ["conv_id", "turn", "digest"]
    ranged = written(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    w = Window.partitionBy("conv_id", "part").orderBy("turn", "digest")
    sizes = ranged.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    later = sizes.withColumn("before", before).where("before IS NOT NULL").drop("n")
    met = ranged.withColumn("place", F.row_number().over(w) - 1).join(later, ["conv_id", "part"], "left")
    out = written(met.select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("place"), "digest", "words"), "numbered")
    forget(ranged)
    return out


def spliced(turns: DataFrame, family: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """numbered -> conv_id, depth (from 1), digest, words of rebuilt conversations, and conv_id, n (their turns). Each
    conversation c's first h turns give way to those of c - c % family; h is crc32 of c modulo heads."""
    head = lambda c: F.crc32(c.cast("string").cast("binary")) % heads
    sizes = written(turns.groupBy("conv_id").agg(F.count("*").alias("own")), "sizes")
    firsts = turns.where(f"place < {heads - 1}").withColumnRenamed("conv_id", "base")
    asked = sizes.select("conv_id", "own", head(F.col("conv_id")).alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    have = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("base_turns"))
    lengths = written(asked.join(have, "base", "left").select("conv_id", "own", "h", "base", F.least("h", F.coalesce("base_turns", F.lit(0))).alias("given")), "lengths")
    given = lengths.where("given > 0").select("conv_id", "base", "given").join(firsts, "base").where("place < given")
    given = given.select("conv_id", (F.col("place") + 1).alias("depth"), "digest", "words")
    # h again by its formula, and the few conversations whose base gives less than h turns by name
    fewer = lengths.where("given < h").select("conv_id", (F.col("h") - F.col("given")).alias("missing"), "own")
    rest = turns.where(F.col("place") >= head(F.col("conv_id")))
    total = turns.count()
    short = lookup(rest, written(fewer, "fewer"), "conv_id", "own", total).select("conv_id", (F.col("place") + 1 - F.col("missing")).alias("depth"), "digest", "words")
    most = max(1000, total // 1000)
    kept = rest.join(F.broadcast(fewer.where(F.col("own") > most).select("conv_id")), "conv_id", "left_anti").join(fewer.where(F.col("own") <= most).select("conv_id"), "conv_id", "left_anti")
    own = kept.select("conv_id", (F.col("place") + 1).alias("depth"), "digest", "words")
    n = lengths.select("conv_id", (F.col("given") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n"))
    return given.unionByName(short).unionByName(own), n


def _scan(finger: Fingerprint):
    """Over rows (conv_id, block, depth, digest, words) in this order -> with sums of the block up to and before each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry = None, [0, 0]
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, block, depth = (batch.column(k).to_numpy() for k in range(3))
            raw = np.frombuffer(b"".join(batch.column(3).to_pylist()), ">u4").reshape(len(conv), -1)
            starts = np.flatnonzero(np.concatenate(([last != (conv[0], block[0])], (conv[1:] != conv[:-1]) | (block[1:] != block[:-1]))))
            group = np.zeros(len(conv), np.int64)
            group[starts] = 1
            group = np.cumsum(group)  # 0: goes on from the batch before
            out = []
            for lane, (prime, base) in enumerate(zip(finger.primes, finger.bases)):
                values = raw[:, lane].astype(np.int64) % prime * _powers(depth, base, prime) % prime
                sums = np.cumsum(values)
                offsets = np.concatenate(([-carry[lane]], (sums - values)[starts]))
                upto = (sums - offsets[group]) % prime
                carry[lane] = int(upto[-1])
                out += [upto, (upto - values) % prime]
            last = (conv[-1], block[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, out)], names=[*batch.schema.names, "f0", "p0", "f1", "p1"])

    return run


def _powers(exponents: np.ndarray, base: int, prime: int) -> np.ndarray:
    out, square, left = np.ones(len(exponents), np.int64), base % prime, exponents.astype(np.int64)
    while left.any():
        out = np.where(left & 1, out * square % prime, out)
        square, left = square * square % prime, left >> 1
    return out


def fingerprinted(turns: DataFrame, finger: Fingerprint) -> DataFrame:
    """spliced -> conv_id, depth, digest, words, key and before (fingerprints of the prefix with and without its last turn)."""
    dealt = turns.withColumn("block", F.expr(f"depth div {BLOCK}")).repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "depth")
    schema = "conv_id long, block long, depth long, digest binary, words long, f0 long, p0 long, f1 long, p1 long"
    local = written(dealt.select("conv_id", "block", F.col("depth").cast("long").alias("depth"), "digest", "words").mapInArrow(_scan(finger), schema), "scanned")
    ends = local.groupBy("conv_id", "block").agg(*[F.max_by(f, "depth").alias(f) for f in ("f0", "f1")])
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("conv_id", "block", *[(F.sum(f"f{k}").over(earlier) % p).alias(f"c{k}") for k, p in enumerate(finger.primes)]).where("c0 IS NOT NULL")
    met = local.join(carried, ["conv_id", "block"], "left")
    full = lambda k, kind: (F.col(f"{kind}{k}") + F.coalesce(f"c{k}", F.lit(0))) % finger.primes[k]
    key = lambda kind: full(0, kind) * (1 << 31) + full(1, kind)
    return met.select("conv_id", "depth", "digest", "words", key("f").alias("key"), key("p").alias("before"))


def _split(rows: DataFrame) -> DataFrame:
    """fingerprinted -> the same with splits and splits_before: the marks of candidates that had to be split, up to the row
    and before it; empty for almost all."""
    differing = rows.groupBy("depth", "key").agg(F.min("digest").alias("low"), F.max("digest").alias("high"), F.count("*").alias("members")).where("low <> high").select(F.struct("depth", "key").alias("at"), "members")
    differing = written(differing, "differing")
    if differing.isEmpty():
        return rows.withColumns({"splits": F.lit(""), "splits_before": F.lit("")})
    marked = lookup(rows.withColumn("at", F.struct("depth", "key")), differing, "at", "members", rows.count())
    marks = marked.select("conv_id", "depth", F.concat(F.col("depth").cast("string"), F.lit(":"), F.hex("digest")).alias("mark"))
    held = marks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("depth", "mark"))).alias("marks"))
    met = rows.join(held, "conv_id", "left")
    upto = lambda depth: F.coalesce(F.array_join(F.transform(F.filter("marks", lambda m: m["depth"] <= depth), lambda m: m["mark"]), ","), F.lit(""))
    return met.withColumns({"splits": upto(F.col("depth")), "splits_before": upto(F.col("depth") - 1)}).drop("marks")


def _packed(most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at, conv_id) in order -> (at, first, joined): ids of one node joined by commas, up to `most` in one text."""
    for batch in batches:
        at, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        starts = [k for k in range(len(at)) if not k or at[k] != at[k - 1]] + [len(at)]
        cuts = [(a, min(a + most, b)) for x, b in zip(starts, starts[1:]) for a in range(x, b, most)]
        yield pa.RecordBatch.from_arrays([pa.array([at[a] for a, _ in cuts], batch.schema.field(0).type), pa.array([ids[a] for a, _ in cuts], pa.int64()), pa.array([",".join(map(str, ids[a:b])) for a, b in cuts], pa.string())], names=["at", "first", "joined"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at, first, joined) in order -> (at, digest); a digest takes its texts one after the other."""
    now, digest = None, None
    for batch in batches:
        kind, done = batch.schema.field(0).type, []
        for at, joined in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if digest is None or at != now:
                if digest is not None:
                    done.append((now, digest.hexdigest()))
                now, digest = at, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(joined.encode())
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in done], kind), pa.array([d for _, d in done], pa.string())], names=["at", "ends_sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([digest.hexdigest()], pa.string())], names=["at", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """ends(depth, key, splits, conv_id) -> depth, key, splits, ends_sha256. Ids of one node are joined where they lie in
    ranges of the order, so the task that hashes them in turn reads long texts, not rows."""
    at = "struct<depth: bigint, key: bigint, splits: string>"
    rows = ends.select(F.struct(*KEY).alias("at"), "conv_id").repartitionByRange("at", "conv_id").sortWithinPartitions("at", "conv_id")
    joined = rows.mapInArrow(partial(_packed, JOINED), f"at {at}, first long, joined string")
    found = joined.repartition("at").sortWithinPartitions("at", "first").mapInArrow(_hashed, f"at {at}, ends_sha256 string")
    return found.select("at.*", "ends_sha256")


def trie(conversations: DataFrame, family: int = 20, heads: int = 4, finger: Fingerprint = Fingerprint()) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256."""
    turns, sizes = spliced(numbered(digested(conversations)), family, heads)
    sizes = written(sizes, "rebuilt_sizes")
    marked = _split(written(fingerprinted(turns, finger), "fingerprinted"))
    # the root, of which all conversations are members, is one row more of each
    root = sizes.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("key"), F.lit(None).cast("long").alias("before"), F.lit("").alias("splits"), F.lit(None).cast("string").alias("splits_before"))
    rows = written(marked.select(*root.columns).unionByName(root), "prefixes")
    found = rows.groupBy(*KEY).agg(F.min(F.struct("conv_id", "before", "splits_before")).alias("first"), F.count("*").alias("n_convs"), F.max("words").alias("words"))
    nodes = written(found.select(*KEY, "first.*", "n_convs", "words"), "nodes")

    parent = F.struct((F.col("depth") - 1).alias("depth"), F.col("before").alias("key"), F.col("splits_before").alias("splits"))
    children = written(nodes.where("depth > 0").groupBy(parent.alias("at")).agg(F.count("*").alias("n_children")), "children")
    with_children = nodes.join(children.select("at.*", "n_children"), KEY, "left").fillna(0, "n_children")
    own = ((F.col("n_convs") - 1) * F.col("words")).alias("own")
    nodes_ = written(with_children.select("*", own, (F.col("n_children") == 0).cast("long").alias("leaf")), "nodes_with_children")

    # along each conversation, what the nodes that it represents have from a depth on to its end
    block = F.expr(f"depth div {BLOCK}")
    inside = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth"))
    later = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocked = nodes_.withColumn("block", block)
    sums = blocked.groupBy("conv_id", "block").agg(F.sum("own").alias("s"), F.sum("leaf").alias("l"))
    beyond = sums.select("conv_id", "block", F.sum("s").over(later).alias("s"), F.sum("l").over(later).alias("l")).where("s IS NOT NULL")
    here = blocked.withColumns({"from_own": F.sum("own").over(inside), "from_leaf": F.sum("leaf").over(inside)}).join(beyond, ["conv_id", "block"], "left")
    here = here.withColumns({"from_own": F.col("from_own") + F.coalesce("s", F.lit(0)), "from_leaf": F.col("from_leaf") + F.coalesce("l", F.lit(0))}).drop("s", "l", "block")
    # other members of a node represent nodes below it only, so all that theirs have counts
    totals = nodes_.groupBy("conv_id").agg(F.sum("own").alias("all_own"), F.sum("leaf").alias("all_leaf"), F.min("depth").alias("since"))
    totals = written(totals.join(sizes, "conv_id").withColumn("prefixes", F.col("n") + 1).drop("n"), "totals")
    others = lookup(rows.select(*KEY, "conv_id"), totals, "conv_id", "prefixes", rows.count()).where("depth < since")
    below = others.groupBy(*KEY).agg(F.sum("all_own").alias("more_own"), F.sum("all_leaf").alias("more_leaf"))

    last = rows.join(sizes.withColumnRenamed("n", "depth"), ["conv_id", "depth"])
    digests = end_digests(last.select(*KEY, "conv_id"))
    full = written(here.join(below, KEY, "left").join(digests, KEY, "left").withColumn("parent", F.when(F.col("depth") > 0, parent)), "summed")
    named = written(nodes_.where("n_children > 0").select(F.struct(*KEY).alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children"), "parents")
    with_parent = lookup(full.where("depth > 0").drop("n_children").join(nodes_.select(*KEY, F.col("n_children").alias("children")), KEY), named, "parent", "n_children", nodes.count())
    top = full.where("depth = 0").withColumnsRenamed({"n_children": "children"}).withColumn("parent_conv_id", F.lit(None).cast("long"))
    none = hashlib.sha256().hexdigest()
    out = [
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("children").alias("n_children"), (F.col("from_leaf") + F.coalesce("more_leaf", F.lit(0))).alias("n_leaves"),
        (F.col("from_own") + F.coalesce("more_own", F.lit(0))).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    ]
    return with_parent.select(*out).unionByName(top.select(*out))
