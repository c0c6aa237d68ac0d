"""Exact similarity join of texts by the Jaccard similarity of their sets of word n-grams (shingles).

Texts of one set are one node. Of a set of s shingles a similar one lacks at most lost(s), so with shingles in one global
order the first lost(s) + 1 of both (the prefixes) share one, and prefixes that are longer by k share k + 1. Three steps:

1. Prefixes in the order of hashes, extended by `extra` shingles: a node goes on only if at least extra + 1 of its own
   stand in prefixes of others (extra of the smallest partner). Nodes without a near copy end here; only counts meet.
2. All shingles of the nodes left are counted, and the order is now by frequency, rare ones first; those of one node only
   count as lost at once. Rare shingles of a prefix are signatures of their own. Frequent ones are dealt into buckets and
   every k of a bucket are one signature: a prefix is extended until two that are similar must share k of one class in one
   bucket. Buckets go by the power of two of the set's size; sets near a border are in the layouts of both sides.
3. Nodes with a signature in common meet, unless what precedes the signature, or what they can't share at all, already
   makes them too different. First each node meets the head of the signatures it shares most; of the other pairs only those
   of two components do, in blocks, so groups of copies give no square of pairs. All pairs are verified on whole sets.

No link between different sets is lost at any size: thresholds of frequency only choose between forms of signatures.
Words are runs of anything but six white-space characters, A-Z in lower case; fewer words than n are one shingle. Null and
empty texts and those of white space have no set and link with nothing. Rows with equal texts, and null or repeated ids,
keep a row each. An empty table gives an empty result. Only id and text are read, so other columns don't matter. Texts
are cut whole. Shingles are told apart by hashes of 64 bits.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from pulseframe.llm.common import forget, lookup, released, written
from pulseframe.llm.simhash import components
from pulseframe.llm.words import columns, grams

#: Shingles of more nodes than this are frequent, and k of them make a signature: (nodes, k), the last that fits.
CLASSES = ((0, 1), (64, 2), (4096, 3))
SINGLE_LEVEL = 3  #: sets of fewer than 2 to this have signatures of one shingle only
BROADCAST_NODES = 1 << 22  #: nodes that are left up to which their ids (8 bytes each) go to the texts, not the texts to them
SLICE = 256  #: rows of a batch that a task works on at once
SIDE = 1000  #: members of a signature on one side of a block


@dataclass(frozen=True)
class Rule:
    """Sets of shingles of so many words link when den * |both| >= num * |either|."""

    words: int = 3
    num: int = 90
    den: int = 100
    classes: tuple = CLASSES

    def __post_init__(self) -> None:
        assert 10 * self.num >= 7 * self.den and self.classes[0] == (0, 1)  # below 0.7 small sets may lack k of a bucket

    def least(self, s):
        """The size of the smallest set similar to one of s."""
        return -(-self.num * s // self.den)

    def lost(self, s):
        return s - self.least(s)

    def extra(self, s):
        return np.minimum(self.lost(s), s // 10)

    def length(self, s):
        """Of the prefix of step 1."""
        return np.minimum(s, self.lost(s) + 1 + self.extra(s))

    def similar(self, both: Column, a: Column, b: Column) -> Column:
        return self.den * both >= self.num * (a + b - both)

    def levels(self, s: int) -> range:
        """Powers of two whose layouts a set of s needs, to meet larger and smaller ones."""
        return range(max(1, self.least(s)).bit_length() - 1, (s * self.den // self.num).bit_length())


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(texts: pa.Array) -> pa.Array:
    """A-Z in lower case; null counts as empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    if not len(texts) or not texts.buffers()[2]:
        return texts
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = _LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]]
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(ends - ends[0]), pa.py_buffer(data)])


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, so that what is made of them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Of each text: the hashes of its shingles, each once, in order."""
    for part in columns(lowered(texts)):
        words = part.hashes()
        found = grams(words, n)
        for a, b in itertools.pairwise(part.begin.tolist()):
            if b - a >= n:
                yield np.unique(found[a : b - n + 1])
            else:
                yield grams(words[a:b], b - a) + np.uint64(b - a) if b > a else words[:0]


def node_of(shingles: np.ndarray) -> int | None:
    return int(np.int64(np.uint64(xxh64_intdigest(shingles.tobytes(), 7)))) if len(shingles) else None


FACTS = "doc_id long, text_node long, node long, n long, prefix binary"


def fact_columns(ids: pa.Array, text_nodes: pa.Array, sets: list[np.ndarray], rule: Rule) -> dict[str, pa.Array]:
    heads = [x[: rule.length(len(x))].tobytes() for x in sets]
    return {"doc_id": ids, "text_node": text_nodes, "node": pa.array(list(map(node_of, sets)), pa.int64()), "n": pa.array(list(map(len, sets)), pa.int64()), "prefix": pa.array(heads, pa.binary())}


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_node (hash of the text), text (null: empty)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_node"), text.alias("text"))


def facts(rows: DataFrame, rule: Rule) -> DataFrame:
    """text_rows -> doc_id, text_node, node (of the set; null without words), n (its size), prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_pydict(fact_columns(batch.column(0), batch.column(1), list(shingle_sets(batch.column(2), rule.words)), rule))

    return written(rows.mapInArrow(lambda batches: released(run(batches)), FACTS), "facts")


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        blobs = batch.column(1).to_pylist()
        nodes = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(x) // 8 for x in blobs])
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(blobs), np.int64)), pa.array(nodes)], names=["shingle", "node"])


def alive(found: DataFrame, rule: Rule) -> DataFrame:
    """facts -> node, n, text_node (of one text of it): the nodes that step 1 leaves."""
    nodes = found.where("node IS NOT NULL")
    shingles = nodes.select("node", "prefix").mapInArrow(lambda batches: released(_exploded(batches)), "shingle long, node long")
    alone = shingles.groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("other")).where("node = other").groupBy("node").agg(F.count("*").alias("alone"))
    least = lambda s: F.ceil(F.lit(rule.num) * s / rule.den)
    lost = lambda s: s - least(s)
    extra = lambda s: F.least(lost(s), F.floor(s / 10))
    n = F.col("n")
    length = F.least(n, lost(n) + 1 + extra(n))
    sizes = nodes.groupBy("node").agg(F.max("n").alias("n"), F.min("text_node").alias("text_node"))
    kept = sizes.join(alone, "node", "left").where(length - F.coalesce("alone", F.lit(0)) > extra(least(n)))
    return written(kept.select("node", "n", "text_node"), "alive")


CORE = "node long, n long, shingles array<long>, counts array<long>"


def cores(rows: DataFrame, left: DataFrame, rule: Rule) -> DataFrame:
    """text_rows and alive nodes -> node, n, shingles that others have too and in how many nodes each; without nodes that
    have too many of their own."""
    asked = left.select("text_node")
    asked = F.broadcast(asked) if left.count() <= BROADCAST_NODES else asked
    texts = rows.join(asked, "text_node", "left_semi").groupBy("text_node").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for found in shingle_sets(batch.column(1), rule.words):
                yield pa.RecordBatch.from_pydict({"node": pa.array(np.full(len(found), node_of(found), np.int64)), "n": pa.array(np.full(len(found), len(found))), "shingle": pa.array(found.view(np.int64))})

    every = written(texts.mapInArrow(lambda batches: released(run(batches)), "node long, n long, shingle long"), "shingles")
    counts = written(every.groupBy("shingle").agg(F.count("*").alias("nodes")).where("nodes > 1"), "shared_shingles")
    met = lookup(every, counts, "shingle", "nodes", every.count())
    held = met.groupBy("node").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("nodes", "shingle"))).alias("held"))
    enough = held.where(F.size("held") >= F.ceil(F.lit(rule.num) * F.col("n") / rule.den))
    out = written(enough.select("node", "n", "held.shingle", "held.nodes").toDF("node", "n", "shingles", "counts"), "cores")
    forget(every, counts)
    return out


def signatures(n: int, shingles: np.ndarray, counts: np.ndarray, rule: Rule) -> Iterator[tuple[int, int]]:
    """(signature, how many shingles a set without an earlier one in common can share) of a set of n, of which these are
    in others too, in the global order."""
    own = n - len(shingles)
    need = rule.lost(n) + 1 - own
    if need < 1:
        return
    borders = [at for at, _ in rule.classes]
    kind = np.searchsorted(borders, counts, "left") - 1
    rare = int((kind == 0).sum())
    for at, x in enumerate(shingles[: min(need, rare)].tolist()):
        yield x, n - own - at
    if rare >= need:
        return
    frequent, kinds = shingles[rare:].tolist(), kind[rare:].tolist()
    for level in rule.levels(n):
        # at most 1.5 lost(n) shingles of a set go into buckets without making a signature
        buckets = max(1, rule.lost(1 << level) // 2)
        dealt: dict[tuple[int, int], list[int]] = {}
        made = rare
        for x, c in zip(frequent, kinds):
            k = 1 if level < SINGLE_LEVEL else rule.classes[c][1]
            mine = dealt.setdefault((k, x % buckets), [])
            for before in itertools.combinations(mine, k - 1):
                yield xxh64_intdigest(np.array([level, *before, x], np.int64).tobytes()) - (1 << 63), n - own - rare
            mine.append(x)
            made += len(mine) >= k
            if made >= need:
                break


SIGNED = "signature long, node long, n long, most long"


def signed(core: DataFrame, rule: Rule) -> DataFrame:
    """cores -> signature, node, n, most (shingles it can share)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                node, n = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                shingles, counts = (batch.column(k)[row].values.to_numpy() for k in (2, 3))
                pairs = np.array(list(signatures(n, shingles, counts, rule)), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_pydict({"signature": pa.array(pairs[:, 0]), "node": pa.array(np.full(len(pairs), node, np.int64)), "n": pa.array(np.full(len(pairs), n)), "most": pa.array(pairs[:, 1])})

    return core.mapInArrow(lambda batches: released(run(batches)), SIGNED)


def _possible(rule: Rule, a: str, b: str) -> Column:
    return rule.similar(F.least(f"{a}most", f"{b}most"), F.col(f"{a}n"), F.col(f"{b}n"))


def _shared(rows: DataFrame) -> DataFrame:
    """signed -> the rows of signatures that several nodes have, with members and head, the member that can share most."""
    head = F.max_by(F.struct("node", "n", "most"), F.struct("most", -F.col("node"))).alias("head")
    heads = written(rows.groupBy("signature").agg(head, F.count("*").alias("members")).where("members > 1"), "heads")
    return written(lookup(rows, heads, "signature", "members", rows.count()), "shared_signatures")


def _nearest(shared: DataFrame, rule: Rule, stars: DataFrame | None = None) -> DataFrame:
    """(a, b) with a > b: each node with the head of most of its signatures that it may be similar to; not those in one
    component of the stars."""
    flat = shared.where("node <> head.node").select("node", "n", "most", *[F.col(f"head.{c}").alias(f"head_{c}") for c in ("node", "n", "most")])
    met = flat.where(_possible(rule, "", "head_")).groupBy("node", "head_node").agg(F.count("*").alias("times"))
    if stars is not None:
        heads = stars.select(F.col("a").alias("head_node"), F.col("b").alias("head_root"))
        met = _rooted(met, stars).join(heads, "head_node", "left").where(F.col("root") != F.coalesce("head_root", "head_node"))
    best = met.groupBy("node").agg(F.max_by("head_node", F.struct("times", "head_node")).alias("other"))
    return best.select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b"))


def _rooted(rows: DataFrame, stars: DataFrame) -> DataFrame:
    return rows.join(stars.withColumnRenamed("a", "node"), "node", "left").withColumn("root", F.coalesce("b", "node")).drop("b")


def _unmet(shared: DataFrame, stars: DataFrame, rule: Rule, side: int) -> DataFrame:
    """(a, b) with a > b: the pairs with a signature in common that may be similar and aren't in one component."""
    rooted = written(_rooted(shared.drop("head"), stars), "rooted")
    several = rooted.groupBy("signature").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("members")).where("low < high").select("signature", "members")
    inside = written(lookup(rooted.drop("members"), written(several, "several"), "signature", "members", rooted.count()), "inside")
    parts = F.ceil(F.col("members") / side)
    every = inside.withColumns({"parts": parts, "mine": F.pmod(F.xxhash64("node"), parts)})

    def dealt(own: str, other: str, prefix: str) -> DataFrame:
        at = [F.col("mine").alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias(other)]
        return every.select("signature", *[F.col(c).alias(prefix + c) for c in ("node", "root", "n", "most")], *at)

    met = dealt("i", "j", "a_").join(dealt("j", "i", "b_"), ["signature", "i", "j"])
    pairs = met.where((F.col("a_node") > F.col("b_node")) & (F.col("a_root") != F.col("b_root")) & _possible(rule, "a_", "b_"))
    out = written(pairs.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct(), "unmet")
    forget(rooted, inside)
    return out


def _verified(rule: Rule, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for k in range(batch.num_rows):
            one, two = (batch.column(c)[k].values.to_numpy() for c in (4, 5))
            both, n = len(np.intersect1d(one, two, assume_unique=True)), batch.column(2)[k].as_py() + batch.column(3)[k].as_py()
            kept.append(rule.den * both >= rule.num * (n - both))
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(kept, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])


def similar_pairs(pairs: DataFrame, core: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose sets are similar; nodes without a core are similar to none."""
    for side in ("a", "b"):
        pairs = pairs.join(core.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("shingles").alias(f"set_{side}")), side)
    return pairs.select("a", "b", "n_a", "n_b", "set_a", "set_b").mapInArrow(lambda batches: released(_verified(rule, batches)), "a long, b long")


def linked(core: DataFrame, rule: Rule, stars: DataFrame | None = None, side: int = SIDE) -> DataFrame:
    """cores -> (a, b): the component b of each node a that isn't its least. stars: the same of links already known."""
    shared = _shared(written(signed(core, rule), "signatures"))
    pairs = written(_nearest(shared, rule, stars), "nearest")
    alike = written(similar_pairs(pairs, core, rule), "alike")
    stars = components(alike if stars is None else stars.union(alike))
    rest = _unmet(shared, stars, rule, side)
    if not rest.isEmpty():
        stars = components(stars.union(written(similar_pairs(rest, core, rule), "alike")))
    forget(shared, pairs, rest, alike)
    return stars


def named(found: DataFrame, stars: DataFrame, wanted: dict[str, Column]) -> DataFrame:
    """facts(doc_id, text_node, node, ...) with a node -> the same with columns aggregated over each component's nodes, of which
    `first` is the least id and text_node the hash of its text."""
    known = found.where("node IS NOT NULL")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_node")).alias("least")
    nodes = known.groupBy("node").agg(least, F.count("*").alias("members")).select("node", F.col("least.doc_id").alias("first"), "least.text_node", "members")
    nodes = written(_rooted(nodes, stars), "nodes")
    ids = written(nodes.groupBy("root").agg(*[c.alias(k) for k, c in wanted.items()], F.count("*").alias("nodes")), "roots")
    back = written(lookup(nodes.select("node", "root", "members"), ids, "root", "nodes", nodes.count()).select("node", *wanted, "members"), "named")
    return lookup(known, back, "node", "members", found.count()).drop("members")


def similar_documents(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the least doc_id reachable by links)."""
    rows = text_rows(docs, id_col, text_col)
    found = facts(rows, rule)
    stars = linked(cores(rows, alive(found, rule), rule), rule)
    found = found.select("doc_id", "text_node", "node", "n")
    inside = named(found, stars, {"component_id": F.min("first")}).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return inside.unionByName(found.where("node IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
