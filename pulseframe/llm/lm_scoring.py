"""Language-model scores by masked pseudo-likelihood.

Tokens are lower-cased words. The most frequent WORDS of the corpus are classes of their own, all others share SHARED
classes by their last two bytes. A bidirectional network of one hidden layer reads the REACH tokens on either side of a
masked one and gives a distribution over classes, as a group of classes and a class within the group. Within a shared
class a word has its share of the class's occurrences in the corpus, n(word) / (n(class) + 1), and what is left over is
for words that the corpus lacks, spelled byte by byte. So every word has a probability in every context, and the sum over
all words is 1. A document's score is the sum of its tokens' log-probabilities, each masked in turn and predicted from
both sides. The counts of all words are a distributed table that grows with the corpus. Those of the KNOWN most frequent
words are broadcast; the documents' other words are joined with the table.

Counts cover all documents, and so does training: each position is a target in one of the ROUNDS, which take turns with
blocks of BATCH positions. In a round every task starts from the shared weights and takes an Adam step on each block, and
the tasks' weights are averaged by their positions, in levels of FAN_IN. Tasks get about TASK_TOKENS tokens each, however many there are; the network, of
fixed size, is all that is broadcast or collected. Splitting the input otherwise changes weights slightly; the same
splits give the same weights, also when tasks are run again.

A null or empty text, or one of white space, has no tokens: log_prob 0 and null means. Repeated rows are scored each
for itself. Words of equal frequency are ranked by their hash. An empty table gives an empty result. Only id and text are
read, so other columns and their names don't matter. Texts are read and scored whole, a block of positions at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.common import forget, written
from pulseframe.llm.words import columns, mix

GROUPS, MEMBERS = 32, 32
CLASSES = GROUPS * MEMBERS
SHARED = 128  #: classes of the words that are no class of their own
WORDS = CLASSES - SHARED
KNOWN = 1 << 20  #: words whose counts every task holds, 16 bytes each, at most
EDGE = CLASSES  #: what stands before the first and behind the last token
REACH, HIDDEN = 2, 32
CELLS = np.arange((CLASSES + 1) * HIDDEN).reshape(-1, HIDDEN)  #: the numbers of an embedding's cells
STARTS = (*range(REACH), *range(REACH + 1, 2 * REACH + 1))  #: of a position's places, counted from the first
ROUNDS = 2
BATCH, RATE = 1 << 11, 0.01
BLOCK = 1 << 12  #: positions scored at once
COUNTED = 1 << 20  #: words counted at once, unless one chunk has more
STEPS = 8  #: in a list of hashes, before it is searched by halves
LARGE = 60.0  #: scores that exp of single precision takes as they are
CHUNK = 1 << 17  #: tokens in arrays at once, unless one document is longer
TASK_TOKENS = 1_000_000
FAN_IN = 64
BYTES = 256.0  #: symbols that spell a word: 255 bytes and its end, all as likely


@dataclass
class Network:
    embed: np.ndarray  #: (CLASSES + 1, HIDDEN)
    near: np.ndarray  #: (2 x REACH, HIDDEN, HIDDEN): what a place makes of a neighbour
    bias: np.ndarray
    group: np.ndarray  #: (HIDDEN, GROUPS)
    group_prior: np.ndarray
    member: np.ndarray  #: (GROUPS, HIDDEN, MEMBERS)
    member_prior: np.ndarray  #: (GROUPS, MEMBERS)

    @classmethod
    def start(cls, counts: np.ndarray) -> Network:
        rng = np.random.default_rng(7)
        normal = lambda *shape: rng.normal(0, 0.15, shape)
        of = (counts + 1).reshape(GROUPS, MEMBERS)
        priors = np.log(of.sum(axis=1) / of.sum()), np.log(of / of.sum(axis=1, keepdims=True))
        found = normal(CLASSES + 1, HIDDEN), normal(2 * REACH, HIDDEN, HIDDEN), np.zeros(HIDDEN), normal(HIDDEN, GROUPS), priors[0], normal(GROUPS, HIDDEN, MEMBERS), priors[1]
        return cls(*(x.astype(np.float32) for x in found))

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, f.name).ravel() for f in fields(self)])

    def like(self, flat: np.ndarray) -> Network:
        """A network over the same numbers, as they change."""
        found, at = [], 0
        for f in fields(self):
            x = getattr(self, f.name)
            found.append(flat[at : at + x.size].reshape(x.shape))
            at += x.size
        return Network(*found)

    def read(self, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embedded tokens, and the hidden layer of every position but REACH at either end."""
        embedded = self.embed.take(stream, axis=0)
        n = len(stream) - 2 * REACH
        hidden = np.broadcast_to(self.bias, (n, HIDDEN)).copy()
        for w, at in zip(self.near, STARTS):
            hidden += embedded[at : at + n] @ w
        return embedded, np.tanh(hidden, out=hidden)

    def placed(self, embed: np.ndarray | None = None) -> np.ndarray:
        """(2 x REACH, CLASSES + 1, HIDDEN): what each place makes of each class, or of each of some embedded ones; the
        first place has the bias in it."""
        out = (self.embed if embed is None else embed) @ self.near
        out[0] += self.bias
        return out

    def hidden(self, stream: np.ndarray, placed: np.ndarray, room: Room | None = None) -> np.ndarray:
        """The hidden layer as `read` has it, by sums of `placed`."""
        room, n = room or Room(), len(stream) - 2 * REACH
        out, more = (room(name, placed.dtype, n, HIDDEN) for name in ("hidden", "more"))
        placed[0].take(stream[:n], axis=0, out=out, mode="clip")
        for of, at in zip(placed[1:], STARTS[1:]):
            out += of.take(stream[at : at + n], axis=0, out=more, mode="clip")
        out *= 2  # tanh(x) = 1 - 2 / (exp(2 x) + 1), in less time
        with np.errstate(over="ignore"):
            np.exp(out, out=out)
        out += 1
        np.divide(-2, out, out=out)
        out += 1
        return out

    def scores(self, hidden: np.ndarray, ends: np.ndarray, room: Room) -> tuple[np.ndarray, np.ndarray]:
        """Of groups, and of the members of each position's own group, less a number of each position's where exp needs
        it; hidden is in the order of groups."""
        group, inner = (room(name, hidden.dtype, len(hidden), width) for name, width in (("group", GROUPS), ("inner", MEMBERS)))
        np.dot(hidden, self.group, out=group)
        group += self.group_prior
        for g, a, b in _groups(ends):
            np.dot(hidden[a:b], self.member[g], out=inner[a:b])
        inner += self.member_prior.take(np.repeat(np.arange(GROUPS), np.diff(ends)), axis=0, out=room("more", hidden.dtype, len(hidden), MEMBERS), mode="clip")
        for x in (group, inner):
            if x.size and max(x.max(), -x.min()) > LARGE:
                x -= x.max(axis=1, keepdims=True)
        return group, inner

    def log_probabilities(self, hidden: np.ndarray, target: np.ndarray, room: Room | None = None) -> np.ndarray:
        """Of the target classes."""
        room = room or Room()
        order, ends = _by_group(target)
        target = target[order]
        group, inner = self.scores(hidden.take(order, axis=0, out=room("ordered", hidden.dtype, *hidden.shape), mode="clip"), ends, room)
        out = np.empty(len(target), hidden.dtype)
        out[order] = _log_softmax_at(group, target // MEMBERS) + _log_softmax_at(inner, target % MEMBERS)
        return out

    def gradient(self, stream: np.ndarray, into: Network | None = None, room: Room | None = None) -> tuple[Network, int]:
        """Of the mean negative log-probability of a stream's positions (EDGE and the ends aside), and their number.
        Places' products and sums are made once a class that occurs, not once a position."""
        into, room = into or self.like(np.empty_like(self.flat())), room or Room()
        n, dtype = len(stream) - 2 * REACH, self.embed.dtype
        target = stream[REACH : REACH + n]
        at = np.flatnonzero(target != EDGE)
        count = max(1, len(at))
        order, ends = _by_group(target[at])
        at = at[order]
        target = target[at].astype(np.int64)
        present = np.flatnonzero(np.bincount(stream, minlength=CLASSES + 1))
        number = np.zeros(CLASSES + 1, np.int64)
        number[present] = np.arange(len(present))
        tokens, embed = number[stream], self.embed.take(present, axis=0)
        hidden = self.hidden(tokens, self.placed(embed), room).take(at, axis=0, out=room("ordered", dtype, len(at), HIDDEN), mode="clip")
        error, inner = self.scores(hidden, ends, room)
        _softmax_errors(error, target // MEMBERS, count)
        _softmax_errors(inner, target % MEMBERS, count)
        pull, more = (room(name, dtype, len(at), HIDDEN) for name in ("pull", "more"))
        ones = np.ones(len(at), dtype)  # products with it sum rows
        np.dot(error, self.group.T, out=pull)
        into.member[:], into.member_prior[:] = 0, 0
        for g, a, b in _groups(ends):
            wrong = inner[a:b]
            np.dot(hidden[a:b].T, wrong, out=into.member[g])
            np.dot(ones[a:b], wrong, out=into.member_prior[g])
            np.dot(wrong, self.member[g].T, out=more[a:b])
        pull += more
        np.dot(hidden.T, error, out=into.group)
        np.dot(ones, error, out=into.group_prior)
        np.multiply(hidden, hidden, out=more)
        pull *= np.subtract(1, more, out=more)
        back = room("back", np.dtype(np.float64), n, HIDDEN)
        back[:] = 0
        back[at] = pull
        np.dot(ones, pull, out=into.bias)
        cells = CELLS.take(tokens, axis=0, out=room("cells", CELLS.dtype, len(stream), HIDDEN), mode="clip")
        pulls = np.zeros_like(embed)
        for j, start in enumerate(STARTS):
            sums = np.bincount(cells[start : start + n].ravel(), back.ravel(), embed.size).reshape(embed.shape).astype(dtype)
            np.dot(embed.T, sums, out=into.near[j])
            pulls += sums @ self.near[j].T
        into.embed[:] = 0
        into.embed[present] = pulls
        return into, len(at)


class Room:
    """Arrays that are used again from block to block: the system takes long to give such large ones anew each time."""

    def __init__(self):
        self.held: dict[tuple, np.ndarray] = {}

    def __call__(self, name: str, dtype: np.dtype, *shape: int) -> np.ndarray:
        size, key = shape[0] * shape[1], (name, dtype)
        if key not in self.held or len(self.held[key]) < size:
            self.held[key] = np.empty(size, dtype)
        return self.held[key][:size].reshape(shape)


def _rows_summed(which: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """n rows: the sum of those of each number."""
    which = which.astype(np.int64)
    out = np.empty((n, rows.shape[1]), rows.dtype)
    for k in range(rows.shape[1]):
        out[:, k] = np.bincount(which, rows[:, k], n)
    return out


def _log_softmax_at(scores: np.ndarray, which: np.ndarray) -> np.ndarray:
    """At one place of each row."""
    told = scores.ravel()[np.arange(0, scores.size, scores.shape[1]) + which]
    np.exp(scores, out=scores)
    return told - np.log(scores @ np.ones(scores.shape[1], scores.dtype))


def _softmax_errors(scores: np.ndarray, which: np.ndarray, count: int) -> None:
    """The rows' softmax, less 1 at one place of each, all divided by count, in place."""
    np.exp(scores, out=scores)
    total = scores @ np.ones(scores.shape[1], scores.dtype)
    total *= count
    scores *= np.divide(1, total, out=total)[:, None]
    scores.ravel()[np.arange(0, scores.size, scores.shape[1]) + which] -= 1 / count


def _by_group(target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The targets' order by group, and where each group begins in it."""
    group = (target // MEMBERS).astype(np.uint8)
    return np.argsort(group, kind="stable"), np.concatenate(([0], np.cumsum(np.bincount(group, minlength=GROUPS))))


def _groups(ends: np.ndarray) -> Iterator[tuple[int, int, int]]:
    for g in np.flatnonzero(np.diff(ends)).tolist():
        yield g, int(ends[g]), int(ends[g + 1])


@dataclass
class Vocabulary:
    """The most frequent words."""

    hashes: np.ndarray  #: sorted
    classes: np.ndarray  #: of those that are classes of their own, else -1
    logs: np.ndarray  #: of their counts

    @cached_property
    def first(self) -> np.ndarray:
        """The number of hashes that begin with less than each number of as many bits as tell most of them apart."""
        bits = max(1, (len(self.hashes) - 1).bit_length())
        return np.concatenate(([0], np.cumsum(np.bincount((self.hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)))).astype(np.int32)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """np.searchsorted of some, the last place at most, by steps from the first that begins as they do."""
        bits, last = (len(self.first) - 1).bit_length() - 1, len(self.hashes) - 1
        out = np.minimum(self.first.take((hashes >> np.uint64(64 - bits)).astype(np.int64)), last).astype(np.int64)
        on = np.flatnonzero(self.hashes.take(out) < hashes)
        for _ in range(STEPS):
            on = on[out[on] < last]
            if not len(on):
                return out
            out[on] += 1
            on = on[self.hashes.take(out[on]) < hashes[on]]
        out[on] = np.minimum(np.searchsorted(self.hashes, hashes[on]), last)
        return out

    def look_up(self, w, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Of the words of a chunk (words.Words) and their hashes: the class, and the log of its count in a shared class, 0
        in one of its own, NaN of a word that isn't here."""
        hashes = w.hashes() if hashes is None else hashes
        classes, logs = np.full(len(hashes), -1, np.int64), np.full(len(hashes), np.nan)
        if len(self.hashes):
            place = self.places(hashes)
            here = np.flatnonzero(self.hashes.take(place) == hashes)
            place = place[here]
            classes[here] = self.classes[place]
            logs[here] = self.logs[place]
            logs[classes >= 0] = 0.0
        at = np.flatnonzero(classes < 0)
        size, end = w.size[at], w.start[at] + w.size[at]
        last = w.data[end - 1].astype(np.uint64)
        before = np.where(size > 1, w.data[np.maximum(end - 2, 0)], 0).astype(np.uint64)
        classes[at] = WORDS + (mix(last * np.uint64(256) + before) % np.uint64(SHARED)).astype(np.int64)
        return classes.astype("<u2"), logs


@dataclass
class Model:
    vocabulary: Vocabulary
    network: Network
    class_counts: np.ndarray
    counts: DataFrame  #: word (hash), total: all words of the corpus


def vocabulary_of(counts: DataFrame, known: int = KNOWN) -> Vocabulary:
    """counts(word, total): words from some frequency up, as many as fit. A histogram finds that frequency."""
    level = F.floor(F.log2("total") * 16)
    sizes = counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect()  # 16 a doubling
    taken, least = 0, None
    for r in sizes:
        taken += r.n
        if taken > known:
            break
        least = r.level
    chosen = counts.where(level >= (least if least is not None else 1 << 20)).toArrow()
    words, totals = chosen["word"].to_numpy(), chosen["total"].to_numpy()
    classes = np.full(len(words), -1, np.int32)
    own = np.lexsort((words, -totals))[:WORDS]
    classes[own] = np.arange(len(own))
    hashes = words.view(np.uint64)
    order = np.argsort(hashes)
    return Vocabulary(hashes[order], classes[order], np.log(totals[order]).astype(np.float32))


def word_counts(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> word (hash), total, over all documents."""

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        words, counts = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts.astype(np.int64))], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for w in columns(pc.ascii_lower(batch.column(0))):
                held.append(w.hashes())
                if sum(map(len, held)) >= COUNTED:
                    yield counted(held)
                    held = []
        if held:
            yield counted(held)

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("total"))


def tokenised(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """docs(doc_id, text) -> doc_id, tokens: two bytes each; row: a number of its own, once the table is written; known:
    the sum of the logs of its known words' counts; uses: of each other word, its hash, times in the document, and bytes."""
    use = pa.struct([("word", pa.int64()), ("n", pa.int32()), ("size", pa.int32())])
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, row = shared.value, TaskContext.get().partitionId() << 33
        for batch in batches:
            for w in columns(pc.ascii_lower(batch.column(1))):
                hashes = w.hashes()
                classes, logs = vocabulary.look_up(w, hashes)
                found = pa.Array.from_buffers(pa.binary(), len(w.begin) - 1, [None, pa.py_buffer((2 * w.begin).astype(np.int32)), pa.py_buffer(classes)])
                of, other = np.repeat(np.arange(len(found)), np.diff(w.begin)), np.isnan(logs)
                known = np.bincount(of[~other], logs[~other], len(found)).astype(np.float64)
                of, hashes, size = of[other], hashes[other].view(np.int64), w.size[other]
                order = np.lexsort((hashes, of))
                of, hashes, size = of[order], hashes[order], size[order]
                at = np.flatnonzero(np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])))[: len(of)])
                times = np.diff(np.append(at, len(of)))
                values = pa.StructArray.from_arrays([pa.array(hashes[at]), pa.array(times.astype(np.int32)), pa.array(size[at].astype(np.int32))], fields=list(use))
                uses = pa.ListArray.from_arrays(pa.array(np.searchsorted(of[at], np.arange(len(found) + 1)).astype(np.int32)), values)
                rows = pa.array(np.arange(row, row + len(found)))
                row += len(found)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.first, len(found)), found, rows, pa.array(known), uses], names=["doc_id", "tokens", "row", "known", "uses"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, tokens binary, row long, known double, uses array<struct<word: long, n: int, size: int>>")


def class_counts(tokens: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u2"), minlength=CLASSES)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES, dtype=np.int32)), pa.array(n)], names=["class", "n"])

    counts = np.zeros(CLASSES)
    for row in tokens.select("tokens").mapInArrow(run, "class int, n long").groupBy("class").agg(F.sum("n").alias("n")).collect():
        counts[row["class"]] = row.n
    return counts


def even(tokens: DataFrame, total: float, *kept: str) -> DataFrame:
    """The rows dealt to tasks of about TASK_TOKENS tokens: a token takes long for its two bytes."""
    cores = tokens.sparkSession.sparkContext.defaultParallelism
    return tokens.select(*kept, "row", "tokens").repartition(max(cores, -(-int(total) // TASK_TOKENS)), "row")


def _streams(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, the tokens of some documents with EDGE around each, and where each document begins."""
    edge = np.full(REACH, EDGE, "<u2").tobytes()
    held: list[bytes] = []
    first = size = 0
    for i, x in enumerate(column):
        held.append(x.as_py())
        size += len(held[-1]) // 2
        if size >= CHUNK or i == len(column) - 1:
            begin = np.cumsum([REACH, *(len(t) // 2 + REACH for t in held)])
            yield first, np.frombuffer(edge + b"".join(t + edge for t in held), "<u2"), begin
            held, first, size = [], i + 1, 0


def train_round(tokens: DataFrame, network: Network, number: int) -> tuple[np.ndarray, int]:
    """tokens(tokens) -> the average of all tasks' weights after their steps, and the number of positions that they
    learned from."""
    shared = tokens.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = shared.value.flat()
        net = shared.value.like(flat)
        mean, square, move, step, seen = np.zeros_like(flat), np.zeros_like(flat), np.empty_like(flat), 0, 0
        g, room = np.empty_like(flat), Room()
        into = net.like(g)
        for batch in batches:
            for _, stream, _ in _streams(batch.column(0)):
                for i in range(BATCH * number, len(stream) - 2 * REACH, BATCH * ROUNDS):
                    _, n = net.gradient(stream[i : i + BATCH + 2 * REACH], into, room)
                    if not n:
                        continue
                    step, seen = step + 1, seen + n
                    np.multiply(g, g, out=move)
                    move -= square
                    move *= np.float32(0.01)
                    square += move
                    g -= mean
                    g *= np.float32(0.1)
                    mean += g
                    np.multiply(square, np.float32(1 / (1 - 0.99**step)), out=move)
                    np.sqrt(move, out=move)
                    move += np.float32(1e-6)
                    np.divide(mean, move, out=move)
                    move *= np.float32(RATE / (1 + number) / (1 - 0.9**step))
                    flat -= move
        if seen:
            yield pa.RecordBatch.from_pydict({"task": [TaskContext.get().partitionId()], "seen": [seen], "weights": [(flat.astype(np.float64) * seen).tolist()]})

    found = written(tokens.select("tokens").mapInArrow(run, "task long, seen long, weights array<double>"), "weights")
    tasks = found.agg(F.max("task")).first()[0]
    while tasks:  # sums of FAN_IN tasks' weights at a time
        grouped, last = found.withColumn("task", F.expr(f"task div {FAN_IN}")).groupBy("task"), found
        found = written(grouped.applyInArrow(_summed, "task long, seen long, weights array<double>"), "weights")
        forget(last)
        tasks //= FAN_IN
    row = found.first()
    forget(found)
    return (network.flat(), 0) if row is None else ((np.array(row.weights) / row.seen).astype(np.float32), row.seen)


def _summed(table: pa.Table) -> pa.Table:
    rows = sorted(range(table.num_rows), key=lambda i: (table["seen"][i].as_py(), table["weights"][i][0].as_py()))  # one order, whatever the arrival
    total = sum(np.asarray(table["weights"][i].values) for i in rows)
    return pa.table({"task": table["task"][:1], "seen": [pc.sum(table["seen"]).as_py()], "weights": [total.tolist()]}, schema=table.schema)


def by_class(tokens: DataFrame, model: Model) -> DataFrame:
    """tokens(doc_id, row, known, tokens) -> doc_id, row, n_tokens, log_prob: the sum of log P(class) and of the logs of
    known words' counts, less log(n(class) + 1) of the tokens in shared classes."""
    share = np.where(np.arange(CLASSES) < WORDS, 0.0, -np.log(model.class_counts + 1))
    shared = tokens.sparkSession.sparkContext.broadcast((model.network, share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, share = shared.value
        placed, room = net.placed(), Room()
        for batch in batches:
            sums, counts = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for first, stream, begin in _streams(batch.column(3)):
                logs = np.zeros(len(stream) + 1)
                for i in range(0, len(stream) - 2 * REACH, BLOCK):
                    piece = stream[i : i + BLOCK + 2 * REACH]
                    target = piece[REACH:-REACH].astype(np.int64)
                    at = np.flatnonzero(target != EDGE)
                    target = target[at]
                    logs[i + REACH + at + 1] = net.log_probabilities(net.hidden(piece, placed, room).take(at, axis=0), target, room) + share[target]
                n = len(begin) - 1
                counts[first : first + n] = np.diff(begin) - REACH
                for k, (a, b) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist())):
                    sums[first + k] = logs[a + 1 : b + 1].sum()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts), pa.array(sums + batch.column(2).to_numpy())], names=["doc_id", "row", "n_tokens", "log_prob"])

    return tokens.select("doc_id", "row", "known", "tokens").mapInArrow(run, "doc_id long, row long, n_tokens long, log_prob double")


def within_classes(tokens: DataFrame, counts: DataFrame) -> DataFrame:
    """row, within: the sum of log n(word) over a document's words that aren't known, and of log P(spelling) over those
    that the corpus lacks. No such word is frequent, so none is a hot key."""
    uses = tokens.select("row", F.explode("uses").alias("use")).select("row", "use.*")
    log = F.coalesce(F.log("total"), -(F.col("size") + 1) * F.log(F.lit(BYTES)))
    return uses.join(counts, "word", "left").groupBy("row").agg(F.sum(F.col("n") * log).alias("within"))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def _trained(rows: DataFrame) -> tuple[Model, DataFrame]:
    counts = written(word_counts(rows), "word_counts")
    vocabulary = vocabulary_of(counts)
    tokens = written(tokenised(rows, vocabulary), "tokens")
    n = class_counts(tokens)
    network = Network.start(n)
    for number in range(ROUNDS):
        weights, _ = train_round(even(tokens, n.sum()), network, number)
        network = network.like(weights)
    return Model(vocabulary, network, n, counts), tokens


def _scored(tokens: DataFrame, model: Model) -> DataFrame:
    found = by_class(even(tokens, model.class_counts.sum(), "doc_id", "known"), model).join(within_classes(tokens, model.counts), "row", "left")
    mean = F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens"))
    found = found.select("doc_id", "n_tokens", (F.col("log_prob") + F.coalesce("within", F.lit(0.0))).alias("log_prob"))
    return found.withColumn("mean_log_prob", mean).withColumn("pseudo_perplexity", F.exp(-mean))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    return _trained(_rows(docs, id_col, text_col))[0]


def score(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, log_prob (summed), mean_log_prob, pseudo_perplexity. Without a model,
    one is trained on docs."""
    rows = _rows(docs, id_col, text_col)
    if model is None:
        model, tokens = _trained(rows)
    else:
        tokens = written(tokenised(rows, model.vocabulary), "tokens")
    return _scored(tokens, model)
