"""Substring deduplication with suffix automata of reference shards.

A window is WINDOW consecutive words of one document. A word goes if a window that covers it has its words also start
in a document with a smaller id; windows are judged on the input. Matching statistics against suffix automata find the
windows: an automaton takes reference passages by rising document, and each of its states knows the first document
that holds its words, so streaming a passage through it gives every window's first document. What is removed are the
maximal spans of such windows.

Automata of a whole corpus have no size bound, so neither are they broadcast nor does every document meet every shard.
A window's fingerprint is the least hash of its GRAM-word grams; equal windows have equal fingerprints, which choose the
shard to visit. Consecutive windows of one fingerprint travel as one span of words. Only fingerprints that at least
two documents hold are sent. Equal spans travel once, with their first document, and every span of a shard is matched
against the shard's automaton, then added to it. A fingerprint with more than CROWDED different spans (the edges of a
passage that many documents hold) would swell one shard, so its spans are cut into single windows, which are spread over
shards by their digests; only of these, equal ones are met by digest, as an automaton of single windows would do.

A null text counts as empty. Rows with a null id keep all words and are no reference. Repeated rows and rows of one id
don't remove each other's words. An empty table gives an empty result. Only id and text are read, so other columns and
their names don't matter. Texts are read whole, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from pulseframe.llm.common import forget, lookup, written
from pulseframe.llm.words import Words, columns, grams, sliding_min

WINDOW = 13
GRAM = 6  #: words in a gram; the grams of a window compete to be its fingerprint
SPAN = 60  #: windows in a span at most, one bit each; longer runs of one fingerprint are cut
CROWDED = 256  #: different spans of one fingerprint, above which they are cut into windows
SHARD_SPANS = 2000  #: different spans in a shard on average; CROWDED bounds what one fingerprint adds


class Automaton:
    """Suffix automaton over passages of words, which must come by rising document."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [0]

    def _state(self, length: int, first: int, following: dict, link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.first.append(first)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, p: int, word, q: int) -> int:
        """The part of q that is reached from p as a state of its own."""
        copy = self._state(self.length[p] + 1, self.first[q], dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, words: list, document: int) -> None:
        following, link, length, last = self.next, self.link, self.length, 0
        for word in words:
            q = following[last].get(word)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, word, q)
                continue
            new, p = self._state(length[last] + 1, document, {}, 0), last
            while p >= 0 and word not in following[p]:
                following[p][word] = new
                p = link[p]
            if p >= 0:
                q = following[p][word]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, word, q)
            last = new

    def firsts(self, words: list, window: int) -> list[int | None]:
        """Of each window of the passage: the first document that holds it, None if none does."""
        following, link, length, first, state, matched, out = self.next, self.link, self.length, self.first, 0, 0, []
        for i, word in enumerate(words):
            to = following[state].get(word)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = following[state].get(word)
            if to is not None:
                state, matched = to, matched + 1
            while state and length[link[state]] >= window:  # the state of the window alone
                state = link[state]
                matched = length[state]
            if i >= window - 1:
                out.append(first[state] if matched >= window else None)
        return out


def _runs(w: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of one fingerprint: document, first window, windows, fingerprint."""
    n = len(w.at) - window + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    least = sliding_min(grams(w.hashes(), gram), window - gram + 1)
    of = np.repeat(np.arange(len(w.begin) - 1), np.diff(w.begin))
    inside = of[:n] == of[window - 1 :]
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | (of[1:n] != of[: n - 1]) | (inside[1:] != inside[:-1])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, n))
    start, size = start[inside[start]], size[inside[start]]
    if len(size) and size.max() > SPAN:
        pieces = -(-size // SPAN)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start, size = np.repeat(start, pieces) + nth * SPAN, np.minimum(SPAN, np.repeat(size, pieces) - nth * SPAN)
    return of[start], start, size, least[start].view(np.int64)


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values))


def fingerprints(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """docs(doc_id, text) -> doc_id, keys: the fingerprints of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in columns(batch.column(1)):
                n = len(w.begin) - 1
                of, _, _, keys = _runs(w, window, gram)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.first, n), _lists(keys, np.bincount(of, minlength=n))], names=["doc_id", "keys"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, keys array<long>")


def spans(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """docs(doc_id, version, text, shared) -> a row for each span whose fingerprint is among shared: doc_id, version,
    start (word), windows, key, span (digest of its words), words. words is null where the task has sent them before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for batch in batches:
            shared = batch.column(3)
            for w in columns(batch.column(2)):
                of, start, size, keys = _runs(w, window, gram)
                wanted = np.unique(shared.slice(w.first, len(w.begin) - 1).flatten().to_numpy())
                chosen = np.flatnonzero(np.isin(keys, wanted))
                of, start, size = of[chosen], start[chosen], size[chosen]
                last = start + size + window - 2
                text, a, b = memoryview(w.text.tobytes()), w.at[start].tolist(), (w.at[last] + w.size[last]).tolist()
                words = [text[x:y] for x, y in zip(a, b)]
                digests = [xxh3_128_digest(x) for x in words]
                if len(sent) > 500_000:
                    sent.clear()
                told = [None if d in sent else sent.add(d) or bytes(x) for d, x in zip(digests, words)]
                rows = pa.array(w.first + of)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array((start - w.begin[of]).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(keys[chosen]), pa.array(digests, pa.binary()), pa.array(told, pa.binary())],
                    names=["doc_id", "version", "start", "windows", "key", "span", "words"],
                )

    return docs.select("doc_id", "version", "text", "shared").mapInArrow(run, "doc_id long, version long, start int, windows int, key long, span binary, words binary")


def shard_firsts(table: pa.Table, window: int) -> pa.Table:
    """One shard's spans (span, words, first_doc) -> span, firsts."""
    words, first = [x.split(b" ") for x in table["words"].to_pylist()], table["first_doc"].to_pylist()
    out: list = [None] * len(first)
    automaton = Automaton()
    for i in sorted(range(len(first)), key=first.__getitem__):
        out[i] = [first[i] if d is None else d for d in automaton.firsts(words[i], window)]
        automaton.add(words[i], first[i])
    return pa.table({"span": table["span"], "firsts": pa.array(out, pa.list_(pa.int64()))})


def _window_digests(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = []
        for x in batch.column(2).to_pylist():
            words = x.split(b" ")
            digests.append([xxh3_128_digest(b" ".join(words[i : i + window])) for i in range(len(words) - window + 1)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.list_(pa.binary()))], names=["span", "first_doc", "windows"])


def first_documents(distinct: DataFrame, words: DataFrame, window: int, crowded: int) -> DataFrame:
    """distinct(span, key, windows, first_doc, last_doc), each span once, and words(span, words), at least once ->
    span, firsts: of each of its windows, the first document that holds it."""
    rivals = distinct.groupBy("key").agg(F.count("*").alias("rivals"))
    met = written(distinct.join(rivals, "key"), "rivals")
    sent = met.where("rivals > 1 OR first_doc < last_doc").select("span", "key", "first_doc", "rivals")
    told = words.join(sent, "span").dropDuplicates(["span"])
    told = written(told.select("span", "key", "first_doc", "rivals", "words"), "told_words")
    forget(met)
    few, many = told.where(F.col("rivals") <= crowded), told.where(F.col("rivals") > crowded)
    shards = max(1, few.count() // SHARD_SPANS)
    sharded = few.select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "span", "first_doc", "words").groupBy("shard")
    found = sharded.applyInArrow(lambda table: shard_firsts(table, window), "span binary, firsts array<long>")
    if many.isEmpty():
        return found
    cut = many.select("span", "first_doc", "words").mapInArrow(lambda x: _window_digests(x, window), "span binary, first_doc long, windows array<binary>")
    cut = written(cut.select("span", "first_doc", F.posexplode("windows").alias("at", "digest")), "windows")
    least = cut.groupBy("digest").agg(F.min("first_doc").alias("first"), F.count("*").alias("members"))
    met = lookup(cut.select("span", "at", "digest"), written(least, "first_windows"), "digest", "members", cut.count())
    return found.unionByName(met.groupBy("span").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "first"))), lambda x: x["first"]).alias("firsts")))


def _strip(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, marks) -> doc_id, text, n_words, n_removed, removed."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        marks = batch.column(2)
        for w in columns(batch.column(1)):
            n = len(w.begin) - 1
            texts, removed, gone = [], [], []
            counts = np.diff(w.begin)
            for i in range(n):
                told = marks[w.first + i].as_py()
                if not told:
                    texts.append(w.joined(i))
                    removed.append([])
                    gone.append(0)
                    continue
                steps = np.zeros(counts[i] + 1, np.int32)
                for mark in told:
                    mask, at = mark["mask"], mark["start"]
                    while mask:
                        if mask & 1:
                            steps[at] += 1
                            steps[at + window] -= 1
                        mask, at = mask >> 1, at + 1
                dropped = np.cumsum(steps)[:-1] > 0
                edges = np.flatnonzero(np.diff(np.concatenate(([False], dropped, [False]))))
                texts.append(w.joined(i, ~dropped))
                removed.append([{"start": a, "end": b} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())])
                gone.append(int(dropped.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(w.first, n), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(removed, kind)],
                names=["doc_id", "text", "n_words", "n_removed", "removed"],
            )


def strip_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, crowded: int = CROWDED) -> DataFrame:
    """One row per row of docs: doc_id, text (kept words joined by one space), n_words, n_removed, removed
    array<struct<start, end>> (maximal spans, in words of the input)."""
    # version tells rows of one id with different texts apart
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text"))
    found = written(fingerprints(rows.where("doc_id IS NOT NULL"), window, gram), "fingerprints")
    held = found.select("doc_id", F.explode("keys").alias("key"))
    groups = held.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("members"))
    shared = written(groups.where("least < most").select("key", "members"), "shared")
    total = found.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    asked = written(lookup(held, shared, "key", "members", total).groupBy("doc_id").agg(F.collect_set("key").alias("shared")), "asked")
    forget(found, shared)
    cut = written(spans(rows.join(asked, "doc_id"), window, gram), "spans")
    forget(asked)
    distinct = cut.groupBy("span").agg(F.max("key").alias("key"), F.max("windows").alias("windows"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count("*").alias("members"))
    distinct = written(distinct, "distinct_spans")
    firsts = first_documents(distinct.drop("members"), cut.where("words IS NOT NULL").select("span", "words"), window, crowded)
    useful = firsts.join(distinct.select("span", "last_doc", "members"), "span").where(F.array_min("firsts") < F.col("last_doc")).select("span", "firsts", "members")
    useful = written(useful, "useful")
    forget(distinct)
    met = lookup(cut.select("doc_id", "version", "start", "span"), useful, "span", "members", cut.count())
    mask = F.expr("aggregate(transform(firsts, (x, i) -> IF(x < doc_id, shiftleft(1L, i), 0L)), 0L, (a, x) -> a | x)")
    marks = met.select("doc_id", "version", "start", mask.alias("mask")).where("mask <> 0").groupBy("doc_id", "version").agg(F.collect_set(F.struct("start", "mask")).alias("marks"))
    marks = written(marks, "marks")
    forget(cut, useful)
    met = rows.join(marks, ["doc_id", "version"], "left").select("doc_id", "text", "marks")
    return met.mapInArrow(lambda x: _strip(x, window), "doc_id long, text string, n_words long, n_removed long, removed array<struct<start: int, end: int>>")
