"""Prefix tries, hard negatives and n-gram joins against brute force."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.llm import hard_negatives, ngram_join, prefix_trie
from tests.llm.test_text_operators import ODD, clash, docs

WORD = re.compile("[^\x20\x09-\x0d]+")
TURNS = "conv_id long, turn long, role string, text string"
TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def tree(rows):
    own = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(turns, key=lambda x: x[:2])] for c, turns in own.items()}
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        turns = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + own[c][h:])
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    children = collections.Counter(s[:-1] for s in members if s)
    leaves, saved = collections.Counter(), collections.Counter()
    for s in members:
        for d in range(len(s) + 1):
            leaves[s[:d]] += not children[s]
            saved[s[:d]] += (len(members[s]) - 1) * len(WORD.findall(s[-1][1])) if s else 0
    digest = lambda s: hashlib.sha256(",".join(map(str, ends[s])).encode()).hexdigest()
    return sorted((m[0], len(s), members[s[:-1]][0] if s else None, len(m), children[s], leaves[s], saved[s], digest(s)) for s, m in members.items())


def found(df, **how):
    return sorted(tuple(r) for r in prefix_trie.trie(df, **how).select(TRIE).collect())


@pytest.fixture(scope="module")
def turns():
    rng = np.random.default_rng(1)
    rows = []
    for c in range(-5, 90):
        for t in range(int(rng.integers(1, 9))):
            rows.append((c, t if t else None, [None, "user", "assistant"][rng.integers(0, 3)], ["a b c", None, "", "d  e", "f"][rng.integers(0, 5)]))
    rows += [(c, t, "user", f"w {t}") for c, n in ((1000, 60), (1007, 50), (2001, 1)) for t in range(n)]
    return rows + [(None, 1, "user", "nobody's"), (500, 1, "user", "x " * 30_000)]


def test_trie(spark, turns):
    df = spark.createDataFrame(turns, TURNS).withColumns({c: F.lit("clash") for c in ("key", "depth", "block", "words", "digest")})
    want = tree(turns)
    assert sum(r[1] == 0 for r in want) == 1 and any(r[3] > 3 and r[1] > 1 for r in want)
    assert found(df) == want
    assert prefix_trie.trie(df.where("false")).count() == 0


def test_trie_splits_collisions(spark, turns):
    """Fingerprints of a few values, so that most candidates hold several prefixes."""
    assert found(spark.createDataFrame(turns, TURNS), finger=prefix_trie.Fingerprint((7, 11), (3, 2))) == tree(turns)


def test_trie_in_blocks(spark, turns, monkeypatch):
    """Conversations of several blocks, digests of several texts."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 8)
    monkeypatch.setattr(prefix_trie, "JOINED", 2)
    assert found(spark.createDataFrame(turns, TURNS)) == tree(turns)


def test_trie_takes_repeated_turns(spark):
    rows = [(20, 1, "user", "a")] * 3 + [(40, 1, "user", "a")] * 3
    got = found(spark.createDataFrame(rows, TURNS))
    assert [r[:4] for r in got if r[1] == 3] == [(20, 3, 20, 2)]


def hard(rows):
    """rows(id, label, vector) -> the wanted rows by sorting."""
    one = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            one[i] = min(one.get(i, (label, v)), (label, v))
    whole = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in one.items()}
    out = []
    for a, (label, v) in whole.items():
        if a % 10:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i) for i, (_, w) in whole.items() if i != a)
        for score, p in [x for x in scored if whole[x[1]][0] == label][:5]:
            near = [x for x in scored if whole[x[1]][0] != label and 80 * -score <= 100 * -x[0] <= 100 * -score][:5]
            out += [(a, p, k + 1, n, -score, -s) for k, (s, n) in enumerate(near)]
    return sorted(out)


VECTORS = "vec_id long, label int, embedding array<float>"


@pytest.mark.parametrize("kind", ["spread", "ties", "large"])
def test_hard_negatives(spark, kind, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 16)
    monkeypatch.setattr(hard_negatives, "LEAST_ROWS", 32)
    rng = np.random.default_rng(2)
    rows = []
    for i in range(150):
        v = rng.normal(0.1, 0.3, 8) if kind == "spread" else rng.integers(0, 2, 3) * (0.25 if kind == "ties" else 1e6)
        rows.append((i, int(rng.integers(0, 3)), [float(np.float32(x)) for x in v]))
    rows += [(200, None, rows[0][2]), (210, 1, None), (220, 1, [0.5, None]), (230, 1, [float("nan"), 1.0]), (None, 1, [1.0]), (240, 1, [0.5]), (240, 0, [0.25, 0.5]), rows[10], (250, 2, [])]
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("clash") for c in ("id", "score", "block", "rank")})
    mined = hard_negatives.mine(df, F.col("id") % 10 == 0, F.col("label"), hard_negatives.Rule(radix=4))
    want = hard(rows)
    assert want and sorted(map(tuple, mined.collect())) == want
    assert hard_negatives.mine(df.where("false"), F.col("id") % 10 == 0, F.col("label")).count() == 0


def test_products():
    big = np.array([[2.0**62, -1.0], [3.0, 2.0**40]])
    assert hard_negatives.products(big, big).tolist() == [[hard_negatives.END, 3 * 2**62 - 2**40 if 3 * 2**62 - 2**40 <= hard_negatives.END else hard_negatives.END], [hard_negatives.END, hard_negatives.END]]
    assert hard_negatives.products(np.array([[1.0, 2.0]]), np.array([[3.0]])).tolist() == [[3]]


def similar(texts, rule):
    sets = []
    for t in texts:
        words = (t or "").encode().lower().split()
        sets.append({tuple(words[i : i + rule.words]) for i in range(max(1, len(words) - rule.words + 1))} if words else set())
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and rule.den * both >= rule.num * (len(a) + len(sets[j]) - both):
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    return [(i, len(s), r) for i, (s, r) in enumerate(zip(sets, root))]


RULES = [ngram_join.Rule(), ngram_join.Rule(3, 9, 10, ((0, 1), (3, 2), (8, 3))), ngram_join.Rule(5, 4, 5, ((0, 1), (2, 2), (6, 3)))]


@pytest.mark.parametrize("rule", RULES, ids=str)
def test_ngram_join(spark, rule):
    rng = np.random.default_rng(5)
    texts = [*ODD, "a b", "A b", "a c", "one two three", "one two three four"]
    for k in range(40):
        n = int(rng.choice([4, 8, 9, 12, 20, 60, 150, 400]))
        base = [f"w{x}" for x in rng.integers(0, 3000, n)]
        for edits in [0, 0, 1, 1, 2, 3, 1 + n // 60, 1 + n // 30, *(rng.integers(0, 5, 30).tolist() if k % 10 == 0 else [])]:
            other = list(base)
            for at in rng.integers(0, n, edits):
                other[at] = f"x{rng.integers(0, 40)}"
            texts.append(" ".join(other))
        texts += [" ".join([*base, "tail"]), " ".join(base[:-1])]
    want = similar(texts, rule)
    assert len({r for _, _, r in want}) < len(texts) - 100
    got = ngram_join.similar_documents(clash(docs(spark, texts)), rule)
    assert sorted(map(tuple, got.collect())) == want
    assert ngram_join.similar_documents(docs(spark, texts).where("false"), rule).count() == 0


def test_ngram_join_ids(spark):
    base = " ".join(f"w{i}" for i in range(50))
    d = docs(spark, [base, base, base + " x", base, "", None], ids=[3, 3, None, 2, None, 9])
    got = sorted((str(r.doc_id), str(r.component_id)) for r in ngram_join.similar_documents(d).collect())
    assert got == [("2", "2"), ("3", "2"), ("3", "2"), ("9", "9"), ("None", "2"), ("None", "None")]


def test_ngram_join_of_a_hot_group(spark):
    """Copies near a base, most too far from each other to link: few pairs are looked at, in blocks of any size."""
    rng = np.random.default_rng(7)
    base, texts = [f"w{i}" for i in range(150)], []
    for k in range(250):
        other = list(base)
        for at in rng.integers(0, 150, k % 6):
            other[at] = f"x{k}.{at}"
        texts.append(" ".join(other))
    rule = ngram_join.Rule(classes=((0, 1), (8, 2), (64, 3)))
    rows = ngram_join.text_rows(docs(spark, texts))
    core = ngram_join.cores(rows, ngram_join.alive(ngram_join.facts(rows, rule), rule), rule)
    want = similar(texts, rule)
    one, two = ({r.a: r.b for r in ngram_join.linked(core, rule, side=side).collect()} for side in (7, 1000))
    assert one == two and len(one) == len(set(texts)) - len({r for _, _, r in want})
    shared = ngram_join._shared(ngram_join.written(ngram_join.signed(core, rule)))
    stars = ngram_join.components(ngram_join.similar_pairs(ngram_join._nearest(shared, rule), core, rule))
    assert ngram_join._unmet(shared, stars, rule, 1000).count() < 500  # of 31,125 pairs
    assert sorted(map(tuple, ngram_join.similar_documents(docs(spark, texts), rule).collect())) == want
