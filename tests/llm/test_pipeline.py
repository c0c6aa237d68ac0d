"""The corpus pipeline against a version in plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pulseframe.llm.common import written
from pulseframe.llm.queries import tokenizer_path
from tests.llm.test_near_copies import groups as near_groups
from tests.llm.test_text_operators import docs

SF = "/root/testdata/sf0.001"
WEIGHTS = (5, 2, 1)


def marks(text):
    """Sentences as sets of lower-cased words and their beginnings."""
    found = []
    for sentence in re.split(r"[.!?\n]", (text or "").lower()):
        words = set(re.findall(r"\w+", sentence))
        if words:
            found.append(words | {"^" + w[:n] for w in words for n in (3, 4, 5, 6, 7) if n < len(w)})
    return found


def toxic_by_hand(learned, texts):
    """A noisy-or model of whole documents with one dense row a sentence -> the probability of each text."""
    bags = [(marks(t), y) for t, y in learned]
    bags = [(b, y) for b, y in bags if b]
    size = [sum(y == k for _, y in bags) for k in (0, 1)]
    seen = [Counter(x for b, y in bags if y == k for x in set().union(*b)) for k in (0, 1)]
    start = {}
    for x in seen[0].keys() | seen[1].keys():
        n, t = seen[0][x], seen[1][x]
        odds = np.log((t + 0.5) / (size[1] + 1)) - np.log((n + 0.5) / (size[0] + 1))
        sure = abs(odds) - 2 * np.sqrt(1 / (t + 0.5) + 1 / (n + 0.5))
        if n + t >= 3 and sure > 0:
            start[x] = sure if odds > 0 else 0.0
    names = sorted(start)
    rows = lambda b: np.array([[x in s for x in names] for s in b], float).reshape(len(b), len(names))
    tables, y = [rows(b) for b, _ in bags], [v for _, v in bags]
    w, b = np.array([start[x] for x in names]), -6.0
    m = v = np.zeros(len(w))
    mb = vb = 0.0
    for step in range(1, 151):
        g, gb = np.zeros(len(w)), 0.0
        for table, toxic in zip(tables, y):
            p = 1 / (1 + np.exp(-np.clip(table @ w + b, -30, 30)))
            none = np.prod(1 - np.minimum(p, 1 - 1e-12))
            told = 0.04 + 0.92 * (1 - none)
            slope = p * 0.92 * none * (-1 / told if toxic else 1 / (1 - told))
            g, gb = g + slope @ table / len(y), gb + slope.sum() / len(y)
        l1 = 0.5 / len(y)
        g = np.where(w == 0, np.sign(g) * np.maximum(np.abs(g) - l1, 0), g + l1 * np.sign(w))
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g**2, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        move = lambda a, c: 0.3 * a / (1 - 0.9**step) / (np.sqrt(c / (1 - 0.99**step)) + 1e-4)
        new = w - move(m, v)
        w, b = np.where(w * new < 0, 0.0, new), b - move(mb, vb)
    w[np.abs(w) <= 0.1] = 0
    return [1 - np.prod([1 - 1 / (1 + np.exp(-(sum(w[k] for k, x in enumerate(names) if x in s) + b))) for s in marks(t)]) for t in texts]


def by_hand(rows, labels):
    """Rows (doc_id, text, source) -> {doc_id: copies} after the fourth stage."""
    toxic = {i: t for i, t in labels if t is not None and zlib.crc32(str(i).encode()) % 5}
    judged = toxic_by_hand([(t, toxic[i]) for i, t, _ in rows if i in toxic], [t for _, t, _ in rows])
    left = [(i, t or "", s) for (i, t, s), p in zip(rows, judged) if p < 0.5]
    groups = defaultdict(list)
    for i, t, s in left:
        groups["".join(t.translate(dict.fromkeys(b" \t\n\x0b\x0c\r")))].append((-len(t), i, t, s))
    left = [min(g)[1:] for g in groups.values()]
    left.sort()
    root, _ = near_groups([t for _, t, _ in left])
    left = [x for k, x in enumerate(left) if root[k] == k]
    size = {i: len(t.encode().split()) for i, t, _ in left}
    sources = sorted({s for *_, s in left}, key=lambda s: (s is None, s))
    whole = {s: sum(size[i] for i, _, x in left if x == s) for s in sources}
    weight = {s: WEIGHTS[k % 3] for k, s in enumerate(sources)}
    target, open_, rest = {}, set(sources), sum(whole.values())
    while True:
        level = rest / sum(weight[s] for s in open_) if open_ else 0
        full = {s for s in open_ if level * weight[s] > 3 * whole[s]}
        if not full:
            break
        for s in full:
            target[s] = 3 * whole[s]
            rest -= target[s]
        open_ -= full
    target |= {s: level * weight[s] for s in open_}
    copies = {}
    for s in sources:
        words, start = round(target[s]), 0
        for i in sorted((i for i, _, x in left if x == s), key=lambda i: hashlib.md5(str(i).encode()).hexdigest()):
            taken = sum(max(0, min(start + k * whole[s] + size[i], words) - (start + k * whole[s])) for k in range(3))
            start += size[i]
            if size[i] and (n := max(int(np.floor(taken / size[i] + 0.5)), int(taken > 0 and start == size[i]))):
                copies[i] = n
    return copies


def test_pipeline_equals_plain_python(spark):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    found = defaultdict(list)
    for r in corpus_pipeline.run(spark, SF).collect():
        found[r.doc_id].append(r)
    assert {i: len(x) for i, x in found.items()} == by_hand(rows, labels)
    library, texts = Tokenizer.from_file(tokenizer_path()), {i: t for i, t, _ in rows}
    for i, same in found.items():
        for r in same:
            assert r.ids == library.encode(texts[i], add_special_tokens=False).ids and r.n_tokens == len(r.ids) and r.decoded_sha256 == hashlib.sha256(texts[i].encode()).hexdigest()


def test_stages_on_odd_rows(spark):
    texts = [None, "", "  ", "same text here now", "same  text here now", "another thing to say", "x", None]
    d = docs(spark, texts, ids=[0, 1, 2, 3, 4, 5, 6, 6]).withColumn("doc_id", F.when(F.col("doc_id") != 6, F.col("doc_id"))).withColumn("size", F.lit("clash")).withColumn("source", F.when(F.col("doc_id") % 2 == 0, "s"))
    for name, stage in corpus_pipeline.STAGES:
        found = written(stage(spark, d, SF), "test")
        if name != "bpe":
            assert found.columns == d.columns, name
        else:
            assert {"doc_id", "n_tokens", "ids"} <= set(found.columns)
        if name == "toxicity":
            assert found.count() == 8
        elif name == "exact_dedup":
            assert sorted(r.doc_id if r.doc_id is not None else -1 for r in found.collect()) == [-1, 2, 4, 5]
        d = found if name != "bpe" else d
    empty = d.where("false")
    assert all(stage(spark, empty, SF).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_clashing_names(spark):
    """Columns of documents named like results keep their values; of one id's texts the longest stays."""
    d = docs(spark, ["good day to all", "a b", "a  b", "a b ", "other text stands here"], ids=[1, 2, 2, 2, 3])
    names = ("score", "predicted", "offending", "digest", "row", "toxic", "keep_id", "size", "copies", "taken", "start", "found_id", "node", "kept")
    d = d.withColumns({c: F.lit(0.25) for c in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = written(stage(spark, d, SF), "test")
        found = d.collect()
        assert {r[c] for r in found for c in names} <= {0.25}, name
        if name == "exact_dedup":
            assert sorted((r.doc_id, r.text) for r in found) == [(1, "good day to all"), (2, "a  b"), (3, "other text stands here")]


def test_source_of_one_long_document(spark):
    """A source whose target is under half of its only document keeps it."""
    d = docs(spark, ["w " * 900, "v " * 800, "u " * 1000], source=lambda i: "abc"[i])
    assert {r.doc_id for r in corpus_pipeline.mixed(spark, d, SF).collect()} == {0, 1, 2}


def test_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "mixing", "bpe"]
