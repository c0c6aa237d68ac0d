"""Near copies against brute force."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from pulseframe.llm import near_copies, ngram_join, simhash
from pulseframe.llm.common import written
from pulseframe.llm.words import mix
from tests.llm.test_text_operators import docs


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def groups(texts):
    """Text numbers -> the least of their component, by all pairs; and the number of pairs that link."""
    sets, root, n = [shingles(t) for t in texts], list(range(len(texts))), 0
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if 5 * both >= 4 * (len(a) + len(sets[j]) - both):
                n += 1
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    return root, n


def components(spark, texts):
    return [c for _, c in sorted((r.doc_id, r.component_id) for r in near_copies.similar_documents(docs(spark, texts)).collect())]


def test_stage_drops_near_copies(spark):
    rng = np.random.default_rng(3)
    texts = [None, "", "  ", "a b", "a B", "a c"]
    for k in range(150):
        words = [f"w{x}" for x in rng.integers(0, 3000, rng.integers(30, 400))]
        for edits in (0, 1, 1 + len(words) // 70, 1 + len(words) // 40):
            other = list(words)
            for at in rng.integers(0, len(words), edits):
                other[at] = f"x{k}"
            texts.append(" ".join(other))
    want, linked = groups(texts)
    assert linked > 300 and components(spark, texts) == want
    kept = {r.doc_id for r in corpus_pipeline.distinct_near_copies(spark, docs(spark, texts), "").collect()}
    assert kept == set(want)


def test_short_texts(spark):
    """Pairs just at 0.8 or above, of texts whose fingerprints say little: all are linked."""
    texts = []
    for short, long in ((8, 9), (12, 14), (20, 24), (59, 72)):
        for _ in range(150):
            words = [f"w{len(texts)}.{i}" for i in range(long)]
            texts += [" ".join(words), " ".join(words[:short])]
        assert groups(texts[-2:])[1] == 1
    assert components(spark, texts) == [i - i % 2 for i in range(len(texts))]


def test_most_links_are_found_by_fingerprints(spark):
    """SimHash finds the links of long texts; the exact join has only the rest to look at."""
    rng = np.random.default_rng(8)
    texts = []
    for k in range(200):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 300)]
        other = list(words)
        for at in rng.integers(0, 300, 5):
            other[at] = f"x{k}"
        texts += [" ".join(words), " ".join(other)]
    rows = ngram_join.text_rows(docs(spark, texts))
    core = ngram_join.cores(rows, ngram_join.alive(ngram_join.facts(rows, near_copies.RULE), near_copies.RULE), near_copies.RULE)
    by_bits = ngram_join.similar_pairs(near_copies.nearest_by_fingerprint(core), core, near_copies.RULE).count()
    assert by_bits >= 0.95 * groups(texts)[1]


def test_hot_group(spark):
    base = " ".join(f"w{i}" for i in range(200))
    d = docs(spark, [f"{base} x{i}" for i in range(600)] + ["other words that stand here alone"])
    rows = ngram_join.text_rows(d)
    core = ngram_join.cores(rows, ngram_join.alive(ngram_join.facts(rows, near_copies.RULE), near_copies.RULE), near_copies.RULE)
    pairs = written(near_copies.nearest_by_fingerprint(core))
    assert pairs.count() < 600
    stars = simhash.components(pairs)
    shared = ngram_join._shared(written(ngram_join.signed(core, near_copies.RULE)))
    assert ngram_join._unmet(shared, stars, near_copies.RULE, 100).count() == 0  # one component: nothing is left to meet
    assert {r.component_id for r in near_copies.similar_documents(d).collect()} == {0, 600}
    assert near_copies.similar_documents(d.where("false")).count() == 0


def test_keys_of_many_components(spark):
    """Documents that share half of their words, so keys too, but link in pairs only."""
    rng = np.random.default_rng(11)
    base, texts = [f"w{i}" for i in range(150)], []
    for k in range(150):
        own = [f"v{x}" for x in rng.integers(0, 10**6, 40)]
        texts += [" ".join(base + own), " ".join(base + own[:-4] + [f"y{k}"] * 4)]
    assert components(spark, texts) == groups(texts)[0]


def test_kept_rows(spark):
    """One row of a group stays, whatever its ids; texts of one set of shingles are one group."""
    base = " ".join(f"w{i}" for i in range(60))
    d = docs(spark, [base, base.upper(), base + " x", "alone", None, ""], ids=[7, 7, None, None, 4, 4])
    got = near_copies.similar_documents(d).collect()
    assert sorted(str(r.component_id) for r in got) == ["4", "4", "7", "7", "7", "None"]
    assert sum(r.kept for r in got if r.component_id == 7) == 1 and sum(r.kept for r in got if r.component_id is None) == 1


def test_columns_of_any_name(spark):
    """Columns that hold a dot, a map or structs, or are named as a stage's own."""
    d = docs(spark, ["one two three four five six", "one two three four five  six", "seven eight"]).withColumns({
        "a.b": F.lit(1), "`": F.lit(2), "row": F.lit("r"), "digest": F.lit("d"), "found_id": F.lit(3), "tags": F.create_map(F.lit("k"), F.col("doc_id")), "parts": F.array(F.struct(F.lit(1).alias("x"))), "node": F.lit(4),
    })
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, d, "")
        assert out.columns == d.columns, name
        d = written(out)
    assert {r.doc_id for r in d.collect()} <= {0, 1, 2} and d.first()["a.b"] == 1


def test_hot_roots(spark):
    """Components by both ways to join, of a star, a chain, and pairs."""
    edges = [(i, 0) for i in range(1, 40)] + [(i, i - 1) for i in range(101, 130)] + [(200, 201), (5, 5)]
    d = spark.createDataFrame(edges, "a long, b long")
    one, two = ({r.a: r.b for r in simhash.components(d, hot=hot).collect()} for hot in (10**6, 1))
    assert one == two == {i: 0 for i in range(1, 40)} | {i: 100 for i in range(101, 130)} | {201: 200}


def test_rounds_are_short_queries(spark, monkeypatch):
    """A round of components has three shuffles and no broadcast: each costs the driver a thread and several plans."""
    d = written(spark.createDataFrame([(i, i - 1) for i in range(1, 40)] + [(i, 100) for i in range(101, 140)], "a long, b long"))
    plans, write = [], simhash.written

    def watched(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(simhash, "written", watched)
    assert {r.a: r.b for r in simhash.components(d).collect()} == {i: 0 for i in range(1, 40)} | {i: 100 for i in range(101, 140)}
    assert len(plans) > 2 and max(x.count("Exchange hashpartitioning") for x in plans) <= 3 and not any("Broadcast" in x for x in plans)


def test_fingerprints_of_all_texts_come_first(spark, monkeypatch):
    """SimHash is given every document with words, by its whole set, and links most pairs without the exact join, short ones too."""
    rng, texts = np.random.default_rng(5), ["alone here", None, "", "nothing like any of the other texts that stand here", "a b c", "A  b c"]
    for short, long in ((8, 9), (20, 24), (59, 72), (290, 300)):
        for _ in range(60):
            words = [f"w{x}" for x in rng.integers(0, 10**6, long)]
            texts += [" ".join(words), " ".join(words[:short])]
    given, search = [], near_copies.nearest_by_fingerprint

    def watched(sets):
        given.append({r.doc_id: bytes(r.bits) for r in sets.where("node IS NOT NULL").select("doc_id", "bits").collect()})
        return search(sets)

    monkeypatch.setattr(near_copies, "nearest_by_fingerprint", watched)
    monkeypatch.setattr(ngram_join, "linked", lambda core, rule, stars: stars)
    got = components(spark, texts)
    whole = [next(ngram_join.shingle_sets(pa.array([t], pa.string()), 5)) for t in texts]
    counts = [2 * np.unpackbits(mix(x[:, None] + np.arange(4, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.uint8), axis=1).sum(axis=0, dtype=int) - len(x) for x in whole]
    assert given[0].keys() == {i for i, x in enumerate(whole) if len(x)}
    for i, bits in given[0].items():
        mine = np.unpackbits(np.frombuffer(bits, np.uint8))
        assert (mine == (counts[i] > 0))[counts[i] != 0].all()
    want = groups(texts)[0]
    pairs = [i for i in range(len(texts)) if want[i] != i and len(whole[i])]
    assert all(g in (i, w) for i, (g, w) in enumerate(zip(got, want)))  # nothing is linked that brute force doesn't link
    found = [got[i] == want[i] for i in pairs]
    print("found by fingerprints alone", [sum(found[k : k + 60]) for k in range(1, len(found), 60)])
    assert sum(found) >= 0.8 * len(found)
