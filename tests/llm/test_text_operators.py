"""Operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables,
clashing column names."""

import hashlib
import tracemalloc

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
import pyarrow as pa
import zstandard
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

from pulseframe.llm import bpe, exact_dedup, langid, lm_scoring, mixing, queries, simhash, substring_dedup, toxicity, url_filters, words

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t", "x", "é ß \u2028 \x1c a\xa0b", "a " * 30_000, "😀 ok <|endoftext|> 12 34\r\n\r\n  end  "]


def docs(spark, texts, ids=None, source=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "en", source(i) if source else "s", 0) for i, t in zip(ids, texts)], SCHEMA)


def clash(df):
    """More columns, named as results are."""
    return df.withColumns({c: F.lit("clash") for c in ("keep_id", "score", "key", "digest", "size", "members", "tokens", "ids")})


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(corpus):
    return {r.doc_id: r.text for r in corpus.select("doc_id", "text").collect()}


def duck(sql):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con.sql(sql)


@pytest.mark.parametrize("name", queries.ORACLES)
def test_sql(spark, name):
    found = queries.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    key = lambda r: [(x is None, str(x)) for x in r]
    near = lambda rows: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=key)
    assert near(map(tuple, found.select(*columns).collect())) == near(duck(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall())


# Words

def test_words(spark):
    column = pa.array([*ODD, "two  words"])
    got = [w.joined(i) for w in words.columns(column) for i in range(len(w.begin) - 1)]
    assert got == [b" ".join((t or "").encode().split()) for t in column.to_pylist()]
    hashes = [h for w in words.columns(pa.array(["ab cd ab", "cd " + "y" * 300_000 + " ab"])) for h in w.hashes().tolist()]
    assert hashes[0] == hashes[2] == hashes[5] != hashes[1] and hashes[1] == hashes[3] and len(set(hashes)) == 3
    x = np.random.default_rng(0).integers(0, 1 << 60, 50).astype(np.uint64)
    for n in range(1, 10):
        assert words.sliding_min(x, n).tolist() == [min(x[i : i + n]) for i in range(50 - n + 1)]


# Language identification

def test_langid_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = queries.op1_language_id(spark, "/root/testdata/sf0.01").join(d.select("doc_id", "lang", "text"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    known = [r for r in found if r.lang_pred != "und"]
    assert len(known) > 200 and sum(r.lang == r.lang_pred for r in known) / len(known) > 0.95
    assert all(0 <= r.score <= 1 for r in found)


def test_langid_edges(spark):
    d = docs(spark, ["guten tag die leute " * 5, "good day to the people " * 5, None, "", "12 34", "GOOD DAY PEOPLE"]).withColumn("lang", F.when(F.col("doc_id") == 0, "de").when(F.col("doc_id") == 1, "en"))
    model = langid.train(d)
    got = {r.doc_id: r for r in langid.identify(clash(d), model).collect()}
    assert [got[i].lang_pred for i in range(6)] == ["de", "en", "und", "und", "und", "en"] and got[2].rejected and got[2].score == 0
    assert langid.train(d.where("lang IS NULL")) == {} and {r.lang_pred for r in langid.identify(d, {}).collect()} == {"und"}
    assert langid.identify(d.where("false"), model).count() == 0


def test_langid_learns_all(spark):
    """300 languages; long labelled texts, whose language shows behind their beginning only; rows without text."""
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    word = lambda k, i: alphabet[k % 26] * 2 + alphabet[k // 26 % 26] + str(k) + alphabet[(i * 7 + k) % 26]
    rows = [(k, " ".join(word(k, i) for i in range(40)), f"l{k:03d}") for k in range(300)]
    rows += [(1000 + i, ("shared header of all documents " * 30) + w, lang) for i, (w, lang) in enumerate((("guten tag die leute sind hier " * 60, "xx"), ("bonjour les gens sont la " * 60, "yy")))]
    rows += [(2000 + i, None, "xx") for i in range(900)] + [(3000, "", "zz")]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=5, budget=600_000)
    assert len(model) == 302 and len(model["xx"]) > 1000 and sum(map(len, model.values())) < 700_000
    classifier = langid.Classifier(model)
    assert classifier.predict("guten tag die leute sind hier")[0] == "xx" and classifier.predict("bonjour les gens sont la")[0] == "yy"
    assert sum(classifier.predict(t)[0] == lang for _, t, lang in rows[:300]) > 290


def test_langid_equals_plain_sizes(spark, corpus, texts):
    model = langid.train(corpus, sample=50, dictionary=20_000)
    samples = [*list(texts.values())[:30], "ab " * 40_000, "x"]
    got = {r.doc_id: r for r in langid.identify(docs(spark, samples), model).collect()}
    for i, t in enumerate(samples):
        if not t or not any(c.isalpha() for c in t):
            continue
        sizes = {}
        for lang, content in model.items():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            settings = zstandard.ZstdCompressionParameters.from_level(langid.LEVEL, dict_size=len(content), window_log=max(17, (len(content) + 4000).bit_length()), write_checksum=False, write_content_size=False, write_dict_id=False)
            d.precompute_compress(compression_params=settings)
            sizes[lang] = sum(len(zstandard.ZstdCompressor(dict_data=d, compression_params=settings).compress(t.lower()[a : a + 1000].encode())) for a in range(0, len(t.lower()), 1000))
        assert got[i].lang_pred == min(sizes, key=sizes.get) and got[i].rejected == ((sorted(sizes.values())[1] - min(sizes.values())) / min(sizes.values()) < langid.MARGIN)
    twice = docs(spark, ["the same text", "the same text"], ids=[1, 1])
    assert len({tuple(r) for r in langid.identify(twice, model).collect()}) == 1


# Language model

def plain_scores(texts, model, totals):
    """Log-probabilities of whole texts, a position and a class at a time."""
    net, voc = model.network, model.vocabulary
    softmax = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    out = []
    for t in texts:
        chunk = next(words.columns(pa.array([(t or "").encode().lower().decode()])))
        classes, hashes, total = voc.look_up(chunk)[0].astype(int), chunk.hashes().view(np.int64).tolist(), 0.0
        padded = [lm_scoring.EDGE] * 2 + classes.tolist() + [lm_scoring.EDGE] * 2
        for i, c in enumerate(classes):
            around = [padded[i], padded[i + 1], padded[i + 3], padded[i + 4]]
            h = np.tanh(net.bias + sum(net.embed[n] @ w for n, w in zip(around, net.near)))
            g = c // lm_scoring.MEMBERS
            total += np.log(softmax(h @ net.group + net.group_prior)[g]) + np.log(softmax(h @ net.member[g] + net.member_prior[g])[c % lm_scoring.MEMBERS])
            if c >= lm_scoring.WORDS:
                n = totals.get(hashes[i])
                total += (np.log(n) if n else -(chunk.size[i] + 1) * np.log(256)) - np.log(model.class_counts[c] + 1)
        out.append((len(classes), total))
    return out


def test_hidden_layers_by_both_ways():
    """Scoring sums what each place makes of each class; training multiplies each token anew. Rows add up as one by one."""
    rng = np.random.default_rng(6)
    net = lm_scoring.Network.start(rng.integers(1, 9, lm_scoring.CLASSES).astype(float))
    stream = rng.integers(0, lm_scoring.CLASSES + 1, 500).astype("<u2")
    assert np.allclose(net.hidden(stream, net.placed()), net.read(stream)[1], atol=1e-5)
    rows, want = rng.normal(size=(500, 3)).astype(np.float32), np.zeros((lm_scoring.CLASSES + 1, 3))
    np.add.at(want, stream, rows)
    assert np.allclose(lm_scoring._rows_summed(stream, rows, len(want)), want, atol=1e-5)


@pytest.mark.parametrize("known", [lm_scoring.KNOWN, 1000])
def test_lm_equals_plain_python(spark, corpus, texts, known, monkeypatch):
    """Of the corpus, and of texts with words that it lacks; most words' counts by the join, where few are known."""
    monkeypatch.setattr(lm_scoring.vocabulary_of, "__defaults__", (known,))
    model = lm_scoring.train(corpus)
    totals = {r.word: r.total for r in model.counts.collect()}
    samples = [*list(texts.values())[:6], None, "", "entirelyunheardof wordzzz", *ODD[2:5]]
    got = {r.doc_id: r for r in lm_scoring.score(docs(spark, samples), model).collect()}
    for i, (n, total) in enumerate(plain_scores(samples, model, totals)):
        assert got[i].n_tokens == n and got[i].log_prob == pytest.approx(total, rel=1e-4, abs=1e-3)


def test_lm_is_a_distribution_and_learns(spark, corpus):
    counts = lm_scoring.written(lm_scoring.word_counts(corpus), "counts")
    vocabulary = lm_scoring.vocabulary_of(counts)
    tokens = lm_scoring.written(lm_scoring.tokenised(corpus.select("doc_id", "text"), vocabulary), "tokens")
    n = lm_scoring.class_counts(tokens)
    start = lm_scoring.Network.start(n)
    rounds = [lm_scoring.train_round(tokens, start, k) for k in range(lm_scoring.ROUNDS)]
    assert sum(seen for _, seen in rounds) == n.sum()  # every position is a target in one round
    net = start.like(rounds[0][0])
    hidden = np.repeat(net.read(np.array([1, 2, 3, 4, 5], "<u2"))[1], lm_scoring.CLASSES, axis=0)
    assert np.exp(net.log_probabilities(hidden, np.arange(lm_scoring.CLASSES))).sum() == pytest.approx(1, abs=1e-3)
    in_class = {}
    shared = set(vocabulary.hashes[vocabulary.classes >= 0].view(np.int64).tolist())
    for r in counts.collect():
        if r.word not in shared:
            in_class[0] = in_class.get(0, 0) + r.total
    assert in_class.get(0, 0) == n[lm_scoring.WORDS :].sum()  # n(word) / (n(class) + 1) leaves 1 / (n(class) + 1) for other words
    loss = [lm_scoring._scored(tokens, lm_scoring.Model(vocabulary, x, n, counts)).agg(F.sum("log_prob")).first()[0] for x in (start, net)]
    assert loss[1] > loss[0]


def test_lm_averages_tasks(spark, corpus, monkeypatch):
    monkeypatch.setattr(lm_scoring, "FAN_IN", 2)
    tokens = lm_scoring.written(lm_scoring.tokenised(corpus.select("doc_id", "text").repartition(5, "doc_id"), lm_scoring.vocabulary_of(lm_scoring.word_counts(corpus))), "tokens")
    start = lm_scoring.Network.start(lm_scoring.class_counts(tokens))
    weights, seen = lm_scoring.train_round(tokens.repartition(5, "row"), start, 0)
    parts = [lm_scoring.train_round(tokens.where(F.pmod(F.hash("row"), F.lit(5)) == k).repartition(1), start, 0) for k in range(5)]
    assert seen > 0 and abs(seen - sum(s for _, s in parts)) < 0.05 * seen and np.abs(weights - sum(w * s for w, s in parts) / sum(s for _, s in parts)).max() < 0.05


def test_lm_gradient():
    rng = np.random.default_rng(0)
    net = lm_scoring.Network.start(rng.integers(1, 9, lm_scoring.CLASSES).astype(float))
    wide = lm_scoring.Network(*(getattr(net, f).astype(np.float64) for f in ("embed", "near", "bias", "group", "group_prior", "member", "member_prior")))
    stream = rng.integers(0, 40, 70).astype("<u2")
    stream[30] = lm_scoring.EDGE

    def loss(n):
        target = stream[2:-2].astype(int)
        at = np.flatnonzero(target != lm_scoring.EDGE)
        return -n.log_probabilities(n.read(stream)[1][at], target[at]).mean()

    g, n = wide.gradient(stream)
    assert n == 65
    for name, at in (("embed", (stream[5], 3)), ("near", (1, 4, 5)), ("bias", (7,)), ("group", (3, 0)), ("group_prior", (1,)), ("member", (0, 4, 5)), ("member_prior", (1, 3))):
        x = getattr(wide, name)
        x[at] += 1e-5
        up = loss(wide)
        x[at] -= 2e-5
        down = loss(wide)
        x[at] += 1e-5
        assert getattr(g, name)[at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-7)


def test_lm_blocks_take_arrays_again():
    """After the first block, neither a gradient nor scores take new arrays of a block's size; results are the same."""
    rng = np.random.default_rng(4)
    net, room = lm_scoring.Network.start(rng.integers(1, 9, lm_scoring.CLASSES).astype(float)), lm_scoring.Room()
    into, placed = net.like(np.empty_like(net.flat())), net.placed()
    streams = [rng.integers(0, 300, n + 4).astype("<u2") for n in (2048, 2048, 70, 2048)]
    for i, stream in enumerate(streams):
        tracemalloc.start()
        net.gradient(stream, into, room)
        hidden = net.hidden(stream, placed, room)
        logs = net.log_probabilities(hidden, stream[2:-2].astype(int), room)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert i == 0 or peak < 1_000_000
        plain = net.gradient(stream)[0]
        assert np.array_equal(into.flat(), plain.flat())
        assert np.array_equal(logs, net.log_probabilities(net.hidden(stream, placed), stream[2:-2].astype(int)))


def test_lm_large_scores():
    """Scores beyond what exp takes, and hidden layers at their limits."""
    rng = np.random.default_rng(5)
    net = lm_scoring.Network.start(rng.integers(1, 9, lm_scoring.CLASSES).astype(float))
    net = net.like(net.flat() * np.float32(400))
    stream = rng.integers(0, lm_scoring.CLASSES, 60).astype("<u2")
    with np.errstate(all="raise", under="ignore"):
        hidden, target = net.hidden(stream, net.placed()), stream[2:-2].astype(int)
        got = net.log_probabilities(hidden, target)
        grown = net.gradient(stream)[0]
    assert np.allclose(hidden, net.read(stream)[1], atol=1e-4) and np.isfinite(grown.flat()).all()
    for h, t, x in zip(hidden.astype(float), target, got):
        g, m = divmod(int(t), lm_scoring.MEMBERS)
        both = h @ net.group + net.group_prior, h @ net.member[g] + net.member_prior[g]
        assert x == pytest.approx(sum(z[i] - z.max() - np.log(np.exp(z - z.max()).sum()) for z, i in zip(both, (g, m))), rel=1e-3, abs=1e-2)


def test_lm_places_of_hashes():
    rng = np.random.default_rng(6)
    top = np.uint64(2**64 - 1)
    for held in (rng.integers(0, 2**63, 5000).astype(np.uint64) * np.uint64(2), np.arange(40, dtype=np.uint64), top - np.arange(100, dtype=np.uint64), np.array([7], np.uint64)):
        held = np.unique(held)
        asked = np.concatenate((held, held + np.uint64(1), held - np.uint64(1), rng.integers(0, 2**63, 500).astype(np.uint64), [np.uint64(0), top]))
        vocabulary = lm_scoring.Vocabulary(held, np.full(len(held), -1, np.int32), np.zeros(len(held), np.float32))
        assert np.array_equal(vocabulary.places(asked), np.minimum(np.searchsorted(held, asked), len(held) - 1))


def test_lm_counts_of_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "COUNTED", 3)
    texts = ["a b a", None, "", "B c", "a " * 10, "d"]
    got = sorted(r.total for r in lm_scoring.word_counts(docs(spark, texts)).collect())
    assert got == [1, 1, 2, 12]


def test_lm_scores(spark):
    d = docs(spark, [*ODD, "the cat sat on the mat", "the cat sat on the mat"])
    got = {r.doc_id: r for r in lm_scoring.score(clash(d)).collect()}
    assert [got[i].n_tokens for i in range(4)] == [0, 0, 0, 1] and got[0].log_prob == 0 and got[0].mean_log_prob is None
    assert got[5].n_tokens == 30_000 and got[7].log_prob == pytest.approx(got[8].log_prob) and got[7].log_prob < 0
    assert lm_scoring.score(d.where("false")).count() == 0


# Exact deduplication

def test_exact_dedup(spark):
    d = docs(spark, ["a b", "ab", " a\tb ", None, "", "  ", "é", "e\u0301", "a  b", "a  b"], ids=[5, 1, 2, 7, 6, 9, 3, 4, 8, 8])
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.DigestIndex(spark, buckets=2).ingest(clash(d).withColumn("keep_id", F.lit("x"))).collect())
    assert got == [(1, 2, 5, False), (2, 2, 5, True), (3, 3, 1, True), (4, 4, 1, True), (5, 2, 5, False), (6, 9, 3, False), (7, 9, 3, False), (8, 2, 5, False), (8, 2, 5, False), (9, 9, 3, True)]


@pytest.mark.parametrize("batches", [1, 4])
def test_whole_table(spark, batches):
    long, before = "y " * 200_000, len(spark.catalog.listTables())
    d = docs(spark, ["a b", "ab", " a\tb ", None, "", long, long + " ", "z"], ids=[5, 1, 2, 7, 6, 3, 4, 8])
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.deduplicated(clash(d), batches=batches).collect()}
    assert got == {(5, 2, 3, False), (1, 2, 3, False), (2, 2, 3, True), (7, 6, 2, False), (6, 6, 2, True), (3, 4, 2, False), (4, 4, 2, True), (8, 8, 1, True)}
    assert exact_dedup.deduplicated(d.where("false")).count() == 0 and len(spark.catalog.listTables()) == before


def test_index_is_persistent(spark):
    index = exact_dedup.DigestIndex(spark, buckets=2)
    first = docs(spark, ["a", "b"])
    assert index.ingest(first).where("kept").count() == 2
    again = exact_dedup.DigestIndex(spark, index.location, buckets=64)  # keeps the buckets it was made with
    told = lambda x: sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in again.ingest(x).collect())
    assert again.buckets == 2 and told(docs(spark, ["b", "c"], ids=[10, 11])) == [(10, 1, 1, False), (11, 11, 1, True)] and again.entries().count() == 3
    # a batch that comes again, whole or with another, changes nothing
    assert told(first) == [(0, 0, 1, True), (1, 1, 1, True)] and again.entries().count() == 3
    assert told(first.union(docs(spark, ["d"], ids=[12]))) == [(0, 0, 1, True), (1, 1, 1, True), (12, 12, 1, True)]
    # a longer text that comes later takes over; what is replaced goes when the index is compacted
    assert told(docs(spark, ["a "], ids=[13])) == [(13, 13, 1, True)] and told(first) == [(0, 13, 1, False), (1, 1, 1, True)]
    small = again.compacted()
    assert again.entries().count() == 5 and small.entries().count() == 4 and sorted(r.keep_id for r in small.entries().collect()) == [1, 11, 12, 13]
    assert again.ingest(first.where("false")).count() == 0
    for x in (index, again, small):
        x.close()


def test_append_without_verdicts(spark):
    """A job that dies behind the append and runs again keeps the same documents."""
    index, d = exact_dedup.DigestIndex(spark, buckets=2), docs(spark, ["a", "a ", "b"])
    index.add(exact_dedup.written(exact_dedup.digested(d), "facts"))
    assert sorted(r.doc_id for r in index.ingest(d).where("kept").collect()) == [1, 2] and index.entries().count() == 2
    index.close()


def test_null_ids(spark):
    d = spark.createDataFrame([(None, "a"), (3, "a"), (None, "b")], "doc_id long, text string")
    got = {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup.DigestIndex(spark, buckets=2).ingest(d).collect()}
    assert got == {(None, 3, False), (3, 3, True), (None, None, True)}
    assert {(r.doc_id, r.component_id) for r in simhash.near_duplicates(d).collect()} == {(None, 3), (3, 3), (None, None)}
    assert mixing.mix(d.withColumn("source", F.lit(None).cast("string"))).count() == 3
    assert {r.n_removed for r in substring_dedup.strip_repeats(spark.createDataFrame([(None, "w " * 20), (None, "w " * 20)], "doc_id long, text string")).collect()} == {0}


# BPE

def test_bpe_equals_the_library(spark, texts):
    library = Tokenizer.from_file(queries.tokenizer_path())
    samples = [*ODD, "".join(chr(c) for c in range(1, 700)), "it's  we'll\tDON'T " * 3, "z" * 5000, *list(texts.values())[:60]]
    got = {r.doc_id: r for r in bpe.tokenised(docs(spark, samples), queries.tokenizer_path(), keep=("doc_id", "source")).collect()}
    for i, t in enumerate(samples):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].n_tokens == len(ids), i
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_apart(spark):
    d = docs(spark, ["ab cd", None])
    both = bpe.decode(bpe.encode(clash(d), queries.tokenizer_path()), queries.tokenizer_path())
    assert {(r.doc_id, r.decoded) for r in both.collect()} == {(0, "ab cd"), (1, "")}
    assert bpe.round_trip(d.where("false"), queries.tokenizer_path()).count() == 0


def test_other_tokenizers_are_refused(tmp_path):
    import json

    spec = json.load(open(queries.tokenizer_path(), encoding="utf-8"))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": spec["model"] | {"ignore_merges": True}}, {"added_tokens": [spec["added_tokens"][0] | {"lstrip": True}]}):
        path = tmp_path / "other.json"
        path.write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            bpe.Codec(str(path))


def test_certain_cuts():
    codec = bpe.codec(queries.tokenizer_path())
    data = "some thing qxzj😀".encode()
    parts = codec.fragments(data)
    assert b"".join(parts) == data and all(not codec.inside[a[-1] << 8 | b[0]] for a, b in zip(parts, parts[1:]))
    assert [i for p in parts for i in codec.merged(p)] == codec.merged(data)
    long = b"the and ing" * 40
    assert codec._merged_long([codec.byte_id[b] for b in long]) == [i for i in codec.merged(long)]


# SimHash

def fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
    hashes = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closest(prints):
    """Components by brute force."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("dense", [128, 1])
def test_simhash(spark, corpus, texts, dense):
    prints = {i: fingerprint(t) for i, t in texts.items()}
    want = closest(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(clash(corpus), dense=dense).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in texts}


@pytest.mark.parametrize("dense, layout", [(128, simhash.LAYOUT), (3, simhash.LAYOUT), (128, simhash.WIDE_LAYOUT)])
def test_links_of_any_bits(spark, dense, layout):
    rng = np.random.default_rng(7)
    base = [int(x) for x in rng.integers(0, 1 << 63, 12)]
    prints = {}
    for i in range(160):
        x = base[i % 12]
        for b in rng.choice(64, rng.integers(0, 6), replace=False):
            x ^= 1 << int(b)
        prints[i] = x
    prints[160], prints[161] = 0, 15
    want = closest(prints)
    signed = {i: simhash._signed(p) for i, p in prints.items()}
    nodes = spark.createDataFrame([(p,) for p in set(signed.values())], "fp long")
    stars = {r.a: r.b for r in simhash.components(simhash.links(nodes, layout, dense)).collect()}
    groups = lambda of: {frozenset(j for j in prints if of(j) == of(i)) for i in prints}
    assert groups(lambda i: stars.get(signed[i], signed[i])) == groups(want.__getitem__)


def test_simhash_edges(spark):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs(spark, [None, "", " ", "A b", "a  B", "a b"])).collect()}
    assert got[0] == got[1] == got[2] == ("0" * 16, 0) and got[3] == got[4] == got[5] and got[3][1] == 3
    assert simhash.near_duplicates(docs(spark, ["a"]).where("false")).count() == 0


# Substring deduplication

def stripped(texts, window=13):
    first, out = {}, {}
    split = {i: (t or "").encode().split() for i, t in texts.items()}
    for i in sorted(split):
        for j in range(len(split[i]) - window + 1):
            first.setdefault(tuple(split[i][j : j + window]), i)
    for i, w in split.items():
        gone = np.zeros(len(w), bool)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                gone[j : j + window] = True
        out[i] = (len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


@pytest.mark.parametrize("crowded", [substring_dedup.CROWDED, 1])
def test_substring_dedup(spark, corpus, texts, crowded):
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substring_dedup.strip_repeats(clash(corpus), crowded=crowded).collect()}
    assert got == stripped(texts)


def test_substring_edges(spark):
    rng = np.random.default_rng(2)
    few = [" ".join(rng.choice(list("ab"), 60)) for _ in range(12)]  # many chance matches
    samples = dict(enumerate([*ODD, *few, " ".join(map(str, range(40))), "x " + "\n".join(map(str, range(13))) + "  y", "a " * 5000]))
    df = docs(spark, list(samples.values()))
    got = {r.doc_id: r for r in substring_dedup.strip_repeats(df).collect()}
    assert {i: (r.n_words, r.n_removed, r.text) for i, r in got.items()} == stripped(samples)
    edge = got[len(ODD) + 13]
    assert [(x.start, x.end) for x in edge.removed] == [(1, 14)] and edge.text == "x y"
    twice = substring_dedup.strip_repeats(df.union(df))
    assert {(r.doc_id, r.n_removed) for r in twice.collect()} == {(i, r.n_removed) for i, r in got.items()} and twice.count() == 2 * len(samples)
    assert substring_dedup.strip_repeats(df.where("false")).count() == 0


def test_automaton():
    rng = np.random.default_rng(4)
    passages = [(rng.integers(0, 3, rng.integers(5, 30)).tolist(), d) for d in range(30)]
    automaton, seen = substring_dedup.Automaton(), {}
    for p, d in passages:
        assert automaton.firsts(p, 5) == [seen.get(tuple(p[i : i + 5])) for i in range(len(p) - 4)]
        automaton.add(p, d)
        for i in range(len(p) - 4):
            seen.setdefault(tuple(p[i : i + 5]), d)


# Toxicity

def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op7_toxicity(spark, sf).join(labels, "doc_id").where("held_out").collect()
    hit = [r for r in rows if r.toxic == 1]
    assert len(rows) > 300 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert sum(r.predicted for r in hit) / len(hit) > 0.85 and sum(r.predicted for r in rows if r.toxic == 0) / (len(rows) - len(hit)) < 0.01
    assert sum(bool(r.offending) for r in hit) / len(hit) > 0.8


def test_toxicity_locates_sentences(spark):
    clean = [f"The day number {i} was fine. We went home." for i in range(40)]
    toxic = [f"The day number {i} was fine. You total grubnik {i}! We went home." for i in range(40)]
    d = docs(spark, clean + toxic + [None, "", "no İ words grubnik. Fine then."])
    labels = spark.createDataFrame([(i, int(i >= 40)) for i in range(80)] + [(5, None)], "doc_id long, toxic int")
    model = toxicity.train(d, labels)
    got = {r.doc_id: r for r in toxicity.score(d.withColumn("score", F.lit("clash")), model).collect()}
    assert all(got[i].predicted == int(i >= 40) for i in range(80)) and got[80].score == got[81].score == 0.0 and got[50].lang == "en"
    span = got[50].offending[0]
    assert len(got[50].offending) == 1 and "grubnik" in got[50].text[span.start : span.end] and "home" not in got[50].text[span.start : span.end]
    odd = got[82].offending[0]
    assert "grubnik" in got[82].text[odd.start : odd.end]
    assert {r.score for r in toxicity.score(d, toxicity.train(d, labels.where("toxic = 0"))).collect()} == {0.0}
    assert toxicity.score(d.where("false"), model).count() == 0 and toxicity.noisy_or([0.5, 0.5]) == pytest.approx(0.75)


def test_toxicity_learns_from_arrays(spark, monkeypatch):
    """Features and documents come to the driver as arrays, not as rows of Python's numbers."""
    d = docs(spark, [("a vile word here. " if i % 3 == 0 else "a good word here. ") * 5 for i in range(60)])
    labels = d.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    sizes, collect = [], type(d).collect
    monkeypatch.setattr(type(d), "collect", lambda self: sizes.append(len(rows := collect(self))) or rows)
    model = toxicity.train(d, labels)
    assert max(sizes) <= 1 and model.weights["vile"] > 0
    assert {r.doc_id for r in toxicity.score(d, model).where("predicted = 1").collect()} == set(range(0, 60, 3))


def test_toxicity_whole_texts(spark):
    """The word that tells lies behind 60,000 characters; repeated rows, ids with several labels, other result names."""
    filler = ("Plain words stand here" + " and go on" * 300 + ". ") * 20
    d = docs(spark, [filler + (f"You grubnik {i}!" if i % 2 else f"Fine day {i}.") for i in range(60)] + [None, ""])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, 0)], "doc_id long, toxic int")
    model = toxicity.train(d.union(d), labels)
    rows = toxicity.score(d.union(d), model, names=("a", "b", "c")).collect()
    assert len(rows) == 124 and all(r.b == (r.doc_id % 2 if r.doc_id < 60 else 0) for r in rows) and {str(r.a) for r in rows if r.doc_id > 59} == {"0.0"}
    assert all("grubnik" in r.text[r.c[0].start : r.c[0].end] for r in rows if r.b)


# Url filters

def test_many_rules_and_odd_urls(spark):
    """The shuffled branch gives what the broadcast one gives."""
    rules = spark.createDataFrame([("com", "/" + "a" * n, "block") for n in range(300)] + [("x.com", "/a", "allow"), ("com", "/ab", "block"), ("com", "/ab", "allow"), ("org", "", "block")], "host string, path string, verdict string")
    urls = ["http://x.com/aaa", "http://y.com/ab", "http://x.com/" + "a" * 100_000, "http://x.com/aaa", "http://x.com/aaa?q", "http://b.org", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    one, two = (sorted((tuple(r) for r in url_filters.filter_urls(pages, rules, **kw).collect()), key=lambda r: r[0]) for kw in ({}, {"broadcast_rules": 10, "salts": 3}))
    assert one == two and len(one) == 7
    assert [r[3:] for r in one[:2]] == [("x.com/a", "allow"), ("com/ab", "block")] and one[2][3] == "com/" + "a" * 299 and one[5][3:] == ("org", "block") and one[0][1:] == one[3][1:]


def test_url_rules(spark):
    pages = spark.createDataFrame(list(enumerate([None, "", "no scheme", "http://A.B.Example.ORG/es/x?y#z", "http://example.org/en/12", "http://notexample.org/es/", "x://fr.com/fr/a", "x://fr.com/de/a", "x://a#b://org/", "http://org", "http://b.org/?://com/de/"])), "page_id long, url string")
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.filter_urls(pages.withColumn("host", F.lit("clash")), rules).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.b.example.org", "/es/x", "example.org/es/", "block") and got[4][2:] == ("example.org/en/1", "block") and got[5][2:] == ("org/", "allow")
    assert got[6][2:] == ("com/fr/", "allow") and got[7][2:] == ("com/de/", "block") and got[8] == ("a", "", None, "allow") and got[9] == ("org", "", None, "allow") and got[10] == ("b.org", "/", "org/", "allow")
    assert url_filters.filter_urls(pages, rules.where("false")).where("verdict = 'allow'").count() == 11 and url_filters.filter_urls(pages.where("false"), rules).count() == 0


# Mixing

def test_targets_and_words(spark):
    size = {"a": 100, "b": 3000, None: 900}
    source = lambda i: ["a", "b", "b", None][i % 4]
    d = docs(spark, [f"{i} w  w\n" * (i % 7) for i in range(400)] + [None], source=source)
    got = mixing.mix(clash(d).drop("size")).collect()
    total = sum(r.size for r in got)
    by = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        by.setdefault((r.source_size, round(r.target, 3)), []).append(r)
    assert len(by) == 3 and len(size) == 3 and sum(t for _, t in by) == pytest.approx(total)
    assert all(abs(sum(r.taken for r in rs) - t) <= 1 for (_, t), rs in by.items())
    again = {(r.doc_id, r.taken) for r in mixing.mix(d.repartition(5)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}
    assert mixing.mix(d.where("false")).count() == 0 and {r.taken for r in mixing.mix(docs(spark, [None, ""])).collect()} == {0}


def test_caps(spark):
    sized = spark.createDataFrame([("a", 10), ("b", 1000), (None, 20), ("c", 0)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sized).collect()}
    assert got["a"] == pytest.approx(30) and got[None] == pytest.approx(60) and got["c"] == 0 and got["b"] == pytest.approx(1030 - 90)


@pytest.mark.parametrize("broadcast_sources", [mixing.BROADCAST_SOURCES, 1])
def test_no_source_loses_words(spark, broadcast_sources):
    """Sources of 241, 463 and 1 words, and one without: each takes its target, to the word."""
    d = docs(spark, ["w " * 241, "w " * 400, "w " * 63, "w", None, "w " * 63], ids=[0, 1, 2, 3, 4, 2], source=lambda i: "abbcdb"[i])
    rows = mixing.mix(d.where("doc_id <> 2").union(d.where("doc_id = 2").limit(1)), broadcast_sources=broadcast_sources).collect()
    taken, target = {}, {}
    for r in rows:
        taken[r.source_size] = taken.get(r.source_size, 0) + r.taken
        target[r.source_size] = r.target
    assert set(target) == {241, 463, 1, 0} and all(abs(taken[k] - target[k]) <= 0.5 for k in target) and taken[1] == 3
    twice = mixing.mix(d).collect()  # repeated rows are rows of their own
    assert len(twice) == 6 and sum(r.size for r in twice) == 241 + 400 + 126 + 1


@pytest.mark.parametrize("bits", [1, 5, 17, 40])
def test_slots_reverse_bits(spark, bits):
    points = [0, 1, (1 << bits) - 1, (1 << bits) // 3]
    got = {r.p: r.slot for r in spark.createDataFrame([(p,) for p in points], "p long").select("p", mixing.slot_of(F.col("p"), bits).alias("slot")).collect()}
    assert got == {p: int(f"{p:0{bits}b}"[::-1], 2) for p in points}


def test_schedule_is_even(spark):
    sources = spark.createDataFrame([(0, 0, 70), (1, 70, 30), (2, 100, 0)], "sid long, low long, blocks long")
    got = sorted((r.slot, r.sid, r["rank"]) for r in mixing.schedule(sources, 7).collect())
    assert len(got) == 100 and len({slot for slot, *_ in got}) == 100
    for n in range(1, 101):
        assert abs(sum(s == 0 for _, s, _ in got[:n]) - 0.7 * n) <= 3
    assert all([k for _, s, k in got if s == sid] == list(range(n)) for sid, n in ((0, 70), (1, 30)))
