"""Bounds on memory, hot keys, limits that bind, clashing names, and models against brute force."""

import collections
import hashlib
import itertools
import math
import re
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from alnspark.llm import bpe, common, langid, media, overlap, packing, pii_crf, quality_nbsvm, quality_rules, sharding, simhash, toxicity
from alnspark.llm.components import components


def test_numbers_and_marks_are_no_letters(spark):
    odd = ["²", "½", "①", "Ⅷ", "123 ² ½", "_ - ²", "٣", "́"]
    model = langid.Profiles(["xx"], np.ones((1, langid.DIMENSIONS), np.float32))
    table = spark.createDataFrame([(i, t) for i, t in enumerate([*odd, "a²b", "é"])], "doc_id long, text string")
    got = [r.lang_pred for r in langid.predict(table, model).orderBy("doc_id").collect()]
    assert got == ["und"] * len(odd) + ["xx"] * 2
    assert langid.letters_of("Ab²½c  ⅧÉ _x") == "ab c é x"


def test_languages_learned_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 2)
    rows = [(i, "ab cd", lang) for i, lang in enumerate("aaabbbcc")]
    assert langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), exclude=lambda c: F.lit(False)).names == ["a", "b"]


def test_long_chains_are_decoded_in_bounded_memory(monkeypatch):
    model = pii_crf.Crf.train(rounds=30)
    rng = np.random.default_rng(1)
    pool = [w for words, _ in pii_crf.parse_labelled(pii_crf.LABELLED) for w in words]
    words = [pool[i] for i in rng.integers(0, len(pool), 3000)]
    whole = model.decode([words, ["a"]])
    monkeypatch.setattr(pii_crf, "CELLS", 100)
    monkeypatch.setattr(pii_crf, "STRETCH", 64)
    again = model.decode([words[:50], words, ["a"]])
    assert np.array_equal(again[1], whole[0]) and np.array_equal(again[2], whole[1])
    monkeypatch.undo()
    text = "7 " * 150_000
    tracemalloc.start()
    found = pii_crf.find_spans([text] + ["a 5"] * 255, model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 256 and peak < 200 << 20


def test_shapes_are_of_whole_words():
    assert pii_crf.shape("a" * 100_000 + "7") == "a9" and pii_crf.shape("a1b2c3d4") == "long" and pii_crf.shape("Ab-9.") == "Aa-9."


def test_secrets_without_digits(spark):
    model = pii_crf.Crf.train()
    texts = ["the password = correcthorsebattery for it", "we say that the secret: nobody came, so all went home", "a token of thanks = none"]
    found = [[t[s:e] for _, s, e in added] for t, (_, added) in zip(texts, pii_crf.find_spans(texts, model))]
    assert found == [["correcthorsebattery"], [], []]


def test_crf_training_reaches_the_likeliest_weights():
    """The gradient of the whole likelihood, from all paths of short chains, is near zero."""
    table = ["a secret{x9y8z7w6} b", "the word 5", "token = secret{abc123def456}"]
    model = pii_crf.Crf.train(table, rounds=3000, ridge=0.1)
    gradient = 0.1 * model.weights
    for words, tags in pii_crf.parse_labelled(table):
        rows = [[model.number[f] for f in fs] for fs in pii_crf.chain_features(words)]
        e = model.emissions(words)
        paths = list(itertools.product(range(len(pii_crf.TAGS)), repeat=len(words)))
        score = np.array([model.begin[p[0]] + sum(e[i, t] for i, t in enumerate(p)) + sum(model.moves[a, b] for a, b in zip(p, p[1:])) for p in paths])
        p = np.exp(score - score.max())
        p /= p.sum()
        for own, w in [*zip(paths, p), (tuple(tags), -1.0)]:
            for i, t in enumerate(own):
                np.add.at(gradient[:, t], rows[i], w)
    assert np.abs(gradient).max() < 0.05


def test_kept_words_take_bounded_memory():
    encoder = bpe.PieceEncoder(bpe.default_path("byte_bpe_50k.json"))
    rng = np.random.default_rng(2)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9000, 4000))) for _ in range(100)]
    packed = encoder.encode(texts)
    kept = sum(len(k) for own in (encoder.words, encoder.pieces) for k in [*own, *own.older])
    assert kept < 100_000 and [np.frombuffer(b, "<u4").tolist() for b in packed[:3]] == [encoder.library.encode(t).ids for t in texts[:3]]
    small = bpe._Kept(50, str.encode)
    for i in range(1000):
        assert small[f"w{i}"] == f"w{i}".encode()
    assert len(small) + len(small.older) <= 100


def test_samples_are_bounded_in_rows_and_bytes(spark):
    docs = spark.range(5000).selectExpr("cast(1 as long) as doc_id", "concat('text ', id) as text")
    docs = docs.unionByName(spark.createDataFrame([(i, "y" * 1000) for i in range(2, 40)], "doc_id long, text string"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id long, q int")
    got = common.labelled_sample(docs, labels, "q", 10).collect()
    assert len(got) == 20 and len({r.id for r in got}) == 20
    every = {r.id: r.text for r in common.labelled_sample(docs, labels, "q", 100).collect()}
    assert every[1] == "text 0" and len(every) == 39
    few = common.labelled_sample(docs, labels, "q", 100, most_bytes=3500).collect()
    assert collections.Counter(r.y for r in few) in ({0: 3, 1: 3}, {0: 3, 1: 4})
    assert common.labelled_sample(docs.limit(0), labels, "q", 10).collect() == []


def test_media_of_a_text_that_many_rows_share(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(common, "HOT_KEYS", 4)
    rows = [(i, "same" if i % 2 else f"text {i}") for i in range(60)]
    got = media.media_columns(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), folder=f"file://{tmp_path}/m").collect()
    assert sorted(r.doc_id for r in got) == list(range(60))
    assert len({(r.shard, r.offset, r.media_sha256, r.feature) for r in got if r.doc_id % 2}) == 1
    assert all(r.payload_sha256 == hashlib.sha256(rows[r.doc_id][1].encode().ljust(192)).hexdigest() for r in got)


def test_components_around_hubs(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", 8)
    edges = [(0, i) for i in range(1, 400)] + [(500 + i, 501 + i) for i in range(30)] + [(1000, 399), (2000, 2001)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {got[i] for i in [*range(400), 1000]} == {0} and {got[500 + i] for i in range(31)} == {500} and got[2001] == 2000


def test_tally_and_verification():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    y = x.copy()
    for k in range(3000):
        for b in rng.choice(64, rng.integers(0, 9), replace=False):
            y[k] ^= np.uint64(1) << np.uint64(b)
    tally = [sum(a == b for a, b in zip(int(p).to_bytes(8, "little"), int(q).to_bytes(8, "little"))) for p, q in zip(x, y)]
    assert simhash.tally(x ^ y).tolist() == tally
    bits = [bin(int(p) ^ int(q)).count("1") for p, q in zip(x, y)]
    assert simhash.linked(x ^ y, 4).tolist() == [b <= 4 for b in bits]
    assert min(t for t, b in zip(tally, bits) if b <= 4) == 4  # the guaranteed minimum


def test_lists_known_to_be_long_are_not_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SEEN", 2)
    base = 0x0123456789ABCDEF
    cloud = {base ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)}
    fps = sorted(cloud | {7, 7 ^ 15, 0x7000FF00FF000000})
    got = {r.node: r.label for r in components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), bound=8)).collect()}
    assert {got[f] for f in cloud} == {min(cloud)}
    assert got[7 ^ 15] == 7 and got[7] == 7 and 0x7000FF00FF000000 not in got


def sequences(rows):
    out = collections.defaultdict(list)
    for r in rows:
        out[r.sequence_id].append(r)
    return out.values()


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(256, 64, 100), packing.Limits(256, 3, 255), packing.Limits(64, 64, 0)])
def test_pieces_are_those_of_the_library(spark, limits):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path("byte_bpe_50k.json"))
    rng = np.random.default_rng(4)
    words = ["the", "cat", "naïve", "日本語", "don't", "  ", "\n", "1234", "Edge!!", "x" * 30]
    texts = [None, "", *(" ".join(rng.choice(words, rng.integers(1, 400))) for _ in range(60)), "word " * 3000]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = packing.pack_texts(table, limits=limits, with_ids=True).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.asarray(r.ids, "<u4").tobytes())
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        own = sorted(by[i], key=lambda r: r.start)
        assert [x for r in own for x in r.ids] == ids and [r.start for r in own] == list(itertools.accumulate([0, *(r.length for r in own[:-1])]))
        assert {r.doc_tokens for r in own} == {len(ids)}
    fullest = 0
    for own in sequences(got):
        used = sum(r.length for r in own)
        loss = used - len(own)
        fullest = max(fullest, loss)
        assert used <= limits.tokens and len(own) <= limits.segments and loss <= limits.loss
        assert used == limits.tokens or used & (used - 1) == 0
    if limits.loss < limits.tokens - 1:  # the limit changes the packing, and is nearly used up
        assert 0.6 * limits.loss <= fullest <= limits.loss


def test_severity_equals_the_plain_formulas():
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdef"), rng.integers(3, 10))) for _ in range(200)]
    names = [*words[:20], *(w[:k] + d for w in words[20:60] for k, d in ((3, "-"), (4, "--")) if len(w) > 4)]
    model = toxicity.Ordinal({n: float(rng.uniform(0.1, 2)) for n in names}, np.array([0.5, 1.0, 2.5]))
    for _ in range(50):
        text = " ".join([*rng.choice(words, rng.integers(1, 60)), "Ünïcode!", "12"])
        tokens = [re.sub(r"^[\W\d_]+|[\W\d_]+$", "", w) for w in text.lower().split()]
        tokens = [t for t in tokens if t]
        z = sum(w for f, w in model.weights.items() if "-" not in f and f in tokens)
        for f, w in model.weights.items():
            if "-" in f:
                start = f.rstrip("-")
                n = sum(t.startswith(start) and len(t) > len(start) for t in tokens)
                z += w * (n >= toxicity.LEAST_RATE * len(tokens) and n >= (2 if f.endswith("--") else 1))
        assert math.isclose(model.latent(text), z, abs_tol=1e-9)
        below = [1 / (1 + math.exp(-(c - z))) for c in model.cuts]
        plain = np.diff([0, *below, 1])
        assert np.allclose(model.grades(np.array([z]))[0], plain)
    y = np.array([0] * 40 + [1] * 20 + [2] * 10 + [3] * 10)
    rows = [np.array([0] * (g > 0) + [1] * (g > 1), dtype=np.int64) for g in y.tolist()]
    rows = [r if k % 4 else np.array([2]) for k, r in enumerate(rows)]
    w, cuts = toxicity.fit_ordinal(rows, y, 3, 4, np.ones(len(y)))

    def loss(w, cuts):
        model = toxicity.Ordinal({}, cuts)
        p = model.grades(np.array([w[r].sum() for r in rows]))
        return -np.log(p[np.arange(len(y)), y]).mean()

    near = [loss(np.maximum(w + rng.normal(0, 0.05, 3), 0), np.sort(cuts + rng.normal(0, 0.05, 3))) for _ in range(50)]
    assert loss(w, cuts) <= min(near) + 2e-3 and (np.diff(cuts) > 0).all()


def test_isolation_forest_equals_its_definition():
    x = np.random.default_rng(6).normal(0, 1, (300, 3))
    forest = quality_rules.IsolationForest.fit(x, trees=20, rows=64)

    def path(node, row):
        if forest.feature[node] < 0:
            return forest.path[node]
        return path(forest.child[node][int(row[forest.feature[node]] > forest.split[node])], row)

    mean = [np.mean([path(root, row) for root in forest.roots]) for row in x[:40]]
    harmonic = sum(1 / k for k in range(1, 64))
    assert np.allclose(forest.score(x[:40]), [2 ** (-m / (2 * harmonic - 2 * 63 / 64)) for m in mean], atol=2e-3)
    assert all(forest.path[n] <= 6 + quality_rules.path_norm(64) for n in range(len(forest.path)))


def test_quality_rules_are_fitted_on_all_labelled_rows(spark):
    """Levels and threshold are those of all 3,200 good rows; the last 40 by hash, with rates of their own, count."""
    ids = [r.id for r in spark.range(3200).selectExpr("id", "xxhash64(id) as h").orderBy("h", "id").collect()]
    words = [" ".join(f"w{i}x{k}" for k in range(60 + i)) + " " for i in range(3)]
    texts = {i: words[i % 3].replace(" ", " # " if at >= 3160 else " ") for at, i in enumerate(ids)}
    texts |= {i: words[i % 3].replace(" ", "### ") for i in range(3200, 3300)} | {3300: "few ## words", 3301: "## few"}
    docs = spark.createDataFrame([*texts.items(), (0, texts[0] + "#" * 999), (None, "#")], "doc_id long, text string").repartition(7)
    labels = [(i, int(i < 3200 or i > 3299)) for i in texts] + [(1, 0), (2, 5), (None, 1), (9999, 0)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality_rules.fit(docs, labels)
    good = np.array([quality_rules.statistics(texts[i])[1] for i in range(3200)])
    bad = np.array([quality_rules.statistics(texts[i])[1] for i in range(3200, 3300)])
    last = int(np.ceil((1 - quality_rules.CLEAN_LOSS) * 3200)) - 1
    assert (model.level == np.sort(good, axis=0)[last]).all() and model.level[0] == 0.5
    assert model.threshold == np.sort(model.score(good))[last]
    found = {(r.y, r.code): r["count"] for r in quality_rules.tally(docs, labels).collect()}
    assert found == collections.Counter((y, quality_rules.to_code(r)) for y, rates in ((1, good), (0, bad)) for r in rates)
    codes = np.array([c for _, c in found])
    assert [quality_rules.to_code(r) for r in quality_rules.from_codes(codes)] == codes.tolist()


def test_columns_named_like_outputs_give_way(spark):
    clash = "score double, predicted string, ids string, spans int, fp string, digest int, shard string, grade string, lang_pred int, kept string, `a.b` int"
    names = re.findall(r"(?:^|, )(`a\.b`|\w+)", clash)
    rows = [(i, "some words to read here " * 20) + (None,) * len(names) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + clash)
    fitted = toxicity.Ordinal()
    profiles = langid.Profiles(["xx"], np.ones((1, langid.DIMENSIONS), np.float32))
    outs = {
        "score": quality_nbsvm.score(docs, quality_nbsvm.NbSvm(constant=0.25)), "ids": bpe.encode(docs), "spans": pii_crf.detect(docs),
        "fp": simhash.fingerprints(docs), "grade": toxicity.apply(docs, fitted), "lang_pred": langid.predict(docs, profiles),
        "kept": quality_rules.apply(docs, quality_rules.RuleModel(None, 1.0)),
    }
    for name, out in outs.items():
        got = out.collect()
        assert len(got) == 4 and out.columns.count(name) == 1 and all(r[name] is not None for r in got) and "a.b" in out.columns
    assert packing.pack_texts(docs).count() >= 1 and sharding.assign(docs).count() == 4 and media.media_columns(docs).count() == 4
    assert simhash.keep_first(docs).columns == docs.columns and overlap.keep_first(docs).count() == 1
    dotted = docs.withColumnRenamed("doc_id", "my.id").withColumnRenamed("text", "my.text")
    assert simhash.near_duplicates(dotted, "my.id", "my.text").count() == 4 and media.media_columns(dotted, "my.id", "my.text").columns[-1:] != []


def test_a_rerun_keeps_the_same_of_repeated_rows(spark):
    rows = [(1, "some words", b) for b in "dbca"] + [(2, "Some words", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra string")
    assert [tuple(r) for r in simhash.keep_first(docs.repartition(3)).collect()] == [(1, "some words", "a")]
