"""The ten operators against brute force, on small tables with awkward rows."""

import base64
import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
import xxhash

from alnspark.llm import bpe, common, langid, media, packing, pii_crf, quality_nbsvm, quality_rules, sharding, simhash, toxicity
from alnspark.llm.components import components

LONG = "lorem ipsum dolor " * 4000
TEXTS = [None, "", " ", "\n\n", "one", "The cat sat on the mat. " * 3, LONG, "x" * 30000, "été ß 日本語 \U0001f600 don't  stop\n\t now ", "1234 @@ ###"]
SCHEMA = "doc_id long, text string, score double, fp string, ids int, __text string"


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, repeated rows, and columns named like those of the operators."""
    rows = [(i, t, None, None, None, None) for i, t in enumerate(TEXTS)]
    rows += [(3, "one", None, None, None, None), (None, "one", None, None, None, None), (20, "one", None, None, None, None)] + rows[-1:]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def corpus(spark, seed=0, n=400):
    """Documents with labels: clean text, symbol junk, and toxic words."""
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefghijkl"), rng.integers(3, 9))) for _ in range(600)]
    docs, labels = [], []
    for i in range(n):
        own = list(rng.choice(words, rng.integers(60, 120)))
        bad, toxic = i % 7 == 0, i % 5 == 0
        if toxic:
            own[3] = own[9] = "vilestuff" + str(rng.choice(["ing", "er", "x"]))
        if bad:
            own = [w + "###" for w in own]
        docs.append((i, " ".join(own)))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_nbsvm(spark, docs, none):
    table, labels = corpus(spark)
    model = quality_nbsvm.fit(table, labels)
    got = {r.doc_id: r for r in quality_nbsvm.score(table, model).withColumn("held_out", quality_nbsvm.held_out()).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out]
    assert np.mean([got[i].predicted == int(i % 7 != 0) for i in held]) > 0.95
    out = quality_nbsvm.score(docs, model).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert quality_nbsvm.score(none, model).collect() == []
    assert quality_nbsvm.fit(none, labels.filter("false")).score("x") == 0.5


def test_dual_descent_finds_the_minimum():
    rng = np.random.default_rng(1)
    rows = [np.sort(rng.choice(20, 6, replace=False)) for _ in range(60)]
    y = np.array([1.0 if (r < 10).sum() > 3 else -1.0 for r in rows])
    values, cost = rng.uniform(0.5, 1.5, 20), np.full(60, 0.3)

    def loss(w):
        return 0.5 * w @ w + sum(c * max(0, 1 - t * (w[r] @ values[r])) for r, t, c in zip(rows, y, cost))

    w = quality_nbsvm.descend(rows, values, y, cost, 500, 0)
    assert all(loss(w) <= loss(w + rng.normal(0, s, 20)) + 1e-6 for s in (0.001, 0.01, 0.1) for _ in range(30))


@pytest.fixture(scope="module")
def reference_encoding():
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken(docs, none, reference_encoding):
    got = bpe.encode(docs.select("doc_id", "text")).collect()
    for r in got:
        text = r.text or ""
        assert list(r.ids) == reference_encoding.encode_ordinary(text)
        assert all(s < e for s, e in zip(r.starts, r.ends)) and (not r.ids or r.ends[-1] == len(text))
    back = bpe.decode(bpe.encode(docs.select("doc_id", "text"))).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back)
    for r in bpe.digests(docs.select("doc_id", "text")).collect():
        ids = reference_encoding.encode_ordinary(r.text or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.digests(none).collect() == [] and set(bpe.encode(docs).columns) >= {"score", "fp", "ids"}


def test_bpe_blanks(reference_encoding):
    encoder = bpe.PieceEncoder(bpe.default_path("byte_bpe_50k.json"))
    texts = ["".join(c) for n in range(1, 6) for c in itertools.product("a \n'　s1", repeat=n)][:9000]
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == [reference_encoding.encode_ordinary(t) for t in texts]
    kept = bpe._Kept(2, str.encode)
    assert [kept[x] for x in ("a", "bb", "ccc", "a", "bb", "a")] == [b"a", b"bb", b"ccc", b"a", b"bb", b"a"] and len(kept) + len(kept.older) <= 4


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_spans(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0 if digits else False
            ok = [True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else True, 16 <= len(digits) <= 19 and luhn, 8 <= len(digits) <= 15][k]
            if ok:
                out.append((k, m.start(), m.end()))
    return out


def test_base_spans_equal_the_patterns():
    rng = np.random.default_rng(2)
    pool = list("ab@@..--+  ()019") + ["255.", "4111111111111111", "@a.b", "1.2.3.4", "+1 (017) 555-7713"]
    for _ in range(3000):
        text = "".join(rng.choice(pool, rng.integers(1, 40)))
        assert pii_crf.base_spans(text) == brute_spans(text), text
    assert pii_crf.base_spans("a" * 200_000 + "@" * 2000 + "1" * 100_000) is not None  # in linear time


def test_crf(spark, docs, none):
    model = pii_crf.Crf.train()
    right = total = 0
    for words, tags in pii_crf.parse_labelled(pii_crf.LABELLED):
        right += int((model.decode([words])[0] == tags).sum())
        total += len(tags)
    assert right / total > 0.98
    # Viterbi against all paths
    words = ["token", "=", '"04dbebab91ab85687d33eeaaf9ac699e1188f962"', "x"]
    e = model.emissions(words)
    best = max(itertools.product(range(len(pii_crf.TAGS)), repeat=4), key=lambda p: model.begin[p[0]] + sum(e[i, t] for i, t in enumerate(p)) + sum(model.moves[a, b] for a, b in zip(p, p[1:])))
    assert model.decode([words, ["a"]])[0].tolist() == list(best)
    text = 'é mail a.b@c.de the token = "681c09b8e90e7e8c9575180f595f646cf2969054" in 1999'
    got = pii_crf.detect(spark.createDataFrame([(1, text)], "doc_id long, text string"), model=model).first()
    assert (got.n_email, got.n_added) == (1, 1) and got.spans.startswith("email:7:15,secret:")
    masked = pii_crf.mask(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), model=model).orderBy("doc_id").collect()
    assert masked[0].text == 'é mail <EMAIL> the token = "<SECRET>" in 1999' and masked[1].text is None
    assert pii_crf.detect(docs, model=model).count() == docs.count() and pii_crf.detect(none, model=model).collect() == []


def test_packing(docs, none):
    encoder = bpe.PieceEncoder(bpe.default_path("byte_bpe_50k.json"))
    got = packing.pack_texts(docs, with_ids=True).collect()
    pieces = collections.defaultdict(list)
    for r in got:
        pieces[r.sequence_id].append(r)
        raw = np.asarray(r.ids, "<u4").tobytes()
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(raw)
    for own in pieces.values():
        used = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == used
            used += r.length
        assert used == 1024 or used & (used - 1) == 0
        assert len(own) <= 64
    whole = collections.Counter()
    for r in docs.collect():
        n = len(encoder.encode([r.text or ""])[0]) // 4 + 1
        whole[r.doc_id] += n
    packed = collections.Counter()
    for r in got:
        packed[r.doc_id] += r.length
    assert whole == packed and packing.pack_texts(none).collect() == []


def test_pack_examples_keeps_limits(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(t), int(rng.integers(0, t + 1))) for i, t in enumerate(rng.integers(1, 400, 3000))]
    limits = packing.Limits(tokens=512, segments=4, loss=300)
    table = spark.createDataFrame([r for r in rows if r[2] <= 300], "id long, t long, loss long")
    got = packing.pack_examples(table, "t", "loss", limits).collect()
    assert sorted(r.id for r in got) == sorted(r[0] for r in rows if r[2] <= 300)
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append(r)
    assert all(sum(r.t for r in x) <= 512 and sum(r.loss for r in x) <= 300 and len(x) <= 4 for x in by.values())
    least = max(sum(r.t for r in got) / 512, sum(r.loss for r in got) / 300, len(got) / 4)
    assert len(by) < 1.25 * least + 4
    with pytest.raises(Exception, match="exceeds the limits"):
        packing.pack_examples(spark.createDataFrame([(1, 9, 9)], "id long, t long, loss long"), "t", "loss", packing.Limits(4, 4, 4)).collect()


def brute_fingerprint(text):
    words = re.findall("[^\\x20\\x09-\\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    label = list(range(len(fps)))
    for i, j in itertools.combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= 4 and label[i] != label[j]:
            a, b = sorted((label[i], label[j]))
            label = [a if x == b else x for x in label]
    return label


def test_simhash(docs, none):
    rows = docs.collect()
    got = simhash.near_duplicates(docs).collect()
    fps = [brute_fingerprint(r.text or "") for r in rows]
    label = brute_components(fps)
    least = {k: min((r.doc_id for r, x in zip(rows, label) if x == k and r.doc_id is not None), default=None) for k in set(label)}
    expected = sorted((str(r.doc_id), f"{f:016x}", least[k]) for r, f, k in zip(rows, fps, label))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == expected
    assert simhash.near_duplicates(none).collect() == []
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(label))
    assert simhash.keep_first(docs.filter("doc_id IS NULL")).count() == 1


def test_lookup_equals_a_join(spark, monkeypatch):
    """Hot keys (here: over a tenth of the rows), rare ones, keys without a partner, and no rows."""
    monkeypatch.setattr(common, "HOT_KEYS", 10)
    keys = [1] * 60 + [2] * 11 + [3] * 10 + list(range(4, 23))
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i int")
    table = spark.createDataFrame([(k, k * k, n) for k, n in collections.Counter(keys).items() if k != 5] + [(99, 0, 0)], "k long, v long, n long")
    got = common.lookup(rows, table, "k", "n", len(keys))
    assert sorted(map(tuple, got.collect())) == sorted((k, i, k * k) for i, k in enumerate(keys) if k != 5)
    assert common.lookup(rows.limit(0), table.limit(0), "k", "n", 0).collect() == []


@pytest.mark.parametrize("bound", [1 << 15, 8])
def test_links_lose_nothing(spark, bound):
    """Chains and clouds of fingerprints; with a low bound the long lists go the other way."""
    rng = np.random.default_rng(4)
    fps = {0, (1 << 64) - 1}
    for _ in range(6):
        x = int(rng.integers(0, 1 << 63)) * 2
        for _ in range(25):
            fps.add(x)
            for b in rng.choice(64, rng.integers(1, 7), replace=False):
                x ^= 1 << int(b)
    fps = sorted(fps)
    table = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    found = {r.node: r.label for r in components(simhash.links(table, bound=bound)).collect()}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    label = brute_components(fps)
    groups = collections.defaultdict(list)
    for s, k in zip(signed, label):
        groups[k].append(s)
    assert {s: found.get(s, s) for s in signed} == {s: min(g) for g in groups.values() for s in g}


def test_media(spark, docs, none, tmp_path):
    got = media.media_columns(docs, folder=f"file://{tmp_path}/media").collect()
    assert len(got) == docs.count() and all(r.width == 192 and r.bits == 8 and r.height * 192 == r.payload_bytes for r in got)
    texts = collections.Counter((r.doc_id, r.text or "") for r in docs.collect())
    expected = collections.Counter()
    for (i, t), n in texts.items():
        raw = t.encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        mean = sum(payload) / len(payload)
        spread = (sum((b - mean) ** 2 for b in payload) / len(payload)) ** 0.5
        cuts = [len(payload) * k // 64 for k in range(65)]
        bright = "".join("1" if sum(payload[a:b]) / (b - a) > mean else "0" for a, b in zip(cuts, cuts[1:]))
        expected[i, len(raw), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), f"{mean:.3f};{spread:.3f};{int(bright, 2):016x}"] += n
    assert collections.Counter((r.doc_id, r.n_bytes, r.payload_sha256, r.tail_crc32, r.feature) for r in got) == expected
    import tarfile

    for r in got:
        with open(f"{tmp_path}/media/{r.shard}", "rb") as f:
            f.seek(r.offset)
            assert hashlib.sha256(f.read(r.length)).hexdigest() == r.media_sha256 == r.digest
    for shard in {r.shard for r in got}:
        with tarfile.open(f"{tmp_path}/media/{shard}") as t:
            assert len(set(t.getnames())) == len(t.getnames())
            assert all(m.name == hashlib.sha256(t.extractfile(m).read()).hexdigest() + ".png" for m in t.getmembers())
    assert media.media_columns(none).collect() == []
    with pytest.raises(ValueError):
        media.png_header(b"x" * 33)


def test_toxicity(spark, docs, none):
    table, labels = corpus(spark)
    model = toxicity.fit(table, labels)
    fresh, _ = corpus(spark, seed=9)
    got = toxicity.apply(fresh, model).collect()
    assert np.mean([r.toxic == (r.doc_id % 5 == 0) for r in got]) > 0.98
    assert all(0 <= r.severity <= 3 for r in got) and (np.diff(model.cuts) >= 0).all()
    low, high = model.grades(np.array([-3.0, 9.0]))
    assert low @ np.arange(4) < high @ np.arange(4) and abs(low.sum() - 1) < 1e-9
    assert toxicity.apply(docs, model).count() == docs.count() and toxicity.apply(none, model).collect() == []
    assert not any(r.toxic for r in toxicity.apply(docs, toxicity.fit(none, labels)).collect())


def test_language_id(spark, docs, none):
    rng = np.random.default_rng(5)
    parts = {"xx": ["ka", "to", "mi", "ra"], "yy": ["sch", "ung", "ber", "ei"], "zz": ["ción", "os", "ll", "ña"]}
    rows = []
    for i in range(300):
        lang = list(parts)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(parts[lang], 3)) for _ in range(30)), lang if i % 11 else None))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(table)
    got = langid.predict(table, model).collect()
    assert np.mean([r.lang_pred == list(parts)[r.doc_id % 3] for r in got]) == 1.0
    bundler, text = langid.Bundler(), "Abc ab"
    last, middle, first = bundler.table
    code = [ord(c) for c in " abc ab "]
    brute = sum(first[a] * middle[b] * last[c] for a, b, c in zip(code, code[1:], code[2:]))
    assert np.array_equal(bundler.bundle(text), brute)
    out = {r.text: r for r in langid.predict(docs, model).collect()}
    assert all(out[t].lang_pred == "und" and out[t].score == 0 for t in (None, "", " ", "1234 @@ ###"))
    assert all(0 <= r.score <= 1 for r in out.values()) and langid.predict(none, model).collect() == []
    assert langid.fit(none.selectExpr("doc_id", "text", "fp as lang")).names == []


def test_sharding(spark, docs, none):
    got = sharding.assign(docs, 3).collect()
    rows = docs.collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted(
        (str(r.doc_id), len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows)
    for s in range(3):
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))
    assert len({r.shard for r in got if r.text_crc32 == zlib.crc32(b"one")}) == 1
    assert sharding.assign(none).collect() == []
    sizes = [(i, int(x)) for i, x in enumerate(np.random.default_rng(6).integers(1, 100, 200))]
    where, load = sharding.longest_first(sizes, 5), [0] * 5
    for unit, size in sorted(sizes, key=lambda x: (-x[1], str(x[0]))):
        assert load[where[unit]] == min(load)
        load[where[unit]] += size
    table = spark.range(2000).selectExpr("id as doc_id", "repeat('x', cast(id % 97 as int)) as text")
    loads = collections.Counter()
    for r in sharding.assign(table).collect():
        loads[r.shard] += r.size
    assert max(loads.values()) - min(loads.values()) < 0.1 * sum(loads.values()) / 8


def brute_rules(text):
    words = [w for w in re.split("[\\x20\\x09-\\x0D]+", text) if w]
    windows = list(zip(words, words[1:], words[2:]))
    tally = collections.Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if tally[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\\x20\\x09-\\x0D]", line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), dup, len(hit)]


def test_quality_rules(spark, docs, none):
    rng = np.random.default_rng(7)
    for _ in range(500):
        text = "".join(rng.choice(list("ab #|\n\t\x0bé\x85"), rng.integers(0, 60)))
        assert quality_rules.statistics(text)[0] == brute_rules(text)
    table, labels = corpus(spark)
    model = quality_rules.fit(table, labels)
    got = quality_rules.apply(table, model).collect()
    assert np.mean([r.kept == (r.doc_id % 7 != 0) for r in got]) > 0.98
    for r in quality_rules.apply(docs, model).collect():
        assert [r[c] for c in quality_rules.COUNTS] == brute_rules(r.text or "")
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    assert quality_rules.apply(none, model).collect() == []
    bare = quality_rules.fit(none, labels)
    assert all(r.kept != r.base_failed for r in quality_rules.apply(docs, bare).collect())


def test_isolation_forest_finds_what_is_apart():
    x = np.vstack([np.random.default_rng(8).normal(0, 0.1, (500, 3)), [[3, 3, 3]]])
    assert quality_rules.IsolationForest.fit(x).score(x).argmax() == 500
