import random

import numpy as np
import pytest

import corpus_pipeline
from alnspark.llm import overlap, simhash


def near_copies(seed=5):
    """Texts of 20 to 120 words with copies that differ in some words, and one line that all share."""
    rng = random.Random(seed)
    texts = []
    for _ in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(20, 120))]
        texts.append(" ".join(words))
        for changes in (1, 2, 3, 5):
            own = list(words)
            for at in rng.sample(range(len(own)), changes):
                own[at] = f"x{rng.randrange(5000)}"
            texts.append(" ".join(own))
        texts.append(" ".join(words).upper() + " this line is in all of them")
    return texts + [t + " and one common line of many words follows here" for t in texts[::4]] + ["one two", "ONE  two", "", " ", None]


def brute_groups(texts):
    """The components of all pairs at a Jaccard similarity of 0.8 and of equal sets."""
    sets = []
    for t in texts:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    group = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or (x | y and 10 * len(x & y) >= 8 * len(x | y)):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    return group


@pytest.mark.parametrize("block, spread", [(2048, 64), (2, 1)])
def test_links_are_those_of_all_pairs(spark, monkeypatch, block, spread):
    """With small blocks and copies of sets as well."""
    monkeypatch.setattr(overlap.links, "__defaults__", (block,))
    monkeypatch.setattr(overlap, "SPREAD", spread)
    texts = near_copies()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    kept = sorted(r.doc_id for r in overlap.keep_first(docs).collect())
    assert kept == sorted(set(brute_groups(texts)))


def test_forests_span_all_near_pairs():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, (6, 8), dtype=np.uint64)
    parity = np.repeat(base, 9, axis=0)
    for k in range(len(parity)):
        for b in rng.choice(512, rng.integers(0, 30), replace=False):
            parity[k, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    n, label = rng.integers(150, 190, len(parity)), np.arange(len(parity))
    label[::5] = 0

    def groups(pairs):
        group = {int(x): int(x) for x in label}
        for i, js in pairs:
            for j in js:
                a, b = sorted((group[int(label[i])], group[int(label[j])]))
                group = {k: a if v == b else v for k, v in group.items()}
        return group

    forest, every = list(overlap._forest(n, parity, label)), list(overlap._crossing(n, parity, label))
    assert groups(forest) == groups(every) and sum(len(j) for _, j in forest) < len(set(label.tolist()))
    plain = sum(int(label[i] != label[j] and 5 * n[j] >= 4 * n[i] and 4 * n[j] <= 5 * n[i]
                    and 9 * int(np.bitwise_count(parity[i] ^ parity[j]).sum()) <= n[i] + n[j]) for i in range(len(n)) for j in range(i + 1, len(n)))
    assert sum(len(j) for _, j in every) == plain


def test_the_stage_drops_near_copies_that_are_far_in_simhash(spark):
    texts = near_copies()
    base = [t for t in texts[::6] if t][:12]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    far = [bin(simhash.fingerprint(b) ^ simhash.fingerprint(t)).count("1") for b, t in zip(base, texts[1::6])]
    assert max(far) > simhash.BITS
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert kept == sorted(set(brute_groups(texts)))


def test_repeated_and_missing_ids(spark):
    text = " ".join(f"v{i}" for i in range(60))
    rows = [(1, text), (1, text + " more"), (1, "other words stand here and no copy"), (None, text + " less"), (None, "alone in the world of words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = overlap.keep_first(docs).collect()
    assert len(out) == 3 and {r.text for r in out} >= {rows[2][1], rows[4][1]}


def test_prefix_counts_shingles_often_seen_last():
    s = np.arange(1, 11, dtype=np.uint64)
    often = np.array([1, 2], np.uint64)
    assert overlap.prefix(s, often, np.array([9, 5])).tolist() == [3, 4, 5]
    assert overlap.prefix(s, often[:0], np.zeros(0)).tolist() == [1, 2, 3]
    assert overlap.prefix(s[:0], often, np.array([9, 5])).tolist() == []


def test_bounds_drop_no_pair_at_the_threshold():
    rng = np.random.default_rng(1)
    for n in (5, 40, 300, 1030, 5000):
        common = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        one, other = (np.unique(np.concatenate([common, rng.integers(0, 2**64, n // 8, dtype=np.uint64)])) for _ in range(2))
        assert overlap.alike(one.data, other.data)
        assert overlap.may_be_alike(overlap.wide(one), overlap.wide(other))
        assert not overlap.may_be_alike(overlap.wide(one), overlap.wide(one + np.uint64(1))) or n == 5
        far = np.bitwise_count(np.frombuffer(overlap.parity(one, 512), np.uint8) ^ np.frombuffer(overlap.parity(other, 512), np.uint8)).sum()
        assert 9 * int(far) <= len(one) + len(other)
