import itertools

import numpy as np

import corpus_pipeline
from alnspark.llm import bpe, overlap, pii_crf
from tests.llm.test_overlap import brute_groups

FOLDER = "/root/testdata/sf0.001"


def test_stages_on_the_smallest_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, n, texts = docs.columns, docs.count(), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "packing":
            assert docs.columns == columns and 0 < docs.count() <= n
            n = docs.count()
            texts[name] = {r.doc_id: r.text for r in docs.collect()}
    # no two kept documents link
    kept = list(texts["near_duplicates"].values())
    assert len(set(brute_groups(kept))) == len(kept)
    # masked texts hold no base span, and texts without any span stay as they were
    for i, t in texts["pii"].items():
        assert pii_crf.base_spans(t) == []
        base, added = pii_crf.find_spans([texts["near_duplicates"][i]], pii_crf.Crf.train(rounds=1))[0]
        assert base or added or texts["near_duplicates"][i] == t or "<" in t
    # the tokens of a document's pieces are those of its masked text, then the terminator
    table = bpe.ByteTable(bpe.default_path("byte_bpe_50k.json"))
    pieces = sorted(docs.collect(), key=lambda r: (r.doc_id, r.start))
    assert {r.doc_id for r in pieces} == set(texts["pii"])
    for i, own in itertools.groupby(pieces, key=lambda r: r.doc_id):
        ids = [x for r in own for x in r.ids]
        assert ids[-1] == 0 and table.decode(np.array(ids[:-1])).decode() == (texts["pii"][i] or "")


def test_awkward_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows, and a column more."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    extra = [(None,) * len(docs.columns), *[tuple(r) for r in docs.limit(2).collect()] * 2]
    long = dict(docs.first().asDict(), doc_id=10**9, text="many words of no great sense " * 20_000)
    rows = spark.createDataFrame([*extra, tuple(long[c] for c in docs.columns)], docs.schema)
    docs = docs.unionByName(rows).selectExpr("*", "'x' as score")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        if name != "packing":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), docs.schema)
    assert out.count() >= docs.count()


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("false")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        assert out.count() == 0
        docs = out if name != "packing" else docs


def test_near_copies_are_caught(spark):
    """Of copies at a Jaccard similarity of 0.8 or more, every one is linked."""
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(4000)]
    texts = []
    for _ in range(30):
        own = list(rng.choice(words, 150))
        texts.append(" ".join(own))
        own[40] = own[90] = "changed"
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert sorted(r.doc_id for r in overlap.keep_first(docs).collect()) == list(range(0, 60, 2))
