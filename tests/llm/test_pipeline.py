"""The pipeline's stages on small tables: what goes, what stays, and odd rows."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P

WORDS = [f"{a}{b}" for a in ("stone", "river", "cloud", "field", "table", "horse") for b in ("s", "ly", "ing", "er", "ed")]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def clean(seed, n=80):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


PASSAGE = clean(999, 40)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    texts = [(i, clean(i) if i % 5 else clean(i, 60) + " moronic morons moronish moronly " * 3) for i in range(300)]
    first = clean(1000)
    odd = [
        (1000, first), (1001, first), (1002, first + " tail"), (1003, None), (1004, ""), (1005, clean(2005, 40) + " " + PASSAGE + " " + clean(2006, 40)), (1006, "call +1 555 123 4567 or a@b.com " + clean(2007)),
        (1006, clean(2008)), (1000, first), (None, clean(2009)), (None, None), (1007, clean(2010, 30_000)),
    ]
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in texts + odd]
    write = lambda data, schema, name: spark.createDataFrame(data, schema).coalesce(2).write.parquet(f"{folder}/{name}.parquet")
    write(rows, SCHEMA, "documents")
    write([(i, 1, int(i % 5 == 0)) for i in range(300)], "doc_id bigint, quality int, toxic int", "labels")
    write([(1, PASSAGE)], "item_id bigint, text string", "benchmark")
    return str(folder)


def stage(name):
    return dict(P.STAGES)[name]


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = stage("toxicity")(spark, docs, sf_dir).cache()
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and len([i for i in range(0, 300, 5) if i in ids]) <= 6 and len([i for i in range(300) if i % 5 and i in ids]) >= 234 and {1003, 1004, None} <= ids
    apart = stage("near copies")(spark, kept, sf_dir).cache()
    left = [r.doc_id for r in apart.collect()]
    assert left.count(1000) == 1 and 1001 not in left and 1002 not in left and left.count(1006) == 2 and left.count(None) == 2 and {1003, 1004, 1007} <= set(left)
    free = stage("decontamination")(spark, apart, sf_dir)
    assert set(left) - {r.doc_id for r in free.collect()} == {1005}
    hidden = stage("personal data")(spark, free, sf_dir).cache()
    row = next(r for r in hidden.collect() if r.doc_id == 1006 and "call" in r.text)
    assert hidden.columns == docs.columns and "555 123" not in row.text and "a@b.com" not in row.text and row.n_chars == len(row.text)
    out = stage("tokens")(spark, hidden, sf_dir)
    assert out.count() == hidden.count() and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)


def test_whole_run_equals_its_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, f in P.STAGES:
        docs = f(spark, docs, sf_dir)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(P.run(spark, sf_dir)) == key(docs)


def test_extra_columns_and_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 40 or doc_id > 999")
    more = docs.withColumns({c: F.lit("x") for c in ("class", "root", "label", "item_id", "n", "score", "bit", "_other")})
    for name, f in P.STAGES[:-1]:
        got = f(spark, more, sf_dir)
        assert got.columns == more.columns, name
        assert got.where("root = 'x' and class = 'x' and label = 'x'").count() == got.count() > 0, name
    for name, f in P.STAGES:
        assert f(spark, docs.where("false"), sf_dir).count() == 0, name
