"""Operators against plain loops on small tables, and odd rows: very long texts, repeats, clashing columns."""

import random
import zlib
from os.path import commonprefix

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from quillspark.llm import ef_lm, page_diff, rule_ensemble, suffix_rules, surrogates, token_shards, toxicity


def text(rng, n):
    return " ".join("".join(rng.choice("abcdeéß 1.\n") for _ in range(rng.randrange(1, 9))) for _ in range(n))


def test_token_shards_hold_the_librarys_ids(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, text(rng, rng.randrange(1, 300))) for i in range(40)] + [(100, "long " * 30_000)]
    ranks = token_shards.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    path = str(tmp_path / "shards")
    out = token_shards.materialise(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, path, seq=32, records=50)
    n = out.count()
    got = {}
    for doc, number, ids in token_shards.read_slots(path, 0, n, seq=32, records=50):
        got.setdefault(doc, {})[number] = ids.tolist()
    for i, t in rows:
        flat = [x for k in sorted(got[i]) for x in got[i][k]]
        assert flat == [*library.encode_ordinary(t), len(ranks)] and sorted(got[i]) == list(range(len(got[i])))


def page(rng, site):
    shell = [f"<div>{site} {k}</div>" for k in range(rng.randrange(1, 4))]
    body = [f"<p>{rng.choice('abcdefgh')}{rng.randrange(30)}</p>" for _ in range(rng.randrange(1, 8))]
    inner = "".join(shell + body) + ("<footer>foot</footer>" if rng.random() < 0.5 else "")
    return f"<html><body>{'<article>' + inner + '</article>' if rng.random() < 0.3 else inner}</body></html>"


def test_pages_against_all_neighbours(spark):
    rng = random.Random(2)
    rows = [(i, f"http://h{rng.randrange(4)}.example/{rng.choice('ab')}/{rng.randrange(40)}", None) for i in range(120)]
    rows = [(i, u, page(rng, u[7:9])) for i, u, _ in rows] + [(900, None, "<p>x"), (901, None, None)]
    order = sorted((page_diff.order_key(u, i), i, page_diff.page_lines(h)) for i, u, h in rows)
    want = {}
    for n, (key, i, lines) in enumerate(order):
        host, path, _ = key.split("\x01", 2)
        near = []
        for m in (n - 1, n + 1):
            if 0 <= m < len(order) and order[m][0].split("\x01", 2)[0] == host:
                near.append((-len(commonprefix([path, order[m][0].split("\x01", 2)[1]])), m))
        other = None
        for _, m in sorted(near, key=lambda x: x[0]):
            found = order[m][2]
            if any(z == page_diff.MAIN for _, z in lines) or [t for t, z in found if z != page_diff.OUT] != [t for t, z in lines if z != page_diff.OUT]:
                other = found
                break
        want[i] = page_diff.main_text(lines, other)
    for ranges in (1, 5, 40):
        got = {r.page_id: r.text for r in page_diff.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string"), ranges=ranges).collect()}
        assert got == want


def slow_bag(t):
    words = toxicity.letters(t)
    out = {}
    for w in words:
        owner, buckets = toxicity.subwords([w])
        for b in buckets.tolist():
            out[b] = out.get(b, 0.0) + 1 / len(buckets) / len(words)
    return out


def test_bags_and_scores_against_loops(spark):
    rng = random.Random(3)
    rows = [(i, text(rng, rng.randrange(1, 60))) for i in range(60)] + [(99, ""), (100, None), (101, "wordly ab " * 50_000)]
    for _, t in rows:
        b, w = toxicity.bag(t)
        assert dict(zip(b.tolist(), w)) == pytest.approx(slow_bag(t))
    model = toxicity.Model(np.random.default_rng(1).normal(size=toxicity.BUCKETS), 0.3)
    docs = spark.createDataFrame(rows + rows[:3], "doc_id bigint, text string").selectExpr("*", "1 as score", "2 as predicted")
    got = [(r.doc_id, r.score, r.held_out) for r in toxicity.score(docs, model).collect()]
    assert len(got) == len(rows) + 3
    for i, s, held in got:
        b = slow_bag(dict(rows)[i])
        assert s == pytest.approx(1 / (1 + np.exp(-(sum(model.value[k] * v for k, v in b.items()) + 0.3))), abs=1e-5) and held == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_rules_against_loops(spark):
    rng = random.Random(4)
    data = np.array([rule_ensemble.statistics(text(rng, rng.randrange(1, 80))) for _ in range(200)])
    model = rule_ensemble.train(data, (data[:, 0] > 40).astype(int))
    assert len(model.rules) > 0 and ((model.log_odds(data) > 0) == (data[:, 0] > 40)).mean() > 0.95


def test_odd_rows_everywhere(spark):
    """Very long texts, repeats and clashing names don't crash and don't change other rows."""
    rng = random.Random(5)
    base = [(1, text(rng, 80)), (2, ""), (3, None), (None, text(rng, 60)), (4, "Mr John Smith " * 20_000), (1, "again " * 60)]
    docs = spark.createDataFrame(base, "doc_id bigint, text string")
    more = docs.selectExpr("*", *[f"7 as {c}" for c in ("n_words", "kept", "score", "n_tokens", "part", "key", "label", "word", "m")])
    for f in (suffix_rules.judge, lambda d: surrogates.pseudonymise(d.select("doc_id", "text")), lambda d: rule_ensemble.score(d, rule_ensemble.RuleModel((), (), 0.0))):
        key = lambda df: sorted(map(str, df.collect()))
        assert key(f(docs)) == key(f(more)) and f(docs.where("false")).count() == 0
    assert surrogates.pseudonymise(more).columns == more.columns


def test_language_model_on_odd_rows(spark, tmp_path):
    rng = random.Random(6)
    base = [(i, text(rng, 30)) for i in range(30)] + [(2, "word " * 100_000), (None, None), (40, ""), (3, "again")]
    docs = spark.createDataFrame(base, "doc_id bigint, text string")
    more = docs.selectExpr("*", *[f"7 as {c}" for c in ("score", "n_tokens", "part", "keys", "held_out")])
    a = sorted(map(str, ef_lm.fit_and_score(docs, str(tmp_path / "a")).collect()))
    assert a == sorted(map(str, ef_lm.fit_and_score(more, str(tmp_path / "b")).collect())) and len(a) == len(base)
    assert ef_lm.fit_and_score(docs.where("false"), str(tmp_path / "c")).count() == 0
    twice = [r.score for r in ef_lm.fit_and_score(docs.unionByName(docs), str(tmp_path / "d")).where(F.col("doc_id") == 7).collect()]
    assert len(twice) == 2 and twice[0] == twice[1]
