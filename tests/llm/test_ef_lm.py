import collections
import math
import random
import re
import zlib

import numpy as np

from quillspark.llm import ef_lm as L


def test_elias_fano():
    rng = random.Random(1)
    for _ in range(150):
        top = rng.choice([10, 1000, 10**6, 2**40, 2**63])
        values = np.unique(np.array([rng.randrange(top) for _ in range(rng.randrange(400))], np.uint64))
        ef = L.EliasFano(L.ef_encode(values, top))
        assert (ef.get(np.arange(len(values))) == values).all()
        asked = np.array([rng.randrange(top) for _ in range(50)] + values[:50].tolist(), np.uint64)
        known = {int(v): i for i, v in enumerate(values)}
        assert [known.get(int(a), -1) for a in asked] == ef.find(asked).tolist()


def test_against_brute_force(spark, tmp_path):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)] + ["É", "a b"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for i in range(120)] + [(500, None), (501, "  ")]
    tokens = {i: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + [None] for i, t in rows}
    one, two = collections.Counter(), collections.Counter()
    for i, t in tokens.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            one.update(t)
            two.update(zip([None, *t], t))
    total, distinct, next_of = sum(one.values()), len(one), collections.Counter(a for a, _ in two)
    uni = lambda w: (one[w] + 0.5) / (total + 0.5 * (distinct + 1))
    pair = lambda a, w: uni(w) if not one[a] else max(two[a, w] - L.DISCOUNT, 0) / one[a] + L.DISCOUNT * next_of[a] / one[a] * uni(w)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = L.fit_and_score(docs, str(tmp_path / "lm")).collect()
    assert len(got) == len(rows)
    for r in got:
        t = tokens[r.doc_id]
        assert r.n_tokens == len(t) and r.train_tokens == total and r.n_known == sum(one[w] > 0 for w in t) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        assert abs(r.base_score - sum(math.log10(uni(w)) for w in t)) < 1e-6
        assert abs(r.score - sum(math.log10(pair(a, w)) for a, w in zip([None, *t], t))) < 0.02 * len(t)
    assert L.fit_and_score(docs.where("false"), str(tmp_path / "none")).count() == 0
