import random
from collections import Counter

import numpy as np

from quillspark.llm import suffix_rules as S


def brute(ids, least):
    n, longest = len(ids), [0] * len(ids)
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and ids[i + k] == ids[j + k]:
                k += 1
            longest[i] = max(longest[i], k)
    spans = {p for i in range(n) if longest[i] >= least for p in range(i, i + longest[i])}
    grams = Counter(zip(ids, ids[1:], ids[2:]))
    words = {i + k for i in range(n - 2) for k in range(3) if grams[tuple(ids[i : i + 3])] > 1}
    return longest, len(spans), len(words)


def test_against_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        ids = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randrange(1, 40))]
        least = rng.randrange(1, 6)
        lengths = S.repeats(np.array(ids))
        assert (lengths.tolist(), S.covered(lengths, least), S.repeat_words(np.array(ids))) == brute(ids, least)


def test_documents(spark):
    clean = " ".join(f"w{i}" for i in range(80))
    rows = [(1, clean), (2, None), (3, ""), (4, " ".join([clean] * 3)), (5, "few words"), (1, clean), (6, "a\nb\na\n\n\n" + clean)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as kept")
    got = {r.doc_id: r for r in S.judge(docs).collect()}
    assert got[1].kept and not got[1].base_failed and got[2].n_words == 0 and got[2].base_failed and not got[3].kept
    assert got[4].base_failed and not got[4].kept and got[5].base_failed and got[6].n_dup_lines == 1 and got[4].longest_repeat == 160
    assert S.judge(docs).count() == 7 and S.judge(docs.where("false")).count() == 0


def test_repetition_rejects_what_the_base_rules_pass(spark):
    w = [f"w{i}" for i in range(1000)]
    pasted, often = w[:810] + w[100:290], w[:600] + w[:40] * 6
    docs = spark.createDataFrame([(1, " ".join(pasted)), (2, " ".join(often)), (3, " ".join(w + w[:40]))], "doc_id bigint, text string")
    got = {r.doc_id: r for r in S.judge(docs).collect()}
    assert not any(r.base_failed for r in got.values()) and got[1].longest_repeat == 190
    assert [got[i].kept for i in (1, 2, 3)] == [False, False, True]
