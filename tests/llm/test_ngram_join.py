import random
import re

import pytest

from quillspark.llm import ngram_join as J


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    sets, up = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            k = len(a & sets[j])
            if k and 100 * k >= 80 * (len(a) + len(sets[j]) - k):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted((d, len(s), least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def sample(seed):
    rng, rows = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(300)]
    for size, copies in ((6, 12), (40, 30), (120, 40), (80, 25)):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randrange(5)):
                words[rng.randrange(size)] = rng.choice(vocabulary)
            rows.append((len(rows) * 3 + 1, " ".join(words)))
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows += [(1000 + k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 25))) + "  " + passage) for k in range(25)]
    return rows + [(5000, ""), (5001, None), (5002, " \n"), (5003, "A b"), (5004, "a  B"), (5005, "a c")]


@pytest.mark.parametrize("seed", [4, 11])
def test_against_brute_force(spark, seed):
    rows = sample(seed)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(tuple(r) for r in J.join_documents(docs).collect()) == brute(rows)


def around_a_passage(seed, start):
    """20 to 60 texts with one passage, some blocks of words that others hold too, and words of their own."""
    rng, rows = random.Random(seed), []
    common, n_blocks, long, per, own, texts = (rng.choice(x) for x in ([60, 80, 100, 120, 160], [5, 6, 8], [6, 7, 8, 10], [1, 2, 3], [0, 1, 2, 4, 8, 12], [20, 40, 60]))
    passage, blocks = [f"g{seed}p{i}" for i in range(common)], [[f"g{seed}b{b}w{i}" for i in range(long)] for b in range(n_blocks)]
    for t in range(texts):
        chosen = [w for b in sorted(rng.sample(range(n_blocks), per)) for w in blocks[b]]
        rows.append((start + t, " ".join(passage + chosen + [f"g{seed}u{t}x{i}" for i in range(own)])))
    return rows


def test_links_away_from_the_centre(spark):
    rows = [r for seed in (1, 26, 43, 78, 102, 134) for r in around_a_passage(seed, 1000 * seed)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(tuple(r) for r in J.join_documents(docs).collect()) == brute(rows)


def edited(seed, groups=20):
    """Groups of a passage with 2 to 11 edited words a copy, so that many copies link in pairs only."""
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(10**6)}" for _ in range(rng.choice((60, 90, 150)))]
        for _ in range(rng.randrange(15, 50)):
            words = list(base)
            for k in rng.sample(range(len(base)), rng.randrange(2, 12)):
                words[k] = f"e{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(words)))
    return rows


def test_copies_that_link_in_pairs_only(spark, monkeypatch):
    rows = edited(5)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute(rows)
    assert sorted(tuple(r) for r in J.join_documents(docs).collect()) == want
    monkeypatch.setattr(J, "INDEX", 900)  # many cells to a family
    monkeypatch.setattr(J, "ASKED", 700)
    monkeypatch.setattr(J, "SMALL", 2)
    assert sorted(tuple(r) for r in J.join_documents(docs).collect()) == want


def test_one_large_group(spark):
    """Trees of edits: a few copies of copies drift away from the first text."""
    rng = random.Random(3)
    texts = [[f"w{rng.randrange(10**6)}" for _ in range(140)]]
    while len(texts) < 300:
        words = list(rng.choice(texts))
        for _ in range(rng.randrange(1, 5)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**9)}"
        texts.append(words)
    rows = [(k, " ".join(x)) for k, x in enumerate(texts)]
    assert sorted(tuple(r) for r in J.join_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()) == brute(rows)


def test_a_passage_that_many_share(spark):
    rng = random.Random(8)
    passage = " ".join(f"p{k}" for k in range(120))
    rows = [(k, " ".join(f"t{k}x{j}" for j in range(rng.choice((0, 3, 20, 28, 35, 60, 200)))) + " " + passage) for k in range(250)]
    assert sorted(tuple(r) for r in J.join_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()) == brute(rows)


@pytest.mark.parametrize("seed", range(6))
def test_search_of_lists(seed):
    rows = edited(seed, 3) + around_a_passage(seed, 1000)
    sets = [J.shingles(t) for _, t in rows]
    lists = J.Lists(sets)
    for query in sets:
        want = [k for k, x in enumerate(sets) if 100 * J.overlap(query, x) >= 80 * (len(query) + len(x) - J.overlap(query, x))]
        assert sorted(lists.search(query)) == want


def test_hashes_do_not_depend_on_blocks(monkeypatch):
    from quillspark.llm import hashing

    text = " ".join(random.Random(1).choice(("a", "Bc", "a longer one", "ß" * 9)) for _ in range(400)) + " " + "x" * 700
    whole = hashing.word_hashes(text)
    monkeypatch.setattr(hashing, "BLOCK", 800)
    monkeypatch.setattr(hashing, "_powers", [])
    assert (hashing.word_hashes(text) == whole).all()


def test_null_ids_link(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text + " tail"), (4, text), (None, "only here a b c"), (None, "  "), (9, text + " end")]
    got = J.join_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, -1), (-1, 4), (4, 4), (9, 4)]


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, None), (2, "x " * 30_000)], "doc_id bigint, text string").selectExpr("*", "1 as class", "2 as n")
    got = J.join_documents(docs).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == [(0, 0, 0), (1, 2, 1), (1, 2, 1), (2, 1, 2)]
    assert J.join_documents(docs.where("false")).count() == 0


def test_one_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text, "k"), (2, text + " tail", "k"), (3, "other words here", "k"), (None, text, "n")], "doc_id bigint, text string, source string")
    assert sorted((r.doc_id or 0) for r in J.without_copies(docs).collect()) == [1, 3]


def test_one_row_of_repeated_and_nameless_copies_stays(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "b"), (1, text, "a"), (2, text + " tail", "k"), (5, "a text of its own", "k"), (5, text, "k"), (6, "one", "k"), (6, "two", "k")]
    rows += [(7, "", "k"), (7, None, "k"), (None, "no name", "n"), (None, "No  name", "m"), (None, "other", "n"), (None, "", "n"), (None, None, "n")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = [tuple(r) for r in J.without_copies(docs).collect()]
    want = [(1, text, "a"), (5, "a text of its own", "k"), (6, "one", "k"), (6, "two", "k"), (7, None, "k"), (None, "No  name", "m"), (None, "other", "n"), (None, "", "n"), (None, None, "n")]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert J.without_copies(docs.where("false")).count() == 0
