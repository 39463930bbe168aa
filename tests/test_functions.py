"""Column functions and operators on small cases."""

from pyspark.sql import functions as F

from quillspark.functions import mcq as M
from quillspark.functions import text as T
from quillspark.operators import assets as A
from quillspark.operators import documents as D
from quillspark.operators import items as I
from quillspark.operators import ledger as L
from quillspark.sources import tables


def values(spark, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame([(x,) for x in rows], "t string").select(*columns).collect()]


def test_strip_and_capitalize(spark):
    assert values(spark, ["  a  b\n", "", None], T.strip("t"), T.squeeze("t")) == [("a  b", "a b"), ("", ""), (None, None)]
    assert values(spark, ["aPPLY now"], T.capitalize("t")) == [("Apply now",)]


def test_labels(spark):
    rows = ["A. dog", "b) x", "A", "A dog", "E. x", " c: "]
    assert [r[0] for r in values(spark, rows, M.choice_label("t"))] == ["A", "B", None, "A", None, "C"]


def test_embedded_truth_takes_the_last(spark):
    assert values(spark, ["<ground_truth>a</ground_truth> <ground_truth>B. b (full correct answer text)"], M.embedded_truth("t"), M.canonical("t")) == [("B. b (full correct answer text)", "b")]


def test_resolver_order(spark):
    rows = [(["A. one", "B. two"], "b. TWO"), (["A. one", "B. two"], "two"), (["A. one", "B. two"], "B."), (["A. one", "B. two"], "three"), ([], "x"), (None, "x")]
    got = I.resolved(spark.createDataFrame(rows, "candidate_answers array<string>, ground_truth string")).select("method", "gold_index").collect()
    assert [tuple(r) for r in got] == [("exact_full", 1), ("payload_match", 1), ("label_only", 1), ("unresolved", None), ("no_candidates", None), ("candidates_not_list", None)]


def test_answer_letter(spark):
    rows = ["b) yes", "the correct answer is C", "because", "x" * 60, " D"]
    assert [r[0] for r in values(spark, rows, M.answer_letter("t"))] == ["B", "C", "B", "N/A", "D"]


def test_scores(spark):
    x = "<groundedness>0.1</groundedness><multimodal_alignment>0</multimodal_alignment><legal_fluency>1</legal_fluency>"
    got = values(spark, [x, "<groundedness>1</groundedness>"], M.parse_scores("t"))
    assert got[0][0].groundedness == 1.0 and got[0][0].overall == 1.0 and got[0][0].taxonomy_level == "Understand" and got[1][0] is None


def test_chunks(spark):
    long = "word " * 30
    md = f"# One\n{long}\n#### deep\n{long}\n## Two\nshort\nĐiều 5\n{long}"
    docs = spark.createDataFrame([("d", md), ("e", "no header"), ("f", "x" * 120 + "\n# T\n" + "y" * 4000)], "id string, t string")
    got = {(r.chunk_id, r.section_title, r.header_level) for r in D.chunks(docs, "id", "t").collect()}
    assert {("d_chunk_0", "One", 1), ("e_chunk_0", "Full Document", 0), ("f_chunk_0", "Preamble", 0), ("f_chunk_1", "T", 1)} <= got
    assert not any(t == "deep" or t == "Two" for _, t, _ in got)
    text = {r.chunk_id: r.text for r in D.chunks(docs, "id", "t").collect()}
    assert text["f_chunk_1"].endswith("[... truncated ...]")


def test_clean(spark):
    good = "This is a sentence that has more than fifteen words in it so that it may stay here. Yes."
    toc = "\n".join(f"part {i} ... {i}" for i in range(7))
    got = values(spark, [good, "short.", toc, "12\n" + good, "@#$% " * 20], D.clean_reason("t"))
    assert [r[0] for r in got] == [None, "short", "toc", None, "noisy"]


def test_table_at_the_end_is_not_emitted(spark):
    docs = spark.createDataFrame([(1, "a\n| x\n| y\nb"), (2, "a\n| x\n| y")], "id int, t string")
    assert [tuple(r) for r in D.table_blocks(docs, "id", "t").collect()] == [(1, 1, 2)]


def test_rank_and_rotation(spark):
    rows = [(i * 7, [f"A. a{i}", "B. b", "C. c", "D. d"], "C.") for i in range(9)]
    got = I.eval_ready(spark.createDataFrame(rows, "id bigint, candidate_answers array<string>, ground_truth string"), "id").orderBy("id").collect()
    assert [r.gold_index for r in got] == [0, 1, 2, 3, 0, 1, 2, 3, 0] and all(r.options[r.gold_index] == "c" == r.ground_truth for r in got)


def test_splits_cross_no_document(spark):
    rows = spark.createDataFrame([(i, f"d{i % 13}", i % 3 == 0) for i in range(400)], "chunk_id int, doc string, mm boolean")
    out = L.document_splits(rows, "doc", "mm", 1)
    assert out.count() == 400 and out.groupBy("doc").agg(F.countDistinct("split").alias("n")).where("n > 1").isEmpty()


def test_majority(spark):
    rows = [("a", True, True), ("a", True, None), ("a", False, False), ("b", True, True), ("b", True, False), ("b", False, True), ("c", True, True)]
    got = {r.item: r.verdict for r in L.verdicts(spark.createDataFrame(rows, "item string, with_image boolean, is_correct boolean")).collect()}
    assert got == {"a": "visually_dependent", "b": "indeterminate"}


def test_domain(spark):
    assert [r[0] for r in values(spark, ["38_x", "99_x", "x", None], A.domain(F.col("t")))] == ["Labor Law", "Other", "unknown", "unknown"]


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n[1]\n{"a": null}\n')
    assert sorted(str(r.a) for r in tables.json_lines(spark, str(tmp_path / "a.jsonl"), "a int").collect()) == ["1", "None"]


def test_numbers(spark):
    assert sorted(r.value for r in tables.numbers(spark.createDataFrame([("1.5",), ("x",), ("",), ("2",)], "c string"), "c").collect()) == [1.5, 2.0]
