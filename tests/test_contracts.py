"""Provenance, evidence graphs and streaming ledgers."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quillspark.operators import graphs as G
from quillspark.operators import provenance as P
from quillspark.streaming import ledger

RECORD = "question_content string, candidate_answers array<string>, ground_truth string, legal_rationale string, context_text string"
GRAPH = "struct<nodes: array<struct<id: string, kind: string, source: string, role: string, value: string>>, edges: array<struct<id: string, source: string, target: string, relation: string, directed: boolean>>>"


def test_stamp_and_verify(spark):
    rows = [("câu hỏi?", ["A. x", None], "A", None, "ctx"), ("q/\"2\"", [], None, "r\n", None)]
    stamped = P.stamp(spark.createDataFrame(rows, RECORD), "run-1")
    for row, r in zip(rows, stamped.collect(), strict=True):
        text = json.dumps(dict(zip(RECORD.replace(" string", "").replace(" array<string>", "").split(", ")[:4], row, strict=False)), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        assert r._provenance.content_sha256 == "sha256:" + hashlib.sha256(text.encode()).hexdigest()
    changed = P.verify(stamped.withColumn("ground_truth", F.lit("B"))).collect()
    assert all(r.has_provenance and not r.content_ok and r.context_ok for r in changed)
    assert all(r.content_ok for r in P.verify(P.stamp(stamped, "run-2")).collect())


def graph(**change):
    nodes = [["T1", "evidence", "text", "premise", "the sea  is"], ["I1", "evidence", "image", "mapping", "image 1"], ["C1", "claim", "derived", "conclusion", "it is so"]]
    edges = [["E1", "T1", "C1", "supports", True], ["E2", "I1", "C1", "maps_to", True]]
    for place, value in change.items():
        part, i, k = place.split("_")
        (nodes if part == "n" else edges)[int(i)][int(k)] = value
    return (nodes, edges)


FAULTS = [
    ({}, "TLV", None), ({}, "T", "graph_source_not_available"), ({"n_0_4": "not there"}, "TLV", "graph_text_not_literal"), ({"n_1_0": "T1"}, "TLV", "graph_node_id"), ({"n_0_0": "S1", "e_0_1": "S1"}, "TLV", "graph_evidence_id_prefix"),
    ({"n_1_4": "image 3"}, "TLV", "graph_image_order_invalid"), ({"n_2_3": "premise"}, "TLV", "graph_claim_type"), ({"n_0_1": "other"}, "TLV", "graph_node_kind"), ({"e_1_0": "E1"}, "TLV", "graph_edge_id"), ({"e_1_1": "T9"}, "TLV", "graph_dangling_edge"),
    ({"e_0_4": False}, "TLV", "graph_edge_type"), ({"e_0_2": "I1"}, "TLV", "graph_edge_direction"), ({"e_1_1": "T1", "e_1_3": "supports"}, "TLV", "graph_duplicate_semantic_edge"), ({"e_1_1": "T1"}, "TLV", "graph_claim_needs_multi_evidence"), ({"n_0_4": " "}, "TLV", "graph_node_value"),
]


def test_graph_faults(spark):
    rows = [(i, *[[tuple(x) for x in part] for part in graph(**c)], cond) for i, (c, cond, _) in enumerate(FAULTS)]
    inner = GRAPH.removeprefix("struct<").removesuffix(">").replace("nodes: ", "nodes ", 1).replace("edges: ", "edges ", 1)
    df = spark.createDataFrame(rows, "i int, " + inner + ", cond string")
    fault = G.graph_fault(F.col("nodes"), F.col("edges"), F.lit("See: THE sea is wide"), F.lit("t"), F.lit(2), F.col("cond"))
    got = [r[0] for r in df.orderBy("i").select(fault).collect()]
    assert got == [code for _, _, code in FAULTS]


@pytest.mark.parametrize(
    ("motif", "evidence", "image", "cond", "code"),
    [
        ("premise_mapping_to_claim", ["T1", "I1"], True, "TLV", None), ("nothing", ["T1", "I1"], True, "TLV", "motif_unknown"), ("premise_mapping_to_claim", ["T1"], True, "TLV", "motif_evidence_ids"),
        ("premise_constraint_to_claim", ["T1", "I1"], True, "TLV", "motif_role_mismatch"), ("premise_mapping_to_claim", ["T1", "C1"], True, "TLV", "motif_node_not_evidence"), ("premise_mapping_to_claim", ["T1", "I1"], False, "TLV", "motif_tlv_image_required"),
        ("premise_mapping_to_claim", ["T1", "I1"], True, "T", "motif_non_tlv_image_forbidden"),
    ],
)
def test_motifs(spark, motif, evidence, image, cond, code):
    nodes, edges = ([tuple(x) for x in part] for part in graph())
    inner = GRAPH.removeprefix("struct<").removesuffix(">").replace("nodes: ", "nodes ", 1).replace("edges: ", "edges ", 1)
    df = spark.createDataFrame([(nodes, edges, evidence)], inner + ", ev array<string>")
    fault = G.motif_fault(F.col("nodes"), F.col("edges"), F.lit(motif), F.col("ev"), F.lit("C1"), F.lit(image), F.lit(cond))
    assert df.select(fault).first()[0] == code
    if code is None:
        a = df.select(G.atom(F.col("nodes"), F.col("edges"), F.col("ev"), F.lit("C1"))).first()[0]
        assert (a.value, a.node_ids, a.edge_ids) == ("it is so", ["T1", "I1", "C1"], ["E1", "E2"])


def test_stream_keeps_each_run_once(spark, tmp_path):
    folder, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    (tmp_path / "in").mkdir()
    for k, rows in enumerate(([("a", "x"), ("b", "x")], [("b", "x"), ("c", "y")])):
        (tmp_path / "in" / f"{k}.json").write_text("".join(json.dumps({"run_id": r, "experiment_id": e}) + "\n" for r, e in rows))
        ledger.append(ledger.new_rows(spark, folder, "run_id string, experiment_id string"), out, mark).awaitTermination(120)
    assert sorted(r.run_id for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]
