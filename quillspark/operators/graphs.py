"""Checks of small evidence graphs held in a row: first failing rule as a code, motif matching, program and atom.

A graph has nodes array<struct<id, kind, source, role, value>> and edges array<struct<id, source, target, relation,
directed>>; evidence is its text, section title and number of images. Rules over one node or edge report the first in
array order that fails any, with that element's first code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import normalize

# The relation each evidence role needs, and the motifs as sorted role lists.
RELATION = {"premise": "supports", "mapping": "maps_to", "constraint": "constrains"}
MOTIFS = {
    "premise_mapping_to_claim": ("mapping", "premise"),
    "premise_constraint_to_claim": ("constraint", "premise"),
    "mapping_constraint_to_claim": ("constraint", "mapping"),
    "premise_mapping_constraint_to_claim": ("constraint", "mapping", "premise"),
}
SOURCES = {"T": ("text",), "TL_struct": ("text", "structure"), "TLV": ("text", "structure", "image")}


def _first(items: Column, code: Callable[[Column, Column], Column]) -> Column:
    return F.try_element_at(F.array_compact(F.transform(items, code)), F.lit(1))


def allowed(source: Column, condition: Column) -> Column:
    out = F.lit(False)
    for name, sources in SOURCES.items():
        out = out | ((condition == name) & source.isin(*sources))
    return out


def image_order(value: Column) -> Column:
    return F.regexp_extract(value, r"(?iu)(?:ảnh|image)\s*(\d+)", 1).try_cast("int")


def graph_fault(nodes: Column, edges: Column, text: Column, title: Column, images: Column, condition: Column) -> Column:
    """Code of the first rule that the graph breaks, null if it is sound."""
    ids = F.transform(nodes, lambda n: n["id"])
    kind_of = lambda i: F.try_element_at(F.filter(nodes, lambda n: n["id"] == i), F.lit(1))["kind"]

    def node(n: Column, i: Column) -> Column:
        evidence, claim = n["kind"] == "evidence", n["kind"] == "claim"
        prefix = F.when(n["source"] == "text", "T").when(n["source"] == "structure", "S").otherwise("I")
        order = image_order(n["value"])
        return (
            F.when(n["id"].isNull() | F.array_contains(F.slice(ids, F.lit(1), i), n["id"]), "graph_node_id")
            .when(n["value"].isNull() | (F.trim(n["value"]) == ""), "graph_node_value")
            .when(evidence & ~(F.coalesce(n["source"].isin("text", "structure", "image"), F.lit(False)) & F.coalesce(n["role"].isin(*RELATION), F.lit(False))), "graph_evidence_type")
            .when(evidence & ~allowed(n["source"], condition), "graph_source_not_available")
            .when(evidence & ~n["id"].rlike(r"^[TSI][1-9][0-9]*$"), "graph_evidence_id_prefix")
            .when(evidence & (F.left(n["id"], F.lit(1)) != prefix), "graph_evidence_id_prefix")
            .when(evidence & (n["source"] == "text") & ~F.contains(normalize(text), normalize(n["value"])), "graph_text_not_literal")
            .when(evidence & (n["source"] == "structure") & (F.coalesce(normalize(title), F.lit("")) != normalize(n["value"])), "graph_structure_not_title")
            .when(evidence & (n["source"] == "image") & ~F.coalesce(order.between(1, images), F.lit(False)), "graph_image_order_invalid")
            .when(claim & ~((n["source"] == "derived") & (n["role"] == "conclusion")), "graph_claim_type")
            .when(claim & ~n["id"].rlike(r"^C[1-9][0-9]*$"), "graph_claim_id")
            .when(~(evidence | claim), "graph_node_kind")
        )

    def edge(e: Column, i: Column) -> Column:
        before = F.slice(edges, F.lit(1), i)
        same = F.exists(before, lambda b: (b["source"] == e["source"]) & (b["target"] == e["target"]) & (b["relation"] == e["relation"]))
        return (
            F.when(~F.coalesce(e["id"].rlike(r"^E[1-9][0-9]*$"), F.lit(False)) | F.exists(before, lambda b: b["id"] == e["id"]), "graph_edge_id")
            .when(~F.coalesce(F.array_contains(ids, e["source"]) & F.array_contains(ids, e["target"]), F.lit(False)), "graph_dangling_edge")
            .when(~F.coalesce(e["directed"] & e["relation"].isin(*RELATION.values()), F.lit(False)), "graph_edge_type")
            .when((kind_of(e["source"]) != "evidence") | (kind_of(e["target"]) != "claim"), "graph_edge_direction")
            .when(same, "graph_duplicate_semantic_edge")
        )

    claims = F.size(F.filter(nodes, lambda n: n["kind"] == "claim"))
    return F.coalesce(
        F.when(nodes.isNull() | (F.size(nodes) < 3), "graph_nodes_too_short"),
        F.when(edges.isNull() | (F.size(edges) < 2), "graph_edges_too_short"),
        _first(nodes, node),
        F.when(claims != 1, "graph_requires_one_claim"),
        _first(edges, edge),
        F.when(F.size(F.array_distinct(F.transform(edges, lambda e: e["source"]))) < 2, "graph_claim_needs_multi_evidence"),
    )


def motif_fault(nodes: Column, edges: Column, motif: Column, evidence: Column, target: Column, image_necessary: Column, condition: Column) -> Column:
    """Code of the first motif rule that a sound graph breaks, null if the motif matches."""
    node_of = lambda i: F.try_element_at(F.filter(nodes, lambda n: n["id"] == i), F.lit(1))
    roles = F.array_sort(F.array_distinct(F.transform(evidence, lambda i: node_of(i)["role"])))
    need = F.lit(None).cast("array<string>")
    for name, parts in MOTIFS.items():
        need = F.when(motif == name, F.array(*[F.lit(p) for p in parts])).otherwise(need)
    into = lambda i: F.filter(edges, lambda e: (e["source"] == i) & (e["target"] == target))
    relation = F.create_map(*[F.lit(x) for kv in RELATION.items() for x in kv])
    one = _first(
        evidence,
        lambda i, _: F.when(F.size(into(i)) != 1, "motif_requires_one_edge_per_evidence").when(F.try_element_at(into(i), F.lit(1))["relation"] != F.try_element_at(relation, node_of(i)["role"]), "motif_role_relation_mismatch"),
    )
    image = F.exists(evidence, lambda i: node_of(i)["source"] == "image")
    return F.coalesce(
        F.when(need.isNull(), "motif_unknown"),
        F.when(evidence.isNull() | (F.size(evidence) < 2) | (F.size(F.array_distinct(evidence)) < F.size(evidence)), "motif_evidence_ids"),
        F.when(~F.coalesce(node_of(target)["kind"] == "claim", F.lit(False)), "motif_target_not_claim"),
        F.when(F.exists(evidence, lambda i: ~F.coalesce(node_of(i)["kind"] == "evidence", F.lit(False))), "motif_node_not_evidence"),
        F.when(roles != need, "motif_role_mismatch"),
        one,
        F.when(F.exists(edges, lambda e: (e["target"] == target) & ~F.array_contains(evidence, e["source"])), "motif_excludes_unbound_incoming_edge"),
        F.when((condition == "TLV") & ~(image_necessary & image), "motif_tlv_image_required"),
        F.when((condition != "TLV") & (image_necessary | image), "motif_non_tlv_image_forbidden"),
    )


def atom(nodes: Column, edges: Column, evidence: Column, target: Column) -> Column:
    """What the fixed four-step program returns for a matched motif: the claim's value and what supports it."""
    value = F.try_element_at(F.filter(nodes, lambda n: n["id"] == target), F.lit(1))["value"]
    used = F.transform(evidence, lambda i: F.try_element_at(F.filter(edges, lambda e: (e["source"] == i) & (e["target"] == target)), F.lit(1))["id"])
    return F.struct(F.lit("A1").alias("id"), value.alias("value"), F.concat(evidence, F.array(target)).alias("node_ids"), used.alias("edge_ids"))
