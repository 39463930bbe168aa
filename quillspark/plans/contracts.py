"""Queries of item contracts: graphs, motifs, anchors, bindings, responses, constructions and their audit.

Inputs are built from documents: each document under one condition, with one planted fault by its id. The SQL works the
anchors, bindings and spans out anew, and names the code that a planted fault must lead to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import contracts as C
from quillspark.operators import graphs as G
from quillspark.plans.registry import query
from quillspark.sources.tables import table

CONDITIONS = ("T", "TL_struct", "TLV")
NODES = "array<struct<id:string,kind:string,source:string,role:string,value:string>>"
EDGES = "array<struct<id:string,source:string,target:string,relation:string,directed:boolean>>"
BASE_SQL = "b AS (SELECT doc_id, text, source AS title, CASE doc_id % 3 WHEN 0 THEN 'T' WHEN 1 THEN 'TL_struct' ELSE 'TLV' END AS condition, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents WHERE regexp_matches(text, '\\S\\s+\\S+\\s+\\S')), d AS (SELECT *, w[1] || ' ' || w[2] AS quote FROM b)"


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of three words or more as evidence: text, title, condition and a literal quote of two words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("title")).where(F.col("text").rlike(r"\S\s+\S+\s+\S"))
    words = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    k = F.col("doc_id") % 3
    return docs.withColumn("condition", F.when(k == 0, "T").when(k == 1, "TL_struct").otherwise("TLV")).withColumn("quote", F.concat_ws(" ", words[0], words[1]))


def _pick(k: Column, *values: Column | str | None) -> Column:
    out = F.lit(None).cast("string")
    for i, v in enumerate(values):
        out = F.when(k == i, v if isinstance(v, Column) else F.lit(v)).otherwise(out)
    return out


@query(
    "anchor_errors",
    f"""WITH {BASE_SQL}, a AS (SELECT *, CASE doc_id % 7 WHEN 2 THEN 'structure' WHEN 3 THEN 'structure' WHEN 4 THEN 'image' WHEN 5 THEN 'image' ELSE 'text' END AS source,
    CASE doc_id % 7 WHEN 0 THEN upper(quote) WHEN 1 THEN 'zzz no such words' WHEN 2 THEN upper(title) WHEN 3 THEN 'other title' WHEN 4 THEN 'Image 1' WHEN 5 THEN 'the image 9' ELSE '  ' END AS support FROM d),
    f AS (SELECT doc_id, CASE WHEN trim(support) = '' OR (source = 'structure' AND condition = 'T') OR (source = 'image' AND condition <> 'TLV') THEN 'invalid_source_or_support'
      WHEN source = 'text' AND NOT contains(lower(regexp_replace(text, '\\s+', ' ', 'g')), lower(support)) THEN 'text_not_literal' WHEN source = 'structure' AND lower(support) <> lower(title) THEN 'structure_not_section_title'
      WHEN source = 'image' AND CAST(regexp_extract(support, '(\\d+)', 1) AS INT) > 1 THEN 'image_order_not_identified' END AS code FROM a)
    SELECT doc_id, concat_ws(',', CASE WHEN code IS NOT NULL THEN 'anchor:1:' || code END, CASE WHEN doc_id % 5 = 0 THEN 'anchor:2:schema' END) AS errors FROM f""",
)
def anchor_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 7
    source = _pick(k, "text", "text", "structure", "structure", "image", "image", "text")
    support = _pick(k, F.upper("quote"), "zzz no such words", F.upper("title"), "other title", "Image 1", "the image 9", "  ")
    own = F.to_json(F.struct(source.alias("source"), support.alias("support")))
    second = F.when(F.col("doc_id") % 5 == 0, F.lit(',{"source":"text"}')).otherwise("")
    rows = evidence(spark, sf_dir).withColumn("anchors", F.parse_json(F.concat(F.lit("["), own, second, F.lit("]"))))
    errors = C.anchor_errors(F.col("anchors"), F.col("text"), F.col("title"), F.lit(1), F.col("condition"))
    return rows.select("doc_id", F.array_join(errors, ",").alias("errors"))


@query(
    "choice_binding",
    f"""WITH {BASE_SQL}, p AS (SELECT doc_id, array_to_string(w[1:8], ' ') AS atom, CASE doc_id % 4 WHEN 0 THEN array_to_string(w[1:8], '  ') WHEN 1 THEN upper(array_to_string(w[1:5], ' ')) WHEN 2 THEN array_to_string(w[1:8], ' ') || ' and more words' ELSE 'zzz qqq' END AS choice FROM d),
    q AS (SELECT doc_id, lower(atom) AS a, lower(regexp_replace(choice, '\\s+', ' ', 'g')) AS c FROM p),
    r AS (SELECT *, len(string_split(a, ' ')) AS na, len(string_split(c, ' ')) AS nc, CASE WHEN a = c THEN 'identical' WHEN contains(a, c) THEN 'choice_within_atom' WHEN contains(c, a) THEN 'atom_within_choice' ELSE 'disjoint' END AS relation FROM q)
    SELECT doc_id, relation, CASE WHEN relation = 'disjoint' THEN 0.0 ELSE round(least(na, nc) / greatest(na, nc)::DOUBLE, 4) END::DOUBLE AS token_ratio, relation <> 'disjoint' AND round(least(na, nc) / greatest(na, nc)::DOUBLE, 4) >= 0.5 AS ok FROM r""",
)
def choice_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    atom = F.array_join(F.slice(w, 1, 8), " ")
    choice = _pick(F.col("doc_id") % 4, F.array_join(F.slice(w, 1, 8), "  "), F.upper(F.array_join(F.slice(w, 1, 5), " ")), F.concat(atom, F.lit(" and more words")), "zzz qqq")
    b = evidence(spark, sf_dir).select("doc_id", C.binding(atom, choice).alias("b"))
    return b.select("doc_id", "b.relation", "b.token_ratio", "b.ok")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw response a document, with a planted fault by id."""
    rows = evidence(spark, sf_dir).withColumn("method", F.when(F.col("doc_id") % 2 == 0, "direct").otherwise("answer_first"))
    k = F.col("doc_id") % 13
    anchor = F.to_json(F.array(F.struct(F.lit("text").alias("source"), F.when(k == 9, "zzz no such words").otherwise(F.col("quote")).alias("support"))))
    choices = _pick(k, *['["w","x","y","z"]'] * 5, '["w","x"," W ","z"]', '["w","x","y"]', '["w","x","y",7]', *['["w","x","y","z"]'] * 5)
    index = _pick(k, "0", "0", "0", "true", '"1"', *["0"] * 8)
    body = F.concat(
        F.lit('{"question":"'), F.when(k == 8, "  ").otherwise("q"), F.lit('","choices":'), choices, F.lit(',"answer_index":'), index, F.when(k == 1, "").otherwise(',"rationale":"r"'), F.lit(',"evidence_anchor":'), anchor,
        F.lit(',"evidence_excerpt":"e","answer":"'), F.when(k == 10, "x").otherwise("w"), F.lit('"}'),
    )
    raw = F.when(k == 2, "not json {").when(k == 11, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 12, F.lit('{"reject_reason":"insufficient_evidence"}')).when(k == 0, F.lit("[1, 2]")).otherwise(body)
    return rows.withColumn("raw", raw)


RESPONSE_SQL = """CASE doc_id % 13 WHEN 0 THEN 'json_not_object' WHEN 1 THEN 'missing:rationale' WHEN 2 THEN 'invalid_json' WHEN 3 THEN 'invalid_core_schema' WHEN 4 THEN 'invalid_core_schema' WHEN 5 THEN 'duplicate_choices' WHEN 6 THEN 'invalid_core_schema'
  WHEN 7 THEN 'invalid_core_schema' WHEN 8 THEN 'invalid_core_schema' WHEN 9 THEN 'invalid_evidence_anchor:anchor:1:text_not_literal' WHEN 10 THEN CASE WHEN doc_id % 2 = 1 THEN 'answer_first_inconsistent' END WHEN 12 THEN 'model_insufficient_evidence' END"""


@query("response_faults", f"WITH {BASE_SQL} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'direct' ELSE 'answer_first' END AS method, {RESPONSE_SQL} AS reason, CASE WHEN doc_id % 13 = 11 THEN 'stripped_markdown_code_fence' WHEN doc_id % 13 <> 2 THEN '' ELSE '' END AS repairs FROM d")
def response_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = responses(spark, sf_dir).withColumn("p", C.parsed(F.col("raw")))
    fault = C.response_fault(F.col("p.value"), F.col("method"), F.col("text"), F.col("title"), F.lit(1), F.col("condition"))
    return rows.select("doc_id", "method", fault.alias("reason"), F.array_join("p.repairs", ",").alias("repairs"))


def constructions(spark: SparkSession, sf_dir: str, fault: Column) -> DataFrame:
    """A sound graph over each document, changed where `fault` (a number) asks for it."""
    rows = evidence(spark, sf_dir).withColumn("fault", fault)
    f, tlv, t = F.col("fault"), F.col("condition") == "TLV", F.col("condition") == "T"
    source = F.when(tlv, "image").when(t, "text").otherwise("structure")
    second = F.concat(F.when(tlv, "I").when(t, "T").otherwise("S"), F.lit("2"))
    value = F.when(tlv, F.when(f == 4, "image 5").otherwise("image 1")).when(t, F.lower("quote")).otherwise(F.upper("title"))
    node = lambda *x: F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in zip(("id", "kind", "source", "role", "value"), x, strict=True)])
    edge = lambda *x: F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in zip(("id", "source", "target", "relation", "directed"), x, strict=True)])
    nodes = F.array(
        node(F.when(f == 1, second).otherwise("T1"), "evidence", "text", "premise", F.when(f == 2, "zzz no such words").otherwise(F.col("quote"))), node(second, "evidence", source, "mapping", value),
        node("C1", "claim", "derived", F.when(f == 3, "premise").otherwise("conclusion"), F.concat(F.lit("claim on "), "quote")),
    )
    edges = F.array(edge("E1", "T1", "C1", "supports", F.lit(True)), edge(F.when(f == 5, "E1").otherwise("E2"), F.when(f == 6, "X9").otherwise(second), "C1", F.when(f == 7, "supports").otherwise("maps_to"), F.lit(True)))
    rows = rows.withColumns({"nodes": nodes.cast(NODES), "edges": edges.cast(EDGES), "ids": F.array(F.lit("T1"), second)})
    return rows.withColumn("motif", F.when(f == 8, "no_such_motif").when(f == 9, "premise_constraint_to_claim").otherwise("premise_mapping_to_claim"))


# faults 4 needs an image; the duplicated node id of fault 1 comes before all others
GRAPH_SQL = "CASE doc_id % 11 WHEN 1 THEN CASE WHEN condition = 'T' THEN 'graph_node_id' ELSE 'graph_evidence_id_prefix' END WHEN 2 THEN 'graph_text_not_literal' WHEN 3 THEN 'graph_claim_type' WHEN 4 THEN CASE WHEN condition = 'TLV' THEN 'graph_image_order_invalid' END WHEN 5 THEN 'graph_edge_id' WHEN 6 THEN 'graph_dangling_edge' END"


def _graph_fault() -> Column:
    return G.graph_fault(F.col("nodes"), F.col("edges"), F.col("text"), F.col("title"), F.lit(1), F.col("condition"))


@query("graph_faults", f"WITH {BASE_SQL} SELECT doc_id, {GRAPH_SQL} AS fault FROM d")
def graph_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constructions(spark, sf_dir, F.col("doc_id") % 11).select("doc_id", _graph_fault().alias("fault"))


@query("motif_faults", f"WITH {BASE_SQL} SELECT doc_id, CASE doc_id % 11 WHEN 7 THEN 'motif_role_relation_mismatch' WHEN 8 THEN 'motif_unknown' WHEN 9 THEN 'motif_role_mismatch' WHEN 10 THEN CASE WHEN condition = 'TLV' THEN 'motif_tlv_image_required' ELSE 'motif_non_tlv_image_forbidden' END END AS fault FROM d WHERE doc_id % 11 IN (0, 7, 8, 9, 10)")
def motif_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Motif checks of the graphs that are sound themselves."""
    rows = constructions(spark, sf_dir, F.col("doc_id") % 11).where(F.col("fault").isin(0, 7, 8, 9, 10))
    necessary = (F.col("condition") == "TLV") != (F.col("fault") == 10)
    fault = G.motif_fault(F.col("nodes"), F.col("edges"), F.col("motif"), F.col("ids"), F.lit("C1"), necessary, F.col("condition"))
    return rows.select("doc_id", fault.alias("fault"))


IMAGES = "array<struct<declared_order:int,sha256:string,bytes:bigint,path:string>>"


def with_provenance(rows: DataFrame) -> DataFrame:
    images = F.array(F.struct(F.lit(1), F.sha2(F.col("title"), 256), F.length("title").cast("bigint"), F.concat(F.lit("img/_page_"), (F.col("doc_id") % 90).cast("string"), F.lit("_1.png")))).cast(IMAGES)
    source = F.struct(F.col("title").alias("doc_id"), F.col("doc_id").cast("string").alias("chunk_id"), F.col("condition").alias("condition"), F.lit("m").alias("manifest_sha256"))
    return rows.withColumn("rho", C.node_provenance(F.col("nodes"), F.col("edges"), F.col("text"), F.col("title"), F.lit(2), images, source))


@query(
    "node_provenance",
    f"""WITH {BASE_SQL}, n AS (SELECT doc_id, text, title, condition, unnest([{{'id': 'T1', 'kind': 'text', 'value': quote}}, {{'id': CASE condition WHEN 'TLV' THEN 'I2' WHEN 'T' THEN 'T2' ELSE 'S2' END, 'kind': CASE condition WHEN 'TLV' THEN 'image' WHEN 'T' THEN 'text' ELSE 'structure' END, 'value': lower(quote)}}, {{'id': 'C1', 'kind': 'claim', 'value': ''}}]) AS n FROM d)
    SELECT doc_id, n.id AS node_id, CASE WHEN n.kind = 'claim' THEN list_aggregate(list_sort(['T1', CASE condition WHEN 'TLV' THEN 'I2' WHEN 'T' THEN 'T2' ELSE 'S2' END]), 'string_agg', ',') END AS derived_from, CASE WHEN n.kind = 'text' THEN sha256(text) END AS text_sha256,
    CAST(CASE WHEN n.kind = 'text' AND contains(text, n.value) THEN strpos(text, n.value) - 1 END AS BIGINT) AS span_start, CASE WHEN n.kind = 'text' THEN CASE WHEN contains(text, n.value) THEN 'exact' ELSE 'normalized' END END AS match,
    CASE WHEN n.kind = 'structure' THEN title END AS section_title, CASE WHEN n.kind = 'image' THEN sha256(title) END AS image_sha256, CAST(CASE WHEN n.kind = 'image' THEN doc_id % 90 END AS INTEGER) AS page, title AS package_doc FROM n""",
)
def node_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = with_provenance(constructions(spark, sf_dir, F.lit(0))).select("doc_id", F.explode("rho").alias("p"))
    span = F.try_element_at("p.char_span", F.lit(1)).cast("bigint")
    return p.select("doc_id", "p.node_id", F.array_join("p.derived_from", ",").alias("derived_from"), "p.text_sha256", span.alias("span_start"), "p.match", "p.section_title", "p.image_sha256", "p.page", F.col("p.doc_id").alias("package_doc"))


@query(
    "construction_replay",
    f"""WITH {BASE_SQL} SELECT doc_id, CASE doc_id % 7 WHEN 1 THEN 'node_provenance_mismatch' WHEN 2 THEN 'matched_motif_not_replayable' WHEN 3 THEN 'restricted_program_mismatch' WHEN 4 THEN 'answer_atoms_not_executor_output' WHEN 5 THEN 'atom_trace_not_tracer_output' WHEN 6 THEN 'construction_receipt_mismatch' END AS fault,
    'claim on ' || quote AS atom, 'T1,' || CASE condition WHEN 'TLV' THEN 'I2' WHEN 'T' THEN 'T2' ELSE 'S2' END || ',C1' AS regions, 'select_nodes,traverse_to_claim,read_value,return_atoms' AS operations FROM d""",
)
def construction_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constructions are built, one stage of most is tampered with, and all are replayed."""
    rows = with_provenance(constructions(spark, sf_dir, F.lit(0)))
    parts = [F.col(c) for c in ("nodes", "edges", "motif", "ids")]
    rows = rows.withColumn("made", C.construction(*parts, F.lit("C1"), F.col("rho")))
    k, m = F.col("doc_id") % 7, F.col("made")
    drop = lambda c: F.slice(c, F.lit(1), F.size(c) - 1)
    tampered = (
        F.when(k == 1, m.withField("provenance", drop(m["provenance"]))).when(k == 2, m.withField("motif", F.lit("other"))).when(k == 3, m.withField("program", drop(m["program"])))
        .when(k == 4, m.withField("atom", m["atom"].withField("value", F.lit("forged")))).when(k == 5, m.withField("trace", m["trace"].withField("regions", drop(m["trace"]["regions"])))).when(k == 6, m.withField("receipt", F.lit("0"))).otherwise(m)
    )
    fault = C.replay_fault(tampered, *parts, F.lit("C1"), F.col("rho"))
    region_ids = F.transform(m["trace"]["regions"], lambda r: r["node_id"])
    return rows.select("doc_id", fault.alias("fault"), m["atom"]["value"].alias("atom"), F.array_join(region_ids, ",").alias("regions"), F.array_join(F.transform(m["program"], lambda s: s["op"]), ",").alias("operations"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Realised items with planted faults, joined to their evidence by document and condition; every 17th has none."""
    cells = constructions(spark, sf_dir, F.lit(0)).withColumn("atom", G.atom(F.col("nodes"), F.col("edges"), F.col("ids"), F.lit("C1"))).where("doc_id % 17 <> 0")
    k = F.col("doc_id") % 7
    base = evidence(spark, sf_dir)
    second = F.when(F.col("condition") == "TLV", "I2").when(F.col("condition") == "T", "T2").otherwise("S2")
    claim = F.concat(F.lit("claim on "), "quote")
    value = F.when(F.col("condition") == "TLV", F.lit("image 1")).when(F.col("condition") == "T", F.lower("quote")).otherwise(F.upper("title"))
    source = F.when(F.col("condition") == "TLV", "image").when(F.col("condition") == "T", "text").otherwise("structure")
    anchor = lambda i, s, v: F.struct(i.alias("evidence_id"), s.alias("source"), v.alias("support"))
    anchors = F.array(anchor(F.lit("T1"), F.lit("text"), F.col("quote")), anchor(F.when(k == 6, "T1").otherwise(second), source, F.when(k == 5, "changed").otherwise(value)))
    body = F.struct(
        F.array(F.when(k == 1, "A2").otherwise("A1")).alias("answer_atom_ids"), F.array(F.when(k == 2, "changed").otherwise(claim)).alias("answer_parts"),
        F.array(*[F.lit(s) for s in ("S1", "S2", "S3")], F.when(k == 3, "S9").otherwise("S4")).alias("program_trace"), F.lit("q").alias("question"),
        F.array(F.when(k == 4, "zzz qqq").otherwise(F.upper(claim)), F.lit("b"), F.lit("c"), F.lit("d")).alias("choices"), F.lit(0).alias("answer_index"), F.lit("r").alias("rationale"), anchors.alias("evidence_anchor"),
    )
    rows = base.select("doc_id", "condition", F.parse_json(F.to_json(body)).alias("value"))
    return rows.join(cells, ["doc_id", "condition"], "left")


@query("realised_faults", f"WITH {BASE_SQL} SELECT doc_id, CASE doc_id % 7 WHEN 1 THEN 'ecm_answer_atom_ids_changed' WHEN 2 THEN 'ecm_answer_atoms_changed' WHEN 3 THEN 'ecm_program_trace_changed' WHEN 4 THEN 'ecm_selected_choice_not_bound_to_atom:disjoint' WHEN 5 THEN 'ecm_evidence_anchor_not_locked' WHEN 6 THEN 'ecm_evidence_anchor_not_locked' END AS reason FROM d WHERE doc_id % 17 <> 0")
def realised_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir).where("atom is not null")
    return rows.select("doc_id", C.realised_fault(F.col("value"), F.col("nodes"), F.col("ids"), F.col("atom")).alias("reason"))


def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = C.audit_errors(F.col("value"), F.lit("ecm"), F.col("text"), F.col("title"), F.lit(1), F.col("condition"), F.col("nodes"), F.col("ids"), F.col("atom"))
    rows = ledger(spark, sf_dir)
    return rows.select("doc_id", F.when(F.col("atom").isNull(), F.array(F.lit("evidence_missing"))).otherwise(errors).alias("errors"))


AUDIT_SQL = "a AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'evidence_missing' ELSE CASE doc_id % 7 WHEN 1 THEN 'ecm_answer_atom_ids_not_locked' WHEN 2 THEN 'ecm_answer_parts_not_executor_atoms' WHEN 3 THEN 'ecm_program_trace_not_locked' WHEN 4 THEN 'ecm_selected_choice_not_bound_to_atom:disjoint' END END AS error FROM d)"


@query("mechanical_audit", f"WITH {BASE_SQL}, {AUDIT_SQL} SELECT doc_id, CASE WHEN error IS NULL THEN 'PASS' ELSE 'FAIL' END AS status, coalesce(error, '') AS errors FROM a")
def mechanical_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(spark, sf_dir).select("doc_id", F.when(F.size("errors") == 0, "PASS").otherwise("FAIL").alias("status"), F.array_join("errors", ",").alias("errors"))


@query("audit_summary", f"WITH {BASE_SQL}, {AUDIT_SQL} SELECT coalesce(error, 'PASS') AS code, count(*) AS n FROM a GROUP BY 1")
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by error code; PASS for those without one."""
    codes = F.when(F.size("errors") == 0, F.array(F.lit("PASS"))).otherwise(F.col("errors"))
    return audited(spark, sf_dir).select(F.explode(codes).alias("code")).groupBy("code").agg(F.count("*").alias("n"))
