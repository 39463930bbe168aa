"""Contracts of generated items, as column expressions: anchors, answer binding, responses, constructions and their replay.

Model output is read as VARIANT, so that types count: true is no index and "1" is no number. Every check reports the
code of the first rule that fails; nothing is collected, and a row's result depends on that row alone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import casefold, fold_normalize, strip
from quillspark.operators import graphs as G

# The fields of each kind of response, the reasons a model may give, program steps and versions.
CORE = ("question", "choices", "answer_index", "rationale", "evidence_anchor")
MORE = {"direct": (), "answer_first": ("evidence_excerpt", "answer"), "ecm": ("answer_atom_ids", "answer_parts", "program_trace")}
REJECTS = ("insufficient_evidence",)
STEPS = ("S1", "S2", "S3", "S4")
OPERATIONS = ("select_nodes", "traverse_to_claim", "read_value", "return_atoms")
MIN_TOKEN_RATIO = 0.5


def _type(v: Column) -> Column:
    return F.schema_of_variant(v)


def _at(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _text(v: Column) -> Column:
    """A variant's string, null if it is something else."""
    return F.when(_type(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _list(v: Column) -> Column:
    return F.when(_type(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))


def _keys(v: Column) -> Column:
    return F.when(_type(v).startswith("OBJECT"), F.array_sort(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))))


def _strings(v: Column) -> Column:
    return F.transform(_list(v), _text)


# --- parsing -----------------------------------------------------------------------------------


def without_fence(raw: Column) -> Column:
    """Text inside one surrounding code fence without a language or with json; other text as it is."""
    text = strip(raw)
    head = F.lower(strip(F.regexp_extract(text, r"^```([^\n]*)\n", 1)))
    body = F.regexp_replace(text, r"^```[^\n]*\n", "")
    closed = F.regexp_extract(body, r"(?s)^(.*)```", 1)
    return F.when(text.rlike(r"^```[^\n]*\n") & head.isin("", "json"), F.when(body.contains("```"), closed).otherwise(body)).otherwise(raw)


def parsed(raw: Column) -> Column:
    """struct(value, repairs): the first of the text, the text without fence and the text without stray \\* that is JSON."""
    bare = without_fence(raw)
    star = F.regexp_replace(bare, r"(?<!\\)\\\*", "*")
    fence = F.when(bare != raw, "stripped_markdown_code_fence")
    escape = F.when(star != bare, "invalid_json_escape:\\*->*")
    whole = F.try_parse_json(raw)
    first, second = F.try_parse_json(bare), F.try_parse_json(star)
    repairs = F.when(whole.isNotNull(), F.array().cast("array<string>")).when(first.isNotNull(), F.array_compact(F.array(fence))).otherwise(F.array_compact(F.array(fence, escape)))
    return F.struct(F.coalesce(whole, first, second).alias("value"), repairs.alias("repairs"))


# --- anchors and binding -----------------------------------------------------------------------


def anchor_errors(anchors: Column, text: Column, title: Column, images: Column, condition: Column, label: str = "anchor") -> Column:
    """Codes of a VARIANT list of anchors {source, support}, with the anchor's place."""

    def one(a: Column, i: Column) -> Column:
        source, support = _text(_at(a, "source")), _text(_at(a, "support"))
        where = F.concat(F.lit(f"{label}:"), (i + 1).cast("string"), F.lit(":"))
        sound = F.coalesce(_keys(a) == F.array(F.lit("source"), F.lit("support")), F.lit(False))
        order = G.image_order(support)
        code = (
            F.when(~sound, "schema")
            .when(~F.coalesce(G.allowed(source, condition), F.lit(False)) | support.isNull() | (strip(support) == ""), "invalid_source_or_support")
            .when((source == "text") & ~F.contains(fold_normalize(F.coalesce(text, F.lit(""))), fold_normalize(support)), "text_not_literal")
            .when((source == "structure") & ((F.coalesce(title, F.lit("")) == "") | (fold_normalize(support) != fold_normalize(F.coalesce(title, F.lit(""))))), "structure_not_section_title")
            .when((source == "image") & ~F.coalesce(order.between(1, images), F.lit(False)), "image_order_not_identified")
        )
        return F.when(code.isNotNull(), F.concat(where, code))

    rows = _list(anchors)
    return (
        F.when(~condition.isin(*G.SOURCES), F.array(F.lit(f"{label}:invalid_condition")))
        .when(rows.isNull() | (F.size(rows) == 0), F.array(F.lit(f"{label}:missing")))
        .otherwise(F.array_compact(F.transform(rows, one)))
    )


def binding(atom: Column, choice: Column) -> Column:
    """struct(ok, relation, token_ratio): whether an option is a surface form of an atom. One holds the other, and the
    shorter has half of the longer one's words at least."""
    a, b = fold_normalize(atom), fold_normalize(choice)
    na, nb = F.size(F.split(a, " ")), F.size(F.split(b, " "))
    relation = F.when((a == "") | (b == ""), "empty").when(a == b, "identical").when(F.contains(a, b), "choice_within_atom").when(F.contains(b, a), "atom_within_choice").otherwise("disjoint")
    ratio = F.when(relation.isin("empty", "disjoint"), 0.0).otherwise(F.round(F.least(na, nb) / F.greatest(na, nb), 4))
    return F.struct((ratio >= MIN_TOKEN_RATIO).alias("ok"), relation.alias("relation"), ratio.alias("token_ratio"))


# --- responses ---------------------------------------------------------------------------------


def core_fault(value: Column, method: Column) -> Column:
    """First fault of a parsed response that concerns its form: object, own refusal, fields, types, distinct options."""
    keys = _keys(value)
    need = F.array(*[F.lit(x) for x in CORE])
    for name, more in MORE.items():
        need = F.when(method == name, F.array(*[F.lit(x) for x in (*CORE, *more)])).otherwise(need)
    missing = F.array_sort(F.array_except(need, keys))
    refusal = _text(_at(value, "reject_reason"))
    choices = _strings(_at(value, "choices"))
    index = F.when(_type(_at(value, "answer_index")) == "BIGINT", F.try_variant_get(value, "$.answer_index", "bigint"))
    filled = lambda c: F.coalesce(strip(c) != "", F.lit(False))
    sound = filled(_text(_at(value, "question"))) & filled(_text(_at(value, "rationale"))) & F.coalesce((F.size(choices) == 4) & F.forall(choices, filled), F.lit(False)) & F.coalesce(index.between(0, 3), F.lit(False))
    return (
        F.when(value.isNull(), "invalid_json")
        .when(keys.isNull(), "json_not_object")
        .when((keys == F.array(F.lit("reject_reason"))) & refusal.isin(*REJECTS), F.concat(F.lit("model_"), refusal))
        .when(F.size(missing) > 0, F.concat(F.lit("missing:"), F.array_join(missing, ",")))
        .when(~sound, "invalid_core_schema")
        .when(F.size(F.array_distinct(F.transform(choices, fold_normalize))) != 4, "duplicate_choices")
    )


def choice(value: Column) -> Column:
    """The option that a sound response marks."""
    return F.try_element_at(_strings(_at(value, "choices")), (F.try_variant_get(value, "$.answer_index", "int") + 1))


def response_fault(value: Column, method: Column, text: Column, title: Column, images: Column, condition: Column) -> Column:
    """First fault of a direct or answer-first response, null if it is accepted."""
    found = anchor_errors(_at(value, "evidence_anchor"), text, title, images, condition)
    agreed = F.coalesce((_text(_at(value, "answer")) == choice(value)) & _text(_at(value, "evidence_excerpt")).isNotNull(), F.lit(False))
    return F.coalesce(
        core_fault(value, method),
        F.when(F.size(found) > 0, F.concat(F.lit("invalid_evidence_anchor:"), F.element_at(found, 1))),
        F.when((method == "answer_first") & ~agreed, "answer_first_inconsistent"),
    )


def realised_fault(value: Column, nodes: Column, evidence: Column, atom: Column) -> Column:
    """First fault of a realised item against its locked construction: nodes, evidence ids of the motif, the atom."""
    anchors = _list(_at(value, "evidence_anchor"))
    node_of = lambda i: F.try_element_at(F.filter(nodes, lambda n: n["id"] == i), F.lit(1))
    bound = binding(atom["value"], choice(value))
    ids = F.transform(anchors, lambda a: _text(_at(a, "evidence_id")))

    def code(a: Column, i: Column) -> Column:
        node = _text(_at(a, "evidence_id"))
        locked = F.array_contains(evidence, node) & ~F.array_contains(F.slice(ids, F.lit(1), i), node) & (_text(_at(a, "source")) == node_of(node)["source"]) & (_text(_at(a, "support")) == node_of(node)["value"])
        sound = F.coalesce(_keys(a) == F.array(F.lit("evidence_id"), F.lit("source"), F.lit("support")), F.lit(False))
        return F.when(~sound, "invalid_ecm_evidence_anchor").when(~F.coalesce(locked, F.lit(False)), "ecm_evidence_anchor_not_locked")

    same = lambda name, want: F.coalesce(_strings(_at(value, name)) == want, F.lit(False))
    return F.coalesce(
        core_fault(value, F.lit("ecm")),
        F.when(~same("answer_atom_ids", F.array(F.lit("A1"))), "ecm_answer_atom_ids_changed"),
        F.when(~same("answer_parts", F.array(atom["value"])), "ecm_answer_atoms_changed"),
        F.when(~same("program_trace", F.array(*[F.lit(s) for s in STEPS])), "ecm_program_trace_changed"),
        F.when(~bound["ok"], F.concat(F.lit("ecm_selected_choice_not_bound_to_atom:"), bound["relation"])),
        F.when(anchors.isNull() | (F.size(anchors) != F.size(evidence)), "invalid_ecm_evidence_anchor"),
        F.try_element_at(F.array_compact(F.transform(anchors, code)), F.lit(1)),
    )


def audit_errors(value: Column, method: Column, text: Column, title: Column, images: Column, condition: Column, nodes: Column, evidence: Column, atom: Column) -> Column:
    """All codes of the mechanical audit of one ledger row with its evidence."""
    core = core_fault(value, method)
    anchors = anchor_errors(_at(value, "evidence_anchor"), text, title, images, condition)
    first = F.when((method == "answer_first") & ~F.coalesce(_text(_at(value, "answer")) == choice(value), F.lit(False)), "answer_first_not_selected_option")
    same = lambda name, want: F.coalesce(_strings(_at(value, name)) == want, F.lit(False))
    bound = binding(atom["value"], choice(value))
    locked = F.array(
        F.when(~same("answer_atom_ids", F.array(F.lit("A1"))), "ecm_answer_atom_ids_not_locked"),
        F.when(~same("answer_parts", F.array(atom["value"])), "ecm_answer_parts_not_executor_atoms"),
        F.when(~same("program_trace", F.array(*[F.lit(s) for s in STEPS])), "ecm_program_trace_not_locked"),
        F.when(~bound["ok"], F.concat(F.lit("ecm_selected_choice_not_bound_to_atom:"), bound["relation"])),
    )
    duplicate = F.when(core == "duplicate_choices", "duplicate_options")
    rest = F.when(method == "ecm", locked).otherwise(F.concat(anchors, F.array(first)))
    return F.when(core.isNotNull() & (core != "duplicate_choices"), F.array(F.lit("invalid_core_item"))).otherwise(F.array_compact(F.concat(F.array(duplicate), rest)))


# --- constructions -----------------------------------------------------------------------------


def node_provenance(nodes: Column, edges: Column, text: Column, title: Column, level: Column, images: Column, source: Column) -> Column:
    """One descriptor a node: where its value comes from. images: array of structs declared_order, sha256, bytes, path;
    source: struct of doc_id, chunk_id, condition, manifest_sha256."""

    def one(n: Column) -> Column:
        order = G.image_order(n["value"])
        image = F.try_element_at(images, order)
        start = F.instr(F.coalesce(text, F.lit("")), n["value"]) - 1
        is_ = lambda kind: (n["kind"] != "claim") & (n["source"] == kind)
        page = F.regexp_extract(image["path"], r"_page_(\d+)", 1).try_cast("int")
        return F.struct(
            n["id"].alias("node_id"), n["kind"].alias("kind"), n["source"].alias("source"),
            *[source[k].alias(k) for k in ("doc_id", "chunk_id", "condition", "manifest_sha256")],
            F.when(n["kind"] == "claim", F.array_sort(F.transform(F.filter(edges, lambda e: e["target"] == n["id"]), lambda e: e["source"]))).alias("derived_from"),
            F.when(is_("text") & (text != ""), F.sha2(text, 256)).alias("text_sha256"),
            F.when(is_("text") & (start >= 0), F.array(start, start + F.length(n["value"]))).alias("char_span"),
            F.when(is_("text"), F.when(start >= 0, "exact").otherwise("normalized")).alias("match"),
            F.when(is_("structure"), title).alias("section_title"), F.when(is_("structure"), level).alias("header_level"),
            F.when(is_("image"), F.coalesce(image["declared_order"], order)).alias("declared_order"),
            F.when(is_("image"), image["sha256"]).alias("image_sha256"), F.when(is_("image"), image["bytes"]).alias("image_bytes"), F.when(is_("image"), page).alias("page"),
        )

    return F.transform(nodes, one)


def program(evidence: Column, edge_ids: Column, target: Column) -> Column:
    """The only program that a matched motif compiles to: four typed steps."""
    args = (F.array_join(evidence, ","), F.concat(F.array_join(edge_ids, ","), F.lit(">"), target), F.lit("claim_nodes"), F.lit("claim_values"))
    return F.array(*[F.struct(F.lit(s).alias("id"), F.lit(o).alias("op"), a.alias("args")) for s, o, a in zip(STEPS, OPERATIONS, args, strict=True)])


def trace(atom: Column, provenance: Column) -> Column:
    """The regions that an atom rests on, in the order of its nodes."""
    of = lambda i: F.try_element_at(F.filter(provenance, lambda p: p["node_id"] == i), F.lit(1))
    return F.struct(atom["id"].alias("atom_id"), atom["edge_ids"].alias("edge_ids"), F.array(*[F.lit(s) for s in STEPS]).alias("step_ids"), F.transform(atom["node_ids"], of).alias("regions"))


def receipt(*parts: Column) -> Column:
    """sha256 of the parts as JSON."""
    return F.sha2(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)]), {"ignoreNullFields": "false"}), 256)


def construction(nodes: Column, edges: Column, motif: Column, evidence: Column, target: Column, provenance: Column) -> Column:
    """struct(provenance, program, atom, trace, receipt) of a sound graph and a matched motif."""
    atom = G.atom(nodes, edges, evidence, target)
    steps, regions = program(evidence, atom["edge_ids"], target), trace(atom, provenance)
    return F.struct(
        provenance.alias("provenance"), motif.alias("motif"), steps.alias("program"), atom.alias("atom"), regions.alias("trace"), receipt(nodes, edges, motif, provenance, steps, atom, regions).alias("receipt")
    )


def replay_fault(stored: Column, nodes: Column, edges: Column, motif: Column, evidence: Column, target: Column, provenance: Column) -> Column:
    """The first stage at which a stored construction isn't what its inputs give; null if all agree."""
    want = construction(nodes, edges, motif, evidence, target, provenance)
    differs = lambda name: ~stored[name].eqNullSafe(want[name])
    own = receipt(nodes, edges, stored["motif"], stored["provenance"], stored["program"], stored["atom"], stored["trace"])
    return F.coalesce(
        F.when(stored.isNull(), "construction_not_object"),
        F.when(differs("provenance"), "node_provenance_mismatch"),
        F.when(differs("motif"), "matched_motif_not_replayable"),
        F.when(differs("program"), "restricted_program_mismatch"),
        F.when(differs("atom"), "answer_atoms_not_executor_output"),
        F.when(differs("trace"), "atom_trace_not_tracer_output"),
        F.when(stored["receipt"] != own, "construction_receipt_mismatch"),
    )
