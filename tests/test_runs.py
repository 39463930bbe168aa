"""Providers, sinks, manifests, splits, screening and settings."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillspark import config
from quillspark.functions.unicode import composed, without_diacritics
from quillspark.operators import ledger, media, providers, runs, steps
from quillspark.sources import sinks, tables


def test_policies_and_backoff():
    asked = []

    def provider(texts):
        asked.append(list(texts))
        return [providers.CallError("busy", 503) if t == "b" else providers.CallError("no", 400) if t == "c" else t.upper() for t in texts]

    assert providers.call(provider, ["a", "b", "c"], providers.transient, 2, 0.0) == [("A", None, 0), (None, "busy", 2), (None, "no", 0)]
    assert asked == [["a", "b", "c"], ["b"], ["b"]]
    assert providers.call(provider, ["b"], providers.truncated_only, 2, 0.0) == [(None, "busy", 0)] and providers.always(ValueError())
    broken = lambda texts: 1 / 0
    assert providers.call(broken, ["a"], providers.transient, 1, 0.0) == [(None, "ZeroDivisionError", 1)]


def test_dry_run_calls_nothing(spark):
    plan = spark.createDataFrame([(1, "p")], "id int, prompt string")
    assert providers.executed(plan, "prompt", None, lambda raw: raw).first().status == "DRY_RUN"


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "report.json")
    sinks.write_report(spark, path, {"b": 1, "a": "ü"})
    sinks.write_report(spark, path, {"b": 2})
    assert json.load(open(path)) == {"b": 2} and [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["report.json"]
    rows = spark.createDataFrame([("r", "e")], "run_id string, experiment_id string")
    sinks.append_ledger(rows, str(tmp_path / "ledger"))
    with pytest.raises(Exception, match="already exists"):
        sinks.append_ledger(rows, str(tmp_path / "ledger"))
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.md").write_text("one\ntwo\n")
    assert [tuple(r) for r in tables.texts(spark, str(tmp_path / "d")).select("doc_id", "text").collect()] == [("a", "one\ntwo\n")]


def test_layout(tmp_path):
    old, new = tmp_path / "data", tmp_path / "data" / "output"
    (new / "interim" / "contexts").mkdir(parents=True)
    assert sinks.layout(str(old), str(new)) == str(new) and sinks.layout(str(new), str(old)) == str(new)
    (new / "interim" / "contexts" / "c.json").write_text("{}")
    assert sinks.layout(str(old), str(new)) == str(new)


def test_manifest_of_one_chunk(spark):
    good = [("c", "T", ["text"], "t", None, None, None), ("c", "TL_struct", ["document_structure", "text"], "t", "s", [1], None), ("c", "TLV", ["text", "images", "document_structure"], "t", "s", [1], 1)]
    schema = "chunk_id string, condition string, keys array<string>, text string, structure string, declared array<int>, images int"
    assert runs.manifest_faults(spark.createDataFrame(good, schema), 3).count() == 0
    faults = {r.fault for r in runs.manifest_faults(spark.createDataFrame([*good, good[0], ("d", "X", ["text"], "t", None, None, None)], schema), 3).collect()}
    assert faults == {"duplicate_chunk_condition", "invalid_package", "incomplete_chunk_x_condition", "unexpected_manifest"}


def test_splits_keep_rows_without_document(spark):
    rows = spark.createDataFrame([(k, None if k % 7 == 0 else k % 5, False) for k in range(100)], "id int, doc int, mm boolean")
    got = ledger.document_splits(rows, "doc", "mm", 1).collect()
    assert len(got) == 100 and len({(r.doc, r.split) for r in got}) == len({r.doc for r in got}) == 6


def test_pairing_guards(spark):
    verdicts = spark.createDataFrame([("a", "VISUAL_DEPENDENT")], "fingerprint string, verdict string")
    with pytest.raises(Exception, match="verdict_without_item"):
        runs.accepted_items(verdicts, spark.createDataFrame([("b", 1)], "fingerprint string, x int")).collect()
    with pytest.raises(Exception, match="duplicate_item_fingerprint"):
        runs.accepted_items(verdicts, spark.createDataFrame([("a", 1), ("a", 2)], "fingerprint string, x int")).collect()


def test_screening_in_order(spark):
    text = "x " * 150
    chunks = spark.createDataFrame([(1, text), (2, text), (3, text + "y"), (4, text + "z"), (5, "short")], "chunk_id int, text string")
    images = spark.createDataFrame([(1, 0, "i", 9000, 100, 100, "s1"), (2, 0, "i", 9000, 100, 100, "s9"), (3, 0, "i", 9000, 100, 100, "s1"), (4, 0, "i", 9000, 100, 100, "s1"), (4, 1, "i", 9000, 100, 100, "s2")], "chunk_id int, pos int, name string, bytes int, width int, height int, sha256 string")
    got = {r.chunk_id: (r.decision, list(r.reasons)) for r in media.screened(chunks, images).collect()}
    assert got == {1: ("ACCEPT", []), 2: ("REJECT", ["duplicate_text_of:1"]), 3: ("REJECT", ["no_usable_image_after_screening"]), 4: ("ACCEPT", []), 5: ("REJECT", ["text_too_short:5<200", "no_declared_image"])}


def test_screening_as_taken_one_by_one(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, rng.randrange(40), sorted({rng.randrange(60) for _ in range(rng.randrange(1, 4))})) for i in range(400)]
    chunks = spark.createDataFrame([(i, "x " * 150 + str(t)) for i, t, _ in rows], "chunk_id int, text string")
    images = spark.createDataFrame([(i, k, "i", 9000, 100, 100 if g % 7 else 10, str(g)) for i, _, gs in rows for k, g in enumerate(gs)], "chunk_id int, pos int, name string, bytes int, width int, height int, sha256 string")
    owner, taken, want = {}, set(), {}
    for i, t, gs in rows:
        new = {g for g in gs if g % 7} - taken
        want[i] = [f"duplicate_text_of:{owner[t]}"] if t in owner else [] if new else ["no_usable_image_after_screening"]
        if not want[i]:
            owner[t] = i
            taken |= new
    held, calls = media._held, []
    monkeypatch.setattr(media, "_held", lambda df: calls.append(1) or held(df))
    for at_once in (0, 30, 10_000):  # in rounds alone, both, in one task alone
        monkeypatch.setattr(media, "AT_ONCE", at_once, raising=False)
        calls.clear()
        assert {r.chunk_id: list(r.reasons) for r in media.screened(chunks, images).collect()} == want
        assert len(calls) <= 40


def test_blindness(spark):
    anchors = "array<struct<atom_id:string,excerpt:string>>"
    text = " ".join(f"w{i}" for i in range(100))
    rows = spark.createDataFrame([([("a0", "w1 w2"), ("a1", "w3")],), ([("a0", " ".join(["w"] * 41))],)], f"anchors {anchors}")
    got = [list(r[0]) for r in rows.select(steps.blindness_errors(F.col("anchors"), F.lit(text))).collect()]
    assert got == [[], ["excerpt_leak_ratio:0.410", "a0:excerpt_too_long"]]


def test_jpeg_size(spark):
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x30\x00\x40\x03" + b"\0" * 20
    rows = spark.createDataFrame([(1, bytearray(jpeg)), (2, bytearray(b"no")), (3, None)], "id int, content binary")
    assert [tuple(r.s) if r.s else None for r in rows.orderBy("id").select(media.jpeg_size("content").alias("s")).collect()] == [(64, 48), (None, None), (None, None)]


def test_unicode(spark):
    rows = spark.createDataFrame([("Đường phố",), ("éạ",), (None,)], "t string")
    assert [tuple(r) for r in rows.select(without_diacritics("t"), composed("t")).collect()] == [("Đuong pho", "Đường phố"), ("ea", "éạ"), (None, None)]


def test_settings_and_stages(spark):
    s = config.from_environment(config.Settings(), {"QUILL_ROOT": "/r", "QUILL_JUDGE": "m"})
    assert (s.root, s.judging.model, s.data) == ("/r", "m", "data")
    add = lambda n: lambda rows, settings: rows.withColumn(n, F.lit(settings.seed))
    stages = [("one", add("a")), ("two", add("b")), ("three", add("c"))]
    assert config.run_stages(spark.range(1), s, stages, start="two").columns == ["id", "b", "c"]
