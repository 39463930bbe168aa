import pytest

from quillspark.functions import fuzzy
from quillspark.functions import model_json as J

CASES = [
    ('{"a": 1}', '{"a":1}', "strict"), ('```json\n{"a": "é"}\n```', '{"a":"é"}', "strict"), ('```\n{"a": 1}', '{"a":1}', "strict"), ('{"a": "x\\* y"}', '{"a":"x\\\\* y"}', "escapes"),
    ('Sure: {"a": "}{"} and so on', '{"a":"}{"}', "first_object"), ('{"a": [1, 2}', '{"a":[1,2]}', "closers"), ('{"a": {"b": [1, {"c": 2]}}', '{"a":{"b":[1,{"c":2}]}}', "closers"),
    ('{"a": [1, 2', None, "truncated"), ('{"a": "xy', None, "truncated"), ("[1, 2]", None, "not_object"), ("", None, "empty"), (None, None, "empty"), ("no json", None, "invalid"),
]


@pytest.mark.parametrize(("raw", "value", "how"), CASES)
def test_parse(raw, value, how):
    assert J.parse(raw) == (value, how)


def test_column(spark):
    rows = spark.createDataFrame([(i, r) for i, (r, _, _) in enumerate(CASES)], "i int, raw string")
    got = [tuple(r.p) for r in rows.select("i", J.parsed(rows.raw).alias("p")).orderBy("i").collect()]
    assert got == [(v, h) for _, v, h in CASES]


def test_fuzzy_only_where_exact_rules_fail(spark):
    options = ["A. the court of appeal decides on it", "B. the court of first instance decides", "C. nobody", "D. all"]
    rows = [(1, options, "the court of appeal decides on itt"), (2, options, "nobody"), (3, options, "something else"), (4, ["A. xxxxxxxxxxxxxxxxxxxxxxxxx1", "B. xxxxxxxxxxxxxxxxxxxxxxxxx2"], "xxxxxxxxxxxxxxxxxxxxxxxxx3")]
    got = {r.id: (r.method, r.gold_index) for r in fuzzy.resolved(spark.createDataFrame(rows, "id int, candidate_answers array<string>, ground_truth string")).collect()}
    assert got == {1: ("fuzzy_payload", 0), 2: ("payload_match", 2), 3: ("unresolved", None), 4: ("unresolved", None)}
