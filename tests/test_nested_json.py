import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from loomwork.operators.nested_json import child_rows, extract, index
from tests.conftest import rows

ASHBY = {"jobs": [{"id": "a", "compensation": {"compensationTierSummary": " x ", "compensationTiers": {"components": [None, {"minValue": 1}, {}]}}}, None]}


def found(adapter, payload):
    return sorted(x[1:5] for x in extract([(1, adapter, payload)]))


def valid(texts):
    return index([t.encode() for t in texts]).valid.tolist()


def test_children_keep_their_places():
    green = {"jobs": {"id": 7, "metadata": [None, {"value": ["", "b", 0, False, []]}, {"value": {"k": 1}}, {"value": "  "}, {"value": 0}, {}]}}
    assert found("greenhouse", json.dumps(green)) == [("7", "metadata", 1, 1), ("7", "metadata", 1, 2), ("7", "metadata", 1, 3), ("7", "metadata", 2, 0), ("7", "metadata", 4, 0)]
    assert found("ashby", json.dumps(ASHBY)) == [("a", "compensation", 0, 0), ("a", "component", 0, 1), ("a", "component", 0, 2)]
    assert found("lever", json.dumps([{"id": "l", "lists": [{"text": "t"}, {"text": None}]}])) == [("l", "list", 0, 0)]
    assert found("workable", json.dumps({"jobs": [{"shortcode": "w", "locations": [None, {"country": "X"}]}]})) == [("w", "location", 1, 0)]


def test_wrapped_encoded_and_marked_payloads_give_the_same():
    plain = json.dumps(ASHBY)
    deep = ASHBY
    for name in ("data", "result", "response", "payload") * 3:
        deep = {"status": 200, name: deep}
    for payload in (json.dumps({"status": 200, "data": ASHBY}), json.dumps(deep), json.dumps(plain), json.dumps(json.dumps(plain)), "﻿" + plain, json.dumps(ASHBY, indent=1)):
        assert found("ashby", payload) == found("ashby", plain)


def test_no_rows_for_what_is_no_complete_json():
    plain = json.dumps(ASHBY)
    for payload in (None, "", " ", "null", "[]", "<html></html>", plain[:-3], plain + "}", plain.replace(":", "", 1), "{" * 500, "[" * 3 + "]" * 3):
        assert found("ashby", payload) == []
    assert list(extract([(1, None, plain), (2, "unknown", plain)])) == []


@settings(max_examples=150, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x), max_leaves=12), st.data())
def test_validity_agrees_with_a_json_reader(value, data):
    text = json.dumps(value, ensure_ascii=data.draw(st.booleans()))
    at = data.draw(st.integers(0, max(0, len(text) - 1)))
    broken = text[:at] + data.draw(st.sampled_from(["", '"', "{", "]", ",", ":", "\\", "1", "x", "\n"])) + text[at + data.draw(st.integers(0, 2)) :]

    def ok(t):
        try:
            json.loads(t, parse_constant=lambda _: 1 / 0)
            return True
        except (ValueError, ZeroDivisionError):
            return False

    broken = broken.encode("utf-8", "replace").decode()
    assert valid([text.encode("utf-8", "replace").decode(), broken, "{}"]) == [True, ok(broken), True]


def test_numbers_that_json_lacks_are_invalid():
    assert valid(["[NaN]", "[Infinity]", "[-Infinity]", "[1e5]"]) == [False, False, False, True]


def test_last_of_equal_members_counts_and_escaped_names_are_read():
    assert found("lever", '[{"id": "a", "id": "b", "li\\u0073ts": [{"text": "t"}]}]') == [("b", "list", 0, 0)]


def test_long_payload_and_repeated_rows(spark):
    many = json.dumps([{"id": str(i), "lists": [{"text": "x" * random.Random(i).randrange(200)}]} for i in range(5000)])
    assert len(found("lever", many)) == sum(random.Random(i).randrange(200) > 0 for i in range(5000))
    df = spark.createDataFrame([(1, "ashby", json.dumps(ASHBY), "v")] * 2 + [(2, None, None, "v")], "payload_id bigint, adapter string, payload string, value string")
    assert len(rows(child_rows(df))) == 6
    assert rows(child_rows(df.limit(0))) == []
