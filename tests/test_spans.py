import json

from hypothesis import given, settings
from hypothesis import strategies as st

from sessionloom.functions import spans

VALUES = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=8)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.text(max_size=4), VALUES, max_size=5), st.booleans(), st.sampled_from([None, 1]))
def test_members_are_cut_where_they_stand(d, ascii_, indent):
    s = json.dumps(d, ensure_ascii=ascii_, indent=indent)
    assert [(k, json.loads(s[b:e])) for k, b, e in spans.members(s)] == list(d.items())


@settings(max_examples=100, deadline=None)
@given(st.lists(VALUES, max_size=5))
def test_entries_are_byte_exact(x):
    s = json.dumps({"é": "ü", "entries": x}, ensure_ascii=False)
    assert [json.loads(s.encode()[r["offset"] : r["offset"] + r["length"]]) for r in spans.entry_spans(s)] == x


def test_attributes_keep_order_and_numbers():
    assert spans.attributes_of('{"b":1.50,"message":{"id":"m","content":[1]},"toolUseResult":{},"a":1e5}') == '{"b":1.50,"message":{"id":"m"},"a":1e5}'
    assert spans.attributes_of('{"message": {"content": ""}, "z": 0}') == '{"z":0}' and spans.attributes_of("[") is None and spans.attributes_of(None) is None


def test_times_and_paths():
    assert spans.embedded_time("Friday, Jan 2, 2026, 3:04 PM (UTC+1)") == "2026-01-02T14:04:00.000Z"
    assert spans.embedded_time("Friday, January 2, 2026, 3:04 PM (UTC-2:30)") == "2026-01-02T17:34:00.000Z" and spans.embedded_time("Friday, Jan 2, 2026, 3:04 PM (UTC)") == "2026-01-02T15:04:00.000Z"
    assert spans.embedded_time("Friday, Jan 2, 2026, 3:04 PM") is None
    assert spans.embedded_time("Monday, Jan 2, 2026, 3:04 PM (UTC+1)") is None and spans.embedded_time("x") is None
    for raw in (b"a/b", "é%".encode(), b"\xff%41x"):
        assert spans.percent_decode(*spans.percent_encode(raw)) == raw


def test_udfs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([('{"entries":[1,"é"],"toolUseResult":1}', "a\nb", "a\nc"), (None, None, "x")], "j string, a string, b string")
    got = df.select(spans.attributes_udf("j").alias("j"), F.size(spans.entry_spans_udf("j")).alias("n"), spans.diff_udf("a", "b").alias("d")).collect()
    assert got[0].j == '{"entries":[1,"é"]}' and got[0].n == 2 and got[0].d[0].lines == [" a", "-b", "+c"] and got[1].d is None
