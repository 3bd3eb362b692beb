"""JSON repair and redaction."""
import json

from pyspark.sql import functions as F

from textquarry.functions import jsontext as J


def test_repair():
    for text, want in [('{"b": 1, "a": [2]}', '{"a":[2],"b":1}'), ('```json\n{"a": 1,}\n```', '{"a":1}'), ('say {"a": {"b": [1, 2', '{"a":{"b":[1,2]}}'), ('{"a": "un', '{"a":"un"}'), ('{"a": "x\\"y"', '{"a":"x\\"y"}'), ("[1]", None), ("none", None), ("", None), (None, None), ('{"a": 1, ', '{"a":1}')]:
        assert J.repair(text) == want, text


def test_redaction(spark):
    data = {"a": [{"api_key": "k", "note": {"Authorization": "t", "n": 1}}], "content": "long", "x": None}
    df = spark.createDataFrame([(json.dumps(data),), ("no json",), (None,), ("",)], "j string")
    got = [r.j for r in df.select(J.redacted_json(F.col("j")).alias("j")).collect()]
    assert json.loads(got[0]) == {"a": [{"api_key": "[redacted]", "note": {"Authorization": "[redacted]", "n": 1}}], "content": "long", "x": None} and got[1:] == ["no json", None, ""]
    assert json.loads(df.select(J.redacted_json(F.col("j"), True).alias("j")).first().j)["content"] == "[omitted]"
