import pytest
from pyspark.sql import functions as F

from tesserae.functions import entries
from tesserae.operators import workflow


def test_layers_with_cycle(spark):
    nodes = spark.createDataFrame([(n, i) for i, n in enumerate("abcdxyz")], "node string, place int")
    edges = spark.createDataFrame([*map(tuple, ["ab", "bc", "ac", "ab", "xy", "yx", "cx", "d?"])], "source string, target string")
    got = {r.node: r.depth for r in workflow.layers(nodes, edges).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 0, "z": 0, "x": 3, "y": 5}
    assert {r.depth for r in workflow.layers(nodes.where("node in ('x', 'y')"), edges).collect()} == {4, 5}
    assert workflow.layers(nodes.limit(0), edges).count() == 0


def test_release(spark):
    r = spark.createDataFrame([("a", True, "1"), ("b", False, None)], "release_id string, is_active boolean, activated_at string")
    assert {tuple(x) for x in workflow.activate(r, "b", "2").collect()} == {("a", False, "1"), ("b", True, "2")}
    with pytest.raises(ValueError):
        workflow.activate(r, "c", "2")


def test_sessions(spark):
    key = "k" * 32
    requests = spark.createDataFrame([(1, f"Bearer {key}"), (2, "Bearer short"), (3, None), (4, f"BEARER  {key}"), (5, f"Bearer {key} x")], "request_id int, authorization string")
    cred = spark.createDataFrame([(key, 7)], "k string, editor_id int").select(F.sha2("k", 256).alias("token_sha256"), "editor_id", F.expr("cast(null as timestamp) expires_at"), F.expr("cast(null as timestamp) revoked_at"))
    editors = spark.createDataFrame([(7, True, False)], "editor_id int, is_active boolean, is_machine boolean")
    roles = spark.createDataFrame([(7, True, None), (7, False, None)], "editor_id int, may_review boolean, revoked_at timestamp")
    run = lambda e, r: {x.request_id: x.status for x in workflow.authenticate(requests, cred, e, r, F.current_timestamp()).collect()}
    assert run(editors, roles) == {1: 200, 2: 401, 3: 401, 4: 200, 5: 401}
    assert run(editors, roles.limit(0))[1] == 403 and run(editors.withColumn("is_machine", F.lit(True)), roles)[1] == 401


def test_entry_fields(spark):
    df = spark.createDataFrame([(" a : 1 \r\nb:\n:c\na:2:3\nplain", b"\x01\x02\xff"), (None, None)], "t string, b binary")
    got = df.select(entries.metadata_fields(F.col("t")).alias("m"), entries.decode_bytes(F.col("b"), {1: "x", 2: ""}).alias("s")).collect()
    assert [r.m for r in got] == [{"a": ["1", "2:3"]}, {}] and [r.s for r in got] == ["x[ff]", ""]
