import hashlib
import json

from pyspark.sql import functions as F

from lorekeep.functions.canonical import canonical_envelope, canonical_json, event_id
from lorekeep.sources import journal as J


def test_canonical_json_sorts_every_depth_and_keeps_letters():
    assert canonical_json({"b": 1, "a": {"z": [1.5, None], "y": "臺"}}) == '{"a":{"y":"臺","z":[1.5,null]},"b":1}'


def test_ids_ignore_when_something_was_seen(spark):
    payloads = [('{"id":"t:1","observed_utc":"2026-01-01T00:00:00Z"}',), ('{"observed_utc":"x","id":"t:1"}',), ('{"id":"t:2"}',), ("[1]",), (None,)]
    ids = [r["id"] for r in spark.createDataFrame(payloads, "p string").select(event_id(F.lit("node.upsert"), F.col("p"), "v").alias("id")).collect()]
    assert ids[0] == ids[1] == hashlib.sha256(b'{"v":"v","op":"node.upsert","payload":{"id":"t:1"}}').hexdigest()
    assert ids[2] not in (None, ids[0]) and ids[3:] == [None, None]
    assert canonical_envelope("x", "{", "v") is None


def test_bad_lines_are_quarantined_as_they_are(spark, tmp_path):
    lines = ['{"id":"a","op":"node.upsert","observed_utc":"2026-01-01T00:00:00Z","payload":{"id":"n"}}', "{", '{"id":1,"op":"x"}', '["id"]', "", '{"id":"b","op":"config.set","payload":{"key":"k"}}']
    (tmp_path / "j.jsonl").write_text("\n".join(lines))
    good, bad = J.split_lines(J.read_lines(spark, str(tmp_path)))
    assert [r["id"] for r in good.orderBy("seq").collect()] == ["a", "b"]
    assert [r["line"] for r in bad.orderBy("seq").collect()] == lines[1:4]
    try:
        J.read_strict(spark, str(tmp_path))
    except ValueError as e:
        assert "line 2" in str(e)
    else:
        raise AssertionError


def test_segments_keep_their_order(spark, tmp_path):
    for name in ("b", "a"):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(json.dumps({"id": f"{name}{n}", "op": "config.set", "payload": {"key": "k"}}) for n in range(3)))
    got = [r["id"] for r in J.read_journal(spark, str(tmp_path)).orderBy("seq").collect()]
    assert got == ["a0", "a1", "a2", "b0", "b1", "b2"]


def test_shapes(spark):
    rows = [(0, "node.upsert", '{"id":"a"}'), (1, "node.upsert", '{"id":1}'), (2, "edge.assert", '{"from":"a","to":"b"}'), (3, "drop", "{}"), (4, "config.set", "nonsense"), (5, None, "{}")]
    good, bad = J.prepare(spark.createDataFrame([(p, o, x, None) for p, o, x in rows], "place long, op string, payload string, observed_utc string"), last_seq=9)
    assert [r["seq"] for r in good.collect()] == [10]
    assert {r["place"]: r["error"] for r in bad.collect()} == {
        1: "node.upsert: requires string field `id`", 2: "edge.assert: requires string field `type`", 3: "unknown op: drop", 4: "config.set: payload must be a JSON object", 5: "unknown op: null",
    }


def test_append_continues(spark, tmp_path):
    events = lambda *ids: spark.createDataFrame([(n, "node.upsert", json.dumps({"id": i}), None) for n, i in enumerate(ids)], "place long, op string, payload string, observed_utc string")
    path = str(tmp_path / "journal")
    assert J.append(path, events("a", "b")).count() == 0
    assert J.append(path, events("c")).count() == 0
    assert [r["seq"] for r in spark.read.parquet(path).orderBy("seq").collect()] == [0, 1, 2]
