import json

import pytest
from parlora import cli
from parlora.operators import embeddings as B
from parlora.operators import quality as Q
from parlora.operators.index import with_positions
from parlora.sources import exports as X
from parlora.sources import runs
from parlora.streaming import ingest
from pyspark.sql import functions as F


def node(parent, message, **more):
    return {"parent": parent, "message": message, "children": [], **more}


def said(key, role, *parts, **more):
    return {"id": key, "author": {"role": role, "name": " "}, "content": {"content_type": "text", "parts": list(parts)}, "create_time": 1700000000.5, "metadata": {}, **more}


GRAPH = {
    "conversation_id": "g1", "title": " Trip ", "create_time": "2024-01-01T00:00:00Z", "current_node": "d", "is_archived": True, "is_starred": "yes",
    "mapping": {
        "a": node(None, None), "b": node("a", said("mb", "user", "Plan a trip to Rome", {"content_type": "image", "asset_pointer": "file-service://pic"}, 7)), "x": node("b", said("mx", "assistant", "branch")),
        "c": node("b", said(None, "assistant", " ", {"file_id": "f1", "text": "Rome is lovely"}, metadata={"attachments": ["raw", {"id": "", "name": "doc.txt"}]})), "d": node("c", said("md", "user", "I think Rome is great")),
    },
}
FLAT = {
    "uuid": "f1", "name": "", "summary": " s ", "created_at": "2024-02-01T00:00:00+01:00", "account": {"uuid": "u"},
    "chat_messages": [
        {"uuid": "q1", "sender": "human", "text": "ignored", "created_at": "2024-02-01T00:00:00Z", "content": [{"type": "text", "text": "Rome again"}, {"text": "two", "flags": ["x"]}, {"type": "text", "text": "three", "citations": [{"u": 1}]}], "attachments": [{"file_name": "n"}], "files": [{}]},
        "junk", {"sender": "assistant", "content": [{"type": "text", "text": " "}]},
    ],
}


@pytest.fixture(scope="module")
def run_path(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("exports")
    (root / "g").mkdir()
    (root / "f").mkdir()
    (root / "g" / "conversations-000.json").write_text(json.dumps([GRAPH, 5]))
    loop = {"id": "g2", "current_node": "n", "mapping": {"n": node("m", said("1", "user", "loop Rome")), "m": node("n", said("2", "user", "pool"))}}
    deep = {"current_node": "n299", "mapping": {f"n{i}": node(f"n{i - 1}" if i else None, said(f"k{i}", "user", f"deep {i}")) for i in range(300)}}
    (root / "g" / "conversations-001.json").write_text(json.dumps([loop, deep, {"id": "g3", "current_node": "zz", "mapping": {}}]))
    (root / "f" / "conversations.json").write_text(json.dumps([FLAT]))
    (root / "f" / "memories.json").write_text("not json")
    return runs.write_run(spark, str(root / "runs"), str(root / "g"), str(root / "f" / "conversations.json"), "r1", "2024-05-01T00:00:00Z", jsonl=True)


def test_graph_conversation():
    c, m = X.map_graph(GRAPH, "file.json", 3, "root")
    assert [x["message_id"] for x in m] == ["chatgpt:message:mb", "chatgpt:message:c", "chatgpt:message:md"]
    assert [x["parent_message_id"] for x in m] == [None, "chatgpt:message:mb", "chatgpt:message:c"]
    assert m[0]["content_blocks"][1]["type"] == "image" and m[0]["attachments"] == [{"kind": "image", "path": "pic", "source_ref": "file-service://pic"}]
    assert m[1]["text"] == "Rome is lovely" and m[1]["attachments"] == [{"kind": "text", "path": None, "source_ref": "f1"}, {"kind": "attachment", "path": None, "source_ref": "raw"}, {"kind": "attachment", "path": "doc.txt", "source_ref": "doc.txt"}]
    assert m[0]["created_at"] == "2023-11-14T22:13:20.500000Z" and m[0]["author_name"] is None and m[0]["source_artifact"]["raw_message_path"] == "mapping.b.message"
    assert c["title"] == "Trip" and c["message_count"] == 3 and c["source_metadata"]["is_archived"] is True and c["source_metadata"]["is_starred"] is None and c["participant_summary"]["roles"] == ["assistant", "user"]
    assert X.conversation_key("p", "", "f", 2) == "p:conversation:missing:f:2" and X.message_key("p", None, "c", "index-1") == "p:message:missing:c:index-1"


def test_flat_conversation():
    c, m = X.map_flat(FLAT, "conversations.json", 0, "root")
    assert c["message_count"] == 3 and len(m) == 2 and c["title"] is None and c["summary"] == "s" and c["created_at"] == "2024-01-31T23:00:00Z"
    assert m[0]["text"] == "Rome again\n\nthree" and [b["type"] for b in m[0]["content_blocks"]] == ["text", "unknown", "text"]
    assert m[0]["author_role"] == "user" and m[0]["sender"] == "human" and m[0]["source_metadata"]["flags"] == '["x"]'
    assert m[0]["attachments"] == [{"kind": "attachment", "path": None, "source_ref": "n"}, {"kind": "file", "path": None, "source_ref": None}]
    assert m[1]["sequence_index"] == 2 and m[1]["text"] is None and m[1]["message_id"] == "claude:message:missing:claude:conversation:f1:index-2"


def test_run(spark, run_path):
    run = runs.load_run(spark, run_path)
    assert run.run_id == "r1" and run.manifest["counts_by_provider"]["claude"] == {"conversation_count": 1, "message_count": 2}
    assert run.manifest["message_count"] == run.messages.count() == 3 + 2 + 300 + 2
    loop = run.messages.where("conversation_id = 'chatgpt:conversation:g2'").orderBy("sequence_index").collect()
    assert [r["source_message_id"] for r in loop] == ["2", "1"]
    assert run.conversations.where("conversation_id = 'chatgpt:conversation:missing:conversations-001.json:1'").first()["message_count"] == 300
    with pytest.raises(FileExistsError):
        runs.write_run(spark, run_path.rsplit("/", 1)[0], flat_path="x", run_id="r1")
    with pytest.raises(FileNotFoundError):
        runs.load_run(spark, "/nonexistent")
    with pytest.raises(FileNotFoundError):
        X.read_graph_export(spark, run_path)


def test_jsonl_equals_parquet(spark, run_path, tmp_path):
    import shutil

    shutil.copy(f"{run_path}/manifest.json", tmp_path)
    for t in ("conversations", "messages"):
        shutil.copytree(f"{run_path}/{t}.jsonl", tmp_path / f"{t}.jsonl")
    a, b = runs.load_run(spark, run_path).messages, runs.load_run(spark, str(tmp_path)).messages
    assert a.exceptAll(b.select(a.columns)).count() == 0 and b.count() == a.count()
    line = next(iter((tmp_path / "messages.jsonl").glob("part-*"))).read_text().splitlines()[0]
    assert line.isascii() and list(json.loads(line)) == sorted(json.loads(line))


def test_last_row_of_an_id_wins(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "message_id string, v int").coalesce(1)
    assert {(r[0], r[1]) for r in runs.last_of_each(df).collect()} == {("a", 3), ("b", 2)}


def test_inventory(tmp_path):
    (tmp_path / "chatgpt" / "sub").mkdir(parents=True)
    (tmp_path / "chatgpt" / ".hidden").write_text("")
    (tmp_path / "chatgpt" / "sub" / "x.json").write_text("")
    a, b = runs.inventory(str(tmp_path))
    assert (a.status, a.files, a.top_level, b.status) == ("ready", ("sub/x.json",), ("sub",), "missing")


def test_quality_report(spark, run_path, tmp_path):
    found = Q.report(runs.load_run(spark, run_path).all_messages, "p")
    assert found["total_messages"] == 307 and found["empty_messages"]["count"] == 1 and found["empty_messages"]["by_provider"] == {"claude": 1}
    assert found["distribution_summary"]["messages_with_attachments"] == 3 and found["distribution_summary"]["messages_with_non_text_content_blocks"] == 2
    assert found["content_blocks_integrity"]["blocks_missing_text"] == 3 and len(found["content_blocks_integrity"]["malformed_examples"]) == 3
    Q.write_report(found, str(tmp_path / "q.json"))
    assert json.loads((tmp_path / "q.json").read_text())["total_messages"] == 307 and "Empty Messages" in Q.render(found)


def fake(texts, model):
    return [[float(len(t)), 1.0] for t in texts]


def test_embedding_build(spark, run_path, tmp_path):
    rows = [("m1", "c", 0, "p", "user", None, "OK"), ("m2", "c", 1, "p", "user", None, "Hi"), ("m3", "c", 2, "p", "tool", None, "long text"), ("m4", "c", 3, "p", "user", None, None), ("m5", "c", 4, "p", "user", None, "a real message"), ("m6", "d", 0, "p", "user", None, "x" * 9000)]
    df = spark.createDataFrame(rows, "message_id string, conversation_id string, sequence_index int, provider string, author_role string, created_at string, text string")
    from parlora.functions import text as T

    df = df.withColumn("searchable", T.searchable(F.col("text")))
    assert {r["reason"]: r["n"] for r in B.reason_counts(df).collect()} == {"low_information_ack": 1, "trivially_short": 1, "tool_role": 1, "empty_text": 1, "eligible": 2}
    records = B.embed(df, fake, "m", "r")
    got = {r["message_id"]: r for r in records.collect()}
    assert got["m6"]["truncation_occurred"] and got["m6"]["embedding"] == [8000.0, 1.0] and got["m5"]["embedding_dimensions"] == 2
    B.replace_artifact(records, str(tmp_path / "e"))
    B.replace_artifact(records.limit(1), str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).count() == 1
    ids = lambda d: [r["message_id"] for r in d.collect()]
    assert ids(B.subset(df, 1, 3)) == ["m2", "m3", "m4"] and len(ids(B.subset(df, sample=2, seed=1))) == 2 and len(ids(B.subset(df, sample=2, seed=1, exact=True))) == 2
    assert ids(B.subset(df, -3, -1)) == [] and sorted(ids(B.targeted(df, ("d",), ("m1",)))) == ["m1", "m6"] and len(ids(B.targeted(df))) == 6
    assert with_positions(df).where("message_id = 'm6'").first()["pos"] == 0


def test_command_line(run_path, tmp_path, capsys):
    out = str(tmp_path / "o.json")
    for args in (
        ["analyze", "--run", run_path], ["answer", "--run", run_path, "Rome", "--debug", "--json", out],
        ["patterns", "--run", run_path, "--query", "Rome", "--ask", "Who are the people?"],
        ["build-embeddings", "--run", run_path, "--client", "tests.test_sources:fake", "--model", "m", "--limit", "5"], ["retrieve", "--run", run_path, "deep Rome", "--channel", "hybrid", "--client", "tests.test_sources:fake", "--model", "m"], ["inspect", str(tmp_path)],
    ):
        assert cli.main(args) == 0, args
    assert "Rome" in capsys.readouterr().out
    bank = tmp_path / "bank.json"
    bank.write_text(json.dumps([{"id": "a", "query": "Rome", "expected_status": "supported"}]))
    assert cli.main(["eval", "--run", run_path, "--bench", str(bank), "--fail-only", "--index"]) == 0
    assert cli.main(["retrieve", "--run", "/nowhere", "x"]) == 2 and cli.main(["retrieve", "--run", run_path, "x", "--mode", "best"]) == 2


def test_streams(spark, run_path, tmp_path):
    for k in range(2):
        (tmp_path / "in").mkdir(exist_ok=True)
        rows = [{"message_id": f"m{i}", "conversation_id": "c", "provider": "p", "author_role": "user", "created_at": f"2024-01-{1 + i:02d}T00:00:00Z", "text": "t"} for i in range(5)]
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(map(json.dumps, rows)))
    stream = ingest.message_stream(spark, str(tmp_path / "in"), 1)
    assert stream.isStreaming
    ingest.append_run(ingest.once(stream, "30 days"), str(tmp_path / "out"), str(tmp_path / "chk")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    for name, df in (("act", ingest.activity(stream, "7 days", "60 days")), ("ses", ingest.conversation_sessions(stream, "3 days", "60 days"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("complete").start()
        q.processAllAvailable()
        q.stop()
    assert spark.sql("select sum(n) from act").first()[0] == 10 and spark.sql("select count(*), max(n) from ses").first()[:] == (1, 10)
