"""Changes of documents, from messages to chunks."""

import json
import random

from lodestone.config import ChunkConfig
from lodestone.plans import api
from lodestone.streaming import sync


def test_sync_documents(spark, tmp_path):
    source, files = tmp_path / "in", tmp_path / "files"
    source.mkdir(), files.mkdir()

    def send(no, *messages):
        rows = [{"docId": d, "docName": f"{d}.txt", "action": a, "storedPath": p, "timestamp": t} for t, (d, a, p) in enumerate(messages)]
        (source / f"{no}.json").write_text("\n".join(json.dumps(r) for r in rows))
        q = api.sync_documents(sync.read_messages(spark, str(source)), str(tmp_path / "log"), str(tmp_path / "dead"), str(tmp_path / "ck"), ChunkConfig("fixed", 64, 0, 1))
        assert q.awaitTermination(80) and q.exception() is None
        got = api.synced_chunks(spark, str(tmp_path / "log")).collect()
        return {d: " ".join(r.content for r in got if r.doc_id == d) for d in {r.doc_id for r in got}}

    for name, text in (("a", "alpha text"), ("b", "beta text"), ("c", "gamma text")):
        (files / f"{name}.txt").write_text(text)
    path = lambda n: str(files / f"{n}.txt")
    first = send(0, ("a", "ADD", path("a")), ("b", "ADD", path("b")), ("c", "ADD", path("c")), ("none", "ADD", path("none")))
    assert first == {"a": "alpha text", "b": "beta text", "c": "gamma text"}
    (files / "a.txt").write_text("alpha anew")
    second = send(1, ("a", "UPDATE", path("a")), ("b", "DELETE", None), ("c", "UPDATE", path("missing")), ("", "ADD", path("a")))
    assert second == {"a": "alpha anew", "c": "gamma text"}
    failures = spark.read.parquet(str(tmp_path / "log/failures")).collect()
    assert sorted((r.batch, r.doc_id) for r in failures) == [(0, "none"), (1, "c")] and all(r.error for r in failures)
    assert spark.read.json(str(tmp_path / "dead")).count() == 1


def test_messages_in_any_order_and_batches(spark, tmp_path):
    rng = random.Random(3)
    files = tmp_path / "files"
    files.mkdir()
    messages = []
    for d in range(6):
        for v, t in enumerate(rng.sample(range(100), 4)):
            (files / f"{d}-{v}.txt").write_text(f"text {v} of {d}")
            messages.append({"docId": f"d{d}", "docName": f"{d}.txt", "tenantId": f"t{d % 2}", "action": rng.choice(["ADD", "UPDATE", "DELETE"]), "storedPath": str(files / f"{d}-{v}.txt"), "md5": str(v), "timestamp": t if d else None})

    def state(name, batches, compact_after=None):
        source = tmp_path / f"in-{name}"
        source.mkdir()
        log = str(tmp_path / f"log-{name}")
        for no, rows in enumerate(batches):
            (source / f"{no}.json").write_text("\n".join(json.dumps(r) for r in rows))
            q = api.sync_documents(sync.read_messages(spark, str(source)), log, str(tmp_path / f"dead-{name}"), str(tmp_path / f"ck-{name}"), ChunkConfig("fixed", 64, 0, 1))
            assert q.awaitTermination(120) and q.exception() is None
            if no == compact_after:
                api.compact_synced(spark, log, f"{log}-compact")
                log = f"{log}-compact"
        assert spark.read.parquet(f"{tmp_path}/log-{name}/parsed").groupBy("doc_id", "batch").count().where("count > 1").count() == 0
        return {(r.doc_id, r.tenant_id, r.content) for r in api.synced_chunks(spark, log).collect()}

    replay = state("replay", [messages])
    assert replay
    for seed in (1, 2):
        mixed = messages[:]
        random.Random(seed).shuffle(mixed)
        assert state(f"mixed{seed}", [mixed[k : k + 6] for k in range(0, len(mixed), 6)], compact_after=1 if seed == 2 else None) == replay


def test_a_late_message_loses(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for no, (t, text) in enumerate(((200, "new text"), (100, "old text"))):
        (tmp_path / f"{t}.txt").write_text(text)
        (tmp_path / "in" / f"{no}.json").write_text(json.dumps({"docId": "a", "docName": "a.txt", "action": "UPDATE", "storedPath": str(tmp_path / f"{t}.txt"), "timestamp": t}))
        q = api.sync_documents(sync.read_messages(spark, str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "dead"), str(tmp_path / "ck"), ChunkConfig("fixed", 64, 0, 1))
        assert q.awaitTermination(80) and q.exception() is None
    assert [r.content for r in api.synced_chunks(spark, str(tmp_path / "log")).collect()] == ["new text"]
