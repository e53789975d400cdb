"""Parsers, whole flows, validation, deltas and the change stream."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestone.config import ChunkConfig
from lodestone.operators import indexing, validation
from lodestone.plans import api
from lodestone.sources import files, parsers
from lodestone.streaming import sync

MARKDOWN = b"lost\n# Guide\nintro\n```java\n# not a heading\nint x;\n```\n## Steps\n1. a\n| k | v |\n|---|---|\n| a | 1 |\n## End\n"


def docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f"<w:p>{f'<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>' if s else ''}<w:r><w:t>{t}</w:t></w:r></w:p>"
    table = f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr><w:tr><w:tc>{p('1')}</w:tc></w:tr></w:tbl>"
    body = f"<w:document {w}><w:body>{p('Top', 'H1')}{p('text')}{p('Sub', 'Heading2')}{table}</w:body></w:document>"
    styles = f'<w:styles {w}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", body)
        z.writestr("word/styles.xml", styles)
    return out.getvalue()


def test_markdown():
    _, got = parsers.parse_markdown(MARKDOWN)
    assert [(s["content_type"], s["section_title"], s["heading_level"]) for s in got] == [("code", None, 0), ("table", None, 0), ("text", "Guide", 1), ("text", "Steps", 2)]
    assert got[0]["metadata"] == {"language": "java"} and "int x;" in got[2]["content"] and "lost" not in "".join(s["content"] for s in got[2:])
    assert "int x;" not in parsers.parse_markdown(MARKDOWN, dedupe_blocks=True)[1][2]["content"]
    assert parsers.parse_markdown(b"plain")[1][0]["heading_level"] == 0 and parsers.parse_markdown(b"")[1] == []


def test_docx_and_pdf_blocks():
    _, got = parsers.parse_docx(docx())
    assert [(s["content_type"], s["section_title"], s["heading_level"]) for s in got] == [("text", "Top", 1), ("text", "Top", 1), ("text", "Sub", 2), ("table", "Sub", 2)]
    assert got[3]["table_markdown"] == "| a | b |\n| --- | --- |\n| 1 |  |"
    assert [parsers.style_level(x) for x in ("heading 3", "标题 2", "Heading", "Normal", None)] == [3, 2, 1, 0, 0]
    blocks = parsers.pdf_blocks(2, "## T\nx\n\na  b  c\n1  2  3\n\n \n\ny")
    assert [(b["content_type"], b["heading_level"], b["page_num"]) for b in blocks] == [("text", 2, 2), ("table", 0, 2), ("text", 0, 2)]
    assert parsers.keep_glyph(50, 100) and not parsers.keep_glyph(5, 100) and not parsers.keep_glyph(95, 100)


def test_files_with_errors_as_rows(spark, tmp_path):
    for name, data in {"a.md": MARKDOWN, "b.docx": b"broken", "c.xyz": b"?", "d.txt": b"plain text", "e.docx": docx()}.items():
        (tmp_path / name).write_bytes(data)
    read = files.read_files(spark, str(tmp_path))
    good, bad = files.segments(read)
    assert {r.doc_name for r in bad.collect()} == {"b.docx", "c.xyz"}
    assert {r.doc_name for r in good.select("doc_name").distinct().collect()} == {"a.md", "d.txt", "e.docx"}
    chunks, errors = api.ingest(read, ChunkConfig("hierarchical", 512, 0, 3))
    assert chunks.count() > 3 and errors.count() == 2
    marks = read.select("doc_id", F.when(F.col("doc_name") == "a.md", "old").otherwise(F.col("md5")).alias("md5"))
    new, stored, _ = api.update(read, marks, chunks, ChunkConfig("hierarchical", 512, 0, 3))
    assert new.count() == chunks.count() and stored.where("md5 = 'old'").count() == 0


def test_answers(spark):
    chunks = spark.createDataFrame([("c1", "d", "refund takes five days", [1.0, 0.0]), ("c2", "d", "other matter", [0.0, 1.0])], "chunk_id string, doc_id string, content string, vector array<double>")
    asked = spark.createDataFrame([(1, "refund days", [1.0, 0.0]), (2, " ", None), (3, "zzz", None)], "query_id int, question string, vector array<double>")
    cite9 = lambda df: df.withColumn("output", F.lit("answer [9]"))
    got = {r.query_id: r for r in api.answer(asked, chunks).collect()}
    assert got[1].answer == "refund takes five days [1]" and got[1].flag == 0 and got[1].citations[0].chunk_id == "c1"
    assert got[2].error and got[2].answer is None and got[3].answer == validation.REJECTION
    wrong = {r.query_id: r for r in api.answer(asked, chunks, cite9).collect()}
    assert wrong[1].answer == validation.REJECTION and wrong[1].flag == 1


@pytest.mark.parametrize(
    "said, want",
    [
        ("幻觉判定：是\n幻觉部分：x\n置信度：0.9", (True, ["x"], 0.9)),
        ("幻觉判定：不是\n幻觉部分：无\n置信度：7", (True, [], 1.0)),
        ("幻觉判定：否\n置信度：abc", (False, [], 0.5)),
        ("  ", (True, [validation.UNREADABLE], 0.5)),
        (None, (True, [validation.UNREADABLE], 0.5)),
        ("置信度：1.2.3", (False, [], 0.5)),
    ],
)
def test_verdicts(spark, said, want):
    v = spark.createDataFrame([(said,)], "s string").select(validation.parse_verdict("s").alias("v")).first().v
    assert (v.has_hallucination, v.details, v.confidence) == want


def test_citations_and_gate_of_blank(spark):
    df = spark.createDataFrame([("a [1] b [3][0] [1]", 2), (None, 1)], "a string, n int")
    got = df.select(validation.extract_citations("a").alias("c"), validation.invalid_citations("a", "n").alias("b")).collect()
    assert (got[0].c, got[0].b) == ([1, 3, 0, 1], [3, 0]) and (got[1].c, got[1].b) == ([], [])
    v = spark.createDataFrame([("", "a", "x"), ("c", " ", "x")], "c string, a string, o string").select(validation.check_answer("c", "a", "o").alias("v")).collect()
    assert [(r.v.has_hallucination, r.v.confidence) for r in v] == [(True, 1.0), (False, 0.0)]


def test_partitions_and_ttl(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a b"), (2, "c")], "id int, tenant string")
    indexing.write_partitioned(df, path, "tenant")
    indexing.write_partitioned(df.where("id = 2").withColumn("id", F.lit(3)), path, "tenant")
    assert {r.id for r in spark.read.parquet(path).collect()} == {1, 3}
    assert indexing.drop_partition(spark, path, "tenant", "a b") and {r.id for r in spark.read.parquet(path).collect()} == {3}
    assert indexing.expire(df, "2024-01-01", 0).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    messages = [{"docId": f"d{i % 5}" if i != 7 else None, "action": ("ADD", "UPDATE", "DELETE", "NOPE")[i % 4], "md5": str(i), "timestamp": i} for i in range(40)]
    source = tmp_path / "in"
    source.mkdir()
    for k in range(4):
        (source / f"{k}.json").write_text("\n".join(json.dumps(m) for m in messages[k * 10 : k * 10 + 10]))
    state: dict[str, tuple[str, int]] = {}

    def apply(upserts, deletions, batch_id):
        for r in upserts.collect():
            state[r.docId] = (r.action, r.timestamp)
        for r in deletions.collect():
            state[r.docId] = ("DELETE", r.timestamp)

    q = sync.apply_stream(sync.read_messages(spark, str(source)), apply, str(tmp_path / "dead"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    good = [m for m in messages if m["docId"] and m["action"] != "NOPE"]
    assert state == {m["docId"]: (m["action"], m["timestamp"]) for m in good}
    assert spark.read.json(str(tmp_path / "dead")).count() == len(messages) - len(good)


def test_kafka_needs_its_connector(spark):
    with pytest.raises(Exception, match="(?i)kafka"):
        sync.read_kafka(spark, "localhost:9092")
