import json

from pageloom.streaming import pages


def write(folder, name, rows):
    (folder / name).write_text("\n".join(map(json.dumps, rows)))


def page(doc, idx, count, text):
    raw = "<|box_start|>0 0 10 10<|box_end|><|ref_start|>text<|ref_end|>"
    return {"doc_id": doc, "page_idx": idx, "page_count": count, "raw": raw, "markdown": text, "ts": "2026-01-01T00:00:00.000Z"}


def test_documents_complete(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    query = pages.documents(pages.read(spark, str(source))).writeStream.format("memory").queryName("docs").outputMode("append").start()
    try:
        write(source, "1.json", [page(1, 1, 2, "b"), page(2, 0, 1, "x")])
        query.processAllAvailable()
        assert [r.doc_id for r in spark.sql("SELECT * FROM docs").collect()] == [2]
        write(source, "2.json", [page(1, 0, 2, "a")])
        query.processAllAvailable()
        got = spark.sql("SELECT * FROM docs WHERE doc_id = 1").first()
        assert (got.pages, got.complete, got.markdown) == (2, True, "a\n\nb")
    finally:
        query.stop()


def test_blocks_in_append_mode(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    write(source, "1.json", [page(1, 0, 1, "a"), page(1, 1, 1, "b")])
    query = pages.parsed(pages.read(spark, str(source))).writeStream.format("memory").queryName("stream_blocks").outputMode("append").start()
    try:
        query.processAllAvailable()
        assert spark.sql("SELECT * FROM stream_blocks").count() == 2
    finally:
        query.stop()
