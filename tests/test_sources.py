"""Files, store, stream and attempts on small inputs."""

import json

from pyspark.sql import functions as F

from ledgerline.operators.attempts import classify_attempts, model_ladder
from ledgerline.operators.pages import redact
from ledgerline.operators.payload import extraction_result, parse_responses
from ledgerline.operators.triage import triage
from ledgerline.sources.documents import append_documents, document_by_name, latest_documents, list_documents, read_documents
from ledgerline.sources.files import as_files, scan_files
from ledgerline.streaming.arrivals import read_response_stream, stream_checks

PNG = bytes.fromhex("89504E470D0A1A0A0000000D49484452") + b"x" * 20 + b"IEND" + b"1234"


def pdf(pages, end=b"%%EOF"):
    return b"%PDF-1.4\n" + b"<< /Type /Pages /Kids [] /Count %d >>" % pages + b" " * 30 + end


def test_triage_of_a_folder(spark, tmp_path):
    contents = {
        "a.pdf": pdf(2), "long.PDF": pdf(4), "cut.pdf": pdf(1, b""), "none.pdf": pdf(0), "note.txt": b"hello",
        "a.png": PNG, "bad.png": b"GIF89a", "a.jpg": b"\xff\xd8" + b"y" * 40 + b"\xff\xd9", "half.jpeg": b"\xff\xd8" + b"y" * 40,
        "noext": pdf(1), "blob": b"zzz",
    }
    for name, content in contents.items():
        folder = tmp_path / name[0]
        folder.mkdir(exist_ok=True)
        (folder / name).write_bytes(content)
    empty = as_files(spark.createDataFrame([("x/empty.pdf", 0, b"")], "path string, length long, content binary"))
    rows = {r.name: r for r in triage(scan_files(spark, str(tmp_path)).unionByName(empty)).collect()}
    assert {n for n, r in rows.items() if r.is_valid} == {"a.pdf", "a.png", "a.jpg", "noext"}
    assert rows["a.pdf"].page_count == 2 and rows["long.PDF"].page_count == 4
    assert rows["empty.pdf"].errors == ["The file is empty."]
    assert "4 pages" in rows["long.PDF"].errors[0] and "unknown" in rows["blob"].errors[0] and ".txt" in rows["note.txt"].errors[0]
    assert "no pages" in rows["none.pdf"].errors[0] and "EOF" in rows["cut.pdf"].errors[0]
    assert as_files(spark.createDataFrame([("x/y.Pdf", 3, b"abc")], "path string, length long, content binary")).first().extension == ".pdf"


def test_store(spark, tmp_path):
    path = str(tmp_path / "store")
    row = lambda i, name, kind, day: (i, name, kind, "COMPLETED", day)
    columns = "id long, document_name string, document_type string, processing_status string, created_at string"
    first = spark.createDataFrame([row(1, "a", "invoice", "2024-01-01"), row(2, "b", "invoice", "2024-01-02")], columns)
    append_documents(first, path)
    append_documents(spark.createDataFrame([row(3, "a", "balance_sheet", "2024-01-02")], columns), path)
    stored = read_documents(spark, path)
    assert [r.id for r in list_documents(stored).collect()] == [3, 2, 1]
    assert [r.id for r in list_documents(stored, skip=1, limit=1).collect()] == [2]
    assert [r.id for r in list_documents(stored, before=("2024-01-02", 3)).collect()] == [2, 1]
    assert [r.id for r in list_documents(stored, document_type="invoice").collect()] == [2, 1]
    assert document_by_name(stored, "a").first().id == 3
    assert {r.id for r in latest_documents(stored).collect()} == {2, 3}


def test_append_again_and_new_ids(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([("a", "invoice"), ("a", "invoice"), ("b", "balance_sheet")], "document_name string, document_type string")
    for batch in ("monday", "monday", None, None):
        append_documents(rows, path, batch)
    stored = read_documents(spark, path)
    assert stored.count() == 9 and stored.select("id").distinct().count() == 9
    assert "append_batch" not in stored.columns


def test_extraction_result(spark):
    cases = {
        "good": ("invoice", json.dumps({"extracted_data": {"subtotal": 1, "line_items": []}}), "SUCCESS"),
        "numeric_text": ("invoice", '{"subtotal": "12.5"}', "SUCCESS"),
        "printed": ("invoice", '{"subtotal": "$12.5"}', "PARTIAL"),
        "fenced": ("balance_sheet", '```json\n{"total_assets": 1}\n```', "SUCCESS"),
        "number_as_text": ("invoice", '{"vendor_name": 5}', "PARTIAL"),
        "null_list": ("invoice", '{"line_items": null}', "PARTIAL"),
        "nameless_line": ("cash_flow_statement", '{"line_items": [{"amount": 5}]}', "PARTIAL"),
        "page": ("invoice", '{"line_items": [{"page_number": 1.5}]}', "PARTIAL"),
        "flag": ("invoice", '{"line_items": [{"is_tax_inclusive": "yes"}, {"is_tax_inclusive": 0}]}', "SUCCESS"),
        "bad_flag": ("invoice", '{"line_items": [{"is_tax_inclusive": "perhaps"}]}', "PARTIAL"),
        "second_alias": ("balance_sheet", '{"share_capital": 5, "capital": "many"}', "SUCCESS"),
        "unknown_key": ("profit_and_loss", '{"surprise": [1]}', "SUCCESS"),
        "list": ("invoice", "[1]", "FAILED"),
        "broken": ("invoice", '{"a": ', "FAILED"),
        "empty": ("invoice", "", "FAILED"),
        "receipt": ("receipt", "{}", "FAILED"),
    }
    df = spark.createDataFrame([(n, k, raw) for n, (k, raw, _) in cases.items()], "doc_id string, document_type string, raw string")
    got = {r.doc_id: r.extraction_status for r in extraction_result(parse_responses(df)).collect()}
    assert got == {name: want for name, (_, _, want) in cases.items()}


def test_stream_gives_each_document_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    body = lambda i: {"doc_id": f"d{i}", "document_type": "cash_flow_statement", "raw": json.dumps({"net_change_in_cash": i})}
    (source / "one.json").write_text("\n".join(json.dumps(body(i)) for i in range(3)))
    run = lambda: stream_checks(
        read_response_stream(spark, str(source)), str(tmp_path / "out"), str(tmp_path / "marks"), str(tmp_path / "work")
    ).awaitTermination()
    run()
    (source / "two.json").write_text(json.dumps(body(3)))
    run()
    checks = spark.read.parquet(str(tmp_path / "out"))
    assert checks.count() == 8 and checks.select("doc_id").distinct().count() == 4


def test_attempt_classes(spark):
    cases = [
        ("model not found", None, 1, "not_found", "next_model", None), ("boom", 404, 1, "not_found", "next_model", None),
        ("429 and 503", None, 1, "quota", "next_model", None), ("Retry in 11s", None, 1, "long_wait", "next_model", None),
        ("503 retry in 4.5s", None, 1, "transient", "retry", 6.5), ("timeout", None, 2, "transient", "retry", 6.0),
        ("timeout", None, 3, "transient", "next_model", None), ("denied", None, 1, "fatal", "raise", None),
    ]
    df = spark.createDataFrame(
        [(i, "a", attempt, error, code, False) for i, (error, code, attempt, *_) in enumerate(cases)],
        "request_id int, model string, attempt int, error string, code int, ok boolean",
    )
    models = spark.createDataFrame([("a", False, 0), ("b-lite", True, 0)], "model string, is_lite boolean, position int")
    got = {r.request_id: r for r in classify_attempts(df, model_ladder(models, "a")).collect()}
    for i, (*_, kind, action, wait) in enumerate(cases):
        assert (got[i].error_class, got[i].action, got[i].wait_s) == (kind, action, wait)
    order = {r.model: r["rank"] for r in model_ladder(models, "z-lite").collect()}
    assert order == {"a": 1, "z-lite": 2, "b-lite": 3}


def test_redaction(spark):
    df = spark.createDataFrame([("u?key=ab-1&x Bearer t.k-1 AIza" + "a" * 35 + " mykey99",), (None,)], "t string")
    first, second = [r.t for r in redact(df, ["t"], literals=["mykey99", "u"]).collect()]
    mark = "[REDACTED_API_KEY]"
    assert first == f"u?key={mark}&x Bearer {mark} {mark} {mark}" and second == ""
