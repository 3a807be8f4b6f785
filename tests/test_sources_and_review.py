"""Sources, models, redaction, review and streaming."""

import json

import pytest
from pyspark.sql import functions as F

from maskwright.operators import layout, model_matches, redact, review
from maskwright.operators.dedupe import dedupe_nested
from maskwright.operators.names import detect_names
from maskwright.operators.patterns import detect_patterns
from maskwright.plans import relations
from maskwright.plans.detect import detect_regex_mode, redact_pages
from maskwright.plans.sql import register_views
from maskwright.sources import files, models
from maskwright.streaming import detection


def test_model_choice_and_status(spark):
    lists = [["a", "b-Instruct"], ["a", "w"], ["a"], []]
    df = spark.createDataFrame([(m,) for m in lists], "m array<string>")
    for wanted in (None, "w", ""):
        assert [r[0] for r in df.select(model_matches.pick_model(F.col("m"), wanted)).collect()] == [models.choose(m, wanted) for m in lists]
    ok = models.status("http://x", "w", lambda url, s: json.dumps({"models": [{"name": "a"}, {"name": "w"}]}).encode())
    assert ok.available and ok.model == "w"
    assert not models.status("http://x", None, lambda url, s: b"no").available
    assert not models.status("http://x", None, lambda url, s: b"{}").available


def test_model_replies_and_matches(spark):
    pages = spark.createDataFrame([(1, 0, "une vitrine, Jean Dupont et Jean Dupont"), (2, 0, " \n"), (3, 0, "boom")], "doc_id long, page int, text string")

    def reply(text):
        if "boom" in text:
            raise OSError("down")
        return json.dumps({"items": [{"type": "name", "text": "Jean Dupont"}, {"type": "name", "text": "trin"}, {"type": "iban", "text": "vitrine"}, {"type": "custom", "text": "absent"}, "x", None]})

    replies = models.model_replies(pages, "find: {{TEXT}} end", reply)
    assert replies.count() == 2
    got = model_matches.model_matches(pages, replies.cache()).orderBy("start_pos").collect()
    assert [(r["text"], r["start_pos"]) for r in got] == [("Jean Dupont", 13), ("Jean Dupont", 28)]
    long = spark.createDataFrame([("é" * 7000,)], "t string").select(model_matches.prompt(F.col("t"), "a{{TEXT}}b")).first()[0]
    assert len(long) == 6002


def test_files(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"%PDF")
    rows = files.binary_documents(spark, str(tmp_path)).collect()
    assert [(r["name"], bytes(r["content"])) for r in rows] == [("a.PDF", b"%PDF")]
    df = spark.createDataFrame([("a.pdf", ""), ("a", ""), ("a", "application/pdf"), ("a.txt", "text/plain")], "n string, m string")
    n, m = F.col("n"), F.col("m")
    assert [tuple(r) for r in df.select(files.accepted_by_server(n, m), files.accepted_by_client(n, m)).collect()] == [(True, True), (True, False), (True, True), (False, False)]
    try:
        import pypdf  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError):
            files.pdf_runs(df)


def test_scanned_threshold(spark):
    df = spark.createDataFrame([("a" * 19 + "  \n",), ("a" * 20,), ("a" * 21,), (None,)], "t string")
    assert [r[0] for r in df.select(layout.is_scanned(F.col("t"))).collect()] == [True, False, False, True]


def test_redaction_has_no_leaks(spark):
    pages = spark.createDataFrame([(1, 0, "Jean Dupont, 06 12 34 56 78, a@b.fr 😀 fin"), (2, 0, "rien"), (3, 0, None)], "doc_id long, page int, text string")
    found = detect_regex_mode(pages)
    done = redact.redact_text(pages, found)
    rows = {r["doc_id"]: r["text"] for r in done.collect()}
    assert rows[2] == "rien" and rows[3] is None and rows[1] == "█" * 11 + ", " + "█" * 14 + ", " + "█" * 6 + " 😀 fin"
    assert redact.leaks(done, found).count() == 0 and redact.leaks(pages, found).count() == 3
    assert redact_pages(pages).collect() == done.select(*pages.columns).collect()


def test_row_local_plan_equals_the_windows(spark):
    """Detection without a shuffle against the window operators, and its plan."""
    pages = relations.texts(spark, "/root/testdata/sf0.001")
    want = dedupe_nested(detect_patterns(pages).unionByName(detect_names(pages)))
    got = detect_regex_mode(pages)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))
    narrow = detect_regex_mode(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.lit(0).alias("page"), "text"))
    plan = narrow._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_views(spark):
    pages = spark.createDataFrame([(1, 0, "a@b.fr et Jean Dupont")], "doc_id long, page int, text string")
    assert "v_findings" in register_views(spark, pages, prefix="v_")
    assert [r[0] for r in spark.sql("select type from v_findings order by start_pos").collect()] == ["email", "name"]
    assert spark.sql("select count(*) from v_rules").first()[0] == 10


def test_review(spark):
    drags = spark.createDataFrame([(1, "a", 0, -0.5, 0.2, 0.5, 0.1), (1, "b", 0, 0.1, 0.1, 0.105, 0.5), (1, "c", 0, 0.1, 0.1, 0.104, 0.5)], "doc_id long, zone_id string, page int, x0 double, y0 double, x1 double, y1 double")
    got = {r["zone_id"]: r["box"] for r in review.manual_zones(drags).collect()}
    assert got["a"]["x"] == 0 and got["a"]["width"] == 0.5 and "c" not in got
    raw = spark.createDataFrame([('[{"page":1,"box":{"x":0.5}}]',), ('{"page":1}',), ("x",), (None,), ('\n [{"page":1}, 5, null, "x", {"page":2}]',)], "r string")
    assert [len(r[0]) if r[0] is not None else None for r in raw.select(review.parse_zones(F.col("r"))).collect()] == [1, None, None, None, 2]
    names = spark.createDataFrame([("a.PDF",), ("b.pdf.txt",)], "n string").select(redact.output_name(F.col("n"))).collect()
    assert [r[0] for r in names] == ["a_anonymise.pdf", "b.pdf.txt_anonymise.pdf"]


def test_streaming(spark, tmp_path):
    spark.createDataFrame([(1, "a@b.fr"), (2, "rien")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    pages = detection.stream_pages(spark, str(tmp_path / "in"))
    q = detection.stream_matches(pages).writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r["text"] for r in spark.table("found").collect()] == ["a@b.fr"]
    q = detection.write_detections(pages, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
