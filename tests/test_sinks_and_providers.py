"""Sinks, and providers with stand-ins for the libraries that are not installed."""

import json
import re
import sys
import types
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from maskwright.functions.geometry import text_advance
from maskwright.operators import layout, names, redact, review
from maskwright.plans.detect import detect_regex_mode
from maskwright.sinks import pdf, responses
from maskwright.sources import files

SIZES = [(200.0, 100.0), (100.5, 50.25), (60.0, 60.0)]


class StandIn:
    """A library whose files are page counts, and whose copies name the pages that they keep."""

    made = 0

    def __init__(self):
        StandIn.made += 1

    def sizes(self, content):
        if content == b"broken":
            raise ValueError("no file")
        return SIZES[: int(content)]

    def render(self, content, page, scale):
        width, height = pdf.raster_size(*SIZES[page], scale)
        return np.full((height, width, 3), 200 + page, np.uint8)

    def replace(self, content, images):
        kept = [n for n in range(int(content)) if n not in images]
        return f"kept {kept} ".encode() + pdf.image_pdf([images[n] for n in sorted(images)])


def rasters(content):
    """The images of a file, and the sizes of their pages."""
    out = []
    for w, h, data in re.findall(rb"/Width (\d+) /Height (\d+) .*?stream\n(.*?)\nendstream", content, re.S):
        out.append(np.frombuffer(zlib.decompress(data), np.uint8).reshape(int(h), int(w), 3))
    return out, re.findall(rb"/MediaBox \[0 0 ([\d.]+) ([\d.]+)\]", content)


def box(x, y, w, h):
    return {"x": x, "y": y, "width": w, "height": h}


def test_paint_covers_every_touched_pixel():
    raster = np.full((10, 20, 3), 9, np.uint8)
    out = pdf.paint(raster, [box(0.1, 0.15, 0.1, 0.1), box(0.9, 0.9, 5.0, 5.0), box(-1, -1, 0.1, 0.1)])
    assert (out[1:3, 2:4] == 0).all() and (out[9, 18:] == 0).all() and (raster == 9).all()
    assert (out == 0).all(2).sum() == 4 + 2


def test_redacted_pages_are_images_of_the_same_size(spark):
    rows = spark.createDataFrame([(1, "a.PDF", b"3"), (2, "b.pdf", b"2"), (3, "c", b"1")], "doc_id long, name string, content binary")
    zone = "doc_id long, page int, box struct<x:double,y:double,width:double,height:double>"
    zones = spark.createDataFrame([(1, 1, (0.0, 0.0, 1.0, 0.5)), (1, 7, (0.0, 0.0, 1.0, 1.0)), (2, 0, (0.5, 0.5, 0.25, 0.25)), (2, 1, (0.0, 0.0, 0.1, 0.1)), (2, 1, (0.5, 0.0, 0.1, 0.1))], zone)
    got = {r["doc_id"]: (r["name"], bytes(r["content"])) for r in pdf.redacted_files(rows, review.zones_by_page(zones), StandIn).collect()}
    assert got[3] == ("c_anonymise.pdf", b"1") and got[1][0] == "a_anonymise.pdf"
    assert got[1][1].startswith(b"kept [0, 2] ")  # pages without zones are copied; a page that is not there is ignored
    (image,), size = rasters(got[1][1])
    assert size == [(b"100.5", b"50.25")] and image.shape[:2] == (126, 252) and (image[:63] == 0).all() and (image[64:] == 201).all()
    images, sizes = rasters(got[2][1])
    assert got[2][1].startswith(b"%PDF-1.4") and got[2][1].endswith(b"%%EOF\n") and len(images) == 2 and sizes[0] == (b"200", b"100")
    assert (images[0] == 0).all(2).mean() == pytest.approx(1 / 16, abs=0.01)
    place = int(re.search(rb"startxref\n(\d+)", got[2][1])[1])
    assert got[2][1][place : place + 4] == b"xref"
    for n, at in enumerate(re.findall(rb"(\d{10}) 00000 n", got[2][1]), 1):
        assert got[2][1][int(at) :].startswith(f"{n} 0 obj".encode())


def test_a_broken_file_does_not_pass_unredacted(spark):
    rows = spark.createDataFrame([(1, "a.pdf", b"broken")], "doc_id long, name string, content binary")
    none = spark.createDataFrame([], "doc_id long, page int, zones array<struct<x:double,y:double,width:double,height:double>>")
    with pytest.raises(Exception, match="no file"):
        pdf.redacted_files(rows, none, StandIn).collect()


def test_responses(spark, tmp_path):
    named = spark.createDataFrame([(1, "a.pdf"), (2, "é b.pdf")], "doc_id long, name string")
    pages = spark.createDataFrame([(1, 1, 10.0, 20.0, True), (1, 0, 5.0, 6.0, False)], "doc_id long, page int, width double, height double, is_scanned boolean")
    found = spark.createDataFrame([(1, 0, 0, 0, "email", "a@b.fr", 3, 9, 0.98, "regex", (0.1, 0.2, 0.3, 0.4), "i1"), (1, 0, 1, 0, "name", "X Y", 0, 3, 0.55, "nlp", (0.1, 0.2, 0.3, 0.4), "i2")],
                                  "doc_id long, page int, ord long, cluster int, type string, text string, start_pos int, end_pos int, confidence double, source string, box struct<x:double,y:double,width:double,height:double>, id string")
    rows = responses.responses(named, pages, found, "ai")
    got = {r["doc_id"]: json.loads(r["json"]) for r in rows.collect()}
    assert got[2] == {"fileName": "é b.pdf", "pages": [], "detections": [], "mode": "ai"}
    assert [p["index"] for p in got[1]["pages"]] == [0, 1] and got[1]["pages"][1] == {"index": 1, "width": 10.0, "height": 20.0, "isScanned": True}
    assert [d["id"] for d in got[1]["detections"]] == ["i2", "i1"]
    assert got[1]["detections"][1] == {"id": "i1", "page": 0, "type": "email", "text": "a@b.fr", "box": box(0.1, 0.2, 0.3, 0.4), "confidence": 0.98, "source": "regex"}
    responses.write_responses(rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    heads = named.select(responses.attachment_header(F.col("name")).alias("h")).collect()
    assert [r["h"] for r in heads] == ['attachment; filename="a_anonymise.pdf"', 'attachment; filename="%C3%A9%20b_anonymise.pdf"']
    odd = spark.createDataFrame([("a+b (1)!~*'%.txt",)], "n string").select(responses.uri_component(F.col("n"))).first()[0]
    assert odd == "a%2Bb%20(1)!~*'%25.txt"


def test_first_file_of_a_drop(spark):
    rows = spark.createDataFrame([(1, 1, "b.pdf", ""), (1, 0, "a.txt", "text/plain"), (2, 5, "x.pdf", ""), (2, 7, "y.pdf", "")], "drop_id long, seq int, name string, mime string")
    assert [tuple(r) for r in files.first_of_drops(rows).collect()] == [(2, 5, "x.pdf", "")]


def test_ocr_engine_is_made_once_a_worker(spark, tmp_path):
    place = str(tmp_path / "made")

    def setup():
        with open(place, "a") as f:
            f.write("x")
        return "engine"

    def read(engine, image):
        assert engine == "engine"
        return ([(w, 10 * k, 5, 10 * k + 8, 15) for k, w in enumerate(image.decode().split(","))] if image else []), (100, 50)

    images = spark.createDataFrame([(1, 0, b"Jean,,Dupont"), (1, 1, b""), (2, 0, b"a@b.fr")] * 20, "doc_id long, page int, image binary").repartition(1)
    words = files.ocr_words(images.limit(3), read, setup).cache()
    items = layout.ocr_items(words).orderBy("doc_id", "page", "item_seq").collect()
    assert [(r["doc_id"], r["item_seq"], r["text"], r["start_pos"]) for r in items if r["doc_id"] == 2] == [(2, 0, "a@b.fr ", 0)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        open(place, "w").close()
        assert files.ocr_words(images, read, setup).count() == 80
        assert len(open(place).read()) == 1  # one task of thirty batches
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_pypdf_runs_number_each_page(monkeypatch):
    class Page:
        mediabox = types.SimpleNamespace(width=612, height=792)

        def __init__(self, texts):
            self.texts = texts

        def extract_text(self, visitor_text):
            for k, t in enumerate(self.texts):
                visitor_text(t, None, [1, 0, 0, 1, 10.0 * k, 700.0], None, 12)

    library = types.ModuleType("pypdf")
    library.PdfReader = lambda f: types.SimpleNamespace(pages=[Page(["Jean ", "", "Dupont\n"]), Page(["x"])])
    monkeypatch.setitem(sys.modules, "pypdf", library)
    got = files._pypdf_runs(pd.DataFrame({"doc_id": [7, 8], "content": [b"", b""]}))
    assert list(zip(got.doc_id, got.page, got.item_seq, got["str"], got.has_eol, strict=True)) == [(d, *x) for d in (7, 8) for x in ((0, 0, "Jean ", False), (0, 1, "Dupont", True), (1, 0, "x", False))]
    assert got.width[1] == pytest.approx(text_advance("Dupont") * 12 / 1000) and text_advance("M") == 833


def test_a_provider_of_places(spark):
    pages = spark.createDataFrame([(1, 0, "vu Jean Lorient et Paul Petit"), (2, 0, "Jean Lorient"), (3, 0, "vers Belle Ile")], "doc_id long, page int, text string")
    places = spark.createDataFrame([(1, 0, "Lorient"), (3, 0, "Belle Ile"), (3, 0, ""), (3, 0, None)], "doc_id long, page int, place string")
    people = spark.createDataFrame([(1, 0, 0, "Lorient"), (1, 0, 1, "Petit"), (2, 0, 0, "Lorient")], "doc_id long, page int, seq int, person string")
    got = sorted((r["doc_id"], r["text"]) for r in names.detect_names(pages, people, places).collect())
    # a candidate that ends in a place is none; a place counts on its own page only
    assert got == [(1, "Paul Petit"), (2, "Jean Lorient")]
    assert sorted((r["doc_id"], r["text"]) for r in names.detect_names(pages, places=places).collect()) == [(1, "Paul Petit"), (2, "Jean Lorient")]
    assert {r["type"] for r in detect_regex_mode(pages, people, places).collect()} == {"name"}


def test_a_planted_leak_is_found(spark):
    pages = spark.createDataFrame([(1, 0, "Jean Dupont, a@b.fr"), (2, 0, "c@d.fr")], "doc_id long, page int, text string")
    found = detect_regex_mode(pages)
    done = redact.redact_text(pages, found)
    leaky = done.where("doc_id = 1").unionByName(pages.where("doc_id = 2"))
    assert [r["doc_id"] for r in redact.leaks(leaky, found).collect()] == [2] and redact.leaks(done, found).count() == 0
