"""Names, dedupe and clustering against small sequential models."""

import random

import pytest
from pyspark.sql import functions as F

from maskwright.operators import dedupe, layout, names
from maskwright.plans.detect import detect, detect_regex_mode

MATCH = "doc_id long, page int, ord long, type string, text string, start_pos int, end_pos int, confidence double, source string"


def random_matches(seed, n=120):
    r = random.Random(seed)
    rows = []
    for doc in range(n):
        for o in range(r.randint(0, 9)):
            s = r.randint(0, 12)
            rows.append((doc, 0, o, r.choice("ab"), "x", s, s + r.randint(1, 8), r.choice([0.3, 0.5, 0.7]), "regex"))
    return rows


def by_doc(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[2])):
        out.setdefault(r[0], []).append(tuple(r))
    return out


def keep_unnested(rows):
    kept = []
    for m in sorted(rows, key=lambda r: r[5]):
        if not any(k[5] <= m[5] and m[6] <= k[6] and (k[5], k[6]) != (m[5], m[6]) for k in kept):
            kept.append(m)
    return kept


def keep_once(rows):
    seen = {}
    for m in rows:
        key = (m[3], m[5], m[6])
        if key not in seen or m[7] > seen[key][7]:
            seen[key] = (*m[:2], seen[key][2] if key in seen else m[2], *m[3:])
    return list(seen.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_dedupe_equals_sequential(spark, seed):
    rows = random_matches(seed)
    df = spark.createDataFrame(rows, MATCH)
    for operator, model in ((dedupe.dedupe_nested, keep_unnested), (dedupe.dedupe_exact, keep_once)):
        want = sorted(m for ms in by_doc(rows).values() for m in model(ms))
        assert sorted(map(tuple, operator(df).collect())) == want


def test_merge_equals_sequential(spark):
    rows = random_matches(3)
    df = spark.createDataFrame(rows, MATCH).select("doc_id", "page", "ord", "start_pos", "end_pos", "confidence")
    want = []
    for doc, ms in by_doc(rows).items():
        merged = []
        for m in sorted(ms, key=lambda r: r[5]):
            if merged and m[5] <= merged[-1][1]:
                merged[-1][1], merged[-1][2] = max(merged[-1][1], m[6]), max(merged[-1][2], m[7])
            else:
                merged.append([m[5], m[6], m[7]])
        want += [(doc, 0, i, *m) for i, m in enumerate(merged)]
    assert sorted(map(tuple, names.merge_names(df).collect())) == sorted(want)


def test_names(spark):
    texts = ["Monsieur Marie-Claire Dupont", "Le Jean Dupont", "PAR CES MOTIFS", "vu Camille ROUSSEAU ici", "Paul Petit\nAudience", "de Clermont-Ferrand", "Hôtel Saint-Denis", "Marie José x", " Étienne Dupont", "jean dupont", None]
    df = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id long, page int, text string")
    got = {}
    for r in names.regex_names(df).collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert got == {0: ["Monsieur Marie-Claire"], 3: ["Camille ROUSSEAU"], 4: ["Paul Petit\nAudience"], 7: ["Marie Jos"]}
    people = spark.createDataFrame([(9, 0, 0, "jean"), (9, 0, 1, "x"), (3, 0, 0, "ROUSSEAU ici"), (5, 0, 0, "Clermont-Ferrand")], "doc_id long, page int, seq int, person string")
    merged = {r["doc_id"]: (r["text"], r["confidence"]) for r in names.detect_names(df, people).collect()}
    assert merged[9] == ("jean", 0.65) and merged[3] == ("Camille ROUSSEAU ici", 0.65) and 5 not in merged


def test_regex_mode_end_to_end(spark):
    df = spark.createDataFrame([(1, 0, "Camille Dupont, 12 rue de la Paix 75002 Paris\nTél 06 12 34 56 78"), (2, 0, ""), (3, 0, None)], "doc_id long, page int, text string")
    got = [(r["type"], r["text"]) for r in detect_regex_mode(df).orderBy("start_pos").collect()]
    assert got == [("name", "Camille Dupont"), ("postal_address", "12 rue de la Paix 75002 Paris"), ("phone", "06 12 34 56 78")]
    replies = spark.createDataFrame([(1, 0, '{"items":[{"type":"name","text":"Camille Dupont"},{"type":"name","text":"amille"}]}'), (2, 0, "x")], "doc_id long, page int, raw string")
    hybrid = [(r["type"], r["text"], r["confidence"]) for r in detect(df, "ai", replies).orderBy("start_pos").collect()]
    assert hybrid[0] == ("name", "Camille Dupont", 0.65) and len(hybrid) == 3


def test_boxes(spark):
    item = "doc_id long, page int, item_seq int, text string, start_pos int, end_pos int, box struct<x:double,y:double,width:double,height:double>, source string"
    rows = [(1, 0, 0, "ab cd", 0, 5, (0.0, 0.1, 0.5, 0.1), "native"), (1, 0, 1, "ef", 5, 7, (0.0, 0.26, 0.5, 0.1), "native"), (1, 0, 2, "gh", 7, 9, (0.0, 0.43, 0.5, 0.1), "ocr"), (1, 0, 3, "", 9, 9, (0.2, 0.9, 0.1, 0.1), "native")]
    items = spark.createDataFrame(rows, item)
    matches = spark.createDataFrame([(1, 0, 0, "name", "x", 3, 9, 0.5, "regex"), (1, 0, 1, "name", "y", 20, 22, 0.5, "regex")], MATCH)
    got = layout.detections(matches, items).orderBy("cluster").collect()
    assert [r["cluster"] for r in got] == [0, 1] and {r["source"] for r in got} == {"ocr"}
    assert got[0]["box"]["y"] == 0.1 and got[0]["box"]["height"] == pytest.approx(0.26)
    assert layout.detections(matches, items, measured=True).count() == 2
    wide = items.select(F.lit("M").alias("m")).limit(1).select(layout.measure_text(F.col("m"))).first()[0]
    assert wide == 833
