"""Learned operators: accuracy on held-out rows, and hostile rows."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.llm import language_id, quality, queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def hostile(spark):
    texts = [None, "", "  \n", "1234 !!", "été", "x" * 70_000, "the of and on in " * 20_000, "😀", "the of", "the of"]
    return spark.createDataFrame([(i if i < 9 else None, t, "no", 1) for i, t in enumerate(texts)], "doc_id long, text string, score string, held_out int")


def test_language_held_out_accuracy(spark):
    got = queries.op5_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(held) > 100 and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)
    assert sum(not r["accepted"] for r in got) <= 0.01 * len(got)


def test_language_of_odd_rows(spark, hostile):
    models = language_id.fit({"en": ["the of and on in " * 9] * 6, "fr": ["été le la les de " * 9] * 6, "none": ["12 3"]})
    assert models.languages == ["en", "fr"]
    got = language_id.identify(hostile, models).collect()
    assert [r["lang_pred"] for r in got][:5] == ["und"] * 4 + ["fr"]
    assert [r["accepted"] for r in got][:4] == [False] * 4 and got[6]["lang_pred"] == "en" and got[6]["accepted"]
    assert len(got) == 10 and language_id.identify(hostile.limit(0), models).count() == 0
    nothing = language_id.fit({})
    assert {r["lang_pred"] for r in language_id.identify(hostile, nothing).collect()} == {"und"}


def test_a_language_of_long_texts_only_is_learned(spark):
    rows = [(i, "the of and on in " * 9, "en") for i in range(6)] + [(10 + i, "été le la les de " * 2_000, "fr") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = language_id.train(docs, F.lit(True))
    assert models.languages == ["en", "fr"]
    assert {(r["doc_id"] >= 10, r["lang_pred"], r["accepted"]) for r in language_id.identify(docs, models).collect()} == {(False, "en", True), (True, "fr", True)}


class PlainKneserNey:
    """The model of one language by dictionaries of strings."""

    def __init__(self, texts):
        grams = Counter(g for t in texts for g in self.windows(t))
        self.p, self.w = {}, {}
        self.alphabet = language_id._alphabet()
        levels = {4: grams}
        for k in (3, 2, 1):
            levels[k] = Counter(g[1:] for g in levels[k + 1])
        for k in (1, 2, 3, 4):
            n1, n2 = (sum(c == n for c in levels[k].values()) for n in (1, 2))
            d = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5
            total, kinds = Counter(), Counter()
            for g, c in levels[k].items():
                total[g[:-1]] += c
                kinds[g[:-1]] += 1
            self.w[k] = {h: d * kinds[h] / total[h] for h in total}
            self.p[k] = {g: (c - d) / total[g[:-1]] for g, c in levels[k].items()}

    @staticmethod
    def windows(text):
        folded = re.sub(" +", " ", "".join(c.lower() if c.isalpha() else " " for c in text))
        return [("   " + folded)[i : i + 4] for i in range(len(folded))]

    def prob(self, g):
        if not g:
            return 1 / self.alphabet
        k = len(g)
        return self.p[k].get(g, 0.0) + self.w[k].get(g[:-1], 1.0) * self.prob(g[1:])

    def cross_entropy(self, text):
        return -sum(math.log(self.prob(g)) for g in self.windows(text)) / max(1, len(self.windows(text)))


def test_models_equal_plain_kneser_ney():
    samples = {"en": ["The cat sat on the mat, and the dog sat too.", "One more: cats & dogs!", "  the end"] * 2, "fr": ["Été à la plage; le chat et le chien", "la fin\n\n du monde"] * 3, "xx": ["zzz", "a"]}
    models = language_id.fit(samples)
    texts = ["the cat", " Le chien est là ", "zzzz", "", "12", "q", "the dog and the été 12 x", "a b  c", "ψω the"]
    ce, n = models.cross_entropy(texts)
    for j, name in enumerate(models.languages):
        own = samples[name] if len(samples[name]) < 5 else [t for i, t in enumerate(samples[name]) if i % 5]
        plain = PlainKneserNey(own)
        assert [float(x) for x in ce[:, j]] == pytest.approx([plain.cross_entropy(t) for t in texts], abs=1e-5)
    plain = PlainKneserNey(samples["xx"])
    letters = sorted({c for c in map(chr, range(0x110000)) if c.isalpha() and len(c.lower()) == 1})
    folded = {c.lower() for c in letters} | {" "}
    assert sum(plain.prob("zz" + c) for c in folded) == pytest.approx(1, abs=0.05)


@pytest.mark.parametrize("filler", ["the cat, on the mat ", "    ", "1 2 3 the  "])
def test_a_long_text_has_the_sums_of_one_run(monkeypatch, filler):
    models = language_id.fit({"en": ["The cat sat on the mat, and the dog sat too."] * 6, "fr": ["été à la plage et le chat"] * 6})
    text = "x" + filler * (600_000 // len(filler)) + "y"
    cut, n = models.cross_entropy([text, "the", text])
    monkeypatch.setattr(language_id, "_RUN", 10_000_000)
    whole, m = models.cross_entropy([text, "the", text])
    assert n.tolist() == m.tolist() and abs(cut - whole).max() < 1e-9


def test_training_on_executors_equals_the_driver(spark):
    """Window sampling, languages learned in tasks, none without letters; a long text gives a run from a seeded place."""
    rows = [(i, f"the cat sat on mat {i % 7} and more", "en") for i in range(40)] + [(100 + i, f"le chat été là {'x' * (i % 4)}", "fr") for i in range(4)]
    rows += [(200 + i, "123 !!", "none") for i in range(8)] + [(None, "the end", "en"), (300, None, "en"), (301, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = language_id.train(docs, F.lit(True))
    assert models.languages == ["en", "fr"]
    probe = ["the cat", "le chat", "là", "x 1"]
    few = language_id.train(docs, F.lit(True), documents=20, total=10)
    assert few.languages == ["en", "fr"] and few.cross_entropy(probe)[0].argmin(1).tolist()[:3] == [0, 1, 1]
    local = language_id.fit({"fr": [r[1] for r in rows if r[2] == "fr"]})
    own = models.languages.index("fr")
    assert models.cross_entropy(probe)[0][:, own].tolist() == pytest.approx(local.cross_entropy(probe)[0][:, 0].tolist(), abs=1e-6)
    assert models.limit[own] == pytest.approx(local.limit[0])
    assert language_id.train(docs.limit(0), F.lit(True)).languages == []


def plain_risk(w, p, u, prior):
    """prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) with logistic loss, one row after another."""
    loss = lambda z, y: math.log1p(math.exp(-y * z)) if -y * z < 30 else -y * z
    margin = lambda x: sum(a * b for a, b in zip(x, w, strict=True))
    rp = sum(loss(margin(x), 1) for x in p) / len(p)
    rest = sum(loss(margin(x), -1) for x in u) / len(u) - prior * sum(loss(margin(x), -1) for x in p) / len(p)
    return prior * rp + max(0.0, rest), rest


def test_quality_minimises_the_plain_risk():
    rng = np.random.default_rng(2)
    p = rng.normal(1, 1, (60, 3))
    u = np.concatenate([rng.normal(1, 1, (40, 3)), rng.normal(-1, 1, (60, 3))])
    for w in (rng.normal(0, 0.5, 3) for _ in range(4)):
        value, rest = plain_risk(w, p, u, 0.4)
        got, slope = quality.risk(w, p, u, 0.4)
        assert got == pytest.approx(value)
        if rest > 0:
            for j in range(3):
                step = np.eye(3)[j] * 1e-5
                assert slope[j] == pytest.approx((plain_risk(w + step, p, u, 0.4)[0] - plain_risk(w - step, p, u, 0.4)[0]) / 2e-5, rel=1e-3, abs=1e-6)
    scorer = quality.fit(p.astype(np.float32), u.astype(np.float32), prior=0.4, decay=0.0)
    w = np.append(scorer.weight, scorer.bias)
    z = lambda x: np.c_[(x - scorer.mean) / scorer.scale, np.ones(len(x))]
    best = plain_risk(w, z(p), z(u), 0.4)[0]
    assert all(best <= plain_risk(w + d, z(p), z(u), 0.4)[0] + 0.02 for d in rng.normal(0, 0.3, (30, 4)))
    many, mixed = rng.normal(1, 1, (2000, 3)), np.concatenate([rng.normal(1, 1, (1600, 3)), rng.normal(-1, 1, (2400, 3))])
    assert abs(quality.fit(many.astype(np.float32), mixed.astype(np.float32)).prior - 0.4) < 0.1


def test_quality_sample_is_bounded_by_rows_in_hash_order(spark):
    rows = [(i % 5, f"text {i} with words") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 0)], "doc_id long, quality int")
    a = quality.train(docs, labels, F.lit(True), positives=30, unlabelled=50)
    b = quality.train(docs.orderBy(F.rand(3)), labels, F.lit(True), positives=30, unlabelled=50)
    assert a.weight.tolist() == b.weight.tolist() and a.prior == b.prior


def test_quality_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    got = queries.op9_quality(spark, SF).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 50
    good, bad = [r["score"] for r in got if r["quality"]], [r["score"] for r in got if not r["quality"]]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.95
    assert sum((r["score"] >= 0.5) == (r["quality"] == 1) for r in got) / len(got) > 0.9


def test_quality_of_odd_rows(spark, hostile):
    labels = spark.createDataFrame([(8, 1), (None, 1), (5, None)], "doc_id long, quality int")
    scorer = quality.train(hostile, labels, F.lit(True))
    got = quality.score(hostile, scorer).collect()
    assert len(got) == 10 and all(0 <= r["score"] <= 1 for r in got)
    nothing = quality.train(hostile, labels.limit(0), F.lit(True))
    assert {r["score"] for r in quality.score(hostile, nothing).collect()} == {0.5}
    assert quality.score(hostile.limit(0), nothing).count() == 0
