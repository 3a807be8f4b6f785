"""Personal data by candidate gradient boosting, in column expressions only.

High-recall generators propose overlapping spans; boosted trees score their
format and context; thresholds calibrated for each generator select. Spans
that the four base rules prove stay whatever their score.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spans import find_all, let, merge_spans, with_parts

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")
_SPAN = "array<struct<start:int,kind:string,end:int>>"


@dataclass(frozen=True)
class Generator:
    """Proposes the leftmost non-overlapping matches of ``pattern`` as ``kind``, in texts that pass ``may``.

    Patterns use possessive repeats and start at the start of a run, so that
    long runs cost linear time and no stack. ``proof`` tells which matches the
    base rule accepts; None: never, the trees decide. Of the matches that have
    no proof only those that ``fits`` accepts are proposed.
    """

    kind: str
    pattern: str
    may: Callable[[Column], Column]
    proof: Callable[[Column], Column] | None = None
    fits: Callable[[Column], Column] | None = None


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0))) % 10 == 0


def _phone_digits(x: Column) -> Column:
    return F.length(_digits(x)).between(7, 15)


_BYTE = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9]|)"
GENERATORS = (
    Generator("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: t.contains("@"), lambda x: F.lit(True)),
    Generator("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), lambda x: x.rlike(rf"\A{_BYTE}(?:\.{_BYTE}){{3}}\z"), lambda x: F.lit(False)),
    Generator("card", r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++", lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
              lambda x: F.when(F.length(_digits(x)).between(14, 19), luhn(_digits(x))).otherwise(False), lambda x: F.length(_digits(x)).between(13, 19)),
    Generator("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: t.contains("+") & t.rlike(r"\+[0-9]"), lambda x: F.length(_digits(x)).between(10, 15), _phone_digits),
    Generator("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)++", lambda t: t.contains("[at]") | t.contains("(at)")),
    Generator("phone", r"(?<![0-9A-Za-z+.-])(?![0-9]{3}-[0-9]{2}-[0-9]{4})(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20.-])[0-9]{2,4}(?:[\x20.-][0-9]{2,4}){1,4}(?![0-9A-Za-z]|[.-][0-9])", lambda t: t.rlike(r"[0-9]{2}[)\x20.-]{1,2}[0-9]{2,4}[\x20.-][0-9]{2}"), fits=_phone_digits),
    Generator("phone", r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])", lambda t: t.rlike(r"[0-9]{3}[)\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}"), fits=_phone_digits),
    Generator("phone", r"(?<![0-9A-Za-z+.-])[0-9]{2}([\x20.-])(?:[0-9]{2}\1){3}[0-9]{2}(?![0-9A-Za-z])", lambda t: t.rlike(r"[0-9]{2}[\x20.-][0-9]{2}[\x20.-][0-9]{2}[\x20.-]"), fits=_phone_digits),
    Generator("phone", r"(?<![0-9A-Za-z+.-])0[0-9]{2,4}[\x20/-][0-9]{5,8}(?![0-9A-Za-z])", lambda t: t.rlike(r"0[0-9]{2,4}[\x20/-][0-9]{5}"), fits=_phone_digits),
    Generator("phone", r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,4}\)[\x20.-]?)?[0-9]{2,4}(?:[\x20.-][0-9]{2,4}){1,4}(?![0-9A-Za-z])", lambda t: t.contains("+") & t.rlike(r"\+[0-9]"), fits=_phone_digits),
    Generator("card", r"(?<![0-9])(?:[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[0-9]{3}([\x20-]?)[0-9]{6}\2[0-9]{4,5})(?![0-9])", lambda t: t.rlike(r"[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}")),
    Generator("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}")),
    Generator("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")),
)
#: What stands before a candidate and speaks for (first four) or against it, in the corpus's languages.
CONTEXTS = (
    r"(?i)(?:phone|tel\b|tel\.|telefon|tél|call|fax|mobile|cell|dial|whatsapp|rufnummer|handy|anruf|teléfono|llam|móvil|appel|portable|reach|ring|text me)",
    r"(?i)(?:card|visa|mastercard|amex|credit|debit|carte|karte|tarjeta|crédit)",
    r"(?i)(?:mail|contact|write|kontakt|contacto|courriel)",
    r"(?i)(?:ssn|social|iban|account|bank|konto|compte|cuenta|sepa)",
    r"(?i)(?:\border|invoice|\bpart\b|\bref|serial|version|\bitem|isbn|sku|\bdate|\bpage|total|price|bestell|rechnung|seite|commande|facture|pedido|factura|artículo|artikel|tracking|batch|score|scored|coordinates|model|build|[$€£#%]\s*\z)",
)
CONTEXT_CHARS = 24


def matches(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches: array of (start, x, before, after), in code points; before and after are
    the nearest characters of the gaps to the neighbouring matches."""
    return F.transform(find_all(text, pattern), lambda m: F.struct(
        m["start"].alias("start"), m["x"].alias("x"), F.substring(m["before"], -CONTEXT_CHARS, CONTEXT_CHARS).alias("before"), F.substring(m["after"], 1, 2).alias("after")))


def features(gen: int, x: Column, before: Column, after: Column) -> Column:
    """Format and context of a candidate, as an array of doubles."""
    digits = F.length(_digits(x))
    letters = F.length(F.regexp_replace(x, "[^A-Za-z]", ""))
    groups = F.filter(F.split(x, "[^0-9A-Za-z]+"), lambda g: g != "")
    sizes = F.transform(groups, lambda g: F.length(g))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return F.array(
        F.lit(float(gen)), digits.cast("double"), F.length(x).cast("double"), letters.cast("double"),
        F.size(groups).cast("double"), F.array_max(sizes).cast("double"), F.array_min(sizes).cast("double"), F.get(sizes, F.size(sizes) - 1).cast("double"),
        flag(F.when(digits.between(12, 19), luhn(_digits(x))).otherwise(False)), flag(x.rlike(r"[()]")), flag(x.rlike(r"[0-9]\.[0-9]")),
        flag(x.rlike(r"\A(?:19|20)[0-9]{2}[ .-]|[ .-](?:19|20)[0-9]{2}\z")), flag(before.rlike(r"[0-9A-Za-z]\z")), flag(after.rlike(r"\A[0-9A-Za-z]")),
        *(flag(before.rlike(c)) for c in CONTEXTS),
        *((F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))).cast("double") for c in " -."), flag(x.startswith("0")), flag(before.rlike(r"[0-9][ -]\z")),
    )


@dataclass
class Trees:
    """Boosted trees over ``features``, and each generator's threshold."""

    trees: list[tuple] = field(default_factory=list)
    bias: float = 0.0
    thresholds: list[float] = field(default_factory=list)

    def column(self, f: Column) -> Column:
        """The probability of a feature array, as nested conditions."""

        def node(t) -> Column:
            return F.lit(t) if isinstance(t, float) else F.when(F.get(f, F.lit(t[0])) <= t[1], node(t[2])).otherwise(node(t[3]))

        margin = F.lit(self.bias)
        for t in self.trees:
            margin = margin + node(t)
        return 1 / (1 + F.exp(-margin))

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self.bias + sum((_walk(t, x) for t in self.trees), np.zeros(len(x)))


def _walk(t, x: np.ndarray) -> np.ndarray:
    return np.full(len(x), t) if isinstance(t, float) else np.where(x[:, t[0]] <= t[1], _walk(t[2], x), _walk(t[3], x))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, rate: float = 0.3, depth: int = 3, penalty: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss; deterministic."""
    model = Trees(bias=float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    cuts = [(v[:-1] + v[1:]) / 2 for v in (np.unique(c) for c in x.T)]
    places = [np.searchsorted(cut, c) for cut, c in zip(cuts, x.T, strict=True)]  # how many cuts are below a value
    margin = model.margins(x)

    def grow(at: np.ndarray, g: np.ndarray, h: np.ndarray, left: int):
        best = (1e-6, None, None)
        sums = g[at].sum(), h[at].sum()
        total = sums[0] ** 2 / (sums[1] + penalty)
        for j, cut in enumerate(cuts if left else []):
            if not len(cut):
                continue
            lo = [np.bincount(places[j][at], v[at], len(cut) + 1).cumsum()[:-1] for v in (g, h)]
            gain = lo[0] ** 2 / (lo[1] + penalty) + (sums[0] - lo[0]) ** 2 / (sums[1] - lo[1] + penalty) - total
            k = int(gain.argmax())
            if gain[k] > best[0] + 1e-9:
                best = (float(gain[k]), j, float(cut[k]))
        if best[1] is None:
            return float(-rate * sums[0] / (sums[1] + penalty))
        _, j, c = best
        return (j, c, grow(at & (x[:, j] <= c), g, h, left - 1), grow(at & (x[:, j] > c), g, h, left - 1))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        tree = grow(np.ones(len(y), bool), p - y, p * (1 - p), depth)
        model.trees.append(tree)
        margin = margin + _walk(tree, x)
    return model


def examples(n: int = 3000, seed: int = 5) -> list[tuple[str, int]]:
    """Made-up sentences, each with one candidate, and whether it is personal data."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("aeioulnrstdm") for _ in range(r.randint(2, 8)))

    def card() -> str:
        s = "4" + d(14)
        total = sum(int(c) if i % 2 else (int(c) * 2) % 10 + int(c) // 5 for i, c in enumerate(s))
        s += str((-total + r.randint(1, 9)) % 10)
        return r.choice(["", " ", "-"]).join(s[i : i + 4] for i in range(0, 16, 4))

    def clear() -> str:  # national numbers whose shape tells them
        a, b, c = d(3), d(3), d(4)
        return r.choice([f"({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", " ".join(["0" + r.choice("123456789"), d(2), d(2), d(2), d(2)])])

    def national() -> str:
        a, b, c = d(3), d(3), d(4)
        pairs = ["0" + d(1), d(2), d(2), d(2), d(2)] if r.random() < 0.7 else [d(2) for _ in range(5)]
        return r.choice([clear(), f"{a}.{b}.{c}", f"{a} {b} {c}", " ".join(pairs), ".".join(pairs), f"{r.choice('679')}{d(2)} {d(3)} {d(3)}", f"0{d(2)} {d(r.randint(6, 8))}", f"0{d(3)}/{d(r.randint(5, 7))}", f"0{d(3)}-{d(6)}"])

    def iban() -> str:
        s = r.choice(["FR", "DE", "ES", "GB"]) + d(2 + 4 * r.randint(3, 5) + 2)
        return s if r.random() < 0.5 else " ".join(s[i : i + 4] for i in range(0, len(s), 4))

    call = ["phone", "call", "tel.", "fax", "mobile", "phone:", "call me at", "Telefon", "Rufnummer", "Handy", "téléphone", "tél. :", "appelez le", "portable", "teléfono", "llame al", "móvil", "reach us on", "cell"]
    no = ["order", "invoice", "ref", "serial", "part", "item", "sku", "Bestellung", "Rechnung", "commande", "facture", "pedido", "factura", "tracking", "batch"]
    good = [
        (card, ["card number", "visa", "credit card", "carte", "Karte", "tarjeta", "my card is"]), (national, call), (national, call), (clear, ["", "", "or", "is", "and"]),
        (lambda: f"{word()}{r.choice(['[at]', ' [at] ', '(at)'])}{word()}{r.choice(['.', ' [dot] ', '(dot)'])}com", ["mail", "contact", "write to", "", ""]),
        (iban, ["iban", "bank account", "Konto", "compte", "cuenta", "", "to"]), (lambda: f"{d(3)}-{d(2)}-{d(4)}", ["ssn", "social security", "", "is"]),
        (lambda: f"+{d(2)} {d(3)} {d(3)}", ["phone", "call", "dial", "Telefon", "teléfono"]),
    ]
    bad = [
        (card, [*no, "", "id", "number"]), (lambda: d(13), ["isbn", "", "id"]), (lambda: d(r.randint(15, 19)), ["", "id", *no]),
        (lambda: f"20{d(2)}-{r.randint(10, 12)}-{r.randint(10, 28)}", ["", "date", "on", "am", "le"]), (lambda: f"{r.randint(10, 28)}.{r.randint(10, 12)}.20{d(2)}", ["", "date", "am"]),
        (lambda: f"{d(2)} {d(3)} {d(3)}", ["total", "price", "", "", "of"]), (lambda: f"{r.randint(1, 9)}{d(2)} {d(3)} {d(3)}", ["total", "", "of", "about", "price"]), (lambda: f"{d(2)} {d(2)} {d(2)}", ["", "page", "score"]),
        (lambda: f"{d(3)}-{d(3)}-{d(2)}", ["part", "item", "ref", ""]), (lambda: f"{d(3)}.{d(3)}.{d(3)}", ["total", "price", "$", ""]), (lambda: f"{d(3)}-{d(2)}-{d(4)}", ["part", "serial", "ref", "sku", "batch"]),
        (national, no), (national, no), (lambda: " ".join(str(r.randint(10, 99)) for _ in range(r.randint(5, 6))), ["", "scores", "numbers", "drew", "coordinates"]),
        (lambda: f"AB{d(2)} {word().upper()[:4].ljust(4, 'X')} {word().upper()[:4].ljust(4, 'Y')} {word().upper()[:4].ljust(4, 'Z')}", ["serial", "", "item"]), (iban, ["serial", "batch", "sku", "part"]),
        (lambda: f"+{d(1)} {d(2)}", ["", "total", "version"]), (lambda: f"+{d(2)} {d(3)} {d(3)}", ["total", "price", "", "score"]),
        (lambda: f"19{d(2)} 20{d(2)} 20{d(2)}", ["", "in", "years"]), (lambda: f"{d(3)} {d(3)} {d(4)}", ["total", "", "of"]), (lambda: f"0{d(3)}-{d(6)}", [*no, "id"]),
    ]
    out = []
    for k in range(n):
        make, before = r.choice(good if k % 2 else bad)
        lead = r.choice(before)
        tail = r.choice([f" {word()}", f" {word()}.", f", {word()}", ".", ""])
        out.append((f"{word()} {word()} {lead}{' ' if lead else ''}{make()}{tail}", k % 2))
    return out


def _candidates(text: Column, gens: tuple[Generator, ...] = GENERATORS) -> Column:
    """All proposals of a text: array of (gen, kind, start, end, ok, f)."""

    def proposals(k: int, g: Generator) -> Column:
        proof = g.proof or (lambda x: F.lit(False))
        found = matches(text, g.pattern) if g.fits is None else F.filter(matches(text, g.pattern), lambda m: proof(m["x"]) | g.fits(m["x"]))
        return F.transform(found, lambda m: F.struct(
            F.lit(k).alias("gen"), F.lit(g.kind).alias("kind"), m["start"].alias("start"), (m["start"] + F.length(m["x"])).alias("end"),
            proof(m["x"]).alias("ok"), features(k, m["x"], m["before"], m["after"]).alias("f")))

    parts = [F.when(g.may(text), proposals(k, g)) for k, g in enumerate(gens)]
    empty = F.from_json(F.lit("[]"), "array<struct<gen:int,kind:string,start:int,end:int,ok:boolean,f:array<double>>>")
    return F.concat(*(F.coalesce(p, empty) for p in parts))


_models: dict[str, Trees] = {}


def _fit(spark: SparkSession) -> Trees:
    rows = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(examples())], "i int, text string, y int")
    made = rows.select("i", "y", F.inline(_candidates(F.col("text")))).where(~F.col("ok")).select("i", "y", "f").collect()  # bounded by examples()
    made.sort(key=lambda r: (r["i"], r["f"]))
    x, y, part = np.array([r["f"] for r in made]), np.array([r["y"] for r in made]), np.array([r["i"] // 2 % 3 for r in made])
    model = boost(x[part > 0], y[part > 0])
    p = 1 / (1 + np.exp(-model.margins(x[part == 0])))
    for k in range(len(GENERATORS)):
        own = x[part == 0][:, 0] == k
        model.thresholds.append(calibrate(p[own], y[part == 0][own]))
    return model


def calibrate(score: np.ndarray, label: np.ndarray, precision: float = 0.97) -> float:
    """The lowest score from which on held-out candidates have the precision; 2 (none) if there is no such score."""
    best = 2.0
    for c in np.unique(score)[::-1]:
        if label[score >= c].mean() >= precision:
            best = float(min(best, c))
    return max(best, 0.5)


def train(spark: SparkSession) -> Trees:
    """Trees and thresholds from ``examples``, fitted once an application on the driver."""
    app = spark.sparkContext.applicationId
    if app not in _models:
        _models.clear()
        _models[app] = _fit(spark)
    return _models[app]


#: The rank of a span that a base rule has proved, above any probability.
PROVED = 2.0


def _best_apart(spans: Column) -> Column:
    """Of spans (start, end, kind, gen, p) sorted by start, by descending p each that overlaps none taken before it; proved
    ones are always taken. Spans are first cut where none overlaps, and only those of one such group are compared."""
    kind = "array<struct<down:double,length:int,start:int,end:int,kind:string>>"

    def group(part: Column) -> Column:
        queue = F.array_sort(F.transform(part, lambda s: F.struct((-s["p"]).alias("down"), (s["start"] - s["end"]).alias("length"), s["start"], s["end"], s["kind"])))
        take = lambda a, s: (s["down"] == -PROVED) | ~F.exists(a, lambda b: (s["start"] < b["end"]) & (b["start"] < s["end"]))
        return F.aggregate(queue, F.array().cast(kind), lambda a, s: F.when(take(a, s), F.concat(a, F.array(s))).otherwise(a))

    groups = lambda m: F.flatten(F.transform(m, lambda g, i: group(F.slice(spans, g["first"] + 1, F.coalesce(F.get(m, i + 1)["first"], F.size(spans)) - g["first"]))))
    return let(merge_spans(spans, touching=False), groups)


def _spans(docs: DataFrame, text: Column, trees: Trees) -> DataFrame:
    """``docs`` with __base and __spans: sorted arrays of (start, kind, end)."""
    order = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    limits = F.array(*map(F.lit, trees.thresholds))

    def select(c: Column) -> Column:
        thin = lambda a: F.transform(a, lambda s: F.struct(s["start"].alias("start"), order(s).alias("order"), s["end"].alias("end"), s["kind"].alias("kind")))
        tidy = lambda a: F.transform(F.array_sort(a), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
        ranked = F.transform(c, lambda s: F.struct(s["start"], s["end"], s["kind"], s["gen"], F.when(s["ok"], PROVED).otherwise(trees.column(s["f"])).alias("p")))
        good = F.filter(ranked, lambda s: (s["p"] == PROVED) | (s["p"] >= F.get(limits, s["gen"])))
        base = tidy(thin(F.filter(c, lambda s: s["ok"])))
        return F.struct(base.alias("base"), let(F.array_sort(good), lambda g: F.when(F.exists(g, lambda s: s["p"] != PROVED), tidy(thin(_best_apart(g)))).otherwise(base)).alias("spans"))

    may = GENERATORS[0].may(text)
    for g in GENERATORS[1:]:
        may = may | g.may(text)
    none = F.struct(F.from_json(F.lit("[]"), _SPAN).alias("base"), F.from_json(F.lit("[]"), _SPAN).alias("spans"))
    found = F.when(text.rlike("[0-9@]|at[)\\]]") & may, let(_candidates(text), select)).otherwise(none)
    return docs.withColumn("__found", found)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, base, spans), one for each row of ``docs``: arrays of (start, kind, end), in code points,
    end exclusive, by start and then kind as listed in KINDS.

    ``base`` holds what the four base rules accept (leftmost non-overlapping
    matches for each kind; failing ones are dropped without a retry).
    ``spans`` adds candidates that the trees select: by descending probability
    (ties: the longer, then the earlier) each that overlaps nothing taken so
    far, base spans first. A null or empty text has none; ids may be null or
    repeat; an empty table gives no rows; other columns are not read, whatever
    their names. One projection: no shuffle, no Python on executors.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return _spans(rows, text, train(docs.sparkSession)).select(F.col("id").alias(id_col), "__found.base", "__found.spans")


def span_digest(spans: str | Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` (any columns; text string) with each found span replaced by its kind in brackets, as ``[EMAIL]``.

    Overlapping spans are replaced as one, by the kind of the first. n_chars,
    where present, follows the new text; null texts and texts without a span
    stay as they are, and so do other columns, whatever they hold. Repeated
    rows stay; an empty table gives no rows. One projection, linear in a
    text's spans.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    rows = _spans(docs, text, train(docs.sparkSession))
    spans = F.col("__found.spans")

    def masked(merged: Column, part) -> Column:
        before = lambda i: F.when(i == 0, 0).otherwise(F.get(merged, i - 1)["end"])
        marks = F.transform(merged, lambda m, i: F.concat(part(before(i), m["start"] - before(i)), F.lit("["), F.upper(F.get(spans, m["first"])["kind"]), F.lit("]")))
        return F.concat(F.array_join(marks, ""), F.substring(text, F.get(merged, F.size(merged) - 1)["end"] + 1, F.length(text)))

    new = F.when(F.size(spans) > 0, let(merge_spans(spans, touching=False), lambda m: with_parts(text, lambda part: masked(m, part)))).otherwise(docs["text"])
    rows = rows.withColumn("__text", new)
    out = [F.col("__text").alias(c) if c == "text" else F.coalesce(F.length("__text").cast(docs.schema[c].dataType), docs[c]).alias(c) if c == "n_chars" else docs[c] for c in docs.columns]
    return rows.select(*out)
