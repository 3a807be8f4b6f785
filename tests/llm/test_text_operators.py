"""Operators on texts against brute force, over the small driver tables and hostile rows."""

import hashlib
import json
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.llm import fingerprints, mixing, packing, queries, sharding, token_counts
from maskwright.llm.near_dedup import near_duplicates

SF = "/root/testdata/sf0.01"
WORD = re.compile("[^\x20\x09-\x0d]+")
HOSTILE = [
    (1, "alpha beta gamma delta epsilon zeta", "a"), (2, "ALPHA beta gamma\tdelta epsilon\nzeta", "a"), (3, None, None), (4, "", "b"), (5, "   \n", "b"),
    (6, "one two", "é"), (7, "One  two", "é"), (8, "x" * 70_000, "z"), (9, "w1 " * 30_000, "z"), (10, "naïve 😀 café don't we'll <|endoftext|> x", None),
    (10, "naïve 😀 café don't we'll <|endoftext|> x", None), (12, "    \n\n\t tab", "b"), (-3, "a b c d e f g h i j k l m n o p q r s t u v w x y z", "a"),
]


@pytest.fixture(scope="module")
def hostile(spark):
    rows = [(i, t, "en", s, len(t or ""), t) for i, t, s in HOSTILE]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string")
    return df.withColumn("rank", F.lit(1)).withColumn("shard", F.lit("x")).withColumn("id", F.lit(0))


@pytest.fixture(scope="module")
def empty(hostile):
    return hostile.limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(text):
    return WORD.findall(re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))


def shingles(text):
    w = words(text)
    return frozenset(zip(*(w[i:] for i in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(rows):
    """Brute force over all pairs that share a shingle."""
    sets = {}
    for i, t in rows:
        sets.setdefault(shingles(t), []).append(i)
    lists, parent = defaultdict(list), {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    def union(i, j):
        a, b = sorted((root(i), root(j)))
        parent[b] = a

    for s, ids in sets.items():
        for i in ids[1:] if s else []:
            union(ids[0], i)
        for g in s:
            lists[g].append(s)
    for s in sets:
        for other, n in Counter(o for g in s for o in lists[g]).items():
            if 100 * n >= 85 * (len(s) + len(other) - n):
                union(sets[s][0], sets[other][0])
    return {i: root(i) for i, _ in rows}


@pytest.mark.parametrize("block", [6_000_000, 400])
def test_near_duplicates_equal_brute_force(spark, docs, hostile, block):
    rng = np.random.default_rng(0)
    base = [f"t{i}" for i in range(120)]
    family = []
    for k in range(60):  # one family of near copies, at all distances
        w = list(base)
        for i in rng.choice(120, k % 9, replace=False):
            w[i] = f"e{k}_{i}"
        family.append((100_000 + k, " ".join(w)))
    rows = docs.select("doc_id", "text").union(spark.createDataFrame(family, "doc_id long, text string")).union(hostile.where("doc_id != 10").select(F.col("doc_id") + 200_000, "text"))
    want = components([tuple(r) for r in rows.collect()])
    got = {r["doc_id"]: r for r in near_duplicates(rows, block_shingles=block).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    assert all(r["n_shingles"] == len(shingles(texts[i])) for i, r in got.items())


def test_near_duplicates_without_ids_or_rows(spark, empty):
    assert near_duplicates(empty).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e")], "doc_id long, text string")
    assert sorted(map(tuple, near_duplicates(rows).collect()), key=str) == [(1, 1, 1, True), (None, 1, None, True)]


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary())
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("which", ["docs", "hostile"])
def test_token_counts_equal_the_library(request, which):
    rows = request.getfixturevalue(which)
    texts = [r["text"] or "" for r in rows.collect()]
    got = token_counts.token_counts(rows, queries.vocabulary()).collect()
    assert [r["n_tokens"] for r in got] == [len(x) for x in library(texts)]
    assert [r["n_bytes"] for r in got] == [len(t.encode()) for t in texts]


def test_merges_on_odd_pieces():
    pairs = token_counts.byte_pairs(queries.vocabulary())
    rng = np.random.default_rng(1)
    alphabet = list("aeinst \n'’.,!é😀 \x1c\x85　한字9٣")
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 40))) for _ in range(3000)]
    assert [pairs.count(t) for t in texts] == [len(x) for x in library(texts)]


@pytest.mark.parametrize("which", ["docs", "hostile"])
def test_packing_round_trip(request, spark, which):
    rows = request.getfixturevalue(which)
    pieces = packing.pack(rows, queries.vocabulary()).collect()
    want = Counter((r["doc_id"], tuple(x) + (0,)) for r, x in zip(rows.collect(), library([r["text"] or "" for r in rows.collect()]), strict=True))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert len(p["ids"]) == 4 * p["length"]
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    got = Counter()
    for i, ps in by_doc.items():
        ps.sort(key=lambda p: (p["sequence_id"], p["offset"]))
        ids = []
        for p in ps:  # repeated rows follow one another on the curve
            assert p["start"] == len(ids)
            ids += np.frombuffer(p["ids"], "<u4").tolist()
            if len(ids) == p["doc_tokens"]:
                got[i, tuple(ids)] += 1
                ids = []
        assert not ids
    assert got == want
    short = 0
    for ps in by_sequence.values():
        ps.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in ps] == [sum(q["length"] for q in ps[:k]) for k in range(len(ps))]
        short += sum(p["length"] for p in ps) < 1024
    assert short <= 8 and all(sum(p["length"] for p in ps) <= 1024 for ps in by_sequence.values())


def test_packing_puts_equal_texts_together_and_takes_no_rows(empty, docs):
    assert packing.pack(empty, queries.vocabulary()).count() == 0
    named = docs.limit(5).select(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("d"), "doc_id")).alias("doc_id"), "text")
    assert {type(r["doc_id"]) for r in packing.pack(named, queries.vocabulary()).collect()} <= {str, type(None)}
    points = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = packing.hilbert(points, 3)
    assert sorted(keys.tolist()) == list(range(512))
    steps = np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(1)
    assert (steps == 1).all()  # neighbours on the curve are neighbours in space


@pytest.mark.parametrize("which", ["docs", "hostile", "one"])
def test_fingerprints_against_brute_force(request, spark, docs, hostile, which):
    rows = {"docs": docs, "hostile": hostile, "one": hostile.where("doc_id = 1")}[which]
    local = sorted(((r["doc_id"], r["text"] or "") for r in rows.select("doc_id", "text").collect()))
    got = sorted(map(tuple, fingerprints.compare_with_following(rows).collect()))
    assert len(got) == len(local)
    for k, (i, text) in enumerate(local):
        following = local[(k + 1) % len(local)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        row = next(r for r in got if r[:3] == (i, len(text), hashlib.sha256(edited.encode()).hexdigest()))
        sketches = [fingerprints.decode(row[3]), fingerprints.decode(row[4])]
        assert [s[0] for s in sketches] == [len(shingles(text)), len(shingles(edited))]
        if len(shingles(text)) > 800:
            assert abs(len(sketches[0][2]) * 8 / sketches[0][0] - 1) < 0.5
            true = len(shingles(text) & shingles(edited)) / min(len(shingles(text)), len(shingles(edited)))
            assert abs(row[5] - true) < 0.25
    by_text = defaultdict(set)
    for i, text in local:
        by_text[text] |= {r[3] for r in got if r[0] == i}
    assert all(len(v) == 1 for v in by_text.values())


def test_fingerprints_merge(spark, empty):
    assert fingerprints.compare_with_following(empty).count() == 0
    rows = spark.createDataFrame([(1, " ".join(f"a{i}" for i in range(900))), (2, " ".join(f"b{i}" for i in range(300))), (3, None)], "doc_id long, text string")
    a, b, none = (r["fingerprint"] for r in fingerprints.fingerprints(rows).orderBy("doc_id").collect())
    both = fingerprints.merge(a, b)
    assert fingerprints.containment(fingerprints.decode(b), fingerprints.decode(both)) == 1
    assert abs(fingerprints.decode(both)[0] - 1192) < 20
    assert fingerprints.containment(fingerprints.decode(a), fingerprints.decode(b)) == 0
    assert fingerprints.decode(fingerprints.merge(a, none))[2].tolist() == fingerprints.decode(a)[2].tolist()
    short = spark.createDataFrame([(i, f"only {i}") for i in range(40)], "doc_id long, text string")
    got = fingerprints.compare_with_following(short).collect()
    assert all(r["near_next"] == 0 for r in got)


@pytest.mark.parametrize("law", ["rows", "bytes"])
@pytest.mark.parametrize("which", ["docs", "hostile"])
def test_sharding_laws(request, which, law):
    rows = request.getfixturevalue(which)
    got = sharding.shard_documents(rows, law=law).collect()
    texts = defaultdict(list)
    for r in rows.collect():
        texts[r["doc_id"]].append(r["text"] or "")
    assert Counter(r["doc_id"] for r in got) == Counter({i: len(t) for i, t in texts.items()})
    shards = defaultdict(list)
    for r in got:
        text = texts[r["doc_id"]][0].encode()
        assert (r["size"], r["text_crc32"]) == (len(text) + 1, zlib.crc32(text))
        shards[r["shard"]].append(r)
    assert all(sorted(r["slot"] for r in s) == list(range(len(s))) for s in shards.values())
    counts, sizes = [len(shards[s]) for s in range(16)], [sum(r["size"] for r in shards[s]) for s in range(16)]
    if law == "rows":
        assert max(counts) - min(counts) <= 1
    else:
        assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in got)
    homes = defaultdict(set)
    for r in got:
        homes[texts[r["doc_id"]][0]].add(r["shard"])
    assert sum(len(h) - 1 for h in homes.values()) <= 15


def test_sharding_splits_a_group_above_a_shard(spark, empty):
    assert sharding.shard_documents(empty).count() == 0
    rows = spark.createDataFrame([(i, "same" if i % 3 == 0 else f"own {i}") for i in range(600)], "doc_id long, text string")
    got = sharding.shard_documents(rows).collect()
    counts = Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 16
    assert len({r["shard"] for r in got if r["doc_id"] % 3 == 0}) <= 8  # 200 of 600 need 6 shards


@pytest.mark.parametrize(("copies", "law"), [(2, "rows"), (3, "bytes"), (40, "rows")])
def test_sharding_leaves_groups_whole_where_every_text_repeats(spark, copies, law):
    rows = spark.range(2400).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") / copies).cast("int")).alias("text"))
    got = sharding.shard_documents(rows, law=law).collect()
    homes = defaultdict(set)
    for r in got:
        homes[r["doc_id"] // copies].add(r["shard"])
    counts = Counter(r["shard"] for r in got)
    assert len(got) == 2400 and len(counts) == 16 and sum(len(h) - 1 for h in homes.values()) <= 15
    assert law == "bytes" or max(counts.values()) - min(counts.values()) <= 1


def reference_targets(sizes):
    weights, total, capped = [i % 3 + 1 for i in range(len(sizes))], sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left = total - sum(3 * sizes[i] for i in capped)
        share = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        over = {i for i in free if share[i] > 3 * sizes[i]}
        if not over:
            return [3.0 * sizes[i] if i in capped else share[i] for i in range(len(sizes))]
        capped |= over


@pytest.mark.parametrize("which", ["docs", "hostile"])
def test_mixing_meets_targets(request, which):
    rows = request.getfixturevalue(which)
    got = mixing.mix_plan(rows).collect()
    sizes = [len(words(r["text"])) for r in rows.collect()]
    assert sorted(r["size"] for r in got) == sorted(sizes)
    source = {}
    for r in rows.collect():
        source[r["doc_id"]] = r["source"]
    by = defaultdict(lambda: [0, 0])
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert r["taken"] == r["passes"] * r["size"] + r["span"]
        by[source[r["doc_id"]]][0] += r["size"]
        by[source[r["doc_id"]]][1] += r["taken"]
    order = sorted(by, key=lambda s: (s is None, s or ""))
    aims = reference_targets([by[s][0] for s in order])
    told = {source[r["doc_id"]]: (r["source_size"], r["target"]) for r in got}
    for s, aim in zip(order, aims, strict=True):
        assert told[s][0] == by[s][0] and told[s][1] == pytest.approx(aim)
        assert abs(by[s][1] - aim) <= max(1.5, 0.02 * aim)
    again = mixing.mix_plan(rows.orderBy(F.rand(1))).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_sainte_lague_by_quotients():
    rng = np.random.default_rng(2)
    for _ in range(200):
        votes, seats = rng.integers(0, 1000, rng.integers(1, 9)).tolist(), int(rng.integers(0, 60))
        got = [0] * len(votes)
        for _ in range(seats if sum(votes) else 0):
            got[max(range(len(votes)), key=lambda i: (votes[i] / (2 * got[i] + 1), -i))] += 1
        assert mixing.sainte_lague(seats, votes) == got


def test_mix_applied_has_the_words_taken(docs, empty):
    rows = docs.where("doc_id < 300")
    plan = {r["doc_id"]: r for r in mixing.mix_plan(rows).collect()}
    out = defaultdict(list)
    mixed = mixing.apply_mix(rows)
    assert mixed.columns == docs.columns
    for r in mixed.collect():
        assert r["n_chars"] == len(r["text"])
        out[r["doc_id"]].append(len(words(r["text"])))
    assert {i: sum(v) for i, v in out.items()} == {i: r["taken"] for i, r in plan.items() if r["taken"]}
    assert mixing.apply_mix(empty).count() == 0 and mixing.mix_plan(empty).count() == 0


def test_sources_get_blocks_by_highest_quotients(spark):
    rng = np.random.default_rng(5)
    for votes, seats in [([1000.0] * 7, 10), (rng.integers(1, 10**6, 300).astype(float).tolist(), 997), ([5e6] + [40.0] * 500, 20_000), ([3.0, 1.0, 1.0, 0.0], 4), ([2.0, 2.0, 1.0], 0), ([0.0], 5), ([7.0], 12)]:
        table = spark.createDataFrame([(i, v) for i, v in enumerate(votes)], "place long, v double")
        got = mixing.highest_quotients(table, "v", "place", seats).orderBy("place").collect()
        assert [r["seats"] for r in got] == mixing.sainte_lague(seats, votes), (len(votes), seats)


def test_a_small_source_leaves_the_others_their_blocks(spark):
    rows = [(i, "w " * 700, "big") for i in range(400)] + [(1000, "one two three", "small"), (1001, "x", None)]
    narrow = spark.createDataFrame(rows, "__draw_id long, text string, source string")
    narrow = narrow.select(*mixing._keys(F.col("__draw_id"), F.col("text"), F.col("source"), 17))
    plan = {r["__source"]: r for r in mixing.source_plan(narrow, (1, 2, 3), 3).collect()}
    assert plan["abig"]["__unit"] == mixing.BLOCK and plan["asmall"]["__unit"] == 1
    assert plan["asmall"]["__due"] == 9 and plan["b"]["__due"] == 3 and plan["abig"]["__due"] == round(plan["abig"]["__target"])


def test_what_a_source_is_due_is_what_sainte_lague_awards(spark):
    kind = "__source string, __size long"
    for sizes in ([3, 3, 3], [7] * 5, [1_000_001, 1_200_003, 900_007], [1_000_001, 1_200_003, 900_007, 3, 5, 11]):
        rows = spark.createDataFrame([(f"a{i}", n) for i, n in enumerate(sizes)], kind)
        plan = mixing.source_plan(rows, (1, 2, 3), 3).orderBy("__source").collect()
        due, want = [r["__due"] for r in plan], {}
        assert max(sizes) > 100 or sum(due) == sum(sizes)
        for large, block in ((True, mixing.BLOCK), (False, 1)):
            aims = [(i, r["__target"]) for i, r in enumerate(plan) if (r["__target"] >= mixing.WHOLE * mixing.BLOCK) == large]
            seats = mixing.sainte_lague(round(sum(t for _, t in aims) / block), [t for _, t in aims])
            want |= {i: min(s * block, 3 * sizes[i]) for (i, _), s in zip(aims, seats, strict=True)}
        assert due == [want[i] for i in range(len(sizes))]
        assert all(abs(r["__due"] - r["__target"]) <= max(1, r["__target"] / 2048) for r in plan)


def test_a_source_of_blank_rows_is_dealt_to_many_shards(spark):
    blank = spark.range(1_000_000).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit("blank").alias("source"))
    some = spark.createDataFrame([(-1, "a b c", "some"), (-2, "d e", "blank")], blank.schema)
    rows = blank.union(some)
    narrow = rows.select(*mixing._keys(F.col("doc_id"), F.col("text"), F.col("source"), 17))
    assert {r["__source"]: r["__shards"] for r in mixing.source_plan(narrow, (1, 2, 3), 3).collect()} == {"ablank": 3, "asome": 1}
    got = {r["doc_id"]: r["taken"] for r in mixing.mix_plan(rows).where("doc_id < 0").collect()}
    assert got[-2] == round(5 / 3) and got[-1] == round(10 / 3)


def test_packing_ranges_follow_token_totals(spark, docs):
    """Several ranges in a task, a hot key over several ranges, and the same sequences in a rerun."""
    rows = docs.select("doc_id", "text").union(spark.range(300).select(F.col("id") + 5_000_000, F.lit("same words in each of these " * 20)))
    a = packing.pack(rows, queries.vocabulary(), range_tokens=20_000).collect()
    b = packing.pack(rows.orderBy(F.rand(2)), queries.vocabulary(), range_tokens=20_000).collect()
    key = lambda r: (r["sequence_id"], r["offset"], r["doc_id"], r["start"], r["length"], bytes(r["ids"]))
    assert sorted(map(key, a)) == sorted(map(key, b))
    tokens, starts = Counter(), Counter()
    for r in a:
        tokens[r["sequence_id"] >> 33] += r["length"]
        starts[r["sequence_id"], r["offset"]] += 1
    total = sum(tokens.values())
    want = sum(len(x) + 1 for x in library([r["text"] or "" for r in rows.collect()]))
    assert total == want and set(starts.values()) == {1} and len(tokens) >= total / 80_000
    assert len({r["sequence_id"] >> 33 for r in a if r["doc_id"] >= 5_000_000}) > 1


def test_vocabularies_that_say_more_are_refused(tmp_path):
    with open(queries.vocabulary(), encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": {**spec["model"], "ignore_merges": True}}):
        (tmp_path / "v.json").write_text(json.dumps({**spec, **change}))
        with pytest.raises(ValueError):
            token_counts.BytePairs(str(tmp_path / "v.json"))
    assert token_counts.byte_pairs(queries.vocabulary()).ordered


def test_fingerprints_of_very_long_texts(spark):
    rows = [(i, f"word{i} " * 400_000) for i in range(6)] + [(10 + i, "a b c d e f") for i in range(4)]
    got = sorted(map(tuple, fingerprints.compare_with_following(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    for k, (i, text) in enumerate(rows):
        edited = fingerprints.edited_text(text, rows[(k + 1) % len(rows)][1])
        assert got[k][:3] == (i, len(text), hashlib.sha256(edited.encode()).hexdigest())
