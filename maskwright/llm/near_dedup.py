"""MinHash near-duplicates by an inverted join over signature coordinates."""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import materialize, with_running_totals
from .textcore import distinct, mix, shingle_sets, shingles_by_text

#: Signature coordinates, and the probability at most with which a linked pair agrees in too few of them.
COORDINATES, MISSED = 64, 2e-7
SIMILARITY = 85  # percent
#: Shingles (with repeats) of a block of candidates that one task takes; larger blocks are cut in parts.
BLOCK_SHINGLES = 6_000_000
#: Members of a posting list of a large block whose signatures one task compares.
SIGNATURES = 4000
#: What tells texts' sets apart. Classes above one in HOT of the rows are broadcast.
KEY, HOT = ("n_shingles", "set_a", "set_b"), 1000
_rng = np.random.default_rng(20240117)
_A = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
_SIGNED = "doc_id long, n_shingles long, n_repeats long, set_a long, set_b long, signature binary"


def least_matches(similarity: int) -> int:
    """How many coordinates must agree: a pair at ``similarity`` percent has fewer with a probability of MISSED at most.

    At 85 a pair agrees in 54.4 +- 2.9 of 64, and 38 must agree; at 80 33 must.
    """
    p, below = similarity / 100, 0.0
    for m in range(COORDINATES):
        below += comb(COORDINATES, m) * p**m * (1 - p) ** (COORDINATES - m)
        if below > MISSED:
            return max(1, m)
    return COORDINATES


def _signatures(hashes: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Least value of each coordinate's hash over each row's shingles, 32 bits each; rows must not be empty."""
    out = np.empty((len(off) - 1, COORDINATES), np.uint32)
    for j in range(COORDINATES):
        v = hashes * _A[j]
        v += _B[j]
        v ^= v >> np.uint64(32)
        out[:, j] = np.minimum.reduceat((v * _A[j] >> np.uint64(32)).astype(np.uint32), off[:-1])
    return out


def sign(docs: DataFrame, width: int = 5) -> DataFrame:
    """Rows (doc_id, n_shingles, n_repeats, set_a, set_b, signature): the size of each text's shingle set, a
    128-bit hash of the set, and its MinHash signature (null for an empty set)."""

    def run(batches):
        for batch in batches:
            ids, out = batch.column(0), []
            for row, h, off in shingles_by_text(batch.column(1), width):
                n = np.diff(off)
                some = np.flatnonzero(n)
                sigs = _signatures(h, np.append(off[:-1][some], off[-1])) if len(some) else []
                sig = dict(zip(some.tolist(), sigs, strict=True))
                for i in range(len(n)):
                    s = distinct(h[off[i] : off[i + 1]])
                    a = int(mix(s ^ np.uint64(0x51ED270B)).sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0
                    b = int(mix(s ^ np.uint64(0x7FB5D329)).sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0
                    out.append((len(s), int(n[i]), a, b, sig[i].tobytes() if i in sig else None))
                if len(out) >= 4096:
                    yield _signed(ids.slice(row + len(n) - len(out), len(out)), out)
                    out = []
            if out:
                yield _signed(ids.slice(batch.num_rows - len(out), len(out)), out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, _SIGNED)


def _signed(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    n, r, a, b, s = zip(*rows, strict=True)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip((n, r, a, b, s), kinds, strict=True))], names=[f.split()[0] for f in _SIGNED.split(", ")])


def _tokens(classes: DataFrame) -> DataFrame:
    """Posting rows (rep, n_repeats, token): a token is a coordinate and its value."""

    def run(batches):
        place = np.arange(COORDINATES, dtype=np.int64) << 32
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).astype(np.int64).reshape(-1, COORDINATES)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), COORDINATES)), pa.array((sig | place).ravel())], names=["rep", "token"])

    return classes.select("rep", "signature").mapInArrow(run, "rep long, token long")


def candidate_blocks(classes: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """Rows (rep, block, weight) of the classes that may have a partner; partners share a block.

    Two signatures that agree in ``least_matches`` coordinates share one of
    the COORDINATES - matches + 1 rarest coordinate values of each (the
    prefix). Values that occur once need no posting and, being rarest, fill a
    prefix first: a class is only posted if at least that many of its values
    occur elsewhere, and only under the rarest of those. Each posting list is a star
    to its least class, and stars that touch form a block. ``weight`` sums how
    often a class's values occur: the typical member of a block has the most.
    """
    matches = least_matches(similarity)
    tokens = _tokens(classes)
    often = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    shared = tokens.join(often, "token").groupBy("rep").agg(F.collect_list(F.struct("df", "token")).alias("t"), F.sum("df").alias("weight")).where(F.size("t") >= matches)  # COORDINATES entries at most
    prefix = F.slice(F.array_sort("t"), F.lit(1), F.size("t") - matches + 1)
    posted = materialize(shared.select("rep", "weight", F.explode(F.transform(prefix, lambda x: x["token"])).alias("token")), "posted")
    stars = posted.join(posted.groupBy("token").agg(F.min("rep").alias("least"), F.count("*").alias("n")).where("n > 1"), "token")
    linked = connected_components(stars.select(F.col("rep").alias("src"), F.col("least").alias("dst")))
    weights = posted.groupBy("rep").agg(F.max("weight").alias("weight"))
    return linked.select(F.col("node").alias("rep"), F.col("component").alias("block")).join(weights, "rep")


def _prefix_lists(sets: list[np.ndarray], similarity: int) -> tuple[list[np.ndarray], dict[int, np.ndarray]]:
    """Each member's rarest shingles in the block that another has too, and for each of these its members.

    Linked sets share one of the n - ceil(similarity * n) + 1 rarest shingles of each.
    """
    n = np.array([len(s) for s in sets], np.int64)
    _, token, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), n)
    order = np.lexsort((token, df[token], owner))
    token = token[order]
    begin = np.repeat(np.cumsum(n) - n, n)
    keep = (np.arange(len(token)) - begin < np.repeat(n - -(-similarity * n // 100) + 1, n)) & (df[token] > 1)
    token, owner = token[keep], owner[keep]
    own = np.split(token, np.cumsum(np.bincount(owner, minlength=len(sets)))[:-1])
    by = np.argsort(token, kind="stable")
    names, at = np.unique(token[by], return_index=True)
    return own, dict(zip(names.tolist(), np.split(owner[by], at[1:]), strict=True)) if len(names) else {}


def link_block(sets: list[np.ndarray], signatures: np.ndarray, first: int, similarity: int = SIMILARITY) -> np.ndarray:
    """Label the members of a block by the least position each can reach.

    From one member after another, all that it is linked with are reached.
    Its prefix lists are merged, members that were reached already are skipped
    and taken off the lists; of the rest those that collide in
    ``least_matches`` signature coordinates or more are confirmed on the full sets. ``first``
    members form part one; if it is less than all, only links between part one
    and the rest are looked for.
    """
    n = len(sets)
    label = np.full(n, -1)
    if not n:
        return label
    sizes = np.array([len(s) for s in sets])
    own, lists = _prefix_lists(sets, similarity)
    one, matches = np.arange(n) < first, least_matches(similarity)
    for seed in range(n):
        if label[seed] >= 0:
            continue
        label[seed] = seed
        queue = [seed]
        while queue:
            at = queue.pop()
            merged = []
            for t in own[at].tolist():
                lists[t] = lists[t][label[lists[t]] < 0]
                merged.append(lists[t])
            near = np.unique(np.concatenate(merged)) if merged else np.empty(0, np.int64)
            if first < n:
                near = near[one[near] != one[at]]
            near = near[100 * np.minimum(sizes[near], sizes[at]) >= similarity * np.maximum(sizes[near], sizes[at])]
            near = near[(signatures[near] == signatures[at]).sum(1) >= matches]
            hit = [j for j in near.tolist() if _linked(sets[at], sets[j], similarity)]
            label[hit] = seed
            queue += hit
    return label


def _linked(a: np.ndarray, b: np.ndarray, similarity: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    shared = int((b[at] == a).sum())
    return 100 * shared >= similarity * (len(a) + len(b) - shared)


def _confirm(tasks: DataFrame, keys: list[str], similarity: int) -> DataFrame:
    """Forest rows (src, dst) of the links among the members (rep, side, text) of each task; with members of side 1,
    of the links between the two sides."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "rep"], kind="stable")
        sets = list(shingle_sets(pa.array(pdf.text, pa.large_string())))
        pdf = pdf[[len(s) > 0 for s in sets]]
        sets = [s for s in sets if len(s)]
        off = np.zeros(len(sets) + 1, np.int64)
        np.cumsum([len(s) for s in sets], out=off[1:])
        sig = _signatures(np.concatenate(sets), off) if sets else np.empty((0, COORDINATES))
        label = link_block(sets, sig, int((pdf.side == 0).sum()), similarity)
        reps = pdf.rep.to_numpy()
        return pd.DataFrame({"src": reps, "dst": reps[label] if len(reps) else reps})

    return tasks.select(*keys, "rep", "side", "text").groupBy(*keys).applyInPandas(run, "src long, dst long")


def _parts(weight: Column, block_shingles: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(weight / block_shingles)).cast("int")


def _with_partner(signatures: np.ndarray, sizes: np.ndarray, components: np.ndarray, similarity: int) -> np.ndarray:
    """Whether a member may be linked with one of another component: enough coordinates agree, and the sizes allow it."""
    out, matches = np.zeros(len(sizes), bool), least_matches(similarity)
    for lo in range(0, len(sizes), 64):
        part = slice(lo, lo + 64)
        agree = np.zeros((len(sizes[part]), len(sizes)), np.uint8)
        for c in range(COORDINATES):
            agree += signatures[part, c, None] == signatures[None, :, c]
        near = (agree >= matches) & (components[part, None] != components[None])
        near &= 100 * np.minimum(sizes[part, None], sizes[None]) >= similarity * np.maximum(sizes[part, None], sizes[None])
        out[part] |= near.any(1)
        out |= near.any(0)
    return out


def _large_blocks(texts: DataFrame, classes: DataFrame, forest: DataFrame, similarity: int, block_shingles: int) -> DataFrame:
    """Forest rows of the links that cross the parts of large blocks. ``texts``: rep, block, text; ``classes``: their
    signatures and sizes; ``forest``: their links within parts.

    Linked sets share one of the n - ceil(similarity * n) + 1 shingles of each
    that are rarest in the block. Members are posted under these (shingles of
    one member need no posting and fill the prefix first), and only the lists
    whose members are not all in one component yet are looked at. A list's
    members first meet by signature; those that may be linked with a member of
    another component go on, lists that are left with the same members count
    once, and only then texts are sent and links confirmed. A list above the
    bounds is cut in parts, and each pair of parts is a task.
    """

    def explode(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                sets = list(shingle_sets(part.column(2)))
                n = np.array([len(v) for v in sets], np.int64)
                ids = [np.repeat(part.column(c).to_numpy(), n) for c in (1, 0)]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (*ids, np.repeat(n, n), np.concatenate(sets).view(np.int64))], names=["block", "rep", "n", "token"])

    def cut(members: DataFrame, parts: Column) -> DataFrame:
        """Each member goes to the tasks (i, j) of its part with every part."""
        part = members.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
        sends = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(o, F.col("part")).alias("i"), F.greatest(o, F.col("part")).alias("j")))
        return part.withColumn("task", F.explode(sends)).withColumn("i", F.col("task.i")).withColumn("j", F.col("task.j")).withColumn("side", (F.col("part") != F.col("i")).cast("int")).drop("task", "parts", "part")

    def flag(pdf: pd.DataFrame) -> pd.DataFrame:
        sig = np.frombuffer(b"".join(pdf.signature), np.uint32).reshape(-1, COORDINATES)
        return pdf[_with_partner(sig, pdf.n.to_numpy(), pdf.component.to_numpy(), similarity)][["block", "token", "rep", "n"]]

    tokens = texts.select("rep", "block", "text").mapInArrow(explode, "block long, rep long, n long, token long")
    often = tokens.groupBy("block", "token").agg(F.count("*").alias("df")).where("df > 1")
    least = F.ceil(F.col("n") * similarity / 100).cast("int")
    shared = tokens.join(often, ["block", "token"]).groupBy("block", "rep", "n").agg(F.collect_list(F.struct("df", "token")).alias("t")).where(F.size("t") >= least)  # one text's shingles
    posted = shared.select("block", "rep", "n", F.explode(F.transform(F.slice(F.array_sort("t"), F.lit(1), F.size("t") - least + 1), lambda x: x["token"])).alias("token"))
    label = connected_components(forest)
    posted = materialize(posted.join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")), "posted")
    members = [F.count("*").alias("members"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("sum")]
    lists = posted.groupBy("block", "token").agg(F.min("component").alias("a"), F.max("component").alias("z"), *members)
    live = lists.where("a != z").groupBy("block", "members", "sum").agg(F.min("token").alias("token")).select("block", "token", "members")
    hits = cut(posted.join(live, ["block", "token"]), F.ceil(F.col("members") / SIGNATURES).cast("int"))
    hits = hits.join(classes.select("rep", "signature"), "rep").select("block", "token", "i", "j", "rep", "n", "component", "signature")
    flagged = materialize(hits.groupBy("block", "token", "i", "j").applyInPandas(flag, "block long, token long, rep long, n long").distinct(), "flagged")
    left = flagged.groupBy("block", "token").agg(F.sum("n").alias("w"), *members).groupBy("block", "members", "sum").agg(F.min("token").alias("token"), F.max("w").alias("w"))
    sent = cut(flagged.join(left.select("block", "token", "w"), ["block", "token"]), _parts(F.col("w"), block_shingles))
    return _confirm(sent.join(texts.select("rep", "text"), "rep"), ["block", "token", "i", "j"], similarity)


def _of_rows(signed: DataFrame, classes: DataFrame, total: int) -> DataFrame:
    """``signed`` (doc_id, KEY) with the component of each row's class in ``classes`` (KEY, component, n).

    The classes that hold more than a thousandth of the rows, fewer than a
    thousand, are broadcast, so that no join key is hot; the others meet their
    rows in a shuffle. Rows with an empty set or without an id stay out of it.
    """
    hot = F.col("n") * HOT > F.lit(total)
    key = lambda c: c.select(*(F.col(k).alias(f"k_{k}") for k in KEY), "component")
    on = [F.col(k) == F.col(f"k_{k}") for k in KEY]
    inside = F.coalesce((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.lit(False))
    out = signed.where(~inside).select("doc_id", "n_shingles", F.col("doc_id").alias("component"))
    some = signed.where(inside).select("doc_id", *KEY)
    large = F.broadcast(key(classes.where(hot)))
    rest = some.join(large.drop("component"), on, "left_anti").join(key(classes.where(~hot)).hint("merge"), on)
    for part in (some.join(large, on), rest):
        out = out.unionByName(part.select("doc_id", "n_shingles", "component"))
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: int = SIMILARITY, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Rows (id_col long, n_shingles long, component_id long, kept boolean), one for each row of ``docs``.

    Words are runs of characters other than space and 0x09-0x0D, A-Z lower-
    cased; a text's set holds its distinct 5-word shingles, or its whole word
    sequence if it has fewer. Texts with 100 * intersection >= ``similarity``
    * union are linked, component_id is the least id reachable, kept marks it.

    A null or blank text has an empty set and is linked with nothing. Repeated
    rows are equal texts; where an id repeats with different texts, each row
    follows its own text, and classes of the same least id are one. Rows
    without an id are linked with nothing: component_id is null and they are
    kept. An empty table gives no rows. Other columns are not read.

    Equal sets are one class. Classes whose signatures may agree in
    ``least_matches`` coordinates share a block (see ``candidate_blocks``); links are confirmed
    on full sets within it. A block above ``block_shingles`` is cut in parts:
    each part is a task that also gets the block's most typical member, which
    joins the parts' clusters of copies, and ``_large_blocks`` finds what links
    still cross them. No task and no posting list holds an unbounded group,
    and no candidate is dropped.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = materialize(sign(rows), "signed")
    classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy(*KEY).agg(F.min("doc_id").alias("rep"), F.min("signature").alias("signature"), F.min("n_repeats").alias("n_repeats"), F.count("*").alias("n"))
    classes = materialize(classes, "classes")
    blocks = materialize(candidate_blocks(classes, similarity), "blocks")
    inside = blocks.join(classes.select("rep", "n_repeats"), "rep")
    weights = inside.groupBy("block").agg(_parts(F.sum("n_repeats"), block_shingles).alias("parts"), F.max(F.struct("weight", (-F.col("rep")).alias("r"))).alias("typical"))
    member = materialize(blocks.join(weights, "block").select("rep", "block", "parts", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part"), (-F.col("typical.r")).alias("typical")), "members")
    texts = rows.join(member, rows["doc_id"] == member["rep"]).select("rep", "block", "parts", "part", "typical", F.lit(0).alias("side"), "text")
    large = member.where("parts > 1").limit(1).count() > 0
    if large:
        texts = materialize(texts, "texts")
        more = texts.where("parts > 1 and rep = typical").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        found = materialize(_confirm(texts.unionByName(more), ["block", "part"], similarity), "found")
        crossing = texts.where("parts > 1")
        forest = found.join(crossing.select(F.col("rep").alias("src")).distinct(), "src", "left_semi").select("src", "dst")
        found = materialize(found.unionByName(_large_blocks(crossing, classes, forest, similarity, block_shingles)), "found")
    else:
        found = materialize(_confirm(texts, ["block", "part"], similarity), "found")
    # a rep in more than one task (a cut block, a repeated id) may have several labels
    loose = large or found.groupBy("src").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() > 0
    label = connected_components(found) if loose else found.groupBy("dst").agg(F.min("src").alias("component")).join(found, "dst").select(F.col("src").alias("node"), "component")
    named = classes.join(label.withColumnRenamed("node", "rep"), "rep", "left").select(*KEY, "n", F.coalesce("component", "rep").alias("component"))
    named = materialize(named, "named")
    out = _of_rows(signed, named, signed.count())
    out = out.select(F.col("doc_id").alias(id_col), "n_shingles", F.col("component").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def keep_representatives(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any more columns) that near_duplicates keeps at ``similarity``.

    Of each group the row of least id stays; repeated rows stay once. Rows
    without an id, and texts that are null or blank, are near copies of nothing
    and stay. Where an id stands on different texts, each text is kept or
    dropped as its own. An empty table gives no rows.
    """
    some = docs.where(docs["doc_id"].isNotNull())
    by_text = some.select("doc_id", F.xxhash64("text").alias("__text"))
    ids = "doc_id"
    if by_text.groupBy("doc_id").agg((F.min("__text") != F.max("__text")).alias("clash")).where("clash").limit(1).count():
        # texts are told apart by their place in the order of the ids
        places = with_running_totals(by_text.distinct(), ["doc_id", "__text"], {}, "__row").select(F.col("doc_id").alias("__id"), F.col("__text").alias("__hash"), "__row")
        some = materialize(some.join(places.hint("merge"), (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__hash"))).select(*(some[c] for c in docs.columns), "__row"), "rows")
        ids = "__row"
    found = materialize(near_duplicates(some, id_col=ids, similarity=similarity), "kept")
    kept = found.where("kept").select(F.col(ids).alias("__kept"))
    # the kept ids grow with the corpus: merged at every size, never broadcast
    rows = some.join(kept.hint("merge"), some[ids] == kept["__kept"], "left_semi")
    if kept.groupBy("__kept").count().where("count > 1").limit(1).count():
        rows = rows.dropDuplicates([ids])
    return rows.select(*docs.columns).unionByName(docs.where(docs["doc_id"].isNull()))
