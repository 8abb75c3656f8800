"""Prefix trie of conversations by the Euler tour technique.

Nodes are the distinct sequences of first turns. A sequence is told by the sums of four 32-bit hashes of its turns, each
turn hashed with its position (SHA-256), so a conversation's prefixes are running sums. Children of a node are ordered by
their smallest member. Every node has an enter and an exit arc; what follows an arc is known from the first child, the
next sibling and the parent, which makes one list of all arcs, the tour. The list is ranked in rounds:

* arcs that follow each other and lie in the same task (tasks hold neighbouring conversations) become one element with
  the sum of their weights;
* while more than `rest` elements are left, each proposes the one of its two links with the larger hash, and a link that
  both its ends propose joins them: a third of the links on average, by one aggregation over what is left;
* at most `rest` elements are ranked on the driver, and the rounds are unrolled: an element's place is that of the
  element it became part of, plus what stood before it there.

With the sums of weights before each arc, a subtree is what lies between a node's arcs: leaves and savings are
differences of two sums. Every step works on rows; no conversation, node or level is held as one group. Hot conversations,
parents and first turns are spread over parts of a global order (see ordered.py); the ids of the conversations that end
at a node are packed in sorted pieces where they are and hashed as a stream.

Defined cases: null role or text counts as empty; rows without a conv_id belong to no conversation and are ignored;
a null turn comes first, equal turns are ordered by role and text; repeated rows are turns of their own; an empty table
has no nodes at all; negative ids take the remainder that SQL takes; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .ordered import in_parts, neighbours, parts_for, running

_S = ["s0", "s1", "s2", "s3"]
_W = ["w_arcs", "w_leaves", "w_saved"]


def numbered(conversations: DataFrame, n: int) -> DataFrame:
    """conv_id, pos (from 1), mark (SHA-256 of role and text), size (code points of the text) of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), role.alias("role"), text.alias("text"))
    table = in_parts(turns, n, ["conv_id", "turn", "role", "text"], "trie-turns")
    mark = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    marked = table.select("conv_id", F.lit(1).cast("long").alias("one"), mark.alias("mark"), F.length("text").cast("long").alias("size"), "place", "part")
    out = materialize(running(marked, "conv_id", {"pos": "one"}).select("conv_id", "pos", "mark", "size"), "trie-marks")
    discard(table)
    return out


def rebuilt(turns: DataFrame, every: int = 100, kinds: int = 6) -> tuple[DataFrame, DataFrame]:
    """(conversations: conv_id; their turns): each takes the first h turns of conversation c - c % every and goes on with its own after the first h; h = crc32(c) % kinds."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % kinds
    counts = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = counts.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % every})
    heads = turns.filter(F.col("pos") < kinds).select(F.col("conv_id").alias("base"), "pos", "mark", "size")
    # at most kinds - 1 turns of at most 2 * every conversations for each base
    taken = convs.join(heads, "base").filter(F.col("pos") <= F.col("h")).select("conv_id", "pos", "mark", "size")
    shift = convs.join(counts.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left")
    shift = shift.select("conv_id", "h", (F.col("h") - F.least("h", F.coalesce("n_base", F.lit(0)))).alias("back"))
    own = turns.join(shift, "conv_id").filter(F.col("pos") > F.col("h")).select("conv_id", (F.col("pos") - F.col("back")).alias("pos"), "mark", "size")
    return convs.select("conv_id"), taken.unionByName(own)


def _hashes(pos, mark):
    digest = F.sha2(F.concat(F.hex(mark), F.lit("@"), pos.cast("string")), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"t{k}") for k in range(4)]


def _ends(ends: DataFrame, most: int = 8192) -> DataFrame:
    """depth, s0..s3, ends_sha256: ends(depth, s0..s3, conv_id) are whole conversations."""
    keys = ["depth", *_S]

    def table(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
        kinds = [pa.int64() if isinstance(x, int) else pa.string() for x in rows[0]]
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def pack(batches):
        # runs of one key in a sorted task, in pieces of at most `most` ids
        key, ids, names = None, [], [*keys, "first", "ids"]
        for batch in batches:
            *cols, conv = (np.asarray(c) for c in batch.columns)
            if not len(conv):
                continue
            new = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cols], axis=0)])).tolist()
            out = []
            for now, a, b in zip(zip(*(c[new].tolist() for c in cols), strict=True), new, [*new[1:], len(conv)], strict=True):
                if now != key:
                    if ids:
                        out.append((*key, ids[0], ",".join(map(str, ids))))
                    key, ids = now, []
                for x in range(a, b, most):
                    part = conv[x : min(b, x + most)].tolist()
                    if len(ids) + len(part) > most:
                        out.append((*key, ids[0], ",".join(map(str, ids))))
                        ids = []
                    ids += part
            if out:
                yield table(out, names)
        if ids:
            yield table([(*key, ids[0], ",".join(map(str, ids)))], names)

    def digest(batches):
        key, state, names = None, None, [*keys, "ends_sha256"]
        for batch in batches:
            *cols, _, texts = (c.to_pylist() for c in batch.columns)
            out = []
            for now, ids in zip(zip(*cols, strict=True), texts, strict=True):
                if now == key:
                    state.update(b"," + ids.encode())
                    continue
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = now, hashlib.sha256(ids.encode())
            if out:
                yield table(out, names)
        if key is not None:
            yield table([(*key, state.hexdigest())], names)

    ddl = ", ".join(f"{k} long" for k in keys)
    spread = ends.select(*keys, "conv_id").repartitionByRange(*keys, "conv_id").sortWithinPartitions(*keys, "conv_id")
    pieces = spread.mapInArrow(pack, f"{ddl}, first long, ids string")
    return pieces.repartition(*keys).sortWithinPartitions(*keys, "first").mapInArrow(digest, f"{ddl}, ends_sha256 string")


def nodes_of(convs: DataFrame, turns: DataFrame, n: int) -> DataFrame:
    """A row per node: id (ascending with conv_id and depth), conv_id, depth, parent, parent_conv_id, n_convs, size, ends_sha256."""
    hashed = turns.select("conv_id", "pos", "size", *_hashes(F.col("pos"), F.col("mark")))
    in_order = in_parts(hashed, n, ["conv_id", "pos"], "trie-hashes")
    placed = materialize(running(in_order, "conv_id", {s: f"t{k}" for k, s in enumerate(_S)}), "trie-prefixes")
    discard(in_order)
    zero, above = F.lit(0).cast("long"), [f"p{k}" for k in range(4)]
    members = placed.select("conv_id", "size", F.col("pos").alias("depth"), *_S, *[(F.col(s) - F.col(f"t{k}")).alias(f"p{k}") for k, s in enumerate(_S)])
    grouped = members.groupBy("depth", *_S).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("size").alias("size"), *[F.max(p).alias(p) for p in above])
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    grouped = grouped.unionByName(root.select(zero.alias("depth"), *[zero.alias(s) for s in _S], "conv_id", "n_convs", zero.alias("size"), *[zero.alias(p) for p in above]))
    # whole conversations: the sums of all their turns
    whole = placed.groupBy("conv_id").agg(F.count("*").alias("depth"), *[F.sum(f"t{k}").alias(s) for k, s in enumerate(_S)])
    whole = convs.join(whole, "conv_id", "left").na.fill(0, ["depth", *_S])
    loose = materialize(grouped.join(_ends(whole), ["depth", *_S], "left").na.fill({"ends_sha256": hashlib.sha256(b"").hexdigest()}), "trie-loose")
    table = in_parts(loose, n, ["conv_id", "depth"], "trie-nodes").withColumnRenamed("place", "id").drop("part")
    discard(loose)
    discard(placed)
    cols = ["id", "conv_id", "depth", "parent", "parent_conv_id", "n_convs", "size", "ends_sha256"]
    up = [F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id")]
    top = table.filter("depth = 0")
    # the root's children know it without a join by key, as most nodes may be among them
    none = top.select("*", F.lit(None).cast("long").alias("parent"), F.lit(None).cast("long").alias("parent_conv_id"))
    flat = table.filter("depth = 1").crossJoin(F.broadcast(top.select(up)))  # one row
    parents = table.filter("depth > 0").select((F.col("depth") + 1).alias("depth"), *[F.col(s).alias(p) for s, p in zip(_S, above, strict=True)], *up)
    deep = table.filter("depth > 1").join(parents, ["depth", *above])
    return materialize(deep.select(cols).unionByName(flat.select(cols)).unionByName(none.select(cols)), "trie-parents")


def related(nodes: DataFrame, n: int) -> DataFrame:
    """id, parent, saved with elder and younger (siblings next to it), eldest and youngest (children), n_children."""
    pairs = in_parts(nodes.select("id", "parent"), n, ["parent", "id"], "trie-siblings")
    siblings = neighbours(pairs, "parent", "id").select("id", F.col("before").alias("elder"), F.col("after").alias("younger"))
    kids = nodes.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.min("id").alias("eldest"), F.max("id").alias("youngest"), F.count("*").alias("n_children"))
    saved = ((F.col("n_convs") - 1) * F.col("size")).alias("saved")
    return nodes.select("id", "parent", saved).join(siblings, "id").join(kids, "id", "left").na.fill({"n_children": 0})


def tour(known: DataFrame) -> DataFrame:
    """head, tail, before, after and weights of every arc: 2 id enters a node and carries its weights, 2 id + 1 leaves it."""
    enter, leave, zero = (lambda c: 2 * F.col(c)), (lambda c: 2 * F.col(c) + 1), F.lit(0).cast("long")
    weights = lambda *w: [x.cast("long").alias(c) for x, c in zip(w, _W, strict=True)]
    arc = lambda x, before, after, w: F.struct(x.alias("head"), x.alias("tail"), before.alias("before"), after.alias("after"), *w)
    into = arc(enter("id"), F.coalesce(leave("elder"), enter("parent")), F.coalesce(enter("eldest"), leave("id")), weights(F.lit(1), F.col("n_children") == 0, F.col("saved")))
    out = arc(leave("id"), F.coalesce(leave("youngest"), enter("id")), F.coalesce(enter("younger"), leave("parent")), weights(F.lit(1), zero, zero))
    return known.select(F.explode(F.array(into, out)).alias("a")).select("a.*")


_E = ["head", "tail", "before", "after", *_W]


def _joined(batches):
    """Elements of one task: each with `up`, the first of its run, and what stands before it in the run; `last` rows tell the runs."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    head, tail, before, after, *w = (table[c].combine_chunks() for c in _E)
    key = tail.to_numpy()
    order = np.argsort(key, kind="stable")
    asked = before.fill_null(-1).to_numpy()
    at = np.minimum(np.searchsorted(key[order], asked), len(key) - 1)
    prev = np.where(key[order][at] == asked, order[at], -1)
    n = len(key)
    own = np.stack([x.to_numpy() for x in w], axis=1)
    sums, p = np.vstack([own, np.zeros((1, len(_W)), np.int64)]), np.append(np.where(prev < 0, n, prev), n)
    root = np.where(prev < 0, np.arange(n), prev)
    while (p < n).any():
        sums, p, root = sums + sums[p], p[p], root[root]
    has_next = np.zeros(n, bool)
    has_next[prev[prev >= 0]] = True
    heads = head.to_numpy()
    cols = {"head": head, "tail": tail, "before": before.take(pa.array(root)), "after": after, "up": pa.array(heads[root]), "last": pa.array(~has_next)}
    cols |= {c: pa.array(sums[:n, k] - own[:, k]) for k, c in enumerate(_W)} | {f"{c}_sum": pa.array(sums[:n, k]) for k, c in enumerate(_W)}
    yield from pa.table(cols).combine_chunks().to_batches()


def _paired(elements: DataFrame, turn: int) -> DataFrame:
    """left, right: pairs that both propose their common link; right is null for what stays alone."""
    named = lambda h, x, y: F.struct(h.alias("h"), F.col(x).alias("x"), F.col(y).alias("y"))
    seed = F.lit(turn)
    back, on = named(F.xxhash64("before", "head", seed), "before", "head"), named(F.xxhash64("tail", "after", seed), "tail", "after")
    alone = F.col("before").isNull() & F.col("after").isNull()
    link = F.when(alone, named(F.lit(0).cast("long"), "tail", "head")).when(F.col("after").isNull() | (F.col("before").isNotNull() & (back > on)), back).otherwise(on)
    both = elements.select(F.struct(*_E).alias("e"), link.alias("l")).groupBy("l.x", "l.y").agg(F.collect_list("e").alias("es"))  # one or two
    first = F.when(F.element_at("es", 1)["tail"] == F.col("x"), 1).otherwise(2)
    pair = both.filter("size(es) = 2").select(F.element_at("es", first).alias("left"), F.element_at("es", 3 - first).alias("right"))
    return pair.unionByName(both.filter("size(es) = 1").select(F.element_at("es", 1).alias("left"), F.lit(None).cast(pair.schema["right"].dataType).alias("right")))


def ranked(arcs: DataFrame, n: int, rest: int = 20_000) -> DataFrame:
    """arc and, for each weight, its sum over all arcs before this one."""
    spark = arcs.sparkSession
    ddl = "head long, tail long, before long, after long, up long, last boolean, " + ", ".join([f"{c} long" for c in _W] + [f"{c}_sum long" for c in _W])
    runs = materialize(arcs.repartitionByRange(n, "head").mapInArrow(_joined, ddl), "trie-runs")
    elements = runs.filter("last").select(F.col("up").alias("head"), "tail", "before", "after", *[F.col(f"{c}_sum").alias(c) for c in _W])
    rounds = []
    while elements.count() > rest:
        pairs = materialize(_paired(elements, len(rounds)), "trie-pairs")
        rounds.append(pairs)
        to = F.coalesce("right", "left")
        elements = pairs.select("left.head", to["tail"].alias("tail"), "left.before", to["after"].alias("after"), *[(F.col("left")[c] + F.coalesce(F.col("right")[c], F.lit(0))).alias(c) for c in _W])
    left = {r["head"]: r for r in elements.collect()}  # at most `rest`
    places, at, sums = [], next((h for h, r in left.items() if r["before"] is None), None), [0] * len(_W)
    while at is not None:
        places.append((at, *sums))
        at, sums = left[at]["after"], [s + left[at][c] for s, c in zip(sums, _W, strict=True)]
    known = spark.createDataFrame(places, "head long, " + ", ".join(f"{c} long" for c in _W))
    for pairs in reversed(rounds):
        j = pairs.select("left", "right", F.col("left.head").alias("head")).join(known, "head")
        right = F.when(F.col("right").isNotNull(), F.struct(F.col("right.head").alias("head"), *[(F.col(c) + F.col("left")[c]).alias(c) for c in _W]))
        known = j.select(F.explode(F.array_compact(F.array(F.struct("head", *_W), right))).alias("k")).select("k.*")
    j = runs.join(known.select(F.col("head").alias("up"), *[F.col(c).alias(f"{c}_up") for c in _W]), "up")
    return j.select(F.col("head").alias("arc"), *[(F.col(c) + F.col(f"{c}_up")).alias(c) for c in _W])


def prefix_trie(conversations: DataFrame, every: int = 100, kinds: int = 6, rest: int = 20_000) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, enter, leave of every node."""
    n = parts_for(conversations.count(), conversations.sparkSession)
    convs, turns = rebuilt(numbered(conversations, n), every, kinds)
    nodes = nodes_of(convs, turns, n)
    known = materialize(related(nodes, n), "trie-related")
    places = ranked(tour(known), n, rest)
    # what lies between a node's arcs is its subtree
    spans = places.groupBy(F.shiftright("arc", 1).alias("id")).agg(
        *[(F.max(c) - F.min(c)).alias(name) for c, name in (("w_leaves", "n_leaves"), ("w_saved", "saved_tokens"))], F.min("w_arcs").alias("enter"), F.max("w_arcs").alias("leave")
    )
    out = nodes.join(known.select("id", "n_children"), "id").join(spans, "id")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "enter", "leave")
