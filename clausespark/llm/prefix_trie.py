"""Prefix trie of conversations with subtree totals by centroid decomposition.

A node is a distinct sequence of turns that some conversations begin with. It is named by the smallest of them
and the number of turns. Conversations that share a sequence share the running XOR of two 64-bit hashes of
(place, role, text) per turn, so nodes come from one aggregate over turns, and no conversation, however long,
is gathered: places and running values are computed per range partition and raised by the totals before.

Subtree totals (``subtree_totals``) follow the centroid decomposition of the parent-edge forest. The centroid of
a component is its node with the smallest subtree that still has over half of the nodes; the nodes with over
half are exactly its path to the component's top. A round finds the centroid of every component, adds up the
values of what hangs below it, adds that total to every node of the path, takes the total out of the sizes
along the path, and removes the centroid; its children head components of their own. As components at least
halve, a forest of any depth or fan-out takes logarithmically many rounds. Components of over ``SMALL`` nodes
go through rounds of joins and aggregates, the rest are finished in one task each by the same steps in numpy.
Which component a node falls into is read off the path of its naming conversation by one equi-join.

Defined cases: a null conv_id takes no part; null turns come first, turns of one number are put in order by
role, then text; null role or text is empty; repeated rows are turns of their own; a conversation whose
own turns are all replaced by none ends at the root; the remainder of a negative conv_id is negative, so the
family of 0 reaches to both sides; an empty table gives an empty result. Other columns are
not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausespark.llm.common import join_counted, ordered_positions
from clausespark.session import Scratch, cut_lineage, ship_package

#: Turns that a conversation may take over from the first one of its hundred.
SHARED_TURNS = 5
FAMILY = 100
#: Most nodes of a component that one task decomposes by itself.
SMALL = 1 << 13
#: Nodes of small components that are decomposed together, as arrays.
TOGETHER = 1 << 16
#: Conversation numbers per piece of a long list that is hashed.
PIECE = 512


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, idx, n, h1, h2, chars): the ``n`` turns of each conversation numbered from 1; hashes of role and text, code points of the text."""
    filled = {c: F.coalesce(c, F.lit("")) for c in ("role", "text")}
    t = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *[c.alias(n) for n, c in filled.items()])
    hashes = {f"h{k}": F.xxhash64(F.lit(k), "role", "text") for k in (1, 2)}
    t = t.withColumns(hashes | {"chars": F.char_length("text").cast("long")})
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    t = ordered_positions(t, order, pos="pos", carry=["conv_id", "h1", "h2", "chars"])
    first = t.groupBy("conv_id").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"), F.count(F.lit(1)).alias("rows"))
    t = join_counted(t, first, "conv_id", "rows", ["pos"])
    return t.select("conv_id", (F.col("pos") - F.col("first") + 1).alias("idx"), "n", "h1", "h2", "chars")


def taken_over(conv: Column) -> Column:
    """How many turns a conversation takes over: crc32 of its decimal number modulo 6."""
    return F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(SHARED_TURNS + 1))


def rebuilt_turns(own: DataFrame) -> DataFrame:
    """(conv_id, depth, h1, h2, chars) of the rebuilt conversations, and a row of depth 0 for each."""
    convs = own.groupBy("conv_id").agg(F.max("n").alias("n"))
    convs = convs.withColumn("h", taken_over(F.col("conv_id"))).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    begin = own.filter(F.col("idx") <= SHARED_TURNS)
    first = F.array_sort(F.collect_list(F.struct("idx", "h1", "h2", "chars")))  # SHARED_TURNS at most
    heads = begin.groupBy(F.col("conv_id").alias("base")).agg(first.alias("first"))
    convs = convs.join(heads, "base", "left").select("conv_id", "n", "h", F.coalesce(F.slice("first", 1, F.col("h")), F.array()).alias("head"))
    convs = cut_lineage(convs)
    taken = convs.select("conv_id", F.explode("head").alias("t")).select("conv_id", F.col("t.idx").alias("depth"), "t.h1", "t.h2", "t.chars")
    info = convs.select("conv_id", "n", "h", F.size("head").alias("begin"))
    rest = join_counted(own.drop("n"), info, "conv_id", "n", ["idx"]).filter(F.col("idx") > F.col("h"))
    rest = rest.select("conv_id", (F.col("idx") - F.col("h") + F.col("begin")).alias("depth"), "h1", "h2", "chars")
    tops = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(c) for c in ("h1", "h2", "chars")])
    return taken.union(rest).union(tops)


def prefix_hashes(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, x1, x2, chars): the running XOR of the turns' hashes within each conversation.

    Running values inside a range partition are raised by those of the earlier partitions that the
    conversation spans, of which there is one row each.
    """
    mixed = {f"v{k}": F.when(F.col("depth") > 0, F.xxhash64(F.lit(k), "depth", f"h{k}")).otherwise(F.lit(0).cast("long")) for k in (1, 2)}
    t = rows.select("conv_id", "depth", "chars", *[c.alias(n) for n, c in mixed.items()]).orderBy("conv_id", "depth")
    t = cut_lineage(t.withColumn("part", F.spark_partition_id()))
    here = Window.partitionBy("part", "conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = t.groupBy("conv_id", "part").agg(*[F.bit_xor(f"v{k}").alias(f"s{k}") for k in (1, 2)], F.min("depth").alias("from"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition of a conversation
    spans = spans.withColumns({f"c{k}": F.coalesce(F.bit_xor(f"s{k}").over(before), F.lit(0)) for k in (1, 2)}).filter(F.col("from") > 0)
    t = t.withColumns({f"x{k}": F.bit_xor(f"v{k}").over(here) for k in (1, 2)})
    t = t.join(spans.select("conv_id", "part", "c1", "c2"), ["part", "conv_id"], "left")
    return t.select("conv_id", "depth", "chars", *[F.col(f"x{k}").bitwiseXOR(F.coalesce(f"c{k}", F.lit(0))).alias(f"x{k}") for k in (1, 2)])


def paths(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, rep, parent_rep): the node at every depth of every conversation, and (rep, depth, n_convs, chars) of the nodes."""
    t = cut_lineage(prefix_hashes(rows).withColumn("node", F.concat_ws(":", "depth", F.hex("x1"), F.hex("x2"))))
    nodes = cut_lineage(t.groupBy("node", "depth").agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n_convs"), F.first("chars").alias("chars")))
    named = cut_lineage(join_counted(t.select("conv_id", "depth", "node"), nodes.select("node", "n_convs", "rep"), "node", "n_convs", ["conv_id", "depth"]).select("conv_id", "depth", "rep"))
    above = named.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("rep").alias("parent_rep"))
    return named.join(above, ["conv_id", "depth"], "left"), nodes.select("rep", "depth", "n_convs", "chars")


def subtree_sizes(path: DataFrame) -> DataFrame:
    """(rep, depth, size) from the paths: a node has below it the deeper nodes that the conversations through it name."""
    own = F.col("rep") == F.col("conv_id")  # from some depth on, as those who share a prefix only get fewer
    convs = path.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("last"), F.min(F.when(own, F.col("depth"))).alias("from"))
    t = join_counted(path.select("conv_id", "depth", "rep"), convs.filter("from IS NOT NULL"), "conv_id", "n", ["depth"])
    return t.groupBy("rep", "depth").agg(F.sum(F.coalesce(F.col("last") - F.greatest("depth", "from") + 1, F.lit(0))).alias("size"))


def subtree_totals(nodes: DataFrame, path: DataFrame, values: list[str], small: int = SMALL) -> DataFrame:
    """(rep, depth, and the total of each value over the node's subtree, itself included).

    ``nodes`` holds (rep, depth, parent_rep, size, values), ``size`` the nodes of the subtree; ``path``
    the (conv_id, depth, rep) at every depth of the conversations that name nodes.
    """
    totals = [f"total_{v}" for v in values]
    zero = {t: F.lit(0).cast("long") for t in totals}
    live = nodes.select("rep", "depth", "parent_rep", "size", *values).withColumns(zero).withColumn("label", F.lit("0"))
    live = cut_lineage(live)
    done, ready = [], []
    while True:
        n = live.groupBy("label").agg(F.max("size").alias("n"), F.count(F.lit(1)).alias("rows"))
        ready.append(live.join(n.filter(F.col("n") <= small).select("label"), "label", "left_semi"))
        large = cut_lineage(n.filter(F.col("n") > small))  # at most one row per ``small`` nodes
        if large.isEmpty():
            break
        t = join_counted(live, large, "label", "rows", ["rep", "depth"]).filter("n IS NOT NULL")
        t = cut_lineage(t.withColumn("chain", F.col("size") * 2 > F.col("n")))
        cut = t.filter("chain").groupBy("label").agg(F.min(F.struct("size", "rep", "depth")).alias("c"))
        cut = cut.join(large.select("label", "rows"), "label").select("label", "rows", F.col("c.rep").alias("c_rep"), F.col("c.depth").alias("c_depth"), F.col("c.size").alias("c_size"))
        t = join_counted(t, cut, "label", "rows", ["rep", "depth"])
        at = path.select(F.col("conv_id").alias("rep"), (F.col("depth") - 1).alias("c_depth"), F.col("rep").alias("x_rep"), F.col("parent_rep").alias("x_parent"))
        deep = F.col("depth") > F.col("c_depth")
        asked = t.filter(deep).groupBy("rep", "c_depth").agg(F.count(F.lit(1)).alias("__n")).join(at, ["rep", "c_depth"])
        place = F.concat_ws(":", F.col("rep").cast("string"), F.col("c_depth").cast("string"))
        t = t.withColumn("at", F.when(deep, place))
        t = join_counted(t, asked.select(place.alias("at"), "__n", "x_rep", "x_parent"), "at", "__n", ["depth"])
        t = t.withColumns({"below": F.coalesce(F.col("x_parent") == F.col("c_rep"), F.lit(False)), "is_cut": (F.col("rep") == F.col("c_rep")) & (F.col("depth") == F.col("c_depth"))})
        t = cut_lineage(t)
        hang = F.col("below") | F.col("is_cut")
        sums = t.groupBy("label").agg(F.count(F.lit(1)).alias("__r"), *[F.sum(F.when(hang, F.col(v)).otherwise(0)).alias(f"__t_{v}") for v in values])
        t = join_counted(t, sums, "label", "__r", ["rep", "depth"])
        t = t.withColumns({f"total_{v}": F.col(f"total_{v}") + F.when(F.col("chain"), F.col(f"__t_{v}")).otherwise(0) for v in values})
        t = t.withColumns({
            "size": F.col("size") - F.when(F.col("chain") & ~F.col("is_cut"), F.col("c_size")).otherwise(0),
            "label": F.when(F.col("below"), F.concat_ws(":", F.col("x_rep").cast("string"), (F.col("c_depth") + 1).cast("string"))).otherwise(F.col("label")),
        })
        t = cut_lineage(t.select("rep", "depth", "parent_rep", "size", *values, *totals, "label", "is_cut"))
        done.append(t.filter("is_cut").select("rep", "depth", *totals))
        live = t.filter(~F.col("is_cut")).drop("is_cut")
    out = _finish(ready, values, totals)
    for d in done:
        out = out.union(d)
    return out.select("rep", "depth", *[F.col(f"total_{v}").alias(v) for v in values])


def decompose(parent: np.ndarray, size: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Subtree totals of a forest held as arrays: ``parent`` is the place of the parent, or -1; ``size`` the nodes below and itself.

    All components are decomposed at once, one centroid each per round.
    """
    n = len(parent)
    size, total, gone = size.copy(), np.zeros_like(values), np.zeros(n, dtype=bool)
    up = np.where(parent < 0, np.arange(n), parent)
    while not gone.all():
        top = np.where(gone | gone[up], np.arange(n), up)  # to the nearest top, by jumps that double
        while not np.array_equal(jump := top[top], top):
            top = jump
        live = np.flatnonzero(~gone)
        chain = live[2 * size[live] > size[top[live]]]
        order = chain[np.lexsort((size[chain], top[chain]))]
        cut = order[np.r_[True, top[order[1:]] != top[order[:-1]]]]  # the smallest of each chain
        below = np.zeros(n, dtype=np.int64)  # under a centroid: its place + 1
        gone[cut] = True
        centroid = np.full(n, -1)
        centroid[top[cut]] = cut
        under = np.where(gone | gone[up], np.arange(n), up)
        while not np.array_equal(jump := under[under], under):
            under = jump
        head = up[under]
        hang = (head != under) & gone[head] & (head == centroid[top])
        below[hang] = head[hang] + 1
        below[cut] = cut + 1
        sums = np.zeros((n + 1, values.shape[1]), dtype=values.dtype)
        mine = live[below[live] > 0]
        np.add.at(sums, below[mine], values[mine])
        total[chain] += sums[centroid[top[chain]] + 1]
        rest = chain[~gone[chain]]
        size[rest] -= size[centroid[top[rest]]]
    return total


def _finish(ready: list[DataFrame], values: list[str], totals: list[str]) -> DataFrame:
    """The totals of small components, whole components at a time."""
    t = ready[0]
    for r in ready[1:]:
        t = t.union(r)
    ship_package(t.sparkSession)

    def solve(f: pd.DataFrame) -> pd.DataFrame:
        keys = f[["rep", "depth"]].assign(place=np.arange(len(f)))
        ends = f[["parent_rep", "depth"]].rename(columns={"parent_rep": "rep"}).assign(depth=f["depth"] - 1)
        parent = ends.merge(keys, how="left", on=["rep", "depth"])["place"].fillna(-1).to_numpy(dtype=np.int64)
        label = f["label"].to_numpy()
        parent[(parent >= 0) & (label[parent] != label)] = -1
        got = decompose(parent, f["size"].to_numpy(dtype=np.int64), f[values].to_numpy(dtype=np.int64))
        out = f[["rep", "depth"]].copy()
        for k, name in enumerate(totals):
            out[name] = f[name].to_numpy() + got[:, k]
        return out

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0
        for f in frames:
            if not len(f):
                continue
            held.append(f)
            rows += len(f)
            if rows < TOGETHER:
                continue
            f = pd.concat(held, ignore_index=True)
            last = f["label"] == f["label"].iloc[-1]  # may go on in the next batch
            if not last.all():
                yield solve(f[~last].reset_index(drop=True))
            held, rows = [f[last]], int(last.sum())
        if held:
            yield solve(pd.concat(held, ignore_index=True))

    columns = ", ".join(["rep long", "depth long", *[f"{c} long" for c in totals]])
    t = t.select("label", "rep", "depth", "parent_rep", "size", *values, *totals)
    return t.repartition("label").sortWithinPartitions("label").mapInPandas(read, columns)


def end_hashes(ends: DataFrame) -> DataFrame:
    """(rep, depth, ends_sha256): SHA-256 of the ascending, comma-joined conv_ids of (rep, depth, conv_id).

    The list of a node is joined in pieces; a list of one piece is hashed in place, the pieces of a longer one
    are streamed through the hash in order, as SHA-256 can only be computed front to back.
    """
    ship_package(ends.sparkSession)
    t = ordered_positions(ends.select("rep", "depth", "conv_id"), [F.col("rep"), F.col("depth"), F.col("conv_id")], pos="pos")
    t = t.withColumn("piece", F.floor(F.col("pos") / PIECE))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    t = cut_lineage(t.groupBy("rep", "depth", "piece").agg(ids.alias("ids")))
    n = t.groupBy("rep", "depth").agg(F.count(F.lit(1)).alias("n"))
    long = cut_lineage(n.filter("n > 1").select("rep", "depth"))
    short = t.join(n.filter("n = 1").select("rep", "depth"), ["rep", "depth"], "left_semi").select("rep", "depth", F.sha2(F.col("ids"), 256).alias("ends_sha256"))
    pieces = t.join(long, ["rep", "depth"], "left_semi").repartition("rep", "depth").sortWithinPartitions("rep", "depth", "piece")

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        out = lambda: pd.DataFrame({"rep": [at[0]], "depth": [at[1]], "ends_sha256": [state.hexdigest()]})
        for f in frames:
            for rep, depth, text in zip(f["rep"], f["depth"], f["ids"]):
                if at != (rep, depth):
                    if at is not None:
                        yield out()
                    at, state = (rep, depth), hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
        if at is not None:
            yield out()

    return short.union(pieces.mapInPandas(digest, "rep long, depth long, ends_sha256 string"))


def prefix_trie(conversations: DataFrame, small: int = SMALL) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    with Scratch(conversations.sparkSession) as scratch:
        path, nodes = paths(rebuilt_turns(cut_lineage(turns(conversations))))
        path = cut_lineage(path)
        named = path.filter(F.col("rep") == F.col("conv_id")).select("rep", "depth", "parent_rep")
        children = named.filter("depth > 0").groupBy(F.col("parent_rep").alias("rep"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
        t = nodes.join(named, ["rep", "depth"]).join(children, ["rep", "depth"], "left").join(subtree_sizes(path), ["rep", "depth"])
        t = t.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
        t = t.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("chars")})
        t = cut_lineage(t)
        totals = subtree_totals(t, path, ["leaf", "saved"], small)
        last = path.groupBy("conv_id").agg(F.max(F.struct("depth", "rep")).alias("e")).select("e.rep", "e.depth", "conv_id")
        t = t.drop("leaf", "saved").join(totals, ["rep", "depth"]).join(end_hashes(last), ["rep", "depth"], "left")
        none = F.sha2(F.lit(""), 256)
        return scratch.keep(t.select(
            F.col("rep").alias("conv_id"), "depth", F.col("parent_rep").alias("parent_conv_id"), "n_convs", "n_children",
            F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"),
        ))
