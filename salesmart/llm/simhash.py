"""SimHash fingerprints and an exact near-duplicate self-join by traversing a binary trie in node pairs."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import components, materialise, text_or_empty

#: Bits of the six blocks a fingerprint is cut into. At most three differing bits leave three blocks equal.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Leading bits on which candidates agree once the equal blocks are moved to the front.
ROOT_BITS = 31
#: Fingerprints that one traversal holds; the subtree of a larger node is split over further tasks.
NODE_ROWS = 4096


def fingerprint(text: str, words: int = 3) -> int:
    """64-bit SimHash of the word shingles of ``text`` as a signed integer; 0 where there is no word.

    Only A-Z are lower-cased, words are runs without ASCII white space, repeats count, and a text of
    fewer words is one shingle. A bit is set if it is set in over half of the shingles' XXH64 (seed 42).
    """
    found = text.encode("utf-8").lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    if len(found) <= words:
        hashes = [xxhash.xxh64_intdigest(line, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], 42) for a, b in zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist())]
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    chosen = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(chosen, bitorder="little").view("<i8")[0])


def simhash(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; a null text counts as empty."""

    @F.pandas_udf("long")
    def prints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([fingerprint(t) for t in batch], dtype="int64")

    return docs.select("doc_id", prints(text_or_empty()).alias("fp"))


def _front(equal: tuple[int, ...]) -> F.Column:
    """The fingerprint with the chosen blocks moved to its front, as a signed long."""
    ends = np.cumsum(BLOCKS).tolist()
    out, left = F.lit(0).cast("long"), 64
    for i in [*equal, *(i for i in range(len(BLOCKS)) if i not in equal)]:
        block = F.shiftrightunsigned("fp", 64 - ends[i]).bitwiseAND(F.lit((1 << BLOCKS[i]) - 1))
        left -= BLOCKS[i]
        out = out.bitwiseOR(F.shiftleft(block, left))
    return out


def _pairs(v: np.ndarray, pairs: np.ndarray, bit: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Walk node pairs down the trie over the sorted values ``v`` from ``bit`` on.

    ``pairs`` has columns lo1, hi1, lo2, hi2 (row ranges of two nodes) and the differing bits so far; a
    pair with the same node twice stands for its self-join. Pairs over the budget are pruned.
    """
    for b in range(bit, -1, -1):
        ones = np.concatenate(([0], np.cumsum((v >> np.uint64(b)) & np.uint64(1)))).astype(np.int32)
        lo1, hi1, lo2, hi2, acc = pairs.T
        m1 = hi1 - (ones[hi1] - ones[lo1])
        m2 = hi2 - (ones[hi2] - ones[lo2])
        same = lo1 == lo2
        other = ~same
        parts = [
            np.stack((lo1, m1, lo2, m2, acc), 1),
            np.stack((m1, hi1, m2, hi2, acc), 1),
            np.stack((lo1, m1, m2, hi2, acc + 1), 1),
            np.stack((m1, hi1, lo2, m2, acc + 1), 1)[other],
        ]
        pairs = np.concatenate(parts)
        n1, n2 = pairs[:, 1] - pairs[:, 0], pairs[:, 3] - pairs[:, 2]
        alive = (n1 > 0) & (n2 > 0) & (pairs[:, 4] <= budget) & ((pairs[:, 0] != pairs[:, 2]) | (n1 > 1))
        pairs = pairs[alive]
        if not len(pairs):
            break
    return pairs[:, 0], pairs[:, 2]


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable row of each row under the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _walk_cells(bit: int, budget: int):
    """Join the cells of a partition sorted by (cell, side, v); too large cells are handed back.

    Cells of split nodes are named by a hash; so that a chance hash links nothing, what the walk finds is
    compared in all its bits, and links only within one choice of equal blocks. ``acc`` holds the choice
    above its lowest four bits.
    """

    def walk(v, rep, side, acc, cell) -> pd.DataFrame:
        perm, acc = acc >> 4, acc & 15
        starts = np.flatnonzero(np.concatenate(([True], (cell[1:] != cell[:-1]) | (side[1:] != side[:-1]))))
        ends = np.concatenate((starts[1:], [len(v)]))
        second = np.concatenate(([False], cell[starts[1:]] == cell[starts[:-1]]))
        first = ~second
        paired = np.concatenate((second[1:], [False]))
        alone = first & ~paired & (ends - starts > 1) & (side[starts] == 0)
        two = first & paired
        nxt = np.flatnonzero(two) + 1
        pairs = np.concatenate([
            np.stack((starts[alone], ends[alone], starts[alone], ends[alone], acc[starts[alone]]), 1),
            np.stack((starts[two], ends[two], starts[nxt], ends[nxt], acc[starts[two]]), 1),
        ]).astype(np.int32)
        if not len(pairs):
            return pd.DataFrame({"a": [], "b": []})
        i, j = _pairs(v, pairs, bit, budget)
        true = (perm[i] == perm[j]) & (np.bitwise_count(v[i] ^ v[j]) <= budget)
        i, j = i[true], j[true]
        _, rows = np.unique(rep, return_inverse=True)
        ids = np.unique(rep)
        root = _forest(len(ids), rows[i], rows[j])
        linked = root != np.arange(len(ids))
        return pd.DataFrame({"a": ids[linked], "b": ids[root[linked]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def edges(x: pd.DataFrame) -> pd.DataFrame:
            e = walk(x["v"].to_numpy().view(np.uint64), x["rep"].to_numpy(), x["side"].to_numpy(), x["acc"].to_numpy(), x["cell"].to_numpy())
            return e.assign(cell=None, v=None, side=None, acc=None).astype({"a": "Int64", "b": "Int64"})

        def deferred(x: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"a": None, "b": x["rep"], "cell": x["cell"], "v": x["v"], "side": x["side"], "acc": x["acc"]})

        held, hot = pd.DataFrame(), None
        columns = ["a", "b", "cell", "v", "side", "acc"]
        for x in batches:
            x = pd.concat([held, x], ignore_index=True) if len(held) else x
            if hot is not None:
                mine = x["cell"] == hot
                if mine.any():
                    yield deferred(x[mine])[columns]
                x = x[~mine].reset_index(drop=True)
                hot = hot if not len(x) else None
            if not len(x):
                held = x
                continue
            cells = x["cell"].to_numpy()
            sizes = pd.Series(cells).map(pd.Series(cells).value_counts(sort=False)).to_numpy()
            last = cells == cells[-1]
            ready = ~last & (sizes <= NODE_ROWS)
            late = (sizes > NODE_ROWS)
            if ready.any():
                yield edges(x[ready])[columns]
            if late.any():
                yield deferred(x[late])[columns]
                hot = cells[-1] if late[-1] else None
            held = x[last & ~late].reset_index(drop=True)
        if len(held):
            yield edges(held)[columns]

    return run


def hamming_links(prints: DataFrame, budget: int = 3) -> DataFrame:
    """Links (a, b) that join all fingerprints within ``budget`` <= 3 differing bits.

    ``prints`` has distinct (fp, rep). Every fingerprint goes once under each choice of three equal
    blocks, so any two linked ones meet below one trie root of ``ROOT_BITS`` bits. A task walks all its
    tries at once and returns the edges of a spanning forest. A node with over ``NODE_ROWS`` rows is
    never joined in one task: its children are paired on the next eight bits (pruned by the budget)
    and its rows go to those pairs' tasks, again and again.
    """
    if budget > len(BLOCKS) - 3:
        raise ValueError("the block scheme covers at most three differing bits")
    spread = prints.select("rep", F.posexplode(F.array(*[_front(c) for c in combinations(range(len(BLOCKS)), 3)])).alias("perm", "v"))
    rows = spread.select(
        (F.col("perm").cast("long") * F.lit(1 << ROOT_BITS) + F.shiftrightunsigned("v", 64 - ROOT_BITS)).alias("cell"), "v", "rep", F.lit(0).alias("side"), (F.col("perm") * 16).alias("acc")
    )
    schema = "a long, b long, cell long, v long, side int, acc int"
    bit, found = 63 - ROOT_BITS, None
    while True:
        # rows of one cell meet in a task in unsigned order of v; flipping the sign bit gives that order
        order = F.col("v").bitwiseXOR(F.lit(-(1 << 63)))
        out = materialise(rows.repartition("cell").sortWithinPartitions("cell", "side", order).mapInPandas(_walk_cells(bit, budget), schema))
        edges = out.where("a is not null").select("a", "b")
        found = edges if found is None else found.union(edges)
        left = out.where("a is null").select("cell", "v", F.col("b").alias("rep"), "side", "acc")
        if left.isEmpty():
            return found.distinct()
        width = min(8, bit + 1)
        left = left.withColumn("digit", F.shiftrightunsigned("v", bit + 1 - width).bitwiseAND(F.lit((1 << width) - 1)))
        nodes = left.groupBy("cell", "side", "digit").agg(F.first("acc").alias("acc"))
        paired = left.where("side = 1").select("cell").distinct().withColumn("two", F.lit(True))
        nodes = materialise(nodes.join(paired, "cell", "left").withColumn("two", F.coalesce("two", F.lit(False))))
        x, y = nodes.alias("x"), nodes.alias("y")
        pairs = x.join(y, "cell").where(
            "x.side = 0 and (case when x.two then y.side = 1 else x.digit <= y.digit end)"
        ).select("cell", F.col("x.digit").alias("d1"), F.col("y.digit").alias("d2"), F.col("x.two").alias("two"),
                 (F.col("x.acc") + F.bit_count(F.col("x.digit").bitwiseXOR(F.col("y.digit")))).cast("int").alias("acc")).where(F.col("acc").bitwiseAND(15) <= budget)
        pairs = pairs.withColumn("next", F.xxhash64("cell", "d1", "d2"))
        one = pairs.select("cell", F.lit(0).alias("side"), F.col("d1").alias("digit"), "next", F.lit(0).alias("nside"), F.col("acc").alias("nacc"))
        two = pairs.where("two or d1 <> d2").select("cell", F.when(F.col("two"), 1).otherwise(0).alias("side"), F.col("d2").alias("digit"), "next", F.lit(1).alias("nside"), F.col("acc").alias("nacc"))
        rows = left.join(one.union(two), ["cell", "side", "digit"]).select(
            F.col("next").alias("cell"), "v", "rep", F.col("nside").alias("side"), F.col("nacc").alias("acc")
        )
        bit -= width
        if bit < 0:  # the cells now hold one value a side: each is a link
            last = rows.groupBy("cell").agg(F.max("rep").alias("a"), F.min("rep").alias("b"), F.bit_count(F.bit_xor("v")).alias("bits"))
            last = last.where((F.col("a") != F.col("b")) & (F.col("bits") <= budget)).select("a", "b")
            return found.union(last).distinct()


def near_duplicates(docs: DataFrame, budget: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links of at most ``budget`` differing bits.
    Equal fingerprints are joined once, as a class with its smallest doc_id, before any pair is formed.
    Texts without words have fingerprint zero and link like any other. Rows whose doc_id is null form
    no links through it and take the component of their fingerprint, if that has a doc_id, else null.
    Repeated rows come back each; an empty table gives none; other columns, of any name, are ignored. A very
    long text is hashed whole in one task, in memory of some 15 times its length.
    """
    prints = materialise(simhash(docs))
    classes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    links = hamming_links(classes.where("rep is not null"), budget)
    named = components(links)
    of_print = materialise(
        classes.join(named, classes["rep"] == named["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    )
    return prints.join(of_print, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
