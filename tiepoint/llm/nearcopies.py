"""Near copies: fingerprints two bits apart, and shingle sets of a Jaccard similarity of 0.8 or more.

Similar sets are found by prefixes. All sets are put in one order of shingles, frequent
ones last; two sets of similarity 0.8 share a shingle among the first n - ceil(0.8 n) + 1
of each, so no pair is missed, whatever the order is. The order is taken from a sample
of the texts and only decides how many pairs meet. A pair matters where it meets first in
that order: there, what follows in either set must be enough for the similarity. So sets
of a common passage and a tenth of text of their own do not meet at the passage.

Where many sets meet at a shingle, each is compared with one of them that leads, first
with the one that has least of its own before the shingle. What that connects is compared
no more. As long as pairs of unconnected sets are many and each round makes them clearly
fewer, others lead; then the rest is compared pair by pair. A pair is first compared
by bitmaps, in which a bit is the parity of the shingles that fall on it: the bits that
differ are at most the shingles that differ. What passes is confirmed on the complete sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiepoint.llm.common import bound_batches, connected_components, materialise, release
from tiepoint.llm.simhash import fingerprint_from, links, shingle_hashes

#: One text in so many is counted for the order, and so many shingles at most are put last.
SAMPLE, FREQUENT = 32, 200_000
#: Up to so many ids are sent to all tasks, so that no text is shuffled to meet them.
FEW = 200_000
#: Pairs for each entry of a shingle, up to which all are compared.
PAIRS = 1.0
#: A round is clearly worth another if it leaves this part of the pairs at most.
FEWER = 0.5


def _order(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that stand in several sampled texts, sorted, with their number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                found = np.unique(np.array(shingle_hashes(t.as_py() or b"", shingle), np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found)], ["h"])

    part = texts.where(F.pmod("same", F.lit(SAMPLE)) == 0).select("text").mapInArrow(run, "h long")
    top = part.groupBy("h").count().where("count > 1").orderBy(F.desc("count"), "h").limit(FREQUENT).toPandas()
    h, n = top["h"].to_numpy(np.int64).view(np.uint64), top["count"].to_numpy(np.int64)
    at = np.argsort(h)
    return h[at], n[at]


def _bitmap(h: np.ndarray) -> bytes:
    """One bit for each remainder of the hashes, at least as many as hashes: set where an odd number of them has it."""
    m = max(64, 1 << max(len(h) - 1, 0).bit_length())
    return np.packbits(np.bincount((h % np.uint64(m)).astype(np.int64), minlength=m) % 2 == 1).tobytes()


def _differ(x: bytes, y: bytes) -> int:
    """Bits in which two bitmaps differ, the longer one folded to the shorter one's length."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    m = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(v.reshape(-1, m), axis=0) for v in (a, b))
    return int(np.bitwise_count(a ^ b).sum())


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, na, nb, x, y = batch.columns
        keep = [9 * _differ(p.as_py(), q.as_py()) <= i.as_py() + j.as_py() for i, j, p, q in zip(na, nb, x, y, strict=True)]
        yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _signatures(texts: DataFrame, shingle: int) -> DataFrame:
    """``same, fp, n, prefix, bits``: hash of the text, fingerprint, size of the shingle set, its prefix and its bitmap."""
    frequent, count = _order(texts, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sizes, prefixes, bits = [], [], [], []
            for t in batch.column(1):
                hashes = shingle_hashes(t.as_py() or b"", shingle)
                fps.append(fingerprint_from(hashes))
                h = np.unique(np.array(hashes, np.uint64))
                weight = np.zeros(len(h), np.int64)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
                    weight = np.where(frequent[at] == h, count[at], 0)
                sizes.append(len(h))
                bits.append(_bitmap(h))
                prefixes.append(h[np.lexsort((h, weight))][: len(h) - (4 * len(h) + 4) // 5 + 1].view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in prefixes])]).astype(np.int32)
            values = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
            cols = [batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["same", "fp", "n", "prefix", "bits"])

    return texts.select("same", "text").mapInArrow(run, "same long, fp long, n int, prefix array<long>, bits binary")


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, t in zip(batch.column(0), batch.column(1), strict=True):
                found = np.unique(np.array(shingle_hashes(t.as_py() or b"", shingle), np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([node.as_py()], pa.int64()), pa.array([found], pa.list_(pa.int64()))], ["node", "s"])

    return texts.mapInArrow(run, "node long, s array<long>")


def _confirmed(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """The pairs ``a, b`` whose sets have a similarity of 0.8 or more."""
    maps = {x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}")) for x in "ab"}
    met = pairs.join(maps["a"], "a").join(maps["b"], "b").select("a", "b", "na", "nb", "bitsa", "bitsb")
    pairs = materialise(met.mapInArrow(_possible, "a long, b long"))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = materialise(wanted.join(nodes.select("node", "same"), "node"))
    few = wanted.count() <= FEW
    found = texts.join(F.broadcast(wanted) if few else wanted, "same").select("node", "text")
    sets = materialise(_sets(found, shingle).dropDuplicates(["node"]))
    release(sets.sparkSession)
    left, right = (sets.select(F.col("node").alias(x), F.col("s").alias(f"s{x}")) for x in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").where(9 * both >= 4 * (F.size("sa") + F.size("sb"))).select("a", "b")


def _enough(x: str, y: str, left_x: str, left_y: str) -> Column:
    """Whether two sets can be similar that meet first where so much is left of them."""
    return 9 * F.least(left_x, left_y) >= 4 * (F.col(x) + F.col(y))


def _led(meet: DataFrame, turn: int) -> DataFrame:
    """``a, b``: every set with the one that leads at a shingle, where the two can be similar."""
    chance = F.xxhash64("h", "node", F.lit(turn))
    first = F.struct((-F.col("left") / F.col("n") if turn == 0 else F.lit(0.0)).alias("own"), chance.alias("x"), "node", "n", "left", "root")
    leaders = meet.groupBy("h").agg(F.min(first).alias("m")).select("h", F.col("m.node").alias("leader"), F.col("m.n").alias("leader_n"), F.col("m.left").alias("leader_left"), F.col("m.root").alias("leader_root"))
    met = meet.join(leaders, "h").where("root <> leader_root").where(_enough("n", "leader_n", "left", "leader_left"))
    return met.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()


def groups(docs: DataFrame, text_col: str = "text", shingle: int = 5) -> DataFrame:
    """``same, root``: the group of every different text, by ``text_hash``.

    Groups are connected over fingerprints at most two bits apart and shingle sets of a
    Jaccard similarity of 0.8 or more. ``docs`` is read several times.
    """
    bound_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    texts = docs.select(text_hash(text).alias("same"), F.coalesce(text, F.lit("")).cast("binary").alias("text"))
    # a different text is a node with a small number
    nodes = materialise(_signatures(texts, shingle).dropDuplicates(["same"]).withColumn("node", F.monotonically_increasing_id()))
    by_fp = materialise(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    equal = nodes.select("fp", "node").join(by_fp, "fp").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    first = {x: by_fp.select(F.col("fp").alias(x), F.col("first").alias(f"n{x}")) for x in "ab"}
    close = links(by_fp.select("fp")).join(first["a"], "a").join(first["b"], "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    found = materialise(equal.unionByName(close))
    del equal, close, first, by_fp
    release(found.sparkSession)

    # what is left of the set at a shingle: it and all that follows it in the order
    two = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR((F.col("n") - F.col("at")).cast("long"))
    entries = nodes.select(F.posexplode("prefix").alias("at", "h"), "node", "n").select("h", "node", two.alias("x"))
    shared = materialise(entries.groupBy("h").count().where("count > 1").select("h"))
    open_ = materialise(entries.join(shared, "h").select("h", "node", F.shiftright("x", 32).cast("int").alias("n"), F.col("x").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("left")))
    del entries, shared
    release(found.sparkSession)
    turn, before = 0, 0
    while True:
        # of what meets at a shingle, different groups only
        roots = materialise(connected_components(found))
        named = open_.join(roots, "node", "left").select("h", "node", "n", "left", F.coalesce("root", "node").alias("root"))
        sizes = named.groupBy("h", "root").agg(F.count("*").alias("k")).groupBy("h").agg(F.sum("k").alias("all"), F.sum(F.col("k") * F.col("k")).alias("within"), F.count("*").alias("groups"))
        mixed = materialise(sizes.where("groups > 1").select("h", "all", ((F.col("all") * F.col("all") - F.col("within")) / 2).alias("pairs")))
        size = mixed.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("all"), F.lit(0)).alias("rows")).first()
        if turn and (size["pairs"] <= PAIRS * size["rows"] or size["pairs"] > FEWER * before):
            break
        before = size["pairs"]
        met = named.join(mixed.select("h"), "h", "left_semi")
        new = _confirmed(_led(met, turn), nodes, texts, shingle)
        found = materialise(found.unionByName(new).distinct())
        del named, sizes, mixed, met, new
        release(found.sparkSession)
        turn += 1
    open_ = materialise(named.join(mixed.select("h"), "h", "left_semi"))
    x, y = (open_.select("h", F.col("node").alias(e), F.col("n").alias(f"n{e}"), F.col("left").alias(f"left{e}"), F.col("root").alias(f"r{e}")) for e in "ab")
    rest = x.join(y, "h").where("ra < rb").where(_enough("na", "nb", "lefta", "leftb")).select("a", "b").distinct()
    found = materialise(found.unionByName(_confirmed(rest, nodes, texts, shingle)))
    del x, y, rest, open_, named, sizes, mixed
    release(found.sparkSession)
    roots = connected_components(found)
    return nodes.select("same", "node").join(roots, "node", "left").select("same", F.coalesce("root", "node").alias("root"))


def text_hash(text: Column) -> Column:
    """By which texts are the same; a null one is like an empty one."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))
