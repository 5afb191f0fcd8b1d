"""Prefix trie of conversations by smallest-member ownership.

A node is a sequence of turns, by a 128-bit hash; a conversation passes through one
node for each of its prefixes. Each node is owned by its smallest member. What follows
a node that a conversation owns it owns too, so it owns a suffix of its path: one number
tells which. A subtree's tokens once per member, less its tokens once per node, are then
a sum over the members of the tokens on their paths that they do not own, and the
other figures of a node are sums over members as well. So one grouping by prefix, which
is summed before its shuffle, gives them all, however many members a node has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tiepoint.llm.common import WORD, bound_batches, materialise

#: Conversations of one base, and the remainders that tell how many turns are taken from it.
BASE, HEADS = 20, 4
#: Turns of a conversation that one task runs through.
CHUNK = 4096
#: Bytes of joined ids in a row on their way to the task that digests them.
PIECE = 1 << 20
NOTHING = hashlib.sha256(b"").hexdigest()


def _numbered(conversations: DataFrame) -> DataFrame:
    """``c, pos, t, u, tokens``: each turn's place in its conversation from 1, two hashes, and its words.

    Rows are dealt by ranges of conversation and turn, so that a conversation of any length
    is spread, and numbered in passing. A partition begins with at most one conversation
    that began before it; what is to be added there is one number for each partition.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"), role, text).where("c is not null")
    order = [F.col("c"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    tokens = F.regexp_count("text", F.lit(WORD)).cast("long").alias("tokens")
    turns = dealt.select("c", F.spark_partition_id().alias("part"), F.xxhash64("role", "text").alias("t"), F.xxhash64(F.lit("again"), "text", "role").alias("u"), tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, at = None, 0
        for batch in batches:
            places = []
            for c in batch.column(0).to_pylist():
                at = at + 1 if c == before else 1
                before = c
                places.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], [*batch.schema.names, "at"])

    numbered = materialise(turns.mapInArrow(run, "c long, part int, t long, u long, tokens long, at long"))
    sizes = numbered.groupBy("c", "part").agg(F.max("at").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # at most one row per partition
    starts = F.broadcast(sizes.withColumn("before", earlier).where("before > 0").select("c", "part", "before"))
    return numbered.join(starts, ["c", "part"], "left").select("c", (F.col("at") + F.coalesce("before", F.lit(0))).alias("pos"), "t", "u", "tokens")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rebuilt turns ``c, pos, t, u, tokens``, and all conversations ``c, n`` with their number of rebuilt turns."""
    turns = materialise(_numbered(conversations))
    heads = (F.crc32(F.col("c").cast("string").cast("binary")) % HEADS).alias("h")
    each = turns.groupBy("c").agg(F.max("pos").alias("own")).select("c", "own", (F.col("c") - F.col("c") % BASE).alias("base"), heads)
    bases = each.where("c = base").select("base", F.col("own").alias("base_n"))
    # of BASE conversations at most
    each = each.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    each = materialise(each.select("c", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")))
    first = turns.where((F.col("c") % BASE == 0) & (F.col("pos") < HEADS)).withColumnRenamed("c", "base")
    head = each.select("c", "base", "h").join(first, "base").where("pos <= h").select("c", "pos", "t", "u", "tokens")
    tail = turns.join(each.select("c", "h", "taken"), "c").where("pos > h").select("c", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "t", "u", "tokens")
    return head.unionAll(tail), each.select("c", "n")


def paths(turns: DataFrame, each: DataFrame) -> DataFrame:
    """``c, depth, k, l, kb, lb, before, tokens``: a row for each conversation and prefix, the empty one too.

    ``k, l`` name the node, ``kb, lb`` its parent, ``before`` are the tokens above it. Both run
    along chunks of a conversation; what is before a chunk is added to it.
    """
    mark = [F.xxhash64("pos", "t", "u").alias("x"), F.xxhash64("u", "pos", "t", F.lit("again")).alias("y")]
    rows = turns.select("c", "pos", F.floor((F.col("pos") - 1) / CHUNK).alias("chunk"), *mark, "tokens")
    along = Window.partitionBy("c", "chunk").orderBy("pos")
    rows = rows.select("c", "pos", "chunk", "x", "y", "tokens", *[f(e).over(along).alias(n) for n, f, e in (("k", F.bit_xor, "x"), ("l", F.bit_xor, "y"), ("upto", F.sum, "tokens"))])
    whole = turns.select("c", F.floor((F.col("pos") - 1) / CHUNK).alias("chunk"), *mark, "tokens").groupBy("c", "chunk").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sum("tokens").alias("tokens"))
    earlier = Window.partitionBy("c").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.select("c", "chunk", F.bit_xor("x").over(earlier).alias("ck"), F.bit_xor("y").over(earlier).alias("cl"), F.sum("tokens").over(earlier).alias("cu")).where("chunk > 0")
    none = F.lit(0).cast("long")
    rows = rows.join(carried, ["c", "chunk"], "left").withColumns({n: F.coalesce(n, none) for n in ("ck", "cl", "cu")})
    k, l = F.col("k").bitwiseXOR(F.col("ck")), F.col("l").bitwiseXOR(F.col("cl"))
    steps = rows.select("c", F.col("pos").alias("depth"), k.alias("k"), l.alias("l"), k.bitwiseXOR(F.col("x")).alias("kb"), l.bitwiseXOR(F.col("y")).alias("lb"), (F.col("upto") + F.col("cu") - F.col("tokens")).alias("before"), "tokens")
    top = each.select("c", none.alias("depth"), none.alias("k"), none.alias("l"), F.lit(None).cast("long").alias("kb"), F.lit(None).cast("long").alias("lb"), none.alias("before"), none.alias("tokens"))
    return steps.unionAll(top)


def _digests(ends: DataFrame) -> DataFrame:
    """``depth, k, l, ends``: SHA-256 of the ids that end at each node, in order, joined by commas.

    Rows are dealt by ranges of node and id. A node whose ids lie in one partition is
    digested there; of the first and last node of a partition joined ids go on in
    pieces, and the pieces of a node through one digest, which by its nature reads
    them one after the other, without holding them.
    """
    order = ["depth", "k", "l", "c"]
    dealt = materialise(ends).repartitionByRange(*order).sortWithinPartitions(*order).select(*order, F.spark_partition_id().alias("part"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("depth", pa.int64()), ("k", pa.int64()), ("l", pa.int64()), ("part", pa.int32()), ("nth", pa.int32()), ("ids", pa.binary()), ("ends", pa.string())])

        def rows() -> Iterator[tuple]:
            node, part, ids, size, nth, first = None, 0, [], 0, 0, True
            for batch in batches:
                for *key, c, part in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                    if key != node:
                        if ids:
                            joined = b",".join(ids)
                            alone = not first and not nth
                            yield (*node, part, nth, None if alone else joined, hashlib.sha256(joined).hexdigest() if alone else None)
                            first = False
                        node, ids, size, nth = key, [], 0, 0
                    ids.append(b"%d" % c)
                    size += len(ids[-1]) + 1
                    if size >= PIECE:
                        yield (*node, part, nth, b",".join(ids), None)
                        ids, size, nth = [], 0, nth + 1
            if ids:
                yield (*node, part, nth, b",".join(ids), None)

        held, size = [], 0
        for row in rows():
            held.append(row)
            size += 100 + len(row[5] or b"")
            if size >= 4 * PIECE:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*held, strict=True), kind, strict=True)], schema=kind)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*held, strict=True), kind, strict=True)], schema=kind)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["depth", "k", "l", "ends"]
        node, state, out = None, None, []
        for batch in batches:
            for *key, ids in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if key == node:
                    state.update(b",")
                else:
                    if node is not None:
                        out.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256()
                state.update(ids)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*out, strict=True)], names)
                out = []
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, state.hexdigest())], names)

    joined = materialise(dealt.mapInArrow(join, "depth long, k long, l long, part int, nth int, ids binary, ends string"))
    pieces = joined.where("ends is null").repartition("depth", "k", "l").sortWithinPartitions("depth", "k", "l", "part", "nth")
    spread = pieces.select("depth", "k", "l", "ids").mapInArrow(digest, "depth long, k long, l long, ends string")
    return joined.where("ends is not null").select("depth", "k", "l", "ends").unionAll(spread)


def nodes(conversations: DataFrame) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations.

    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.
    Null roles and texts are empty ones; turns go by number, null first, those of one
    number by role and text; equal rows are turns of their own. Rows without a conv_id
    belong to no conversation and are left out. Without conversations there is no node, not
    even a root. Texts and conversations may be of any length. Other columns are not read.
    """
    bound_batches(conversations.sparkSession)
    turns, each = rebuilt(conversations)
    steps = materialise(paths(materialise(turns), each))
    node = ["depth", "k", "l"]
    # each task sends on one row for each node at most
    first = F.row_number().over(Window.partitionBy(*node).orderBy("c"))
    owned = materialise(steps.withColumn("nth", first).where("nth = 1").drop("nth"))
    own = owned.groupBy("c").agg(F.min("depth").alias("since"))
    inner = owned.where("kb is not null").select((F.col("depth") - 1).alias("depth"), F.col("kb").alias("k"), F.col("lb").alias("l")).distinct()
    sizes = steps.groupBy("c").agg(F.max("depth").alias("n"), F.sum("tokens").alias("total"))
    last = owned.join(sizes.select("c", "n"), "c").where("depth = n").select("c", *node)
    leaves = last.join(inner, node, "left_anti").select("c", F.lit(1).alias("leaf"))
    # what is above the first node that a conversation owns
    tops = owned.join(own, "c").where("depth = since").select("c", "since", F.col("before").alias("above"), (F.col("depth") - 1).alias("depth"), F.col("kb").alias("k"), F.col("lb").alias("l"))
    parents = owned.select(*node, F.col("c").alias("parent"))
    tops = tops.join(parents, node, "left").select("c", "since", "above", "parent")
    facts = sizes.join(tops, "c", "left").join(leaves, "c", "left")
    facts = materialise(facts.select("c", "n", F.coalesce("since", F.col("n") + 1).alias("since"), F.coalesce("above", "total").alias("above"), "parent", F.coalesce("leaf", F.lit(0)).alias("leaf")))
    member = steps.select("c", *node, "before").join(facts, "c")
    owns = F.col("depth") >= F.col("since")
    flag = lambda x: F.sum(x.cast("long"))
    found = member.groupBy(*node).agg(
        F.min("c").alias("conv_id"),
        F.min(F.when(owns, F.when(F.col("depth") > F.col("since"), F.col("c")).otherwise(F.col("parent")))).alias("parent_conv_id"),
        F.count("*").alias("n_convs"),
        flag((F.col("depth") + 1 >= F.col("since")) & (F.col("depth") < F.col("n"))).alias("n_children"),
        F.sum(F.col("leaf").cast("long")).alias("n_leaves"),
        F.sum(F.when(owns, F.lit(0)).otherwise(F.col("above") - F.col("before"))).alias("saved_tokens"),
    )
    ends = steps.join(sizes.select("c", "n"), "c").where("depth = n").select(*node, "c")
    out = found.join(_digests(ends), node, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"))


def nodes_sql() -> str:
    """The same rows in DuckDB's SQL: nodes first, each then added to all above it."""
    crc = "list_reduce([4294967295::BIGINT] || list_transform(string_split({0}, ''), lambda d: ascii(d)::BIGINT), lambda a, b: list_reduce([xor(a, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda u, v: CASE WHEN u & 1 = 1 THEN xor(u >> 1, 3988292384) ELSE u >> 1 END))"
    return rf"""
    WITH turns AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    heads AS (SELECT DISTINCT c, c - c % {BASE} AS base, xor({crc.format("c::VARCHAR")}, 4294967295) % {HEADS} AS h FROM turns),
    parts AS (SELECT h.c, 0 AS part, t.pos, role, text FROM heads h JOIN turns t ON t.c = h.base WHERE t.pos <= h.h
        UNION ALL SELECT h.c, 1, t.pos, role, text FROM heads h JOIN turns t ON t.c = h.c WHERE t.pos > h.h),
    rebuilt AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS depth, role, text FROM parts),
    steps AS (SELECT c, depth, text, sha256(string_agg(sha256(role) || sha256(text), '' ORDER BY depth) OVER (PARTITION BY c ORDER BY depth ROWS UNBOUNDED PRECEDING)) AS node FROM rebuilt
        UNION ALL SELECT c, 0, '', '' FROM heads),
    lengths AS (SELECT c, max(depth) AS n FROM steps GROUP BY 1),
    nodes AS (SELECT node, depth, min(c) AS conv_id, count(*) AS n_convs, any_value(len(regexp_extract_all(text, '{WORD}'))) AS tokens, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (depth = n), '') AS ends FROM steps JOIN lengths USING (c) GROUP BY ALL),
    up AS (SELECT a.node, a.depth, p.node AS parent FROM nodes a JOIN steps p ON p.c = a.conv_id AND p.depth = a.depth - 1),
    children AS (SELECT parent AS node, count(*) AS n FROM up GROUP BY ALL),
    below AS (SELECT above.node, sum((b.n_convs - 1) * b.tokens)::BIGINT AS saved, count(*) FILTER (k.n IS NULL) AS leaves FROM nodes b JOIN steps above ON above.c = b.conv_id AND above.depth <= b.depth LEFT JOIN children k ON k.node = b.node GROUP BY ALL)
    SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, coalesce(k.n, 0) AS n_children, leaves AS n_leaves, saved AS saved_tokens, sha256(v.ends) AS ends_sha256
    FROM nodes v JOIN below USING (node) LEFT JOIN children k USING (node) LEFT JOIN up USING (node) LEFT JOIN nodes p ON p.node = up.parent"""
