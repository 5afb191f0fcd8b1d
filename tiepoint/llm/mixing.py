"""Mixing sources to target weights.

Rows of a source are ordered by a hash of their id and text. Sizes are summed by
ranges of that hash (partial aggregation), the range totals are prefix-summed, and rows
get their position from their range's offset plus a running sum within it, so no
source is ever in one task. The budget then cuts each source at one hash value, and
applying the cut to documents needs no shuffle. Only rows that are equal in id and text
share a hash; where the budget ends among such rows, they are numbered to be cut too.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiepoint.llm.common import WORD, free_name, materialise, quoted

#: Weights in the order of the sources' names, repeating.
WEIGHTS = (1, 2, 3)
#: A source is repeated this many times at most.
MAX_EPOCHS = 3
SEED = "mix-1"
#: Up to so many sources, the table with a row for each is broadcast; beyond, it is joined as Spark sees fit.
MOST_BROADCAST = 100_000


def size_of(text: Column) -> Column:
    """Words of the whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """32 hex digits; rows of a source are in their order. Rows equal in id and text tie."""
    own = F.coalesce(F.md5(text.cast("string")), F.lit(""))
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), own))


def targets_of(sizes: dict, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> dict:
    """Target of each source: shares of the total by weight, none above ``max_epochs`` times its size.

    Python compares text by code point; null comes last.
    """
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), list(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > max_epochs * sizes[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        out |= {s: float(max_epochs * sizes[s]) for s in full}
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """A row per source: ``source, source_size, target, epochs, cut, tied, of_tied``.

    Every row of the source is taken ``epochs`` times, and once more if its order key
    is less than ``cut`` (null: none), or is ``cut`` and the row is one of ``of_tied`` of
    the ``tied`` rows that have it. A row is within the cut if its midpoint lies
    before the budget, so that a source's words are within one document of the target.
    The driver sees one row per source, never documents.
    """
    spark = docs.sparkSession
    schema = "source string, source_size long, target double, epochs int, rest double"
    sized = materialise(docs.select(F.col(source_col).cast("string").alias("source"), order_key(F.col(id_col), F.col(text_col), seed).alias("key"), size_of(F.col(text_col)).alias("size")))
    found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    sizes = {r["source"]: r["size"] for r in found}
    rows = []
    for s, t in targets_of(sizes, weights, max_epochs).items():
        epochs = min(int(t // sizes[s]), max_epochs) if sizes[s] else 0
        rows.append((s, sizes[s], t, epochs, t - epochs * sizes[s]))
    budgets = spark.createDataFrame(rows, schema)
    # hex digits that make about the square root of the largest source's rows into a range
    digits = max(1, math.ceil(math.log(max([r["n"] for r in found], default=1), 16) / 2))
    ranged = sized.withColumn("slot", F.substring("key", 1, digits))
    totals = ranged.groupBy("source", "slot").agg(F.sum("size").alias("total"))
    before = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("offset", F.coalesce(F.sum("total").over(before), F.lit(0)))
    # only the range in which a source's budget ends has to be read row by row
    same = lambda x, y: F.col(x).eqNullSafe(F.col(y))
    small = F.broadcast if len(found) <= MOST_BROADCAST else lambda df: df
    b = small(budgets.select(F.col("source").alias("s"), "rest"))  # one row per source
    ends = offsets.join(b, same("source", "s")).where("offset < rest and total > 0")
    last = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("slot")))
    ends = small(ends.withColumn("nth", last).where("nth = 1").select(F.col("source").alias("s"), F.col("slot").alias("end_slot"), "offset", "rest"))
    inside = ranged.join(ends, same("source", "s") & (F.col("slot") == F.col("end_slot")))
    running = F.sum("size").over(Window.partitionBy("source").orderBy("key").rangeBetween(Window.unboundedPreceding, 0))
    per_key = inside.groupBy("source", "key").agg(F.sum("size").alias("size"), F.count("*").alias("tied"), F.first("offset").alias("offset"), F.first("rest").alias("rest"))
    room = F.col("rest") - F.col("offset") - (F.col("upto") - F.col("size"))
    fit = F.when(F.col("size") > 0, F.floor(room * F.col("tied") / F.col("size") + 0.5)).otherwise(F.when(room >= 0, F.col("tied")).otherwise(0))
    fit = F.greatest(F.lit(0), F.least(F.col("tied"), fit)).cast("long")
    last_in = F.max_by(F.struct("key", "tied", F.col("fit").alias("of_tied")), "key").alias("x")
    cut = per_key.withColumn("upto", running).withColumn("fit", fit).where("fit > 0").groupBy("source").agg(last_in).select("source", "x.*")
    # nothing of the last range: the cut is just before it
    edge = ends.select("s", F.col("end_slot").alias("edge")).join(cut, same("source", "s"), "left").select("s", F.coalesce("key", "edge").alias("cut"), F.coalesce("tied", F.lit(0)).alias("tied"), F.coalesce("of_tied", F.lit(0)).alias("of_tied"))
    some = F.col("rest") > 0
    return budgets.join(edge, same("source", "s"), "left").select("source", "source_size", "target", "epochs", *[F.when(some, F.col(c)).alias(c) for c in ("cut", "tied", "of_tied")])


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, name: str = "mix") -> DataFrame:
    """Every row of ``docs`` with its own columns, plus last a struct ``name`` of ``copies, source_size, target``.

    Columns of ``docs`` may have any names; if one is called ``name``, the struct's name
    gets underscores before it. Null texts have size 0; a null source is a source of its own, and null ids are told apart by their texts;
    of rows that are equal in id and text as many are taken as the budget has room for, and which
    of them these are may change from run to run. An empty table stays empty.
    """
    name = free_name(docs.columns, name)
    decided = materialise(plan(docs, id_col, text_col, source_col, weights, max_epochs, seed))  # one row per source
    parts = decided.agg(F.count("*").alias("n"), F.count_if(F.col("of_tied") < F.col("tied")).alias("cut_ties")).first()
    decided = F.broadcast(decided) if parts["n"] <= MOST_BROADCAST else decided
    # all columns go as one struct, so that their names can be any
    whole = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), F.col(source_col).cast("string").alias("of"), order_key(F.col(id_col), F.col(text_col), seed).alias("key"))
    joined = whole.join(decided, F.col("of").eqNullSafe(F.col("source")))
    out = lambda df, copies: df.select("row.*", F.struct(copies.cast("int").alias("copies"), "source_size", "target").alias(name))
    at_cut = F.coalesce((F.col("key") == F.col("cut")) & (F.col("of_tied") < F.col("tied")), F.lit(False))
    within = F.coalesce((F.col("key") <= F.col("cut")).cast("int"), F.lit(0))
    if not parts["cut_ties"]:
        return out(joined, F.col("epochs") + within)
    # rows of one key at the end of a budget are numbered: within partitions, and by the partitions' sizes before
    ties = materialise(joined.where(at_cut).withColumn("n", F.monotonically_increasing_id()))
    ties = ties.withColumn("part", F.shiftright("n", 33))
    sizes = ties.groupBy("source", "part").agg(F.count("*").alias("size"), F.min("n").alias("first"))
    before = F.sum("size").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col("source").alias("s"), F.col("part").alias("p"), "first", F.coalesce(before, F.lit(0)).alias("before"))
    # numbers of a partition's rows rise with gaps where other sources' rows lie between
    rank = F.row_number().over(Window.partitionBy("source", "part").orderBy("n"))
    numbered = ties.withColumn("rank", rank).join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    taken = out(numbered, F.col("epochs") + (F.col("before") + F.col("rank") <= F.col("of_tied")).cast("int"))
    return out(joined.where(~at_cut), F.col("epochs") + within).unionAll(taken)


def mix_sql() -> str:
    """The sizes, targets and taken words of ``documents`` in DuckDB's SQL.

    A source's target is its weight times a common level, or its cap where that is less;
    the level follows from the sources in the order in which they reach their caps.
    """
    weights = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS))
    return rf"""
    WITH docs AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size, md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(md5(text), '')) AS key FROM documents),
    sums AS (SELECT source, sum(size)::BIGINT AS s FROM docs GROUP BY 1),
    named AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} {weights} END AS w FROM sums),
    ranked AS (SELECT *, row_number() OVER o AS nth, sum({MAX_EPOCHS} * s) OVER o - {MAX_EPOCHS} * s AS capped, sum(w) OVER o - w AS used FROM named WINDOW o AS (ORDER BY {MAX_EPOCHS} * s / w, source ROWS UNBOUNDED PRECEDING)),
    level AS (SELECT ((SELECT sum(s) FROM sums) - capped)::DOUBLE AS rest, ((SELECT sum(w) FROM named) - used)::DOUBLE AS open FROM ranked WHERE {MAX_EPOCHS} * s >= ((SELECT sum(s) FROM sums) - capped)::DOUBLE * w / ((SELECT sum(w) FROM named) - used)::DOUBLE ORDER BY nth LIMIT 1),
    targets AS (SELECT source, s, least({MAX_EPOCHS} * s, coalesce((SELECT rest FROM level) * w / (SELECT open FROM level), {MAX_EPOCHS} * s))::DOUBLE AS target FROM named),
    budgets AS (SELECT *, CASE WHEN s > 0 THEN least(floor(target / s), {MAX_EPOCHS})::BIGINT ELSE 0 END AS epochs FROM targets),
    run AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key ROWS UNBOUNDED PRECEDING) - size / 2.0 AS middle FROM docs)
    SELECT d.doc_id, d.size, b.s AS source_size, b.target, ((b.epochs + CASE WHEN b.target - b.epochs * b.s > 0 AND d.middle <= b.target - b.epochs * b.s THEN 1 ELSE 0 END) * d.size)::BIGINT AS taken
    FROM run d JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source"""
