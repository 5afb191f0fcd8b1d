"""Line deduplication by pairwise alignment.

Documents that share a line of several words meet through that line's hash: each
is paired with the earliest document that has the line. A pair's lines are aligned with
patience diff, and aligned blocks that hold such a line are deleted from the later
document; so are such lines that the alignment does not reach. The earliest document
that has a line keeps it. How often a line occurs changes nothing: documents that are
paired with one come to it in groups of bounded size, which read its lines once, and an
alignment looks at the lines only that both have.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiepoint.llm.common import WORD, bound_batches, materialise, quoted

#: Words that a line must have to bring two documents together, and a block to be deleted.
MIN_WORDS = 5
#: Documents that meet an earlier one in one group.
GROUP = 256
#: Times that gaps are aligned within gaps; what is left then is taken line by line.
DEPTH = 50
_LAST = (1 << 63) - 1


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Patience diff: pairs of positions of equal lines, rising in both.

    Common starts and ends are matched; between them the lines that occur once on
    either side are matched along their longest rising run, and the gaps in turn.
    """
    found, todo = [], [(0, len(a), 0, len(b), 0)]
    while todo:
        a0, a1, b0, b1, deep = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1 or deep == DEPTH:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {b[j]: j for j in range(b0, b1) if in_b[b[j]] == 1 and in_a.get(b[j]) == 1}
        points = [(i, where[a[i]]) for i in range(a0, a1) if a[i] in where]
        if not points:
            continue
        ends: list[int] = []
        last: list[int] = []
        back: list[int] = []
        for n, (_, j) in enumerate(points):
            at = bisect_left(ends, j)
            if at == len(ends):
                ends.append(j)
                last.append(n)
            else:
                ends[at], last[at] = j, n
            back.append(last[at - 1] if at else -1)
        run, n = [], last[-1]
        while n >= 0:
            run.append(points[n])
            n = back[n]
        found += run
        run.reverse()
        for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *run], [*run, (a1, b1)], strict=True):
            todo.append((i + 1, k, j + 1, m, deep + 1))
    return sorted(found)


class Earlier:
    """The lines of a document that others are compared with."""

    def __init__(self, lines: list) -> None:
        self.lines = lines
        self.places: dict = {}
        for j, x in enumerate(lines):
            self.places.setdefault(x, []).append(j)
        self.neighbours: dict = {}
        for j, x in enumerate(zip(lines, lines[1:], strict=False)):
            self.neighbours.setdefault(x, j)

    def align(self, later: list) -> list[tuple[int, int]]:
        """``align`` of the lines that both have, by their places in the whole documents."""
        i = [p for p, x in enumerate(later) if x in self.places]
        j = sorted(q for x in {later[p] for p in i} for q in self.places[x])
        return [(i[p], j[q]) for p, q in align([later[p] for p in i], [self.lines[q] for q in j])]


def common_blocks(later: list, earlier: Earlier | list, worth: list[bool]) -> list[int]:
    """Positions in ``later`` of aligned blocks that hold a line worth deleting.

    Such lines that the alignment leaves, because they were moved or stand there
    twice, are then taken one by one with their surroundings, so that no line worth
    deleting is left that ``earlier`` has.
    """
    earlier = earlier if isinstance(earlier, Earlier) else Earlier(earlier)
    gone: list[int] = []
    block: list[int] = []
    before = None
    for i, j in [*earlier.align(later), (-1, -1)]:
        if before is None or (i, j) != (before[0] + 1, before[1] + 1):
            if any(worth[p] for p in block):
                gone += block
            block = []
        block.append(i)
        before = (i, j)
    lost = set(gone)
    left = [p for p in range(len(later)) if p not in lost]
    rest = _by_line([later[p] for p in left], earlier, [worth[p] for p in left])
    return sorted(gone + [left[i] for i in rest])


def _by_line(a: list, earlier: Earlier, worth: list[bool]) -> set[int]:
    """Positions in ``a`` of all lines worth deleting that ``earlier`` has, with the lines around them that also stand around a copy."""
    b, before = earlier.lines, earlier.neighbours
    gone: set[int] = set()
    for p, x in enumerate(a):
        if not worth[p] or x not in earlier.places or p in gone:
            continue
        gone.add(p)
        for step in (-1, 1):
            pair = tuple(a[min(p, p + step) : max(p, p + step) + 1]) if p + step >= 0 else ()
            if pair not in before:
                continue
            i, j = p + step, before[pair] + max(step, 0)
            while 0 <= i < len(a) and 0 <= j < len(b) and i not in gone and a[i] == b[j]:
                gone.add(i)
                i, j = i + step, j + step
    return gone


def _order_of(id_col: str, text: Column) -> Column:
    """Documents in order: by id, null last, then by a hash of the text. Rows of equal id and text are one document."""
    return F.struct(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("key"), F.xxhash64(text).alias("same"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, group: int = GROUP) -> DataFrame:
    """``doc, gone``: for each document that loses lines, by ``_order_of``, their positions."""
    bound_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.split(text, "\n")
    rows = docs.select(_order_of(id_col, text).alias("doc"), F.transform(lines, lambda x: F.xxhash64(x)).alias("lines"), F.transform(lines, lambda x: F.regexp_count(x, F.lit(WORD)) >= min_words).alias("worth"))
    rows = materialise(rows.where(F.exists("worth", lambda x: x)))
    if not rows.groupBy("doc").count().where("count > 1").isEmpty():
        rows = materialise(rows.dropDuplicates(["doc"]))
    each = rows.select("doc", F.explode(F.array_distinct(F.filter(F.transform(F.arrays_zip("lines", "worth"), lambda x: F.when(x["worth"], x["lines"])), lambda x: x.isNotNull()))).alias("line"))
    # written before the join, so that a line of very many documents can be dealt to several tasks there
    owners = materialise(each.groupBy("line").agg(F.min("doc").alias("owner"), F.max("doc").alias("last")).where("owner < last").select("line", "owner"))
    pairs = materialise(each.join(owners, "line").where("owner < doc").select("doc", "owner").distinct())
    # an earlier document of many others gets several groups of them
    # written, so that the join with it can deal the pairs of one owner to several tasks
    many = materialise(pairs.groupBy("owner").agg(F.count("*").alias("n")).where(F.col("n") > group).select("owner", F.ceil(F.col("n") / group).cast("int").alias("parts")))
    dealt = pairs.join(many, "owner", "left").select("owner", "doc", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int")).alias("part"))
    dealt = materialise(dealt)
    heads = dealt.select("owner", "part").distinct().join(rows.select(F.col("doc").alias("owner"), "lines"), "owner")
    heads = heads.select("owner", "part", F.lit(0).alias("turn"), F.col("owner").alias("doc"), "lines", F.lit(None).cast("array<boolean>").alias("worth"))
    later = dealt.join(rows, "doc").select("owner", "part", F.lit(1).alias("turn"), "doc", "lines", "worth")
    met = heads.unionAll(later).repartition("owner", "part").sortWithinPartitions("owner", "part", "turn").select("turn", "doc.key", "doc.same", "lines", "worth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        earlier = Earlier([])
        for batch in batches:
            keys, sames, gone = [], [], []
            for turn, key, same, x, worth in zip(*batch.columns, strict=True):
                if turn.as_py() == 0:
                    earlier = Earlier(x.as_py())
                    continue
                keys.append(key.as_py())
                sames.append(same.as_py())
                gone.append(common_blocks(x.as_py(), earlier, worth.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sames, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], ["key", "same", "gone"])

    aligned = met.mapInArrow(run, "key long, same long, gone array<int>").where(F.size("gone") > 0)
    return aligned.select(F.struct("key", "same").alias("doc"), F.explode("gone").alias("at")).groupBy("doc").agg(F.collect_set("at").alias("gone"))


def _without(text: Column, gone: Column) -> Column:
    """The text without the lines at some positions; each line is looked at once."""
    left = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    joined = F.transform(F.array(F.split(text, "\n")), lambda lines: F.array_join(F.transform(left(lines), lambda i: F.get(lines, i)), "\n"))
    return F.get(joined, F.lit(0))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Every row of ``docs`` with its own columns, its text without the repeated blocks.

    Earlier means a smaller id, null last, and of equal ids the smaller hash of the text;
    rows that are equal in both lose nothing to each other. A null or empty text stays as
    it is; a document all of whose lines are repeated keeps an empty text. Columns may have
    any other names, and ``n_chars``, if there, follows the text. An empty table stays empty.
    """
    gone = repeated_lines(docs, id_col, text_col, min_words)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    row = F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row")
    joined = docs.select(row, _order_of(id_col, text).alias("doc")).join(gone, "doc", "left")
    kept = _without(F.col("row")[text_col], F.col("gone"))
    out = {text_col: F.when(F.col("gone").isNotNull(), kept).otherwise(F.col("row")[text_col])}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("gone").isNotNull(), F.length(kept).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row")["n_chars"])
    return joined.select(*[out.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
