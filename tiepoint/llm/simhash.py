"""SimHash near-duplicates through multi-index hashing.

A 64-bit fingerprint is two 32-bit segments, and each segment has a table of the
distinct fingerprints by their value there. Of two fingerprints that differ in at
most two bits, either the first segments differ by one bit at most, or the second
segments are equal. So a fingerprint looks up the 33 values of the radius-1 ball
around its first segment, and its own second segment; what it finds there is linked
if the complete distance is at most two.

A value that more than BUSY fingerprints share is not looked through. Its members are
entered once more, under the value and the ball around their other segment, and who
looks the value up is entered there under their own other segment. Two that are close
meet at one of these finer addresses, and all who meet there are within two bits of
each other, so an address has 65 of them at most and links them in a chain.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiepoint.llm.common import bound_batches, connected_components, materialise

SEED = 42
SHINGLE = 3
DISTANCE = 2
#: Fingerprints of a table's value up to which all of them are compared with who looks it up.
BUSY = 64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> list[int]:
    """Hashes of the shingles of one whole UTF-8 text; of all its words if they are too few, none for a text without words."""
    words = text.translate(_LOWER).split()
    n = len(words)
    if not n:
        return []
    joined = b" ".join(words)
    if n <= shingle:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: n - shingle]]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s : e - 1], SEED) for s, e in zip(starts, ends[shingle - 1 :], strict=True)]


def fingerprint_from(hashes: list[int]) -> int:
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = np.array(hashes[at : at + 65536], np.uint64)
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint_of(text: bytes, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of one whole UTF-8 text; 0 for a text without words."""
    return fingerprint_from(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)`` for every row; fp is the fingerprint as a signed long. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint_of(t.as_py() or b"", shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _ball(segment: Column) -> Column:
    """A 32-bit value and the 32 values one bit away."""
    return F.concat(F.array(segment), F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: segment.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))


def _met(entries: DataFrame, wanted: DataFrame, first: bool, busy: int) -> DataFrame:
    """``(a, b)``: who meets in one segment's table, from ``entries`` and ``wanted`` of ``value, fp``."""
    # the other segment, 32 bits
    rest = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)) if first else F.shiftrightunsigned("fp", 32)
    sizes = entries.groupBy("value").agg(F.count("*").alias("size"))
    crowded = materialise(sizes.where(F.col("size") > busy).select("value", F.lit(True).alias("crowded")))
    known = entries.join(crowded, "value", "left")
    listed = known.where("crowded is null").groupBy("value").agg(F.collect_list("fp").alias("members"))  # busy of them at most
    values = listed.unionAll(crowded.select("value", F.lit(None).cast("array<bigint>")))
    # Spark takes exploded rows for as few as there were before, and would broadcast 33 times what it thinks
    met = wanted.hint("merge").join(values, "value")
    found = met.where("members is not null").select(F.col("fp").alias("a"), F.explode("members").alias("b"))

    visits = met.where("members is null").select("value", rest.alias("rest"), "fp")
    members = known.where("crowded").select("value", F.explode(_ball(rest)).alias("rest"), "fp")
    before = F.lag("fp").over(Window.partitionBy("value", "rest").orderBy("fp"))
    chained = visits.unionAll(members).select(F.col("fp").alias("a"), before.alias("b")).where("b is not null")
    return found.unionAll(chained).where("a <> b")


def links(fps: DataFrame, busy: int = BUSY) -> DataFrame:
    """``(a, b)``: pairs of distinct fingerprints at most two bits apart, enough of them to connect every such pair.

    ``fps`` has distinct values of ``fp``.
    """
    first, second = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    ball = fps.select(F.explode(_ball(first)).alias("value"), "fp")
    alike = fps.select(second.alias("value"), "fp")
    found = _met(fps.select(first.alias("value"), "fp"), ball, True, busy).unionAll(_met(alike, alike, False, busy))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    return found.where(close).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per input row: ``doc_id, fp, component_id``.

    ``component_id`` is the smallest doc_id reachable over links of at most two
    differing bits. Exact copies share a fingerprint and are joined as one node.
    Null or wordless texts have fingerprint 0 and link like any other; repeated
    rows stay repeated; a null doc_id is a row of its own class unless others share
    its component. An empty table gives an empty result.
    """
    fps = materialise(fingerprints(docs, id_col, text_col, shingle))
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    found = connected_components(links(nodes.select("fp")))
    rooted = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted)
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = rooted.join(smallest, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
