"""Divergence of sources within a language, by exact term counts in mergeable byte tries.

Each task keeps a radix trie of the terms' bytes for every language. It is laid out in
traversal order: a leaf has the number of bytes that it shares with the leaf before,
the rest of its bytes, the documents that hold it, and a counter for each source. Tries
are cut at prefixes, dealt by ranges of language and prefix, and those of one prefix
merged. So a task meets the terms of its range in the order of their UTF-8 bytes, which
is the order of ties.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tiepoint.llm.common import bound_batches, checkpoint_dir, discard, materialise

#: Documents of a language that must hold a term.
LEAST_DOCUMENTS = 10
#: Ranks of the terms of a source.
TERMS = 10
#: Bytes of the prefixes at which tries are cut.
PREFIX = 4
#: Leaf counters that a task holds before it hands on its tries and starts new ones.
MOST_COUNTERS = 1_500_000
#: Cells of the tables of shares that a task holds at once.
CELLS = 1 << 20
#: Probabilities are whole numbers of so many parts.
PARTS = 1_000_000_000
# Bytes of terms: letters, in lower case, and all bytes beyond ASCII; the others separate.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of a string array, in order, and the row that each is from."""
    texts = pa.concat_arrays([texts.cast(pa.large_string()).fill_null("")])
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = bytes(data)[ends[0] : ends[-1]].translate(_FOLD) if data is not None and len(texts) else b""
    letters = np.frombuffer(raw, np.uint8)
    inside = letters != 32
    at = ends - ends[0]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = at[:-1][at[:-1] < len(raw)]
    first[cuts] |= inside[cuts]  # no term goes on from one text to the next
    starts = np.flatnonzero(first)
    kept = np.concatenate([[0], np.cumsum(inside)])
    offsets = np.concatenate([kept[starts], kept[-1:]]).astype(np.int64)
    terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters[inside].tobytes())])
    return terms, np.searchsorted(at, starts, "right") - 1


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's counts; exact for whole numbers."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


class Tries:
    """Term counts of one language: terms, documents, and counters (term, source, count)."""

    def __init__(self) -> None:
        self.parts: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, terms: pa.Array, documents: np.ndarray, term: np.ndarray, source: np.ndarray, count: np.ndarray) -> None:
        self.parts.append((terms, documents, term, source, count))
        self.size += len(count)

    def merge(self) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """One part of all: terms in the order of their bytes, counters by term and source."""
        every = pa.concat_arrays([p[0] for p in self.parts]).dictionary_encode()
        order = pc.sort_indices(every.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        at = rank[every.indices.to_numpy()]
        begin = np.concatenate([[0], np.cumsum([len(p[0]) for p in self.parts])])
        documents = np.zeros(len(order), np.int64)
        np.add.at(documents, at, np.concatenate([p[1] for p in self.parts]))
        term = at[np.concatenate([p[2] + b for p, b in zip(self.parts, begin, strict=False)])]
        wide = int(max([p[3].max(initial=0) for p in self.parts])) + 1
        keys, counts = _summed(term * wide + np.concatenate([p[3] for p in self.parts]), np.concatenate([p[4] for p in self.parts]))
        merged = every.dictionary.take(pa.array(order)), documents, keys // wide, keys % wide, counts
        self.parts, self.size = [merged], len(counts)
        return merged


def _shared(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    return lo


def cut(trie: tuple, prefix: int = PREFIX) -> Iterator[tuple[bytes, list[int], list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Tries below each prefix: the prefix, bytes shared with the leaf before, the rest of each leaf, documents, counters for each leaf, their sources and counts."""
    terms, documents, term, source, count = trie
    words = terms.to_pylist()
    per_term = np.bincount(term, minlength=len(words))
    at = np.concatenate([[0], np.cumsum(per_term)])
    heads = [w[:prefix] for w in words]
    begin = 0
    while begin < len(words):
        end = begin + 1
        while end < len(words) and heads[end] == heads[begin]:
            end += 1
        shared, rest, before = [], [], b""
        for w in words[begin:end]:
            n = _shared(before, w)
            shared.append(n)
            rest.append(w[n:])
            before = w
        some = slice(at[begin], at[end])
        yield heads[begin], shared, rest, documents[begin:end], per_term[begin:end], source[some], count[some]
        begin = end


def walk(shared: list[int], rest: list[bytes]) -> list[bytes]:
    """The leaves of a trie in order."""
    out, before = [], b""
    for n, r in zip(shared, rest, strict=True):
        before = before[:n] + r
        out.append(before)
    return out


_TRIE = "lang string, prefix binary, shared array<int>, rest array<binary>, documents array<long>, counters array<int>, source array<int>, count array<long>"
_TRIE_ARROW = pa.schema([("lang", pa.string()), ("prefix", pa.binary()), ("shared", pa.list_(pa.int32())), ("rest", pa.list_(pa.binary())), ("documents", pa.list_(pa.int64())), ("counters", pa.list_(pa.int32())), ("source", pa.list_(pa.int32())), ("count", pa.list_(pa.int64()))])


def _batches(rows: Iterator[tuple], schema: pa.Schema, weigh, most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Rows in batches whose weights are about ``most``."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += weigh(row)
        if weight >= most:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def count_terms(docs: DataFrame, names: dict[str, list[str]], most: int = MOST_COUNTERS, prefix: int = PREFIX) -> DataFrame:
    """A row for each task, language and prefix: the trie of the terms below it. ``docs``: ``lang, source, text`` without nulls in the first two."""
    index = {lang: {s: i for i, s in enumerate(sources)} for lang, sources in names.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, Tries] = {}

        def rows() -> Iterator[tuple]:
            for lang in sorted(tries):
                for head, shared, rest, documents, per_term, source, count in cut(tries[lang].merge(), prefix):
                    yield lang, head, shared, rest, documents, per_term, source, count
            tries.clear()

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            sources = batch.column(1).to_pylist()
            for lang in set(langs.tolist()):
                mine = np.flatnonzero(langs == lang)
                terms, row = terms_of(batch.column(2).take(pa.array(mine)))
                if not len(terms):
                    continue
                coded = terms.dictionary_encode()
                code = coded.indices.to_numpy().astype(np.int64)
                of = np.array([index[lang][sources[i]] for i in mine], np.int64)
                n = len(names[lang])
                keys, counts = np.unique(code * n + of[row], return_counts=True)
                held = np.unique(code * len(mine) + row) // len(mine)
                tries.setdefault(lang, Tries()).add(coded.dictionary, np.bincount(held, minlength=len(coded.dictionary)), keys // n, keys % n, counts.astype(np.int64))
            if sum(t.size for t in tries.values()) > most:
                for t in tries.values():
                    t.merge()
                if sum(t.size for t in tries.values()) > most // 2:
                    yield from _batches(rows(), _TRIE_ARROW, lambda r: len(r[6]) + 5)
        yield from _batches(rows(), _TRIE_ARROW, lambda r: len(r[6]) + 5)

    return docs.select("lang", "source", "text").mapInArrow(run, _TRIE)


def merge_tries(tries: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """``lang, term, source, count`` for the terms that at least so many documents hold, each task's in the order of their bytes; the last two are arrays."""
    schema = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("source", pa.list_(pa.int32())), ("count", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            open_, held = None, Tries()
            for batch in batches:
                for lang, prefix, shared, rest, *numbers in zip(*(c.to_pylist() if i < 4 else c for i, c in enumerate(batch.columns)), strict=True):
                    if (lang, prefix) != open_:
                        yield from kept(open_, held)
                        open_, held = (lang, prefix), Tries()
                    documents, counters, source, count = (x.values.to_numpy() for x in numbers)
                    held.add(pa.array(walk(shared, rest), pa.large_binary()), documents, np.repeat(np.arange(len(counters)), counters), source.astype(np.int64), count)
                    if len(held.parts) > 1 and held.size > MOST_COUNTERS:
                        held.merge()
            yield from kept(open_, held)

        def kept(key: tuple | None, held: Tries) -> Iterator[tuple]:
            if key is None:
                return
            terms, documents, term, source, count = held.merge()
            stay = np.flatnonzero(documents >= least)
            lo, hi = np.searchsorted(term, stay, "left"), np.searchsorted(term, stay, "right")
            for i, a, b in zip(stay.tolist(), lo.tolist(), hi.tolist(), strict=True):
                yield key[0], terms[i].as_py(), source[a:b], count[a:b]

        yield from _batches(rows(), schema, lambda r: len(r[2]) + 2)

    ranged = tries.repartitionByRange("lang", "prefix").sortWithinPartitions("lang", "prefix")
    return ranged.mapInArrow(run, "lang string, term binary, source array<int>, count array<long>")


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(PARTS * count / total) in whole numbers, digit by digit so that nothing overflows; count <= total."""
    out, left = np.zeros(np.broadcast(count, total).shape, np.int64), count
    for _ in range(9):
        left = left * 10
        out, left = out * 10 + left // total, left % total
    return out + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _partial_sums(kept: DataFrame, names: dict[str, list[str]], totals: dict[str, np.ndarray], kinds: dict[str, int], terms: int) -> DataFrame:
    """For each task: the gap of every two sources over its terms, and each source's leading terms."""
    schema = pa.schema([("lang", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("term", pa.binary()), ("value", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int, int], np.ndarray] = {}
        best: dict[tuple[str, int], list[tuple[int, bytes]]] = {}

        def take(lang: str, words: list[bytes], term: np.ndarray, source: np.ndarray, count: np.ndarray) -> None:
            n, v = len(names[lang]), kinds[lang]
            table = np.zeros((len(words), n), np.int64)
            table[term, source] = count
            p = shares(table + 2, totals[lang][None, :] + 2 * v)
            q = shares(table.sum(axis=1) + 2, totals[lang].sum() + 2 * v)
            value = np.where((table > 0) & (p > q[:, None]), gap(p, q[:, None]), -1)
            for i in range(n):
                have = np.flatnonzero(value[:, i] >= 0)
                if len(have) > terms:  # the first of equal ones come first: terms are in order
                    have = np.sort(have[np.argsort(-value[have, i], kind="stable")[:terms]])
                if len(have):
                    both = [*best.get((lang, i), ()), *((-int(value[t, i]), words[t]) for t in have)]
                    best[lang, i] = sorted(both)[:terms]
            step = max(1, CELLS // max(1, len(words)))  # sources that are compared with one at a time
            for i in range(n):
                for j in range(i + 1, n, step):
                    found = gap(p[:, i : i + 1], p[:, j : j + step]).sum(axis=0)
                    at = sums.setdefault((lang, i, j), np.zeros(len(found), np.int64))
                    at += found

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in dict.fromkeys(langs.tolist()):
                mine = batch.filter(pa.array(langs == lang))
                rows = max(1, CELLS // max(1, len(names[lang])))
                for at in range(0, len(mine), rows):
                    some = mine.slice(at, rows)
                    lengths = some.column(2).value_lengths().to_numpy()
                    take(lang, some.column(1).to_pylist(), np.repeat(np.arange(len(some)), lengths), some.column(2).flatten().to_numpy(), some.column(3).flatten().to_numpy())
        pairs = ((lang, i, j + k, None, int(x)) for (lang, i, j), found in sums.items() for k, x in enumerate(found))
        leading = ((lang, i, -1, t, -v) for (lang, i), x in best.items() for v, t in x)
        for rows in (pairs, leading):
            yield from _batches(rows, schema, lambda r: 1)

    return kept.mapInArrow(run, "lang string, a int, b int, term binary, value long")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCUMENTS, terms: int = TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source of a language is from the others, and by which terms.

    Null texts, languages and sources count as empty ones, each row as a document of its
    own. A language in which no term is frequent enough gives pairs of value 0; a source
    that is alone in its language gives no pairs; an empty table gives no rows. Ties go to
    the smaller item by UTF-8 bytes. A text may have any length. The driver sees one number
    for each source of a language (the result has a row for every two of these); tasks
    hold tries of at most MOST_COUNTERS counters, and only the distinct terms below one
    prefix when they merge.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    names: dict[str, list[str]] = {}
    for r in rows.select("lang", "source").distinct().collect():
        names.setdefault(r["lang"], []).append(r["source"])
    for sources in names.values():
        sources.sort(key=str.encode)
    # written before they are dealt by ranges, which takes two passes over them
    folder = f"{checkpoint_dir(spark)}/tries-{uuid.uuid4().hex}"
    count_terms(rows, names).write.parquet(folder)
    kept = materialise(merge_tries(spark.read.parquet(folder), least))
    discard(spark, folder)
    kinds, totals = dict.fromkeys(names, 0), {lang: np.zeros(len(s), np.int64) for lang, s in names.items()}
    kinds |= {r["lang"]: r["n"] for r in kept.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    each = kept.select("lang", F.explode(F.arrays_zip("source", "count")).alias("x"))
    for r in each.groupBy("lang", "x.source").agg(F.sum("x.count").alias("n")).collect():
        totals[r["lang"]][r["source"]] = r["n"]
    found = materialise(_partial_sums(kept, names, totals, kinds, terms))
    groups = spark.createDataFrame([(lang, i, s) for lang, sources in names.items() for i, s in enumerate(sources)], "lang string, i int, source string")
    one, other = groups.select("lang", F.col("i").alias("a"), "source"), groups.select("lang", F.col("i").alias("b"), F.col("source").alias("item"))
    summed = found.where("b >= 0").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = summed.unionAll(summed.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    pairs = one.join(other, "lang").where("a <> b").join(both, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    leading = found.where("b < 0").select("lang", "a", F.decode("term", "UTF-8").alias("item"), "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    leading = one.join(leading, ["lang", "a"]).select("lang", "source", F.lit("term").alias("part"), "item", "value")
    return pairs.unionAll(leading).withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= terms))


def audit_sql(least: int = LEAST_DOCUMENTS, terms: int = TERMS) -> str:
    """The same rows in DuckDB's SQL."""
    share = lambda n, total, v: f"1 + ({PARTS}::HUGEINT * ({n} + 2)) // ({total} + 2 * {v})"
    return rf"""
    WITH docs AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    each AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
    kept AS (SELECT lang, term FROM each GROUP BY ALL HAVING count(DISTINCT doc) >= {least}),
    counts AS (SELECT lang, source, term, count(*) AS n FROM each SEMI JOIN kept USING (lang, term) GROUP BY ALL),
    kinds AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL),
    sources AS (SELECT DISTINCT lang, source FROM docs),
    total AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM sources LEFT JOIN counts USING (lang, source) GROUP BY ALL),
    grid AS (SELECT k.lang, t.source, k.term, coalesce(c.n, 0) AS n, t.total, v FROM kept k JOIN kinds USING (lang) JOIN total t USING (lang) LEFT JOIN counts c ON c.lang = k.lang AND c.term = k.term AND c.source = t.source),
    p AS (SELECT lang, source, term, n, {share('n', 'total', 'v')} AS p, {share('sum(n) OVER (PARTITION BY lang, term)', 'sum(total) OVER (PARTITION BY lang, term)', 'v')} AS q FROM grid),
    gaps AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN gaps g ON g.lang = a.lang AND g.source = a.source AND g.item = b.source
        UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q)
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM parts
    QUALIFY part = 'pair' OR rank <= {terms}"""
