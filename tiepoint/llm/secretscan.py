"""Secret scans: named patterns, and windows of high Shannon entropy within each character class.

A candidate string is a maximal run of a class's characters. A window slides along
it; the counts of its characters change by one character in and one out, and with them
the sum of n log2 n, in whole numbers, so that no rounding builds up. Windows that
are random enough, and hold enough digits and letters, are merged to spans. An allow-list
takes out what is known to be harmless: placeholders, UUIDs, named digests. It never takes
out what a pattern has found.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiepoint.llm.common import bound_batches, free_name, quoted

# The patterns, the group that is measured, and the characters it must have. A
# shorter run of capitals or hex digits holds no longer one, so those two ask for the length themselves.
PATTERNS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
# What is never reported for its entropy alone. Texts stand anywhere in a
# span, in either case; runs are a whole candidate; labels stand right before one.
ALLOWED_TEXTS = ("example", "placeholder", "changeme", "dummy", "xxxxxx", "0123456789", "1234567890", "abcdefgh", "deadbeef")
ALLOWED_RUNS = (r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",)
ALLOWED_LABELS = (r"sha-?(?:1|224|256|384|512)", r"md5", r"etag", r"commit", r"checksum", r"digest", r"integrity")
#: Characters before a candidate in which a label is looked for.
BEFORE = 24
#: n log2 n is kept in so many parts of a bit.
SCALE = 1 << 20


@dataclass(frozen=True)
class CharacterClass:
    """Candidates of one alphabet: the window, its least entropy in bits a character, and what it must hold."""

    name: str
    alphabet: str
    width: int
    bits: float
    digits: int
    uppers: int
    lowers: int
    letters: int

    def weights(self) -> list[int]:
        """n log2 n for every count that a window can have."""
        return [0] + [round(n * math.log2(n) * SCALE) for n in range(1, self.width + 1)]

    def most(self) -> int:
        """The sum of n log2 n up to which a window is random enough."""
        return math.floor((math.log2(self.width) - self.bits) * self.width * SCALE)


CLASSES = (
    CharacterClass("entropy_hex", "0-9A-Fa-f", 20, 3.0, 3, 0, 0, 2),
    CharacterClass("entropy_alnum", "A-Za-z0-9", 20, 3.5, 2, 0, 0, 2),
    CharacterClass("entropy_base64", "A-Za-z0-9+/_=-", 24, 3.9, 1, 1, 1, 3),
)


def random_stretches(run: str, of: CharacterClass) -> list[tuple[int, int]]:
    """Stretches of ``run`` that random windows cover, in order; those that meet or overlap are one."""
    width, weight, most = of.width, of.weights(), of.most()
    count: dict[str, int] = {}
    total = digits = uppers = lowers = 0
    found: list[tuple[int, int]] = []
    for at, c in enumerate(run):
        n = count.get(c, 0)
        count[c] = n + 1
        total += weight[n + 1] - weight[n]
        digits += "0" <= c <= "9"
        uppers += "A" <= c <= "Z"
        lowers += "a" <= c <= "z"
        begin = at + 1 - width
        if begin < 0:
            continue
        if total <= most and digits >= of.digits and uppers >= of.uppers and lowers >= of.lowers and uppers + lowers >= of.letters:
            if found and begin <= found[-1][1]:
                found[-1] = (found[-1][0], at + 1)
            else:
                found.append((begin, at + 1))
        c = run[begin]
        n = count[c]
        count[c] = n - 1
        total += weight[n - 1] - weight[n]
        digits -= "0" <= c <= "9"
        uppers -= "A" <= c <= "Z"
        lowers -= "a" <= c <= "z"
    return found


class Scanner:
    """Finds the spans of one text; ``kinds`` is the order of kinds that start at one place."""

    def __init__(self, classes=CLASSES, texts=ALLOWED_TEXTS, runs=ALLOWED_RUNS, labels=ALLOWED_LABELS) -> None:
        self.classes = classes
        self.kinds = [k for k, *_ in PATTERNS] + [c.name for c in classes]
        self.patterns = [(k, re.compile(p, re.ASCII), group, least) for k, p, group, least in PATTERNS]
        self.candidates = [(c, re.compile(f"(?<![{c.alphabet}])[{c.alphabet}]{{{c.width},}}")) for c in classes]
        # a run of any class's characters, in which alone there can be candidates
        letters = "".join(c.alphabet.removesuffix("-") for c in classes) + "-" * any(c.alphabet.endswith("-") for c in classes)
        self.regions = re.compile(f"[{letters}]{{{min(c.width for c in classes)},}}") if classes else None
        self.texts = [t.lower() for t in texts]
        self.runs = re.compile("|".join(runs)) if runs else None
        self.labels = re.compile(rf"(?i:\b(?:{'|'.join(labels)}))[\"']?\s*[:=-]?\s*[\"']?$") if labels else None

    def base(self, text: str) -> list[tuple[str, int, int]]:
        """The patterns' matches, kind by kind; matches that are too short go after they were made."""
        assigns = "=" in text or ":" in text
        return [(k, m.start(), m.end()) for k, p, group, least in self.patterns if assigns or k != "assign" for m in p.finditer(text) if m.end(group) - m.start(group) >= least]

    def allowed(self, text: str, run: re.Match, start: int, end: int) -> bool:
        if self.runs and self.runs.fullmatch(run.group()):
            return True
        if self.labels and self.labels.search(text[max(0, run.start() - BEFORE) : run.start()]):
            return True
        low = text[start:end].lower()
        return any(t in low for t in self.texts)

    def random(self, text: str) -> list[tuple[str, int, int]]:
        """Random stretches of all classes that the allow-list leaves; of stretches within others the outer one, of equal ones the first class's."""
        found = []
        for region in self.regions.finditer(text) if self.regions else ():
            for order, (of, pattern) in enumerate(self.candidates):
                for run in pattern.finditer(text, region.start(), region.end()):
                    for a, b in random_stretches(run.group(), of):
                        start, end = run.start() + a, run.start() + b
                        if not self.allowed(text, run, start, end):
                            found.append((start, -end, order))
        out, reach = [], -1
        for start, end, order in sorted(found):
            if -end > reach:
                out.append((self.classes[order].name, start, -end))
                reach = -end
        return out

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        return sorted(self.base(text) + self.random(text), key=lambda s: (s[1], self.kinds.index(s[0])))


def find_secrets(docs: DataFrame, text_col: str = "text", name: str = "secrets", scanner: Scanner | None = None) -> DataFrame:
    """Every row of ``docs`` with its own columns and last an array ``name`` of ``kind, start, end``.

    Positions are code points, the end exclusive, in order of start and kind. A null
    or empty text has none. Whole texts are read, however long; a text costs time in
    proportion to its length. Repeated rows are scanned each by itself, an empty table
    stays empty, and columns may have any names (``name`` gets underscores before it if
    it is taken).
    """
    bound_batches(docs.sparkSession)
    scanner = scanner or Scanner()
    name = free_name(docs.columns, name)
    kind = "array<struct<kind:string,start:int,end:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in scanner.spans(t.as_py() or "")] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, to)], ["row", "spans"])

    whole = F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row")
    rows = docs.select(whole, F.col(quoted(text_col)).cast("string").alias("text"))
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, spans {kind}").select("row.*", F.col("spans").alias(name))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` for every row."""
    found = find_secrets(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    of = lambda kinds: F.filter("secrets", lambda s: s["kind"].isin(kinds))
    base = of([k for k, *_ in PATTERNS])
    counts = [F.size(of([k])).cast("long").alias(f"n_{k}") for k, *_ in PATTERNS]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))


def report_sql() -> str:
    """The same rows in DuckDB's SQL: every window by itself. Texts must not hold the characters 1 and 2, which mark matches."""
    either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
    words = "|".join([*map(either, ("password", "passwd", "secret", "token")), either("api") + "_?" + either("key")])
    quote = "[\"'']?"
    patterns = {"assign": rf"(?:{words}){quote}\x20*[:=]\x20*{quote}([A-Za-z0-9+/_.=-]+)"} | {k: p for k, p, *_ in PATTERNS[1:]} | {c.name: f"[{c.alphabet}]{{{c.width},}}" for c in CLASSES}
    kinds = list(patterns)
    marked = " UNION ALL ".join(f"SELECT r, {i} AS ord, string_split(regexp_replace(text, '{p}', chr(1) || '\\0' || chr(2), 'g'), chr(1)) AS parts FROM d" for i, p in enumerate(patterns.values()))
    classes = " UNION ALL ".join(f"SELECT {len(PATTERNS) + i} AS ord, {c.width} AS w, {c.bits} AS bits, {c.digits} AS digits, {c.uppers} AS uppers, {c.lowers} AS lowers, {c.letters} AS letters" for i, c in enumerate(CLASSES))
    labels = rf"(?i)\b(?:{'|'.join(ALLOWED_LABELS)}){quote}\s*[:=-]?\s*{quote}$"
    harmless = " OR ".join(f"contains(lower(substr(run, a + 1, b - a)), '{t}')" for t in ALLOWED_TEXTS)
    only = lambda what: f"length(regexp_replace(win, '[^{what}]', '', 'g'))"
    names = "CASE ord " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(kinds)) + " END"
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    marked AS ({marked}),
    parts AS (SELECT r, ord, unnest(parts) AS part, generate_subscripts(parts, 1) AS nth FROM marked WHERE len(parts) > 1),
    placed AS (SELECT r, ord, nth, split_part(part, chr(2), 1) AS run, sum(length(replace(part, chr(2), ''))) OVER (PARTITION BY r, ord ORDER BY nth) - length(replace(part, chr(2), '')) AS start FROM parts),
    found AS (SELECT * FROM placed WHERE nth > 1),
    base AS (SELECT r, ord, start, start + length(run) AS stop FROM found WHERE ord BETWEEN 1 AND 2 OR ord = 0 AND length(regexp_extract(run, '{patterns["assign"]}', 1)) >= 8),
    classes AS ({classes}),
    wins AS (SELECT r, f.ord, start, run, i, substr(run, i::BIGINT + 1, w) AS win, c.* EXCLUDE (ord) FROM (SELECT *, unnest(range(0, length(run) - (CASE ord {' '.join(f"WHEN {len(PATTERNS) + n} THEN {c.width}" for n, c in enumerate(CLASSES))} END) + 1)) AS i FROM found WHERE ord >= {len(PATTERNS)}) f JOIN classes c ON c.ord = f.ord),
    chars AS (SELECT r, ord, start, i, ch, count(*) AS n FROM (SELECT r, ord, start, i, unnest(string_split(win, '')) AS ch FROM wins) GROUP BY ALL),
    sums AS (SELECT r, ord, start, i, sum(n * log2(n)) AS s FROM chars GROUP BY ALL),
    good AS (SELECT r, ord, start, run, i, w FROM wins JOIN sums USING (r, ord, start, i) WHERE log2(w) - s / w >= bits - 1e-9 AND {only('0-9')} >= digits AND {only('A-Z')} >= uppers AND {only('a-z')} >= lowers AND {only('A-Za-z')} >= letters),
    islands AS (SELECT *, sum(fresh) OVER (PARTITION BY r, ord, start ORDER BY i) AS island FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY r, ord, start ORDER BY i) > w THEN 1 ELSE 0 END AS fresh FROM good)),
    stretches AS (SELECT r, ord, start AS run_start, run, min(i) AS a, max(i) + w AS b FROM islands GROUP BY r, ord, start, run, w, island),
    left_ AS (SELECT r, ord, run_start + a AS start, run_start + b AS stop FROM stretches JOIN d USING (r)
        WHERE NOT regexp_full_match(run, '{ALLOWED_RUNS[0]}') AND NOT regexp_matches(substr(text, greatest(run_start - {BEFORE}, 0)::BIGINT + 1, least({BEFORE}, run_start)::BIGINT), '{labels}') AND NOT ({harmless})),
    outer_ AS (SELECT * FROM left_ x WHERE NOT EXISTS (SELECT 1 FROM left_ y WHERE y.r = x.r AND y.start <= x.start AND y.stop >= x.stop AND (y.start < x.start OR y.stop > x.stop OR y.ord < x.ord))),
    every AS (SELECT *, {names} || ':' || start::BIGINT || ':' || stop::BIGINT AS span FROM (SELECT * FROM base UNION ALL SELECT * FROM outer_)),
    per AS (SELECT r, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex, string_agg(span, ',' ORDER BY start, ord) FILTER (ord < 3) AS base, string_agg(span, ',' ORDER BY start, ord) AS spans FROM every GROUP BY r)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN per USING (r)"""
