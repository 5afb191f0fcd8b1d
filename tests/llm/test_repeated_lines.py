"""Line deduplication leaves no line of five words that an earlier document has."""

import random

import pytest

from tiepoint.llm import linededup

L, M = "a line that has six words", "another line of at least five words"


@pytest.mark.parametrize(
    ("later", "earlier", "gone"),
    [
        (["x", L, "y", L, "z"], ["p", L, "q"], [1, 3]),
        (["x", L, "s", M, "y"], ["p", L, "s", M, "q", L, "s", M, "r"], [1, 2, 3]),
        ([L, "s", "t", "u"], ["s", "t", "u", L], [0]),
        (["x", "s", L, "y", "s", L, "t", "z"], ["s", L, "t", L, "v"], [1, 2, 4, 5, 6]),
    ],
)
def test_repeated_and_crossing_lines_go(later, earlier, gone):
    assert linededup.common_blocks(later, earlier, [x in (L, M) for x in later]) == gone


def test_against_brute_force(spark):
    rng = random.Random(3)
    lines = [f"long line {i} with many words" for i in range(12)] + ["short", "tiny", ""]
    docs = [(i, "\n".join(rng.choices(lines, k=rng.randint(1, 6)) + [f"own line {i} of this document"])) for i in range(60)]
    seen, want = set(), {}
    for i, t in docs:
        want[i] = [x for x in t.split("\n") if len(x.split()) >= 5 and x not in seen]
        seen |= set(t.split("\n"))
    got = linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: [x for x in r["text"].split("\n") if len(x.split()) >= 5] for r in got} == want


@pytest.mark.parametrize("copies", [900, 1100])
def test_how_often_a_line_occurs_changes_nothing(spark, copies):
    block = f"{L}\nshort one\n{M}"
    docs = spark.createDataFrame([(i, f"own words of document number {i}\n{block}\nits end") for i in range(copies)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs).collect()}
    assert got[0].count(block) == 1 and all(got[i] == f"own words of document number {i}" for i in range(1, copies))


def test_a_long_document_whose_lines_many_others_share(spark):
    import time

    lines = [f"line number {i} of a long document" for i in range(50_000)]
    docs = [(0, "\n".join(lines))] + [(i, f"{lines[i * 7]}\nwords that only number {i} has\n{lines[i * 9]}") for i in range(1, 5001)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    began = time.time()
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(df).collect()}
    assert got[0] == docs[0][1] and all(got[i] == f"words that only number {i} has" for i in range(1, 5001))
    assert time.time() - began < 60
