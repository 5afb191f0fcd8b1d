"""The pipeline's near_dedup stage keeps one row of each group, whatever the ids."""

import random

import corpus_pipeline
from test_documents import brute_fingerprint, components

SCHEMA = "doc_id long, text string"


def kept(spark, rows):
    return sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()), key=str)


def test_null_and_repeated_ids_lose_no_group(spark):
    texts = [" ".join(f"{name}{i}" for i in range(40)) for name in ("ant", "bee", "cow", "dog", "elk")]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (8, texts[4]), (9, texts[0]), (10, texts[3]), (10, texts[3])]
    want = [(None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (9, texts[0])]
    assert kept(spark, rows) == sorted(want, key=str)
    assert kept(spark, []) == []


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_copies_beyond_two_bits_are_found(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for n in (30, 60, 120, 300, 700):
        base = rng.choices(vocabulary, k=n)
        for edits in (0, 0, 1, 1, 2, 3, 5, 8, 13):
            words = list(base)
            for at in rng.sample(range(n), edits):
                words[at] = "edit" + str(rng.randrange(10**6))
            rows.append((len(rows), " ".join(words)))
    sets = [shingles(t) for _, t in rows]
    fps = [brute_fingerprint(t, 5) for _, t in rows]
    near = lambda i, j: 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    far = sum(near(i, j) and (fps[i] ^ fps[j]).bit_count() > 2 for i in range(len(rows)) for j in range(i))
    assert far > 20
    roots = components(len(rows), lambda i, j: near(i, j) or (fps[i] ^ fps[j]).bit_count() <= 2)
    assert 5 < len(set(roots)) < len(rows) - 20
    assert kept(spark, rows) == sorted((rows[r] for r in set(roots)), key=str)
