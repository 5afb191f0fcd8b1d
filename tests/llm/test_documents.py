"""Operators on documents against brute force, and on rows that are hard to bear."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

from tiepoint.llm import bpe, language, linededup, mixing, ngram_lm, quality, simhash, spotsigs
from tiepoint.llm.common import connected_components

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fold(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def components(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute_fingerprint(text, k):
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    counts = Counter(b for p in parts for h in [xxh64_intdigest(p, 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(parts))


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150), (300, 300), (None, 4)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(links).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 100, 150: 100}
    assert connected_components(links.limit(0)).count() == 0


@pytest.mark.parametrize("k", [3, 5])
def test_simhash(spark, documents, hard, k):
    for df in (documents, hard):
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        fps = [brute_fingerprint(t, k) for _, t in rows]
        roots = components(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
        least = {}
        for r, (i, _) in zip(roots, rows, strict=True):
            if i is not None:
                least[r] = min(least.get(r, i), i)
        want = sorted((str(i), f, str(least.get(r))) for (i, _), f, r in zip(rows, fps, roots, strict=True))
        got = sorted((str(r["doc_id"]), r["fp"] % (1 << 64), str(r["component_id"])) for r in simhash.near_duplicates(df, shingle=k).collect())
        assert got == want
    assert simhash.near_duplicates(hard.limit(0)).count() == 0


@pytest.mark.parametrize("busy", [1, 3, 64])
def test_segment_tables_connect_all_that_is_close(spark, busy):
    rng = np.random.default_rng(busy)
    fps = set()
    for _ in range(12):
        centre = int(rng.integers(1 << 63)) * 2 + int(rng.integers(2))
        for _ in range(25):
            x = centre
            for bit in rng.integers(64, size=int(rng.integers(4))).tolist():
                x ^= 1 << bit
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = {tuple(sorted((signed.index(r["a"]), signed.index(r["b"])))) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), busy).collect()}
    near = lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2
    assert all(near(*p) for p in got)
    assert components(len(fps), lambda i, j: (j, i) in got) == components(len(fps), near)


def test_no_exploded_fingerprints_are_broadcast(spark):
    # grouped, so that Spark knows the size before the explode, which is small enough
    found = simhash.links(spark.range(5000).select(F.xxhash64("id").alias("fp")).distinct())
    assert found.count() == 0
    found.collect()
    depth = None
    for line in found._jdf.queryExecution().executedPlan().toString().splitlines():
        at = len(line) - len(line.lstrip(" :+-"))
        depth = at if "BroadcastExchange" in line else None if depth is not None and at <= depth else depth
        assert depth is None or "Generate" not in line


def brute_mix(rows):
    size = [len((t or "").encode().split()) for _, _, t in rows]
    sums = defaultdict(int)
    for (_, s, _), n in zip(rows, size, strict=True):
        sums[s] += n
    names = sorted(sums, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    low, high = 0.0, 1e18  # the level at which the sources together make up the total
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(3 * sums[s], mid * weight[s]) for s in names) < sum(size) else (low, mid)
    target = {s: min(3 * sums[s], high * weight[s]) for s in names}
    return size, sums, target


def test_mixing(spark, documents, hard):
    for df in (documents, hard):
        rows = [(r["doc_id"], r["source"], r["text"]) for r in df.collect()]
        size, sums, target = brute_mix(rows)
        got = mixing.mix(df.drop("mix")).select("doc_id", "source", "mix.*", mixing.size_of(F.col("text")).alias("size")).collect()
        assert sorted(r["size"] for r in got) == sorted(size)
        taken = defaultdict(int)
        for r in got:
            assert r["source_size"] == sums[r["source"]] and math.isclose(r["target"], target[r["source"]], rel_tol=1e-9)
            assert r["copies"] <= 3
            taken[r["source"]] += r["copies"] * r["size"]
        for s, t in target.items():
            assert abs(taken[s] - t) <= max(n for (_, x, _), n in zip(rows, size, strict=True) if x == s)
        again = mixing.mix(df.drop("mix").repartition(5)).select("doc_id", "mix.copies")
        assert sorted(map(str, again.collect())) == sorted(str(r) for r in mixing.mix(df.drop("mix")).select("doc_id", "mix.copies").collect())
    assert mixing.mix(hard.drop("mix").limit(0)).count() == 0


def test_mixing_cuts_among_null_ids_and_equal_rows(spark):
    rows = [(None, "a", f"w{i} x y z v") for i in range(2000)] + [(i, "b", "one two three") for i in range(3000)] + [(None, "c", "equal rows of five words")] * 900 + [(None, "d", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("mix", F.lit(1))
    size, sums, target = brute_mix(rows)
    mixed = mixing.mix(df)
    assert mixed.columns == [*df.columns, "_mix"]
    got = mixed.select("source", "_mix.copies", mixing.size_of(F.col("text")).alias("size")).toPandas()
    assert len(got) == len(rows)
    taken = (got["copies"] * got["size"]).groupby(got["source"]).sum()
    for s, t in target.items():
        assert abs(taken[s] - t) <= 5
    again = mixing.mix(df.repartition(7)).select("doc_id", "source", "text", "_mix.copies").toPandas()
    once = mixed.select("doc_id", "source", "text", "_mix.copies").toPandas()
    order = list(once.columns)
    assert once.sort_values(order, ignore_index=True).equals(again.sort_values(order, ignore_index=True))


def test_targets_are_shared_again():
    assert mixing.targets_of({"a": 10, "b": 1000, None: 1}) == {"a": 30.0, "b": pytest.approx(978), None: 3.0}
    assert mixing.targets_of({}) == {} and mixing.targets_of({"a": 0}) == {"a": 0.0}


def test_quality(spark, documents, hard, labels):
    known = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = quality.classify(docs, known).join(known, "doc_id").where("held_out").select("score", "predicted", "quality").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.97 and got["score"].between(0, 1).all()
    assert got[got["quality"] == 1]["predicted"].mean() > 0.98
    rows = quality.classify(hard, labels).collect()
    assert len(rows) == hard.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (fold(r["doc_id"], 5) == 0) for r in rows)
    assert {r["score"] for r in quality.classify(hard, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(hard.limit(0), labels).count() == 0


def test_quality_equals_brute_force(spark, documents):
    """Training rows, labels and threshold: a model of the plain choice of rows gives the same answers."""
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    label = {r["doc_id"]: r["quality"] for r in labels.collect()}
    total = np.zeros((2, len(quality.STATISTICS) + 1, len(quality.STATISTICS) + 1))
    for i, y in label.items():
        if i in rows and y in (0, 1) and fold(i, 5):
            one = np.append(1, quality.statistics_of(rows[i]))
            total[y] += np.outer(one, one)
    model = quality.fit_moments(total)
    got = quality.classify(documents, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        score = model.score(np.array([quality.statistics_of(rows[r["doc_id"]])]))[0]
        assert r["score"] == pytest.approx(score, abs=1e-6) and r["held_out"] == (fold(r["doc_id"], 5) == 0)
        assert r["predicted"] == int(r["score"] >= 0.3)


def test_quality_statistics():
    """Counted by hand."""
    at = dict(zip(quality.STATISTICS, quality.statistics_of("The cat sat. The cat sat.\nNo 42!"), strict=True))
    assert at["words"] == pytest.approx(math.log(9)) and at["lines"] == pytest.approx(math.log(3) - 0.5 * math.log(9))
    assert at["distinct"] == pytest.approx(math.log(25 / 28)) and at["commonest"] == pytest.approx(math.sqrt(3 / 28))
    assert at["digits"] == pytest.approx(math.sqrt(2 / 72)) and at["upper"] == pytest.approx(math.sqrt(4 / 72))
    assert at["longest"] == pytest.approx(math.log(14)) and at["repeated_lines"] == 0
    assert quality.statistics_of("")[0] == 0


def test_quadratic_discriminant_is_a_density_ratio():
    rng = np.random.default_rng(1)
    d = len(quality.STATISTICS)
    x = {0: rng.normal(1, 2, (500, d)), 1: rng.normal(0, 1, (900, d))}
    total = np.array([np.hstack([np.ones((len(v), 1)), v]).T @ np.hstack([np.ones((len(v), 1)), v]) for v in x.values()])
    model = quality.fit_moments(total, shrinkage=0.1, floor=0.0)
    probe = rng.normal(0, 1, (20, d))
    logs = []
    for v in x.values():
        cov = np.cov(v.T, bias=True)
        shrunk = 0.9 * cov + 0.1 * np.diag(np.diag(cov))
        e = probe - v.mean(axis=0)
        logs.append(math.log((len(v) + 1) / 1402) - 0.5 * np.linalg.slogdet(shrunk)[1] - 0.5 * np.einsum("ij,jk,ik->i", e, np.linalg.inv(shrunk), e))
    assert np.allclose(model.score(probe), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_language(spark, hard):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").select("lang_pred", "lang", "score").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.97 and got["score"].between(0, 1).all()
    rows = language.identify(hard).collect()
    assert len(rows) == hard.count()
    text = {r["doc_id"]: r["text"] for r in hard.collect()}
    for r in rows:
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text[r["doc_id"]] or "")) and r["held_out"] == (fold(r["doc_id"], 3) == 1)
    assert {r["lang_pred"] for r in language.identify(hard.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.identify(hard.limit(0)).count() == 0


def test_language_of_many_characters(spark):
    """A language whose trigrams hardly repeat, beside one that shares its characters and is more frequent."""
    rng = np.random.default_rng(5)
    han = np.array([chr(0x4E00 + i) for i in rng.permutation(8000)[:3000]])
    kana = np.array([chr(0x3042 + i) for i in range(70)])
    latin = np.array(list("etaoinshrdlu"))
    zipf = lambda letters, n: "".join(letters[np.minimum(rng.zipf(1.3, n), len(letters)) - 1])
    mixed = lambda n: "".join((zipf(kana, 3) if rng.random() < 0.7 else zipf(han[:800], 2)) for _ in range(n // 3))
    rows = [(i, zipf(han, 60), "zh") if i % 4 == 0 else (i, mixed(90), "ja") if i % 4 < 3 else (i, " ".join(zipf(latin, 5) for _ in range(20)), "en") for i in range(1600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.identify(df).where("held_out").join(df, "doc_id").groupBy("lang").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")).alias("right")).collect()
    assert all(r["right"] >= 0.97 for r in got), got


def test_language_equals_brute_force(spark, documents, hard):
    """Exact sets in place of the filter: the same language wherever one is clearly ahead."""
    for df in (documents, hard):
        rows = [(r["doc_id"], (r["text"] or "").lower(), r["lang"], r["text"] is None) for r in df.collect()]

        def grams(t):
            marked = [c if c.isalpha() else " " for c in f" {t} "]
            return [x for i in range(1, len(marked) - 1) if marked[i] != " " for x in ("".join(marked[i - 1 : i + 2]), marked[i])]

        counts, totals = defaultdict(Counter), Counter()
        for i, t, lang, null in rows:
            if fold(i, 3) != 1 and lang is not None and not null:
                counts[lang].update(grams(t))
                totals[lang] += len(grams(t)) // 2
        share = {n: {g: c / totals[n] for g, c in of.items()} for n, of in counts.items()}
        kept = {n: {g for g, x in of.items() if x >= 0.2 * max(o.get(g, 0) for o in share.values())} for n, of in share.items()}
        found = defaultdict(list)
        for i, t, _, _ in rows:
            own = grams(t)
            hits = sorted(((sum(g in kept[n] for g in own) / max(1, len(own)), n) for n in kept), reverse=True)
            found[str(i)].append((hits, bool(own)))
        for r in language.identify(df).collect():
            hits, any_letter = found[str(r["doc_id"])][0]
            if not any_letter:
                assert r["lang_pred"] == "und" and r["score"] == 0
            elif len(hits) == 1 or hits[0][0] - hits[1][0] > 0.03:
                assert hits[0][0] == 0 or r["lang_pred"] == hits[0][1]
                assert r["score"] == pytest.approx(hits[0][0], abs=0.03)


def test_language_filter_has_no_false_negatives():
    rng = np.random.default_rng(2)
    grams = {f"l{i}": rng.integers(0, 1 << 60, 300).astype(np.uint64) for i in range(70)}
    f = language.Filter.build(grams)
    for i, name in enumerate(f.languages):
        assert ((f.members(grams[name])[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).all()
    other = rng.integers(0, 1 << 60, 20000).astype(np.uint64)
    seen = np.mean([((f.members(other)[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(70)])
    assert abs(seen - f.false_rate.mean()) < 0.01


def test_bpe(spark, documents, hard):
    path = public_tokenizers.path("byte_bpe_50k.json")
    exact = Tokenizer.from_file(path)
    for df in (documents, hard):
        text = defaultdict(list)
        for r in df.collect():
            text[r["doc_id"]].append(r["text"] or "")
        for r in bpe.encode(df, path, with_ids=True).collect():
            ids = exact.encode(text[r["doc_id"]][0], add_special_tokens=False).ids
            assert r["ids"] == ids and r["n_tokens"] == len(ids)
            assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(exact.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode(hard.limit(0), path).count() == 0


def test_bpe_words_that_fail_the_check_are_merged_exactly():
    codec = bpe.Codec(public_tokenizers.path("byte_bpe_50k.json"))
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(3)
    words = sorted({"".join(rng.choice(list("aethinsroulé"), int(rng.integers(1, 90)))) for _ in range(3000)})
    failed = codec.learn(words)
    assert 0 < failed < len(words)
    assert [list(codec._known[w]) for w in words] == [exact.encode(w, add_special_tokens=False).ids for w in words]
    assert [codec.merge_exactly(w.encode()) for w in words] == codec.merge_together([w.encode() for w in words])


def brute_scores(rows):
    """Interpolated absolute discounting of orders three and two over the base."""
    tokens = [(i, [*(t or "").encode().translate(LOWER).split(), None]) for i, t in rows]
    count, pair, triple = Counter(), Counter(), Counter()
    for i, w in tokens:
        if fold(i, 10):
            count.update(w)
            pair.update(zip(["start", *w], w, strict=False))
            triple.update(zip(["start", *w], w, w[1:], strict=False))
    total, distinct = sum(count.values()), len(count)
    after, kinds = Counter(), Counter()
    for seen in (pair, triple):
        for gram, n in seen.items():
            after[gram[:-1]] += n
            kinds[gram[:-1]] += 1
    for i, w in tokens:
        base = full = 0.0
        for n, x in enumerate(w):
            before = (["start", *w[:n]])[-2:]
            p = (count[x] + 0.1) / (total + 0.1 * (distinct + 1))
            base += math.log10(p)
            for context in (tuple(before[-1:]), tuple(before))[: len(before)]:
                if after[context]:
                    seen = (pair if len(context) == 1 else triple)[(*context, x)]
                    p = max(seen - 0.75, 0) / after[context] + 0.75 * kinds[context] / after[context] * p
            full += math.log10(p)
        yield str(i), fold(i, 10) == 0, len(w), sum(count[x] > 0 for x in w), total, base, full


def test_language_model(spark, documents, hard):
    for df in (documents, hard, hard.where("doc_id is null")):
        want = sorted(brute_scores([(r["doc_id"], r["text"]) for r in df.collect()]))
        got = sorted((str(r["doc_id"]), *(r[c] for c in ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"))) for r in ngram_lm.train_and_score(df).collect())
        assert [g[:5] for g in got] == [w[:5] for w in want]
        for g, w in zip(got, want, strict=True):
            assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], abs=6e-4 * w[2])
    assert ngram_lm.train_and_score(hard.limit(0)).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(4)
    for n, universe in ((0, 10), (1, 1 << 50), (5000, 6000), (5000, 1 << 55), (3000, 100)):
        v = np.sort(rng.integers(0, universe, n)).astype(np.uint64)
        e = ngram_lm.EliasFano.build(v, universe)
        assert np.array_equal(e.access(np.arange(n)), v)
        probe = np.concatenate([v, rng.integers(0, universe, 500).astype(np.uint64)])
        found = e.find(probe)
        assert np.array_equal(found >= 0, np.isin(probe, v))
        assert np.array_equal(v[found[found >= 0]], probe[found >= 0])


def spark_rows(df, rows):
    return df.sparkSession.createDataFrame(rows, "doc_id long, text string")


def test_long_repeated_lines_take_linear_time():
    import time

    began = time.time()
    n = 50_000
    assert len(linededup.common_blocks([1] * n, [2] + [1] * (n // 2) + [3] + [1], [True] * n)) == n
    moved = list(range(n))
    assert linededup.common_blocks(moved, [x for at in range(n // 2) for x in (moved[n - 1 - at], moved[at])], [True] * n) == moved
    assert time.time() - began < 10


def check_dedup(rows, kept):
    """Against a plain rule: of lines of five words those go that an earlier document has, and no others; short lines go only beside such lines."""
    worth = lambda x: len(x.encode().split()) >= 5
    seen = set()
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        lines, left = (t or "").split("\n"), (kept[i] or "").split("\n")
        want = [x for x in lines if worth(x) and x not in seen]
        assert [x for x in left if worth(x)] == want
        if len(want) == sum(map(worth, lines)):
            assert kept[i] == t
        it = iter(lines)
        assert kept[i] in ("", None) or all(any(x == y for y in it) for x in left)  # in their order
        short, alone = Counter(x for x in lines if not worth(x)), Counter(x for x in left if not worth(x))
        assert kept[i] == "" or not alone - short
        seen.update(filter(worth, lines))


def test_line_dedup(spark, documents, hard):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: r for r in linededup.dedup_lines(docs).collect()}
    check_dedup(rows, {i: r["text"] for i, r in got.items()})
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert sum(r["text"] == "" for r in got.values()) > 0
    # the groups' size changes nothing
    lines = {r["doc_id"]: r["text"] for r in docs.join(linededup.repeated_lines(docs, group=2).select(F.col("doc.key").alias("doc_id"), "gone"), "doc_id", "left").select("doc_id", linededup._without(F.col("text"), F.coalesce("gone", F.array().cast("array<int>"))).alias("text")).collect()}
    assert lines == {i: r["text"] for i, r in got.items()}
    kept = linededup.dedup_lines(hard)
    assert kept.columns == hard.columns and kept.count() == hard.count()
    text = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert text[2] == "" and text[3] is None and text[4] == "" and text[9] == "der hund und die katze " * 3000
    assert linededup.dedup_lines(hard.limit(0)).count() == 0
    line = "one line of five words"
    lone = hard.limit(0).select("doc_id", "text").union(spark_rows(hard, [(None, line), (None, line + "\nmore"), (7, line), (7, line), (7, line + "!")]))
    assert sorted(r["text"] for r in linededup.dedup_lines(lone).collect()) == sorted(["", "more", line, line, line + "!"])


def test_patience_diff():
    a, b = list("xabcyabz"), list("qabcab")
    found = linededup.align(a, b)
    assert all(a[i] == b[j] for i, j in found) and found == sorted(found) and len({j for _, j in found}) == len(found)
    assert linededup.align([], b) == [] and linededup.align(a, a) == [(i, i) for i in range(len(a))]
    assert linededup.common_blocks(list("cab"), list("abc"), [True] * 3) == [0, 1, 2]


def test_spotsigs(spark, documents, hard):
    rows = {(r["doc_id"], r["text"]): r for r in hard.collect()}
    got = spotsigs.edited_likeness(hard).collect()
    assert len(got) == len(hard.collect())
    by = {r["doc_id"]: r for r in got}
    assert by[1]["fingerprint"] == by[2]["fingerprint"] and by[3]["fingerprint"] == "" == by[4]["fingerprint"]
    assert by[2]["near_next"] == 1.0 and by[4]["near_next"] == 1.0 and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    order = sorted([r["doc_id"] for r in rows.values() if r["doc_id"] is not None], reverse=True)
    text = {r["doc_id"]: r["text"] or "" for r in rows.values()}
    for i, nxt in ((11, 10), (8, 6), (2, 1)):
        n = len(text[i])
        edited = text[i][: n - n // 2] + text[nxt][: n // 2]
        assert by[i]["n_chars"] == n and by[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert order[0] == 11
    one = spotsigs.edited_likeness(hard.where("doc_id = 1")).first()
    assert one["near_next"] == 1.0
    assert spotsigs.edited_likeness(hard.limit(0)).count() == 0


def test_spotsigs_classes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 400")
    rows = sorted((r["doc_id"], frozenset(r["s"])) for r in docs.select("doc_id", spotsigs.fingerprint(F.col("text")).alias("s")).collect())
    roots = components(len(rows), lambda i, j: (1.0 if rows[i][1] == rows[j][1] else len(rows[i][1] & rows[j][1]) / max(1, len(rows[i][1] | rows[j][1]))) >= 0.8)
    got = {r["doc_id"]: r["class_id"] for r in spotsigs.near_duplicates(docs).collect()}
    assert got == {rows[i][0]: rows[r][0] for i, r in enumerate(roots)}
    assert len(set(got.values())) < len(got)
