"""Exact search, page extraction, the registered queries and the pipeline."""

import html
import math
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from test_documents import brute_fingerprint, check_dedup, brute_mix, components
from tiepoint.llm import html_blocks, quality, queries, topk
from twins import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_twins(spark, name):
    assert compare(spark, "/root/testdata/sf0.01", queries.queries()[name], queries.oracle_sql()[name]) > 0


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_queries_return_all_rows(spark, name):
    table = "pages" if name.startswith("op7_") else "documents"
    assert queries.queries()[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def brute_top_k(rows, asks, k=5):
    """Scores of whole numbers by Python; rows are left out only from their own lists."""
    whole = [(n, i, [math.floor(256.0 * c) for c in v]) for n, (i, v) in enumerate(rows) if v is not None and all(c is not None and math.isfinite(256.0 * c) for c in v)]
    out = []
    for n, i, q in whole:
        if asks(i):
            best = sorted((-sum(a * b for a, b in zip(q, c, strict=False)), j is None, j or 0, m) for m, j, c in whole if m != n)[:k]
            out += [(i, r + 1, None if no else j, max(-(2**63), min(2**63 - 1, -s))) for r, (s, no, j, _) in enumerate(best)]
    return sorted(out, key=str)


def test_top_k_equals_brute_force_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 9)) * 0.3
    x[50:90] = x[0]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(300, None), (301, [float("nan")] * 9), (302, [None] * 9), (303, [float("inf")] + [0.0] * 8), (None, [9.0] * 9), (None, [0.1] * 9), (304, [0.5]), (305, []), (310, [1.0] * 12)]
    rows += [(20, [float(v) for v in x[20]]), (20, [2.0] * 9), (7, [float(v) for v in x[7]])]
    ask = F.col("vec_id") % 10 == 0
    df = lambda r: spark.createDataFrame([(*row, 0) for row in r], "vec_id long, embedding array<double>, score int")
    got = sorted((tuple(r) for r in topk.top_k(df(rows), ask).collect()), key=str)
    assert got == brute_top_k(rows, lambda i: i is not None and i % 10 == 0)
    wide = rows[:40] + [(n, [float(v) for v in rng.choice([1e9, -3e9, 300_000.0, 0.001, 5e15, 1e200, 1e306], 9)]) for n in range(1000, 1060, 5)]
    got = sorted((tuple(r) for r in topk.top_k(df(wide), ask).collect()), key=str)
    assert got == brute_top_k(wide, lambda i: i % 10 == 0)
    assert topk.top_k(df([]), ask).count() == 0
    assert [r["vec_id"] for r in topk.top_k(df(rows[10:12]), F.col("vec_id") == 10).collect()] == [11]


def test_top_k_sends_no_pairs_of_blocks_and_packs(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 6)) * 0.3
    x[100:] = x[:100]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    want = brute_top_k(rows, lambda i: i % 2 == 0)
    for name, value in (("BLOCK", 4), ("PACK", 2), ("CELLS", 8), ("MOST_TASKS", 5)):
        monkeypatch.setattr(topk, name, value, raising=False)
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 2 == 0)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # 50 blocks and 50 packs: no join that Spark could broadcast by the size before an explode, and no task for each of 2 500 pairs
    assert "Join" not in plan and max(int(n) for n in re.findall(r"RepartitionByExpression \[[^]]*\], (\d+)", plan)) <= 5
    assert sorted((tuple(r) for r in found.collect()), key=str) == want


def test_search_reads_less_than_all_and_is_exact():
    rng = np.random.default_rng(3)
    rows = np.floor(rng.normal(size=(5000, 24)) * 60)
    rows[:2500] = np.floor(rows[:2500] * 0.3)
    block = topk.Block(rows, topk.Block.order_of(rows))
    for n in range(0, 5000, 500):
        left = block.possible(rows[n], n, 5)
        scores = rows @ rows[n]
        scores[n] = -np.inf
        assert len(left) < 0.5 * len(rows) and set(np.nonzero(scores > np.sort(scores)[-5])[0]) <= set(left.tolist())


def test_labeller_gradients():
    rng = np.random.default_rng(2)
    model = html_blocks.Labeller({k: v.astype(np.float64) for k, v in html_blocks.Labeller.fresh(rng).w.items()})
    x, mask = rng.normal(size=(4, 3, html_blocks.DIMS)), np.array([[1, 1, 1], [1, 1, 1], [1, 0, 1], [0, 0, 1]], bool)
    y = rng.random((4, 3)) > 0.5
    _, grads = model.gradients(x, mask, y)
    for name in model.w:
        at = tuple(int(rng.integers(n)) for n in model.w[name].shape)
        slopes = []
        for step in (1e-3, -1e-3):
            model.w[name][at] += step
            slopes.append(model.gradients(x, mask, y)[0])
            model.w[name][at] -= step
        assert grads[name][at] == pytest.approx((slopes[0] - slopes[1]) / 2e-3, abs=2e-4)


def test_labeller_on_unseen_layouts():
    model = html_blocks.trained()
    held_out = html_blocks.training_set(150, seed=99)
    found = model.label([x for x, _ in held_out])
    assert np.mean(np.concatenate([a == y for a, (_, y) in zip(found, held_out, strict=True)])) > 0.98


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in html_blocks.extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:h1|p)>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])
    hard = spark.createDataFrame([(1, "u", None, 1), (1, "u", None, 1), (2, None, "", 1), (None, "u", "<p", 1), (4, "u", "<article><p>" + "word here, and more. " * 20000, 1), (5, "u", "<<<>>><a href='x>y'>&amp;&#x41;</p></div>" * 50, 1)], "page_id long, url string, html string, text int")
    got = html_blocks.extract(hard).collect()
    assert len(got) == 6 and {r["text"] for r in got if r["page_id"] in (1, 2)} == {""}
    assert [r["n_chars"] for r in got if r["page_id"] == 4] == [len("word here, and more. " * 20000) - 1]
    assert html_blocks.extract(hard.limit(0)).count() == 0


def test_pages_laid_out_as_tables():
    text = "The old harbour was quiet in the morning, and few boats left. " * 6
    model = html_blocks.trained()
    plain = f"<table><tr><td><a href=1>Home</a><br><a href=2>News</a><br><a href=3>About us</a></td><td><h1>Harbour</h1><p>{text}</p><p>{text}</p></td></tr></table>"
    named = f"<table><tr><td class=menu><ul><li><a href=1>Home</a></li></ul></td><td class=article><p>{text}</p></td></tr><tr><td class=footer>&copy; 2020 Someone</td></tr></table>"
    assert html_blocks.main_text([plain, named, ""], model) == [f"Harbour\n{text.strip()}\n{text.strip()}", text.strip(), ""]


def test_page_blocks():
    page = "<HTML><head><title>t</title><script>x='<p>no</p>'</script></head><body><!-- <p>no --><nav><a href=\"a>b\">one</a></nav><p>a &amp; b<br>c<p> d\n\t e <b>f</b></div><ul><li>x<li>y</ul>tail"
    assert [p.text for p in html_blocks.pieces_of(page)] == ["one", "a & b c", "d e f", "x", "y", "tail"]


def test_pipeline_equals_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    stages = dict(corpus_pipeline.STAGES)
    step = 0

    def apply(name, df):
        nonlocal step
        step += 1
        stages[name](spark, df, SF).write.parquet(str(tmp_path / str(step)))
        return spark.read.parquet(str(tmp_path / str(step)))

    import zlib

    rows = {r["doc_id"]: r for r in docs.collect()}
    stats = {i: np.array(quality.statistics_of(r["text"] or "")) for i, r in rows.items()}
    total = np.zeros((2, len(quality.STATISTICS) + 1, len(quality.STATISTICS) + 1))
    for i, q in labels.items():
        if i in stats and zlib.crc32(str(i).encode()) % 5:
            one = np.append(1, stats[i])
            total[q] += np.outer(one, one)
    model = quality.fit_moments(total)
    good = apply("quality", docs)
    assert good.columns == docs.columns
    assert {r["doc_id"] for r in good.collect()} == {i for i in rows if model.score(stats[i][None])[0] >= quality.THRESHOLD}

    edited = apply("line_dedup", good)
    want = {r["doc_id"]: r["text"] for r in edited.collect()}
    check_dedup([(r["doc_id"], r["text"]) for r in good.collect()], want)

    items = sorted(want.items())
    fps = [brute_fingerprint(t, corpus_pipeline.SHINGLE) for _, t in items]
    roots = components(len(items), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    single = apply("near_dedup", edited)
    assert sorted(r["doc_id"] for r in single.collect()) == sorted({items[r][0] for r in roots})

    source = [(r["doc_id"], r["source"], r["text"]) for r in single.collect()]
    size, _, target = brute_mix(source)
    mixed = apply("mix", single)
    assert mixed.columns == docs.columns
    taken = {}
    for r in mixed.collect():
        taken[r["source"]] = taken.get(r["source"], 0) + len(r["text"].encode().split())
    for s, t in target.items():
        assert abs(taken.get(s, 0) - t) <= max(n for (_, x, _), n in zip(source, size, strict=True) if x == s)

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = apply("tokens", mixed)
    text = {r["doc_id"]: r["text"] for r in mixed.collect()}
    found = tokens.collect()
    assert len(found) == mixed.count()
    for r in found:
        assert r["ids"] == exact.encode(text[r["doc_id"]], add_special_tokens=False).ids
    assert corpus_pipeline.run(spark, SF).count() == len(found)


def test_pipeline_stages_bear_hard_rows(spark, hard, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for n, df in enumerate((hard, hard.limit(0))):
        for name, stage in corpus_pipeline.STAGES:
            out = str(tmp_path / f"{n}-{name}")
            stage(spark, df, str(tmp_path)).write.parquet(out)
            kept = spark.read.parquet(out)
            assert name == "tokens" or kept.columns == df.columns
            df = kept
