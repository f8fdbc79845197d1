"""Operators against plain forms of themselves, and on empty, null and repeated rows."""

import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from loomleaf.llm import bpe, embeddings, html_extract, line_dedup, mixing, near_copies, quality, simhash, toxicity  # noqa: E402

WHERE = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
DOCS = "doc_id long, text string, lang string, source string, _row string, score double"
ROWS = [(1, "a few words here", "en", "s", "x", 1.0), (2, None, None, None, None, None), (3, "", "en", "s", "x", 1.0), (1, "a few words here", "en", "s", "x", 1.0), (4, "word " * 30000, "en", "t", None, 2.0)]


def test_bpe_as_library():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(WHERE[0], "rb"))}
    library = tiktoken.Encoding("own", pat_str=WHERE[1], mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    texts = ["", "a" * 2000, "日本語 ééé\n\n  x <|endoftext|>"] + ["".join(rng.choice("abcth e\n1é'") for _ in range(400)) for _ in range(40)]
    vocabulary = bpe.Vocabulary(*WHERE)
    ids = vocabulary.encode(texts)
    assert ids == [library.encode_ordinary(t) for t in texts]
    assert [vocabulary.decode(i).decode() for i in ids] == texts


def test_golay_keys_miss_no_pair():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 2000).astype(np.uint64)
    flips = [(1 << int(i)) ^ (1 << int(j)) for i, j in rng.integers(0, 64, (2000, 2))]
    other = base ^ np.array(flips, np.uint64)
    at, key = simhash.keys(base, False)
    to, near = simhash.keys(other, True)
    found = set(zip(to.tolist(), near.tolist()))
    assert {i for i, k in zip(at.tolist(), key.tolist()) if (i, k) in found} == set(range(2000))


def test_simhash_components(spark):
    from pyspark.sql import functions as F

    prints = spark.createDataFrame([(0b1,), (0b111,), (0b11111,), (1 << 40,), (-1,)], "fp long")
    assert {tuple(r) for r in simhash.links(prints).select(F.least("a", "b"), F.greatest("a", "b")).collect()} == {(1, 7), (7, 31), (1, 1 << 40)}
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(ROWS, DOCS)).collect()}
    assert got == {(1, 1), (2, 2), (3, 2), (4, 4)}


def test_near_copies_as_brute_force(spark):
    """Also through the pipeline's stage: copies with a few words changed differ in more than two bits of a fingerprint."""
    import corpus_pipeline

    rng = random.Random(5)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([4, 5, 9, 40, 200, 900]))]
        for _ in range(12):
            other = list(base)
            for _ in range(rng.randrange(1 + len(other) // 30)):
                other[rng.randrange(len(other))] = f"x{rng.randrange(9)}"
            texts.append(" ".join(other[: len(other) - rng.randrange(1 + len(other) // 10)]))
    texts += ["", None, "a b", "A  b"]
    runs = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for t in texts]
    group = list(range(len(texts)))
    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if runs[i] == runs[j] or 10 * len(runs[i] & runs[j]) >= 8 * len(runs[i] | runs[j])]
    for i, j in pairs:
        group = [group[i] if g == group[j] else g for g in group]
    want = {i: min(j for j, h in enumerate(group) if h == g) for i, g in enumerate(group)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_copies.near_duplicates(docs).collect()} == want
    assert sorted(r.doc_id for r in corpus_pipeline.near_stage(spark, docs, "").collect()) == sorted(set(want.values())) != sorted(want)
    assert sorted(r.doc_id for r in near_copies.kept(spark.createDataFrame(ROWS, DOCS)).collect()) == [1, 2, 4]
    assert near_copies.near_duplicates(docs.limit(0)).count() == 0


def test_near_copies_shuffle_no_sets_for_repeats(spark, monkeypatch):
    """Repeated rows and texts that share an id change nothing, and sets of shingles are not shuffled to find repeats."""
    plans, put = {}, near_copies.stored
    monkeypatch.setattr(near_copies, "stored", lambda df, name: (plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()), put(df, name))[1])
    words = [f"w{i}" for i in range(60)]
    near = " ".join([*words[:-1], "other"])
    rows = [(1, " ".join(words)), (1, " ".join(words)), (1, "  ".join(words)), (1, "quite another text of more than five words"), (2, near), (2, near), (3, "alone in the world it is")]
    got = near_copies.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1)] * 4 + [(2, 1)] * 2 + [(3, 3)]
    assert "Exchange" in plans["sets"] and "Exchange" not in plans["sets"].split("MapInArrow")[0]


def test_line_dedup(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"one\n{passage}\ntwo"), (2, f"three\n{passage}"), (3, "short\nline"), (4, "short\nline"), (5, None)]
    got = {r.doc_id: r.text for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "three", 3: "short\nline", 4: "short\nline", 5: None}
    assert all(" ".join(line_dedup.chunks(t)).split() == t.split() for t in ["", "\n\n", "a\n", f"{passage}\n\nb", "x" * 100_000, "é ü\nz"])


def test_main_text(spark):
    page = "<nav><a>menu</a></nav><article><h1>T</h1><p>one <b>two</b>&amp;<p>three<div class='comments'><p>said</div></article><footer>f</footer>"
    plain = "<div class=top>Same on each</div><div class=text>Only here {}</div>"
    rows = [(0, "http://a/x", page), (1, None, None), *((i, "http://b/x", plain.format(i)) for i in range(2, 12))]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: "T one two& three", 1: "", **{i: f"Only here {i}" for i in range(2, 12)}}


def test_tree_holds_pages_with_articles(spark):
    """A teaser is the only article element, and a line within articles says the same on each page."""
    teaser = "<article><p>Teaser for all</p></article><div class=text>Main text {}</div><div class=top>Same on each</div>"
    inside = "<div class=top>Same on each</div><article><p>Main text {}</p><div class=note>Sign up now</div></article>"
    rows = [(i, f"http://{'ab'[i % 2]}/x", (teaser, inside)[i % 2].format(i)) for i in range(20)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Main text {i}" for i in range(20)}


def test_embeddings_as_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16))
    all_ = np.concatenate([base, base[:20] + 0.03 * rng.standard_normal((20, 16)), base[:5]])
    rows = [(i, [float(x) for x in v], i % 40 % 3) for i, v in enumerate(all_)] + [(100, None, 1), (101, [0.0] * 16, 1), (102, [float("nan")] * 16, 1)]
    unit = all_ / np.linalg.norm(all_, axis=1)[:, None]
    label = np.arange(len(all_)) % 40 % 3
    close = (unit @ unit.T >= 0.98) & (label[:, None] == label[None, :])
    want = {i: int(close[i].sum()) - 1 for i in range(len(all_))} | {100: 0, 101: 0, 102: 0}
    found = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), cell=8).collect()
    assert {r.vec_id: r.n_links for r in found} == want
    assert all(r.component_id == min([j for j in range(len(all_)) if close[r.vec_id, j]]) for r in found if r.vec_id < 40)


def test_models_learn_and_take_odd_rows(spark):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "rho"]
    texts = [[rng.choice(words) for _ in range(40)] for _ in range(300)]
    y = np.array([i % 2 for i in range(300)], np.float32)
    for t, bad in zip(texts, y):
        if bad:
            t[rng.randrange(40)] = "stupid"
    scorer = toxicity.Scorer(toxicity.Network().fit(texts, y))
    assert ((scorer.score([" ".join(t) for t in texts]) >= 0.5) == (y == 1)).mean() > 0.95
    x = np.array([quality.features(" ".join(t) + (" $$$ ###" if bad else "")) for t, bad in zip(texts, y)])
    assert ((quality.Additive.fit(x, y).score(x) >= 0.5) == (y == 1)).mean() > 0.95
    docs, labels = spark.createDataFrame(ROWS, DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score(docs, quality.train(docs, labels)).count() == toxicity.score(docs, toxicity.train(docs, labels)).count() == 5


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    assert [f.count() for f in (simhash.near_duplicates(docs), line_dedup.dedup(docs), mixing.mix(docs), bpe.encode(docs, *WHERE))] == [0, 0, 0, 0]
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert found.where("NOT round_trip").count() == 0 and found.count() > 0
