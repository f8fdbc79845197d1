"""Collocations against counts of all phrases by plain loops."""

import random
import re
from collections import Counter

import pytest

from loomleaf.llm import collocations

DOCS = "doc_id long, text string, lang string, phrase string, n long"


def plain(docs, least, best, share=100):
    f, total = Counter(), Counter()
    for _, text, lang, *_ in docs:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    found = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    rows = {}
    for (lang, w), a in found.items():
        inside = any(p == lang and len(v) > len(w) and 100 * b >= share * a and any(v[i : i + len(w)] == w for i in range(len(v))) for (p, v), b in found.items())
        if not inside:
            score, _, left, right = min((1000 * a * total[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            rows.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), a, left, right, total[lang], score))
    return sorted((lang, i, p.decode(), *rest) for lang, rs in rows.items() for i, (_, _, p, *rest) in enumerate(sorted(rs)[:best], 1))


def made(seed):
    rng = random.Random(seed)
    docs = [(1, None, "en", None, 1), (2, "", None, None, 2), (3, " \t.", "en", None, 3), (4, "a " * 3000, "en", None, 4), (5, "Ab É a\tb" * 40, None, "x", 5), (5, "Ab É a\tb" * 40, None, "x", 5), (None, "x y", "und", None, None)]
    for i in range(6, 200):
        words = [rng.choice("aBcdéF") * rng.choice([1, 1, 2]) + rng.choice(["", "", ".", ",", "\n", "!"]) for _ in range(rng.choice([1, 4, 40]))]
        docs.append((i, rng.choice([" ", "\t", "  "]).join(words), rng.choice(["en", "en", "de", None, ""]), None, i))
    return docs


@pytest.mark.parametrize(("seed", "least", "slots", "pair_slots"), [(1, 2, 1 << 16, 1 << 16), (2, 5, 4, 8), (3, 20, 1 << 16, 2)])
def test_as_plain_counts(spark, seed, least, slots, pair_slots):
    """Also with tables so small that most words and pairs share slots."""
    docs = made(seed)
    got = collocations.collocations(spark.createDataFrame(docs, DOCS).repartition(5), least=least, best=30, slots=slots, pair_slots=pair_slots, share_rows=7)
    assert sorted(tuple(r) for r in got.collect()) == plain(docs, least, 30)


def test_smaller_share_covers_more(spark):
    docs = made(4)
    got = collocations.collocations(spark.createDataFrame(docs, DOCS), least=3, best=10**6, share=60)
    assert sorted(tuple(r) for r in got.collect()) == plain(docs, 3, 10**6, 60)


def test_products_beyond_64_bits(spark):
    phrases = spark.createDataFrame([("en", "a", 4 * 10**12), ("en", "b", 3 * 10**12), ("en", "a b", 2 * 10**12)], "lang string, phrase string, n long")
    got = collocations.scored(phrases, spark.createDataFrame([("en", 9 * 10**16)], "lang string, n long")).first()
    assert got.score == 1000 * 2 * 10**12 * 9 * 10**16 // (12 * 10**24)


def test_empty(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).collect() == []
    assert collocations.collocations(spark.createDataFrame([(1, None, None, None, 1)], DOCS)).collect() == []
