"""The filter audit against a plain run of all orders."""

import random
import re
from itertools import permutations

import pytest

from loomleaf.llm import filter_audit

DOCS = "doc_id long, text string, lang string, source string, mask string, good string"


def plain(docs, labels):
    good, toxic = {d for d, q, t in labels if q == 1} - {None}, {d for d, q, t in labels if t == 1} - {None}
    told = []
    for d, text, lang, *_ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
            "E": d is not None and any(o is not None and o < d and (t or "") == text for o, t, *_ in docs),
        }
        told.append((lang or "", {k for k, bad in fails.items() if bad}, d in good, d in toxic))
    rows, removed_by = {}, {}
    for part in {p for p, *_ in told}:
        for order in map("".join, permutations("ABCDE")):
            left = [x for x in told if x[0] == part]
            before = []
            for step, f in enumerate(order, 1):
                out = [x for x in left if f in x[1]]
                redundant = sum(f in x[1] for x in before)
                left, before = [x for x in left if f not in x[1]], before + out
                removed_by[part, f] = removed_by.get((part, f), 0) + len(out)
                unique = sum(x[0] == part and x[1] == {f} for x in told)
                rows[part, order, step] = (len(left), len(out), redundant, unique, sum(x[2] for x in out), sum(x[3] for x in out))
    return {(*k, *v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in rows.items()}


def made(seed):
    rng = random.Random(seed)
    docs = [(1, None, None, None, "x", None), (2, "", "en", "s", None, "y"), (None, "", "en", "s", None, None), (3, "Abc $", "en", "s", None, None), (3, "Abc $", "en", "s", None, None), (3, "Abc $", "de", "t", None, None), (4, "w " * 50000, "en", "s", None, None)]
    for i in range(5, 60):
        words = [rng.choice("ab Cd e# é日 K|".split(" ")) + str(rng.randrange(rng.choice([3, 400]))) for _ in range(rng.choice([1, 5, 199, 200, 300]))]
        docs.append((i, rng.choice([" ", "\t", "\n", " "]).join(words), rng.choice(["en", "de", None, ""]), "s", "m", "g"))
    docs += [(d + 1000, *rest) for d, *rest in docs[5:25]]
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1])) for d, *_ in docs if rng.random() < 0.6] + [(None, 1, 1), (10**9, 1, 1)]
    return docs, labels


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_as_plain_runs(spark, seed):
    docs, labels = made(seed)
    found = filter_audit.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == plain(docs, labels)


def test_sums_invert(spark):
    rows = [("p", m, 0, 0) for m in range(32) for _ in range(m * m % 7)]
    sums = filter_audit.parity_sums(spark.createDataFrame(rows, "part string, mask int, good int, toxic int"))
    assert filter_audit.cells(sums).first()["all"] == [m * m % 7 for m in range(32)]


def test_empty(spark):
    assert filter_audit.audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []
