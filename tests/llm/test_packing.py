"""Packing: each token once, sequences without gaps, little padding."""

import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from loomleaf.llm import packing  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, ids string, length long"


def verified(pieces, docs, length=2048):
    """Checks all pieces against the library; returns the share of padding."""
    from collections import defaultdict

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    want = sorted(str((d, [*library.encode(t or "", add_special_tokens=False).ids, 1])) for d, t, *_ in docs)
    sequences, by_doc = defaultdict(list), defaultdict(list)
    for r in pieces:
        assert 0 < r.length == len(r.ids) // 4
        sequences[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id, r.doc_tokens].append((r.start, r.ids))
    for held in sequences.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= length
    got = []
    for (doc, n), held in by_doc.items():
        # Rows repeated in id and length: pieces of one row follow another's.
        ids = np.frombuffer(b"".join(x for _, x in sorted(held)), "<u4").tolist()
        if sum(len(x) // 4 for _, x in held) == n:
            got.append(str((doc, ids)))
        else:
            copies = sum(len(x) // 4 for _, x in held) // n
            assert copies > 1
            got += [str((doc, next(w for d, w in [(d, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for d, t, *_ in docs] if d == doc and len(w) == n)))] * copies
    assert sorted(got) == want
    used = [sum(n for _, n in held) for held in sequences.values()]
    total = sum(used)
    return sum(0 if u & (u - 1) == 0 else length - u for u in used) / max(1, total)


def made(seed, n, sizes):
    rng = random.Random(seed)
    words = "the quick brown fox jumps over lazy dog é 日本 Zürich 12345 antidisestablishmentarianism".split()
    return [(i, " ".join(rng.choice(words) for _ in range(rng.choice(sizes))), "en", None, i) for i in range(n)]


@pytest.mark.parametrize("sizes", [[3, 50, 200, 700, 1500], [800], [5000, 40], [2, 3], list(range(1, 1400, 7))])
def test_pieces(spark, sizes):
    docs = made(len(sizes), 150, sizes) + [(1000, None, None, None, None), (1001, "", "en", None, 1), (None, "x y z", "en", None, 1), (7, "seven", "en", None, 1), (7, "seven", "en", None, 1), (1002, "long " * 20000, "en", None, 1)]
    got = packing.pack(spark.createDataFrame(docs, DOCS).repartition(3), PATH).collect()
    assert verified(got, docs) < 0.01


def test_patterns_are_found():
    """Lengths that fit exactly are packed whole: nothing goes to the stream, and no column is better than those found."""
    lengths = np.zeros(2048, np.int64)
    lengths[[1048, 1000, 512, 256, 128]] = [5000, 5000, 800, 400, 800]
    plan = packing.Plan(lengths)
    seen = np.zeros(plan.total, np.int64)
    for r in np.flatnonzero(lengths):
        sequence, offset, _ = plan.places(np.full(lengths[r], r), np.arange(lengths[r]))
        whole = sequence >= 0
        assert whole.mean() > 0.99
        np.add.at(seen, sequence[whole], r)
    assert (seen == 2048).sum() >= 5000 + 290


def test_knapsack_as_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(30):
        units = np.unique(rng.integers(1, 12, 4))[::-1]
        values = rng.random(len(units)).round(2)
        room = int(rng.integers(1, 30))
        best = [0.0] * (room + 1)
        for c in range(1, room + 1):
            best[c] = max([best[c - 1]] + [best[c - u] + v for u, v in zip(units, values) if u <= c])
        value, counts = packing.priced(values, units, room)
        assert abs(value - best[room]) < 1e-9 and counts @ units <= room and abs(counts @ values - value) < 1e-9


def test_program_finds_full_patterns():
    """Of lengths that sequences were cut into, nearly all are packed whole, without padding."""
    rng = np.random.default_rng(4)
    demand = np.zeros(513, np.int64)
    for _ in range(150):
        cuts = np.unique(rng.integers(1, 512, rng.integers(0, 5)))
        np.add.at(demand, np.diff(np.concatenate([[0], cuts, [512]])), rng.integers(1, 10**5))
    units = np.flatnonzero(demand)[::-1]
    found = packing.generated(units, demand[units], 512)
    taken = sum(p * x for p, x in found)
    assert (taken <= demand[units] * (1 + 1e-6) + 1e-3).all()
    assert sum(x for _, x in found) * 512 <= (taken @ units) * 1.002 and taken @ units >= 0.98 * (demand @ np.arange(513))


def test_words_as_whole_texts():
    """Words encoded apart are the library's ids of the whole text, whatever stands between and within them."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    rng = random.Random(6)
    signs = ["a", "B", "é", "e\u0301", "\u0301", "'s", "'", "12", "Σ", "ς", "İ", "ß", "日", "🙂", "<|endoftext|>", "<|start", "oftext|>", "-", "\u00a0", "\u2028", "\x0b", "\x1c", "\t", "\r\n", " ", " ", "\n", "ﬁ", "\u1100\u1161"]
    texts = ["", " ", "\n \n"] + ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(3000)]
    library, encode = Tokenizer.from_file(PATH), packing.Encoder(PATH, 1)
    plain = [t.replace("<|endoftext|>", "<|").replace("<|start", "|>") for t in texts]
    for part in (texts[:1000], texts[1000:], texts[:5], plain):
        ids, bounds = encode(pa.array([*part, "x"]).slice(0, len(part)))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [[*library.encode(t, add_special_tokens=False).ids, 1] for t in part]


def test_words_together_and_forgotten(monkeypatch):
    """Words encoded together have the ids they have alone, also with the word between them within; what batches share is remembered beyond the limit."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    library, encode = Tokenizer.from_file(PATH), packing.Encoder(PATH, 1)
    found = ["0", "é0", "0日0", "abc", "\u0301", "'", "'s", "<|endoftext|>", "Σ", "don't"] + [f"w{chr(97 + i % 26) * (i % 7)}é{i}" for i in range(900)]
    sizes, pool = encode.encoded(found)
    ends = np.cumsum(sizes)
    assert [pool[e - n : e].tolist() for n, e in zip(sizes, ends)] == [library.encode(w, add_special_tokens=False).ids for w in found]
    monkeypatch.setattr(packing, "REMEMBERED", 20)
    asked = []
    whole = encode.encoded
    monkeypatch.setattr(encode, "encoded", lambda new: (asked.append(list(new)), whole(new))[1])
    for i in range(60):
        text = f"always here {'abcdefghij'[i % 10] * (i + 2)}"
        ids, _ = encode(pa.array([text]))
        assert ids.tolist() == [*library.encode(text, add_special_tokens=False).ids, 1]
    assert len(encode.known) < 40 and sum("always" in new for new in asked) < 10


def test_tasks_of_a_worker_share_words():
    assert packing._encoder(PATH, 1) is packing._encoder(PATH, 1)


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], DOCS), PATH).collect() == []
