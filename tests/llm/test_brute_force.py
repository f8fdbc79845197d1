"""Operators against brute force, exact round trips or plain loops, and on rows with nulls, repeats, long texts and clashing columns."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from pyspark.sql import functions as F  # noqa: E402

from loomleaf.llm import bpe, common, embeddings, html_extract, line_dedup, media, mixing, quality, queries, simhash, token_counts, toxicity  # noqa: E402

WHERE = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
TEXTS = ["a few words here", None, "", "a few words here", "Wörter ﬁ <|endoftext|> \t\n x", "word " * 20000, "x" * 5000]
#: Every name that an operator uses for itself.
CLASH = ("_row", "_id", "_lost", "_gone", "gone", "_t", "_text", "_media", "_in", "_blocks", "_html", "_cut", "_page_row", "_digest", "_key", "_times", "_rows", "_copy", "host", "score", "ids", "digest", "fp", "c", "n", "share", "key", "random", "range", "size", "__row")


def rows(spark, with_clash=False, texts=TEXTS):
    found = spark.createDataFrame([(i if i != 3 else 0, t, "en", None if i % 2 else "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    for c in CLASH if with_clash else ():
        found = found.withColumn(c, F.lit(f"own {c}"))
    return found


def kept_columns(found, replaced=()):
    names = [c for c in CLASH if c in found.columns and c not in replaced]
    assert names and all(r[c] == f"own {c}" for r in found.select(*names).collect() for c in names)


# ---- 1


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_counts_through_the_cache(spark, tmp_path):
    own, tokenizer, cache = library(), token_counts.Tokenizer(public_tokenizers.path("byte_bpe_50k.json")), str(tmp_path / "cache")
    want = sorted((i if i != 3 else 0, len((t or "").encode()), len(own.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(TEXTS))

    def got(df):
        return sorted(tuple(r) for r in token_counts.count_tokens(df, tokenizer, cache).select("doc_id", "n_bytes", "n_tokens").collect())

    def held():
        return spark.read.parquet(cache).count()

    assert got(rows(spark, texts=TEXTS[:2])) == want[:1] + [w for w in want if w[0] == 1] and held() == 2  # all misses
    assert got(rows(spark)) == want and held() == 5  # some hits
    assert got(rows(spark)) == want and held() == 5  # all hits
    other = token_counts.Tokenizer(public_tokenizers.path("piece_bpe_32k.model"))
    assert token_counts.count_tokens(rows(spark), other, cache).count() == 7 and held() == 10  # another version
    assert got(rows(spark).limit(0)) == []
    kept_columns(token_counts.count_tokens(rows(spark, True), tokenizer, cache), ("digest", "n_tokens", "n_bytes"))


def test_stored_counts_are_what_is_joined(spark, tmp_path):
    """A count in the cache is believed: it isn't made again."""
    tokenizer, cache = token_counts.Tokenizer(public_tokenizers.path("byte_bpe_50k.json")), str(tmp_path / "cache")
    spark.createDataFrame([(tokenizer.version, hashlib.sha256(b"known").digest(), 77)], token_counts.CACHE).write.parquet(cache)
    docs = spark.createDataFrame([(1, "known"), (2, "new")], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, tokenizer, cache).collect()} == {1: 77, 2: 1}


# ---- 2


def test_node_importance_as_brute_force(spark):
    rng = random.Random(8)
    pages = []
    for i in range(60):
        top, note = rng.choice(["Menu one", "Menu two"]), rng.choice([f"note {rng.randrange(40)}", "same note"])
        pages.append((i, f"http://h{i % 2}/p", f"<div class=top>{top}</div><article><p>Text {i} of page</p><div class=note>{note}</div></article><div class=foot>All rights</div><div class=ad>Buy {i}</div>"))
    pages += [(60, *pages[0][1:]), (61, None, None), (62, "http://h0/x", "")]

    def importance(host):
        nodes, seen = {}, set()
        for _, url, html in pages:
            found = tuple(html_extract.blocks(html or ""))
            if (url or "").startswith(f"http://{host}/") and found not in seen:
                seen.add(found)
                for path, sure, text in set(found):
                    nodes.setdefault(path, []).append((text, sure))
        low = set()
        for path, shown in nodes.items():
            n = len(shown)
            share = [sum(t == x for t, _ in shown) / n for x in {t for t, _ in shown}]
            entropy = -sum(p * np.log(p) for p in share)
            told = entropy / np.log(n) if n >= html_extract.FEWEST else 1.0
            if told + html_extract.PRESENTED * any(s for _, s in shown) - html_extract.HINTED * path.startswith(html_extract.MARK) < html_extract.IMPORTANCE:
                low.add(path)
        return low

    low = {h: importance(h) for h in ("h0", "h1")}
    assert any("top" in p for p in low["h0"]) and any("foot" in p for p in low["h1"])
    want = {i: " ".join(t for p, _, t in html_extract.blocks(html or "") if p not in low.get((url or "//").split("/")[2], ())) for i, url, html in pages}
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extract.extract(df).collect()} == want
    assert {r.page_id: r.text for r in html_extract.extract(df, few=0).collect()} == want
    assert html_extract.extract(df.limit(0)).count() == 0
    for c in CLASH:
        df = df.withColumn(c, F.lit(f"own {c}"))
    kept_columns(html_extract.extract(df), ("host",))


def test_hidden_inline_elements_and_headings(spark):
    def text(html):
        return " ".join(t for path, _, t in html_extract.blocks(html) if not path.startswith(html_extract.MARK))

    assert text("<p>a <span class='ad'>buy<span>now</span>LEAK</span> b</p>") == "a b"
    assert text("<article><h1 class=header>T</h1><p>one</p></article>") == "T one"
    assert text("<p>" + "long " * 50000 + "</p>") == ("long " * 50000).strip()


def test_what_wraps_the_article_stays(spark):
    """Classes alone don't decide; what they name goes where it is beside the article or within it."""

    def texts(pages, **options):
        df = spark.createDataFrame([(i, f"http://h{i % 3}/p", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
        return [r.text for r in sorted(html_extract.extract(df, **options).collect())]

    names = ["article-header", "page-header", "no-sidebar", "reviews", "share", "notice", "widget", "content"]
    assert texts([f"<article><div class='{n}'><h1>T</h1><p>one</p></div><div class=share>Tell</div></article>" for n in names]) == ["T one"] * len(names)
    assert texts(["<form id=aspnet><div><h1>T</h1><p>one</p></div></form><footer><p>f</p></footer>"]) == ["T one"]
    assert texts(["<div class=header><h1>Site</h1></div><article><p>one</p><div class=comments><article><p>said</p></article></div></article>"]) == ["one"]
    # Without hints the tree alone cuts what repeats, in nav elements and footers as elsewhere.
    plain = [f"<nav><ul><li>Home<li>About</ul></nav><article><h1>Title {i}</h1><p>Text of {i}</p></article><footer>All rights</footer>" for i in range(30)]
    assert texts(plain, hint=0.0) == [f"Title {i} Text of {i}" for i in range(30)]


# ---- 3


def test_bpe_columns(spark):
    got = bpe.round_trip(rows(spark, True), *WHERE)
    assert sorted((r.decoded or b"").decode() for r in got.collect()) == sorted(t or "" for t in TEXTS)
    kept_columns(got, ("ids",))
    two = bpe.decode(bpe.encode(rows(spark), *WHERE), *WHERE)
    assert sorted(map(str, two.select("doc_id", "ids", "decoded").collect())) == sorted(map(str, got.select("doc_id", "ids", "decoded").collect()))


# ---- 4


def test_fingerprints_and_components_as_brute_force(spark):
    from xxhash import xxh64_intdigest

    rng = random.Random(3)
    texts = list(TEXTS)
    for _ in range(25):
        base = [f"w{rng.randrange(50)}" for _ in range(rng.choice([1, 2, 3, 30, 400]))]
        for _ in range(4):
            other = list(base)
            other[rng.randrange(len(other))] = rng.choice(base + ["Zz"])
            texts.append(" ".join(other))

    def fingerprint(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = [w for w in "".join(" " if c in "\t\n\v\f\r " else c for c in low).split(" ") if w]
        grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = [fingerprint(t) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                group = [group[j] if g == group[i] else g for g in group]
    ids = [i if i != 3 else 0 for i in range(len(texts))]
    want = sorted((i, p - (1 << 64) if p >> 63 else p, min(ids[j] for j in range(len(texts)) if group[j] == g)) for i, p, g in zip(ids, prints, group))
    got = simhash.near_duplicates(rows(spark, True, texts))
    assert sorted(tuple(r) for r in got.select("doc_id", "fp", "component_id").collect()) == want


# ---- 5


def passages(rng, n):
    return [f"p{rng.randrange(5000)}" for _ in range(n)]


@pytest.mark.parametrize("width", [5, 9, 30, 1000])
def test_repeated_passages_go_and_the_rest_stays(spark, width):
    rng = random.Random(width)

    def lay(words):
        return "\n".join(" ".join(words[i : i + width]) for i in range(0, len(words), width))

    docs, alone = [], {}
    for i in range(0, 60, 2):
        shared = lay(passages(rng, rng.choice([55, 60, 90])))
        for j in (i, i + 1):
            before, after = lay(passages(rng, rng.randrange(40))), lay(passages(rng, rng.randrange(40)))
            docs.append((j, "\n".join(x for x in (before, shared, after) if x)))
            alone[j] = f"{before} {after}".split()
    docs += [(100, None), (101, ""), (102, lay(passages(rng, 200))), (102, "  a\n\n b ")]
    got = {(r.doc_id, r.text) for r in line_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for j, text in docs:
        if j >= 100 or j % 2 == 0:
            assert (j, text) in got  # the first of each, and what nothing repeats
    later = {j: t for j, t in got if j < 100 and j % 2}
    caught = sum(t.split() == alone[j] for j, t in later.items())
    assert caught == 30, f"{caught} of 30"


def test_removals_as_a_plain_loop(spark):
    """With chunks as given: runs of chunks that an earlier document has go, if they are long enough, and what is equal beside them."""
    rng = random.Random(2)
    pool = [" ".join(passages(rng, rng.randrange(8, 40))) for _ in range(12)]
    docs = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.5 else " ".join(passages(rng, 12)) for _ in range(8))) for i in range(40)]
    docs += [docs[5], (None, docs[7][1])]
    got = line_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    seen = set(line_dedup.chunks(docs[7][1]))
    want = {(None, docs[7][1])}
    for i, text in sorted(docs[:40]):
        chunks = line_dedup.chunks(text)
        want.add((i, None if any(c in seen for c in chunks) else text))
        seen |= set(chunks)
    for r in got:
        assert (r.doc_id, r.text) in want or (r.doc_id, None) in want
        assert len(r.text) <= max(len(t) for j, t in docs if j == r.doc_id)
    assert len(got) == 42 and all(r.text == "" for r in got if r.doc_id == 7)


def test_line_dedup_columns(spark):
    kept_columns(line_dedup.dedup(rows(spark, True)))
    assert line_dedup.dedup(rows(spark).limit(0)).count() == 0


# ---- 6


def test_dense_cell_repeats_and_lengths(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal(12)
    near = [(i, [float(x) for x in base + 0.05 * rng.standard_normal(12)], 1) for i in range(150)]
    odd = [(200, [1.0, 0.0], 1), (201, [1.0, 0.01], 1), (202, [2.0, 0.0], 2), (0, near[0][1], 1), (203, None, 1), (204, [0.0] * 12, 1), (205, [float("inf")] * 12, 1), (206, near[0][1], None)]
    data = near + odd
    ok = [v is not None and l is not None and all(map(np.isfinite, v)) and any(v) for _, v, l in data]

    def linked(i, j):
        (_, a, la), (_, b, lb) = data[i], data[j]
        return i != j and ok[i] and ok[j] and la == lb and len(a) == len(b) and np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98

    want = sorted((data[i][0], sum(linked(i, j) for j in range(len(data)))) for i in range(len(data)))
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").withColumn("point", F.lit("own"))
    got = embeddings.near_duplicates(df, cell=16).collect()
    assert sorted((r.vec_id, r.n_links) for r in got) == want


# ---- 7 and 8


def test_network_as_plain_loops():
    net, rng = toxicity.Network(3), np.random.default_rng(0)
    words = [toxicity.word_inputs(w) for w in ("alpha", "beta", "x", "été")]
    table = np.concatenate([net.project(net.vectors([(0, [0])])), net.project(net.vectors(words))])
    window = np.r_[rng.integers(1, 5, 11), np.zeros(5, int)]
    h, sigmoid = toxicity.HIDDEN, lambda x: 1 / (1 + np.exp(-x))
    states = np.zeros((toxicity.WIDTH, 2 * h))
    for k, side in enumerate("fb"):
        s = np.zeros(h)
        for t in range(toxicity.WIDTH) if side == "f" else reversed(range(toxicity.WIDTH)):
            x, u = table[window[t], 3 * h * k : 3 * h * (k + 1)], net.p[f"h{side}"]
            z, r = sigmoid(x[:h] + s @ u[:, :h]), sigmoid(x[h : 2 * h] + s @ u[:, h : 2 * h])
            s = (1 - z) * s + z * np.tanh(x[2 * h :] + r * (s @ u[:, 2 * h :]))
            states[t, h * k : h * (k + 1)] = s
    e = np.array([np.exp(states[t] @ net.p["v"]) if window[t] else np.exp(-20.0) for t in range(toxicity.WIDTH)])
    want = (e / e.sum()) @ states @ net.p["w"] + net.p["b"][0]
    assert abs(net.forward(window[None, :], table)[0] - want) < 1e-4


def test_text_score_is_the_highest_window(spark):
    net = toxicity.Network(5)
    scorer = toxicity.Scorer(net)
    words = [f"w{i % 37}" for i in range(150)]
    whole = scorer.score([" ".join(words)])[0]
    each = [scorer.score([" ".join(words[s : s + toxicity.WIDTH])])[0] for s in toxicity.starts(len(words))]
    assert abs(whole - max(each)) < 1e-5
    got = toxicity.score(rows(spark, True), net)
    assert {r.held_out for r in got.collect()} <= {True, False} and got.count() == 7
    kept_columns(got, ("score",))


def test_additive_as_lookups(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = quality.Additive.fit(x, y, 60)
    assert ((model.score(x) >= 0.5) == (y == 1)).mean() > 0.9  # an interaction of two features
    for row, got in zip(x[:20], model.score(x)[:20]):
        raw = model.base + sum(t[sum(b <= v for b in e)] for v, e, t in zip(row, model.edges, model.tables))
        raw += sum(t[sum(b <= row[i] for b in model.coarse[i])][sum(b <= row[j] for b in model.coarse[j])] for i, j, t in model.pairs)
        assert abs(got - 1 / (1 + np.exp(-raw))) < 1e-9
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(7)], "doc_id long, quality int, toxic int")
    got = quality.score(rows(spark, True), quality.train(rows(spark), labels))
    assert sorted(r.held_out for r in got.collect()) == sorted(zlib.crc32(str(i if i != 3 else 0).encode()) % 3 == 1 for i in range(7))
    kept_columns(got, ("score",))


# ---- 9


def test_mixing_ties_and_null_rows(spark):
    data = [(1, "a b c", "s"), (1, "a b c", "s"), (None, "d e", None), (None, "f", None), (2, None, "t"), (3, "x " * 10, "t"), (4, "", "s")]
    got = mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()
    assert sorted(r.size for r in got) == [0, 0, 1, 2, 3, 3, 10]
    by = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        s = by.setdefault(r.source, [r.target, 0, r.source_size])
        s[1] += r.taken
    assert all(abs(taken - target) <= 1 and target <= 2 * size for target, taken, size in by.values())
    kept_columns(mixing.mixed_documents(rows(spark, True)))


# ---- 10


def test_media_round_trip(spark):
    got = media.describe(media.store(rows(spark, True)))
    for r in got.collect():
        text = next(t for i, t in enumerate(TEXTS) if (i if i != 3 else 0) == r.doc_id)
        data = (text or "").encode()
        data += bytes(-len(data) % 64 or (0 if data else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.error) == (len((text or "").encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), None)
    assert len({(r.media_sha256, r.feature) for r in got.where("doc_id = 0").collect()}) == 1
    kept_columns(got)
    broken = spark.createDataFrame([(1, b"\xff\xd8nothing"), (2, None), (3, b"")], "doc_id long, media binary")
    assert [(r.width, bool(r.error)) for r in media.describe(broken).orderBy("doc_id").collect()] == [(None, True), (None, False), (None, True)]


def color_jpeg(rng, wide, high, restart):
    """A file with three components, the first sampled 2 x 2, and with AC values: the file and its luminance DC values."""
    symbols = [0x00, 0x01, 0x11, 0x02, 0xF0]  # end of block; values of 1, 1 after a zero, 2 bits; 16 zeros
    codes = {s: (i, 3) for i, s in enumerate(symbols)}
    tables = struct.pack(">BBH", 0xFF, 0xC4, 2 + 17 + 12) + bytes([0]) + bytes([0, 0, 0, 12, *[0] * 12]) + bytes(range(12)) + struct.pack(">BBH", 0xFF, 0xC4, 2 + 17 + 5) + bytes([0x10]) + bytes([0, 0, 5, *[0] * 13]) + bytes(symbols)
    across, down = -(-wide // 16), -(-high // 16)
    luma = np.zeros((down * 2, across * 2), int)
    out, bits = bytearray(), ""

    def flush():
        nonlocal bits
        bits += "1" * (-len(bits) % 8)
        for i in range(0, len(bits), 8):
            out.append(int(bits[i : i + 8], 2))
            if out[-1] == 255:
                out.append(0)
        bits = ""

    def number(v):
        n = abs(v).bit_length()
        return n, format(v if v >= 0 else v + (1 << n) - 1, f"0{n}b") if n else ""

    last, count = [0, 0, 0], 0
    for my in range(down):
        for mx in range(across):
            if restart and count and count % restart == 0:
                flush()
                out += bytes([0xFF, 0xD0 + (count // restart - 1) % 8])
                last = [0, 0, 0]
            for part, (v, h) in enumerate(((2, 2), (1, 1), (1, 1))):
                for y in range(v):
                    for x in range(h):
                        dc = rng.randrange(-60, 60)
                        if part == 0:
                            luma[my * 2 + y, mx * 2 + x] = dc
                        n, raw = number(dc - last[part])
                        bits += format(n, "04b") + raw
                        last[part] = dc
                        place = 1
                        while place < 50 and rng.random() < 0.6:
                            s = rng.choice(symbols[1:])
                            size, run = s & 15, s >> 4
                            bits += format(codes[s][0], "03b") + (number(rng.choice([-1, 1]) * ((1 << size) - 1))[1] if size else "")
                            place += run + 1
                        bits += format(codes[0][0], "03b")
            count += 1
    flush()
    quant = struct.pack(">BBH", 0xFF, 0xDB, 67) + bytes([0]) + bytes([8] * 64)
    frame = struct.pack(">BBHBHHB", 0xFF, 0xC0, 17, 8, high, wide, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    interval = struct.pack(">BBHH", 0xFF, 0xDD, 4, restart) if restart else b""
    scan = struct.pack(">BBHB", 0xFF, 0xDA, 12, 3) + bytes([1, 0, 2, 0, 3, 0, 0, 63, 0])
    file = b"\xff\xd8" + quant + tables + frame + interval + scan + bytes(out) + b"\xff\xd9"
    return file, luma[: -(-high // 8), : -(-wide // 8)]


@pytest.mark.parametrize("restart", [0, 3])
def test_colour_files_with_ac_values(restart):
    rng = random.Random(restart)
    made = [color_jpeg(rng, w, h, restart) for w, h in ((40, 24), (16, 16), (9, 70))]
    for (file, luma), got in zip(made, media.read([f for f, _ in made])):
        assert isinstance(got, list), got
        width, height, thumb = got[0]
        assert np.array_equal(thumb, np.clip(luma + 128, 0, 255))


# ---- all


def test_queries_take_an_empty_table(spark, tmp_path):
    for name, kind in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("pages", "page_id long, url string, html string"), ("labels", "doc_id long, quality int, toxic int"), ("embeddings", "vec_id long, embedding array<float>, label int")):
        spark.createDataFrame([], kind).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name, query in queries.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name


def test_fresh_names():
    assert common.fresh(["_A", "b"], "_a", "c") == ["__a", "_c"]
