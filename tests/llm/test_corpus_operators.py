"""The corpus operators against SQL, brute force, exact round trips and held-out accuracy."""

import collections
import functools
import io
import itertools
import json
import os
import re
import struct
import time
import zlib

import numpy as np
import pytest
import xxhash
from oracle import check
from pyspark.sql import functions as F

from sparkloom.llm import common, html, langid, mixing, passages, pieces, queries, quality, simhash, topk, warc, zipread

SF = "/root/testdata/sf0.01"
data = pytest.mark.skipif(not os.path.isdir(SF), reason="the supplied tables are not here")
model = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="the public model is not here")


@data
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    assert check(spark, queries.QUERIES[name], queries.ORACLES[name], SF) > 0


def roots(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def ascii_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# --- components


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 200)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    expected = roots(edges, {x for e in edges for x in e})
    assert got == {n: c for n, c in expected.items() if any(n in e and e[0] != e[1] for e in edges)}


# --- SimHash


@data
def test_simhash_is_exact(spark):
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in queries.op10_simhash(spark, SF).collect()}
    prints = {}
    for d in common.table(spark, SF, "documents").collect():
        w = ascii_words(d.text)
        shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[d.doc_id] = sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes)) if hashes else 0
    ids, values = list(prints), np.array(list(prints.values()), dtype=np.uint64)
    pairs = [(ids[i], ids[j]) for i in range(len(ids)) for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 3) + i + 1]
    expected = roots(pairs, ids)
    assert got == {(d, f"{prints[d]:016x}", expected[d]) for d in ids}


@pytest.mark.parametrize("n,k,radius", [(500, 40, 3), (1500, 3, 3), (300, 5, 2), (100, 2, 0), (500, 40, 16), (1200, 3, 9)])
def test_bit_sliced_distances(n, k, radius):
    rng = np.random.default_rng(n + radius)
    v = rng.integers(0, 2**63, size=k, dtype=np.uint64)[rng.integers(0, k, n)]
    for _ in range(3 * radius // 2 + 1):
        v = v ^ np.where(rng.random(n) < 0.5, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64), np.uint64(0))
    runs = np.sort(rng.integers(0, max(1, k // 2), n))
    a, b = simhash.near_pairs(v, np.flatnonzero(np.append(True, runs[1:] != runs[:-1])), radius)
    expected = {(i, j) for i in range(n) for j in range(i) if runs[i] == runs[j] and int(v[i] ^ v[j]).bit_count() <= radius}
    assert set(zip(a.tolist(), b.tolist())) == expected and len(a) == len(expected)


def test_table_keys_hold_every_close_pair(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(-(2**62), 2**62, 300)
    y = [int(v) ^ sum(1 << int(b) for b in rng.choice(63, 3, replace=False)) for v in x]
    rows = spark.createDataFrame([(int(a), b) for a, b in zip(x, y)], "x long, y long")
    shared = rows.select(F.arrays_overlap(simhash.table_keys(F.col("x")), simhash.table_keys(F.col("y"))).alias("s"))
    assert all(r.s for r in shared.collect())


def test_large_buckets_are_tiled_without_loss(spark):
    rng = np.random.default_rng(4)
    base = 0x1234567890ABCDEF
    values = sorted({base ^ sum(1 << int(b) for b in rng.choice(16, rng.integers(0, 7), replace=False)) for _ in range(600)})
    got = {r.node: r.component for r in simhash.linked(spark.createDataFrame([(v,) for v in values], "fp long"), chunk=32).collect()}
    arr = np.array(values)
    pairs = [(values[i], values[j]) for i in range(len(arr)) for j in np.flatnonzero(np.bitwise_count(arr[i + 1 :] ^ arr[i]) <= 3) + i + 1]
    expected = roots(pairs, values)
    linked = {n for p in pairs for n in p}
    assert set(got) == linked
    groups = lambda m: sorted(sorted(n for n in m if m[n] == c) for c in set(m.values()))
    assert groups(got) == groups({n: expected[n] for n in linked})


@data
def test_near_copies_have_a_similar_text(spark):
    docs = common.table(spark, SF, "documents")
    kept = {r.doc_id for r in simhash.deduplicated(docs).collect()}
    sets = {d.doc_id: frozenset(simhash.shingle_set(d.text, 5).tolist()) for d in docs.collect()}
    ids = sorted(sets)
    similar = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (n := len(sets[a] & sets[b])) and n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    assert kept == set(roots(similar, ids).values())


def similar_pairs(texts, least=0.8):
    sets = {i: frozenset(simhash.shingle_set(t, 5).tolist()) for i, t in texts.items()}
    ids = sorted(sets)
    return [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (n := len(sets[a] & sets[b])) and n >= least * (len(sets[a]) + len(sets[b]) - n)]


def test_near_copies_far_apart_in_bits(spark):
    """Similarity is on sets: neither a line that one text repeats nor a distance over the radius keeps near copies apart."""
    base = lambda i, n=60: [f"b{i}w{j}" for j in range(n)]
    texts = {}
    for i in range(8):
        line = " ".join(base(i)[:12])
        texts[i], texts[100 + i] = " ".join(base(i)), " ".join([*base(i), *[line] * 40])
    distance = lambda x, y: ((simhash.sketch(x, 5, 8)[0] ^ simhash.sketch(y, 5, 8)[0]) & 0xFFFFFFFFFFFFFFFF).bit_count()
    assert max(distance(texts[i], texts[100 + i]) for i in range(8)) <= 20
    far = 0
    for i in range(1000, 4000):  # small sets at 0.8, over the radius by chance
        one = base(i, 13)
        two = one[:-1]
        one, two = " ".join(one), " ".join(two)
        if distance(one, two) > 16:
            texts[i], texts[10000 + i] = one, two
            far += 1
    expected = roots(similar_pairs(texts), texts)
    got = simhash.deduplicated(spark.createDataFrame(sorted(texts.items()), "doc_id long, text string"))
    assert far > 5 and {r.doc_id for r in got.collect()} == set(expected.values())


@pytest.mark.parametrize("alike", [0, 150, 290])
def test_large_blocks_make_few_rows_and_lose_no_pair(spark, monkeypatch, alike):
    """Texts of one block, alike of them near copies of one: rows do not grow with the square of the block, and all similar pairs are found."""
    rng = np.random.default_rng(alike)
    lines = [f"l{i} k k k k" for i in range(300_000)]
    hashes = np.array([xxhash.xxh64_intdigest(x, simhash.SEED) for x in lines], np.uint64)
    line = lines[int(simhash.mixed(hashes ^ np.uint64(0x9E3779B97F4A7C15)).argmin())]  # the smallest hash of nearly any text that has it
    texts = {}
    for d in range(300):
        if d < alike:
            own = [f"a{i}" for i in range(100)]
            own[int(rng.integers(0, 100))] = f"z{d}"
        else:
            own = [f"d{d // 2}x{i}" for i in range(20)] + [f"z{d}"]
        texts[d] = " ".join([line, *own])
    assert collections.Counter(simhash.sketch(t, 5, 1)[1][0] for t in texts.values()).most_common(1)[0][1] > 280
    made, frame = [], type(spark.range(1))
    work = frame.mapInArrow

    def counted(df, *args, **kwargs):
        if {"k", "i", "j"} <= set(df.columns):
            made.append(df.count())
        return work(df, *args, **kwargs)

    monkeypatch.setattr(frame, "mapInArrow", counted)
    got = simhash.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), functions=1, chunk=8)
    names = {r.uid: r.node for r in got.collect()}
    uid = dict(spark.createDataFrame(list(texts.items()), "d long, t string").select("d", F.xxhash64("t")).collect())
    expected = roots(similar_pairs(texts), texts)
    assert all(names.get(uid[a], uid[a]) == names.get(uid[b], uid[b]) for a, b in expected.items())
    assert len(made) == 3 and max(made) < 7 * 300  # tiles of pairs of chunks of 8: 38 * 300


def test_families_around_the_similarity_are_whole(spark):
    """Pairs on both sides of 0.8: a failed link of a block's forest must not hide the pairs that it stood for."""
    rng = np.random.default_rng(8)
    texts = {}
    for f in range(12):
        base = [f"f{f}w{i}" for i in range(200)]
        for c in range(16):
            words = list(base)
            for e in rng.choice(200, rng.integers(2, 6), replace=False):
                words[e] = f"e{f}x{c}x{e}" if rng.random() < 0.6 else f"e{f}x{e}"
            texts[100 * f + c] = " ".join(words)
    pairs = similar_pairs(texts)
    expected = roots(pairs, texts)
    got = simhash.deduplicated(spark.createDataFrame(sorted(texts.items()), "doc_id long, text string"))
    assert 100 < len(pairs) < 12 * 16 * 15 // 2 and {r.doc_id for r in got.collect()} == set(expected.values())


# --- substring dedup


@pytest.mark.parametrize("n,least", [(60, 8), (200, 20), (30, 30), (500, 7)])
def test_compact_windows(n, least):
    rng = np.random.default_rng(n)
    v = rng.integers(0, 2**63, n, dtype=np.uint64)
    v[n // 3] = v[n // 4]
    starts, ends = np.array([0, n // 2]), np.array([n // 2, n])
    got = set(zip(*(x.tolist() for x in passages.compact_windows(v, starts, ends, least))))
    key = lambda i: (int(v[i]) >> 24, i)  # noqa: E731  the lower bits hold the place
    expected = set()
    for s, e in zip(starts, ends):
        for c in range(s, e):
            left = right = c
            while left > s and key(left - 1) > key(c):
                left -= 1
            while right < e - 1 and key(right + 1) > key(c):
                right += 1
            if right - left + 1 >= least:
                expected.add((left, c, right))
    assert got == expected


def texts_with_passages():
    rng = np.random.default_rng(7)
    some = lambda n: [f"w{i}" for i in rng.integers(0, 30_000, n)]
    passage = {k: some(n) for k, n in (("p", 60), ("q", 51), ("r", 300), ("short", 40))}
    edited = passage["r"][:150] + ["zzz"] + passage["r"][150:]
    docs = {1: some(100) + passage["p"] + some(50), 2: passage["p"] + some(80), 3: some(70) + passage["q"], 4: some(20) + passage["q"] + some(20), 5: some(10) + passage["r"] + some(9), 6: edited + some(40)}
    docs |= {7: some(60) + passage["short"] + some(60), 8: passage["short"] + some(99), 9: some(200), 10: some(30)}
    docs |= {20 + i: some(40) + passage["p"] + some(40) for i in range(30)}  # more than are all paired
    return {d: " ".join(w) for d, w in docs.items()}, {d: len(w) for d, w in docs.items()}


def test_passages_are_found_and_clean_texts_left(spark):
    docs, sizes = texts_with_passages()
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in passages.classed(df).collect()}
    with_p = {1, 2, *range(20, 50)}
    assert {d: r.class_id for d, r in got.items()} == {d: 1 if d in with_p else {4: 3, 6: 5}.get(d, d) for d in docs}
    assert [(s["first"], s["last"]) for s in got[1].spans] == [(100, 159)] and got[2].dup_words == 60 and got[9].n_spans == 0
    left = {r.doc_id: r.text for r in passages.removed(df).collect()}
    assert set(left) == set(docs)
    assert sum(len(left[d].split()) == sizes[d] for d in with_p) == 1  # one keeps the passage
    assert all(left[d] == docs[d] for d in (7, 8, 9, 10))


@data
def test_no_repeated_passage_is_missed(spark):
    docs = common.table(spark, SF, "documents")
    words = {d.doc_id: ascii_words(d.text) for d in docs.collect()}
    seen = collections.defaultdict(set)
    for d, w in words.items():
        for i in range(len(w) - 49):
            seen[hash(tuple(w[i : i + 50]))].add(d)
    expected = roots([(min(g), x) for g in seen.values() for x in g], words)
    got = {r.doc_id: r for r in queries.op1_substring_dedup(spark, SF).collect()}
    assert all(got[d].class_id == got[expected[d]].class_id for d in words)
    for d, w in words.items():
        repeated = {j for i in range(len(w) - 49) if len(seen[hash(tuple(w[i : i + 50]))]) > 1 for j in range(i, i + 50)}
        assert repeated <= {j for s in got[d].spans for j in range(s["first"], s["last"] + 1)}
    left = collections.defaultdict(set)
    for r in passages.removed(docs).collect():
        w = ascii_words(r.text)
        for i in range(len(w) - 49):
            left[hash(tuple(w[i : i + 50]))].add(r.doc_id)
    assert all(len(g) == 1 for g in left.values())


# --- HTML


def test_blocks():
    page = """<html><head><title>T</title></head><body><header class="site">Top</header><div id="cookie-notice">We use <b>cookies</b></div><nav><ul><li><a>x</a></ul></nav>
    <main><article><header><h1>Head &amp; line</h1></header><p>One  two<br>three &nbsp; &lt;b&gt;<p>Four <i>fi</i>ve<div class="advert">Buy</div><ul><li>a<li>b</ul><form>q <input> <button>go</button></form>
    <aside>Side</aside><section class="comments"><p>Nice!</p></section><p>Last &#233;&hellip;</article></main><div class=sidebar>S</div><footer>F</footer><script>if (a<b) "</p>"</script><!-- <p>no</p> --></body>"""
    assert html.main_text(html.blocks(page), set()) == "Head & line\nOne two three <b>\nFour five\na\nb\nLast é…"
    assert html.blocks("a < b and c > d <p title='x>y'>q</p>") == [(html.OPEN, "a < b and c > d"), (html.OPEN, "q")]
    assert html.blocks(None) == [] and html.blocks("<p>cut <a href='/x") == [(html.OPEN, "cut")]


def test_suffix_names_are_equal_for_equal_runs():
    rng = np.random.default_rng(0)
    tokens = [str(x) for x in rng.integers(0, 3, 400)]
    level = html.names(tokens)
    runs = [tuple(tokens[i : i + html.WINDOW]) for i in range(len(tokens) - html.WINDOW + 1)]
    assert len(set(level.tolist())) == len(set(runs)) and len({(a, b) for a, b in zip(level.tolist(), runs)}) == len(set(runs))


def test_boilerplate_of_a_host_goes(spark):
    menu, foot = "Home Products About us Contact Jobs Press Legal Imprint", "All content of this site may be used with the owner's consent only"
    rows = [(i, f"http://h{i % 2}/p{i}", f"<div>{menu}</div><div>Text number {i} has words like n{i * 7} and m{i * 13} of its own</div><div>{foot if i % 2 else 'own end ' + str(i)}</div>") for i in range(12)]
    rows.append((99, "http://other/x", f"<div>{menu}</div><div>alone</div>"))
    got = {r.page_id: r.text for r in html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(12):
        own = f"Text number {i} has words like n{i * 7} and m{i * 13} of its own"
        assert got[i] == (own if i % 2 else f"{own}\nown end {i}")
    assert got[99] == f"{menu}\nalone"  # once on its host


# --- top-k, pieces, language, WARC, mixing


def test_topk_by_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x[50:120] = x[3]  # a large group of ties
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.search(rows, F.col("vec_id") % 20 == 0, k=7, rows=64, queries=8).collect()}
    q = np.floor(64 * x.astype(float)).astype(int)
    for i in range(0, 400, 20):
        s = q @ q[i]
        order = [j for j in np.lexsort((np.arange(400), -s)) if j != i][:7]
        assert [got[(i, k + 1)] for k in range(7)] == [(j, s[j]) for j in order]


@model
def test_pieces_equal_the_library():
    import random

    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    own = pieces.Model(pieces.model_bytes(pieces.MODEL))
    rng = random.Random(1)
    some = [p for p in own.ids if "▁▁" not in p]
    texts = [" hello  world", "a\nb\t c  ", "ﬁ é é", "你好 <s> <0x41>", "", " ", "x\x00y", None, "\n\nab\n", "     in\n    dent", "ab" * 200 + "😀" * 30, "ab... ab.. ab. ab", "ab!! ab! cd. cd.."]
    texts += ["".join(rng.choice(some) for _ in range(6)).replace("▁", " ") for _ in range(3000)]
    parts = [own.encode(texts[i : i + 97]) for i in range(0, len(texts), 97)]  # what one call remembers, later ones use
    ids, sizes = (np.concatenate(x) for x in zip(*parts))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [library.encode(t or "") for t in texts]
    assert own.decode(ids, sizes) == [t or "" for t in texts]


def unigram(scores: dict[str, float]) -> bytes:
    """A unigram model file without bytes."""
    string = lambda n, b: bytes([n << 3 | 2, len(b)]) + b
    piece = lambda p, s, t: string(1, string(1, p.encode()) + b"\x15" + struct.pack("<f", s) + bytes([0x18, t]))
    return piece("<unk>", 0.0, 2) + b"".join(piece(p, s, 1) for p, s in scores.items()) + string(2, bytes([0x18, 1])) + string(3, bytes([0x18, 1, 0x20, 0, 0x28, 1]))


def test_unigram_takes_the_best_path():
    scores = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.0, "▁a": -2.2, "bb": -4.9, "▁ab": -6.0, "abb": -4.0}
    own = pieces.Model(unigram(scores))
    for text in ("abb", "ab ab", "bbb a", "aabbab"):
        marked = "▁" + text.replace(" ", "▁")
        best = [(0.0, [])] + [(-1e9, [])] * len(marked)
        for end in range(1, len(marked) + 1):
            best[end] = max((best[s][0] + scores[marked[s:end]], best[s][1] + [own.ids[marked[s:end]]]) for s in range(end) if marked[s:end] in scores)
        ids, sizes = own.encode([text])
        assert sum(own.score[i] for i in ids) == pytest.approx(best[-1][0]) and own.decode(ids, sizes) == [text]


@model
@data
def test_round_trip(spark):
    got = queries.op4_sentencepiece(spark, SF)
    assert got.filter("not round_trip or n_tokens <> size(token_ids)").count() == 0
    back = pieces.decoded(got).join(common.table(spark, SF, "documents").withColumnRenamed("text", "given"), "doc_id")
    assert back.filter("text <> given").count() == 0


def test_gradients():
    p = {n: a.astype(np.float64) for n, a in langid.started(3, 4).items()}
    rng = np.random.default_rng(0)
    x, y, w = rng.integers(97, 105, (6, 5)), rng.integers(0, 4, 5), rng.random((6, 5))
    _, g = langid.gradients(p, x, y, w)
    for n in p:
        i = (0, int(x[2, 1])) if n[0] == "w" else tuple(rng.integers(0, s) for s in p[n].shape)
        keep, e = p[n][i], 1e-6
        p[n][i] = keep + e
        up = langid.gradients(p, x, y, w)[0]
        p[n][i] = keep - e
        down = langid.gradients(p, x, y, w)[0]
        p[n][i] = keep
        assert (up - down) / (2 * e) == pytest.approx(g[n][i], abs=1e-6)


@data
def test_held_out_accuracy(spark):
    got = queries.op8_language_id(spark, SF).join(common.table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").filter("held_out")
    n, right = got.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 100 and right / n >= 0.97


def test_positions_have_labels():
    weights = langid.started(4, 2)
    labels = langid.Reader(weights).labels(b"some bytes, more than one window of them, so that two windows are read")
    assert len(labels) == 70 and set(labels.tolist()) <= {0, 1}


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_round_trip(zip64):
    import zipfile

    out = io.BytesIO()
    z = zipread.Writer(out, zip64)
    z.add("a/x.bin", bytes(range(256)) * 40)
    z.add("é.txt", b"hello")
    z.close()

    class File(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    r = zipread.Reader(File(out.getvalue()))
    assert r.ranged("a/x.bin", 250, 10) == bytes(range(250, 256)) + bytes(range(4)) and r.whole("é.txt") == b"hello"
    with zipfile.ZipFile(io.BytesIO(out.getvalue())) as f:
        assert f.namelist() == ["a/x.bin", "é.txt"] and f.read("é.txt") == b"hello"
    with pytest.raises(zipread.BadZip):
        r.ranged("é.txt", 3, 9)
    with pytest.raises(zipread.BadZip):
        zipread.Reader(File(b"no package"))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as f:
        f.writestr("c", b"c" * 1000)
    with pytest.raises(zipread.BadZip, match="compressed"):
        zipread.Reader(File(packed.getvalue())).whole("c")


def test_warc_payloads_come_back(spark):
    rows = [(1, "http://a/ b", "same"), (5, "http://a", "same"), (2, "u", "own é"), (3, None, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for zip64 in (False, True):
        got = {r.page_id: r for r in warc.read(warc.write(pages, package=300, zip64=zip64)).collect()}
        assert got[1].record_type == "revisit" and got[1].refers_to == 5 and got[1].payload is None and got[1].payload_bytes == 4
        assert bytes(got[5].payload) == b"same" and bytes(got[2].payload) == "own é".encode() and bytes(got[3].payload) == b"" and got[3].url is None
    assert {r.record_type for r in warc.read(warc.write(pages, least=5)).collect()} == {"response"}


def test_mixing_reaches_its_targets(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "rare").otherwise("hot").alias("source"), F.lit("t").alias("text"))
    got = {r.source: r["count"] for r in mixing.mix(docs, {"rare": 0.75, "hot": 0.25}).groupBy("source").count().collect()}
    assert got["rare"] == pytest.approx(4500, rel=0.06) and got["hot"] == pytest.approx(1500, rel=0.08)
    assert mixing.mix(docs, {"rare": 1.0}).filter("source = 'hot'").count() == 0
    high = mixing.mix(docs.filter("doc_id < 400"), {"rare": 0.999, "hot": 0.001}).filter("source = 'rare'").groupBy("doc_id").count()
    m, v = high.agg(F.avg("count"), F.var_pop("count")).first()  # a mean near 10
    assert m == pytest.approx(10, rel=0.15) and v == pytest.approx(10, rel=0.8)
    parts = mixing.rates(docs.filter("doc_id < 1000"), {"rare": 1.0}, "source").filter("n = 100").first()
    assert parts.rate == pytest.approx(10.0) and parts.parts == 1


def test_means_above_one_part(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 20, "rare").otherwise("hot").alias("source"))
    counts = mixing.mix(docs, {"rare": 1.0}).groupBy("doc_id").count()
    m, v = counts.agg(F.avg("count"), F.var_pop("count")).first()
    assert m == pytest.approx(100, rel=0.1) and 30 < v < 300


def test_frequent_lines_leave_and_copies_do_not_count(spark):
    body = lambda i: " ".join(f"a{i}x{j}" for j in range(60))
    rows = [(i, f"{body(i)}\nShare this page with friends\n{body(i + 100)}", "s") for i in range(40)] + [(100 + i, f"{body(500)}\n{body(501)}", "s") for i in range(30)]
    rows += [(200, "Share this page with friends\n" * 20 + "but no words", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality.judged(docs, keep=["doc_id"]).select("row.doc_id", "kept", "lost_words", "base_failed").collect()}
    assert all(got[i].kept and got[i].lost_words == 5 for i in range(40)) and all(got[100 + i].lost_words == 0 and got[100 + i].kept for i in range(30))
    assert not got[200].kept
    texts = {r.doc_id: r.text for r in quality.cleaned(docs).collect()}
    assert texts[3] == f"{body(3)}\n{body(103)}" and 200 not in texts


def test_passages_within_a_large_group_of_one_paragraph(spark):
    """A paragraph under the limit gives all texts the same keys; pairs of them share 10 words more beside it, and so a passage."""
    paragraph = [f"p{i}" for i in range(45)]
    own = lambda d, n=40: [f"d{d}w{i}" for i in range(n)]
    rows = []
    for d in range(300):
        extra = [f"x{d // 2}y{i}" for i in range(10)] if d < 80 else []
        rows.append((d, " ".join([*own(d), *paragraph, *extra, *own(1000 + d)])))
    for parts in (1, 7):
        got = {r.doc_id: r for r in passages.classed(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()}
        assert all(got[d].class_id == (d - d % 2 if d < 80 else d) for d in got)
        assert all(got[d].dup_words == (55 if d < 80 else 0) for d in got)


@pytest.mark.parametrize("others", [1, 30])
def test_a_passage_that_a_document_holds_twice(spark, others):
    passage = [f"p{i}" for i in range(70)]
    own = lambda d, n=60: [f"d{d}w{i}" for i in range(n)]
    twice = {0: [*own(0), *passage, *own(100), *passage, *own(200)]}
    once = {d: [*own(d), *passage, *own(100 + d)] for d in range(1, others + 1)}
    twice[50] = [*own(50), *passage, *own(150), *passage, *own(250), *passage]
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in {**twice, **once}.items()], "doc_id long, text string")
    spans = {r.doc_id: [(x["first"], x["last"]) for x in r.spans] for r in passages.classed(docs).collect()}
    assert spans == {d: [(i, i + 69) for i in range(len(w) - 69) if w[i : i + 70] == passage] for d, w in {**twice, **once}.items()}
    left = [r.text.count(" ".join(passage)) for r in passages.removed(docs).collect()]
    assert sum(n > 0 for n in left) == 1


def page_text(page: str) -> str:
    return html.main_text(html.blocks(page), set())


@pytest.mark.parametrize("name", ["related-work", "share-holders", "reply-to-critics", "adhesion", "searching", "content", "post"])
def test_names_that_only_sound_like_boilerplate(name):
    assert page_text(f'<article><p>One</p><div class="{name}">Two</div></article>') == "One\nTwo"


@pytest.mark.parametrize("name", ["ad", "cookie-notice", "adBox", "post-comments", "x share-buttons", "site_footer_links", "sidebar"])
def test_names_of_boilerplate(name):
    assert page_text(f'<article><p>One</p><div class="{name}">Two</div></article>') == "One"


def test_an_articles_header_keeps_its_headings():
    page = "<article><header><p>By me</p><h1>Head <b>line</b></h1><ul><li>menu</ul></header><p>Body</p></article><header><h1>Site</h1></header>"
    assert page_text(page) == "Head line\nBody"


def test_a_teaser_article_beside_the_body(spark):
    menu = "Read more of what we wrote about these things here"
    rows = [(i, f"http://h/p{i}", f"<article><h2>Teaser {i}</h2></article><div><p>Body number {i} with its own long text</p></div><div>{menu}</div>") for i in range(5)]
    got = {r.page_id: r.text for r in html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Teaser {i}\nBody number {i} with its own long text" for i in range(5)}


@pytest.mark.parametrize("seed", range(3))
def test_repeats_by_brute_force(spark, seed):
    """All substrings of a host's streams, compared one by one."""
    rng = np.random.default_rng(seed)
    phrases = [[f"r{k}w{j}" for j in range(rng.integers(3, 20))] for k in range(8)]
    pages = []
    for i in range(10):
        parts = [phrases[k] if rng.random() < 0.6 else [f"p{i}x{j}" for j in range(rng.integers(1, 12))] for k in rng.integers(0, 8, 6)]
        pages.append([w for part in parts for w in part])
    where = collections.defaultdict(set)
    for i, w in enumerate(pages):
        for n in range(html.WINDOW, len(w) + 1):
            for at in range(len(w) - n + 1):
                where[tuple(w[at : at + n])].add(i)
    expected = {}
    for i, w in enumerate(pages):
        covered = {at + j for n in range(html.WINDOW, len(w) + 1) for at in range(len(w) - n + 1) if len(where[tuple(w[at : at + n])]) >= html.MIN_PAGES for j in range(n)}
        expected[i] = html.main_text([(html.OPEN, " ".join(w))], covered)
    rows = [(i, "http://h/", f"<div>{' '.join(w)}</div>") for i, w in enumerate(pages)]
    got = {r.page_id: r.text for r in html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == expected and any(got[i] != " ".join(w) for i, w in enumerate(pages))


def test_rows_that_repeat_a_key_search_and_are_found(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (3, [1.0, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(2)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(v, F.col("vec_id") % 20 == 0).collect())
    one, other = [(20, 1, 3, 4096), (20, 2, 20, 0), (20, 3, 20, 0)], [(20, 1, 3, 4096), (20, 2, 20, 4096), (20, 3, 20, 0)]
    assert got == sorted(one + other + other)


@pytest.mark.parametrize("low,lists", [(-1e18, 2), (200, 2), (900, 3), (1500, 4)])
def test_remaining_scores(low, lists):
    rng = np.random.default_rng(int(abs(low)) % 97)
    rows, queries = (rng.integers(-30, 30, (n, 12)).astype(float) * rng.integers(0, 3, (n, 1)) for n in (300, 40))
    whole = queries @ rows.T
    q, r, score = topk.remaining(rows, queries, lists, np.full(40, float(low)))
    assert sorted(zip(q.tolist(), r.tolist(), score.tolist())) == sorted((i, j, whole[i, j]) for i, j in zip(*np.nonzero(whole >= low)))


def test_whole_licenses(spark):
    from sparkloom.llm import licenses

    mit = max((t for label, t in licenses.TEMPLATES if label == "mit"), key=len)
    words = mit.split()
    changed = " ".join(words[:40] + ["ACME", "Inc"] + words[40:])
    rows = [(1, "x y " + mit), (2, changed), (3, " ".join(words[: len(words) // 3])), (4, " ".join(words[::-1]))]
    got = {r.doc_id: r for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = {r.doc_id: (r.label, r["first"], r["last"]) for r in licenses.spans(
        spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", licenses.words_of(licenses.folded(F.col("text"))).alias("w")), ["doc_id"], "w", [("mit", mit)]).collect()}
    assert len(words) > 150 and found[1][:2] == ("mit", 2) and set(found) == {1, 2}
    assert "mit" in got[1].labels and "mit" in got[2].labels and got[4].labels == ""


def test_license_scan_is_linear(spark):
    """Twice the text takes about twice the time: a k-gram's row does not carry the text."""
    from sparkloom.llm import licenses

    def seconds(n):
        df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(n)))], "doc_id long, text string")
        return min(timed(lambda: licenses.scanned(df).collect()) for _ in range(2))

    def timed(work):
        start = time.time()
        work()
        return time.time() - start

    seconds(10_000)
    assert seconds(320_000) < 4 * seconds(80_000) + 3


def test_every_language_is_learned(spark):
    rows = [(i, f"text number {i} of lang {i % 90}", f"l{i % 90:02d}") for i in range(270)] + [(1000 + i, "plain text", "big") for i in range(3000)]
    languages, pairs = langid.sample(spark.createDataFrame(rows, "key long, text string, lang string"), docs=64)
    assert languages == sorted({*(f"l{i:02d}" for i in range(90)), "big"}) and 20 < sum(x == "big" for x, _ in pairs) < 130


def test_packages_are_read_by_their_directory(tmp_path):
    """Two archives, two indexes, one of them without compression and without a name."""
    one, two = warc.record(1, "http://x/", b"<p>a", True, None), warc.record(2, None, b"<p>b", True, None)
    packed = zlib.compress(two, wbits=31)
    for name, members in {"a.zip": [("archive/first.warc", one), ("archive/second.warc.gz", packed)], "b.zip": [("archive/only.warc.gz", packed)]}.items():
        with open(tmp_path / name, "wb") as out:
            z = zipread.Writer(out)
            for member, data in members:
                z.add(member, data)
            entries = [{"offset": 0, "length": len(data)} | ({"filename": member[8:]} if len(members) > 1 else {}) for member, data in members]
            z.add("indexes/x.cdxj", "\n".join(f"com,x)/ 20200101000000 {json.dumps(e)}" for e in entries).encode())
            z.close()
    assert [r["page_id"] for r in warc.records(f"file://{tmp_path}/a.zip")] == [1, 2]
    assert [r["payload"] for r in warc.records(f"file://{tmp_path}/b.zip")] == [b"<p>b"]


def test_packages_are_dealt_to_tasks(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "x" * 500 + str(i)) for i in range(64)], "page_id long, url string, html string")
    manifest = warc.write(pages.repartition(1), package=200)
    back = warc.read(manifest)
    assert manifest.count() > 8 and back.count() == 64
    assert back.groupBy(F.spark_partition_id()).count().count() > 4


@pytest.mark.parametrize("words", [50, 60, 120])
def test_recall_of_changed_passages(spark, words):
    """Passages with words replaced at random places, similar at 0.8 or more as a whole, in texts that have nothing else in common."""
    rng = np.random.default_rng(words)
    own = lambda n: [f"w{i}" for i in rng.integers(0, 10**9, n)]
    rows, pairs = [], []
    while len(pairs) < 60:
        one = own(words)
        other = list(one)
        for i in rng.choice(words, max(1, words // 45), replace=False):
            other[i] = own(1)[0]
        a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (one, other))
        if len(a & b) < 0.8 * len(a | b):
            continue
        k = len(rows)
        rows += [(k, " ".join(own(70) + one + own(50))), (k + 1, " ".join(own(30) + other + own(90)))]
        pairs.append((k, k + 1))
    got = {r.doc_id: r.class_id for r in passages.classed(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert sum(got[b] == a for a, b in pairs) >= 0.9 * len(pairs)


def test_changed_passages_in_large_groups(spark, monkeypatch):
    """Texts of one line, pairs of which share changed passages about it: nothing is lost of what all pairs of the groups give, in parts of keys too."""
    rng = np.random.default_rng(17)
    line = [f"l{i}" for i in range(24)]
    rows = []
    for d in range(120):
        base = [f"b{d // 2}x{i}" for i in range(18)] + line + [f"b{d // 2}y{i}" for i in range(18)]
        for i in rng.choice(18, int(rng.integers(0, 2)), replace=False) + (42 if d % 4 else 0):
            base[i] = f"d{d}z{i}"
        if d % 10 == 0:
            base.insert(20, f"d{d}in")
        rows.append((d, " ".join([f"d{d}w{i}" for i in range(int(rng.integers(20, 60)))] + base + [f"d{d}v{i}" for i in range(30)])))
    for d in range(200, 240):  # near copies of one text, none of which has 50 words in a row of another
        base = [f"n{i}" for i in range(140)]
        for i in range(int(rng.integers(0, 45)), 140, 45):
            base[i] = f"d{d}z{i}"
        rows.append((d, " ".join(base)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)

    def found():
        words, links = collections.defaultdict(set), []
        for r in passages.shared(docs).collect():
            words[r.uid] |= set(range(r.first, r.last + 1))
            links.append((r.uid, r.other))
        return roots(links, list(words)), words

    got = [found()]
    with monkeypatch.context() as m:
        m.setattr(passages, "HOT", 16)
        m.setattr(passages, "SAMPLED", 2)
        got.append(found())
    monkeypatch.setattr(passages, "meetings", functools.partial(passages.meetings, small=200))
    classes, words = found()
    assert len(classes) > 120
    for c, w in got:
        assert all(c[x] == c[classes[x]] for x in classes) and all(words[x] <= w[x] for x in words)


def test_changed_passages_of_large_groups_are_removed(spark, monkeypatch):
    """Of pairs of texts with changed passages about one line, no more words stay than when all pairs of the line's group meet."""
    line = [f"l{i}" for i in range(24)]
    rows = []
    for d in range(60):
        base = [f"b{d // 2}x{i}" for i in range(18)] + line + [f"b{d // 2}y{i}" for i in range(18)]
        base[8 if d % 2 else 50] = f"d{d}z"
        rows.append((d, " ".join([f"d{d}w{i}" for i in range(20 + d)] + base + [f"d{d}v{i}" for i in range(30)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    left = lambda: {r.doc_id: len(r.text.split()) for r in passages.removed(docs).collect()}
    got = left()
    monkeypatch.setattr(passages, "meetings", functools.partial(passages.meetings, small=200))
    whole = left()
    assert sum(whole.values()) < sum(len(t.split()) for _, t in rows) and all(got[d] <= whole[d] for d in whole)


def test_passages_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for d in range(90):
        w = list(base)
        for i in rng.choice(120, rng.integers(0, 6), replace=False):
            w[i] = f"d{d}x{i}"
        rows.append((d, " ".join([f"d{d}y{i}" for i in range(40)] + w[rng.integers(0, 30) : 120 - rng.integers(0, 30)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [{r.doc_id: (r.class_id, tuple((s["first"], s["last"]) for s in r.spans)) for r in passages.classed(docs.repartition(n)).collect()} for n in (1, 4, 50)]
    assert got[0] == got[1] == got[2] and sum(len(x[1]) > 0 for x in got[0].values()) > 60


def test_a_passage_twice_in_one_text_and_once_in_another(spark):
    p = [f"p{i}" for i in range(60)]
    own = lambda d, n=30: [f"o{d}x{i}" for i in range(n)]
    docs = [(1, " ".join(own(0) + p + own(1) + p + own(2))), (2, " ".join(own(3) + p + own(4)))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    spans = {r.doc_id: [(s["first"], s["last"]) for s in r.spans] for r in passages.classed(df).collect()}
    assert spans == {1: [(30, 89), (120, 179)], 2: [(30, 89)]}
    assert sum(r.text.count(" ".join(p)) for r in passages.removed(df).collect()) == 1


def test_a_changed_passage_at_every_place_of_a_text(spark):
    """A long block that a text repeats has the same words around the passage at each place: each is found, and one stays."""
    p = [f"p{i}" for i in range(150)]
    block = [f"m{i}" for i in range(400)] + p + [f"n{i}" for i in range(400)]
    own = lambda d: [f"o{d}x{i}" for i in range(30)]
    changed = [f"c{i}" if i in (40, 88, 136) else w for i, w in enumerate(p)]  # no 50 words in a row
    docs = [(1, " ".join(own(0) + block + own(1) + block + own(2) + block + own(3) + block)), (2, " ".join(own(4) + changed + own(5)))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    spans = {r.doc_id: [(s["first"], s["last"]) for s in r.spans] for r in passages.classed(df).collect()}
    assert spans == {1: [(x, x + 149) for x in (430, 1410, 2390, 3370)], 2: [(30, 179)]}
    assert sum(r.text.split().count("p0") for r in passages.removed(df).collect()) == 1


def test_pairs_with_too_little_in_common_are_not_compared(monkeypatch):
    """Places of a key that share its words and a few that one of them repeats, and not what a passage needs."""
    made, work = [], passages.common_passages
    monkeypatch.setattr(passages, "common_passages", lambda *a: made.append(a) or work(*a))

    def compared(n):
        middle = lambda d: [*range(5000, 5013), *[*range(6000, 6000 + n)] * (1 + d % 2)]
        around = [np.array([*range(100 * d, 100 * d + 60), *middle(d), *range(100 * d + 61, 100 * d + 99)], np.uint16).tobytes() for d in range(1, 13)]
        made.clear()
        out = passages.near_meetings(7, np.arange(12), np.full(12, 60), np.full(12, 60), around, [[]] * 12, 50, 0.8)
        return len(made), len(out)

    assert compared(8) == (0, 0)


def near_meetings_of(texts):
    """The rows that near_meetings gives of all keys of the texts."""
    by = collections.defaultdict(list)
    for uid, text in enumerate(texts):
        words = passages.word_hashes(text)
        for _, k, c, left, right in passages.windows([text], 46):
            k, _, c, left, right = passages.firsts_of(k, np.full(len(k), uid), c, left, right, 46)
            near = passages.surroundings(words, k, c, left, right, 46, np.ones(max(0, len(words) - 49), bool))
            for key, *row in zip(*near):
                by[key].append((uid, *row))
    out = []
    for key, rows in by.items():
        uid, centre, before, around, also, given = zip(*sorted(rows, key=lambda r: r[:2]))
        if uid[0] != uid[-1]:
            out += passages.near_meetings(key, np.array(uid), np.array(centre), np.array(before), list(around), list(also), 50, 0.8, list(given))
    return out


@pytest.mark.parametrize("period", [1, 2])
def test_stretches_of_one_word_lose_nothing(monkeypatch, period):
    """Texts of few words, said many times, with changed words: words and links are those that are found when no run is known and no member of a stretch left out."""
    rng = np.random.default_rng(period)
    texts = []
    for d in range(5):
        w = [f"d{d}o{i}" for i in range(int(rng.integers(3, 30)))]
        for _ in range(int(rng.integers(2, 5))):
            said, times = 0, int(rng.integers(10, 45))
            w += [f"s{said}p{i % period}" for i in range(times)]
            if rng.random() < 0.6:
                w += [f"d{d}z{len(w)}"] * int(rng.integers(1, 4))
        texts.append(" ".join(w))
    words = [passages.short_hashes(t) for t in texts]

    def found():
        got, links, anchors = set(), [], collections.defaultdict(set)
        for row in near_meetings_of(texts):
            if row[6] is None:
                got |= {(row[1], i) for i in range(row[2], row[3] + 1)}
            else:
                a, b = sorted([(row[1], row[2]), (row[5], row[6])])
                anchors[a[0], b[0]].add((a[1], b[1]))
        for a, b in itertools.combinations(range(len(texts)), 2):
            runs = collections.defaultdict(list)  # runs that meet as a whole
            for i in range(len(words[a]) - 49):
                runs[words[a][i : i + 50].tobytes()].append(i)
            for j in range(len(words[b]) - 49):
                if (same := runs.get(words[b][j : j + 50].tobytes())) is not None:
                    links.append((a, b))
                    got |= {(b, j + x) for x in range(50)} | {(a, i + x) for i in same for x in range(50)}
            for s, e, f, g in passages.common_passages(words[a], 0, words[b], 0, sorted(anchors[a, b]), 50):
                links.append((a, b))
                got |= {(a, i) for i in range(s, e + 5)} | {(b, i) for i in range(f, g + 5)}
        return got, roots(links, range(len(texts)))

    got, classes = found()
    work = passages.near_meetings
    monkeypatch.setattr(passages, "near_meetings", lambda *a: work(*a[:8]))
    monkeypatch.setattr(passages, "in_stretch", lambda data, before, classes: [np.zeros(len(x[0]), bool) for x in classes])
    expected, expected_classes = found()
    assert expected
    assert expected <= got and all(classes[x] == classes[expected_classes[x]] for x in classes)


def test_stretches_of_one_word_are_not_compared_place_by_place(monkeypatch):
    """Texts that say one word many times beside words of which two texts say some too: most of what they have in common is whole runs, and few pairs are compared (668 when all were)."""
    made, work = [], passages.common_passages
    monkeypatch.setattr(passages, "common_passages", lambda *a: made.append(a) or work(*a))
    texts = [" ".join([f"a{d // 2}"] * 20 + ["the"] * (15 + 3 * d) + [f"b{d // 3}"] * 20) for d in range(8)]
    near_meetings_of(texts)
    assert 0 < len(made) < 200


def test_diagonals_of_one_word_are_looked_at_once(monkeypatch):
    """Two texts of a few words that are said many times: a diagonal is compared once, not for each two places that lie on it (179 comparisons when it was)."""
    made, work = [], passages.common_passages
    monkeypatch.setattr(passages, "common_passages", lambda *a: made.append(a) or work(*a))
    near_meetings_of([" ".join([w for w, n in words for _ in range(n)]) for words in ([("the", 40), ("of", 44), ("to", 40), ("in", 48)], [("of", 42), ("at", 30), ("the", 44), ("of", 46), ("on", 40)])])
    assert 0 < len(made) < 60


def test_texts_beyond_a_part_are_cut(spark):
    rng = np.random.default_rng(5)
    text = " ".join(f"w{i}" for i in rng.integers(0, 10**6, 3000))
    whole = {(int(k), int(c)) for _, *x in [next(passages.windows([text], 46))] for k, c in zip(x[0], x[1])}
    found, seen = set(), np.zeros(2996, bool)
    for _, k, c, left, right in passages.windows([text], 46, at_once=512, overlap=128):
        found |= set(zip(k.tolist(), c.tolist()))
        for at, x, y in zip(c, left, right):
            seen[at - x : at + y + 1] = True
    assert len(found & whole) > 0.8 * len(whole) and seen.all()


@pytest.mark.parametrize("kinds", [1, 2, 5])
def test_windows_of_texts_that_repeat_themselves(kinds):
    rng = np.random.default_rng(kinds)
    values = rng.integers(0, kinds, 400).astype(np.uint64) << np.uint64(40)
    got = sorted(zip(*(x.tolist() for x in passages.compact_windows(values, np.array([0]), np.array([400]), 20))))
    expected, todo = [], [(0, 400)]
    while todo:
        s, e = todo.pop()
        if e - s >= 20:
            c = s + int(values[s:e].argmin())
            expected.append((s, c, e - 1))
            todo += [(s, c), (c + 1, e)]
    assert got == sorted(expected)


@model
@data
def test_pieces_of_documents_equal_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    docs = common.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.row.doc_id: r.token_ids for r in pieces.encoded(docs, keep=["doc_id"]).collect()}
    assert got == {d: library.encode(t or "") for d, t in texts.items()}


@model
def test_pieces_do_not_depend_on_what_is_held(monkeypatch):
    plain, small = (pieces.Model(pieces.model_bytes(pieces.MODEL)) for _ in range(2))
    rng = np.random.default_rng(1)
    texts = [" ".join("".join(rng.choice(list("abcdeé.,\n日"), rng.integers(1, 9))) for _ in range(40)) for _ in range(60)]
    whole = [plain.encode([t])[0].tolist() for t in texts]
    monkeypatch.setattr(pieces, "HELD", 50)
    assert [small.encode([t])[0].tolist() for t in texts] == whole
    assert [small.encode([t])[0].tolist() for t in reversed(texts)] == whole[::-1]


def test_reader_equals_a_plain_forward_pass():
    p = langid.started(6, 3, 4)
    texts = [b"", b"a", b"some words of a text", bytes(range(97, 123)) * 8]
    got = langid.Reader(p).documents(texts, 16)

    def run(d, data):
        h, out = np.zeros(6), []
        for x in data:
            g, a = p["w" + d][:, x], p["u" + d] @ h
            z, r = 1 / (1 + np.exp(-(g[:6] + a[:6]))), 1 / (1 + np.exp(-(g[6:12] + a[6:12])))
            n = np.tanh(g[12:] + r * (a[12:] + p["c" + d][:, 0]))
            h = (1 - z) * n + z * h
            out.append(h)
        return out

    for t, row in zip(texts, got):
        total = np.zeros(3)
        for at in range(0, len(t), 16):
            part = t[at : at + 16]
            padded = part + bytes(16 - len(part))
            f, b = run("f", padded), run("b", padded[::-1])[::-1]
            for i in range(len(part)):
                e = np.exp(p["of"] @ f[i] + p["ob"] @ b[i] + p["k"][:, 0])
                total += e / e.sum()
        assert np.allclose(row, total / max(1, len(t)), atol=1e-4)


def test_hot_keys_are_dealt_in_parts(spark, monkeypatch):
    """With a low limit most keys are dealt; classes, spans and what stays are the same."""
    rng = np.random.default_rng(9)
    line, p, q = ([f"{x}{i}" for i in range(n)] for x, n in (("l", 20), ("p", 60), ("q", 55)))
    own = lambda d, n: [f"d{d}w{i}n{n}" for i in range(n)]
    rows = [(d, " ".join(own(d, 20) + line + (p if d % 3 else q) + own(d, 80) + (line + p if d % 5 == 0 else [])[: int(rng.integers(10, 90))])) for d in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)

    def found():
        classes = {r.doc_id: (r.class_id, [(s["first"], s["last"]) for s in r.spans]) for r in passages.classed(docs).collect()}
        return classes, sorted((r.doc_id, r.text) for r in passages.removed(docs).collect())

    plain = found()
    monkeypatch.setattr(passages, "HOT", 16)
    monkeypatch.setattr(passages, "SAMPLED", 2)
    assert found() == plain and len({c for c, _ in plain[0].values()}) < 10
