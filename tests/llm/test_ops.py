"""Each operator against brute force on small tables with nulls, empty and very long texts, ties, repeated rows and clashing names."""

from __future__ import annotations

import base64
import hashlib
import itertools
import math
import random
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.llm import chat, decontaminate, jaccard, line_dedup, lm, mixing, pq, shared, toxicity, url_filter, warc, words
from skein.llm.elias_fano import EliasFano, Trie, mapped, pack

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VOCAB = [a + b for a in ("ka", "lo", "mé", "ßu", "ti", "ro") for b in ("n", "ra", "söl", "t9", "x")]
DOC = "doc_id long, text string, lang string, source string, n_chars long, score string, _key string, spans string, n_words int, n_lines int"


def plain(text):
    return WORD.findall((text or "").translate(LOW))


def prose(rng, n):
    return " ".join(rng.choice(VOCAB) + rng.choice(["", "", ",", ".", "\n", "!"]) for _ in range(n))


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "s", "k", "p", 7, 8) for i, t, s in rows], DOC)


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


# --- words


@pytest.mark.parametrize("table", [words.PLAIN, words.SPACED])
def test_words_match_the_pattern(table):
    rng = random.Random(1)
    texts = ["", None, " a", "b ", "É1 x--Y", "\t\n", "z" * 5000, *("".join(rng.choice("aB9 .é\n\x00ß漢") for _ in range(rng.randrange(60))) for _ in range(200))]
    pattern = WORD if table is words.PLAIN else re.compile("[^\x20\x09-\x0d]+")
    h = words.Hasher(table, 50)
    seen, same = [], {}
    for lo, hi, low, starts, ends, first, hashes in h.words(pa.array(texts)):
        got = [words.text_of(low, s, e) for s, e in zip(starts, ends, strict=True)]
        seen += [got[first[i] : first[i + 1]] for i in range(hi - lo)]
        for w, x in zip(got, hashes.tolist(), strict=True):
            assert same.setdefault(w, x) == x
    assert seen == [pattern.findall((t or "").translate(LOW)) for t in texts]
    assert len(set(same.values())) == len(same)


# --- 1


def brute_hits(text, items, window=10):
    ws = plain(text)
    hit, ids = set(), set()
    for item, t in items:
        iw = plain(t)
        if item is None or not iw:
            continue
        n = min(window, len(iw))
        grams = {tuple(iw[k : k + n]) for k in range(len(iw) - n + 1)}
        for k in range(len(ws) - n + 1):
            if tuple(ws[k : k + n]) in grams:
                hit |= set(range(k, k + n))
                ids.add(item)
    return len(ws), len(hit), sorted(map(str, ids)), hit


def decontamination_case(spark):
    rng = random.Random(2)
    items = [(i, prose(rng, rng.randrange(3, 30))) for i in range(12)] + [(90, "Solo"), (91, "two words"), (92, ""), (93, None), (None, "x y"), (3, "other text of item three " * 3), (94, "rep " * 14)]
    docs = []
    for i in range(40):
        parts = [prose(rng, rng.randrange(0, 25))]
        for _ in range(rng.randrange(3)):
            w = plain(rng.choice(items)[1])
            a = rng.randrange(len(w)) if w else 0
            parts += [" ".join(w[a : a + rng.randrange(2, 25)]).upper(), prose(rng, 3)]
        docs.append((i, " ".join(parts), "s"))
    docs += [(100, None, "s"), (101, "", "s"), (102, "..", "s"), (103, prose(rng, 30000) + " " + items[0][1], "s"), (104, "a SOLO-two;words", "s"), (105, "rep " * 40, "s"), docs[0]]
    return docs, items, documents(spark, docs), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block", [1_000_000, 300])
def test_decontamination_report(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", block)
    docs, items, df, bench = decontamination_case(spark)
    want = []
    for i, t, _ in docs:
        n, hits, ids, _ = brute_hits(t, items)
        want.append((i, n, hits, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hits > 0))
    assert rows_of(decontaminate.report(spark, df, bench), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(want, key=repr)


def test_decontamination_cleans(spark):
    docs, items, df, bench = decontamination_case(spark)
    out = decontaminate.decontaminate(spark, df, bench)
    assert out.columns == df.columns
    got = {r.doc_id: r for r in out.collect()}
    for i, t, _ in docs:
        n, hits, _, at = brute_hits(t, items)
        assert (i in got) == (hits <= n / 2)
        if i in got:
            assert got[i].spans == "p" and got[i].n_words == 7
            assert got[i].text == t if not hits else plain(got[i].text) == [w for k, w in enumerate(plain(t)) if k not in at]


def test_decontamination_empty(spark):
    _, _, df, bench = decontamination_case(spark)
    assert decontaminate.report(spark, df.limit(0), bench).count() == 0
    assert decontaminate.report(spark, df, bench.limit(0)).where("contaminated").count() == 0


# --- 2


def vectors():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 12))
    rows = [list(map(float, b)) for b in base]
    for k in range(150):
        b = base[k % 20]
        rows.append([float(x) for x in b + rng.normal(size=12) * 0.08 * np.linalg.norm(b) / math.sqrt(12) * (1 + k % 5)])
    rows += [rows[0]] * 30 + [[2 * x for x in rows[1]]] * 3 + [None, [], [0.0] * 12, [float("nan")] * 12, [None] + [1.0] * 11, [float("inf")] + [1.0] * 11, [1.0, 2.0], [1e200] * 12, [1e-200] * 12]
    return rows


def brute_components(ids, links):
    comp = {i: i for i in ids}

    def top(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        comp[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("block", [1024, 7])
def test_embedding_links(spark, monkeypatch, block):
    monkeypatch.setattr(pq, "BLOCK", block)
    monkeypatch.setattr(pq, "LIST_SIZE", 16)
    rows = vectors()
    fine = {i: np.array(v) / np.max(np.abs(v)) for i, v in enumerate(rows) if v and len(v) == 12 and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    links = [(a, b) for a, b in itertools.combinations(fine, 2) if fine[a] @ fine[b] / np.linalg.norm(fine[a]) / np.linalg.norm(fine[b]) >= 0.95]
    n = Counter(x for p in links for x in p)
    comp = brute_components(range(len(rows)), links)
    df = spark.createDataFrame([(i, v, 1, "n") for i, v in enumerate(rows)], "vec_id long, embedding array<double>, label int, n_links string")
    got = rows_of(pq.near_duplicates(spark, df), "vec_id", "n_links", "component_id", "kept")
    assert got == sorted(((i, n[i], comp[i], comp[i] == i) for i in range(len(rows))), key=repr)


@pytest.mark.parametrize("flat", [64, 6])
def test_embedding_recall_over_many_lists(spark, monkeypatch, flat):
    """Planted links in 64 dimensions, of vectors that fill them or lie in a space of 6, over 20 lists and more."""
    monkeypatch.setattr(pq, "LIST_SIZE", 64)
    rng = np.random.default_rng(23)
    basis = np.linalg.qr(rng.normal(size=(64, flat)))[0]
    x = rng.normal(size=(1500, flat)) @ basis.T
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    way = rng.normal(size=(1000, flat)) @ basis.T
    way -= (way * x[:1000]).sum(1, keepdims=True) * x[:1000]
    c = rng.uniform(0.951, 0.97, (1000, 1))
    x = np.concatenate([x, c * x[:1000] + np.sqrt(1 - c**2) * way / np.linalg.norm(way, axis=1, keepdims=True)]).astype(np.float32)
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    want = (y @ y.T >= 0.95).sum(1) - 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in pq.near_duplicates(spark, df).collect()}
    have = np.array([got[i] for i in range(len(x))])
    assert want.sum() >= 2000 and (have == want).all()


def test_embedding_of_several_lengths_and_repeated_ids(spark):
    a, b, c, d = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [1.0, 0.1, 0.0], [0.0, 1.0, 0.1]
    rows = [(1, a), (1, b), (2, c), (3, d), (4, [2.0, 1.0]), (5, [2.0, 1.0]), (6, [1.0, -0.0]), (7, [1.0, 0.0]), (8, [5.0]), (9, [1.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = rows_of(pq.near_duplicates(spark, df), "vec_id", "n_links", "component_id", "kept")
    want = [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 1, 6, False), (8, 0, 8, True), (9, 0, 9, True)]
    assert got == sorted(want, key=repr)


def test_embedding_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert pq.near_duplicates(spark, df).count() == 0
    one = spark.createDataFrame([(5, [1.0, 0.0]), (4, None)], "vec_id long, embedding array<float>")
    assert rows_of(pq.near_duplicates(spark, one), "vec_id", "n_links", "component_id", "kept") == [(4, 0, 4, True), (5, 0, 5, True)]


def test_components_of_long_paths(spark):
    rng = random.Random(4)
    order = list(range(300))
    rng.shuffle(order)
    edges = list(zip(order, order[1:], strict=False)) + [(1000 + a, 1000 + b) for a, b in itertools.product(range(3), range(3, 6))] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in shared.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(300)} | {1000 + i: 1000 for i in range(6)}


# --- 3


def jaccard_case(rng):
    base = prose(rng, 120)
    docs = [(50 + i, prose(rng, rng.randrange(5, 80))) for i in range(20)]
    for i in range(40):  # near copies, drifting apart along a chain
        w = base.split(" ")
        for _ in range(i // 8):
            w[rng.randrange(len(w))] = f"new{rng.randrange(1000)}"
        docs.append((200 + i, " ".join(w)))
    docs += [(7, base.upper()), (8, base), (9, base), (1, None), (2, ""), (3, "?!"), (4, "Ab c"), (5, "ab C."), (6, "ab c d"), (10, prose(rng, 8000))]
    docs += [(11, docs[-1][1] + " end"), docs[0]]
    return docs


@pytest.mark.parametrize("block", [256, 5])
def test_jaccard_links(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    docs = jaccard_case(random.Random(5))
    sets = []
    for i, t in docs:
        w = plain(t)
        sets.append((i, tuple(w), {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else None))
    links = []
    for (a, wa, sa), (b, wb, sb) in itertools.combinations(sets, 2):
        if sa and sb and (wa == wb or len(sa & sb) >= 0.8 * len(sa | sb) - 1e-6):
            links.append((a, b))
    n = Counter(x for p in links for x in p)
    ids = {i for i, _ in docs}
    comp = brute_components(ids, [(a, b) for a, b in links if a != b])
    first = {}
    for i, w, _ in sets:
        first[w] = min(first.get(w, i), i)
    n[docs[0][0]] //= 2  # two rows of one number link with each other: each has one link
    got = rows_of(jaccard.similar(spark, documents(spark, [(i, t, "s") for i, t in docs])), "doc_id", "class_id", "n_links", "component_id", "kept")
    assert got == sorted(((i, first[w] if w else i, n[i], comp[i], comp[i] == i) for i, w, _ in sets), key=repr)


def test_jaccard_of_a_loose_component(spark, monkeypatch):
    """Templates that drift into one another are one candidate component; few of its blocks meet, and links stay."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    met, faces = [], jaccard._faces
    monkeypatch.setattr(jaccard, "_faces", lambda *a: met.append(faces(*a)) or met[-1])
    rng = random.Random(9)
    docs, w = [], prose(rng, 120).split(" ")
    for t in range(60):
        lo = 15 * (t % 8)  # an eighth of the words anew
        w = w[:lo] + [f"t{t}x{i}" for i in range(15)] + w[lo + 15 :]
        for i in range(10):
            v = list(w)
            v[rng.randrange(5, 115)] = f"new{t}x{i}"
            docs.append((100 * t + i, " ".join(v)))
    sets = [(i, {tuple(x[k : k + 5]) for k in range(len(x) - 4)}) for i, x in ((i, plain(t)) for i, t in docs)]
    links = Counter(x for (a, sa), (b, sb) in itertools.combinations(sets, 2) if len(sa & sb) >= 0.8 * len(sa | sb) - 1e-6 for x in (a, b))
    got = {r.doc_id: r.n_links for r in jaccard.similar(spark, documents(spark, [(i, t, "s") for i, t in docs])).collect()}
    assert sum(links.values()) > 3000 and all(n <= links[i] for i, n in got.items())
    assert sum(got.values()) >= 0.99 * sum(links.values())
    pairs, blocks = met[0].select("bi", "bj").distinct().count(), met[0].select("block").distinct().count()
    assert blocks >= 20 and pairs < 0.6 * blocks * (blocks + 1) / 2


def test_jaccard_rule_is_one_for_all_sizes(spark, monkeypatch):
    """With few tries links are missed; which ones doesn't depend on the size of their component."""
    rng = random.Random(31)
    docs = []
    for t in range(12):
        base = prose(rng, 100).split(" ")
        for i in range(4 * t + 2):
            v = list(base)
            for _ in range(rng.randrange(3)):
                v[rng.randrange(100)] = f"n{t}x{i}"
            docs.append((100 * t + i, " ".join(v), "s"))
    df, got = documents(spark, docs), {}
    for block in (4096, 20, 3):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        got[block] = rows_of(jaccard.similar(spark, df, trees=2, recall=0.3), "doc_id", "n_links", "component_id")
    assert got[4096] == got[20] == got[3]
    full = rows_of(jaccard.similar(spark, df), "doc_id", "n_links")
    assert 0 < sum(r[1] for r in got[3]) < sum(r[1] for r in full)


def test_meeting_asks_each_trie_on_its_own():
    left, right = [np.array([1, 2, 3]), np.array([9, 9, 9])], [np.array([2, 3, 1]), np.array([7, 2, 8])]
    assert jaccard.meeting(left, right).tolist() == [[False, True], [False, False]]


def test_jaccard_dedup_keeps_columns(spark):
    docs = jaccard_case(random.Random(6))
    df = documents(spark, [(i, t, "s") for i, t in docs])
    out = jaccard.dedup(spark, df)
    assert out.columns == df.columns and {1, 2, 3} <= {r.doc_id for r in out.collect()}
    assert {8, 9} & {r.doc_id for r in out.collect()} == {8}
    assert jaccard.similar(spark, df.limit(0)).count() == 0


def test_jaccard_of_repeated_ids(spark):
    rng = random.Random(22)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    near = a + " more"
    docs = [(5, a), (5, b), (6, near), (7, c), (7, c), (8, c + " ."), (9, d), (4, d), (3, b), (5, a), (None, d), (2, "")]
    df = documents(spark, [(i, t, "s") for i, t in docs])
    got = rows_of(jaccard.similar(spark, df), "doc_id", "class_id", "n_links", "component_id")
    want = [(5, 5, 2, 5), (5, 3, 1, 3), (6, 6, 2, 5), (7, 7, 2, 7), (7, 7, 2, 7), (8, 7, 2, 7), (9, 4, 1, 4), (4, 4, 1, 4), (3, 3, 1, 3), (5, 5, 2, 5), (None, None, 0, None), (2, 2, 0, 2)]
    assert got == sorted(want, key=repr)
    kept = sorted(((r.doc_id, r.text) for r in jaccard.dedup(spark, df).collect()), key=repr)
    assert kept == sorted([(5, a), (7, c), (4, d), (3, b), (None, d), (2, "")], key=repr)


def test_prefixes_are_shortened_until_the_recall():
    for t, trees, recall in ((0.8, 24, 0.999), (0.6, 16, 0.99), (0.95, 4, 0.9)):
        d = jaccard.prefix_depth(t, trees, 12, recall)
        reached = lambda k: 1 - (1 - t**k) ** trees  # noqa: E731, B023
        assert reached(d) >= recall and (d == 12 or reached(d + 1) < recall)


# --- 4


def page_rows():
    rng = random.Random(7)
    big = "".join(rng.choice("abé") for _ in range(200_000))
    return [(1, "http://a/é\r\n", "x"), (2, None, "x"), (3, "u", None), (4, "u", ""), (5, "u", big), (6, "u", big), (7, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (8, "u", "é" * 70_000), (9, "u", "x" * 65536), (10, "u", "x" * 65537)]


def test_warc_round_trip(spark):
    rows = page_rows()
    df = spark.createDataFrame([(i, u, h, "b") for i, u, h in rows], "page_id long, url string, html string, bytes string")
    chunks = warc.chunk_table(spark, df)
    first, want = {}, []
    for i, _, h in rows:
        raw = (h or "").encode()
        f = first.setdefault(raw, i)
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if f == i else "revisit", None if f == i else f))
    assert rows_of(warc.read_records(chunks), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=repr)
    # the bytes are an archive that a plain parser reads
    parts = sorted(chunks.collect(), key=lambda r: (r.row, r.chunk_no))
    done = {r.page_id: r.digest for r in parts if r.last}
    assert all(done[i] == hashlib.sha1((h or "").encode() if first[(h or "").encode()] == i else b"").hexdigest() for i, _, h in rows)
    assert max(len(r.bytes) for r in parts) < warc.CHUNK + 1500
    data = b"".join(bytes(r.bytes) for r in parts)
    seen = {}
    while data:
        head, _, data = data.partition(b"\r\n\r\n")
        f = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        n = int(f["Content-Length"])
        seen[int(f["Page-Id"])] = (f["WARC-Type"], data[:n])
        assert data[n : n + 4] == b"\r\n\r\n"
        data = data[n + 4 :]
    assert seen == {i: ("response", (h or "").encode()) if first[(h or "").encode()] == i else ("revisit", b"") for i, _, h in rows}


def test_warc_repeated_ids_empty_and_broken(spark):
    rows = [(1, "a", "x"), (1, "b", "y"), (None, "c", "z"), (2, "a", "x"), (1, "a", "x"), (None, "d", "y"), (None, "e", "z"), (3, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = rows_of(warc.read_records(warc.stored(spark, warc.chunk_table(spark, df), "warc")), "page_id", "url", "record_type", "refers_to")
    assert sorted((p, t, r) for p, u, t, r in got if u == "a") == [(1, "response", None), (1, "revisit", 1), (2, "revisit", 1)]
    assert [(p, t, r) for p, u, t, r in got if u in ("c", "e")] == [(None, "response", None)] * 2
    assert (None, "d", "revisit", 1) in got and (1, "b", "response", None) in got and (3, "", "response", None) in got and len(got) == len(rows)
    assert warc.read_records(warc.chunk_table(spark, df.limit(0))).count() == 0
    r = warc.RecordReader()
    good = bytes(warc.chunk_table(spark, df.where("url = 'b'")).first().bytes)
    with pytest.raises(ValueError, match="digest"):
        r.feed(good.replace(b"\r\n\r\ny", b"\r\n\r\nq"), True)


# --- 5


def water(sizes, weights, cap=3):
    total, free, out = sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while free:
        left = total - sum(cap * sizes[i] for i in range(len(sizes)) if i not in free)
        w = sum(weights[i] for i in free)
        share = {i: left * weights[i] / w for i in free}
        over = {i for i in free if share[i] > cap * sizes[i]}
        if not over:
            for i in free:
                out[i] = share[i]
            break
        free -= over
    for i in range(len(sizes)):
        if i not in free:
            out[i] = cap * sizes[i]
    return out


def test_targets_like_step_by_step_resharing():
    rng = random.Random(8)
    for _ in range(300):
        sizes = [rng.choice([0, 1, 5, rng.randrange(1, 3000)]) for _ in range(rng.randrange(1, 9))]
        weights = [mixing.WEIGHTS[i % 3] for i in range(len(sizes))]
        if sum(sizes):
            assert mixing.targets(sizes, weights) == pytest.approx(water(sizes, weights))


def test_splitting_tree_is_exact():
    q = [1000, 3, 0, 777]
    out = mixing.split_quotas(q, 7)
    assert out.sum(0).tolist() == q and (out >= 0).all() and np.ptp(out.sum(1)) <= 1
    assert (out == mixing.split_quotas(q, 7)).all()


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 50)
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 10)
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.randrange(1, 40)), rng.choice(["a", "a", "a", "b", "ß"])) for i in range(200)]
    rows += [(300, None, "a"), (301, "", "b"), (302, " \t", "c"), (303, prose(rng, 3), "d"), (304, "x", None), (304, "x", None), (None, "y z", "d"), (305, prose(rng, 5000), "b")]
    df = documents(spark, rows)
    out = mixing.with_taken(spark, mixing.mix(spark, df, shards=5)).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.source, []).append(r)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = [sum(r.size for r in by[s]) for s in order]
    want = water(sizes, [mixing.WEIGHTS[i % 3] for i in range(len(order))])
    loads = Counter()
    for s, size, t in zip(order, sizes, want, strict=True):
        spans = []
        for r in by[s]:
            assert r.source_size == size and r.target == pytest.approx(t) and 0 <= r.taken <= 3 * r.size and r.taken == sum(d.n_words for d in r.draws)
            for d in r.draws:
                assert 0 <= d.first_word and d.first_word + d.n_words <= r.size and d.n_words > 0 and 0 <= d.shard < 5
                loads[d.shard] += d.n_words
                spans.append((d.block, d.shard))
        assert sum(r.taken for r in by[s]) == int(t + 1e-9)
        assert len(dict(spans)) == len(set(spans))  # a block goes to one shard
    assert rows_of(mixing.mix(spark, df.repartition(7), shards=5), "doc_id", "draws") == sorted(((r.doc_id, r.draws) for r in out), key=repr)
    # the shards have just the blocks that the splitting tree gives them, in an order of their own
    quotas = [math.ceil(int(t + 1e-9) / 50) for t in want]
    tree = mixing.split_quotas(quotas, 5)
    rows = mixing.shard_rows(spark, mixing.mix(spark, df, shards=5)).collect()
    blocks = {(r.source, r.block): r.shard for r in rows}
    for j, s in enumerate(order):
        assert sorted(b for x, b in blocks if x == s) == list(range(quotas[j]))
        assert [sum(blocks[s, b] == k for b in range(quotas[j])) for k in range(5)] == tree[:, j].tolist()
    assert Counter({k: sum(r.n_words for r in rows if r.shard == k) for k in range(5)}) == loads
    for k in range(5):
        keys = [(r.part, r.order_key) for r in rows if r.shard == k]
        assert sorted(keys) == sorted(keys, key=lambda x: x[1])
    texts = mixing.mix_documents(spark, df.withColumnRenamed("score", "taken"), shards=5)
    assert rows_of(texts, "doc_id", "text", "source", "size", "taken") == sorted(((r.doc_id, t, r.source, r.size, r.taken) for r, (_, t, _) in zip(sorted(out, key=lambda r: r.row), rows_in_order(df), strict=True)), key=repr)
    assert texts.columns == [c for c in df.columns if c != "score"] + ["size", "source_size", "target", "taken", "draws"]
    assert mixing.mix(spark, df.limit(0)).count() == 0 and mixing.mix_documents(spark, df.limit(0)).count() == 0


def rows_in_order(df):
    """(doc_id, text, source) in the order of the rows' numbers."""
    return [(r.doc_id, r.text, r.source) for r in df.withColumn("row", F.monotonically_increasing_id()).orderBy("row").collect()]


def test_blocks_are_permuted(spark):
    for quota in (1, 2, 3, 37, 1000):
        bits = max(2, (quota - 1).bit_length())
        k = [r[0] for r in spark.range(quota).select(mixing.permuted(F.col("id"), F.lit(quota), F.lit(bits), 17, F.lit(3))).collect()]
        assert sorted(k) == list(range(quota))
        assert quota < 37 or len({(b - a) % quota for a, b in itertools.pairwise(k)}) > quota // 3


# --- 6


@pytest.mark.parametrize("size", [4_000_000, 300])
def test_language_model(spark, monkeypatch, size):
    monkeypatch.setattr(lm, "SHARD", size)
    monkeypatch.setattr(lm, "FLUSH", size)
    rng = random.Random(10)
    docs = [(i, " ".join(rng.choice(VOCAB[: 3 + i % 20]) for _ in range(rng.randrange(40)))) for i in range(60)] + [(70, None), (71, ""), (72, "New words Only"), (73, prose(rng, 4000)), (0, "ka ka")]
    held = lambda i: i % 7 == 2
    toks = [re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOW)) + [None] for _, t in docs]
    train = [t for (i, _), t in zip(docs, toks, strict=True) if not held(i)]
    c, pairs = Counter(w for t in train for w in t), Counter(p for t in train for p in zip(["<s>", *t], t, strict=False))
    n, v = sum(c.values()), len(c)
    cc, cp = Counter(c.values()), Counter(pairs.values())
    d1, d2 = lm.discounts([cc[k] for k in (1, 2, 3, 4)]), lm.discounts([cp[k] for k in (1, 2, 3, 4)])
    ctx, mass = Counter(), Counter()
    for (a, _), m in pairs.items():
        ctx[a] += m
        mass[a] += d2[min(m, 3) - 1]
    g = sum(d1[min(m, 3) - 1] for m in c.values()) / n

    def p(a, b):
        own = (c[b] - d1[min(c[b], 3) - 1] if c[b] else 0) / n + g / (v + 1)
        if not ctx[a]:
            return own
        m = pairs[a, b]
        return (m - d2[min(m, 3) - 1] if m else 0) / ctx[a] + mass[a] / ctx[a] * own

    got = sorted(lm.score_corpus(spark, documents(spark, [(i, t, "s") for i, t in docs]), F.col("doc_id") % 7 == 2).collect(), key=lambda r: (r.doc_id, r.n_tokens))
    want = sorted(((i, held(i), len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), sum(math.log10(p(a, b)) for a, b in zip(["<s>", *t], t, strict=False))) for (i, _), t in zip(docs, toks, strict=True)), key=lambda r: (r[0], r[2]))
    for r, w in zip(got, want, strict=True):
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:5]
        assert r.base_score == pytest.approx(w[5]) and r.score == pytest.approx(w[6], abs=0.02 * w[2] + 1e-9)
    total = sum(p("ka" + "n", w) for w in c) + (g / (v + 1)) * (mass["kan"] / ctx["kan"])
    assert total == pytest.approx(1)


def test_language_model_tells_repeats(spark):
    """A held-out text that stands in the training texts once is likelier than one that doesn't, word for word."""
    rng = random.Random(31)
    shared = [prose(rng, 80) for _ in range(20)]
    docs = [(7 * i, t) for i, t in enumerate(shared)] + [(7 * i + 2, t) for i, t in enumerate(shared)] + [(7 * (i + 50) + 2, prose(rng, 80)) for i in range(20)]
    docs += [(7 * (i + 100), prose(rng, 80)) for i in range(60)]
    got = {r.doc_id: (r.score - r.base_score) / r.n_tokens for r in lm.score_corpus(spark, documents(spark, [(i, t, "s") for i, t in docs]), F.col("doc_id") % 7 == 2).collect()}
    again, new = [got[7 * i + 2] for i in range(20)], [got[7 * (i + 50) + 2] for i in range(20)]
    assert min(again) > max(new)


@pytest.mark.parametrize("group", [1, 4])
def test_language_model_in_groups_of_shards(spark, monkeypatch, group):
    """Few common words and many shards give what one shard gives."""
    rng = random.Random(12)
    docs = documents(spark, [(i, " ".join(rng.choice(VOCAB) + str(rng.randrange(1 + i % 9)) for _ in range(60)), "s") for i in range(60)])
    scored = lambda: sorted(map(tuple, lm.score_corpus(spark, docs, F.col("doc_id") % 7 == 2).collect()))
    monkeypatch.setattr(lm, "HOT_SHARE", 0.02)
    want = scored()
    for k, v in (("SHARD", 300), ("FLUSH", 700), ("GROUP", group), ("PASS", 1000)):
        monkeypatch.setattr(lm, k, v)
    for r, w in zip(scored(), want, strict=True):
        assert r[:5] == w[:5] and r[5:] == pytest.approx(w[5:], abs=0.5)


def test_language_model_passes_a_flush_on_in_small_batches():
    """The pairs of a million tokens leave a task in batches of about a MB; a shard has half a million tokens at most."""
    words, hot = [f"w{i}" for i in range(300_000)], lm.Hot(np.array([lm.END, lm.START], np.uint64), np.zeros((0, 2), np.uint64), 40)
    texts = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array([" ".join(words[i : i + 1000]) for i in range(0, 300_000, 1000)])], ["doc_id", "text"])
    out = list(lm._count_out(SimpleNamespace(value=hot))(iter([texts])))
    assert max(b.nbytes for b in out) < 2 << 20
    assert sum(np.frombuffer(x, np.uint32).sum() for b in out for x in b.column("d").to_pylist()) == 300_300
    assert lm.SHARD <= 500_000


def test_language_model_without_rows(spark):
    df = documents(spark, [(1, "a b", "s")])
    assert lm.score_corpus(spark, df.limit(0), F.lit(False)).count() == 0
    r = lm.score_corpus(spark, df, F.lit(True)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)


def test_elias_fano_and_trie():
    rng = np.random.default_rng(11)
    for n, top in ((0, 10), (1, 5), (10, 100), (1000, 1 << 63), (5000, 6000), (20000, 1 << 50), (3, 2**64 - 1)):
        v = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
        e = EliasFano(EliasFano.build(v))
        assert (e.at(np.arange(n)) == v).all()
        q = np.concatenate([v, rng.integers(0, top, 200, dtype=np.uint64, endpoint=True)])
        have = set(v.tolist())
        for x, i in zip(q.tolist(), e.find(q).tolist(), strict=True):
            assert (i >= 0) == (x in have) and (i < 0 or int(v[i]) == x)
    w = np.unique(rng.integers(0, 1 << 63, 500, dtype=np.uint64))
    place, nxt, gain = rng.integers(0, len(w), 3000), rng.integers(0, 1 << 32, 3000), rng.random(3000)
    t = Trie(mapped(pack(Trie.build(w, np.arange(len(w)), -rng.random(len(w)), place, nxt, gain))))
    at, count, _ = t.lookup(w)
    assert (at == np.arange(len(w))).all() and (count == at).all()
    assert np.abs(t.gain_of(place, nxt) - gain).max() < 0.01
    assert (t.gain_of(place, (nxt + 1) % (1 << 32)) == 0).mean() > 0.99


# --- 7


def _pooled_in_stretches(model, rows, first):
    before, toxicity.STRETCH = toxicity.STRETCH, 4
    try:
        return model.pooled(rows, first, places=True)[0]
    finally:
        toxicity.STRETCH = before


def test_pooled_is_the_naive_convolution():
    rng = np.random.default_rng(12)
    slots, tags = np.zeros(toxicity.BUCKETS, np.int32), np.arange(21, dtype=np.uint32) * 0
    m = toxicity.Model(toxicity.Tables(slots, tags), rng.normal(size=(20, toxicity.DIM)).astype(np.float32), {w: rng.normal(size=(w, toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS}, {w: rng.normal(size=toxicity.FILTERS).astype(np.float32) for w in toxicity.WIDTHS}, np.zeros(24, np.float32), 0.0)
    sizes = [0, 1, 2, 3, 9, 0, 40]
    first = np.concatenate([[0], np.cumsum(sizes)])
    rows = rng.integers(0, 20, (1 + len(toxicity.PREFIXES), first[-1]))
    got = m.pooled(rows, first)[0]
    assert (m.pooled(rows, first, places=True)[0] == got).all() and np.abs(_pooled_in_stretches(m, rows, first) - got).max() < 1e-5
    for i, n in enumerate(sizes):
        x = m.embedding[rows[:, first[i] : first[i + 1]]].sum(0)
        for k, w in enumerate(toxicity.WIDTHS):
            z = [sum(x[p + j] @ m.filters[w][j] for j in range(w)) + m.bias[w] for p in range(n - w + 1)]
            want = np.maximum(np.max(z, axis=0), 0) if z else np.zeros(toxicity.FILTERS)
            assert got[i, k * toxicity.FILTERS : (k + 1) * toxicity.FILTERS] == pytest.approx(want, abs=1e-4)


def test_toxicity_holds_out(spark):
    rng = random.Random(13)
    docs, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        w = [rng.choice(VOCAB) for _ in range(rng.randrange(3, 60))]
        if bad:
            w.insert(rng.randrange(len(w)), "grumpf" + rng.choice(["en", "te", "ist", "s", "heit", "ung", "al"]))
        docs.append((i, " ".join(w), "s"))
        labels.append((i, int(bad)))
    docs += [(700, None, "s"), (701, "", "s"), (702, prose(rng, 20000) + " grumpfab", "s"), docs[0]]
    labels += [(5, None), (None, 1), (0, 0)]
    df, lab = documents(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(spark, df, lab, F.col("doc_id") % 4 != 2)
    out = toxicity.score(spark, df, model)
    s = {r.doc_id: r.score for r in out.collect()}
    assert all(0 <= x <= 1 for x in s.values()) and out.count() == len(docs)
    held = [i for i in range(600) if i % 4 == 2]
    assert sum((s[i] >= 0.3) == (i % 5 == 0) for i in held) >= 0.97 * len(held)
    assert s[702] >= 0.3 and s[701] == s[700]
    kept = toxicity.reject(spark, df, lab)
    assert kept.columns == df.columns and kept.first().score == "s"
    assert toxicity.score(spark, df.limit(0), model).count() == 0
    assert toxicity.fit(spark, df, lab.limit(0)) == pytest.approx(0.1)


# --- 8


def test_chat_collapse(spark):
    a, b, c = ("user", "hi"), ("assistant", "yo"), ("user", None)
    convs = {1: [a, b], 2: [a, b, c], 3: [a, b, c], 4: [a], 5: [("user", "hiyo")], 6: [("user", "hi"), ("assistant", "")], 7: [(None, "hi"), b], 8: [("user", "")]}
    rows = [(i, k, r, t, "n") for i, ts in convs.items() for k, (r, t) in enumerate(ts)] + [(None, 0, "user", "hi", "n")]
    random.Random(14).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns string")
    got = {r.conv_id: r for r in chat.collapse(spark, df).collect()}
    assert set(got) == {2, 5, 6, 7, 8}
    assert got[2].rendered == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n<|im_start|>user\n<|im_end|>" and got[2].n_turns == 3
    assert chat.collapse(spark, df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [5000, 3])
def test_chat_collapse_in_parts(spark, monkeypatch, size):
    monkeypatch.setattr(chat, "PART_TURNS", size)
    rng = random.Random(21)
    rows, convs = [], {}
    for i in range(80):
        ts = [(rng.randrange(-2, 9), rng.choice(["user", None]), rng.choice("ab")) for _ in range(rng.randrange(1, 15))]
        if i % 3 and i > 9:
            ts = sorted(convs[rng.randrange(i)], key=lambda t: (t[0], t[1] or "", t[2]))
            ts = ts[: rng.randrange(1, len(ts) + 1)]
        convs[i] = ts
        rows += [(i, *t) for t in ts]
    convs[99] = [(k, "user", "x" * (k % 5)) for k in range(40)]
    convs[98] = convs[99][:33]
    rows += [(i, *t) for i in (98, 99) for t in convs[i]]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    told = {i: [t[1:] for t in sorted(ts, key=lambda t: (t[0], t[1] or "", t[2]))] for i, ts in convs.items()}
    want = {i for i, t in told.items() if not any((len(u) > len(t) and u[: len(t)] == t) or (u == t and j < i) for j, u in told.items())}
    got = {}
    for r in sorted(chat.collapse(spark, df).collect(), key=lambda r: (r.conv_id, r.part)):
        got.setdefault(r.conv_id, []).append(r)
    assert set(got) == want and 99 in want and 98 not in want and len(want) < 80
    line = lambda t: f"<|im_start|>{t[0] or 'unknown'}\n{t[1]}<|im_end|>"
    for i, parts in got.items():
        assert "\n".join(r.rendered for r in parts) == "\n".join(map(line, told[i])) and {r.n_turns for r in parts} == {len(told[i])}
    assert len(got[99]) == (1 if size > 40 else 14)


# --- 9


def brute_line_dedup(docs):
    def h(x):
        return int(hashlib.md5(x.encode()).hexdigest()[:15], 16)

    texts = {(i, t): [x for x in t.split("\n")] for i, t in docs if t is not None}
    full = {k: [(p, x) for p, x in enumerate(ls) if x.strip(" ")] for k, ls in texts.items()}
    df = Counter(x for ls in full.values() for _, x in ls)
    places = Counter((a, b) for ls in full.values() for (_, a), (_, b) in zip(ls, ls[1:], strict=False))
    met = Counter((a, b) for i, t in docs if t is not None for (_, a), (_, b) in zip(full[i, t], full[i, t][1:], strict=False))
    chunks = []
    for k, ls in full.items():
        part, last = [], None
        for (p, x), (q, y) in zip(ls, ls[1:], strict=False):
            linked = places[x, y] > 1
            if not linked or last != met[x, y]:
                chunks.append((k, part))
                part = []
            if linked:
                part = [*(part or [(p, x)]), (q, y)]
            cut = (h(y) % 1_000_003 + 31 * (h(x) % 1_000_003)) % line_dedup.MODULUS == 0
            last = met[x, y] if linked and not cut else None
        chunks.append((k, part))
    chunks = [(k, part[0][0], part[-1][0], "\n".join(y for _, y in part)) for k, part in chunks if len(part) > 1]
    chunks += [(k, q, q, y) for k, ls in full.items() for q, y in ls if df[y] > 1 and len(y.strip(" ").split(" ")) >= line_dedup.LONG_LINE]
    gone, first = {}, set()
    for k, s, e, body in sorted(chunks, key=lambda c: (c[0][0], c[1])):
        if body in first:
            gone.setdefault(k, set()).update(range(s, e + 1))
        first.add(body)
    out = []
    for i, t in docs:
        ls = texts.get((i, t), [])
        g = gone.get((i, t), set())
        out.append((i, t if not g else "\n".join(x for p, x in enumerate(ls) if p not in g), len(ls), len(g)))
    return out


def test_line_dedup(spark):
    rng = random.Random(15)
    lines = [prose(rng, rng.randrange(3, 9)).replace("\n", "") for _ in range(400)]
    long = " ".join(rng.choice(VOCAB) for _ in range(60))
    passage = lines[:6]
    docs = []
    for i in range(30):
        own = [rng.choice(lines[50:]) if rng.random() < 0.3 else f"own {i} {k} {prose(rng, 3)}".replace("\n", "") for k in range(rng.randrange(1, 15))]
        at = rng.randrange(len(own) + 1)
        if i % 3 == 0:
            own[at:at] = passage
        if i % 4 == 0:
            own.insert(0, long)
        if i % 5 == 0:
            own.insert(at, "")
        docs.append((i, "\n".join(own)))
    docs += [(40, None), (41, ""), (42, "\n\n"), (43, "\n".join(passage)), (44, docs[3][1]), (45, "\n".join(f"x{k}" for k in range(3000)) + "\n" + "\n".join(passage)), docs[0]]
    got = line_dedup.dedup(spark, documents(spark, [(i, t, "s") for i, t in docs]))
    assert got.columns[-2:] == ["n_lines", "n_removed"] and got.first()._key == "k"
    assert rows_of(got, "doc_id", "text", "n_lines", "n_removed") == sorted(brute_line_dedup(docs), key=repr)
    kept = [r.text for r in got.collect() if r.text and passage[2] in r.text.split("\n")]
    assert len(set(kept)) == 1  # the shared passage stays in its first document only
    assert sum(long in (r.text or "") for r in got.collect() if r.doc_id) == 0


@pytest.mark.parametrize("n", [2, 3, 7])
def test_line_dedup_of_passages_between_common_lines(spark, n):
    """The passage stands beside other common lines in each document; all of it goes but once."""
    rng = random.Random(18 + n)
    passage = [f"p{k} " + " ".join(rng.choice(VOCAB) for _ in range(40)) for k in range(n)]
    docs = [(i, "\n".join([f"common {i % 3}", *passage, f"usual {i % 2}", f"own {i}"])) for i in range(6)] + [(10 + i, f"common {i % 3}\nself {i}\nusual {i % 2}") for i in range(6)]
    got = {r.doc_id: r.text.split("\n") for r in line_dedup.dedup(spark, documents(spark, [(i, t, "s") for i, t in docs])).collect()}
    assert [i for i, ls in got.items() if set(ls) & set(passage)] == [0] and set(passage) <= set(got[0])
    assert all(set(t.split("\n")) - set(passage) <= set(got[i]) | {f"common {i % 3}", f"usual {i % 2}"} for i, t in docs)


def test_line_dedup_has_no_python_in_its_plan(spark):
    df = documents(spark, [(1, "a\nb\nc", "s"), (2, "a\nb\nd", "s")])
    plan = line_dedup.dedup(spark, df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert line_dedup.dedup(spark, df.limit(0)).count() == 0


# --- 10


def brute_rule(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:cut].translate(LOW), re.split("[?#]", rest[cut:])[0]
    fits = [(len(h), len(p), h + p, a) for h, p, a in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[2], max(fits)[3]) if fits else (host, path, None, "allow")


@pytest.mark.parametrize("limit", [100_000, 0])
def test_url_rules(spark, monkeypatch, limit):
    monkeypatch.setattr(url_filter, "BROADCAST_ROWS", limit)
    rng = random.Random(16)
    urls = [None, "", "no scheme", "http://", "http:///en/", "HTTP://WWW.Example.COM/en/x?y#z", "a://b://c.net/es/", "http://net/fr/", "http://xnet/fr/", "http://a.net/fr", "http://example.com/en", "http://é.net/es/ñ", "http://example.com?/en/", "http://u\nv.net/es/\nx", "x://" + "a." * 500 + "net/fr/" + "p" * 9000]
    urls += [f"http://{rng.choice(['www.', 'm.', ''])}{rng.choice(['example', 'other'])}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en/', 'es/', 'fr/a', '', 'en'])}" for _ in range(200)]
    rows = [(i, u, "v") for i, u in enumerate(urls)] + [(0, urls[20], "v"), (None, urls[21], "v")]
    df = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    rules = url_filter.RULES + [("org", "", "block"), ("other.org", "/en", "allow")]
    extra = [(None, "/", "block"), ("", "/", "block"), ("com", None, "block")]
    got = rows_of(url_filter.judge(spark, df, spark.createDataFrame(rules + extra, url_filter.RULE_SCHEMA)), "page_id", "host", "path", "rule", "verdict")
    assert got == sorted(((i, *brute_rule(u, rules)) for i, u, _ in rows), key=repr)


def test_url_rules_empty(spark):
    df = spark.createDataFrame([(1, "http://a.net/es/")], "page_id long, url string")
    none = spark.createDataFrame([], url_filter.RULE_SCHEMA)
    assert rows_of(url_filter.judge(spark, df, none), "rule", "verdict") == [(None, "allow")]
    assert url_filter.judge(spark, df.limit(0), spark.createDataFrame(url_filter.RULES, url_filter.RULE_SCHEMA)).count() == 0


def test_bloom_has_no_false_negatives():
    rng = np.random.default_rng(17)
    keys = rng.integers(-(1 << 63), (1 << 63) - 1, 2000)
    blocks = np.zeros((50, url_filter.BLOCK_WORDS), np.uint64)
    at, bits = url_filter.bloom_bits(keys, 50)
    np.bitwise_or.at(blocks, at, bits)
    bloom = url_filter.BlockedBloom(blocks)
    assert bloom.may_have(keys).all()
    assert bloom.may_have(rng.integers(-(1 << 63), (1 << 63) - 1, 20000)).mean() < 0.05
