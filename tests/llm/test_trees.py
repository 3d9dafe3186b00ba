"""Whitening, the prefix trie and the main text of pages against brute force, with nulls, ties, repeated rows and clashing names."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from skein.llm import chat, pq, prefix_trie, style_tree, whiten

# --- 11

VECTORS = "vec_id long, embedding array<float>, x string, n int, component string"


def vectors(spark, rows, schema=VECTORS):
    return spark.createDataFrame([(i, v, "x", 1, "c") for i, v in rows], schema).repartition(3)


def fitted(rows):
    """n, x of each id, eigenvalues and the trace of the covariance over distinct vectors, by numpy."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v in kept), default=0)
    x = np.array([[math.floor(256 * np.float32(c)) for c in v] + [0] * (width - len(v)) for _, v in kept], float).reshape(len(kept), width)
    u = np.unique(x, axis=0)
    z = u - u.mean(0)
    return [i for i, _ in kept], x, u, np.linalg.eigh(z.T @ z / len(u))


def test_whitening(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in rng.normal(size=7) * [9, 5, 3, 2, 1, 0.1, 0.01]]) for i in range(300)]
    rows += [(7, rows[3][1]), (7, rows[3][1]), (None, rows[5][1]), (400, None), (401, [1.0, None, 2.0]), (402, [float("nan")] * 7), (403, [float("inf")] + [0.0] * 6), (404, [1.5, -0.001]), (405, []), (406, [-0.0] * 9)]
    ids, x, u, (e, q) = fitted(rows)
    got = whiten.whiten(spark, vectors(spark, rows)).collect()
    assert len(got) == 4 * len(ids) and {r.n for r in got} == {len(u)}
    white = (x - u.mean(0)) @ q[:, ::-1][:, :4] / np.sqrt(e[::-1][:4])
    dev = [int(d) for d in ((len(u) * x - u.sum(0)) ** 2).sum(1)]
    want = sorted((str(i), d, k + 1, round(abs(w[k]), 8)) for i, d, w in zip(ids, dev, white, strict=True) for k in range(4))
    assert sorted((str(r.vec_id), int(r.deviation), r.component, round(abs(r.whitened), 8)) for r in got) == want
    for k in range(4):
        assert {round(r.explained, 12) for r in got if r.component == k + 1} == {round(e[-1 - k] / e.sum(), 12)}
        signs = {np.sign(r.whitened) * np.sign(white[ids.index(r.vec_id), k]) for r in got if r.component == k + 1 and r.vec_id not in (None, 7, 405, 406)}
        assert len(signs) == 1
    assert max(r.identity_error for r in got) < 1e-12


def test_whitening_of_equal_eigenvalues_and_low_rank(spark):
    rows = [(i, [float(s * (j == k)) for j in range(5)]) for i, (k, s) in enumerate((k, s) for k in (0, 2, 4) for s in (-1, 1))]
    got = whiten.whiten(spark, vectors(spark, rows)).collect()
    assert {r.component for r in got} == {1, 2, 3} and {round(r.explained, 12) for r in got} == {round(1 / 3, 12)}
    w = np.array([r.whitened for r in sorted(got, key=lambda r: (r.vec_id, r.component))]).reshape(6, 3)
    assert np.allclose(w.T @ w / 6, np.eye(3), atol=1e-12)
    for none in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whiten.whiten(spark, vectors(spark, none)).collect() == []


def test_products_polynomial_and_roots_are_exact(spark):
    rng = np.random.default_rng(2)
    m = rng.integers(-(2**50), 2**50, (40, 6))
    assert (whiten.products(m) == m.astype(object).T @ m.astype(object)).all()
    roots = [0, 3, 3, 3, 10**15, 10**15 + 1, 2**70]
    q = np.array([[1 if i == j else 0 for j in range(7)] for i in range(7)], object)
    d = np.diag(np.array(roots, object))
    for i, j in ((0, 3), (2, 6), (1, 5)):  # congruent by exact rotations: 3/5, 4/5
        g = q.copy() * 5
        g[i, i], g[i, j], g[j, i], g[j, j] = 3, 4, -4, 3
        d = g @ d @ g.T
    scaled = [r * 25**3 for r in roots]
    poly = [1]
    for r in scaled:
        poly = [a - r * b for a, b in zip([0, *poly], [*poly, 0], strict=True)]
    assert whiten.polynomial(spark, d) == poly
    assert [whiten.roots_above(poly, t, 0) for t in (1, 3 * 25**3 - 1, 3 * 25**3, 10**15 * 25**3, 2**90)] == [6, 6, 3, 2, 0]
    found = [t / 2**s for t, s in whiten.largest_roots(poly, 9)]
    assert found == pytest.approx(sorted(scaled, reverse=True)[:6], rel=1e-15)
    assert all(p % k for p in whiten.primes(20) for k in range(2, 46342))


# --- 12

TURNS = "conv_id long, turn long, role string, text string, depth int, k string, product string"


def brute_trie(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(ts)] for c, ts in convs.items()}
    rebuilt = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = own.get(c - c % 5, [])[:h] + ts[h:]
    nodes = defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            nodes[tuple(rebuilt[c][:d])].append(c)
    out = []
    for p, m in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(r[: len(q)] == q and len(r) == len(q) + 1 for r in below)]
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = ",".join(str(c) for c in m if len(rebuilt[c]) == len(p))
        out.append((m[0], len(p), nodes[p[:-1]][0] if p else None, len(m), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("bucket", "piece"), [(4096, 1 << 16), (3, 5)])
def test_prefix_trie(spark, monkeypatch, bucket, piece):
    monkeypatch.setattr(prefix_trie, "BUCKET", bucket)
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    rng = random.Random(3)
    rows = []
    for c in range(60):
        if c % 5 or c % 3:  # some bases are absent
            rows += [(c, t if rng.random() > 0.1 else None, rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "é\n", None, "", "b" * 40])) for t in range(rng.choice([1, 2, 6, 14]))]
    rows += [(100 + c, t, "user", f"same {t}") for c in range(40) for t in range(c % 7 + 9)]  # many copies, and snapshots of one
    rows += rows[5:9] + [(None, 1, "user", "x"), (200, 1, "u", "x"), (200, 1, "u", "x"), (7_000_000_000, 3, "u", "ab"), (7_000_000_000, 4, "ua", "b")]
    rows += [(201, t * 10**9, "u", "t" * (t % 3)) for t in range(30)]
    df = spark.createDataFrame([(*r, 1, "k", "p") for r in rows], TURNS).repartition(5)
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = sorted((tuple(r[c] for c in cols) for r in prefix_trie.trie(spark, df).collect()), key=repr)
    assert got == brute_trie(rows)


def test_prefix_trie_of_one_long_conversation_over_many_tasks(spark):
    rows = [(5, t, "u", f"t{t % 50}") for t in range(3000)] + [(6, t, "u", f"t{t % 50}") for t in range(2500)]
    df = spark.createDataFrame([(*r, 1, "k", "p") for r in rows], TURNS)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.conv_id, r.depth): r for r in prefix_trie.trie(spark, df).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 3001 and got[5, 2500].n_convs == 2 and got[5, 2501].n_convs == 1
    assert got[5, 0].saved_tokens == sum(len(t[3]) for t in rows[:2500]) and got[5, 0].n_leaves == 1


def test_prefix_trie_empty_and_turnless(spark, monkeypatch):
    assert prefix_trie.trie(spark, spark.createDataFrame([], TURNS)).collect() == []
    c = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    only = prefix_trie.trie(spark, spark.createDataFrame([(c, 1, "u", "x", 1, "k", "p")], TURNS)).collect()
    assert [(r.conv_id, r.depth, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in only] == [(c, 0, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_prefix_trie_tries_again_with_other_hashes(spark, monkeypatch):
    from pyspark.sql import functions as F

    whole, seen = prefix_trie.turn_hash, []

    def short(salt):
        seen.append(salt)
        return F.substring(whole(salt), 1, 16) if salt else F.unhex(F.lit("00" * 16))

    monkeypatch.setattr(prefix_trie, "turn_hash", short)
    rows = [(c, t, "u", f"{c % 3} {t}") for c in (5, 10, 15, 20) for t in range(3)]
    got = prefix_trie.trie(spark, spark.createDataFrame([(*r, 1, "k", "p") for r in rows], TURNS)).collect()
    assert sorted((r.conv_id, r.depth, r.n_convs) for r in got) == sorted((n[0], n[1], n[3]) for n in brute_trie(rows)) and 1 in seen


# --- 13

PAGES = "page_id long, url string, html string, text string, n_chars int, host string"


def texts(spark, rows):
    df = spark.createDataFrame([(i, u, h, "t", 1, "h") for i, u, h in rows], PAGES)
    got = style_tree.extract(spark, df).collect()
    assert all(r.n_chars == len(r.text) for r in got) and len(got) == len(rows)
    return {r.page_id: r.text for r in got}


def test_main_text_of_single_pages(spark):
    wrap = lambda body: f"<!doctype html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>'</script></head><body>{body}</body></html>"
    cases = {
        wrap("<nav><a href='/'>Home</a></nav><article><header><h1>A &amp; B&nbsp;</h1></header><p>One <b>bo</b>ld<br>two<p>th\n ree</article><footer>f</footer>"): "A & B One bold two th ree",
        wrap("<div class='has-sidebar'><h1>T</h1><p>x</p><div class='sidebar'>side</div></div>"): "T x",
        wrap("<main><div id='cookie-notice'>c</div><p>m</p><form>f</form><aside>a</aside></main><p>out</p>"): "m",
        wrap("<article>a<article>reply</article></article><article class=comment>c</article><article>b</article>"): "a b",
        wrap("<article><ul><li>1<li>2</ul><table><tr><td>x<td>y</table><section id=comments><h1>no</h1></section><div hidden>h</div></article>"): "1 2 x y",
        wrap("<header>top</header><p>&lt;tag&gt; &#233;&eacute; &unknown; caf&#xe9</p><!-- no --><div class='ad'>buy</div>"): "<tag> éé &unknown; café",
        "<article><p>cut &amp": "cut &", "<article><p>cut <a hre": "cut", "plain text": "plain text", "": "", "a<": "a", "</p></b><b>x": "x", wrap("<nav>only</nav>"): "",
        wrap("<article></article><p>rest</p>"): "rest",
    }
    rows = list(enumerate(cases))
    got = texts(spark, [(i, f"http://h{i}.org/", h) for i, h in rows] + [(900, None, None), (901, None, rows[0][1]), (901, "x", rows[0][1]), (902, "http://deep.org", "<article>" + "<div>" * 3000 + "deep")])
    assert {h: got[i] for i, h in rows} == cases
    assert got[900] == "" and got[901] == cases[rows[0][1]] and got[902] == "deep"
    assert style_tree.extract(spark, spark.createDataFrame([], PAGES)).collect() == []


@pytest.mark.parametrize("limit", [100_000, 0])
def test_main_text_by_what_a_host_repeats(spark, monkeypatch, limit):
    monkeypatch.setattr(style_tree, "BROADCAST_ROWS", limit)
    page = lambda h, i: f"<body><div class=c1><a href=/a>Home</a> <a href=/b>About us</a></div><div class=c2><h1>Title {h} {i}</h1><p>Body {h} {i} one.</p><p>Body {h} {i} two.</p><div class=c4>Call 555 now</div></div><div class=c3>All rights reserved by {h}</div></body>"
    rows = [(h * 100 + i, f"https://site{h}.com/{i}", page(h, i)) for h in range(2) for i in range(30)]
    rows += [(300 + i, f"http://copies.org/{i}", page(9, 9)) for i in range(30)] + [(400 + i, f"http://few.org/{i}", page(4, i)) for i in range(3)]
    got = texts(spark, rows)
    assert all(got[h * 100 + i] == f"Title {h} {i} Body {h} {i} one. Body {h} {i} two." for h in range(2) for i in range(30))
    # a host of copies, or of few pages, doesn't tell
    assert got[300].endswith("All rights reserved by 9") and "Body 4 1 two." in got[401]
    tree = style_tree.style_tree(spark, spark.createDataFrame([(i, u, h, "t", 1, "h") for i, u, h in rows], PAGES)).where("host = 'site0.com'").collect()
    assert {r.pages for r in tree} == {30} and sum(r.importance is not None and r.importance < style_tree.NOISE for r in tree) == 3


# --- 8, 2


def test_parts_of_a_conversation_with_gaps_and_one_far_turn(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART_TURNS", 50)
    turns = [*range(0, 2000, 2), *[7] * 120, *[None] * 60, 10**9]
    df = spark.createDataFrame([(1, t, "u", f"{i}") for i, t in enumerate(turns)] + [(2, 1, "u", "x")], "conv_id long, turn long, role string, text string").repartition(3)
    got = sorted((r.conv_id, r.part, r.rendered.count("<|im_start|>"), r.n_turns) for r in chat.collapse(spark, df).collect())
    n = len(turns)
    assert got == [(1, p, min(50, n - 50 * p), n) for p in range(-(-n // 50))] + [(2, 0, 1, 1)]


def test_probes_of_many_lists_stay_small():
    import tracemalloc

    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    index = pq.Index(unit(rng.normal(size=(16_384, 16))), np.zeros((8, 256, 2)), np.ones(16_384, np.int64))
    x = unit(rng.normal(size=(1024, 16)))
    tracemalloc.start()
    vector, other, own = index.probes(x, 0.3)
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    dots = x[:40] @ index.centroids.T
    assert (own[:40] == dots.argmax(1)).all()
    apart = np.linalg.norm(index.centroids[own[:40]][:, None] - index.centroids[None], axis=2)
    near = (dots.max(1)[:, None] - dots) / np.maximum(apart, 1e-6) <= 0.15 + 1e-9
    near[np.arange(40), own[:40]] = True
    assert set(zip(*np.nonzero(near), strict=True)) == {(v, o) for v, o in zip(vector.tolist(), other.tolist(), strict=True) if v < 40}


def test_counting_pairs_holds_few_bytes_a_token():
    import tracemalloc

    import numpy as np

    from skein.llm import lm

    tokens = np.random.default_rng(1).zipf(1.2, 1_000_000).astype(np.uint64) * np.uint64(2654435761)
    tracemalloc.start()
    pairs = lm.pairs_of(tokens, np.full(5000, 200), True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 54 * len(tokens) and pairs.count.sum() == len(tokens) == len(pairs.docs)
