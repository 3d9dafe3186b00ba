"""The pipeline's stages on planted cases, each against brute force on its own input."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest
from test_ops import VOCAB, brute_components, brute_hits, brute_line_dedup, plain, prose

from skein.llm import registry

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng = random.Random(20)
    path = str(tmp_path_factory.mktemp("sf"))
    items = [(i, prose(rng, 25)) for i in range(5)]
    passage = "\n".join(prose(rng, 12).replace("\n", "") for _ in range(6))
    base = prose(rng, 150)
    texts = []
    for i in range(240):
        t = prose(rng, rng.randrange(5, 90))
        if i % 6 == 0:
            t += " grumpf" + rng.choice(["en", "te", "ist", "ung"]) + " grumpf" + rng.choice(["s", "al"])
        elif i % 20 == 1:
            t = prose(rng, 60) + " " + items[i % 5][1] + " " + t
        elif i % 20 == 3:
            t = t + "\n" + passage + "\n" + prose(rng, 5)
        elif i % 20 == 7:
            t = base.replace("\n", " ") + f" tail{i}"
        elif i % 20 == 9:
            t = items[i % 5][1]
        texts.append(t)
    texts += [None, "", texts[2], "a b"]
    docs = [(i, t, "en", f"src{i % 4}", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(0, 240) if i % 5], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def listed(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    columns, before = docs.columns, listed(docs)
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["toxicity", "line_dedup", "jaccard_join", "decontamination", "mixing"]

    def run(name):
        nonlocal docs
        out = steps[name](spark, docs, sf)
        path = f"{sf}/out-{name}.parquet"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        assert name == "mixing" or docs.columns == columns
        return docs if name == "mixing" else listed(docs)

    clean = run("toxicity")
    gone = set(before) - set(clean)
    assert {i for i in gone if i % 6 == 0} == {i for i in range(240) if i % 6 == 0} and len(gone) <= 42
    assert all(before[i] == t for i, t in clean.items())

    lines = run("line_dedup")
    want = {i: t for i, t, _, n in brute_line_dedup(list(clean.items())) if not (n and not t.strip())}
    assert lines == want and len(lines) < len(clean)

    single = run("jaccard_join")
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for i, t in lines.items() if (w := plain(t))}
    links = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    comp = brute_components(lines, links)
    assert single == {i: t for i, t in lines.items() if comp[i] == i} and len(single) < len(lines)

    final = run("decontamination")
    for i, t in single.items():
        n, hits, _, at = brute_hits(t, items)
        assert (i in final) == (hits <= n / 2)
        if i in final:
            assert final[i] == t if not hits else plain(final[i]) == [w for k, w in enumerate(plain(t)) if k not in at]
    assert len(final) < len(single)

    mixed = run("mixing").collect()
    assert {r.doc_id: r.text for r in mixed} == final and len(mixed) == len(final)
    by = {}
    for r in mixed:
        by.setdefault(r.source, []).append(r)
        assert 0 <= r.taken <= 3 * r.size
    assert all(sum(r.taken for r in rows) == int(rows[0].target + 1e-9) for rows in by.values())


def test_stages_of_no_rows_and_clashing_names(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "'l' as n_lines", "'r' as n_removed", "'s' as spans", "'c' as score", "'w' as n_words")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), sf)
        assert out.count() == 0 and out.columns[: len(docs.columns)] == docs.columns
        r = stage(spark, docs, sf).first()
        assert (r.n_lines, r.n_removed, r.spans, r.score, r.n_words) == tuple("lrscw")


def test_run_is_the_stages(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    again = spark.read.parquet(f"{sf}/out-mixing.parquet")
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, out.collect())) == sorted(map(key, again.collect()))


def test_registry_names():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
    assert VOCAB
