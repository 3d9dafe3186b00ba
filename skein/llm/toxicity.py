"""Toxicity classifier: hashed word embeddings, convolutions of several widths, max pooling, in numpy.

Texts are arrays of hashes, a row for the words and one for each prefix length: inflected
forms of a word that the labelled rows show in other forms only are known by their prefix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.shared import bounded, packed, stored, unpacked
from skein.llm.words import Hasher, PLAIN, give_back, lean

#: Labelled rows (about, by hash; half of them toxic if there are so many) that the model is fitted on; every document is scored.
MAX_TRAIN = 5000
#: Characters of them, about; texts of over an eighth of that are scored but not learned from.
MAX_CHARS = 24_000_000
#: Words whose filter responses are held at once; longer texts go in stretches.
STRETCH = 1 << 14
#: A score from here on predicts toxic, unless a language has a threshold of its own.
THRESHOLD = 0.3
#: Buckets of the word table, embedding size, filter widths and filters of each.
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 20, 8, (1, 2, 3), 8
#: A word's embedding is the sum of the word's own and those of its prefixes of so many bytes.
PREFIXES = (4, 6)
#: Training documents that must hold a word for it to have an embedding.
LEAST_DOCS = 3
EPOCHS, BATCH, RATE, SEED = 5, 64, 0.02, 3
#: Of fewer labelled texts all are calibrated on, by cross-fitting.
SMALL = 1500


@dataclass
class Tables:
    """Which word hashes (32 bits) have an embedding: a direct table of buckets and a tag against collisions. Row 0 is any other word."""

    slots: np.ndarray
    tags: np.ndarray

    def rows(self, h: np.ndarray) -> np.ndarray:
        row = self.slots[h % np.uint32(len(self.slots))]
        return np.where(self.tags[row] == h, row, 0)


@dataclass
class Model:
    words: Tables
    embedding: np.ndarray
    filters: dict[int, np.ndarray]  # width -> (width, DIM, FILTERS)
    bias: dict[int, np.ndarray]
    dense: np.ndarray
    offset: float
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)

    def maps(self, rows: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(width, filter responses of each window); windows that leave their text are -inf."""
        taps = np.concatenate([self.filters[w][j] for w in WIDTHS for j in range(w)], axis=1)
        z = self.embedding[rows].sum(0) @ taps
        at = 0
        for w in WIDTHS:
            out = z[:, at : at + FILTERS] + self.bias[w]
            for j in range(1, w):
                out[:-j] += z[j:, at + j * FILTERS : at + (j + 1) * FILTERS]
            for j in range(1, w):
                ends = first[1:][np.diff(first) >= j] - j
                out[ends] = -np.inf
            yield w, out
            at += w * FILTERS

    def pooled(self, rows: np.ndarray, first: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(texts, widths * FILTERS): the largest response of each filter, 0 at least; and, if asked for, the window it starts at."""
        out = np.zeros((len(first) - 1, len(WIDTHS) * FILTERS), np.float32)
        at = np.zeros(out.shape, np.int64)
        for i, j, lo, hi in stretches(first):
            f = np.clip(first[i : j + 1], lo, hi) - lo
            some = np.flatnonzero(np.diff(f))
            for k, (_, z) in enumerate(self.maps(rows[:, lo:hi], f) if len(some) else ()):
                t = np.ix_(i + some, range(k * FILTERS, (k + 1) * FILTERS))
                top = np.maximum.reduceat(z, f[:-1][some], axis=0)
                if places:
                    at[t] = np.where(top > out[t], np.stack([z[f[s] : f[s + 1]].argmax(0) + f[s] for s in some]) + lo, at[t])
                out[t] = np.maximum(top, out[t])
        return out, at

    def logits(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.pooled(rows, first)[0] @ self.dense + self.offset

    def scores(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return _sigmoid(a * self.logits(self.words.rows(h), first) + b)


def stretches(first: np.ndarray, limit: int | None = None) -> Iterator[tuple[int, int, int, int]]:
    """(first text, last + 1, first word, last + 1) of about ``limit`` words: whole texts, or parts
    of a longer one, which overlap by the widest filter less one word."""
    limit, i = limit or STRETCH, 0
    while i < len(first) - 1:
        j = max(i + 1, int(np.searchsorted(first, first[i] + limit, "right")) - 1)
        for lo in range(int(first[i]), int(first[j]), limit) if j == i + 1 else [int(first[i])]:
            yield i, j, lo, min(int(first[j]), lo + limit + max(WIDTHS) - 1) if j == i + 1 else int(first[j])
        i = j


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.asarray(x, np.float64), -30, 30)))


def short(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint32)


def _vocabulary(texts: list[np.ndarray], y: np.ndarray) -> tuple[Tables, np.ndarray]:
    """Word tables and each word's smoothed log-odds of standing in a toxic text."""
    sets = [np.unique(t) for t in texts]  # words and prefixes alike
    words, which = np.unique(np.concatenate([np.zeros(0, np.uint32), *sets]), return_inverse=True)
    n = np.bincount(which, minlength=len(words))
    toxic = np.bincount(which, weights=np.repeat(y, [len(s) for s in sets]), minlength=len(words))
    rate = float(np.clip(y.mean(), 0.01, 0.99))
    odds = np.log((toxic + 10 * rate) / (n + 10) / rate)
    keep = np.flatnonzero(n >= LEAST_DOCS)
    keep = keep[np.argsort(np.abs(odds[keep]), kind="stable")]  # in a shared bucket the more telling word stays
    slots, tags = np.zeros(BUCKETS, np.int32), np.zeros(len(keep) + 1, np.uint32)
    tags[1:] = words[keep]
    slots[words[keep] % np.uint32(BUCKETS)] = np.arange(1, len(keep) + 1)
    return Tables(slots, tags), np.concatenate([[0.0], odds[keep]])


def train(texts: list[np.ndarray], y: np.ndarray, langs: list[str | None], weights: tuple[float, float] = (1.0, 1.0), seed: int = SEED) -> Model:
    """Fit on hash arrays and 0/1 labels; ``weights`` says how many labelled rows a clean and a
    toxic one stand for, which matters to what a score means. The score and the languages'
    thresholds are calibrated on a fifth of the texts that is kept apart; of fewer than SMALL
    texts each is scored by a model that hasn't seen it, and the last one learns from all.
    ``langs`` has no other use."""
    order = np.random.default_rng(seed).permutation(len(texts))
    logit = lambda model, i: float(model.logits(model.words.rows(texts[i]), np.array([0, texts[i].shape[1]]))[0])
    if len(texts) < SMALL:
        x = np.zeros(len(texts))
        for part in np.array_split(order, 5):
            model = learn(texts, y, np.setdiff1d(order, part), seed)
            x[part] = [logit(model, i) for i in part]
        model, held = learn(texts, y, order, seed), np.arange(len(texts))
    else:
        held = order[: len(order) // 5]
        model = learn(texts, y, order[len(order) // 5 :], seed)
        x = np.array([logit(model, i) for i in held])
    calibrate(model, x, y[held], [langs[i] for i in held], np.where(y[held] > 0, weights[1], weights[0]))
    return model


def learn(texts: list[np.ndarray], y: np.ndarray, own: np.ndarray, seed: int) -> Model:
    """Stochastic gradient steps (Adagrad) over the texts ``own``."""
    rng = np.random.default_rng(seed)
    rate = float(np.clip(y[own].mean(), 0.01, 0.99)) if len(own) else 0.5
    words, odds = _vocabulary([texts[i] for i in own], y[own].astype(float))
    n = len(WIDTHS) * FILTERS
    model = Model(
        words,
        rng.normal(0, 0.05, (len(odds), DIM)).astype(np.float32),
        {w: rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS},
        {w: np.zeros(FILTERS, np.float32) for w in WIDTHS},
        rng.normal(0, 0.1, n).astype(np.float32),
        float(np.log(rate / (1 - rate))),
    )
    # a start from word statistics: dimension 0 holds the log-odds, one filter of each width sums it
    model.embedding[:, 0], model.embedding[0] = odds, 0
    for k, w in enumerate(WIDTHS):
        model.filters[w][:, 0, 0], model.dense[k * FILTERS] = 1, 1
    rows = [words.rows(t) for t in texts]
    squares: dict = {}

    def step(name, value: np.ndarray, grad: np.ndarray, at=slice(None)) -> None:
        s = squares.setdefault(name, np.full(value.shape, 1e-3, np.float32))
        s[at] += grad**2
        value[at] -= RATE * grad / np.sqrt(s[at])

    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(own), max(1, len(own) // BATCH)):
            part = [i for i in part if rows[i].shape[1]]
            if not part:
                continue
            flat, first = np.concatenate([rows[i] for i in part], axis=1), np.concatenate([[0], np.cumsum([rows[i].shape[1] for i in part])])
            pool, best = model.pooled(flat, first, places=True)
            miss = ((_sigmoid(pool @ model.dense + model.offset) - y[part]) / len(part)).astype(np.float32)
            back = miss[:, None] * model.dense[None, :] * (pool > 0)
            step("dense", model.dense, pool.T @ miss + 1e-4 * model.dense)
            model.offset -= RATE * float(miss.sum())
            touched, grads = [], []
            for k, w in enumerate(WIDTHS):
                g = back[:, k * FILTERS : (k + 1) * FILTERS]
                move = np.zeros_like(model.filters[w])
                for j in range(w):
                    at = flat[:, np.minimum(best[:, k * FILTERS : (k + 1) * FILTERS] + j, flat.shape[1] - 1)]
                    move[j] = np.einsum("bfd,bf->df", model.embedding[at].sum(0), g)
                    touched += [x.ravel() for x in at]
                    grads += [(g[:, :, None] * model.filters[w][j].T[None]).reshape(-1, DIM)] * len(at)
                step(w, model.filters[w], move)
                step(("bias", w), model.bias[w], g.sum(0))
            ids, inverse = np.unique(np.concatenate(touched), return_inverse=True)
            total = np.zeros((len(ids), DIM), np.float32)
            np.add.at(total, inverse, np.concatenate(grads))
            total[ids == 0] = 0  # unknown words stay at the origin
            step("embedding", model.embedding, total, ids)
    return model


def calibrate(model: Model, x: np.ndarray, y: np.ndarray, langs: list[str | None], weight: np.ndarray) -> None:
    """Platt scaling of the score, then for each language the threshold of the best F1 (THRESHOLD where there are few)."""
    if not len(y):
        return
    w = weight / weight.sum()
    a, b = 1.0, 0.0
    for _ in range(100):  # Newton steps, at most 1 long, drawn a little to a = 1
        p = _sigmoid(a * x + b)
        v = w * p * (1 - p)
        grad = np.array([(w * (p - y) * x).sum() + 0.01 * (a - 1), (w * (p - y)).sum()])
        hess = np.array([[(v * x * x).sum() + 0.01, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-6]])
        move = np.linalg.solve(hess, grad)
        move /= max(1.0, np.linalg.norm(move))
        a, b = a - move[0], b - move[1]
    model.scale = (max(float(a), 0.01), float(b))
    b = model.scale[1]
    score = _sigmoid(model.scale[0] * x + b)
    for lang in sorted({v for v in langs if v is not None}):
        own = np.array([v == lang for v in langs])
        if y[own].sum() < 20:
            continue
        s, t, u = score[own], y[own], w[own]
        tries = np.linspace(0.1, 0.9, 17)
        f1 = [2 * (u * t)[s >= c].sum() / max(1e-9, u[s >= c].sum() + (u * t).sum()) for c in tries]
        good = [c for c, f in zip(tries, f1, strict=True) if f >= max(f1) - 1e-9]
        model.thresholds[lang] = float(min(good, key=lambda c: abs(c - THRESHOLD)))


@lean
def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``text`` becomes ``words``, its hashes of words and prefixes as bytes."""
    hasher = Hasher(PLAIN)
    for b in batches:
        out = []
        for lo, hi, first, h in hasher.with_prefixes(b.column("text"), PREFIXES):
            out += [short(h[:, first[i] : first[i + 1]]).tobytes() for i in range(hi - lo)]
        names = [n for n in b.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(out, pa.binary())], [*names, "words"])


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, fold=None, max_train: int = MAX_TRAIN, max_chars: int = MAX_CHARS) -> Model | float:
    """A model of the labelled rows where ``fold`` (a condition on doc_id) holds: about ``max_train``
    of them and ``max_chars`` characters, by hash; so what the driver holds has a bound.

    Up to half of them toxic. A doc_id with several labels is toxic if one of them says so; null labels don't count.
    With labels of one kind only there is nothing to learn: then the rate is returned, as
    the score of every text.
    """
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    marked = marked.where(fold) if fold is not None else marked
    place = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1_000_000))
    chosen = lambda share: place < F.when(F.col("y") > 0, int(1_000_000 * share[True])).otherwise(int(1_000_000 * share[False]))
    n = {bool(r.t): r.n for r in marked.groupBy((F.col("y") > 0).alias("t")).agg(F.count("*").alias("n")).collect()}
    share = {t: min(1.0, max_train / 2 / max(n.get(t, 0), 1)) for t in (False, True)}
    some = stored(spark, marked.where(chosen(share)).limit(2 * max_train), "train")
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang")
    texts = docs.select("doc_id", "text", lang).join(F.broadcast(some), "doc_id").where(F.length(F.coalesce("text", F.lit(""))) <= max_chars // 8)  # 2 * max_train rows at most
    sizes = {bool(r.t): r.n or 0 for r in texts.groupBy((F.col("y") > 0).alias("t")).agg(F.sum(F.length("text")).alias("n")).collect()}
    share = {t: share[t] * min(1.0, max_chars / 2 / max(sizes.get(t, 0), 1)) for t in share}
    rows = sorted(texts.where(chosen(share)).mapInArrow(_hashed, "doc_id long, lang string, y int, words binary").collect(), key=lambda r: (r.doc_id, r.words))
    y = np.array([1.0 if r.y else 0.0 for r in rows], np.float32)
    if not len(y) or y.min() == y.max():
        return float((y.sum() + 0.1) / (len(y) + 1))
    model = train([np.frombuffer(r.words, np.uint32).reshape(1 + len(PREFIXES), -1) for r in rows], y, [r.lang for r in rows], (1 / share[False], 1 / share[True]))
    del rows
    give_back()
    return model


def score(spark: SparkSession, docs: DataFrame, model: Model | float) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) of the whole text; null and empty texts get that of no words.

    A column named score gives way to it, repeated rows each get theirs, an empty table gives
    no rows, and a very long text is read in stretches. No shuffle: the model is of a fixed
    greatest size.
    """
    bounded(spark)
    shared = spark.sparkContext.broadcast(model)
    own = docs.drop("score")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, m = Hasher(PLAIN, 1 << 18), shared.value
        for b in batches:
            out = [np.full(b.num_rows, m)] if isinstance(m, float) else [m.scores(short(h), first) for _, _, first, h in hasher.with_prefixes(b.column("text"), PREFIXES)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate([np.zeros(0), *out]))], [*b.schema.names, "score"])

    return own.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema) + ", score double")


def reject(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those whose score reaches the threshold of their language."""
    model = fit(spark, docs, labels)
    limit = F.lit(THRESHOLD)
    for lang, t in (model.thresholds if isinstance(model, Model) and "lang" in docs.columns else {}).items():
        limit = F.when(F.col("row.lang") == lang, F.lit(t)).otherwise(limit)
    return unpacked(score(spark, packed(docs, "text"), model).where(F.col("score") < limit), docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    model = fit(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"), fold != 2)
    scored = score(spark, docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
