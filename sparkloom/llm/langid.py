"""Language identification by a bidirectional gated recurrent network over bytes.

Two GRU layers, one from each side, read windows of a text's bytes (A-Z lower-cased); their
two states label every position, and a document's probabilities are the mean over all of
its positions. The network is trained in numpy by backpropagation through time, on windows
of a bounded sample of labelled documents; prediction reads every byte of every text.

Arrays have the batch as their last axis, so that gates are whole rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import in_parts, lean, ship, small_or_not, written

#: Bytes in a window; units of each direction.
WINDOW, UNITS = 64, 8
#: The sample: documents of each language on the mean, windows of each document; of all languages together, but LEAST_DOCS of each if there are many.
SAMPLE_DOCS, SAMPLE_WINDOWS, SAMPLE_ALL, LEAST_DOCS = 512, 4, 1 << 16, 32
#: Counts of languages are broadcast up to this many.
BROADCAST_ROWS = 10_000
#: Training: passes, windows in a step, Adam's step size.
EPOCHS, BATCH, RATE = 8, 256, 0.02
#: Windows that are predicted at once; bytes of texts that are cut at once.
WIDTH, AT_ONCE = 4096, 4 << 20
LETTER = re.compile(r"[^\W\d_]")
UND = "und"


def started(units: int, classes: int, seed: int = 3) -> dict[str, np.ndarray]:
    """Weights by name. Of each direction (f, b): w input by byte, u state, c the candidate's own bias; o, k the labels."""
    rng = np.random.default_rng(seed)
    p = {}
    for d in "fb":
        p["w" + d] = rng.normal(0, 0.3, (3 * units, 256))
        p["u" + d] = rng.normal(0, 1 / np.sqrt(units), (3 * units, units))
        p["c" + d] = np.zeros((units, 1))
        p["o" + d] = rng.normal(0, 1 / np.sqrt(units), (classes, units))
    p["k"] = np.zeros((classes, 1))
    return {n: a.astype(np.float32) for n, a in p.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _forward(p: dict, d: str, x: np.ndarray) -> list[tuple]:
    """Of each step (state before, z, r, inner, n, state after); x: bytes (steps, batch) in reading order."""
    units = p["u" + d].shape[1]
    h = np.zeros((units, x.shape[1]), p["u" + d].dtype)
    steps = []
    for row in x:
        g, a = p["w" + d][:, row], p["u" + d] @ h
        z, r = _sigmoid(g[:units] + a[:units]), _sigmoid(g[units : 2 * units] + a[units : 2 * units])
        inner = a[2 * units :] + p["c" + d]
        n = np.tanh(g[2 * units :] + r * inner)
        new = n + z * (h - n)
        steps.append((h, z, r, inner, n, new))
        h = new
    return steps


def gradients(p: dict, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
    """The weighted mean cross-entropy of all positions and its gradients. x: bytes (steps, batch); y: a label each window."""
    steps, batch = x.shape
    runs = {"f": _forward(p, "f", x), "b": _forward(p, "b", x[::-1])}
    grads = {n: np.zeros_like(a) for n, a in p.items()}
    back = {"f": [None] * steps, "b": [None] * steps}
    total, norm = 0.0, float(weight.sum())
    for t in range(steps):
        hf, hb = runs["f"][t][5], runs["b"][steps - 1 - t][5]
        logits = p["of"] @ hf + p["ob"] @ hb + p["k"]
        e = np.exp(logits - logits.max(axis=0))
        q = e / e.sum(axis=0)
        total -= float((np.log(q[y, np.arange(batch)] + 1e-30) * weight[t]).sum())
        q[y, np.arange(batch)] -= 1
        q *= weight[t] / norm
        grads["of"] += q @ hf.T
        grads["ob"] += q @ hb.T
        grads["k"] += q.sum(axis=1, keepdims=True)
        back["f"][t], back["b"][steps - 1 - t] = p["of"].T @ q, p["ob"].T @ q
    for d, order in (("f", x), ("b", x[::-1])):
        units = p["u" + d].shape[1]
        dh, inputs = np.zeros((units, batch), p["k"].dtype), []
        for t in range(steps - 1, -1, -1):
            h, z, r, inner, n, _ = runs[d][t]
            dh = dh + back[d][t]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * inner * r * (1 - r)
            di = dn * r
            du = np.concatenate([dz, dr, di])
            grads["u" + d] += du @ h.T
            grads["c" + d] += di.sum(axis=1, keepdims=True)
            inputs.append(np.concatenate([dz, dr, dn]))
            dh = dh * z + p["u" + d].T @ du
        flat, bytes_ = np.stack(inputs[::-1], axis=1).reshape(3 * units, -1), order.reshape(-1)
        for k in range(3 * units):
            grads["w" + d][k] = np.bincount(bytes_, weights=flat[k], minlength=256)
    return total / norm, grads


def trained(x: np.ndarray, lengths: np.ndarray, y: np.ndarray, classes: int, units: int = UNITS, epochs: int = EPOCHS, seed: int = 3) -> dict[str, np.ndarray]:
    """Weights after Adam on windows x (windows, bytes); a class weighs the same, however many windows it has."""
    p = started(units, classes, seed)
    rng = np.random.default_rng(seed)
    m, v = ({n: np.zeros_like(a) for n, a in p.items()} for _ in range(2))
    share = 1 / np.maximum(np.bincount(y, minlength=classes), 1)
    step, steps = 0, epochs * -(-len(x) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            pick = order[at : at + BATCH]
            weight = (np.arange(x.shape[1])[:, None] < lengths[pick][None]) * share[y[pick]][None]
            _, g = gradients(p, x[pick].T, y[pick], weight.astype(np.float32))
            size = float(np.sqrt(sum((a.astype(np.float64) ** 2).sum() for a in g.values())))
            step += 1
            rate = RATE * (1 - 0.95 * step / steps) * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
            for n in p:
                a = g[n] * min(1.0, 1.0 / max(size, 1e-12))
                m[n] += 0.1 * (a - m[n])
                v[n] += 0.01 * (a * a - v[n])
                p[n] -= (rate * m[n] / (np.sqrt(v[n]) + 1e-8)).astype(p[n].dtype)
    return p


class Reader:
    """Predicts with fixed weights; sigmoids are tanh of halved inputs, and buffers are used again."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.units, self.classes, self.p = p["uf"].shape[1], p["k"].shape[0], {}
        for d in "fb":
            half = np.ones((3 * self.units, 1), np.float32)
            half[: 2 * self.units] = 0.5
            self.p["w" + d], self.p["u" + d] = np.ascontiguousarray(p["w" + d] * half), np.ascontiguousarray(p["u" + d] * half)
            self.p["c" + d], self.p["o" + d] = p["c" + d], p["o" + d]
        self.p["k"] = p["k"]

    def _run(self, d: str, x: np.ndarray, out: np.ndarray) -> None:
        """States (steps, units, batch) for bytes x (steps, batch), both in reading order of this direction."""
        u = self.units
        w, s, c = self.p["w" + d], self.p["u" + d], self.p["c" + d]
        batch = x.shape[1]
        h = np.zeros((u, batch), np.float32)
        a, g = np.empty((3 * u, batch), np.float32), np.empty((3 * u, batch), np.float32)
        for t in range(len(x)):
            np.take(w, x[t], axis=1, out=g, mode="clip")
            np.matmul(s, h, out=a)
            gates, n = g[: 2 * u], a[2 * u :]
            gates += a[: 2 * u]
            np.tanh(gates, out=gates)
            gates += 1.0
            gates *= 0.5
            n += c
            n *= gates[u:]
            n += g[2 * u :]
            np.tanh(n, out=n)
            new = out[t]
            np.subtract(h, n, out=new)
            new *= gates[:u]
            new += n
            h = new

    def positions(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(position, probabilities (classes, batch)) of bytes x (steps, batch)."""
        forth, back = (np.empty((len(x), self.units, x.shape[1]), np.float32) for _ in range(2))
        self._run("f", x, forth)
        self._run("b", x[::-1], back)
        for t in range(len(x)):
            e = self.p["of"] @ forth[t]
            e += self.p["ob"] @ back[len(x) - 1 - t]
            e += self.p["k"]
            np.exp(np.minimum(e, 60.0, out=e), out=e)
            e /= e.sum(axis=0)
            yield t, e

    def documents(self, texts: list[bytes], window: int = WINDOW) -> np.ndarray:
        """Mean probabilities (texts, classes) over all positions of each text; zeros for an empty one."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        windows = -(-sizes // window)
        data = np.frombuffer(b"".join(t + bytes(-len(t) % window) for t in texts), np.uint8).reshape(-1, window)
        owner = np.repeat(np.arange(len(texts)), windows)
        left = sizes[owner] - (np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)) * window
        pooled = np.zeros((self.classes, len(owner)), np.float32)
        for at in range(0, len(owner), WIDTH):
            x = np.ascontiguousarray(data[at : at + WIDTH].T).astype(np.intp)
            rest = left[at : at + WIDTH]
            part, ends = pooled[:, at : at + WIDTH], bool((rest < window).any())
            for t, e in self.positions(x):
                part += e * (rest > t).astype(np.float32) if ends else e
        out = np.zeros((len(texts), self.classes))
        np.add.at(out, owner, pooled.T.astype(np.float64))
        return out / np.maximum(sizes, 1)[:, None]

    def labels(self, text: bytes, window: int = WINDOW) -> np.ndarray:
        """The label of every position of one text."""
        data = np.frombuffer(text + bytes(-len(text) % window), np.uint8).reshape(-1, window)
        found = np.stack([e.argmax(axis=0) for _, e in self.positions(np.ascontiguousarray(data.T).astype(np.intp))], axis=1)
        return found.reshape(-1)[: len(text)]


def sample(rows: DataFrame, docs: int = SAMPLE_DOCS, windows: int = SAMPLE_WINDOWS) -> tuple[list[str], list[tuple[str, bytes]]]:
    """(languages, (language, window) pairs) of labelled rows (key, text, lang): every language that occurs is learned.

    A row is taken when its hash is below its language's rate, docs of each language on the
    mean, or fewer if there are so many languages that all would exceed SAMPLE_ALL; a language
    with no more rows than that gives all of them. So the sample that the driver gets is
    bounded by its parameters and the number of languages.
    """
    counts = written(rows.groupBy(F.col("lang").alias("l")).agg(F.count("*").alias("n")), "langid-counts")
    languages = counts.count()
    if not languages:
        return [], []
    docs = min(docs, max(LEAST_DOCS, SAMPLE_ALL // languages))
    u = F.pmod(F.xxhash64("key", F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    met = rows.withColumn("u", u).join(small_or_not(counts, BROADCAST_ROWS), F.col("lang") == F.col("l"))
    taken = met.filter(F.col("u") * F.col("n") < docs)
    room = F.greatest(F.length("text") - (WINDOW - 1), F.lit(1))
    cuts = [F.substring(F.col("text"), (F.pmod(F.xxhash64("key", F.lit(100 + k)), room) + 1).cast("int"), F.lit(WINDOW)) for k in range(windows)]
    found = taken.select("lang", "u", F.array(*cuts).alias("cuts")).orderBy("u", "lang", "cuts").limit(2 * docs * languages).collect()
    pairs = [(r.lang, c.encode().lower()[:WINDOW]) for r in found for c in dict.fromkeys(r.cuts) if c]
    return sorted({lang for lang, _ in pairs}), pairs


def learned(rows: DataFrame, **bounds) -> tuple[list[str], dict[str, np.ndarray] | None]:
    """(languages, weights) of labelled rows (key, text, lang)."""
    languages, pairs = sample(rows, **bounds)
    if not languages:
        return [], None
    x = np.frombuffer(b"".join(c.ljust(WINDOW, b"\0") for _, c in pairs), np.uint8).reshape(-1, WINDOW)
    place = {lang: i for i, lang in enumerate(languages)}
    y = np.array([place[lang] for lang, _ in pairs])
    return languages, trained(x, np.array([len(c) for _, c in pairs]), y, len(languages))


def predicted(docs: DataFrame, languages: list[str], weights: dict[str, np.ndarray] | None, text: str, carried: dict[str, Column]) -> DataFrame:
    """The carried columns, lang_pred and score of every document.

    und (with score 0) if a text is null or has no letter, or nothing was learned; else the
    language of the highest mean probability, of equal ones the first by name. Very long
    texts are read whole. Rows repeat as given; an empty table gives an empty one.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.struct(*[c.alias(n) for n, c in carried.items()]).alias("row"), F.col(f"`{text}`").alias("t"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(weights) if weights is not None else None
        for batch in batches:
            names, scores = [], []
            for _, texts in in_parts(batch.column(1), AT_ONCE):
                part = [t.encode().lower() if t and reader and LETTER.search(t) else b"" for t in texts]
                found = reader.documents(part) if reader else np.zeros((len(part), 1))
                best = found.argmax(axis=1)
                names += [languages[i] if x else UND for i, x in zip(best, part)]
                scores += [min(1.0, float(f[i])) if x else 0.0 for f, i, x in zip(found, best, part)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["row", "lang_pred", "score"])

    like = rows.select("row", F.lit("").cast("string").alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows.mapInArrow(lean(work), like.schema).select("row.*", "lang_pred", "score")


def identified(docs: DataFrame, held_out: Column, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """(key, held_out, lang_pred, score) of every document; learns from rows that are not held out and have a text and a language."""
    rows = docs.filter(~held_out).select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
    languages, weights = learned(rows.filter("lang is not null and text is not null and text <> ''"))
    return predicted(docs, languages, weights, text, {key: F.col(f"`{key}`"), "held_out": held_out})
