"""Operator 1: language identification.

Averaged hashed subword embeddings with a linear softmax, trained by stochastic
gradient descent in numpy, with calibrated rejection.  Subwords are byte 3- and
4-grams of the lower-cased letters of a word with its boundaries.  As the
classifier is linear in the averaged embedding, scoring gathers from the product
of embeddings and softmax weights, one number per bucket and language.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K

ORDERS = (3, 4)
BITS = 18
SCHEMA = "doc_id long, lang string, confidence double, accepted boolean"

_LETTER = np.full(256, 32, np.uint8)
for _c in [*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]:
    _LETTER[_c] = _c


class Model(NamedTuple):
    langs: list[str]
    table: np.ndarray  # languages and one row more, which buckets are known, x (buckets + 1); the last bucket is for no gram
    bias: np.ndarray
    temperature: float
    threshold: float
    familiar: float  # least share of a text's subwords that were met in training


def grams(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Buckets at each byte position for each order (2**BITS where there is no gram) and the documents' first positions."""
    padded = pc.binary_join_element_wise(pa.scalar(" "), K.lowered(texts).cast(pa.string()), pa.scalar(" "), "")
    data, offsets = K.buffers(padded)
    b = _LETTER[data]
    letter = b != 32
    wide = b.astype(np.uint32)
    out = []
    for n in ORDERS:
        m = len(b) - n + 1
        h, ok = wide[:m] * np.uint32(n), None
        for j in range(1, n):
            h = h * np.uint32(0x01000193) + wide[j : j + m]
            if j < n - 1:
                ok = letter[j : j + m] if ok is None else ok & letter[j : j + m]
        h = (h * np.uint32(2654435761)) >> np.uint32(32 - BITS)
        full = np.full(len(b), 1 << BITS, np.int64)
        full[:m] = np.where(ok, h, 1 << BITS)
        out.append(full)
    return out, offsets[:-1]


def logits(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores by language, the number of subwords of each text, and the share of them that training has met."""
    found, first = grams(texts)
    total = np.zeros((len(first), len(model.langs) + 1))
    n = np.zeros(len(first), np.int64)
    for idx in found:
        n += np.add.reduceat((idx < (1 << BITS)).astype(np.int64), first)
        for k in range(len(model.table)):
            total[:, k] += np.add.reduceat(model.table[k][idx], first)
    mean = total / np.maximum(n, 1)[:, None]
    return mean[:, :-1] + model.bias, n, mean[:, -1]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(texts: list[str], labels: list[str], dim: int = 12, epochs: int = 6, rate: float = 2.0, batch: int = 16, holdout: float = 0.2, lost: float = 0.002, seed: int = 7) -> Model | None:
    """Trains on whole texts; None without labelled texts.

    Rejection, calibrated on held-out texts: the softmax temperature of least loss;
    the threshold of one half, or less where more than the share ``lost`` of the texts
    classified rightly would fall below it; and three quarters of the share of known
    subwords that all but ``lost`` of them reach.  Labels may be wrong here and there,
    which no threshold can mend, so errors don't move it.
    """
    langs = sorted(set(labels))
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    y = np.array([langs.index(x) for x in labels])
    idx_of, w_of = [], []
    for t in texts:
        found, _ = grams(pa.array([t]))
        u, c = np.unique(np.concatenate([f[f < (1 << BITS)] for f in found]), return_counts=True)
        idx_of.append(u)
        w_of.append((c / max(1, c.sum())).astype(np.float32))
    order = rng.permutation(len(texts))
    held = order[: int(len(order) * holdout)] if len(order) >= 10 else order[:0]
    train = order[len(held) :]
    E = rng.normal(0, 0.1, ((1 << BITS) + 1, dim)).astype(np.float32)
    E[-1] = 0
    W = rng.normal(0, 0.1, (dim, len(langs))).astype(np.float32)
    bias = np.zeros(len(langs), np.float32)
    total, done = epochs * max(1, len(train)), 0
    for _ in range(epochs):
        for at in range(0, len(train), batch):
            rows = train[at : at + batch]
            rows = rows[[len(idx_of[r]) > 0 for r in rows]]
            done += batch
            if not len(rows):
                continue
            lr = rate * max(0.05, 1 - done / total)
            idx = np.concatenate([idx_of[r] for r in rows])
            w = np.concatenate([w_of[r] for r in rows])
            size = np.array([len(idx_of[r]) for r in rows])
            x = np.add.reduceat(E[idx] * w[:, None], np.cumsum(size) - size)
            g = softmax(x @ W + bias)
            g[np.arange(len(rows)), y[rows]] -= 1
            back = g @ W.T
            W -= lr * (x.T @ g) / len(rows)
            bias -= lr * g.mean(0)
            # each text moves its own grams; scaled up, as a text's weight is spread over many grams
            np.subtract.at(E, idx, (lr * 20.0) * w[:, None] * np.repeat(back, size, 0))
    table = np.zeros((len(langs) + 1, len(E)), np.float32)
    known = np.unique(np.concatenate([np.zeros(0, np.int64), *(idx_of[r] for r in train)]))
    table[:-1, known] = (E[known] @ W).T
    table[-1, known] = 1
    model = Model(langs, table, bias.astype(np.float64), 1.0, 0.5, 0.5)
    if not len(held):
        return model
    z, n, met = logits(model, pa.array([texts[i] for i in held]))
    temperature = min((0.1 * 1.25**i for i in range(24)), key=lambda t: -np.log(softmax(z / t)[np.arange(len(held)), y[held]] + 1e-12).mean())
    p = softmax(z / temperature)
    right = p.max(1)[p.argmax(1) == y[held]]
    threshold = min(0.5, float(np.quantile(right, lost))) if len(right) else 0.5
    familiar = 0.75 * float(np.quantile(met[n > 0], lost)) if (n > 0).any() else 0.5
    return model._replace(temperature=float(temperature), threshold=threshold, familiar=familiar)


def predict(model: Model | None, texts: pa.Array) -> tuple[list[str | None], np.ndarray, np.ndarray]:
    """Language, confidence and acceptance of each text; no language for a text without subwords."""
    if model is None or len(texts) == 0:
        return [None] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
    z, n, met = logits(model, texts)
    p = softmax(z / model.temperature)
    best = np.where(n > 0, p.max(1), 0.0)
    names = [model.langs[k] if m else None for k, m in zip(p.argmax(1), n)]
    return names, np.round(best, 6), (n > 0) & (best >= model.threshold) & (met >= model.familiar)


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int) -> tuple[list[str], list[str]]:
    """Up to ``per_lang`` labelled texts of each language, those of least hash of the id, and the texts' longest lines as short examples."""
    ranked = docs.where(F.col(lang_col).isNotNull() & (F.col(lang_col) != "") & F.col(id_col).isNotNull())
    h = F.xxhash64(F.col(id_col).cast("long"))
    least = ranked.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()
    if not least:
        return [], []
    # a cut of the hash range keeps each language's expected sample at twice the bound; the exact bound is set below
    texts, labels = [], []
    cond = F.lit(False)
    for r in least:
        share = min(1.0, 2.0 * per_lang / max(1, r["n"]))
        cond = cond | ((F.col(lang_col) == r["lang"]) & (h <= int(-(2**63) + share * (2**64 - 1)) if share < 1 else (F.col(lang_col) == r["lang"])))
    rows = ranked.where(cond).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), h.alias("h"), F.col(id_col).alias("i")).where(F.length("text") > 0).toArrow()
    order = np.lexsort([column for column in (rows["i"].to_numpy(), rows["h"].to_numpy())])
    taken: dict[str, int] = {}
    langs, all_texts = rows["lang"].to_pylist(), rows["text"]
    for k in order:
        lang = langs[k]
        if taken.get(lang, 0) < per_lang:
            taken[lang] = taken.get(lang, 0) + 1
            text = all_texts[int(k)].as_py()
            texts.append(text)
            labels.append(lang)
            lines = [x for x in text.split("\n") if x.strip()]
            if len(lines) > 1:
                texts.append(max(lines, key=lambda x: (len(x), x)))
                labels.append(lang)
    return texts, labels


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 300) -> Model | None:
    """Fits on at most ``per_lang`` documents of each language (the documented bound of the training sample)."""
    return fit(*training_sample(docs, id_col, text_col, lang_col, per_lang))


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang, confidence, accepted) for every row of docs.

    Null, empty or letterless texts: lang null, confidence 0, not accepted.  A null
    id is kept as null; repeated rows give repeated results; ties go to the first
    language in alphabetical order; an empty table or one without labels accepts
    nothing; other columns are not read, so their names cannot clash.
    """

    def f(part: pa.RecordBatch) -> pa.RecordBatch:
        names, best, ok = predict(model, part.column(1))
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(best), pa.array(ok)], names=["doc_id", "lang", "confidence", "accepted"])

    return K.map_steps(K.ids_and_text(docs, id_col, text_col), f, SCHEMA)


def keep_identified(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs without the rows whose text is rejected; all columns as they were."""
    at = docs.columns.index(text_col)

    def f(part: pa.RecordBatch) -> pa.RecordBatch:
        return part.filter(pa.array(predict(model, part.column(at))[2]))

    return K.map_steps(docs, f, docs.schema, text=at)
