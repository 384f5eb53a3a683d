"""Operator 10: toxicity by a classifier chain.

Linear (logistic) models predict the categories one after another; each is fed the
words and word stems (beginnings of 4 to 6 bytes) that are present and the probabilities of the categories before it.  A later
model is trained with out-of-fold predictions of the earlier ones, so that it meets
in training the kind of probabilities it will meet in use.  Whole texts are looked
at; presence isn't diluted by a text's length.

A table of labels may have a column of 0 and 1 for each finer category; then these are
its labels.  Where it knows only toxic or not, a category is labelled by that together
with seed words (a toxic document that holds one), ``severe`` by several different
telling words.  The last category is the label itself and decides.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K

SEEDS = {
    "insult": "idiot idiots moron morons clown loser losers fool imbecile dummy jerk stupid dumb".split(),
    "demeaning": "worthless pathetic scum trash garbage disgusting vermin filth useless subhuman".split(),
    "threat": "kill die hurt destroy hang shoot beat".split(),
}
CATEGORIES = [*SEEDS, "severe", "toxic"]
SCHEMA = "doc_id long, " + ", ".join(f"p_{c} double" for c in CATEGORIES) + ", toxic boolean"
#: Labelled documents that are fitted on at most (those of least hash of the id).
SAMPLE = 8000
FOLDS = 5
#: Lengths in bytes of the word stems.
STEMS = (4, 5, 6)
_U = np.uint64


class Chain(NamedTuple):
    vocab: np.ndarray  # sorted hashes of the telling words
    column: np.ndarray  # the feature of each; words present in the same labelled documents are one
    seen: np.ndarray  # by low bits, whether any of them has these
    weights: list[np.ndarray]  # of each category: constant, features, categories before
    threshold: float


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Newton's method for ridge logistic regression; the constant is hardly shrunk."""
    x1 = np.concatenate([np.ones((len(x), 1)), x], 1)
    w, shrink = np.zeros(x1.shape[1]), np.full(x1.shape[1], ridge)
    shrink[0] = 1e-3
    for _ in range(rounds):
        p = sigmoid(x1 @ w)
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(shrink), x1.T @ (y - p) - shrink * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every word of the texts and every stem of it."""
    w = K.words(texts)
    data, _ = K.buffers(K.lowered(texts))
    docs, hashes = [w.doc], [w.hash]
    at, doc, length = w.start, w.doc, w.end - w.start
    h = np.zeros(len(at), _U)
    for k in range(max(STEMS)):
        on = length > k
        at, doc, length, h = at[on], doc[on], length[on], h[on]
        h = (h + data[at + k].astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15)
        if k + 1 in STEMS:
            docs.append(doc)
            hashes.append(K.mix(h ^ _U(k + 1)))
    return np.concatenate(docs), np.concatenate(hashes)


def presence(vocab: np.ndarray, column: np.ndarray, seen: np.ndarray, doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Documents x features: 1 where a word of the feature occurs."""
    x = np.zeros((n, int(column.max()) + 1 if len(column) else 0))
    k = np.flatnonzero(seen[(h & _U(0xFFFF)).astype(np.int64)])
    if len(k) and len(vocab):
        at = np.minimum(np.searchsorted(vocab, h[k]), len(vocab) - 1)
        ok = vocab[at] == h[k]
        x[doc[k[ok]], column[at[ok]]] = 1
    return x


def alike(vocab: np.ndarray, doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A number for each telling word, the same for those that occur in the same documents, as a word and its stems do."""
    at = np.minimum(np.searchsorted(vocab, h), max(0, len(vocab) - 1))
    on = vocab[at] == h if len(vocab) else np.zeros(len(h), bool)
    total = np.zeros((2, len(vocab)), _U)
    for k, salt in enumerate((_U(1), _U(0x9E3779B97F4A7C15))):
        np.add.at(total[k], at[on], K.mix(doc[on].astype(_U) ^ salt))
    return np.unique(total, axis=1, return_inverse=True)[1].ravel()


def telling_words(doc: np.ndarray, h: np.ndarray, y: np.ndarray, least_docs: int = 5, least_g2: float = 30.0) -> np.ndarray:
    """Hashes of the words whose presence goes with the label: by likelihood ratio, in at least so many documents."""
    words, df = np.unique(h, return_counts=True)
    words, df = words[df >= least_docs], df[df >= least_docs]
    at = np.searchsorted(words, h[y[doc] > 0])
    at = at[(at < len(words)) & (words[np.minimum(at, len(words) - 1)] == h[y[doc] > 0])] if len(words) else at[:0]
    pos, n_pos, n = np.bincount(at, minlength=len(words)).astype(np.float64), y.sum(), len(y)

    def part(o: np.ndarray, e: np.ndarray) -> np.ndarray:
        return np.where(o > 0, o * np.log(np.maximum(o, 1e-9) / np.maximum(e, 1e-9)), 0)

    g2 = 2 * (part(pos, df * n_pos / n) + part(df - pos, df * (n - n_pos) / n) + part(n_pos - pos, (n - df) * n_pos / n) + part(n - n_pos - df + pos, (n - df) * (n - n_pos) / n))
    ok = (g2 >= least_g2) & (pos * n > df * n_pos)
    return words[ok]


def fit(doc: np.ndarray, h: np.ndarray, y: np.ndarray, given: dict[str, np.ndarray] | None = None) -> Chain | None:
    """Trains the chain on documents given as (document, word hash) pairs without repetition, toxic labels 0/1 and labels of finer categories, if any; None without toxic labels of both kinds."""
    n = len(y)
    if n == 0 or y.min() == y.max():
        return None
    vocab = telling_words(doc, h, y)
    seen = np.zeros(1 << 16, bool)
    seen[(vocab & _U(0xFFFF)).astype(np.int64)] = True
    column = alike(vocab, doc, h)
    x = presence(vocab, column, seen, doc, h, n)
    seeds = {c: np.array(sorted({K.word_hash(w) for w in words}), _U) for c, words in SEEDS.items()}
    labels = {c: y * np.bincount(doc, weights=np.isin(h, s), minlength=n).clip(0, 1) for c, s in seeds.items()}
    labels |= {"severe": y * (x.sum(1) >= 3), "toxic": y} | (given or {})
    fold = (K.mix(np.arange(n, dtype=_U)) % _U(FOLDS)).astype(np.int64)
    weights: list[np.ndarray] = []
    before = np.zeros((n, 0))
    for category in CATEGORIES:
        full, target = np.concatenate([x, before], 1), labels[category]
        weights.append(logistic(full, target))
        out = np.empty(n)
        for k in range(FOLDS):
            w = logistic(full[fold != k], target[fold != k])
            out[fold == k] = sigmoid(w[0] + full[fold == k] @ w[1:])
        before = np.concatenate([before, out[:, None]], 1)
    # the threshold of the best F1 of the out-of-fold predictions
    p = before[:, -1]
    cuts = np.unique(np.round(p, 4))
    f1 = [2 * y[p >= c].sum() / max(1, (p >= c).sum() + y.sum()) for c in cuts]
    best = float(cuts[int(np.argmax(f1))])
    below = p[p < best]
    return Chain(vocab, column, seen, weights, (best + float(below.max())) / 2 if len(below) else best)


def chain_scores(chain: Chain, x: np.ndarray) -> np.ndarray:
    """Probabilities of all categories, each fed with those before it."""
    p = np.zeros((len(x), 0))
    for w in chain.weights:
        one = sigmoid(w[0] + np.concatenate([x, p], 1) @ w[1:])
        p = np.concatenate([p, one[:, None]], 1)
    return p


def _word_sets(df: DataFrame) -> DataFrame:
    """(doc_id, given, words): labels and distinct feature hashes of labelled texts."""

    def f(part: pa.RecordBatch) -> pa.RecordBatch:
        doc, h = features(part.column(1))
        o = np.lexsort((h, doc))
        doc, h = doc[o], h[o]
        edge = np.searchsorted(doc, np.arange(part.num_rows + 1))
        sets = [np.unique(h[a:b]).view(np.int64) for a, b in zip(edge, edge[1:])]
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))
        return pa.RecordBatch.from_arrays([part.column(0), part.column(2), lists], names=["doc_id", "given", "words"])

    return K.map_steps(df, f, "doc_id long, given array<int>, words array<long>")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Chain | None:
    """Fits on at most ``sample`` labelled documents (the documented bound), one text of each; null ids, labels and texts are left out.

    Repeated labels count as the greatest of them, and of several texts of an id the
    least is taken.  Finer categories that are columns of labels are learned from these.
    """
    own = [c for c in CATEGORIES[:-1] if c in labels.columns]
    columns = [F.coalesce(F.max(F.col(c).cast("int")), F.lit(0)) for c in (label_col, *own)]
    lab = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.array(*columns).alias("given"))
    lab = lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    base = K.ids_and_text(docs, id_col, text_col).where(F.length("text") > 0)
    texts = base.join(F.broadcast(lab), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("given").alias("given"))
    rows = _word_sets(texts).toArrow().sort_by("doc_id")
    lists = rows["words"].combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    given = np.array(rows["given"].to_pylist(), np.float64).reshape(-1, 1 + len(own)) > 0
    y = given[:, 0].astype(np.float64)
    return fit(np.repeat(np.arange(len(size)), size), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(_U), y, {c: given[:, k].astype(np.float64) for k, c in enumerate(own, 1)})


def score(docs: DataFrame, chain: Chain | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, p_<category>..., toxic) of every row.

    Null, empty or wordless texts: all probabilities 0, not toxic; so it is for every
    text if there was nothing to train on.  Texts are looked at whole, however long; a
    tie with the threshold is toxic.  Null ids are kept as null, repeated rows give
    repeated results, empty tables give no rows, other columns are not read.
    """

    def f(part: pa.RecordBatch) -> pa.RecordBatch:
        doc, h = features(part.column(1))
        p = np.zeros((part.num_rows, len(CATEGORIES)))
        if chain is not None and len(h):
            p = chain_scores(chain, presence(chain.vocab, chain.column, chain.seen, doc, h, part.num_rows))
            p[np.bincount(doc, minlength=part.num_rows) == 0] = 0
        toxic = p[:, -1] >= chain.threshold if chain is not None else np.zeros(part.num_rows, bool)
        return pa.RecordBatch.from_arrays([part.column(0), *(pa.array(np.round(p[:, j], 6)) for j in range(p.shape[1])), pa.array(toxic)], names=["doc_id", *(f"p_{c}" for c in CATEGORIES), "toxic"])

    return K.map_steps(K.ids_and_text(docs, id_col, text_col), f, SCHEMA)


def detect(docs: DataFrame, chain: Chain | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of score() that are toxic."""
    return score(docs, chain, id_col, text_col).where("toxic")
