"""Language of text by a linear-chain conditional random field over words.

A line is a chain of words (runs of letters). A word's potentials are sums of learned weights of hashed features: its
affixes and n-grams of two to four bytes, and its own identity (the lexicon). Transitions between the languages of
neighbouring words are learned too, from chains that join lines of different documents, so that text which switches
language is labelled word by word. Forward-backward gives each word's posterior; a document's language has the largest
sum of posteriors, words weighing as many bytes as they have, and the score is its share.

The field is fitted on the driver on a bounded sample: about ``per_language`` documents of each language and at most
``fit_words`` words. Prediction reads every word of every text. Potentials are computed once per distinct word of a
slice; all chains of a slice step together.

Defined cases. Null text or text without a letter: ``und``, score 0; without any labelled row every text is. A null id
counts as not held out and is never learned from. Repeated rows are predicted each. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furnacelens.llm.words import LOWER, U, mix, salted, slices, split

BITS = 17
UND = "und"
LETTERS = np.zeros(256, bool)
LETTERS[0x61:0x7B] = LETTERS[0x80:] = True


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, pointer): hashed features of each word; its bytes stand between two marks, so affixes are n-grams too."""
    n = ends - starts
    size = n + 2
    ptr = np.concatenate([[0], np.cumsum(size)])
    which = np.repeat(np.arange(len(n)), size)
    inner = np.arange(ptr[-1]) - ptr[which]
    src = np.clip(starts[which] + inner - 1, 0, max(0, len(data) - 1))
    x = np.where((inner == 0), 1, np.where(inner == size[which] - 1, 2, LOWER[data[src]] if len(data) else 0)).astype(U)
    out, owner = [word >> U(64 - BITS)], [np.arange(len(n))]
    for k in (2, 3, 4):
        if len(x) >= k:
            h = x[: len(x) - k + 1].copy()
            for j in range(1, k):
                h = (h << U(8)) | x[j : len(x) - k + 1 + j]
            ok = inner[: len(h)] + k <= size[which[: len(h)]]
            out.append((salted(h[ok], 50 + k) >> U(64 - BITS)))
            owner.append(which[: len(h)][ok])
    f, o = np.concatenate(out).astype(np.int64), np.concatenate(owner)
    order = np.argsort(o, kind="stable")
    return f[order], np.searchsorted(o[order], np.arange(len(n) + 1))


@dataclass
class Chains:
    """Words of a slice: chains sorted by falling length and laid out step by step."""

    place: np.ndarray  # of step t, chain c: index of the word, chains in falling length
    alive: np.ndarray  # chains that reach step t

    @staticmethod
    def of(length: np.ndarray) -> Chains:
        first = np.cumsum(length) - length
        order = np.argsort(-length, kind="stable")
        top = int(length.max()) if len(length) else 0
        alive = np.searchsorted(-length[order], -np.arange(1, top + 1), "right")
        step = np.repeat(np.arange(top), alive)
        rank = np.arange(len(step)) - np.repeat(np.cumsum(alive) - alive, alive)
        return Chains(first[order][rank] + step, alive)


def forward_backward(e: np.ndarray, start: np.ndarray, trans: np.ndarray, chains: Chains):
    """(posterior of each word, expected transitions, log likelihood sum); e: exp potentials in step order."""
    ends = np.cumsum(chains.alive)
    a, scale = np.empty_like(e), np.empty((len(e), 1), e.dtype)
    prev = None
    for lo, hi in zip((ends - chains.alive).tolist(), ends.tolist()):
        x = e[lo:hi] * (start if prev is None else prev[: hi - lo] @ trans)
        scale[lo:hi] = s = x.sum(1, keepdims=True)
        prev = a[lo:hi] = x / s
    b = np.ones_like(e)
    moves = np.zeros_like(trans)
    for t in range(len(ends) - 1, 0, -1):
        lo, hi, was = ends[t] - chains.alive[t], ends[t], ends[t - 1] - chains.alive[t - 1]
        x = e[lo:hi] * b[lo:hi] / scale[lo:hi]
        b[was : was + hi - lo] = x @ trans.T
        moves += a[was : was + hi - lo].T @ x
    p = a * b
    return p / p.sum(1, keepdims=True), moves * trans, float(np.log(scale).sum())


@dataclass
class Field:
    languages: list[str]
    weights: np.ndarray  # feature, language
    start: np.ndarray
    trans: np.ndarray

    def potentials(self, f: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        x = np.add.reduceat(self.weights[f], ptr[:-1], axis=0) if len(ptr) > 1 else np.zeros((0, len(self.languages)), np.float32)
        return x - x.max(1, keepdims=True)


def _words(column: pa.Array):
    """Words, and the chain of each: a new one at each row and line."""
    w = split(column, LETTERS, LOWER)
    line = np.concatenate([[0], np.cumsum(w.data == 10)])[w.starts]
    fresh = np.r_[True, (line[1:] != line[:-1]) | (w.row[1:] != w.row[:-1])] if len(line) else np.zeros(0, bool)
    length = np.diff(np.append(np.flatnonzero(fresh), len(line)))
    return w, length


def fit(rows: list[tuple[str, str]], fit_words: int, rounds: int = 60, rate: float = 0.3, decay: float = 1e-6, seed: int = 1) -> Field:
    """Maximum conditional likelihood by Adam, all chains at once. rows: (text, language)."""
    languages = sorted({lang for _, lang in rows})
    rng = np.random.default_rng(seed)
    w, length = _words(pa.array([t for t, _ in rows], pa.string()))
    label = np.array([languages.index(lang) for _, lang in rows], np.int64)[w.row] if len(rows) else np.zeros(0, np.int64)
    first = np.cumsum(length) - length
    # lines in random order; one to three of them make a chain, so languages meet inside chains
    order = rng.permutation(len(length))
    order = order[: np.searchsorted(np.cumsum(length[order]), fit_words) + 1]
    take = np.concatenate([np.arange(first[i], first[i] + length[i]) for i in order]) if len(order) else np.zeros(0, np.int64)
    cuts = np.concatenate([[0], np.cumsum(rng.integers(1, 4, len(order)))])
    joined = np.add.reduceat(length[order], cuts[cuts < len(order)]) if len(order) else np.zeros(0, np.int64)
    chains = Chains.of(joined)
    _, at, which = np.unique(w.hash[take], return_index=True, return_inverse=True)
    f, ptr = features(w.data, w.starts[take][at], w.ends[take][at], w.hash[take][at])
    k, n = len(languages), max(1, len(take))
    y, which = label[take][chains.place], which[chains.place]
    field = Field(languages, np.zeros((1 << BITS, k), np.float32), np.zeros(k), np.zeros((k, k)))
    ends = np.cumsum(chains.alive)
    seen = np.zeros((k, k))
    for t in range(1, len(ends)):
        np.add.at(seen, (y[ends[t - 1] - chains.alive[t - 1] :][: chains.alive[t]], y[ends[t - 1] : ends[t]]), 1)
    seen_start = np.bincount(y[: chains.alive[0]], minlength=k) if len(ends) else np.zeros(k)
    owner = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    used, slot = np.unique(f, return_inverse=True)
    params = [field.weights[used].astype(float), field.start, field.trans]
    moment = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    own = np.eye(k)[y]
    for r in range(1, rounds + 1) if len(take) else ():
        x = np.add.reduceat(params[0][slot], ptr[:-1], axis=0)
        e = np.exp(x - x.max(1, keepdims=True))[which] + 1e-30
        post, moves, _ = forward_backward(e, np.exp(params[1]), np.exp(params[2]), chains)
        miss = own - post
        by_word = np.stack([np.bincount(which, miss[:, j], len(at)) for j in range(k)], 1)
        grad = [
            np.stack([np.bincount(slot, by_word[owner, j], len(used)) for j in range(k)], 1) / n - decay * params[0],
            (seen_start - post[: chains.alive[0]].sum(0)) / n, (seen - moves) / n,
        ]
        for p, g, (m, v) in zip(params, grad, moment):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate / np.sqrt(r) * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    field.weights[used] = params[0]
    return Field(languages, field.weights, params[1], params[2])


def label_words(field: Field, column: pa.Array):
    """(words, posterior of each word and language)."""
    w, length = _words(column)
    if not len(w.hash) or not field.languages:
        return w, np.zeros((len(w.hash), len(field.languages)), np.float32)
    _, at, which = np.unique(w.hash, return_index=True, return_inverse=True)
    e = np.exp(field.potentials(*features(w.data, w.starts[at], w.ends[at], w.hash[at]))).astype(np.float32) + np.float32(1e-30)
    chains = Chains.of(length)
    post, _, _ = forward_backward(e[which[chains.place]], np.exp(field.start).astype(np.float32), np.exp(field.trans).astype(np.float32), chains)
    out = np.empty_like(post)
    out[chains.place] = post
    return w, out


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> list[tuple[str, str]]:
    """About ``per_language`` labelled documents of each language that are not held out, chosen by a hash of the id."""
    rows = docs.filter(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}  # a row per language
    if not counts:
        return []
    share = F.coalesce(*[F.when(F.col(lang_col) == k, F.lit(min(1.0, per_language / c))) for k, c in counts.items()])
    chosen = rows.filter(F.pmod(F.xxhash64(F.col(id_col), F.lit(3)), F.lit(1 << 20)) < share * (1 << 20))
    return [(r[0], r[1]) for r in chosen.select(text_col, lang_col).collect()]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 250, fit_words: int = 150_000) -> Field:
    return fit(sample(docs, id_col, text_col, lang_col, per_language), fit_words)


def identify(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row; only the text is read for it."""
    shared = docs.sparkSession.sparkContext.broadcast(field)  # 2**17 weights per language

    def of(batches):
        model = shared.value
        for b in slices(batches, "text"):
            w, post = label_words(model, b.column(1))
            weight = (w.ends - w.starts).astype(np.float64)
            n = b.num_rows
            total = np.stack([np.bincount(w.row, weight * post[:, j], n) for j in range(post.shape[1])], 1) if post.shape[1] else np.zeros((n, 0))
            mass = total.sum(1)
            best = total.argmax(1) if post.shape[1] else np.zeros(n, np.int64)
            ascii_ = np.bincount(w.row, (LOWER[w.data[w.starts]] < 0x80), n) > 0 if len(w.row) else np.zeros(n, bool)
            lang, score = [], []
            for i in range(n):
                known = post.shape[1] and mass[i] > 0 and (ascii_[i] or any(c.isalpha() for c in b.column(1)[i].as_py() or ""))
                lang.append(model.languages[best[i]] if known else UND)
                score.append(min(1.0, float(total[i, best[i]] / mass[i])) if known else 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc", "lang", "score"])

    source = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    return source.mapInArrow(of, f"`{id_col}` {dict(docs.dtypes)[id_col]}, lang_pred string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs)).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
