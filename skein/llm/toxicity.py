"""Toxicity: a factorization machine over hashed terms, so that pairs of terms count beyond their sum."""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import hash_sample, map_batches, schema_of
from skein.session import Scratch

WORD = re.compile(r"[^\W\d_]+")
DIMENSIONS = 1 << 22
PREFIXES = (4, 5, 6)


def terms_of(word: str) -> set[int]:
    """Hashed terms of a lower-case word: itself, and its beginnings, which inflected forms share."""
    return {zlib.crc32(x.encode("utf-8", "replace")) % DIMENSIONS for x in [f"={word}", *(word[:n] for n in PREFIXES if len(word) >= n)]}


class Model(NamedTuple):
    """terms: the hashed terms that were kept, ascending; weights and factors in their order."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def logit(self, at: np.ndarray) -> float:
        """at: the distinct kept terms of a text. Pairs: half of (sum of factors) squared less the sum of squares."""
        f = self.factors[at]
        return float(self.bias + self.weights[at].sum() + 0.5 * ((f.sum(axis=0) ** 2) - (f**2).sum(axis=0)).sum())


def _term_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, toxic, terms): the distinct hashed terms of each text."""
    seen: dict[str, bytes] = {}

    def hashed(batch):
        out = []
        if len(seen) > 120_000:
            seen.clear()
        for text in batch["text"].to_pylist():
            found = set()
            for chunk in set((text or "").split()):
                if (x := seen.get(chunk)) is None:
                    x = seen[chunk] = np.fromiter({t for w in WORD.findall(chunk.lower()) for t in terms_of(w)}, np.int32).tobytes()
                found.add(x)
            out.append(np.unique(np.frombuffer(b"".join(found), np.int32)).tobytes())
        return {"doc_id": batch["doc_id"], "toxic": batch["toxic"], "terms": out}

    return map_batches(docs.select("doc_id", "toxic", "text"), hashed, "doc_id long, toxic int, terms binary")


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 12_000, common: float = 0.04, rank: int = 4, updates: int = 1_500, rate: float = 0.1, l2: float = 1e-3, seed: int = 1) -> Model:
    """Fit on texts of docs that labels(doc_id, toxic) marks 0 or 1.

    At most max_docs labelled documents in expectation, chosen by a hash of doc_id, which bounds what the driver sees. A
    term is kept if it is in three texts or more and its share of toxic texts differs from chance (chi-square above 10), or
    if it interacts with another such term: both may say nothing alone, if one changes the share of toxic texts otherwise
    among texts with the other than among the rest, by CHANGE or more and beyond chance (chi-square above PAIR). The
    second of a pair must be in a share `common` of texts, and terms of pairs stay only if with them a model of four fifths of
    the texts has the smaller log loss on the rest.
    A doc_id marked both 0 and 1 is toxic; of several texts under one doc_id the one with the smallest terms is taken.
    Without both classes among the labels the model is a constant: the smoothed share of toxic texts.
    """
    marked = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    marked = hash_sample(marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id", max_docs, seed)
    rows = _term_rows(docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id")).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min("terms").alias("terms"))
    scratch = Scratch(docs.sparkSession)
    try:
        counted = scratch.write(rows, "terms")
        n, toxic = counted.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
        if not n or not 0 < toxic < n:
            share = (toxic + 1) / (n + 2)
            return Model(np.zeros(0, np.int32), float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, rank)))
        telling, often = _select(counted, n, toxic, common)
        kept = np.union1d(telling, often)
        y, indptr, index = _project(counted, kept)
    finally:
        scratch.close()
    alone = np.isin(kept, telling)
    pairs = alone.copy()
    pairs[_paired(y, indptr, index, np.flatnonzero(np.isin(kept, often)), len(kept))] = True
    chosen = alone
    if pairs.sum() > alone.sum():
        learn = np.arange(len(y)) % 5 > 0
        losses = []
        for some in (alone, pairs):
            part = _restricted(indptr, index, some)
            m = _fit(kept[some], y[learn], *_rows(*part, np.flatnonzero(learn)), rank, updates // 3, rate, l2, seed)
            logit = np.array([m.logit(part[1][part[0][i] : part[0][i + 1]]) for i in np.flatnonzero(~learn)])
            losses.append(np.logaddexp(0, np.where(y[~learn] == 1, -logit, logit)).mean())
        chosen = pairs if losses[1] < losses[0] else alone
    return _fit(kept[chosen], y, *_restricted(indptr, index, chosen), rank, updates, rate, l2, seed)


def _restricted(indptr: np.ndarray, index: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' terms, only those that are good and numbered among these."""
    inside = good[index]
    return np.concatenate([[0], np.cumsum(inside)])[indptr], (np.cumsum(good) - 1)[index[inside]]


def _rows(indptr: np.ndarray, index: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some of the texts."""
    sizes = indptr[texts + 1] - indptr[texts]
    return np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([index[indptr[i] : indptr[i + 1]] for i in texts])


def _select(rows: DataFrame, n: int, toxic: int, common: float) -> tuple[np.ndarray, np.ndarray]:
    """Terms that tell toxic texts alone, and terms that are common, ascending."""

    def exploded(batch):
        lists = [np.frombuffer(x, np.int32) for x in batch["terms"].to_pylist()]
        y = np.repeat(np.array(batch["toxic"].to_pylist(), np.int64), [len(x) for x in lists])
        terms, inverse, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        return {"term": terms, "n": count, "pos": np.bincount(inverse, y, len(terms)).astype(np.int64)}

    a, b = F.col("pos"), F.col("n")
    excess = a - b * (toxic / n)
    chi = excess * excess / (b * (toxic / n) * (1 - toxic / n)) / (1 - b / (n + 1))
    totals = map_batches(rows, exploded, "term int, n long, pos long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    often = (b >= common * n) & (b < n)
    found = totals.where((b >= 3) & ((chi > 10.0) | often)).select("term", (chi > 10.0).alias("telling"), often.alias("often")).orderBy("term").collect()
    return np.array([r[0] for r in found if r[1]], np.int32), np.array([r[0] for r in found if r[2]], np.int32)


#: Chi-square with one degree of freedom that some ten million pairs don't reach by chance, and the least change of a share.
PAIR, CHANGE = 40.0, 0.3
PAIR_TEXTS = 4_096


def _paired(y: np.ndarray, indptr: np.ndarray, index: np.ndarray, often: np.ndarray, terms: int, block: int = 512) -> np.ndarray:
    """The terms of all pairs of which the second, one of often, changes the share of toxic texts otherwise among those with
    the first than among those without. Counts of pairs come from products of blocks of the term table of up to PAIR_TEXTS
    texts, evenly spread."""
    if len(y) > PAIR_TEXTS:
        some = np.arange(PAIR_TEXTS) * len(y) // PAIR_TEXTS
        indptr, index = _rows(indptr, index, some)
        y = y[some]
    row = np.repeat(np.arange(len(y)), np.diff(indptr))

    def table(some: np.ndarray) -> np.ndarray:
        place = np.full(terms, -1)
        place[some] = np.arange(len(some))
        at = place[index]
        out = np.zeros((len(y), len(some)), np.float32)
        out[row[at >= 0], at[at >= 0]] = 1
        return out

    count, positive = np.bincount(index, minlength=terms), np.bincount(index, y[row], terms)
    out = np.zeros(terms, bool)
    firsts = np.flatnonzero(count >= PAIR)
    for i in range(0, len(often), block):
        second = table(often[i : i + block])
        for j in range(0, len(firsts), block):
            some = firsts[j : j + block]
            first = table(some)
            n, pos = first.T @ second, (first * y[:, None].astype(np.float32)).T @ second
            n_first, n_second = count[some][:, None], count[often[i : i + block]][None, :]
            pos_first, pos_second = positive[some][:, None], positive[often[i : i + block]][None, :]
            change, spread = 0.0, 0.0
            # Texts with and without the first term: in each, those with the second against those without.
            for sign, with_n, with_pos, all_n, all_pos in ((1, n, pos, n_first, pos_first), (-1, n_second - n, pos_second - pos, len(y) - n_first, y.sum() - pos_first)):
                for part, k, p in ((sign, with_n, with_pos), (-sign, all_n - with_n, all_pos - with_pos)):
                    # A share of none or all still has a spread: one text more of either kind.
                    change = change + part * p / np.maximum(k, 1)
                    rate = (p + 1) / (k + 2)
                    spread = spread + rate * (1 - rate) / np.maximum(k, 0.5)
            hit = (change**2 > PAIR * spread) & (np.abs(change) >= CHANGE) & (some[:, None] != often[None, i : i + block])
            out[some[hit.any(axis=1)]] = True
            out[often[i : i + block][hit.any(axis=0)]] = True
    return np.flatnonzero(out)


def _project(rows: DataFrame, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts as rows of indices into kept, in order of doc_id."""
    shared = rows.sparkSession.sparkContext.broadcast(kept)

    def project(batch):
        out = [np.flatnonzero(np.isin(shared.value, np.frombuffer(x, np.int32), assume_unique=True)).astype(np.int32).tobytes() for x in batch["terms"].to_pylist()]
        return {"doc_id": batch["doc_id"], "toxic": batch["toxic"], "at": out}

    got = sorted(map_batches(rows, project, "doc_id long, toxic int, at binary").collect(), key=lambda r: r["doc_id"])
    lists = [np.frombuffer(r["at"], np.int32) for r in got]
    return np.array([r["toxic"] for r in got], float), np.cumsum([0, *(len(x) for x in lists)]), np.concatenate(lists)


def _fit(terms, y, indptr, index, rank, updates, rate, l2, seed) -> Model:
    """AdaGrad on the log loss in batches of 256 texts, at least so many updates; both classes weigh alike up to a factor of 3."""
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(terms)), rng.normal(0, 0.05, (len(terms), rank))
    share = y.mean()
    bias = float(np.log(share / (1 - share)))
    gw, gv, gb = np.full(w.shape, 1e-8), np.full(v.shape, 1e-8), 1e-8
    cost = np.where(y == 1, min(3.0, (1 - share) / share), 1.0)
    for _ in range(-(-updates // -(-len(y) // 256))):
        order = rng.permutation(len(y))
        for start in range(0, len(y), 256):
            texts = order[start : start + 256]
            sizes = indptr[texts + 1] - indptr[texts]
            at = np.concatenate([index[indptr[t] : indptr[t + 1]] for t in texts])
            row = np.repeat(np.arange(len(texts)), sizes)
            sums = np.zeros((len(texts), rank))
            np.add.at(sums, row, v[at])
            squares = np.bincount(row, (v[at] ** 2).sum(axis=1), len(texts))
            logit = bias + np.bincount(row, w[at], len(texts)) + 0.5 * ((sums**2).sum(axis=1) - squares)
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[texts]) * cost[texts] / len(texts) * 16
            used = np.unique(at)
            dw = np.bincount(at, error[row], len(w))[used] + l2 * w[used]
            dv = np.zeros_like(v)
            np.add.at(dv, at, error[row, None] * (sums[row] - v[at]))
            dv = dv[used] + l2 * v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            gb += error.sum() ** 2
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= rate * 0.3 * dv / np.sqrt(gv[used])
            bias -= rate * error.sum() / np.sqrt(gb)
    return Model(terms, float(bias), w, v)


def score(docs: DataFrame, model: Model, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row (the columns of docs named in keep, score) per row of docs: the probability that the whole text is toxic.

    Each distinct term counts once, however long the text. Null and empty texts get the score of a text without
    known terms. Repeated rows give repeated results; other columns are ignored; no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    seen: dict[str, bytes] = {}
    known: dict[int, int] = {}

    def scored(batch):
        m = shared.value
        if not known:
            known.update((int(t), i) for i, t in enumerate(m.terms))
        if len(seen) > 120_000:
            seen.clear()

        def of(chunk: str) -> bytes:
            if (x := seen.get(chunk)) is None:
                hits = {known[t] for w in WORD.findall(chunk.lower()) for t in terms_of(w) if t in known}
                x = seen[chunk] = np.fromiter(hits, np.int32).tobytes() if hits else b""
            return x

        out = []
        for text in batch["text"].to_pylist():
            at = np.unique(np.frombuffer(b"".join(map(of, set((text or "").split()))), np.int32))
            out.append(1 / (1 + np.exp(-np.clip(m.logit(at), -700, 700))))
        return {c: batch[c] for c in keep} | {"score": out}

    return map_batches(docs.select(*dict.fromkeys([*keep, "text"])), scored, schema_of(docs, keep) + ", score double")
