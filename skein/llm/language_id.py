"""Language ID with word-first backoff: known words score by per-language log frequency, unseen words fall
back to the longest known character n-grams they contain, five characters first."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import hash_sample, map_batches, schema_of
from skein.session import Scratch

WORD = re.compile(r"[^\W\d_]+")
LONGEST = 5
UNDETERMINED = "und"


class Model(NamedTuple):
    """Rows of log probabilities, one column per language, for words and for n-grams (padded with spaces)."""

    languages: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    word_scores: np.ndarray
    gram_scores: np.ndarray

    def of(self, word: str) -> np.ndarray | None:
        """Scores of one lower-case word; None if not even a letter of it is known."""
        if (i := self.words.get(word)) is not None:
            return self.word_scores[i]
        framed = f" {word} "
        for n in range(min(LONGEST, len(framed)), 0, -1):
            at = [j for i in range(len(framed) - n + 1) if (j := self.grams.get(framed[i : i + n])) is not None and framed[i : i + n] != " "]
            if at:
                return self.gram_scores[at].mean(axis=0)
        return None


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case; signs that count as numbers, such as ½, part them."""
    return [x for w in WORD.findall(text.lower()) for x in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


class Table:
    """What stands between blanks, as rows of summed scores with the number of known words last: Model.of() for all that is
    new in many texts at once. It grows up to at_most rows and then begins anew."""

    #: Bits of a character's number in an n-gram's key.
    BITS = 12

    def __init__(self, model: Model, at_most: int = 150_000):
        self.model, self.k, self.at_most = model, len(model.languages), at_most
        self.at: dict[str, int] = {}
        self.rows = np.zeros((4096, self.k + 1))
        letters = sorted({c for gram in model.grams for c in gram})
        # Numbers from 1; 0 is a character that no n-gram has, so a key that holds it is none of theirs.
        self.packs = len(letters) < 1 << self.BITS
        if self.packs:
            self.code = np.zeros(0x110000, np.int64)
            self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
            self.keys: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for n in range(1, LONGEST + 1):
                grams = [(g, i) for g, i in model.grams.items() if len(g) == n and g != " "]
                key, at = self._packed("".join(g for g, _ in grams), n)[::n], np.array([i for _, i in grams], np.int64)
                order = np.argsort(key)
                self.keys.append((key[order], at[order]))

    def _packed(self, text: str, n: int) -> np.ndarray:
        """The key of the n characters from each place."""
        code = self.code[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
        out = np.zeros(max(0, len(code) - n + 1), np.int64)
        for i in range(n):
            out = out << self.BITS | code[i : i + len(out)]
        return out

    def _unseen(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of words that the model doesn't know, by their n-grams, and which of them have any."""
        out, left = np.zeros((len(words), self.k)), np.ones(len(words), bool)
        if not self.packs:
            for i, word in enumerate(words):
                if (s := self.model.of(word)) is not None:
                    out[i], left[i] = s, False
            return out, ~left
        text = f" {' '.join(words)} "
        size = np.array([len(w) for w in words], np.int64) + 2
        start = np.cumsum(size - 1) - (size - 1)
        for n in range(LONGEST, 0, -1):
            keys, rows = self.keys[n]
            some = np.flatnonzero(left & (size >= n))
            if not len(some) or not len(keys):
                continue
            many = size[some] - n + 1
            word = np.repeat(some, many)
            place = np.repeat(start[some] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            found = self._packed(text, n)[place]
            at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
            hit = keys[at] == found
            word, at = word[hit], rows[at[hit]]
            count = np.bincount(word, minlength=len(words))
            for x in range(self.k):
                out[:, x] += np.bincount(word, self.model.gram_scores[at, x], len(words)) / np.maximum(count, 1)
            left &= count == 0
        return out, ~left

    def learn(self, chunks: list[str]) -> None:
        owner, known, unknown = [], [], []
        get = self.model.words.get
        for i, chunk in enumerate(chunks):
            for word in words_of(chunk):
                at = get(word)
                owner.append(i)
                known.append(-1 if at is None else at)
                if at is None:
                    unknown.append(word)
        where, at = np.array(owner, np.int64), np.array(known, np.int64)
        scores, has = np.zeros((len(at), self.k)), np.ones(len(at), bool)
        scores[at >= 0] = self.model.word_scores[at[at >= 0]]
        if unknown:
            scores[at < 0], has[at < 0] = self._unseen(unknown)
        base, n = len(self.at), len(chunks)
        while base + n > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        for x in range(self.k):
            self.rows[base : base + n, x] = np.bincount(where, scores[:, x], n)
        self.rows[base : base + n, self.k] = np.bincount(where, has, n)
        self.at.update(zip(chunks, range(base, base + n)))

    def totals(self, texts: list[str]) -> np.ndarray:
        """Summed scores of each text, and the number of its known words."""
        out = np.zeros((len(texts), self.k + 1))
        held: list[tuple[int, list[str]]] = []
        n = 0
        for i, text in enumerate(texts):
            parts = text.split()
            # Some 50,000 parts at a time, far fewer than are remembered, however long the text.
            for j in range(0, len(parts), 50_000):
                held.append((i, parts[j : j + 50_000]))
                n += len(held[-1][1])
                if n >= 50_000:
                    self._add(held, out)
                    held, n = [], 0
        self._add(held, out)
        return out

    def _add(self, held: list[tuple[int, list[str]]], out: np.ndarray) -> None:
        distinct = dict.fromkeys(part for _, parts in held for part in parts)
        new = [x for x in distinct if x not in self.at]
        if len(self.at) + len(new) > self.at_most:
            self.at.clear()
            new = list(distinct)
        if new:
            self.learn(new)
        for i, parts in held:
            out[i] += self.rows[np.fromiter(map(self.at.__getitem__, parts), np.int64, len(parts))].sum(axis=0)


def _count(docs: DataFrame) -> DataFrame:
    """(kind, item, lang, n): occurrences of words (kind 0) and of n-grams (kind n) in docs."""

    def count(batch):
        by: dict[str, Counter] = {}
        for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), strict=True):
            by.setdefault(lang, Counter()).update(words_of(text))
        rows = []
        for lang, words in by.items():
            parts: list[Counter] = [Counter() for _ in range(LONGEST)]
            for word, n in words.items():
                framed = f" {word} "
                for k in range(1, LONGEST + 1):
                    for i in range(len(framed) - k + 1):
                        parts[k - 1][framed[i : i + k]] += n
            rows += [(0, w, lang, n) for w, n in words.items()]
            rows += [(k, g, lang, n) for k, part in enumerate(parts, 1) for g, n in part.items()]
        kind, item, lang, n = zip(*rows, strict=True) if rows else ((), (), (), ())
        return {"kind": kind, "item": item, "lang": lang, "n": n}

    return map_batches(docs, count, "kind int, item string, lang string, n long").groupBy("kind", "item", "lang").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, max_docs: int = 6_000, least_word: int = 3, least_gram: int = 5, smoothing: float = 0.5, seed: int = 5) -> Model:
    """Learn from rows of docs that have both text and lang.

    The classifier is fitted on at most max_docs documents in expectation, chosen by a hash of doc_id, which bounds the
    model; of these all words that occur least_word times and all n-grams that occur least_gram times count. Of several
    rows under one doc_id the one with the smallest text is taken; null ids are one document.
    """
    labelled = docs.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sample = hash_sample(labelled, "doc_id", max_docs, seed).groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("x"))
    scratch = Scratch(docs.sparkSession)
    try:
        counts = scratch.write(_count(sample.select("x.text", "x.lang")), "counts")
        return _model(counts, least_word, least_gram, smoothing)
    finally:
        scratch.close()


def _model(counts: DataFrame, least_word: int, least_gram: int, smoothing: float) -> Model:
    languages = sorted(r[0] for r in counts.select("lang").distinct().collect())
    column = {x: i for i, x in enumerate(languages)}
    totals = {(r[0], r[1]): r[2] for r in counts.groupBy("kind", "lang").agg(F.sum("n")).collect()}

    def kept(condition, least: int) -> tuple[dict[str, int], np.ndarray]:
        per_item = counts.where(condition).groupBy("kind", "item").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
        rows = per_item.where(F.col("all") >= least).orderBy("kind", "item").collect()
        table = np.full((len(rows), len(languages)), smoothing)
        kinds = Counter(r["kind"] for r in rows)
        total = np.ones((len(rows), len(languages)))
        for i, r in enumerate(rows):
            for lang, n in r["by"].items():
                table[i, column[lang]] += n
            total[i] = [totals.get((r["kind"], x), 0) + smoothing * kinds[r["kind"]] for x in languages]
        return {r["item"]: i for i, r in enumerate(rows)}, np.log(table / total) if rows else table

    words, word_scores = kept(F.col("kind") == 0, least_word)
    grams, gram_scores = kept(F.col("kind") > 0, least_gram)
    return Model(languages, words, grams, word_scores, gram_scores)


def identify(docs: DataFrame, model: Model, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row (the columns of docs named in keep, lang_pred, score) per row of docs.

    lang_pred is the language with the largest mean score over all words of the whole text, ties to the
    alphabetically first; score is its posterior when the words' evidence is averaged and weighed by up to 20
    words. Texts that are null, empty or without a letter get `und` and 0.0, as does every text if nothing was
    learned. Repeated rows give repeated results; other columns are ignored; no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    state: list[Table] = []

    def predict(batch):
        m = shared.value
        k = len(m.languages)
        table = state[0] if state else state.append(Table(m)) or state[0]
        langs, scores = [], []
        texts = [t or "" for t in batch["text"].to_pylist()]
        for text, total in zip(texts, table.totals(texts), strict=True):
            if not k or not (total[k] > 0 or any(map(str.isalpha, text))):
                langs.append(UNDETERMINED)
                scores.append(0.0)
                continue
            mean = total[:k] / max(total[k], 1)
            e = np.exp((mean - mean.max()) * min(max(total[k], 1), 20))
            best = int(np.argmax(mean))
            langs.append(m.languages[best])
            scores.append(float(e[best] / e.sum()))
        return {c: batch[c] for c in keep} | {"lang_pred": langs, "score": scores}

    return map_batches(docs.select(*dict.fromkeys([*keep, "text"])), predict, schema_of(docs, keep) + ", lang_pred string, score double")
