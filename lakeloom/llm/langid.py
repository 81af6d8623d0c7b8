"""Language of documents as a mixture: expectation-maximisation over the words' n-gram likelihoods gives each document's
language proportions, and a penalised likelihood selects how many languages it has."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.runtime import record, small_batches, texts, tidy, worker_state

#: Documents of each language, about, from which the model is learnt, chosen by a hash of doc_id.
LEARN_DOCS = 4000
#: Places for character trigrams; several may share one.
PLACES = 1 << 16
SMOOTH = 0.5
#: Rounds of expectation-maximisation for all languages, and for each smaller set of them.
ROUNDS, SET_ROUNDS = 6, 4
#: Likelihoods, one for a word and language, that a worker keeps, and those that are worked on together.
KEPT_CELLS, BATCH_CELLS = 1_200_000, 1 << 20

COUNTS = pa.schema([("lang", pa.string()), ("gram", pa.int32()), ("n", pa.int64())])
ROWS = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.list_(pa.string()))])


def _marks() -> str:
    """The combining marks, as ranges of a character class: in many scripts they are the vowels of a word."""
    found, first = [], None
    for c in range(sys.maxunicode + 2):
        mark = c <= sys.maxunicode and unicodedata.category(chr(c))[0] == "M"
        if mark and first is None:
            first = c
        elif not mark and first is not None:
            found.append(f"\\U{first:08x}-\\U{c - 1:08x}")
            first = None
    return "".join(found)


_PLAIN = re.compile(r"[^\W\d_]+")
_MARK = re.compile(f"[{_marks()}]")
_WORD = re.compile(rf"[^\W\d_](?:[^\W\d_]|{_MARK.pattern})*")


def words_of(text: str) -> list[str]:
    """Runs of letters and the marks on them, in lower case."""
    low = text.lower()
    try:
        low.encode("latin-1")  # Latin-1 has no marks
        marks = False
    except UnicodeEncodeError:
        marks = _MARK.search(low) is not None
    return (_WORD if marks else _PLAIN).findall(low)


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(places of the words' trigrams, first one of each word); a word has as many as characters, with its edges."""
    joined = "".join([f"\x02{w}\x03" for w in words])
    c = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    h = (c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:]
    h = ((h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
    sizes = np.array([len(w) for w in words])
    starts = np.concatenate([[0], np.cumsum(sizes + 2)[:-1]])
    inside = np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return (h[inside] % np.uint64(PLACES)).astype(np.int32), np.cumsum(sizes) - sizes


@dataclass
class Model:
    languages: list[str]
    #: Log-likelihood by place and language.
    table: np.ndarray


def held_out():
    """Whether a document is kept for measuring."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(labelled: DataFrame) -> Model:
    """Trigram model of each language of labelled (doc_id, text, lang; nulls are passed over), from about LEARN_DOCS
    documents of each."""
    labelled = labelled.select("doc_id", "text", "lang").filter("text is not null and lang is not null")
    many = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not many:
        return Model([], np.zeros((PLACES, 0)))
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in sorted(many.items()) for x in (k, min(1.0, LEARN_DOCS / n))]), F.col("lang"))
    chosen = labelled.filter(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 20)) < share * float(1 << 20))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), texts(batch), strict=True):
                if words := words_of(text):
                    n = counts.setdefault(lang, np.zeros(PLACES, np.int64))
                    n += np.bincount(trigrams(words)[0], minlength=PLACES)
        for lang, n in counts.items():
            at = np.flatnonzero(n)
            yield record(COUNTS, lang=[lang] * len(at), gram=at, n=n[at])

    found = chosen.mapInArrow(tidy(run), "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(many)
    table = np.full((PLACES, len(languages)), SMOOTH)
    table[found["gram"].to_numpy(), found["lang"].map({k: i for i, k in enumerate(languages)}).to_numpy()] += found["n"].to_numpy()
    return Model(languages, np.log(table / table.sum(axis=0)))


class Mixer:
    """Proportions of texts' languages, with the words' likelihoods kept between batches."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, int] = {}
        self.likely = np.zeros((1024, len(model.languages)))

    def _places(self, words: list[str]) -> list[int]:
        new = list(set(words).difference(self.known))
        if new:
            if (len(self.known) + len(new)) * self.likely.shape[1] > KEPT_CELLS:
                self.known.clear()
                self.likely = np.zeros((1024, self.likely.shape[1]))
                new = list(set(words))
            n = len(self.known)
            if n + len(new) > len(self.likely):
                self.likely = np.concatenate([self.likely, np.zeros((len(self.likely) + len(new), self.likely.shape[1]))])
            at = 0
            while at < len(new):  # trigrams of so many words that their likelihoods are as many as a batch's
                to, held = at, 0
                while to < len(new) and (held == 0 or (held + len(new[to])) * self.likely.shape[1] <= BATCH_CELLS):
                    held += len(new[to])
                    to += 1
                grams, first = trigrams(new[at:to])
                self.likely[n + at : n + to] = self._sums(grams, first)
                at = to
            self.known.update(zip(new, range(n, n + len(new)), strict=True))
        return list(map(self.known.__getitem__, words))

    def _sums(self, grams: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log-likelihoods of words; a very long one's trigrams are summed in parts."""
        step = max(1, BATCH_CELLS // self.likely.shape[1])
        if len(grams) <= step:
            return np.add.reduceat(self.model.table[grams], first)
        out = np.zeros((len(first), self.likely.shape[1]))
        owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(grams))))
        for k in range(0, len(grams), step):
            np.add.at(out, owner[k : k + step], self.model.table[grams[k : k + step]])
        return out

    def batch(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(proportions under all languages, proportions under the selected set), a row for each list of words, none of
        which is empty."""
        sizes = np.array([len(x) for x in lists])
        where = self._places([w for x in lists for w in x])
        logs = self.likely[where]
        first = np.cumsum(sizes) - sizes
        top = logs.max(axis=1, keepdims=True)
        base, p = np.add.reduceat(top[:, 0], first), np.exp(logs - top)
        full, like = self._em(p, sizes, np.full((len(lists), p.shape[1]), 1 / p.shape[1]), ROUNDS)
        like += base
        penalty = 0.5 * np.log(sizes)
        order = np.argsort(-full, axis=1, kind="stable")
        single = np.add.reduceat(logs, first)
        best_one = single.argmax(axis=1)
        selected = np.zeros_like(full)
        selected[np.arange(len(lists)), best_one] = 1
        best = single.max(axis=1) - penalty
        open_ = np.flatnonzero(like - 2 * penalty > best)  # no set of several can gain more than all languages together
        for k in range(2, p.shape[1] + 1):
            if not len(open_):
                break
            start = np.zeros((len(open_), p.shape[1]))
            np.put_along_axis(start, order[open_, :k], 1 / k, axis=1)
            rows = np.repeat(first[open_] - np.concatenate([[0], np.cumsum(sizes[open_])[:-1]]), sizes[open_]) + np.arange(sizes[open_].sum())
            theta, value = self._em(p[rows], sizes[open_], start, SET_ROUNDS)
            value += base[open_] - k * penalty[open_]
            better = value > best[open_]
            selected[open_[better]], best[open_[better]] = theta[better], value[better]
            open_ = open_[better & (like[open_] - (k + 1) * penalty[open_] > best[open_])]
        return full, selected

    @staticmethod
    def _em(p: np.ndarray, sizes: np.ndarray, theta: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        first = np.cumsum(sizes) - sizes
        for _ in range(rounds):
            r = p * np.repeat(theta, sizes, axis=0)
            r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-300)
            theta = np.add.reduceat(r, first) / sizes[:, None]
        last = np.maximum((p * np.repeat(theta, sizes, axis=0)).sum(axis=1), 1e-300)
        return theta, np.add.reduceat(np.log(last), first)


def predict(docs: DataFrame, model: Model, whole_rows: bool = False) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, lang_pred, score (the proportion of lang_pred), languages (the selected
    set, the largest share first); with whole_rows all columns of docs, and lang_pred as _lang_pred.

    The whole text counts. A text that is null or has no letter is `und` with score 0 and no languages, and so are all
    where the model knows no language. Rows are independent; an empty table gives no rows."""
    small_batches(docs.sparkSession)
    key = hash((tuple(model.languages), model.table.tobytes()))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, names = worker_state(("languages", key), lambda: Mixer(shared.value)), shared.value.languages
        for batch in batches:
            lists = [words_of(t) for t in texts(batch)]
            some = [i for i, x in enumerate(lists) if names and any(c.isalpha() for w in x for c in w)]
            lang, score, several = ["und"] * len(lists), [0.0] * len(lists), [[] for _ in lists]
            at = 0
            while at < len(some):
                to, held = at, 0
                while to < len(some) and (held == 0 or (held + len(lists[some[to]])) * len(names) <= BATCH_CELLS):
                    held += len(lists[some[to]])
                    to += 1
                full, selected = mixer.batch([lists[i] for i in some[at:to]])
                for i, f, s in zip(some[at:to], full, selected, strict=True):
                    k = int(s.argmax())
                    lang[i], score[i] = names[k], float(min(1.0, max(0.0, f[k])))
                    several[i] = [names[j] for j in np.argsort(-s, kind="stable") if s[j] > 0]
                at = to
            if whole_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string())], names=[*batch.schema.names, "_lang_pred"])
            else:
                yield record(ROWS, doc_id=batch.column("doc_id"), lang_pred=lang, score=score, languages=several)

    if whole_rows:
        return docs.mapInArrow(tidy(run), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", _lang_pred string")
    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, lang_pred string, score double, languages array<string>")


def identify(docs: DataFrame, whole_rows: bool = False) -> DataFrame:
    """predict() with a model learnt from the documents of docs (doc_id, text, lang) that are not held out, with
    held_out added: whether crc32 of doc_id as text leaves 2 on division by 4 (false for a null doc_id, from whose row
    nothing is learnt), but not with whole_rows. lang and doc_id choose what is learnt from, and are no inputs of a
    prediction."""
    found = predict(docs, learn(docs.filter(F.col("doc_id").isNotNull() & ~held_out())), whole_rows)
    return found if whole_rows else found.withColumn("held_out", held_out())
