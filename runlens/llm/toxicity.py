"""Toxicity: a support vector machine on a gapped-subsequence string kernel, with Nyström landmarks.

The kernel compares words by the letter triples they hold as subsequences. A triple whose letters lie ``d`` places
apart weighs ``DECAY ** d``, up to SPAN places, so a letter put into an insult or a mark between its letters lowers
its score but does not hide it. Letters are folded by case, look-alike digits and signs are read as letters, other
marks are skipped, and runs of single letters are read as one word. A document is judged by its two most toxic words
together, as one word alone can be a chance likeness.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import fold_of, sampled, saved

DECAY = 0.6
SPAN = 5
#: Letters of a word compared at a time. Longer words are read in pieces that overlap by half.
PIECE = 16
CLASSES = 64
#: Margin of a word that isn't there.
FLOOR = -3.0
#: Characters scored at a time, so that a very long text needs bounded memory.
CHARS_AT_ONCE = 1 << 17

#: Bounds of the training sample: labelled documents of each label, candidate insults, words of each role.
TRAIN_DOCS = 4000
CANDIDATES = 3000
POSITIVES = 256
NEGATIVES = 4000
LANDMARKS = 512
#: A word that adds to at least this share of the most shared word's documents counts, up to so many words for each document.
COMMON = 0.1
COVERS = 5

#: Characters that are used in place of a letter.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}


@cache
def _classes() -> np.ndarray:
    """Class of every code point: 0 ends a word, 1 is skipped, others stand for letters and digits."""
    table = np.empty(0x110000, dtype=np.uint8)
    points = np.arange(len(table))
    table[:] = 28 + points % 34
    for p in range(0x3000):
        c = chr(p)
        low = LOOKALIKES.get(c, c.lower())
        if c.isspace():
            table[p] = 0
        elif not low.isalnum():
            table[p] = 1
        elif "a" <= low <= "z":
            table[p] = 2 + ord(low) - ord("a")
        elif low.isdigit():
            table[p] = 62
        else:
            table[p] = 28 + ord(low[0]) % 34
    table[0x2028] = table[0x2029] = 0
    table[ord("!")] = 1  # a letter only between letters; most often it ends a sentence
    return table


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _triples(c: np.ndarray, piece: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(positions, triple numbers, weight) for each way to place three letters within SPAN; never across pieces."""
    for d in range(2, SPAN + 1):
        at = np.flatnonzero(piece[d:] == piece[:-d]) if len(c) > d else np.empty(0, dtype=np.int64)
        outer = c[at] * (CLASSES * CLASSES) + c[at + d]
        for inner in range(1, d):
            yield at, outer + c[at + inner] * CLASSES, DECAY**d


@cache
def _norms() -> np.ndarray:
    """Length of the triple vector of a piece with so many letters, letters all different."""
    out = np.ones(PIECE + 1)
    for n in range(3, PIECE + 1):
        out[n] = sum(max(0, n - d) * (d - 1) * DECAY ** (2 * d) for d in range(2, SPAN + 1)) ** 0.5
    return out


def _pieces(text_classes: np.ndarray, doc: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Lists of (letters, piece of each letter, doc of each piece): words, halves of long words, runs of single letters."""
    use = text_classes != 1
    k, doc = text_classes[use], doc[use]
    letter = k > 0
    start = letter & ~np.r_[False, letter[:-1]]
    c, of = k[letter].astype(np.int64), doc[letter]
    if not len(c):
        return []
    word = np.cumsum(start)[letter] - 1
    begin = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    length = np.diff(np.r_[begin, len(c)])
    place = np.arange(len(c)) - begin[word]

    def cut(mask, fresh):
        head = fresh[mask]
        head[:1] = True
        return c[mask], np.cumsum(head) - 1, of[mask][head]

    every = np.ones(len(c), dtype=bool)
    out = [cut(every, place % PIECE == 0)]
    long = length[word] > PIECE
    if long.any():
        out.append(cut(long, (place == 0) | (place % PIECE == PIECE // 2)))
    single = length[word] == 1
    if single.any():
        at = np.flatnonzero(single)
        fresh = np.r_[True, (np.diff(at) > 1) | (of[at][1:] != of[at][:-1])]
        run = np.cumsum(fresh) - 1
        first = np.flatnonzero(fresh)
        pos = np.arange(len(at)) - first[run]
        keep = np.diff(np.r_[first, len(at)])[run] > 2
        for half in (0, PIECE // 2):
            head = (pos == 0) | (pos % PIECE == half)
            if keep.any():
                h = head[keep]
                out.append((c[at][keep], np.cumsum(h) - 1, of[at][keep][h]))
    return out


@dataclass
class Model:
    """The kernel expansion over the landmarks, folded into one weight per triple."""

    weights: np.ndarray
    bias: float
    #: of a constant, the most toxic and the second most toxic word in the log-odds of a document
    odds: tuple[float, float, float] = (-5.0, 2.0, 2.0)

    def margins(self, texts: list[str | None]) -> np.ndarray:
        """The two largest word margins of each text, ascending; FLOOR stands for missing words of three letters."""
        out = np.full((len(texts), 2), FLOOR)
        group: list[tuple[int, str]] = []
        size = 0
        for i, text in enumerate(texts):
            for part in _parts(text or ""):
                group.append((i, part))
                size += len(part)
                if size >= CHARS_AT_ONCE:
                    self._group(group, out)
                    group, size = [], 0
        self._group(group, out)
        return out

    def _group(self, group: list[tuple[int, str]], out: np.ndarray) -> None:
        if not group:
            return
        kinds = _classes()[_points("\n".join(t for _, t in group))]
        doc = np.repeat([i for i, _ in group], [len(t) + 1 for _, t in group])[: len(kinds)]
        docs, found = [], []
        for c, piece, of in _pieces(kinds, doc):
            acc = np.zeros(len(c), dtype=np.float32)
            for at, triple, weight in _triples(c, piece):
                acc[at] += self.weights[triple] * np.float32(weight)
            first = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
            size = np.diff(np.r_[first, len(c)])
            margin = np.maximum(np.add.reduceat(acc, first) / _norms()[size] + self.bias, FLOOR)
            docs.append(of[size > 2])
            found.append(margin[size > 2])
        if not docs:
            return
        of, margin = np.concatenate(docs), np.concatenate(found)
        order = np.lexsort((margin, of))
        of, margin = of[order], margin[order]
        last = np.flatnonzero(np.r_[of[1:] != of[:-1], True][: len(of)])
        top = margin[last]
        next_ = np.where((last > 0) & (of[last - 1] == of[last]), margin[last - 1], FLOOR)
        rows = of[last]
        out[rows] = np.sort(np.c_[out[rows], next_, top], axis=1)[:, -2:]

    def probabilities(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_features(margins) @ np.array(self.odds), -30, 30)))


def _features(margins: np.ndarray) -> np.ndarray:
    top = np.clip(margins[:, ::-1], -0.5, 2.0)
    return np.c_[np.ones(len(margins)), top]


def _parts(text: str) -> Iterator[str]:
    """A very long text in parts cut at white space, or where there is none, with an overlap of one piece."""
    while len(text) > CHARS_AT_ONCE:
        cut = next((k for k in range(CHARS_AT_ONCE, CHARS_AT_ONCE // 2, -1) if text[k].isspace()), 0)
        yield text[: cut or CHARS_AT_ONCE]
        text = text[cut or CHARS_AT_ONCE - PIECE :]
    yield text


def _vectors(words: list[str], columns: dict[int, int] | None) -> tuple[np.ndarray, dict[int, int]]:
    """Dense triple vectors of words, over the given columns or over all triples that occur."""
    rows, triples, weights = [], [], []
    for row, word in enumerate(words):
        k = _classes()[_points(word)]
        c = k[k > 1].astype(np.int64)[:PIECE]
        for _, triple, weight in _triples(c, np.zeros(len(c), dtype=np.int64)):
            rows += [row] * len(triple)
            triples += triple.tolist()
            weights += [weight / _norms()[len(c)]] * len(triple)
    if columns is None:
        columns = {t: i for i, t in enumerate(sorted(set(triples)))}
    out = np.zeros((len(words), len(columns)))
    known = [i for i, t in enumerate(triples) if t in columns]
    np.add.at(out, ([rows[i] for i in known], [columns[triples[i]] for i in known]), [weights[i] for i in known])
    return out, columns


def _disguised(word: str) -> list[str]:
    """A word with a letter put in, and with a letter doubled, at a third and two thirds of its length."""
    places = sorted({max(1, len(word) // 3), max(1, 2 * len(word) // 3)})
    return [word[:p] + "x" + word[p:] for p in places] + [word[:p] + word[p - 1 :] for p in places] if len(word) > 3 else []


def _machine(toxic: list[str], clean: list[str]) -> tuple[np.ndarray, float]:
    """Squared-hinge SVM on Nyström features of words; returns the weight of each triple, and the bias."""
    landmarks = toxic[: LANDMARKS // 2]
    toxic = toxic + [v for word in toxic for v in _disguised(word)]
    landmarks = landmarks + clean[:: max(1, len(clean) // (LANDMARKS - len(landmarks)))][: LANDMARKS - len(landmarks)]
    z, columns = _vectors(landmarks, None)
    values, vectors = np.linalg.eigh(z @ z.T)
    good = values > 1e-6 * max(values.max(), 1e-12)
    whiten = vectors[:, good] / np.sqrt(values[good])  # kernel of the landmarks to the power -1/2
    words = toxic + clean
    x = np.concatenate([_vectors(words[i : i + 500], columns)[0] @ z.T @ whiten for i in range(0, len(words), 500)])
    x = np.c_[x, np.ones(len(x))]
    y = np.r_[np.ones(len(toxic)), -np.ones(len(clean))]
    cost = np.where(y > 0, 0.5 / len(toxic), 0.5 / len(clean)) * 4000
    w = np.zeros(x.shape[1])
    ridge = np.r_[np.ones(len(w) - 1), 1e-4]
    before = None
    for _ in range(30):  # Newton steps on the rows inside the margin
        inside = y * (x @ w) < 1
        if before is not None and (inside == before).all():
            break
        before = inside
        a = x[inside] * cost[inside, None]
        w = np.linalg.solve(x[inside].T @ a + np.diag(ridge), a.T @ y[inside])
    table = np.zeros(CLASSES**3, dtype=np.float32)
    table[list(columns)] = z.T @ (whiten @ w[:-1])
    return table, float(w[-1])


def _cover(found: list[tuple[str, list[int]]], limit: int) -> list[str]:
    """Words of which each toxic document holds one, the most shared first. Chance words of copied texts add nothing."""
    docs = {d: i for i, d in enumerate(sorted({d for _, ds in found for d in ds}))}
    holds = np.zeros((len(found), len(docs)), dtype=bool)
    for row, (_, ds) in enumerate(found):
        holds[row, [docs[d] for d in ds]] = True
    left, out = np.ones(len(docs), dtype=bool), []
    while len(out) < limit and len(found):
        gain = (holds & left).sum(axis=1)
        best = int(gain.argmax())
        if gain[best] < (2 if out else 1):
            break
        out.append(best)
        left &= ~holds[best]
    # toxic documents mostly hold several insults: words that many of them share count even if each document has another
    seen = holds[out].sum(axis=0) if out else np.zeros(len(docs))
    enough = COMMON * holds.sum(axis=1).max(initial=0)
    while out and len(out) < limit:
        gain = (holds & (seen < COVERS)).sum(axis=1)
        gain[out] = 0
        best = int(gain.argmax())
        if gain[best] < max(2, enough):
            break
        out.append(best)
        seen = seen + holds[best]
    return [found[i][0] for i in out]


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from labelled documents outside the held-out fold.

    All sentences of a labelled document carry its label. The words that toxic documents share and clean ones lack
    explain the labels (a greedy cover of the toxic documents); the machine then learns to tell these words from
    words of clean documents, in rounds that add the clean words it gets most wrong and the words of toxic documents
    that it finds itself. Uses at most about TRAIN_DOCS documents of each label, picked by a hash of their id. Labels
    that are NULL or contradict each other are not used. Without toxic or clean labels all scores are 0.
    """
    spark = docs.sparkSession
    known = (
        labels.select("doc_id", "toxic").where(fold_of("doc_id") != 0).groupBy("doc_id")
        .agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most")).where("toxic = _most and toxic in (0, 1)").drop("_most")
    )
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        return Model(np.zeros(CLASSES**3, dtype=np.float32), -1.0)
    picked = known.where(sampled(F.col("doc_id"), TRAIN_DOCS / counts[0]) & (F.col("toxic") == 0) | sampled(F.col("doc_id"), TRAIN_DOCS / counts[1]) & (F.col("toxic") == 1))
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # some 2 * TRAIN_DOCS rows
    tokens = F.array_distinct(F.transform(F.split(F.lower("text"), r"\s+"), lambda w: F.substring(F.regexp_replace(w, r"[^\p{L}\p{N}@$]", ""), 1, PIECE)))
    held = saved(sample.select("doc_id", "toxic", F.explode(tokens).alias("word")).where(F.length("word") > 2), "toxic-words")
    by_word = saved(held.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("f"), F.xxhash64("word").alias("h")), "toxic-counts")

    top = [r["word"] for r in by_word.where("t >= 2 and f * 50 <= t").orderBy(F.desc("t"), "word").limit(CANDIDATES).collect()]
    if not top:
        top = [r["word"] for r in by_word.where("f = 0").orderBy(F.desc("t"), "word").limit(CANDIDATES).collect()]
    listed = spark.createDataFrame([(w,) for w in top], "word string")
    lists = held.where("toxic = 1").join(F.broadcast(listed), "word").groupBy("word").agg(F.sort_array(F.collect_set("doc_id")).alias("docs")).orderBy("word").collect()
    toxic = _cover([(r["word"], r["docs"]) for r in lists], POSITIVES)
    clean = [r["word"] for r in by_word.where("f > 0").orderBy(F.desc("f"), "word").limit(NEGATIVES // 2).collect()]
    clean += [r["word"] for r in by_word.where("f > 0").orderBy("h").limit(NEGATIVES // 2).collect()]
    clean = [w for w in dict.fromkeys(clean) if w not in set(toxic)]
    if not toxic or not clean:
        return Model(np.zeros(CLASSES**3, dtype=np.float32), -1.0)

    for _ in range(3):
        model = Model(*_machine(toxic, clean))
        scored = saved(by_word.withColumn("m", margin_udf(model, words=True)("word")).where("m > -0.5"), "toxic-scores")
        wrong = [r["word"] for r in scored.where("f > 0 and f * 10 > t").orderBy(F.desc("m"), "word").limit(NEGATIVES // 2).collect()]
        found = [r["word"] for r in scored.where("f = 0 and t >= 2 and m > 0").orderBy(F.desc("t"), "word").limit(POSITIVES).collect()]
        toxic = list(dict.fromkeys(toxic + found))[: 2 * POSITIVES]
        clean = [w for w in dict.fromkeys(clean + wrong) if w not in set(toxic)]
    model = Model(*_machine(toxic, clean))
    best = sample.select("toxic", margin_udf(model)("text").alias("m")).collect()  # two numbers for each sampled document
    model.odds = _odds(np.array([r["m"] for r in best]), np.array([r["toxic"] for r in best]), counts)
    return model


def _odds(margins: np.ndarray, toxic: np.ndarray, counts: dict[int, int]) -> tuple[float, float, float]:
    """Logistic regression on the two margins, with the labels weighing as they do among all labelled documents."""
    x = _features(margins)
    weight = np.where(toxic == 1, counts[1] / max(1, (toxic == 1).sum()), counts[0] / max(1, (toxic == 0).sum()))
    weight = weight / weight.mean()
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3), x.T @ (weight * (toxic - p)) - 0.05 * w)
        w = w + step
        if abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def margin_udf(model: Model, words: bool = False):
    """The two largest word margins of a text, ascending; with ``words``, the largest alone."""

    def margins(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = model.margins(texts.tolist())
            yield pd.Series(found[:, 1] if words else list(found))

    return F.pandas_udf(margins, "double" if words else "array<double>")


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """Add the probability of toxicity of each whole text. NULL and empty texts score as ones without an insult."""

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.probabilities(model.margins(texts.tolist())))

    return docs.withColumn(name, F.pandas_udf(scores, "double")(F.col(text)))
