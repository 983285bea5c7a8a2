"""Language identification by error-correcting output codes over character n-grams.

Each language gets a codeword. For every bit one binary classifier on hashed n-gram shares predicts on which side of
that bit a text's language is. Decoding weighs each bit's loss, for each language, by how well the bit's classifier
did on that language, and takes the language with the least loss. A text whose two best languages are close is flagged.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import fold_of, fresh

UNKNOWN = "und"
BUCKETS = 1 << 13
#: Bound of the training sample: about so many documents of each language, picked by a hash of their id.
TRAIN_DOCS = 600
#: Languages up to this number get every distinct split as a bit; more get random splits.
EXHAUSTIVE = 6
#: Least share of the probability by which the best language must lead.
AMBIGUOUS = 0.2
CHARS_AT_ONCE = 1 << 17


@cache
def _letters() -> np.ndarray:
    """Code point to folded letter; 0 for everything that isn't a letter."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for p in range(0x110000):
        c = chr(p)
        if c.isalpha():
            low = c.lower()
            table[p] = ord(low[0]) if unicodedata.category(low[0])[0] == "L" else p
    return table


def _grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of all letter n-grams (1 to 3, words padded with one blank), a bounded piece of the text at a time."""
    for k in range(0, len(text), CHARS_AT_ONCE):
        points = np.frombuffer(text[max(0, k - 2) : k + CHARS_AT_ONCE].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        c = np.r_[0, _letters()[points], 0].astype(np.uint64)
        c = c[np.r_[True, (c[1:] > 0) | (c[:-1] > 0)]]  # runs of other characters count as one blank
        h = np.zeros(len(c), dtype=np.uint64)
        for n in range(1, 4):
            h = h[: len(c) - n + 1] * np.uint64(1_000_003) + c[n - 1 :] + np.uint64(n)
            mixed = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 13)
            yield mixed[c[: len(mixed)] > 0] if n == 1 else mixed


def histogram(text: str | None) -> np.ndarray | None:
    """Share of each bucket among a text's n-grams, square-rooted; None for a text without a letter."""
    counts = np.zeros(BUCKETS)
    for grams in _grams(text or ""):
        counts += np.bincount(grams.astype(np.int64), minlength=BUCKETS)
    if not any(c.isalpha() for c in text or ""):
        return None
    return np.sqrt(counts / counts.sum())


def codewords(n: int) -> np.ndarray:
    """Rows of +1 and -1, one for each of n languages; columns differ from each other and from their opposites."""
    if n < 2:
        return np.ones((n, 1))
    if n <= EXHAUSTIVE:
        splits = np.arange(1, 1 << (n - 1))
        rest = 1 - 2 * ((splits[None, :] >> np.arange(n - 1)[:, None]) & 1)
        return np.vstack([np.ones(len(splits)), rest]).astype(float)
    random = np.random.default_rng(7)
    bits = int(np.ceil(10 * np.log2(n)))
    tries = [np.where(random.random((n, bits)) < 0.5, -1.0, 1.0) for _ in range(200)]
    return max(tries, key=lambda c: (bits - c @ c.T + np.eye(n) * 4 * bits).min())


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # language x bit
    weights: np.ndarray  # bucket x bit
    bias: np.ndarray
    trust: np.ndarray  # language x bit; rows sum to 1

    def probabilities(self, shares: np.ndarray) -> np.ndarray:
        """Of each language, from the trust-weighted exponential loss of each bit."""
        bits = np.clip(shares @ self.weights + self.bias, -4, 4)
        loss = (self.trust[None] * np.exp(-self.codes[None] * bits[:, None, :])).sum(axis=2)
        z = np.exp(-4 * (loss - loss.min(axis=1, keepdims=True)))
        return z / z.sum(axis=1, keepdims=True)


def train(docs: DataFrame, lang: str = "lang") -> Model:
    """Learn from text and non-null language of documents outside the held-out fold."""
    known = docs.select("doc_id", "text", F.col(lang).alias("lang")).where(F.col("lang").isNotNull() & (fold_of("doc_id") != 0))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").collect()}
    share = F.lit(0.0)
    for name, n in counts.items():
        share = F.when(F.col("lang") == name, TRAIN_DOCS / n).otherwise(share)
    picked = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < share * (1 << 30)

    def shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(lang, h) for lang, text in zip(batch["lang"], batch["text"]) if (h := histogram(text)) is not None]
            yield pd.DataFrame({"lang": [x for x, _ in found], "at": [np.flatnonzero(h).astype(np.int32) for _, h in found], "share": [h[h > 0].astype(np.float32) for _, h in found]})

    rows = known.where(picked).select("lang", "text").mapInPandas(shares, "lang string, at array<int>, share array<float>").collect() if counts else []
    languages = sorted({r["lang"] for r in rows})
    x = np.zeros((len(rows), BUCKETS), dtype=np.float32)
    for i, r in enumerate(rows):
        x[i, r["at"]] = r["share"]
    y = np.array([languages.index(r["lang"]) for r in rows], dtype=int)
    codes = codewords(len(languages))
    weights, bias = np.zeros((BUCKETS, codes.shape[1]), dtype=np.float32), np.zeros(codes.shape[1], dtype=np.float32)
    if len(languages) > 1:
        target = codes[y].astype(np.float32)
        balance = (len(rows) / (len(languages) * np.bincount(y, minlength=len(languages))))[y].astype(np.float32)[:, None] / len(rows)
        speed = np.zeros_like(weights)
        for _ in range(200):  # logistic loss on all bits at once, gradient steps with momentum
            pull = target * balance / (1 + np.exp(np.clip(target * (x @ weights + bias), -30, 30)))
            speed = 0.9 * speed + x.T @ pull - 1e-5 * weights
            weights = weights + 4 * speed
            bias = bias + 4 * pull.sum(axis=0)
    right = np.array([((np.sign(x[y == k] @ weights + bias) == codes[k]).mean(axis=0) if (y == k).any() else np.ones(codes.shape[1])) for k in range(len(languages))]).reshape(codes.shape)
    trust = np.maximum(right - 0.5, 0.01)
    return Model(languages, codes, weights, bias, trust / trust.sum(axis=1, keepdims=True))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add lang_pred, score (probability of the chosen language) and ambiguous.

    NULL texts and texts without a letter get ``und``, score 0 and are not ambiguous. With one learned language
    every other text gets it; with none all are ``und``. Columns with the names of results are replaced.
    """

    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, scores, close = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
            values = texts.tolist()
            for k in range(0, len(values) if model.languages else 0, 256):
                rows = [(i, h) for i, t in enumerate(values[k : k + 256], k) if (h := histogram(t)) is not None]
                if not rows:
                    continue
                p = model.probabilities(np.array([h for _, h in rows], dtype=np.float32))
                best, ranked = p.argmax(axis=1), np.sort(p, axis=1)
                for j, (i, _) in enumerate(rows):
                    names[i], scores[i] = model.languages[best[j]], p[j, best[j]]
                    close[i] = p.shape[1] > 1 and ranked[j, -1] - ranked[j, -2] < AMBIGUOUS
            yield pd.DataFrame({"lang_pred": names, "score": scores, "ambiguous": close})

    found = F.pandas_udf(predicted, "lang_pred string, score double, ambiguous boolean")
    own, kept = fresh(docs, "_found"), [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "ambiguous")]
    return docs.withColumn(own, found(F.col(text))).select(*kept, f"{own}.*")
