"""Language identification with error-correcting output codes over byte n-grams.

Each learned language gets a codeword. For each bit a binary naive Bayes classifier separates
the languages with a one from those with a zero by counts of hashed byte 2-, 3- and 4-grams,
gathered over all labelled rows. Decoding takes the codeword with the least loss, each bit's
logistic loss weighted by how far apart its two classes lie (Jensen-Shannon divergence). A small lead over
the second codeword flags the prediction as ambiguous.
"""

from __future__ import annotations

import re
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import arrow_rows

SIZES = (2, 3, 4)
SPACE_BITS = 15
STEP = 1 << 20
UNKNOWN = "und"
#: All code columns up to this many languages; beyond it, drawn ones.
EXHAUSTIVE = 5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32


def grams(raw: bytes) -> np.ndarray:
    """Hashed n-grams of a text, padded by a space on both sides; one column for each size."""
    b = _LOWER[np.frombuffer(b" " + raw + b"   ", np.uint8)].astype(np.uint32)
    n = len(raw) + 1
    out = np.empty((n, len(SIZES)), np.uint32)
    for k, size in enumerate(SIZES):
        h = np.full(n, 0x9E3779B1 + size, np.uint32)
        for i in range(size):
            h = (h ^ b[i : i + n]) * np.uint32(0x01000193)
        out[:, k] = (h ^ (h >> 15)) & ((1 << SPACE_BITS) - 1)
    return out + (np.arange(len(SIZES), dtype=np.uint32) << SPACE_BITS)


def codewords(n: int) -> np.ndarray:
    """One row of bits for each of ``n`` languages; no column is constant and rows lie far apart."""
    if n < 2:
        return np.ones((n, 1), bool)
    if n <= EXHAUSTIVE:
        return np.array([c for c in product([True, False], repeat=n) if c[0] and not all(c)]).T
    rng, bits = np.random.default_rng(9), int(np.ceil(15 * np.log2(n)))
    best, apart = None, -1
    for _ in range(50):
        drawn = rng.random((n, bits)) < 0.5
        drawn = drawn[:, drawn.any(0) & ~drawn.all(0)]
        least = min((int((drawn[i] ^ drawn[:i]).sum(1).min()) for i in range(1, n)), default=0)
        if least > apart:
            best, apart = drawn, least
    return best


class Model:
    """Bit classifiers and codewords from counts[language][gram] and rows per language."""

    def __init__(self, names: list[str], counts: np.ndarray, rows: np.ndarray):
        self.names, self.code = names, codewords(len(names))
        bits = self.code.shape[1]
        self.weights = np.zeros((counts.shape[1], bits), np.float32)
        self.prior, self.trust = np.zeros(bits), np.ones(bits)
        for k in range(bits if len(names) > 1 else 0):
            one, zero = (counts[self.code[:, k] == v].sum(0) + 0.5 for v in (True, False))
            p, q = one / one.sum(), zero / zero.sum()
            self.weights[:, k] = np.log(p) - np.log(q)
            self.prior[k] = np.log((rows[self.code[:, k]].sum() + 1) / (rows[~self.code[:, k]].sum() + 1))
            m = (p + q) / 2
            self.trust[k] = 0.5 * float((p * np.log(p / m) + q * np.log(q / m)).sum())
        self.trust = self.trust / max(self.trust.sum(), 1e-12)

    def margins(self, raw: bytes) -> tuple[np.ndarray, int]:
        """Log odds of each bit, and the number of positions."""
        total, n = self.prior.copy(), len(raw) + 1
        for at in range(0, len(raw), STEP):
            part = grams(raw[at : at + STEP])
            for k in range(len(SIZES)):
                total += self.weights[part[:, k]].sum(0, dtype=np.float64)
        return total, n

    def predict(self, raw: bytes) -> tuple[str, float, bool]:
        """(language, score, ambiguous)."""
        if len(self.names) < 2:
            return (self.names[0] if self.names else UNKNOWN), 1.0 if self.names else 0.0, False
        margin, n = self.margins(raw)
        z = np.where(self.code, margin, -margin)
        loss = (np.logaddexp(0, -z) * self.trust).sum(1)
        order = np.argsort(loss, kind="stable")
        scaled = np.exp(-(loss - loss[order[0]]) / np.sqrt(n))  # grams overlap: odds are worth less than they say
        score = float(scaled[order[0]] / scaled.sum())
        return self.names[order[0]], score, score < 0.6


_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def _has_letter(raw: bytes | None) -> bool:
    """Whether a text in UTF-8 holds a letter of any script. Python tells, since Java 17 misses the letters of Unicode 14 and later."""
    return raw is not None and (_ASCII_LETTER.search(raw) is not None or any(map(str.isalpha, raw.decode("utf-8", "replace"))))


def fit(docs: DataFrame) -> Model:
    """Learn from all rows with text and lang, texts without a letter too. What reaches the driver is bounded by the number
    of languages times the gram space."""
    width = len(SIZES) << SPACE_BITS

    def run(batches):
        held: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for b in batches:
            for lang, raw in zip(b["lang"], b["text"], strict=True):
                total = held.setdefault(lang, np.zeros(width, np.int64))
                rows[lang] = rows.get(lang, 0) + 1
                for at in range(0, len(raw), STEP):
                    total += np.bincount(grams(raw[at : at + STEP]).ravel(), minlength=width)
        for lang, total in held.items():
            at = np.flatnonzero(total)
            yield {"lang": [lang] * (len(at) + 1), "gram": [-1, *at.tolist()], "n": [rows[lang], *total[at].tolist()]}

    given = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", F.col("text").cast("binary").alias("text"))
    summed = arrow_rows(given, "lang string, gram long, n long", run).groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(summed["lang"].unique())
    counts, rows = np.zeros((len(names), width)), np.zeros(len(names))
    at = {n: i for i, n in enumerate(names)}
    for lang, part in summed.groupby("lang"):
        own = part["gram"] >= 0
        counts[at[lang], part["gram"][own]] = part["n"][own]
        rows[at[lang]] = part["n"][~own].iloc[0]
    return Model(names, counts, rows)


def predict(docs: DataFrame, model: Model, *carried: Column) -> DataFrame:
    """doc_id, the carried columns, lang_pred, score, ambiguous, has_letter: one row per row.

    A null text, or one without a letter, gives ``und`` with score 0. Only the text is read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    given = docs.select(F.col("doc_id").cast("long"), *carried, F.col("text").cast("binary").alias("__raw"))
    others = given.drop("__raw")

    def run(batches):
        m = held.value
        for b in batches:
            found = [(*m.predict(raw), True) if _has_letter(raw) else (UNKNOWN, 0.0, True, False) for raw in b["__raw"]]
            yield {k: v for k, v in b.items() if k != "__raw"} | dict(
                zip(("lang_pred", "score", "ambiguous", "has_letter"), map(list, zip(*found, strict=True)) if found else ([], [], [], []), strict=True)
            )

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in others.schema)
    return arrow_rows(given, f"{schema}, lang_pred string, score double, ambiguous boolean, has_letter boolean", run)


def held_out() -> Column:
    """Documents kept for the test: crc32 of the id as text is divisible by five. Null ids are learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identified(docs: DataFrame) -> DataFrame:
    """Fit on the rows that aren't held out, then predict all.

    Rows with a null text or lang are not learned from. With no labelled row every prediction is
    ``und``. Repeated rows are kept; an empty table gives no rows; other columns are ignored.
    """
    model = fit(docs.where(~held_out()))
    return predict(docs, model, held_out().alias("held_out"))


def op9_language(spark, sf_dir: str) -> DataFrame:
    found = identified(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def recognised(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text can have a language; null texts and texts without letters go.

    Texts with letters stay if no language was learned, and if theirs is learned under the name ``und``.
    """
    model = fit(docs.where(~held_out()))
    held = [F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(docs.columns)]
    kept = predict(docs, model, *held).where("has_letter")
    return kept.select(*(F.col(f"__{i}").alias(c) for i, c in enumerate(docs.columns)))
