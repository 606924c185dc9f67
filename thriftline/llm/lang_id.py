"""Language identification by error-correcting output codes.

Each language has a codeword of bits. A binary classifier over hashed letter
trigrams predicts each bit: its weights are the log ratio of a trigram's
frequency in the languages with that bit set and in those without. A text's
bit margins are compared with every codeword under the logistic loss; the
codeword of least loss wins, and a narrow lead over the second is flagged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thriftline.llm.common import shielded, stash

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
#: Prior count of every trigram, strength of a text's margins, and least lead of the winner.
PRIOR, SHARPNESS, CLEAR_LEAD = 0.5, 4.0, 0.7
#: Languages whose counts are on the driver at once, characters of a text that are looked at together, and bits of distance between codewords for each bit of a language's number.
LANGS_AT_ONCE, PIECE, DISTANCE = 64, 1 << 18, 4
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Buckets of the trigrams of text that hold a letter, piece by piece; other characters count as one kind."""
    text = f" {text.lower()} "
    for lo in range(0, len(text) - 2, PIECE):
        c = np.frombuffer(text[lo : lo + PIECE + 2].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        is_letter = letters()[c]
        c = np.where(is_letter, c, np.uint32(1))
        some = is_letter[:-2] | is_letter[1:-1] | is_letter[2:]
        h = (c[:-2] * np.uint32(0x9E3779B1) + c[1:-1]) * np.uint32(0x85EBCA6B) + c[2:]
        yield ((h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BUCKET_BITS))[some]


def count_trigrams(labelled: DataFrame) -> DataFrame:
    """(lang, counts array<bigint>): trigram counts of all texts of each language, added up per task before they are shuffled."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.text, b.lang):
                got = sums.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                for piece in trigrams(text):
                    got += np.bincount(piece, minlength=BUCKETS)
        for lang, got in sums.items():
            at = np.flatnonzero(got)
            for lo in range(0, len(at), 8192):
                yield pd.DataFrame({"lang": lang, "bucket": at[lo : lo + 8192].astype(np.int32), "n": got[at[lo : lo + 8192]]})

    return labelled.select("text", "lang").mapInPandas(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1: the exhaustive code for up to 7 languages, else a linear code with a least distance.

    A bit of the linear code is the parity of some bits of a language's number.
    The difference of two codewords is then the codeword of two numbers' xor,
    so the least distance is the least weight of all codewords but the first.
    Bits are added, in a fixed order, until that is DISTANCE times the bits of
    a number (or as much as all parities there are give): no two languages
    share a codeword, however many there are.
    """
    if n <= 7:
        width = max(1, 2 ** (n - 1) - 1)
        return np.array([[1 if i == 0 or not (j >> (n - 1 - i)) & 1 else -1 for j in range(1, width + 1)] for i in range(n)], dtype=np.float64)
    m = (n - 1).bit_length()
    numbers, rng = np.arange(2**m), np.random.default_rng(7)
    weight, masks, taken = np.zeros(2**m, dtype=np.int64), [], set()
    least = min(DISTANCE * m, 2 ** (m - 1))
    while weight[1:].min() < least:
        mask = 1 << len(masks) if len(masks) < m else int(rng.integers(1, 2**m))
        if mask not in taken:
            taken.add(mask)
            masks.append(mask)
            weight += np.bitwise_count(numbers & mask) & 1
    return np.array([np.where(np.bitwise_count(numbers[:n] & mask) & 1, -1.0, 1.0) for mask in masks]).T


class Model:
    """langs, their codewords, and a weight for every bucket and bit. add gives it the counts of languages, in order."""

    def __init__(self, langs: list[str]):
        self.langs, self.code = langs, codewords(len(langs)) if langs else np.zeros((0, 0))
        self.n_seen, self.on, self.off = 0, np.zeros((self.code.shape[1], BUCKETS)), np.zeros((self.code.shape[1], BUCKETS))
        self.weights = np.zeros((BUCKETS, self.code.shape[1]), np.float32)

    def add(self, counts: np.ndarray) -> None:
        p = (counts + PRIOR) / (counts + PRIOR).sum(1, keepdims=True)
        code = self.code[self.n_seen : self.n_seen + len(counts)]
        self.on, self.off = self.on + (code > 0).T @ p, self.off + (code < 0).T @ p
        self.n_seen += len(counts)

    def finish(self) -> Model:
        on, off = (self.code > 0).sum(0), (self.code < 0).sum(0)
        for bit in np.flatnonzero((on > 0) & (off > 0)):
            self.weights[:, bit] = np.log(self.on[bit] / on[bit]) - np.log(self.off[bit] / off[bit])
        self.on = self.off = None
        return self

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        n, margins = 0, np.zeros(self.code.shape[1])
        for found in trigrams(text or ""):
            n, margins = n + len(found), margins + self.weights[found].sum(0, dtype=np.float64)
        if not n or not self.langs:
            return UNKNOWN, 0.0, True
        loss = np.logaddexp(0, -self.code * (margins / n * SHARPNESS)).sum(1)
        order = np.argsort(loss, kind="stable")
        lead = loss[order[1]] - loss[order[0]] if len(order) > 1 else np.inf
        share = np.exp(loss[order[0]] - loss)
        return self.langs[order[0]], float(1 / share.sum()), bool(lead < CLEAR_LEAD)


def train(labelled: DataFrame) -> Model:
    """A model of labelled (text, lang): rows with a null text or lang take no part; all others count, none is sampled.

    Any number of languages: the driver gets the counts of LANGS_AT_ONCE of
    them at a time and keeps a sum per bucket and bit, which is what the model
    and its broadcast hold besides a codeword for each language.
    """
    counted = stash(count_trigrams(labelled.filter("text is not null and lang is not null")), "trigram-counts")
    langs = sorted(counted.select("lang").distinct().toArrow()["lang"].to_pylist())
    model = Model(langs)
    for lo in range(0, len(langs), LANGS_AT_ONCE):
        some = langs[lo : lo + LANGS_AT_ONCE]
        got = counted.filter(F.col("lang").isin(some)).toArrow()
        counts, place = np.zeros((len(some), BUCKETS)), {lang: i for i, lang in enumerate(some)}
        counts[[place[x] for x in got["lang"].to_pylist()], got["bucket"].to_numpy()] = got["n"].to_numpy()
        model.add(counts)
    return model.finish()


def held_out() -> Column:
    """Documents that are kept from training; a null doc_id is neither held out nor trained on."""
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 4 == 2


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score (0 to 1) and ambiguous; und, 0 and true where text is null or has no letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def told(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score", "ambiguous"])

    return docs.withColumn("_told", told("text")).select(*docs.columns, "_told.*")


def identify(docs: DataFrame) -> DataFrame:
    """docs with held_out, lang_pred, score and ambiguous, from a model of its own labelled rows that are not held out.

    lang, source and doc_id are no inputs of a prediction: equal texts are
    judged alike, so ties and repeated rows are too. Without labelled rows all
    is und. Extra columns pass through, those of the same names as the new ones
    are replaced; an empty table gives no rows.
    """
    docs = docs.drop("held_out", "lang_pred", "score", "ambiguous")
    model = train(docs.filter(~held_out()))
    return predict(docs, model).withColumn("held_out", F.coalesce(held_out(), F.lit(False)))


def accepted(docs: DataFrame, least_score: float = 0.3) -> DataFrame:
    """The rows of docs in a learned language: no und, and no score under least_score."""
    keep = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)
    return shielded(docs, ["doc_id", "text", "lang"], lambda d: identify(d).filter(keep).drop("held_out", "lang_pred", "score", "ambiguous"))


def query(docs: DataFrame) -> DataFrame:
    return identify(docs.select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
