"""Language identification by multilingual mixture inference."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.textcodes import code_points, lower_letters, pieces

#: Hash buckets for n-grams of letters.
BUCKETS = 1 << 16
NONE = "und"


@dataclass
class LanguageModel:
    """Smoothed log probabilities of hashed n-grams: (BUCKETS, languages)."""

    languages: list[str]
    log_p: np.ndarray


def word_grams(texts: list[str], lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigrams of the words of several texts.

    A word is a run of letters, in lower case, with a space before and after it; each of its letters is the middle of
    one trigram. ``lower`` is the table ``lower_letters``. Returns the bucket of each trigram, the first trigram of each word, and the text of each word.
    """
    codes = [code_points(t) for t in texts]
    space = np.array([32], dtype=np.uint32)
    joined = np.concatenate([space] + [x for c in codes for x in (c, space)])
    owner_end = np.cumsum([len(c) + 1 for c in codes])
    low = lower[joined]
    middle = np.flatnonzero(low != 32)
    if not len(middle):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    a, b, c = low[middle - 1].astype(np.uint64), low[middle].astype(np.uint64), low[middle + 1].astype(np.uint64)
    mixed = ((a << np.uint64(42)) ^ (b << np.uint64(21)) ^ c) * np.uint64(0x9E3779B97F4A7C15)
    gram = (mixed >> np.uint64(48)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, np.diff(middle) > 1])
    return gram, first, np.searchsorted(owner_end, middle[first], side="left")


def train(labelled: DataFrame, text_col: str, lang_col: str, sample_per_language: int, seed: int = 11) -> LanguageModel:
    """Fit on about ``sample_per_language`` texts of each language, chosen by a hash of the text (all if there are fewer).

    Counts are summed by Spark; only the model, one row per language and bucket in use, comes to the driver.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0), dtype=np.float32))
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.0, sample_per_language / n)).otherwise(share)
    picked = rows.filter(F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(1 << 20)) < share * (1 << 20))
    number = {lang: i for i, lang in enumerate(languages)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, lower = np.zeros((len(number), BUCKETS), dtype=np.int64), lower_letters()
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                texts = part["text"].tolist()
                for first, last in pieces(texts):
                    total[number[lang]] += np.bincount(word_grams(texts[first:last], lower)[0], minlength=BUCKETS)
        lang, bucket = np.nonzero(total)
        yield pd.DataFrame({"lang": lang, "bucket": bucket, "n": total[lang, bucket]})

    counted = picked.mapInPandas(run, "lang int, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counted.toPandas()
    counts = np.zeros((BUCKETS, len(languages)))
    counts[found["bucket"], found["lang"]] = found["n"]
    smooth = counts + 0.05
    return LanguageModel(languages, np.log(smooth / smooth.sum(axis=0)).astype(np.float32))


def em(likelihood: np.ndarray, starts: np.ndarray, owner: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Mixture proportions (texts, languages) of words with the given likelihoods, and each text's log likelihood.

    ``starts`` is the first word of each text, ``owner`` the text of each word; ``allowed`` limits each text's languages.
    """
    share = allowed / allowed.sum(axis=1, keepdims=True)
    n_words = np.diff(np.r_[starts, len(owner)])[:, None]
    for _ in range(rounds):
        joint = likelihood * share[owner]
        joint /= joint.sum(axis=1, keepdims=True)
        share = np.add.reduceat(joint, starts, axis=0) / n_words
    fit = np.log((likelihood * share[owner]).sum(axis=1))
    return share, np.add.reduceat(fit, starts)


def mixtures(model: LanguageModel, texts: list[str], lower: np.ndarray, rounds: int = 12, penalty: float = 2.0) -> np.ndarray:
    """For each text its language proportions (zero for languages not selected), or zeros if it has no letter.

    Expectation-maximisation over words, from n-gram likelihoods, with all languages; then the sets of the most frequent 1, 2,
    ... languages are fitted again and the one with the largest log likelihood less
    ``penalty`` * log(words) for each language after the first is kept.
    """
    k = len(model.languages)
    shares = np.zeros((len(texts), k))
    gram, first, owner = word_grams(texts, lower)
    if not k or not len(gram):
        return shares
    log_word = np.add.reduceat(model.log_p[gram].astype(np.float64), first, axis=0)
    top = log_word.max(axis=1, keepdims=True)
    likelihood = np.maximum(np.exp(log_word - top), 1e-12)
    there, starts, owner = np.unique(owner, return_index=True, return_inverse=True)
    everything = np.ones((len(there), k))
    share, _ = em(likelihood, starts, owner, everything, rounds)
    order = np.argsort(-share, axis=1, kind="stable")
    rank = np.argsort(order, axis=1, kind="stable")
    words = np.diff(np.r_[starts, len(owner)])
    best, score = None, None
    for size in range(1, k + 1):
        fitted, fit = em(likelihood, starts, owner, (rank < size).astype(float), rounds if size > 1 else 1)
        value = fit - penalty * np.log(words + 1) * (size - 1)
        if best is None:
            best, score = fitted, value
        else:
            better = value > score
            best[better], score[better] = fitted[better], value[better]
    shares[there] = best
    return shares


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col, lang_pred, score, mixture`` (map of language to proportion, selected languages only).

    ``lang_pred`` is the language with the largest proportion (ties: the first by name), ``score`` its proportion. Null, empty and
    letterless texts give ``und``, score 0 and no mixture, as does everything when no language was learned.
    Null ids and repeated rows are handled like any other; other columns are ignored; whole texts are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.log_p))

    @F.pandas_udf("lang_pred string, score double, mixture map<string,double>")
    def language_mixture(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own, lower = LanguageModel(*shared.value), lower_letters()
        for batch in batches:
            texts = [t or "" for t in batch]
            rows = []
            for first, last in pieces(texts):
                for share in mixtures(own, texts[first:last], lower):
                    if share.sum() > 0:
                        top = int(share.argmax())
                        found = {own.languages[i]: float(share[i]) for i in np.flatnonzero(share > 0)}
                        rows.append((own.languages[top], min(1.0, float(share[top])), found))
                    else:
                        rows.append((NONE, 0.0, {}))
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "mixture"])

    found = docs.select(F.col(id_col).alias("id"), language_mixture(F.col(text_col)).alias("found"))
    return found.select(F.col("id").alias(id_col), "found.lang_pred", "found.score", "found.mixture")
