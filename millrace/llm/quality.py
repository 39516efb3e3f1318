"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut, small
from millrace.llm.textcodes import TABLE_SIZE, code_points, matching, pieces

#: Character classes that are counted in every line, as patterns; the last one that matches holds.
CLASSES = (r"\p{L}+", r"[\p{Lu}\p{Lt}]+", r"\p{N}+", r"\s+", r"[\p{P}\p{S}]+", r"[!?]+", r"\|+", r"[#$%&*@^~_=+<>{}\[\]\\]+", r"[.,;:]+")
SPACE = 4
OWN = len(CLASSES) + 1 + 6


@dataclass
class QualityModel:
    """Weights of a line's features (its own and its neighbours', then a bias), transitions between bad (0) and good (1)
    lines, and slope and offset that turn the log-odds of the mean marginal into a document's."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    transition: np.ndarray
    slope: float
    offset: float


def class_table() -> np.ndarray:
    table = np.zeros(TABLE_SIZE, dtype=np.int64)
    for number, pattern in enumerate(CLASSES, start=1):
        table[matching(pattern)] = number
    return table


def line_features(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line that is not blank, the text it belongs to, and its length in characters."""
    newline = np.array([10], dtype=np.uint32)
    codes = np.concatenate([x for t in texts for x in (code_points(t), newline)] or [newline])
    owner_end = np.cumsum([len(t) + 1 for t in texts])
    kinds = table[codes]
    ends = np.flatnonzero(codes == 10)
    starts = np.r_[0, ends[:-1] + 1]
    length = ends - starts
    line = np.repeat(np.arange(len(ends)), length + 1)
    n = len(CLASSES) + 1
    counts = np.bincount(line * n + kinds, minlength=len(ends) * n).reshape(len(ends), n).astype(float)
    counts[:, SPACE] -= 1  # the line end itself
    solid = counts[:, SPACE] < length
    # Words: runs of anything but white space, told apart by a hash of their characters.
    dark = kinds != SPACE
    first = np.flatnonzero(dark & np.r_[True, ~dark[:-1]])
    words = np.zeros(len(ends))
    again = np.zeros(len(ends))
    distinct = np.zeros(len(ends))
    if len(first):
        within = np.arange(len(codes)) - np.maximum.accumulate(np.where(dark & np.r_[True, ~dark[:-1]], np.arange(len(codes)), 0))
        power = (np.uint64(0x9E3779B97F4A7C15) * (2 * within.astype(np.uint64) + np.uint64(1))) | np.uint64(1)
        mixed = np.where(dark, (codes.astype(np.uint64) + np.uint64(7)) * power, np.uint64(0))
        word_hash = np.add.reduceat(mixed ^ (mixed >> np.uint64(29)), first)
        at = line[first]
        words = np.bincount(at, minlength=len(ends)).astype(float)
        same = (word_hash[1:] == word_hash[:-1]) & (at[1:] == at[:-1])
        again = np.bincount(at[1:][same], minlength=len(ends)).astype(float)
        order = np.lexsort((word_hash, at))
        new = np.r_[True, (word_hash[order][1:] != word_hash[order][:-1]) | (at[order][1:] != at[order][:-1])]
        distinct = np.bincount(at[order][new], minlength=len(ends)).astype(float)
    size, w = np.maximum(length, 1), np.maximum(words, 1)
    letters = np.maximum(counts[:, 1] + counts[:, 2], 1)
    own = np.column_stack(
        [counts / size[:, None], counts[:, 2] / letters, np.log1p(length) / 5, np.minimum(length / w, 40) / 10, again / w, distinct / w, np.minimum(words, 5) / 5]
    )
    return own[solid], np.searchsorted(owner_end, starts[solid], side="right"), length[solid]


def with_neighbours(own: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after in the same text (zero at its ends), and a bias."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    if len(own) > 1:
        same = (owner[1:] == owner[:-1])[:, None]
        before[1:], after[:-1] = own[:-1] * same, own[1:] * same
    return np.hstack([own, before, after, np.ones((len(own), 1))])


def chain(log_odds: np.ndarray, owner: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log-odds of "good" for every line; the marginal's log-odds are their sum.

    The forward value includes the line's own log-odds. All texts take each step together.
    """
    forward, backward = log_odds.copy(), np.zeros_like(log_odds)
    if not len(owner):
        return forward, backward
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    lengths = np.diff(np.r_[starts, len(owner)])
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")  # texts with more than t lines
    t00, t01, t10, t11 = transition.ravel()
    for t in range(1, lengths[0]):
        at = starts[: active[t]] + t
        past = forward[at - 1]
        forward[at] += np.logaddexp(t01, past + t11) - np.logaddexp(t00, past + t10)
    for t in range(lengths[0] - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        ahead = log_odds[at + 1] + backward[at + 1]
        backward[at] = np.logaddexp(t10, ahead + t11) - np.logaddexp(t00, ahead + t01)
    return forward, backward


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_chain(features: np.ndarray, owner: np.ndarray, good: np.ndarray, rounds: int = 250, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions by Adam on the conditional likelihood of the line labels."""
    params = np.zeros(features.shape[1] + 4)
    first, second = np.zeros_like(params), np.zeros_like(params)
    inner = np.flatnonzero(owner[1:] == owner[:-1]) + 1  # lines with one before them
    pair_seen = np.bincount(2 * good[inner - 1] + good[inner], minlength=4)
    n = len(good)
    for step in range(1, rounds + 1):
        weights, transition = params[:-4], params[-4:].reshape(2, 2)
        log_odds = features @ weights
        forward, backward = chain(log_odds, owner, transition)
        gradient = np.r_[features.T @ (good - sigmoid(forward + backward)), np.zeros(4)]
        past, ahead = forward[inner - 1], log_odds[inner] + backward[inner]
        joint = np.stack([np.zeros(len(inner)), ahead, past, past + ahead]) + transition.reshape(4, 1)
        joint = np.exp(joint - joint.max(axis=0))
        gradient[-4:] = pair_seen - (joint / joint.sum(axis=0)).sum(axis=1)
        gradient = gradient / n - ridge * params
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        params = params + 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return params[:-4], params[-4:].reshape(2, 2)


def mean_log_odds(own: np.ndarray, owner: np.ndarray, length: np.ndarray, n: int, model: QualityModel) -> np.ndarray:
    """Log-odds of each text's length-weighted mean marginal; 0 for texts without lines."""
    features = with_neighbours((own - model.mean) / model.scale, owner)
    forward, backward = chain(features @ model.weights, owner, model.transition)
    marginal = sigmoid(forward + backward)
    total = np.bincount(owner, weights=length, minlength=n)
    mean = np.bincount(owner, weights=length * marginal, minlength=n) / np.maximum(total, 1)
    mean = np.clip(np.where(total > 0, mean, 0.5), 1e-4, 1 - 1e-4)
    return np.log(mean / (1 - mean))


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample: int = 4000,
    longest: int = 100_000,
    seed: int = 5,
) -> QualityModel:
    """Fit on about ``sample`` labelled documents, chosen by a hash of their id (all if there are fewer), of at most
    ``longest`` characters each, which bounds what comes to the driver.

    Each line takes its document's label. Features are made by Spark tasks. An id that has several labels takes the more
    frequent one, 1 if they are even; labels without id or value, and labels of ids that no document has, are ignored.
    Documents that share an id are fitted one by one.
    """
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id IS NOT NULL AND label IS NOT NULL")
    n = marked.count()
    share = min(1.0, sample / max(1, n))
    picked = marked.filter(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 20)) < share * (1 << 20))
    picked = picked.groupBy("id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    rows = named.filter(F.char_length("text") <= longest).join(small(cut(picked, "labelled")), "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, number, row = class_table(), 0, TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in pieces(texts):
                own, owner, length = line_features(texts[a:b], table)
                of = {c: batch[c].to_numpy()[a:b][owner] for c in ("id", "text_hash", "label")}
                yield pd.DataFrame({**of, "row": row + owner, "line": number + np.arange(len(own)), "length": length, "own": list(own)})
                number, row = number + len(own), row + b - a

    kind = docs.schema[id_col].dataType.simpleString()
    lines = rows.mapInPandas(run, f"id {kind}, text_hash bigint, label int, row bigint, line bigint, length bigint, own array<double>").toPandas()
    lines = lines.sort_values(["id", "text_hash", "row", "line"], kind="stable")
    if lines["label"].nunique() < 2:
        share = float(lines["label"].mean()) if len(lines) else 0.5
        return QualityModel(np.zeros(OWN), np.ones(OWN), np.zeros(3 * OWN + 1), np.zeros((2, 2)), 0.0, 8 * share - 4)
    own = np.array(lines["own"].tolist())
    owner, good = pd.factorize(lines["row"])[0], lines["label"].to_numpy()
    mean, scale = own.mean(axis=0), own.std(axis=0) + 1e-3
    weights, transition = fit_chain(with_neighbours((own - mean) / scale, owner), owner, good)
    model = QualityModel(mean, scale, weights, transition, 1.0, 0.0)
    n_docs = int(owner.max()) + 1
    x = mean_log_odds(own, owner, lines["length"].to_numpy(), n_docs, model)
    y = good[np.unique(owner, return_index=True)[1]]
    model.slope, model.offset = calibrate(x, y)
    return model


def calibrate(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Logistic regression of y on x by Newton steps, slightly regularised."""
    design, beta = np.column_stack([x, np.ones_like(x)]), np.array([1.0, 0.0])
    for _ in range(rounds):
        p = sigmoid(design @ beta)
        hessian = design.T @ (design * (p * (1 - p))[:, None]) + 0.1 * np.eye(2)
        beta = beta + np.linalg.solve(hessian, design.T @ (y - p) - 0.1 * (beta - [1, 0]))
    return float(beta[0]), float(beta[1])


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col, score``, the probability that it is good.

    Every line that is not blank is a state of the chain; the marginals of all lines, weighted by their length, give
    the score. Null, empty and blank texts have no lines and get the score of an even mean. Null ids and
    repeated rows are scored like any other; other columns are ignored; whole texts are read.
    """
    return docs.select(id_col, scorer(model)(F.col(text_col)).alias("score"))


def scorer(model: QualityModel):
    """The score of a text column as a vectorised function."""

    @F.pandas_udf("double")
    def quality_score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = class_table()
        for batch in batches:
            texts = [t or "" for t in batch]
            scores = [scored(texts[a:b], table, model) for a, b in pieces(texts)]
            yield pd.Series(np.concatenate(scores) if scores else np.empty(0))

    return quality_score


def scored(texts: list[str], table: np.ndarray, model: QualityModel) -> np.ndarray:
    own, owner, length = line_features(texts, table)
    return sigmoid(model.slope * mean_log_odds(own, owner, length, len(texts), model) + model.offset)


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The documents whose score is at least ``least``, with all their columns."""
    return docs.filter(scorer(model)(F.col(text_col)) >= least)
