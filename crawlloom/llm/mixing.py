"""Mixing to target weights with soft membership.

A classifier fitted to a table of labelled documents gives every document the
posteriors of the domains. The rates, how often each document is to be taken, are
nonnegative and fitted by least squares so that the expected tokens of every domain, posterior
times tokens times rate summed over all documents, match the targets. The fit is by
projected gradient, scaled by the domains' matrix of second moments: each round
is one aggregation to a few numbers, and a document's rate follows from its posteriors and
the rounds' steps alone, so nothing is kept between rounds that a lost executor could lose.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlloom.llm.common import content_key, written

#: The shares of tokens that are asked for.
TARGETS = {"good": 0.80, "poor": 0.19, "toxic": 0.01}
#: Labelled documents the classifier is fitted to at most, those with the smallest hashes of their ids.
LABELLED = 20_000
#: Words a domain adds to the features, and the documents a word must be in.
VOCABULARY, LEAST = 250, 6
#: A domain's distance from its target, as a share of all tokens, at which the fit is done; and how many rounds may bring it nearer by less than this share before the fit ends.
TOLERANCE, STALL, GAIN = 1e-3, 5, 0.01
STRIP = ".,!?;:*%#&$|\"'()[]"
UPPER = bytes(range(65, 91))
SIGNS = b"*%#&$|!<>{}=_~^@/\\+"
DIGITS = bytes(range(48, 58))
DENSE = 7


def word_set(text: str) -> set[str]:
    return {w.strip(STRIP) for w in set(text.lower().split())}


def dense(text: str) -> list[float]:
    """Features of the whole text that no single word shows."""
    raw = text.encode("utf-8", "surrogatepass")
    size = max(1, len(raw))
    n = text.count(" ") + text.count("\n") + 1
    return [np.log1p(n) / 5, *(min(1.0, 4 * (len(raw) - len(raw.translate(None, c))) / size) for c in (UPPER, SIGNS, DIGITS)), min(1.0, size / n / 20), min(1.0, 20 * text.count("\n") / n), 1.0]


@dataclass
class Classifier:
    """Softmax regression on the presence of words and a few dense features."""

    domains: list[str]
    words: dict[str, int]
    weights: np.ndarray

    def features(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.words) + DENSE), np.float32)
        for i, t in enumerate(texts):
            found = [self.words[w] for w in self.words.keys() & word_set(t or "")]
            out[i, found] = 1
            out[i, len(self.words) :] = dense(t or "")
        return out

    def posteriors(self, texts: list[str | None]) -> np.ndarray:
        z = self.features(texts).astype(np.float64) @ self.weights
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def descend(x: np.ndarray, y: np.ndarray, domains: int, rounds: int = 400, rate: float = 0.5, ridge: float = 1e-4) -> np.ndarray:
    """Softmax weights by accelerated gradient descent with steps scaled to each feature."""
    w = np.zeros((x.shape[1], domains))
    v, goal = w.copy(), np.eye(domains)[y]
    scale = rate / (np.maximum((x * x).mean(0), 1e-4)[:, None] + ridge) / 8
    for k in range(rounds):
        z = x @ v
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        step = v - np.minimum(scale, 4.0) * (x.T @ (p - goal) / len(x) + ridge * v)
        v = step + k / (k + 3) * (step - w)
        w = step
    return w


def fit_classifier(docs: DataFrame, labels: DataFrame, domains: list[str], labelled: int = LABELLED, doc_id: str = "doc_id", text: str = "text") -> Classifier:
    """labels is (doc_id, domain); of several domains for one id the last in domains counts, other names are ignored.

    Only the sample of at most labelled documents reaches the driver, as its features. Without labelled documents all
    domains are equally likely.
    """
    place = F.create_map(*[F.lit(x) for i, d in enumerate(domains) for x in (d, i)])
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), place[F.col("domain")].alias("y")).where("doc_id is not null and y is not null")
    chosen = chosen.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    # at most labelled rows of two numbers; of rows that repeat an id one is taken, that of the smallest hash
    sample = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = sample.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("y").alias("y"))
    sample = written(sample.select("text", "y"), "labelled")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for pdf in batches:
            for t, y in zip(pdf["text"], pdf["y"], strict=True):
                seen.update((w, y) for w in word_set(t))
            if len(seen) > 1_000_000:
                yield pd.DataFrame([(w, y, n) for (w, y), n in seen.items()], columns=["word", "y", "n"])
                seen.clear()
        yield pd.DataFrame([(w, y, n) for (w, y), n in seen.items()], columns=["word", "y", "n"])

    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = max(1, sum(sizes.values()))
    counted = sample.mapInPandas(count, "word string, y int, n long").groupBy("word").agg(F.sum("n").alias("all"), *[F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0)).alias(f"n{y}") for y in range(len(domains))])
    counts = written(counted.where((F.col("all") >= LEAST) & (F.col("word") != "")), "words")
    words: dict[str, int] = {}
    for y in range(len(domains)):
        share = sizes.get(y, 0) / total
        if 0 < share < 1:
            # how far the word's documents differ from the domain's share, in standard errors
            excess = F.abs(F.col(f"n{y}") - share * F.col("all")) / F.sqrt(share * (1 - share) * F.col("all"))
            for r in counts.orderBy(excess.desc(), "word").limit(VOCABULARY).select("word").collect():
                words.setdefault(r["word"], len(words))
    model = Classifier(domains, words, np.zeros((len(words) + DENSE, len(domains))))

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = model.features(list(pdf["text"]))
            yield pd.DataFrame({"y": pdf["y"], "found": [np.flatnonzero(r[: len(words)]).astype(np.int32) for r in x], "rest": list(x[:, len(words) :])})

    rows = sample.mapInPandas(featured, "y int, found array<int>, rest array<float>").collect()
    if len(sizes) > 1:
        x = np.zeros((len(rows), len(words) + DENSE))
        for i, r in enumerate(rows):
            x[i, r["found"]] = 1
            x[i, len(words) :] = r["rest"]
        model.weights = descend(x, np.array([r["y"] for r in rows]), len(domains))
    elif sizes:
        model.weights[-1, next(iter(sizes))] = 20.0
    return model


def memberships(docs: DataFrame, model: Classifier, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, key, n_words, p) of every whole text; n_words counts white-space words."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for lo in range(0, whole.num_rows, 1024):
                b = whole.slice(lo, 1024)
                texts = b.column(2).to_pylist()
                p = model.posteriors(texts)
                tokens = [len((t or "").split()) for t in texts]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(tokens, pa.int64()), pa.array(list(p), pa.list_(pa.float64()))], ["doc_id", "key", "n_words", "p"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), content_key(doc_id, text).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(batches, "doc_id long, key long, n_words long, p array<double>")


def rates(p: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """The rates of documents with these posteriors after these steps: from 1 down each step, never below 0."""
    r = np.ones(len(p))
    for u in steps:
        r = np.maximum(0.0, r - p @ u)
    return r


def used(r: np.ndarray, spare: float) -> np.ndarray:
    """The rates that count: those of at least spare and below 1 count as 1."""
    return np.where((r >= spare) & (r < 1), 1.0, r)


def _posteriors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def moments(members: DataFrame, steps: list[np.ndarray], tried: list[np.ndarray], spare: float = 1.0) -> np.ndarray:
    """For each step tried after steps: the domains' expected tokens at the rates that count, and their second moments over documents of positive rate.

    Tasks add up their documents, so a round moves a few numbers a task and its plan is the same in every round.
    """
    d, size = len(tried[0]), len(tried) * len(tried[0]) * (len(tried[0]) + 1)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(tried), d * (d + 1)))
        for b in it:
            if not b.num_rows:
                continue
            t, p = b.column(0).to_numpy().astype(np.float64), _posteriors(b.column(1))
            before = rates(p, steps)
            for n, u in enumerate(tried):
                r = np.maximum(0.0, before - p @ u)
                total[n, :d] += (used(r, spare) * t) @ p
                total[n, d:] += ((p * (t * (r > 0))[:, None]).T @ p).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total.ravel())], ["at", "x"])

    out = np.zeros(size)
    for r in members.select("n_words", "p").mapInArrow(batches, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
        out[r["at"]] = r["x"]
    return out.reshape(len(tried), d * (d + 1))


def fit_rates(members: DataFrame, targets: dict[str, float], keep: tuple[str, ...] = (), spare: float = 1.0, tolerance: float = TOLERANCE) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The steps of the fit, the domains' targets in tokens, and what the rates give.

    The total is that of members, raised so far that no domain in keep has to shrink. A round tries several steps in one pass and
    takes that which comes nearest in squares: the gradient scaled by the second moments, which is quick while few rates are 0, and the plain one
    at some lengths, the shortest of which can't miss. Rounds go on until every domain is within tolerance of the total, or until STALL of
    them in a row have come no nearer: then nonnegative rates can't meet the targets.
    """
    d = len(targets)
    share = np.array(list(targets.values()))
    share = share / share.sum()
    steps: list[np.ndarray] = []
    first = moments(members, steps, [np.zeros(d)], spare)[0]
    have, second = first[:d], first[d:].reshape(d, d)
    length = 1 / max(np.linalg.eigvalsh(second)[-1], 1e-9)
    goal = share * max([have.sum()] + [have[i] / share[i] for i, name in enumerate(targets) if name in keep and share[i] > 0])
    left, slow = np.linalg.norm(have - goal), 0
    while np.abs(have - goal).max() > tolerance * goal.sum() and slow < STALL:
        scaled = np.linalg.solve(second + 1e-6 * max(np.trace(second), 1e-9) * np.eye(d), have - goal)
        tried = [scaled, scaled / 4, *[length * 8.0**k * (have - goal) for k in range(4)]]
        got = moments(members, steps, tried, spare)
        best = np.linalg.norm(got[:, :d] - goal, axis=1).argmin()
        now = np.linalg.norm(got[best, :d] - goal)
        if now >= left:
            break
        steps.append(tried[best])
        have, second = got[best, :d], got[best, d:].reshape(d, d)
        slow = slow + 1 if now > (1 - GAIN) * left else 0
        left = now
    return steps, goal, have


def rated(members: DataFrame, steps: list[np.ndarray]) -> DataFrame:
    """members with their rate."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            r = rates(_posteriors(b.column(3)), steps) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(r)], [*b.schema.names, "rate"])

    return members.mapInArrow(batches, "doc_id long, key long, n_words long, p array<double>, rate double")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, keep: tuple[str, ...] = (), spare: float = 1.0, labelled: int = LABELLED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, key, n_words, p_<domain>..., rate, copies, missed) of every document.

    copies is the rate rounded up or down by a hash of the document, so that its expectation is
    the rate; rates of at least spare and below 1 count as 1, which the fit knows. missed is the same in every row: how far the domain farthest from
    its target is off, as a share of all tokens; it is above TOLERANCE only where no nonnegative rates meet the targets. Tokens
    are white-space words here. Null and empty texts have none; their rate follows from the posteriors like any other. A null doc_id
    is never labelled and otherwise as good as any. Repeated rows have equal results; an empty table gives an empty result.
    """
    targets = targets or TARGETS
    model = fit_classifier(docs, labels, list(targets), labelled, doc_id, text)
    members = written(memberships(docs, model, doc_id, text), "memberships")
    steps, goal, have = fit_rates(members, targets, keep, spare)
    missed = float(np.abs(have - goal).max() / max(goal.sum(), 1e-12))
    counts = F.when((F.col("rate") >= spare) & (F.col("rate") < 1), F.lit(1.0)).otherwise(F.col("rate"))
    chance = F.shiftrightunsigned(F.xxhash64("key", F.lit("mix")), 11) / F.lit(float(1 << 53))
    shares = [F.get("p", F.lit(i)).alias(f"p_{n}") for i, n in enumerate(targets)]
    return rated(members, steps).select("doc_id", "key", "n_words", *shares, "rate", F.floor(counts + chance).cast("long").alias("copies"), F.lit(missed).alias("missed"))
