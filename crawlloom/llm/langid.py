"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram binds its letters: the
vectors, each rotated by the letter's place, are multiplied elementwise. A text
bundles (adds) its n-grams' vectors, a language bundles its texts, and a text
is compared with the languages' prototypes by cosine.

Bundling is linear, so a batch of texts is its count matrix times the vectors of the n-grams
that occur in it, and a language's prototype is the sum of what the tasks have bundled. Every letter
of any script has a vector of its own, made from its code point.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

N = 3
DIMENSIONS = 1024
SEED = 7
#: Characters that are worked on at once, so that memory doesn't follow the texts' lengths.
CHUNK = 1 << 18
#: Texts and n-grams that are bundled at once.
ROWS, GRAMS = 256, 1 << 19
#: N-grams whose vectors are made at once, and the size of a table of counts up to which it is made whole.
SLICE, TABLE = 4096, 1 << 22
UND = "und"


@lru_cache(1)
def letter_table() -> np.ndarray:
    """Every code point's letter in lower case, 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            out[cp] = ord(c.lower()[0])
    return out


@lru_cache(1 << 14)
def letter_vector(letter: int) -> np.ndarray:
    """The letter's own vector; 0 stands for the gap between words."""
    return np.random.default_rng([SEED, letter]).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1


def letters(text: str) -> Iterator[np.ndarray]:
    """The letters of a whole text chunk by chunk, runs of anything else being one gap; every n-gram lies in one chunk."""
    table, last = letter_table(), np.zeros(1, np.uint32)
    for i in range(0, len(text), CHUNK):
        s = table[np.frombuffer(text[i : i + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)]
        s = np.concatenate([last, s] if i + CHUNK < len(text) else [last, s, np.zeros(1, np.uint32)])
        s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]
        if len(s) >= N:
            yield s
        last = s[-(N - 1) :]


def _bundled(chunks: list[np.ndarray], rows: list[int], out: np.ndarray, total: np.ndarray) -> None:
    """Adds the n-grams' vectors of every chunk to its row of out, and their number to total."""
    s = np.concatenate(chunks)
    size = np.array([len(c) for c in chunks])
    first = np.repeat(np.cumsum(size) - size, size - (N - 1)) + np.arange((size - (N - 1)).sum()) - np.repeat(np.cumsum(size - (N - 1)) - (size - (N - 1)), size - (N - 1))
    row = np.repeat(rows, size - (N - 1))
    # the letters that occur, dealt numbers as small as can be
    seen = np.zeros(0x110000, bool)
    seen[s] = True
    alphabet = np.flatnonzero(seen)
    number = np.zeros(0x110000, np.int64)
    number[alphabet] = np.arange(len(alphabet))
    n, s = len(alphabet), number[s]
    code = np.zeros(len(first), np.int64)
    for k in range(N):
        code = code * n + s[first + k]
    if n**N <= 1 << 21:
        there = np.zeros(n**N, bool)
        there[code] = True
        grams = np.flatnonzero(there)
        place = np.zeros(n**N, np.int64)
        place[grams] = np.arange(len(grams))
        column = place[code]
    else:
        grams, column = np.unique(code, return_inverse=True)
    base = np.stack([letter_vector(int(x)) for x in alphabet])
    turned = [np.roll(base, N - 1 - k, axis=1) for k in range(N)]
    at, row = np.unique(row, return_inverse=True)
    whole = np.bincount(row * len(grams) + column, minlength=len(at) * len(grams)).reshape(len(at), -1) if len(at) * len(grams) <= TABLE else None
    order = None if whole is not None else np.argsort(column, kind="stable")
    cuts = None if order is None else np.searchsorted(column[order], np.arange(0, len(grams) + SLICE, SLICE))
    for j, lo in enumerate(range(0, len(grams), SLICE)):
        some = grams[lo : lo + SLICE]
        vectors = turned[0][some // n ** (N - 1)]
        for k in range(1, N):
            vectors = vectors * turned[k][some // n ** (N - 1 - k) % n]
        if whole is not None:
            counts = whole[:, lo : lo + SLICE]
        else:
            own = order[cuts[j] : cuts[j + 1]]
            counts = np.bincount(row[own] * len(some) + column[own] - lo, minlength=len(at) * len(some)).reshape(len(at), -1)
        out[at] += counts.astype(np.float32) @ vectors.astype(np.float32)
    total[at] += np.bincount(row, minlength=len(at))


def bundles(texts: Iterable[str | None], rows: list[int], size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of size rows the bundle of all n-grams of the texts that belong to it, and their number; whole numbers."""
    out, total = np.zeros((size, DIMENSIONS)), np.zeros(size, np.int64)
    held: list[np.ndarray] = []
    at: list[int] = []
    n = 0
    for t, r in zip(texts, rows, strict=True):
        for s in letters(t or ""):
            held.append(s)
            at.append(r)
            n += len(s)
            if n >= GRAMS:
                _bundled(held, at, out, total)
                held, at, n = [], [], 0
    if held:
        _bundled(held, at, out, total)
    return out, total


def profiles(df: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """The unit prototype of every non-null language in df; all rows count.

    Tasks bundle their texts by language and the bundles are added up by dimension, so what comes to the driver is
    one number for each dimension of each language, however many rows there are.
    """

    def sent(total: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for name, vector in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * DIMENSIONS), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(vector)], ["lang", "at", "n"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                b = whole.slice(lo, ROWS)
                langs = b.column(1).to_pylist()
                names = sorted(set(langs))
                sums, _ = bundles((t.as_py() for t in b.column(0)), [names.index(x) for x in langs], len(names))
                for name, vector in zip(names, sums, strict=True):
                    total[name] = total.get(name, 0) + vector.astype(np.int64)
                if len(total) > 64:
                    yield from sent(total)
                    total = {}
        yield from sent(total)

    rows = (
        df.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
        .select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
        .mapInArrow(gather, "lang string, at int, n long")
        .groupBy("lang", "at")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    out = {}
    for name, part in rows.groupby("lang"):
        vector = np.zeros(DIMENSIONS)
        vector[part["at"].to_numpy()] = part["n"].to_numpy(np.float64)
        if norm := np.linalg.norm(vector):
            out[name] = vector / norm
    return dict(sorted(out.items()))


def predict(texts: list[str | None], prototypes: dict[str, np.ndarray]) -> tuple[list[str], list[float]]:
    """The nearest prototype's language and its cosine, cut at 0; ties go to the smaller name.

    What all prototypes share (their mean) tells no language from another and is taken off before they are compared. A text that
    is null or has no letter, and any text where there are no prototypes, is und with score 0.
    """
    names = list(prototypes)
    if not names or not texts:
        return [UND] * len(texts), [0.0] * len(texts)
    p = np.stack([prototypes[n] for n in names])
    apart = p - p.mean(0) if len(names) > 1 else p
    apart = apart / np.maximum(np.linalg.norm(apart, axis=1, keepdims=True), 1e-12)
    langs: list[str] = []
    scores: list[float] = []
    for i in range(0, len(texts), ROWS):
        some = texts[i : i + ROWS]
        vectors, total = bundles(some, list(range(len(some))), len(some))
        cosine = vectors / np.maximum(np.linalg.norm(vectors, axis=1), 1e-12)[:, None] @ apart.T
        best = cosine.argmax(1)
        langs += [names[b] if n else UND for b, n in zip(best, total, strict=True)]
        scores += [float(min(max(c[b], 0.0), 1.0)) if n else 0.0 for c, b, n in zip(cosine, best, total, strict=True)]
    return langs, scores


def identify(df: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """df with lang_pred and score of every whole text.

    Null and empty texts and texts without a letter are und with score 0; equal texts
    get equal results; columns of df that have these names are replaced.
    """
    df = df.drop("lang_pred", "score")
    at = df.columns.index(text)
    schema = T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # some texts at a time, so that memory holds no whole batch
        for b in (whole.slice(lo, ROWS) for whole in it for lo in range(0, whole.num_rows, ROWS)):
            langs, scores = predict(b.column(at).to_pylist(), prototypes)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names, "lang_pred", "score"])

    return df.mapInArrow(batches, schema)
