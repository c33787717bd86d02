"""Line dedup by winnowing over line hashes.

Windows are runs of whole lines with at least min_words words that lose that with the line at one of their ends: the
shortest from every line on, and the shortest up to every line. Winnowing selects in each window the line of the smallest hash
(of several the last), and keeps each selected line once, as a fingerprint at its position, with the windows that it was selected
for. Two documents that share a run of min_words words or more select the same fingerprints inside it, whatever surrounds the run.
Fingerprints that are met once are dropped; positions of the same fingerprint are joined, and from there matches are
extended both ways, window by window: windows of equal content are one run of lines in two places. A repeated run of any length is
covered by such windows to its last line at either end, however short that is, so overlapping
windows join to the longest run that is repeated. Of the places of a run all but the first in document order are deleted.
Occurrences are aggregated, never paired.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlloom.llm.common import content_key, forget, written

MIN_WORDS = 10
#: Where a null doc_id sorts in document order.
LAST = (1 << 63) - 1
#: Windows and fingerprints that are handed over at once.
ROWS = 50_000


def windows(words: list[int], min_words: int = MIN_WORDS) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(first line, line after the last) of the shortest windows from every line on, and of those up to every line."""
    on, to = [], []
    have = end = 0
    for i, n in enumerate(words):
        while have < min_words and end < len(words):
            have += words[end]
            end += 1
        if have < min_words:
            break
        on.append((i, end))
        have -= n
    have = begin = 0
    for j, n in enumerate(words):
        have += n
        while have - words[begin] >= min_words and begin < j:
            have -= words[begin]
            begin += 1
        if have >= min_words:
            to.append((begin, j + 1))
    return on, to


def selected(hashes: list[int], spans: list[tuple[int, int]]) -> Iterator[int]:
    """The last line of the smallest hash in each of the spans, whose ends never go back."""
    rising: deque[int] = deque()
    end = 0
    for a, z in spans:
        while end < z:
            while rising and hashes[rising[-1]] >= hashes[end]:
                rising.pop()
            rising.append(end)
            end += 1
        while rising[0] < a:
            rising.popleft()
        yield rising[0]


def fingerprints(text: str, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, list[tuple[int, int, int, int]]]]:
    """(hash, line, windows) of the selected lines of a whole text; windows are (first line, line after the last, digest high, digest low)."""
    data = text.encode("utf-8", "surrogatepass")
    lines = data.split(b"\n")
    words = [len(x.split()) for x in lines]
    if sum(words) < min_words:
        return
    hashes = [xxhash.xxh3_64_intdigest(x) for x in lines]
    at = np.concatenate([[0], np.cumsum([len(x) + 1 for x in lines])]).tolist()
    chosen: dict[int, set[tuple[int, int]]] = {}
    for spans in windows(words, min_words):
        for line, span in zip(selected(hashes, spans), spans, strict=True):
            chosen.setdefault(line, set()).add(span)
    for line, spans in chosen.items():
        rows = []
        for a, z in sorted(spans):
            digest = xxhash.xxh3_128_intdigest(data[at[a] : at[z] - 1])
            rows.append((a, z, digest >> 64, digest & (1 << 64) - 1))
        yield hashes[line], line, rows


def kept(text: str, spans: list[tuple[int, int]]) -> tuple[str, int, int, int]:
    """The text without the lines in spans; its lines, the removed ones and their runs."""
    lines = text.split("\n")
    gone = np.zeros(len(lines) + 2, np.int64)
    for a, b in spans:
        gone[a + 1] += 1
        gone[b + 1] -= 1
    out = np.cumsum(gone)[:-1] > 0  # out[0] stands before the first line
    runs = int((out[1:] & ~out[:-1]).sum())
    return "\n".join(x for x, o in zip(lines, out[1:], strict=True) if not o), len(lines), int(out.sum()), runs


def _longs(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def fingerprint_rows(df: DataFrame, min_words: int, doc_id: str, text: str) -> DataFrame:
    """(mark, pos, key, line, windows) of every fingerprint of every document."""

    def batch(b: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
        marks, line, spans = zip(*rows, strict=True)
        start, stop, high, low = zip(*[w for s in spans for w in s], strict=True)
        kinds = ["start", "stop", "high", "low"]
        flat = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(stop, pa.int32()), _longs(high), _longs(low)], kinds)
        nested = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(s) for s in spans])]), pa.int32()), flat)
        own = [b.column(k).take(pa.array(at)) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([_longs(marks), *own, pa.array(line, pa.int32()), nested], ["mark", "pos", "key", "line", "windows"])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            at: list[int] = []
            rows: list[tuple] = []
            size = 0
            for i, t in enumerate(b.column(2)):
                for found in fingerprints(t.as_py() or "", min_words):
                    at.append(i)
                    rows.append(found)
                    size += len(found[2])
                    if size >= ROWS:
                        yield batch(b, at, rows)
                        at, rows, size = [], [], 0
            if rows:
                yield batch(b, at, rows)

    source = df.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("pos"), content_key(doc_id, text).alias("key"), F.col(text).alias("text"))
    return source.mapInArrow(batches, "mark long, pos long, key long, line int, windows array<struct<start: int, stop: int, high: long, low: long>>")


def repeated(df: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(pos, key, spans): the windows of each document that repeat an earlier one."""
    rows = written(fingerprint_rows(df, min_words, doc_id, text), "fingerprints")
    # written, so that the joins get both sides by a shuffle that can split a frequent key
    marks = written(rows.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark"), "marks")
    extended = rows.join(marks, "mark", "left_semi").select("pos", "key", F.explode("windows").alias("w")).select("pos", "key", "w.*")
    candidates = written(extended, "candidates")
    forget(rows, marks)
    place = F.struct("pos", "key", "start")
    first = candidates.groupBy("high", "low").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").drop("last")
    first = written(first, "first")
    later = candidates.join(first, ["high", "low"]).where(place != F.col("first"))
    return later.groupBy("pos", "key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def dedup_lines(df: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df without later repeats of runs of lines, with n_lines, n_removed and n_runs.

    A run of lines counts if it has at least min_words words; its first place in order of
    doc_id, then of line, stays, and a null doc_id comes last. A line goes if any run that it is in has an earlier place, so
    short lines at the ends of a repeated run go with it. Lines are compared as they
    stand. Null texts stay null with no lines, empty ones have one empty line. Rows that
    repeat doc_id and text are one document, shown as often as it occurs. Columns of df
    that have the added names are replaced; an empty table gives an empty result.
    """
    added = ["n_lines", "n_removed", "n_runs"]
    df = df.drop(*added)
    spans = repeated(df, min_words, doc_id, text)
    rest = [c for c in df.columns if c != text]
    # all other columns travel as one, so that their names can't meet those used here
    keyed = df.select(F.struct(*rest).alias("rest"), F.col(text).alias("text"), F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("pos"), content_key(doc_id, text).alias("key"))
    joined = keyed.join(spans, ["pos", "key"], "left").select("rest", "text", "spans")
    schema = T.StructType([joined.schema["rest"], joined.schema["text"], *[T.StructField(n, T.LongType()) for n in added]])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(lo, 512) for whole in it for lo in range(0, whole.num_rows, 512)):
            out: list[tuple] = []
            for t, s in zip(b.column(1), b.column(2), strict=True):
                if (t := t.as_py()) is None:
                    out.append((None, 0, 0, 0))
                elif s.is_valid:
                    out.append(kept(t, [(x["start"], x["stop"]) for x in s.as_py()]))
                else:
                    out.append((t, t.count("\n") + 1, 0, 0))
            texts, *counts = zip(*out, strict=True) if out else ([],) * 4
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, b.column(1).type), *[pa.array(c, pa.int64()) for c in counts]], schema.names)

    return joined.mapInArrow(batches, schema).select(*[F.col("text").alias(c) if c == text else F.col("rest")[c].alias(c) for c in df.columns], *added)


def oracle_sql(min_words: int = MIN_WORDS) -> str:
    return rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, ls[i] AS line, len(regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+')) AS w
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
c AS (SELECT doc_id, i, line, w, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM l),
long AS (SELECT a.doc_id, a.i, b.i AS j FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.w >= {min_words}),
e AS (SELECT doc_id, i, min(j) AS j FROM long GROUP BY doc_id, i UNION SELECT doc_id, max(i), j FROM long GROUP BY doc_id, j),
x AS (SELECT e.doc_id, e.i, e.j, array_to_string(d.ls[e.i:e.j], chr(10)) AS content FROM e JOIN d USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, i) AS nth FROM x),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS i FROM r WHERE nth > 1),
m AS (SELECT l.*, g.i IS NOT NULL AS cut FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i),
n AS (SELECT *, coalesce(lag(cut) OVER (PARTITION BY doc_id ORDER BY i), false) AS before FROM m)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT cut), '') AS text,
       count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE cut)::BIGINT AS n_removed,
       count(*) FILTER (WHERE cut AND NOT before)::BIGINT AS n_runs
FROM n GROUP BY doc_id"""
