"""Repeated passages by sparse suffix arrays.

A passage is a stretch of at least MIN_WORDS words (split at white space, compared as they are) that occurs in
two places, in one document or in several.  Of each text only the suffixes at content-selected positions are
kept: the anchor of a stretch of MIN_WORDS words is the (leftmost) place in it where the hash of the next SEED
words is least, and the places that are anchors of some stretch are kept.  Equal stretches have equal anchors.

The kept suffixes are dealt by their first SEED words and sorted; those of equal neighbours are matches.  Only
documents with matches are read again, and send their matching suffixes with the words to the right and to the
left.  There the suffixes are sorted by the words that follow and compared with their neighbours word by word, which
extends a match to the right, and sorted by the words before, backwards, which extends it to the left.  For each
number of words to the left, suffixes that agree as far on both sides are one class: a passage, if it has several,
and the least document and place is its first.  No two suffixes are compared that are not neighbours.

The first occurrence (least id, then place) stays; words that only later occurrences cover are to be removed.

Words are compared by 32 bits of their hashes, beyond the 64 bits of the first SEED words: a passage can seem a word
longer than it is with probability 2^-32 an end.

Defined results: null, empty and short texts have no passages; rows equal in id and text are one document and
get the same result; a null id sorts last; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError
from .common import WORD, forget, maybe_in, release, table, written
from .memos import serve, trimmed
from .words import bounds, distinct, expand, mixed, pack, powers, runs, squeeze, unpack, word_hashes

MIN_WORDS, SEED = 50, 25
#: A worker sends what it has gathered when it holds so many places, or documents.
FLUSH_PLACES, FLUSH_DOCS = 1_000_000, 60_000
#: Groups of suffixes a shuffle partition: a worker holds one at a time.
GROUPS = 4
#: Neighbours that are compared at a time.
BLOCK = 20_000
NO_ID = 2**63 - 1

_U = np.uint64


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each stretch of n words, the same wherever the stretch is."""
    if len(h) < n:
        return np.empty(0, _U)
    up, down = powers(len(h))
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(h * up, dtype=_U)])
    return mixed((sums[n:] - sums[:-n]) * down[: len(h) - n + 1])


def _sliding(x: np.ndarray, width: int, least) -> np.ndarray:
    """least over each stretch of width, by doubling."""
    span, m = 1, x
    while span * 2 <= width:
        m = least(m[:-span], m[span:])
        span *= 2
    rest = width - span
    return least(m[: len(m) - rest], m[rest:]) if rest else m


def anchors(h: np.ndarray, words: int = MIN_WORDS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The places that are anchors of stretches of `words` words, their seed hashes, and the least and the largest
    number of words that those stretches have before the anchor."""
    if len(h) < words:
        none = np.empty(0, np.int64)
        return none, np.empty(0, _U), none, none
    x, width = rolling(h, seed), words - seed + 1
    m = _sliding(x, width, np.minimum)  # per stretch
    # the leftmost place of the least: the first place of that value at or after the stretch's start
    order = np.argsort(x, kind="stable")
    start = np.arange(len(m))
    if len(distinct(x)) == len(x):
        at = order[np.searchsorted(x[order], m)]
    else:
        v = x[order]
        lo = np.searchsorted(v, m)
        # places of a value are sorted; count those before the start
        key = np.searchsorted(distinct(x), v) * len(x) + order
        at = order[np.searchsorted(key, np.searchsorted(distinct(x), m) * len(x) + start)]
        assert (v[lo] == m).all()
    place, first, count = np.unique(at, return_index=True, return_counts=True)
    return place, x[place], place - start[first] - count + 1, place - start[first]


class _Sender:
    """Gathers (key, document, place, more) and packs them by the part of the key."""

    def __init__(self, parts: int, width: int = 0):
        self.cuts, self.width = bounds(parts), width
        self.clear()

    def clear(self):
        self.keys, self.places, self.more, self.own, self.ids, self.rows, self.total = [], [], [], [], [], [], 0

    def add(self, keys, places, doc_id, row, more=None):
        self.keys.append(keys)
        self.places.append(places)
        if more is not None:
            self.more.append(more)
        self.own.append(len(keys))
        self.ids.append(NO_ID if doc_id is None else doc_id)
        self.rows.append(row)
        self.total += len(keys) * (1 + self.width // 4)

    def full(self) -> bool:
        return self.total > FLUSH_PLACES or len(self.own) >= FLUSH_DOCS

    def packed(self) -> pa.RecordBatch:
        k = np.concatenate([np.empty(0, _U), *self.keys])
        place = np.concatenate([np.empty(0, np.int64), *self.places]).astype("<u4")
        more = np.concatenate([np.empty((0, self.width), "<u4"), *self.more])
        d = np.repeat(np.arange(len(self.own)), self.own)
        ids, rows = np.array(self.ids, "<i8"), np.array(self.rows, "<i8")
        order = np.argsort(k, kind="stable")
        k, place, d = k[order], place[order], d[order]
        at, out = np.append(np.searchsorted(k, self.cuts), len(k)), []
        for p, (a, b) in enumerate(zip(at, at[1:])):
            if b > a:
                used, short = np.unique(d[a:b], return_inverse=True)
                own = more[order[a:b]].astype("<u4").tobytes() if self.width else b""
                out.append((p, pack(k[a:b]), squeeze(place[a:b]), squeeze(short.astype("<u2")), ids[used].tobytes(), rows[used].tobytes(), own))
        self.clear()
        cols = list(zip(*out)) or [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["part", "keys", "places", "docs", "ids", "rows", "more"])


_SENT = "part int, keys binary, places binary, docs binary, ids binary, rows binary, more binary"


def _received(pdf: pd.DataFrame, width: int = 0) -> tuple[np.ndarray, ...]:
    """keys, ids, rows, places and more, sorted by the first four, each once; of keys that come several times."""
    keys = np.concatenate([unpack(k) for k in pdf["keys"]])
    place = np.concatenate([expand(p, "<u4") for p in pdf["places"]])
    doc = [expand(d, "<u2") for d in pdf["docs"]]
    ids = np.concatenate([np.frombuffer(i, "<i8")[d] for i, d in zip(pdf["ids"], doc)])
    rows = np.concatenate([np.frombuffer(r, "<i8")[d] for r, d in zip(pdf["rows"], doc)])
    order = np.lexsort((place, rows, ids, keys))
    k, r, p = keys[order], rows[order], place[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1]) | (p[1:] != p[:-1])
    order = order[fresh]
    n = np.diff(runs(keys[order]))
    order = order[np.repeat(n, n) > 1]
    more = np.concatenate([np.frombuffer(m, "<u4").reshape(-1, width) for m in pdf["more"]])[order] if width else None
    return keys[order], ids[order], rows[order], place[order], more


def _sorted(keys: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by key and words of context: their order, and in how many words each agrees with its neighbour
    before; -1 if not in the key."""
    n, width = context.shape
    x = np.concatenate([keys.astype("<u8").view("<u4").reshape(n, 2), context], axis=1)
    order = np.argsort(x.view(f"V{4 * (width + 2)}").ravel(), kind="stable")
    agree = np.full(n, -1, np.int16)
    for a in range(1, n, BLOCK):
        i, j = order[a - 1 : a - 1 + BLOCK], order[a : a + BLOCK]
        differ = x[i[: len(j)]] != x[j]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), width + 2)
        agree[a : a + BLOCK] = np.where(first < 2, -1, first - 2)
    return order, agree


def _class_of(order: np.ndarray, agree: np.ndarray, depth: int) -> np.ndarray:
    """The class of each suffix: those that agree in key and so many words, which are neighbours."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(agree < depth)
    return out


def _repeats(keys: np.ndarray, left: np.ndarray, right: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of documents and places: bit l of the first result tells whether the stretch with l words
    before the suffix is repeated, of the second whether it is the first of its kind."""
    n, width = left.shape
    repeated, first = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    before, after = _sorted(keys, left), _sorted(keys, right)
    for l in range(width + 1):
        own = np.flatnonzero((least <= l) & (l <= most))
        c = _class_of(*before, l)[own] * (n + 2) + _class_of(*after, width - l)[own]
        order = np.argsort(c, kind="stable")
        r = runs(c[order])
        size = np.diff(r)
        several = np.repeat(size > 1, size)
        lead = np.zeros(len(own), bool)
        lead[r[:-1]] = True
        repeated[own[order[several]]] |= _U(1 << l)
        first[own[order[several & lead]]] |= _U(1 << l)
    return repeated, first


def _by_document(met: DataFrame) -> DataFrame:
    """row, places, repeated, first (packed), gathered by document."""

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = np.frombuffer(b"".join(pdf["rows"]), np.int64)
        place = np.frombuffer(b"".join(pdf["places"]), np.uint32)
        masks = [np.frombuffer(b"".join(pdf[c]), np.uint64) for c in ("repeated", "first")]
        order = np.lexsort((place, rows))
        rows, place, masks = rows[order], place[order], [m[order] for m in masks]
        g = runs(rows)
        return pd.DataFrame([(int(rows[a]), squeeze(place[a:b].astype("<u4")), *(squeeze(m[a:b].astype("<u8")) for m in masks)) for a, b in zip(g, g[1:])], columns=["row", "places", "repeated", "first"])

    return met.groupBy("part").applyInPandas(trimmed("suffix", gather), "row long, places binary, repeated binary, first binary")


def _dealt(rows: np.ndarray, place: np.ndarray, repeated: np.ndarray, first: np.ndarray, parts: int) -> pd.DataFrame:
    group = (rows.astype(_U) % _U(parts)).astype(np.int64)
    order = np.lexsort((rows, group))
    g = runs(group[order])
    return pd.DataFrame([(int(group[order[a]]), *(x[order[a:b]].tobytes() for x in (rows, place, repeated, first))) for a, b in zip(g, g[1:])], columns=["part", "rows", "places", "repeated", "first"])


_MET = "part int, rows binary, places binary, repeated binary, first binary"


def _spans(covered: np.ndarray) -> list[tuple[int, int]]:
    e = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    return list(zip(e[::2].tolist(), e[1::2].tolist()))


def _covered(starts: np.ndarray, n: int, words: int) -> np.ndarray:
    c = np.zeros(n + 1, np.int64)
    np.add.at(c, starts, 1)
    np.add.at(c, np.minimum(starts + words, n), -1)
    return np.cumsum(c[:n]) > 0


_SPANS = "array<struct<start:bigint,stop:bigint>>"


def row_key(doc: str, text: str):
    return F.xxhash64(F.col(doc), F.col(text))


def repeated_passages(docs: DataFrame, doc: str = "doc_id", text: str = "text", words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """row (row_key of the document), repeated and removed: arrays of spans of word numbers [start, stop), for
    the documents that hold repeated passages."""
    parts = GROUPS * max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    d = docs.select(F.col(doc).cast("long").alias("id"), F.col(text).alias("text"), row_key(doc, text).alias("row"))
    width = words - seed
    if not 0 < width < 64:
        raise ConfigError("passages have 1 to 63 words more than seeds")

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("suffix")
        s = _Sender(parts)
        for b in batches:
            for i, t, r in zip(*b.columns):
                at, keys, _, _ = anchors(word_hashes(t.as_py()), words, seed)
                if len(at):
                    s.add(keys, at, i.as_py(), r.as_py())
                if s.full():
                    yield s.packed()
        yield s.packed()

    def equal(pdf: pd.DataFrame) -> pd.DataFrame:
        _, _, rows, place, _ = _received(pdf)
        return _dealt(rows, place, np.zeros(len(rows), _U), np.zeros(len(rows), _U), parts)

    met = d.mapInArrow(seeds, _SENT).groupBy("part").applyInPandas(trimmed("suffix", equal), _MET)
    matches = written(_by_document(met).select("row", "places"), "suffix-matches")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("suffix")
        s = _Sender(parts, 2 * width + 1)
        for b in batches:
            for i, t, r, p in zip(*b.columns):
                h = word_hashes(t.as_py())
                at, keys, least, most = anchors(h, words, seed)
                own = np.isin(at, expand(p.as_py(), "<u4"))
                at, keys, least, most = at[own], keys[own], least[own], most[own]
                low = np.concatenate([np.zeros(width, _U), h, np.zeros(words, _U)]) & _U(0xFFFFFFFF)
                k = np.arange(width)
                left = np.where(k < most[:, None], low[at[:, None] + width - 1 - k], 0)  # backwards from the suffix
                right = np.where(k < (width - least)[:, None], low[at[:, None] + width + seed + k], 0)
                s.add(keys, at, i.as_py(), r.as_py(), np.concatenate([left, right, (least * 64 + most)[:, None].astype(_U)], axis=1).astype("<u4"))
                if s.full():
                    yield s.packed()
        yield s.packed()

    def extended(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, _, rows, place, more = _received(pdf, 2 * width + 1)
        if not len(keys):
            return pd.DataFrame(columns=["part", "rows", "places", "repeated", "first"])
        ends = more[:, -1].astype(np.int64)
        repeated, first = _repeats(keys, more[:, :width], more[:, width:-1], ends // 64, ends % 64)
        some = repeated > 0
        return _dealt(rows[some], place[some], repeated[some], first[some], parts)

    again = maybe_in(d, "row", matches.select("row")).join(matches, "row").select("id", "text", "row", "places")
    found = _by_document(again.mapInArrow(contexts, _SENT).groupBy("part").applyInPandas(trimmed("suffix", extended), _MET))

    def spans(parts_: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        serve("suffix")
        for pdf in parts_:
            out = []
            for row, *cols in zip(pdf["row"], pdf["places"], pdf["repeated"], pdf["first"]):
                place, masks = expand(cols[0], "<u4").astype(np.int64), [expand(c, "<u8") for c in cols[1:]]
                l = np.arange(width + 1)
                every, lead = (((m[:, None] >> l.astype(_U)) & _U(1)).astype(bool) for m in masks)
                start = place[:, None] - l
                n = int(place.max()) + words
                first, repeated = _covered(start[lead], n, words), _covered(start[every], n, words)
                later = _covered(start[every & ~lead], n, words) & ~first
                out.append((row, *[[{"start": a, "stop": b} for a, b in _spans(c)] for c in (repeated, later)]))
            yield pd.DataFrame(out, columns=["row", "repeated", "removed"])

    out = written(found.mapInPandas(spans, f"row long, repeated {_SPANS}, removed {_SPANS}"), "suffix-found")
    forget(docs.sparkSession, matches)
    release(docs.sparkSession)
    return out


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of spans; each goes with the white space that follows it."""
    at = [m.start() for m in re.finditer(WORD, text)] + [len(text)]
    out, last = [], 0
    for start, stop in spans:
        out.append(text[last : at[start]])
        last = at[stop]
    return "".join([*out, text[last:]])


def remove_passages(docs: DataFrame, doc: str = "doc_id", text: str = "text", words: int = MIN_WORDS) -> DataFrame:
    """docs with the later occurrences of passages cut from text; other columns as they are."""
    found = repeated_passages(docs, doc, text, words).where(F.size("removed") > 0)

    def cut(texts: pd.Series, removed: pd.Series) -> pd.Series:
        return pd.Series([t if r is None or t is None else without_spans(t, [(x["start"], x["stop"]) for x in r]) for t, r in zip(texts, removed)], dtype=object)

    cut_udf = F.pandas_udf(cut, "string")
    d, keys = docs.withColumn("__key", row_key(doc, text)), found.select(F.col("row").alias("__key"))
    spans = found.select(F.col("row").alias("__key"), F.col("removed").alias("__removed"))
    some = maybe_in(d, "__key", keys).join(spans, "__key", "left")  # the others are not shuffled
    some = some.withColumn(text, F.when(F.col("__removed").isNull(), F.col(text)).otherwise(cut_udf(F.col(text), F.col("__removed"))))
    return some.select(*docs.columns).union(maybe_in(d, "__key", keys, "left_anti").select(*docs.columns))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = repeated_passages(docs)
    base = written(docs.select("doc_id", row_key("doc_id", "text").alias("row"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words")), "suffix-base")
    total = lambda c: F.coalesce(F.aggregate(c, F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"]), F.lit(0).cast("long"))
    listed = F.coalesce(F.array_join(F.transform("repeated", lambda s: F.concat_ws("-", s["start"].cast("string"), s["stop"].cast("string"))), ","), F.lit(""))
    return base.join(found, "row", "left").select("doc_id", "n_words", total("repeated").alias("n_repeated"), total("removed").alias("n_removed"), listed.alias("spans"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(doc_id, 9223372036854775807) AS o, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), u AS (SELECT row_number() OVER (ORDER BY o, text) AS r, * FROM (SELECT DISTINCT o, text, w FROM d)),
x AS (
  SELECT r, o, s, md5(array_to_string(w[s + 1:s + 50], ' ')) AS k FROM (SELECT *, unnest(generate_series(0, len(w) - 50)) AS s FROM u WHERE len(w) >= 50)
), m AS (
  SELECT r, s, row_number() OVER (PARTITION BY k ORDER BY o, r, s) = 1 AS first FROM x QUALIFY count(*) OVER (PARTITION BY k) > 1
), c AS (
  SELECT r, p, bool_or(first) AS kept FROM (SELECT r, first, unnest(generate_series(s, s + 49)) AS p FROM m) GROUP BY r, p
), i AS (
  SELECT r, min(p) AS a, max(p) + 1 AS b, count(*) FILTER (NOT kept) AS gone FROM (SELECT *, p - row_number() OVER (PARTITION BY r ORDER BY p) AS g FROM c) GROUP BY r, g
), s AS (
  SELECT r, sum(b - a)::BIGINT AS n_repeated, sum(gone)::BIGINT AS n_removed, string_agg(a::VARCHAR || '-' || b::VARCHAR, ',' ORDER BY a) AS spans FROM i GROUP BY r
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_repeated, 0)::BIGINT AS n_repeated, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(spans, '') AS spans
FROM d JOIN u ON d.o = u.o AND d.text IS NOT DISTINCT FROM u.text LEFT JOIN s USING (r)
"""
