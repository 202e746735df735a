"""N-gram Jaccard join over parity sketches.

The sets are the distinct five-word shingles of lower-cased texts, as 64-bit hashes.  A band holds sets of like
size.  In a band of sets up to size e, a set is dealt by hash into K parts, and each part is the XOR of its
hashes; the number of parts in which two sketches differ is at most the size of the symmetric difference, which
for linked sets is at most a third of the smaller one (similarity 0.75).  K is larger than that, so linked sets
agree in at least one part that is not empty, and meet there.  Sets near a border are put into both bands.  Sets
of up to TINY shingles use each shingle as a part of its own.

Those that meet in a part make a run.  Every set is first held against the least of all its runs' first members:
one pair a set, after which most near copies are one component.  Components are merged on their labels, and runs
that hold one label only are out.  In the rest each set is held against its runs' first members of other
components, then against its nearest of another component, and at last all pairs across components are compared; a parity sketch of bits, whose Hamming distance is at most the symmetric difference, rules most of them
out before the sets are compared.  A run of many members is cut into blocks, and pairs of blocks are dealt to
tasks.  So a group of thousands of near copies costs a few comparisons per member, and no link is lost.

Equal sets are one node throughout.  Two different sets share a 64-bit name with probability 2^-64 a pair.  An
empty part that two sets share tells nothing; K leaves room for that, and for a linked pair the probability
that only empty parts agree is below 1e-9.

Defined results: null texts and texts without words have no shingles and are linked with nothing; rows with
the same id are rows of their own; a null id never names a component unless all its ids are null; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError
from .common import batches_of, forget, maybe_in, release, table, written
from .graph import merged
from .memos import serve, trimmed
from .suffix_dedup import row_key
from .words import bounds, mixed, pack, runs, shingle_set, unpack

TINY, RATIO = 40, 1.78
SKETCH_BITS = 256
#: A worker sends what it has gathered when it holds so many parts, or documents.
FLUSH_PARTS, FLUSH_DOCS = 2_000_000, 60_000
#: Pairs of sketches that are compared at a time; documents, or pairs of sets, that are sent to Python at a time.
BLOCK, BATCH = 200_000, 500
#: Near copies share many runs, so one run in so many is enough to find a set's nearest; all pairs are looked for in
#: all runs.
NEAREST_SHARE = 8

#: Members of a run that are compared with each other in one piece.
MEMBERS = 1_024
#: Groups of pieces a shuffle partition: a worker holds one at a time.
GROUPS = 4

_U = np.uint64
_CONTENT = _U((1 << 44) - 1)
#: As many parts can be numbered beside 44 bits of content.
PACKED_PARTS = 1 << 20
EDGES = [TINY]


def band_of(n: int) -> int:
    """The band of sets of n shingles; there is no last one."""
    while EDGES[-1] < n:
        EDGES.append(math.floor(EDGES[-1] * RATIO))
    return next(j for j, e in enumerate(EDGES) if n <= e)


def parts_of_band(band: int) -> int:
    """K: more than a third of the band's largest set, with room for empty parts."""
    return math.ceil(1.08 * (EDGES[band] // 3)) + 4


def set_name(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) & 0x7FFFFFFFFFFFFFFF


def signatures(s: np.ndarray) -> np.ndarray:
    """The parts of a set's sketches, in its own band and, near the border, the band below."""
    n = len(s)
    if n < 3:  # two different sets need at least 3 and 4 shingles
        return np.empty(0, _U)
    band = band_of(n)
    out = []
    for j in (band, band - 1) if band and math.ceil(0.75 * n) <= EDGES[band - 1] else (band,):
        if j == 0:
            out.append(mixed(s + _U(1)))
            continue
        k = parts_of_band(j)
        if k <= PACKED_PARTS:  # one sort deals and orders: the part's number above, 44 bits of the shingle below
            x = np.sort(((s >> _U(44)) % _U(k)) << _U(44) | (s & _CONTENT))
            part, x = x >> _U(44), x & _CONTENT
        else:
            part = s % _U(k)
            order = np.argsort(part, kind="stable")
            part, x = part[order], s[order]
        starts = runs(part)[:-1]
        content = np.bitwise_xor.reduceat(x, starts)
        out.append(mixed(content + mixed(part[starts] * _U(64) + _U(j))))
    return np.concatenate(out)


def bit_sketch(s: np.ndarray) -> np.ndarray:
    """Parities of a set's shingles by their low bits, as 64-bit words: a power of two of bits, SKETCH_BITS at
    least and as many as the set has shingles."""
    bits = max(SKETCH_BITS, 1 << max(0, len(s) - 1).bit_length())
    return np.packbits((np.bincount((s & _U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").view("<u8")


def folded(k: np.ndarray, words: int) -> np.ndarray:
    """Sketches (in the last axis) as they are with fewer bits."""
    while k.shape[-1] > words:
        half = k.shape[-1] // 2
        k = k[..., :half] ^ k[..., half:]
    return k


def named_sets(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """doc_id, row (row_key of the document), n_shingles, s (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("jaccard")
        for b in batches:
            n, names = [], []
            for t in b.column(1):
                s = shingle_set(t.as_py())
                n.append(len(s))
                names.append(set_name(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(names, pa.int64())], names=["doc_id", "row", "n_shingles", "s"])

    return docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"), row_key(doc, text).alias("row")).mapInArrow(run, "doc_id long, row long, n_shingles long, s long")


def flushed(keys: list, own: list, names: list, bits: int, cuts: np.ndarray) -> pa.RecordBatch:
    """The keys of sets (own: how many each has) by their upper bits, a row for each part between cuts; empties keys.
    In place as far as it goes: there are millions of keys."""
    k = np.concatenate(keys)
    keys.clear()
    k >>= _U(64 - bits)
    if bits <= 48:  # one sort of both
        k <<= _U(16)
        k |= np.repeat(np.arange(len(own), dtype=_U), own)
        k.sort()
        d = k.astype(np.uint16)  # the lower 16 bits
        k >>= _U(16)
    else:
        order = np.argsort(k, kind="stable")
        k, d = k[order], np.repeat(np.arange(len(own), dtype=np.uint16), own)[order]
    at, names = np.append(np.searchsorted(k, cuts), len(k)), np.array(names, np.int64)
    rows, short = [], np.zeros(len(own), "<u2")
    for p, (a, b) in enumerate(zip(at, at[1:])):
        if b > a:
            used = np.flatnonzero(np.bincount(d[a:b], minlength=len(own)))
            short[used] = np.arange(len(used))
            rows.append((p, pack(k[a:b]), short[d[a:b]].tobytes(), names[used].astype("<i8").tobytes()))
    cols = list(zip(*rows)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["part", "keys", "sets", "names"])


def sketch_runs(docs: DataFrame, text: str) -> DataFrame:
    """run, s, lead: sets that meet in a part of a sketch; lead is the run's least s.  Runs of one set are left out."""
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bits = min(64, 36 + 2 * math.ceil(math.log2(parts + 1)))  # a shorter key can only make sets meet that need not
    cuts = bounds(parts) >> _U(64 - bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("jaccard")
        keys, own, names, total, known = [], [], [], 0, set()
        for b in batches:
            for t in b.column(0):
                s = shingle_set(t.as_py())
                if len(s) < 3 or (name := set_name(s)) in known:  # equal sets need to be sent once
                    continue
                known.add(name)
                k = signatures(s)
                keys.append(k)
                own.append(len(k))
                names.append(name)
                total += len(k)
                if total > FLUSH_PARTS or len(own) >= FLUSH_DOCS:
                    yield flushed(keys, own, names, bits, cuts)
                    keys, own, names, total, known = [], [], [], 0, set()
        if own:
            yield flushed(keys, own, names, bits, cuts)

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([unpack(k) for k in pdf["keys"]])
        s = np.concatenate([np.frombuffer(n, "<i8")[np.frombuffer(i, "<u2")] for i, n in zip(pdf["sets"], pdf["names"])])
        order = np.argsort(keys)
        keys, s = keys[order], s[order]
        n = np.diff(runs(keys))
        many = np.repeat(n, n) > 1  # most parts are met by one set only
        keys, s = keys[many], s[many]
        order = np.lexsort((s, keys))
        keys, s = keys[order], s[order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (s[1:] != s[:-1])
        keys, s = keys[fresh], s[fresh]
        r = runs(keys)
        n = np.diff(r)
        many = np.repeat(n, n) > 1
        return pd.DataFrame({"run": keys[many].astype(np.int64), "s": s[many], "lead": np.repeat(s[r[:-1]], n)[many]})

    sent = docs.select(F.col(text).alias("text")).mapInArrow(send, "part int, keys binary, sets binary, names binary")
    return sent.groupBy("part").applyInPandas(trimmed("jaccard", meet), "run long, s long, lead long")


def set_table(docs: DataFrame, base: DataFrame, wanted: DataFrame, doc: str, text: str) -> DataFrame:
    """s, n, shingles (packed, the upper 48 bits), sketch for the sets in wanted (s), each once a task.  A text is
    found by its row_key, so sets that only rows without an id hold are found as well."""
    ids = written(base.join(wanted, "s", "left_semi").groupBy("s").agg(F.min("row").alias("row")), "jaccard-ids")
    own = maybe_in(docs.select(row_key(doc, text).alias("row"), F.col(text).alias("text")), "row", ids).join(ids, "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("jaccard")
        known = set()  # rows of one key are repeated rows
        for b in batches:
            rows = []
            for t, want in zip(b.column(0), b.column(1)):
                if want.as_py() in known:
                    continue
                s = shingle_set(t.as_py())
                if len(s) and set_name(s) == want.as_py():
                    known.add(want.as_py())
                    rows.append((want.as_py(), len(s), pack(s >> _U(16)), bit_sketch(s).tobytes()))
            cols = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], names=["s", "n", "shingles", "sketch"])

    out = written(own.select("text", "s").mapInArrow(run, "s long, n long, shingles binary, sketch binary"), "jaccard-sets")
    forget(docs.sparkSession, ids)
    return out


def linked(pairs: DataFrame, sets: DataFrame, percent: int = 75) -> DataFrame:
    """The rows a, b of pairs whose sets link: 100 * intersection >= percent * union.  pairs is a written table; sets
    that are in none stay out of the exchanges."""
    sets = maybe_in(sets, "s", pairs.select(F.explode(F.array("a", "b")).alias("s")))
    x = sets.select(F.col("s").alias("a"), F.col("shingles").alias("sa"))
    y = sets.select(F.col("s").alias("b"), F.col("shingles").alias("sb"))

    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        serve("jaccard")
        for left, right in parts:
            out = []
            for p, q in zip(left, right):
                p, q = unpack(p), unpack(q)
                both = len(np.intersect1d(p, q, assume_unique=True))
                out.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pd.Series(out, dtype=bool)

    return pairs.join(x, "a").join(y, "b").where(F.pandas_udf(run, "boolean")("sa", "sb")).select("a", "b")


def fitting(k: list[np.ndarray], n: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs i, j sizes and sketches allow to link, and the sketches' distance by the sizes' sum.

    |A xor B| = a + b - 2 * both, and linked sets have both >= percent / (100 + percent) * (a + b).
    """
    total = n[i] + n[j]
    fits = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
    near = np.full(len(i), 2.0)
    words = np.array([len(x) for x in k])
    w = np.minimum(words[i], words[j])
    for size in np.unique(w[fits]):
        at = np.flatnonzero(fits & (w == size))
        used, place = np.unique(np.concatenate([i[at], j[at]]), return_inverse=True)
        m = np.array([folded(k[u], size) for u in used])
        x, y = place[: len(at)], place[len(at) :]
        step = max(1, BLOCK * 8 // int(size))
        for a in range(0, len(at), step):
            far = np.bitwise_count(m[x[a : a + step]] ^ m[y[a : a + step]]).sum(axis=1, dtype=np.int64)
            own = at[a : a + step]
            fits[own] = far * (100 + percent) <= total[own] * (100 - percent)
            near[own] = far / total[own]
    return fits, near


def _sketches(col) -> list[np.ndarray]:
    return [np.frombuffer(b, "<u8") for b in col]


def promising(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """The rows a, b of pairs that sizes and sketches allow to link."""
    x = facts.select(F.col("s").alias("a"), F.struct("n", "sketch").alias("fa"))
    y = facts.select(F.col("s").alias("b"), F.struct("n", "sketch").alias("fb"))

    def run(parts: Iterator[tuple[pd.DataFrame, pd.DataFrame]]) -> Iterator[pd.Series]:
        serve("jaccard")
        for left, right in parts:
            k, at = _sketches([*left["sketch"], *right["sketch"]]), np.arange(len(left))
            yield pd.Series(fitting(k, np.concatenate([left["n"], right["n"]]).astype(np.int64), at, at + len(left), percent)[0], dtype=bool)

    return pairs.join(x, "a").join(y, "b").where(F.pandas_udf(run, "boolean")("fa", "fb")).select("a", "b")


def across(members: DataFrame, facts: DataFrame, percent: int, parts: int, nearest: int | None) -> DataFrame:
    """a, b: all pairs of sets of a run (run, s, label) that have different labels and that sizes and sketches (facts:
    s, n, sketch) allow to link; nearest: of them, each set's so many nearest by sketch.

    A run's members are dealt to blocks of about MEMBERS, and each pair of blocks is a piece of work of its own:
    pieces are dealt to tasks by hash, many to a group, and compared by distance in the piece.  Sketches, which are
    most of the bytes, join last and so travel once with the members."""

    def pairs_of(piece: np.ndarray, label: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of pairs with different labels (and sides, if a piece has two) within pieces (sorted), a block
        at a time."""
        left, gap, held, size = np.arange(len(piece)), 0, [], 0
        while len(left):
            gap += 1
            left = left[left + gap < len(piece)]
            left = left[piece[left] == piece[left + gap]]
            own = left[(label[left] != label[left + gap]) & ((side[left] == 0) | (side[left] != side[left + gap]))]
            held.append((own, own + gap))
            size += len(own)
            if size > BLOCK or not len(left):
                yield tuple(np.concatenate(x) for x in zip(*held))
                held, size = [], 0

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["piece", "label"], ignore_index=True)
        s, n, k = pdf["s"].to_numpy(), pdf["n"].to_numpy(), _sketches(pdf["sketch"])
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for i, j in pairs_of(pdf["piece"].to_numpy(), pdf["label"].to_numpy(), pdf["side"].to_numpy()):
            fits, near = fitting(k, n, i, j, percent)
            i, j, near = i[fits], j[fits], near[fits]
            if nearest:  # of this block; the block's best are the candidates for the group's best
                one, two, far = np.concatenate([s[i], s[j]]), np.concatenate([s[j], s[i]]), np.concatenate([near, near])
                order = np.lexsort((two, far, one))
                one, two = one[order], two[order]
                fresh = np.ones(len(one), bool)
                fresh[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
                one, two = one[fresh], two[fresh]
                starts = runs(one)
                place = np.arange(len(one)) - np.repeat(starts[:-1], np.diff(starts))
                found.append((one[place < nearest], two[place < nearest]))
            else:
                found.append((s[i], s[j]))
            p = np.unique(np.sort(np.stack([np.concatenate(x) for x in zip(*found)], 1), axis=1), axis=0)
            found = [(p[:, 0], p[:, 1])]
        a, b = found[0]
        to = (a.astype(_U) % _U(parts)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        a, b, to = a[order], b[order], to[order]
        r = runs(to)
        return pd.DataFrame([(int(to[x]), a[x:y].tobytes(), b[x:y].tobytes()) for x, y in zip(r, r[1:])], columns=["part", "a", "b"])

    def once(pdf: pd.DataFrame) -> pd.DataFrame:
        p = np.stack([np.frombuffer(b"".join(pdf[c]), np.int64) for c in ("a", "b")], 1)
        p = np.unique(p, axis=0)
        return pd.DataFrame({"a": p[:, 0], "b": p[:, 1]})

    sizes = members.groupBy("run").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("blocks"))
    d = members.join(sizes, "run").withColumn("block", F.pmod(F.xxhash64("s", F.lit(3)), "blocks").cast("int"))
    # a piece for each pair of blocks; side 0: of a block with itself
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    d = d.withColumn("side", F.when(F.col("other") == F.col("block"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2))
    d = d.withColumn("piece", F.xxhash64("run", F.least("block", "other"), F.greatest("block", "other")))
    dealt = d.select("piece", "side", "s", "label", F.pmod("piece", F.lit(parts * GROUPS)).cast("int").alias("part")).join(facts, "s")
    packed = dealt.groupBy("part").applyInPandas(trimmed("jaccard", run), "part int, a binary, b binary")  # pairs meet in many runs
    return packed.groupBy("part").applyInPandas(trimmed("jaccard", once), "a long, b long")


def jaccard_components(docs: DataFrame, doc: str = "doc_id", text: str = "text", percent: int = 75, rows: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs; rows: its row_key, too.  Parts and bands hold for 75
    percent and more."""
    if percent < 75:
        raise ConfigError("links of less than 75 percent can be lost")
    with batches_of(docs.sparkSession, BATCH):
        out = _components(docs, doc, text, percent)
        return out if rows else out.drop("row")


def _components(docs: DataFrame, doc: str, text: str, percent: int) -> DataFrame:
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    base = written(named_sets(docs, doc, text), "jaccard-base")
    open_ = written(sketch_runs(docs, text), "jaccard-runs").withColumn("label", F.col("s")).withColumn("first", F.col("lead"))
    release(spark)
    sets = set_table(docs, base, open_.select("s").distinct(), doc, text)
    release(spark)
    facts = sets.select("s", "n", "sketch")
    labels = None

    def grown(pairs: DataFrame, sketched: bool = False) -> None:
        """Compares pairs (a, b), each given once, and merges the components of those that link; runs of one label are
        out.  sketched: their sketches have been compared."""
        nonlocal labels, open_
        fit = written(pairs if sketched else promising(pairs, facts, percent), "jaccard-fit")
        release(spark)
        links = written(linked(fit, sets, percent), "jaccard-links")
        release(spark)
        labels = merged(labels, links)
        for t in (fit, links):
            forget(spark, t)
        own = labels.select(F.col("node").alias("s"), F.col("label").alias("to"))
        now = open_.select("run", "s", "lead").join(own, "s", "left").select("run", "s", "lead", F.coalesce("to", "s").alias("label"))
        several = now.groupBy("run").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.min_by("label", F.abs(F.col("s") - F.col("lead"))).alias("first")).where("x != y").select("run", "first")
        new = written(now.join(several, "run"), "jaccard-runs")
        forget(spark, open_)
        open_ = new
        release(spark)

    pair = (F.least("s", "lead").alias("a"), F.greatest("s", "lead").alias("b"))
    grown(open_.where("s != lead").groupBy("s").agg(F.min("lead").alias("lead")).select(*pair))
    grown(open_.where("label != first").select(*pair).distinct())
    for nearest in (1, None):  # near copies grow together first; then every pair that is left
        if open_.isEmpty():
            break
        some = open_.where(F.pmod(F.xxhash64("run", F.lit(7)), F.lit(NEAREST_SHARE)) == 0) if nearest else open_
        grown(across(some.select("run", "s", "label"), facts, percent, parts, nearest), sketched=True)
    forget(spark, open_)
    forget(spark, sets)
    classes = base.where("s is not null").groupBy("s").agg(F.min("doc_id").alias("first"))
    classes = written(classes.join(labels.withColumnRenamed("node", "s"), "s", "left").withColumn("label", F.coalesce("label", "s")), "jaccard-classes")
    first = classes.groupBy("label").agg(F.min("first").alias("component_id"))
    named = written(classes.join(first, "label").select("s", "component_id"), "jaccard-components")
    out = written(base.join(named, "s", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "row"), "jaccard-result")
    for t in (labels, classes, named, base):
        forget(spark, t)
    release(spark)
    return out


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT DISTINCT r, g FROM (
    SELECT r, unnest(CASE WHEN len(w) >= 5 THEN list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d)
), n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
p AS (SELECT x.r AS a, y.r AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.r < y.r GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
c AS (SELECT r AS x, r AS y FROM n UNION SELECT c.x, e.b FROM c JOIN e ON c.y = e.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(m, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (r) LEFT JOIN (SELECT c.x AS r, min(o.doc_id) AS m FROM c JOIN d o ON o.r = c.y GROUP BY c.x) USING (r)
"""
