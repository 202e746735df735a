"""Byte-level BPE with a lexicon automaton.

The words of the whole corpus are counted; the most frequent ones and their ids are compiled into a minimal
acyclic transducer (equal suffixes share states; the outputs along a path add up to the word's number, which
points into one array of ids).  Its bytes are sent to the workers, which map them into memory.  A word that
the automaton lacks is merged pair by pair, lowest rank first, which gives the same ids.

Texts are cut at every space before a visible character, which is always a border of the pre-tokenizer's
pieces, so what was encoded once per such chunk serves all its occurrences in a worker, and what was encoded per
piece serves all chunks that hold it.  The memos of a worker are emptied when they are full; this changes no result.

Defined results: null and empty texts have no ids; special tokens in a text get their ids; repeated rows are
encoded each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import re
import struct
import tempfile
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .memos import keeps, serve

#: Most words in the automaton, and the least count of a word to be compiled.  Bounds what is sent to workers.
LEXICON_WORDS = 1 << 15
LEXICON_LEAST = 8
LEXICON_BYTES = 64
#: Entries of a worker's memo.
MEMO = 600_000
#: Arcs of the automaton that a worker keeps at hand.
ARCS = 1 << 17

# Fixed value: the pre-tokenizer's pattern.
PIECES = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: The same for ASCII, where it is faster.
PLAIN = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+""", re.ASCII)
#: Characters on whose class every Unicode version since 2014 agrees; texts with others are cut by the library itself.
UNSURE = re.compile("[^\x00-ԯ؀-؅ऀ-॔‐- ‰-⁞₠-₹←-⏳─-➿、-〩ぁ-ゖァ-ヺ一-鿌가-힣！-～]")
#: A space that may not be a border.
LOOSE = re.compile(" (?![!-~¡-ʯΑ-ώА-я一-鿌])")
#: Above every rank.
NONE = 1 << 60
BORDER = regex.compile(r" (?=\S)")


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 bytes for
    themselves, the others as the characters from U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in own}
    out.update({chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in own)})
    return out


# ---- the automaton ----------------------------------------------------------------------------------


def compile_lexicon(words: list[tuple[bytes, list[int]]]) -> bytes:
    """words, sorted by bytes and distinct, with their ids -> the automaton as bytes.

    Built word by word: the states of the last word that the next one leaves behind are frozen, and a frozen
    state equal to an earlier one (same finality, same labels, same targets) is replaced by it.  Afterwards
    each arc's output is the number of words that sort before those it leads to.
    """
    frozen: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in frozen:
            frozen[key] = len(states)
            states.append(key)
        return frozen[key]

    path: list[list] = [[False, []]]  # open states of the last word: final, arcs
    last = b""
    for word, _ in words:
        same = 0
        while same < min(len(last), len(word)) and last[same] == word[same]:
            same += 1
        for k in range(len(last), same, -1):
            path[k - 1][1].append((last[k - 1], freeze(path[k])))
        del path[same + 1 :]
        path.extend([False, []] for _ in word[same:])
        path[-1][0] = True
        last = word
    for k in range(len(last), 0, -1):
        path[k - 1][1].append((last[k - 1], freeze(path[k])))
    root = freeze(path[0])
    reach = [0] * len(states)
    offsets, labels, targets, outputs, final = array("I", [0]), bytearray(), array("I"), array("I"), bytearray()
    for k, (is_final, arcs) in enumerate(states):  # targets come before the states that lead to them
        seen = int(is_final)
        for label, to in arcs:
            labels.append(label)
            targets.append(to)
            outputs.append(seen)
            seen += reach[to]
        reach[k] = seen
        final.append(is_final)
        offsets.append(len(labels))
    starts, ids = array("I", [0]), array("I")
    for _, own in words:
        ids.extend(own)
        starts.append(len(ids))
    parts = [offsets.tobytes(), targets.tobytes(), outputs.tobytes(), starts.tobytes(), ids.tobytes(), bytes(labels), bytes(final)]
    return struct.pack("<8I", root, *map(len, parts)) + b"".join(parts)


class Lexicon:
    """Looks words up in a compiled automaton that is mapped into memory."""

    def __init__(self, data: bytes):
        with tempfile.TemporaryFile() as f:  # this worker's own copy; it has no name and goes with the worker
            f.write(data)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        view, at = memoryview(self.map), 32
        self.root, *sizes = struct.unpack_from("<8I", self.map)
        parts = []
        for n in sizes:
            parts.append((at, view[at : at + n]))
            at += n
        self.offsets, self.targets, self.outputs, self.starts, self.ids = (p.cast("I") for _, p in parts[:5])
        self.labels, self.final = parts[5][0], parts[6][1]
        self.known: dict[int, int] = {}  # state << 8 | label: target << 32 | output, or -1

    def _arc(self, state: int, label: int) -> int:
        """The target and the output of a state's arc, or -1."""
        arc = self.map.find(bytes([label]), self.labels + self.offsets[state], self.labels + self.offsets[state + 1]) - self.labels
        return -1 if arc < 0 else self.targets[arc] << 32 | self.outputs[arc]

    def find(self, word: bytes) -> bytes | None:
        """The ids of word as little-endian 32-bit numbers, or None."""
        state, number, known = self.root, 0, self.known
        if len(known) > ARCS:
            known.clear()
        for b in word:
            arc = known.get(state << 8 | b)
            if arc is None:
                arc = known[state << 8 | b] = self._arc(state, b)
            if arc < 0:
                return None
            number += arc & 0xFFFFFFFF
            state = arc >> 32
        if not self.final[state]:
            return None
        return self.ids[self.starts[number] : self.starts[number + 1]].tobytes()


# ---- merging ----------------------------------------------------------------------------------------


class Vocabulary:
    """tokens[id]: bytes; singles[byte]: id; merges: pairs of ids; special: content -> id."""

    def __init__(self, text: str):
        d = json.loads(text)
        m, alphabet = d["model"], byte_alphabet()
        vocab = m["vocab"]
        self.text = text
        self.special = {t["content"]: t["id"] for t in d.get("added_tokens", [])}
        self.tokens: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for t, i in vocab.items():
            self.tokens[i] = t.encode() if t in self.special else bytes(alphabet[c] for c in t)
        for t, i in self.special.items():
            self.tokens[i] = t.encode()
        singles = {t: i for i, t in enumerate(self.tokens) if len(t) == 1}
        self.singles = [singles[bytes([b])] for b in range(256)]
        pairs = (p if isinstance(p, list) else p.split(" ") for p in m["merges"])
        #: left id << 20 | right id -> rank << 20 | merged id
        self.merges = {vocab[a] << 20 | vocab[b]: rank << 20 | vocab[a + b] for rank, (a, b) in enumerate(pairs)}

    def merge(self, word: bytes) -> list[int]:
        """The ids of one piece: the pair of lowest rank is merged first, the leftmost of equals."""
        ids = [self.singles[b] for b in word]
        if len(ids) > 48:
            return self._merge_long(ids)
        get = self.merges.get
        best = [get(a << 20 | b, NONE) for a, b in zip(ids, ids[1:])]
        while best and (m := min(best)) != NONE:
            k = best.index(m)
            ids[k : k + 2] = [m & 0xFFFFF]
            del best[k]
            if k:
                best[k - 1] = get(ids[k - 1] << 20 | ids[k], NONE)
            if k < len(best):
                best[k] = get(ids[k] << 20 | ids[k + 1], NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a linked list and a heap, for pieces of any length."""
        n, get = len(ids), self.merges.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(m >> 20, k, ids[k], ids[k + 1], m & 0xFFFFF) for k in range(n - 1) if (m := get(ids[k] << 20 | ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, a, b, new = heapq.heappop(heap)
            j = after[k]
            if ids[k] != a or j < 0 or ids[j] != b:
                continue
            ids[k], ids[j], after[k] = new, -1, after[j]
            if after[k] >= 0:
                before[after[k]] = k
                if (m := get(new << 20 | ids[after[k]])) is not None:
                    heapq.heappush(heap, (m >> 20, k, new, ids[after[k]], m & 0xFFFFF))
            if (p := before[k]) >= 0 and (m := get(ids[p] << 20 | new)) is not None:
                heapq.heappush(heap, (m >> 20, p, ids[p], new, m & 0xFFFFF))
        return [i for i in ids if i >= 0]


# ---- encoding ---------------------------------------------------------------------------------------


class Encoder:
    def __init__(self, vocabulary: Vocabulary, lexicon: bytes | None = None, memo: int = MEMO):
        self.v, self.most = vocabulary, memo
        self.lexicon = Lexicon(lexicon) if lexicon else None
        self.chunk_ids: dict[str, bytes] = {}  # of a space and the chunk
        self.piece_ids: dict[str, bytes] = {}  # of pieces of longer chunks
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.v.special, key=len, reverse=True))) + ")") if self.v.special else None
        self._library = None

    def pieces(self, text: str) -> list[str]:
        if UNSURE.search(text):
            if self._library is None:
                from tokenizers import Tokenizer

                self._library = Tokenizer.from_str(self.v.text).pre_tokenizer
            return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]
        return PIECES.findall(text)

    def piece(self, piece: str) -> bytes:
        word = piece.encode()
        return self.lexicon and self.lexicon.find(word) or array("I", self.v.merge(word)).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """The ids of a space and a chunk without characters of UNSURE.  A space and letters are a piece, and so a
        chunk that the memo of chunks may know as well."""
        if chunk.isalpha():
            return self.piece(" " + chunk)
        out = []
        for p in (PLAIN if chunk.isascii() else PIECES).findall(" " + chunk):
            ids = self.piece_ids.get(p)
            if ids is None and p[0] == " " and p[1:2].isalpha():
                ids = self.chunk_ids.get(p[1:])
            if ids is None:
                ids = self.piece_ids[p] = self.piece(p)
            out.append(ids)
        return b"".join(out)

    def _plain(self, text: str) -> bytes:
        """The ids of a text without special tokens."""
        if UNSURE.search(text):
            return b"".join(map(self.piece, self.pieces(text)))
        chunks = BORDER.split(text) if LOOSE.search(text) else text.split(" ")
        out = [b"".join(map(self.piece, PIECES.findall(chunks[0])))]
        memo = self.chunk_ids
        if len(memo) > self.most:
            memo.clear()
        if len(self.piece_ids) > self.most // 4:
            self.piece_ids.clear()
        for c in chunks[1:]:
            ids = memo.get(c)
            if ids is None:
                ids = memo[c] = self._chunk(c)
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if self.specials and any(s in text for s in self.v.special):
            return b"".join(struct.pack("<I", self.v.special[p]) if k % 2 else self._plain(p) for k, p in enumerate(self.specials.split(text)) if p)
        return self._plain(text)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.v.tokens.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


_ready: dict = {}
keeps("bpe", _ready.clear)


def _encoder(name: str, sent) -> Encoder:
    """This worker's encoder for a broadcast (vocabulary file, automaton); its memo outlives a task."""
    serve("bpe")
    if _ready.get("name") != name:
        _ready.update(name=name, encoder=Encoder(Vocabulary(sent.value[0]), sent.value[1]))
    return _ready["encoder"]


def piece_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """piece, n: how often each piece of the pre-tokenizer that is a word occurs in all texts.  Counted by
    batch first, then summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chunks: Counter = Counter()
            for t in b.column(0):
                if s := t.as_py():
                    chunks.update(s.split(" ")[1:])
            found: Counter = Counter()
            for c, n in chunks.items():
                if len(c) <= LEXICON_BYTES and (m := PIECES.match(" " + c)):
                    found[m.group()] += n
            yield pa.RecordBatch.from_pydict({"piece": list(found), "n": list(found.values())}, schema=pa.schema([("piece", pa.string()), ("n", pa.int64())]))

    return docs.select(text).where(F.col(text).isNotNull()).mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def frequent_lexicon(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", words: int = LEXICON_WORDS, least: int = LEXICON_LEAST) -> bytes:
    """The automaton of the most frequent words of docs, at most `words` of them.

    A histogram of the counts' logarithms says from which count on there are no more than that; only those words
    are sent to the driver.
    """
    counts = written(piece_counts(docs, text).where(F.col("n") >= least).withColumn("grade", F.floor(F.log2("n") * 32).cast("int")), "bpe-counts")
    total, grade = 0, None
    for g, n in sorted(((r["grade"], r["count"]) for r in counts.groupBy("grade").count().collect()), reverse=True):  # some hundred grades
        total += n
        if total > words:
            break
        grade = g
    top = counts.where(F.col("grade") >= grade).select("piece").collect() if grade is not None else []
    e = Encoder(vocabulary)
    found = sorted({r[0].encode(): r[0] for r in top}.items())
    return compile_lexicon([(w, vocabulary.merge(w)) for w, p in found if len(e.pieces(p)) == 1])


def encode(docs: DataFrame, path: str, keys: tuple[str, ...] = ("doc_id",), text: str = "text", digest: bool = False) -> DataFrame:
    """keys, ids (array of long; with digest: n_tokens, ids_sha256, decoded_sha256 instead).  path: the
    vocabulary file, read on the driver and sent to the workers with the automaton."""
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as f:
        content = f.read()
    lexicon = frequent_lexicon(docs, Vocabulary(content), text)
    sent, name = spark.sparkContext.broadcast((content, lexicon)), uuid.uuid4().hex
    d = docs.select(*keys, F.col(text).alias("__text"))
    own = d.drop("__text").schema
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(name, sent)
        for b in batches:
            cols = [b.column(k) for k in range(b.num_columns - 1)]
            if digest:
                n, a, z = [], [], []
                for t in b.column(b.num_columns - 1):
                    ids = e.encode(t.as_py())
                    n.append(len(ids) // 4)
                    a.append(hashlib.sha256(ids).hexdigest())
                    z.append(hashlib.sha256(e.decode(ids).encode("utf-8")).hexdigest())
                new = [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(z, pa.string())]
                names = ["n_tokens", "ids_sha256", "decoded_sha256"]
            else:
                new = [pa.array([list(memoryview(e.encode(t.as_py())).cast("I")) for t in b.column(b.num_columns - 1)], pa.list_(pa.int64()))]
                names = ["ids"]
            yield pa.RecordBatch.from_arrays(cols + new, names=[f.name for f in own] + names)

    out = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids array<bigint>"
    return d.mapInArrow(run, f"{kinds}, {out}" if kinds else out)


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Replaces ids by decoded (string; null for null ids)."""
    with open(path, encoding="utf-8") as f:
        sent = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        v = Vocabulary(sent.value)
        for s in parts:
            yield pd.Series([None if x is None else b"".join(v.tokens[int(i)] for i in x).decode("utf-8", "replace") for x in s], dtype=object)

    return encoded.withColumn("decoded", F.pandas_udf(run, "string")(F.col(ids))).drop(ids)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), default_path(), digest=True)
