"""N-gram scoring with an Elias-Fano trie in memory-mapped levels.

Level 1 holds the words: their sorted 64-bit hashes, Elias-Fano coded, with their counts and a second hash; a word's id is its
rank. Level 2 holds the bigrams: the ids of the contexts and the pointers to where their successors begin are monotone and
Elias-Fano coded, and the successors of all contexts form one more monotone sequence, each id relative to its context's
base. Each bigram keeps its discounted probability, and each context its back-off weight, in 8 bits. A lookup reads the
pointers of the context and searches the successor of (base + id) between them: a select for the high bits, then a binary
search among the elements that share them.

Two words that share a hash are found by their second hash while the words are counted; the words are then hashed anew with
another seed. A word that only a scored text has and that shares a hash with a known one is told apart in the same way.

Probabilities are absolutely discounted and interpolated: p(w | h) = (c(hw) - D) / c(h) + D T(h) / c(h) p(w), with T(h)
the number of distinct successors and p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)).

Both levels are counted from all training documents: tasks send sorted, packed runs of keys to the shards of the level, a
shard merges its runs and writes one file to the shared folder, and scoring tasks map the files that they need. A word
that makes up more than a shard's share of all tokens has its successors cut into as many shards as it needs.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import map_texts, partitions, shared_path, text_batches, word_hashes

DISCOUNT = 0.75
#: Bytes of text that are worked on together; a longer text is worked on in pieces between words.
PIECE = 1 << 22
#: Bytes of training text for each shard of the words, at most about.
SHARD = 1 << 26
#: The end of a text, as a word's two hashes; no word has white space, so none is meant.
END, END_CHECK = np.uint64(0x9D39247E33776D41), np.uint32(0x1B0CE5A9)
#: Word ids from here on do not fit into one number with another.
NARROW = 1 << 32
_GAP = re.compile(rb"[\t-\r ]")


# ---------------------------------------------------------------- tokens


class Run:
    """Tokens of some texts of a batch, or of a piece of one: `first` is the place of the first text, `bounds` where each text's tokens begin and the last end; `inner` tells that the first text began in the run before."""

    def __init__(self, first: int, hashes: np.ndarray, checks: np.ndarray, bounds: np.ndarray, inner: bool) -> None:
        self.first, self.hashes, self.checks, self.bounds, self.inner = first, hashes, checks, bounds, inner


def _pieces(text: bytes) -> Iterator[bytes]:
    at = 0
    while len(text) - at > PIECE and (gap := _GAP.search(text, at + PIECE)):
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:]


def _run(first: int, parts: list[bytes], seed: int, inner: bool = False, ends: bool = True) -> Run:
    data = b"\n".join(parts) + b"\n"
    h, starts = word_hashes(data, seed)
    check = (word_hashes(data, seed + 1)[0] >> np.uint64(32)).astype(np.uint32)
    bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])]))
    if not ends:
        return Run(first, h, check, bounds, inner)
    n = np.arange(1, len(parts) + 1)
    out, checks = np.full(len(h) + len(parts), END, np.uint64), np.full(len(h) + len(parts), END_CHECK, np.uint32)
    word = np.ones(len(out), bool)
    word[bounds[1:] + n - 1] = False
    out[word], checks[word] = h, check
    return Run(first, out, checks, bounds + np.concatenate([[0], n]), inner)


def tokens(texts: list[str | None], seed: int) -> Iterator[Run]:
    """The tokens of texts, an END after each, in runs of about PIECE bytes."""
    parts, size, first = [], 0, 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "replace")
        if parts and size + len(raw) > PIECE:
            yield _run(first, parts, seed)
            parts, size = [], 0
        if len(raw) > PIECE:
            *some, last = _pieces(raw)
            for k, piece in enumerate(some):
                yield _run(i, [piece], seed, k > 0, False)
            yield _run(i, [last], seed, bool(some))
            continue
        first = first if parts else i
        parts.append(raw)
        size += len(raw) + 1
    if parts:
        yield _run(first, parts, seed)


# ---------------------------------------------------------------- Elias-Fano


class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary, and the ones before each word of the unary part."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray) -> None:
        self.n, self.width, self.low, self.high, self.ones = n, width, low, high, ones

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // n).bit_length() - 1) if n else 0
        bits = np.zeros(((top >> width) + n + 64) // 64 * 64 + 64, bool)
        bits[(values >> np.uint64(width)).astype(np.int64) + np.arange(n)] = True
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])
        packed = []
        for at in range(0, n, 1 << 16):  # pieces of whole words
            part = values[at : at + (1 << 16)]
            packed.append(np.packbits(((part[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little"))
        flat = np.concatenate([*packed, np.zeros(0, np.uint8)])
        low = np.zeros(len(flat) // 8 + 2, np.uint64)
        low.view(np.uint8)[: len(flat)] = flat
        return cls(n, width, low, high, ones)

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Positions of the k-th (from 0) ones or zeros of the unary part."""
        before = self.ones if one else 64 * np.arange(len(self.ones)) - self.ones
        word = np.searchsorted(before, k, "right") - 1
        left = (k - before[word]).astype(np.uint64)
        bits = self.high[word] if one else ~self.high[word]
        at = np.zeros(len(k), np.uint64)
        for step in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count(bits & np.uint64((1 << step) - 1)).astype(np.uint64)
            over = left >= count
            left = np.where(over, left - count, left)
            at = np.where(over, at + np.uint64(step), at)
            bits = np.where(over, bits >> np.uint64(step), bits)
        return 64 * word + at.astype(np.int64)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        bit = i * self.width
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        upper = (self.low[word + 1] << np.uint64(1)) << (np.uint64(63) - shift)
        return ((self.low[word] >> shift) | upper) & np.uint64((1 << self.width) - 1)

    def at(self, i: np.ndarray) -> np.ndarray:
        """Values at positions."""
        i = np.asarray(i, np.int64)
        return ((self._select(i, True) - i).astype(np.uint64) << np.uint64(self.width)) | self._low(i)

    def find(self, x: np.ndarray, begin: np.ndarray | None = None, until: np.ndarray | None = None) -> np.ndarray:
        """Positions of the values x, or -1: the successor of x, if it is x; looked for from begin on, before until."""
        out = np.full(len(x), -1, np.int64)
        if not self.n:
            return out
        high = (x >> np.uint64(self.width)).astype(np.int64)
        inside = np.flatnonzero(high <= int(self.at(np.array([self.n - 1]))[0]) >> self.width)
        high, low = high[inside], x[inside] & np.uint64((1 << self.width) - 1)
        i = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) + 1 - high, 0)
        end = self._select(high, False) - high
        if begin is not None:
            i, end = np.maximum(i, begin[inside]), np.minimum(end, until[inside])
        lo, hi = i, end.copy()
        live = np.flatnonzero(lo < hi)
        while len(live):  # a dense context puts many elements under the same high bits
            mid = (lo[live] + hi[live]) >> 1
            less = self._low(mid) < low[live]
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
            live = live[lo[live] < hi[live]]
        there = np.flatnonzero(lo < end)
        there = there[self._low(lo[there]) == low[there]]
        out[inside[there]] = lo[there]
        return out


# ---------------------------------------------------------------- files of the shared folder


def _write(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """One file of named arrays, each at a multiple of 8 bytes; it appears under its name when it is whole."""
    head, at, body = {}, 0, []
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        head[name] = [str(a.dtype), at, len(a)]
        raw += bytes(-len(raw) % 8)
        body.append(raw)
        at += len(raw)
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    fs, path = pafs.FileSystem.from_uri(uri)
    part = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(len(text).to_bytes(8, "little") + text)
        for raw in body:
            out.write(raw)
    fs.move(part, path)


@lru_cache(maxsize=4096)
def _read(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped; a file of a store that has no local paths is copied to a temporary file first, which goes with the process."""
    fs, path = pafs.FileSystem.from_uri(uri)
    if not isinstance(fs, pafs.LocalFileSystem):
        copy = tempfile.NamedTemporaryFile()
        with fs.open_input_stream(path) as source:
            while data := source.read(1 << 24):
                copy.write(data)
        copy.flush()
        data = np.asarray(np.memmap(copy.name, np.uint8, "r"))
        copy.close()
    else:
        data = np.asarray(np.memmap(path, np.uint8, "r"))
    size = int(data[:8].view(np.uint64)[0])
    out = {}
    for name, (kind, at, n) in json.loads(data[8 : 8 + size].tobytes()).items():
        begin = 8 + size + at
        out[name] = data[begin : begin + n * np.dtype(kind).itemsize].view(kind)
    return out


def _arrays(name: str, ef: EliasFano) -> dict[str, np.ndarray]:
    return {f"{name}.size": np.array([ef.n, ef.width]), f"{name}.low": ef.low, f"{name}.high": ef.high, f"{name}.ones": ef.ones}


def _ef(arrays: dict[str, np.ndarray], name: str) -> EliasFano:
    n, width = arrays[f"{name}.size"]
    return EliasFano(int(n), int(width), arrays[f"{name}.low"], arrays[f"{name}.high"], arrays[f"{name}.ones"])


def _planes(a: np.ndarray) -> bytes:
    return a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()


def _pack(keys: np.ndarray, more: np.ndarray, counts: np.ndarray) -> bytes:
    """Entries in the order of keys, then more, with their counts: differences of the keys, all by byte planes, compressed."""
    gaps = np.concatenate([keys[:1], keys[1:] - keys[:-1]])
    return len(keys).to_bytes(8, "little") + zstandard.compress(b"".join(_planes(x.astype(np.uint64)) for x in (gaps, more, counts)), 1)


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int.from_bytes(raw[:8], "little")
    every = np.frombuffer(zstandard.decompress(raw[8:]), np.uint8).reshape(3, 8, n)
    gaps, more, counts = (np.ascontiguousarray(x.T).view(np.uint64).ravel() for x in every)
    return np.cumsum(gaps, dtype=np.uint64), more, counts


def _sorted_pairs(keys: np.ndarray, more: np.ndarray, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """The order of pairs, and where in it a new pair begins. Pairs of numbers under NARROW are sorted as one number."""
    if wide:
        order = np.lexsort((more, keys))
        keys, more = keys[order], more[order]
        new = (keys[1:] != keys[:-1]) | (more[1:] != more[:-1])
    else:
        both = (keys << np.uint64(32)) | more
        order = np.argsort(both, kind="stable")
        new = both[order][1:] != both[order][:-1]
    return order, np.flatnonzero(np.concatenate([[True], new])) if len(keys) else np.zeros(0, np.int64)


def _merge(runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], wide: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, more, counts = (np.concatenate(x).astype(np.uint64) for x in zip(*runs, strict=True))
    order, first = _sorted_pairs(keys, more, wide)
    return keys[order][first], more[order][first], np.add.reduceat(counts[order], first) if len(keys) else counts


def _counted(keys: np.ndarray, more: np.ndarray, wide: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _merge([(keys, more, np.ones(len(keys), np.uint64))], wide)


def _quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """8-bit codes and their codebook: half of the cells hold equally many values, half are equally wide; a cell stands for its mean."""
    if not len(x):
        return np.zeros(0, np.uint8), np.zeros(1)
    cuts = np.unique(np.concatenate([np.quantile(x, np.linspace(0, 1, 129)), np.linspace(x.min(), x.max(), 128)]))[:-1][-256:]
    code = np.clip(np.searchsorted(cuts, x, "right") - 1, 0, None)
    n = np.bincount(code, minlength=len(cuts))
    return code.astype(np.uint8), np.bincount(code, x, minlength=len(cuts)) / np.maximum(n, 1)


# ---------------------------------------------------------------- the model


class Trie:
    """A model in the shared folder: `head` is what its manifest holds, a few numbers for each shard."""

    def __init__(self, uri: str, head: dict) -> None:
        self.uri, self.head = uri, head
        self.offsets = np.array(head["offsets"], np.int64)  # first id of each word shard, and the number of words
        self.total, self.words, self.docs, self.seed = head["total"], int(self.offsets[-1]), head["docs"], head["seed"]
        self.wide = self.words >= NARROW - 1
        self.shift = np.uint64(head["shift"])
        self.hot = {int(k): tuple(v) for k, v in head["hot"].items()}  # id -> (first part, parts, count)
        self.hot_ids = np.array(sorted(self.hot), np.int64)
        self.successors = {int(k): v for k, v in head.get("successors", {}).items()}

    @property
    def start(self) -> int:
        """The context of a text's first token."""
        return self.words

    def word_file(self, shard: int) -> str:
        return f"{self.uri}/words-{shard}"

    def bigram_file(self, part: int) -> str:
        return f"{self.uri}/bigrams-{part}"

    def ids(self, hashes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of words by their two hashes, the first of them sorted."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        shard = (hashes >> self.shift).astype(np.int64) if self.shift < 64 else np.zeros(len(hashes), np.int64)
        for s in np.unique(shard):
            lo, hi = np.searchsorted(shard, [s, s + 1])
            if self.offsets[s] == self.offsets[s + 1]:
                continue
            level = _read(self.word_file(int(s)))
            low = hashes[lo:hi] & np.uint64((1 << int(self.shift)) - 1) if self.shift < 64 else hashes[lo:hi]
            found = _ef(level, "hash").find(low)
            known = np.flatnonzero(found >= 0)
            known = known[level["check"][found[known]] == checks[lo:hi][known]]
            ids[lo + known] = found[known] + self.offsets[s]
            counts[lo + known] = level["count"][found[known]]
        return ids, counts

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Counts of sorted ids; the start context counts the training texts."""
        out = np.zeros(len(ids), np.int64)
        shard = np.searchsorted(self.offsets, ids, "right") - 1
        for s in np.unique(shard):
            lo, hi = np.searchsorted(shard, [s, s + 1])
            if s == len(self.offsets) - 1:
                out[lo:hi] = self.docs
            else:
                out[lo:hi] = _read(self.word_file(int(s)))["count"][ids[lo:hi] - self.offsets[s]]
        return out

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.5) / (self.total + 0.5 * (self.words + 1))

    def parts(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The shard of each bigram of ids: its context's, or for a hot context the one of the successor's range."""
        out = np.searchsorted(self.offsets, first, "right") - 1
        for h in self.hot_ids:
            begin, n, _ = self.hot[int(h)]
            mine = first == h
            out[mine] = begin + second[mine] * n // max(1, self.words)
        return out

    def conditional(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For pairs (context id, id), sorted by context: the discounted probability and the context's back-off weight."""
        p, back = np.zeros(len(first)), np.ones(len(first))
        part = self.parts(first, second)
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], part[order][1:] != part[order][:-1], [True]])) if len(first) else np.zeros(1, np.int64)
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            mine = order[lo:hi]
            if not self.head["sizes"].get(str(part[mine[0]])):
                continue  # a shard without bigrams
            level = _read(self.bigram_file(int(part[mine[0]])))
            contexts, at = np.unique(first[mine], return_inverse=True)
            rank = _ef(level, "context").find(contexts.astype(np.uint64))
            weight = np.where(rank >= 0, level["back.book"][level["back"][np.maximum(rank, 0)]], 1.0)
            pointer, place = _ef(level, "pointer"), np.maximum(rank, 0)
            begin, until = pointer.at(place).astype(np.int64), pointer.at(place + 1).astype(np.int64)
            known = rank[at] >= 0
            mine, at = mine[known], at[known]
            back[mine] = weight[at]
            x = rank[at].astype(np.uint64) * np.uint64(self.words + 1) + second[mine].astype(np.uint64)
            found = _ef(level, "next").find(x, begin[at], until[at])
            hit = found >= 0
            p[mine[hit]] = 10.0 ** level["prob.book"][level["prob"][found[hit]]]
        for h in self.hot_ids:  # a hot context's successors are counted over all its shards
            mine = first == h
            back[mine] = DISCOUNT * self.successors.get(int(h), 0) / max(1, self.hot[int(h)][2]) if self.successors.get(int(h)) else 1.0
        return p, back


class Reader:
    """Turns runs of one batch into ids; what a run's first token follows is carried on from the run before."""

    def __init__(self, trie: Trie) -> None:
        self.trie, self.last = trie, -1

    def read(self, run: Run) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(context ids, ids, counts) of a run's tokens; -1 where unknown."""
        order = np.argsort(run.hashes, kind="stable")
        h, c = run.hashes[order], run.checks[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])[: len(h)]
        at = np.empty(len(h), np.int64)
        at[order] = np.cumsum(new) - 1
        ids, counts = self.trie.ids(h[new], c[new])
        ids, counts = ids[at], counts[at]
        before = np.concatenate([[self.last], ids[:-1]])[: len(ids)]
        starts = run.bounds[:-1][1 if run.inner else 0 :]
        before[starts[starts < len(ids)]] = self.trie.start
        self.last = ids[-1] if len(ids) else self.last if run.inner else self.trie.start
        return before, ids, counts


def train(docs: DataFrame, uri: str | None = None, shards: int | None = None, seed: int = 1) -> Trie:
    """Count docs (text) and write the model's levels and manifest to uri, in the shared folder unless given.

    shards: of the words, a power of two; by default as many as there are shuffle partitions, and so many that no shard counts
    more than about SHARD bytes of text: a shard's runs are merged in one group. An empty table gives a
    model without words. Where two words share the hash of a seed the next seed is tried.
    """
    spark = docs.sparkSession
    uri = uri or shared_path(spark, "ngram")
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path, recursive=True)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = shards or 1 << max(0, (max(partitions(spark), -(-size // SHARD)) - 1).bit_length())
    shift = 64 - (shards.bit_length() - 1)
    docs = docs.select("text")
    text_batches(spark)

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            runs = [_counted(r.hashes, r.checks, True) for r in tokens(batch["text"].tolist(), seed)]
            if runs:
                keys, checks, counts = _merge(runs, True)
                shard = (keys >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(keys), np.int64)
                cuts = np.searchsorted(shard, np.arange(shards + 1))
                yield pd.DataFrame([(s, len(batch) if s == 0 else 0, _pack(keys[a:b], checks[a:b], counts[a:b])) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a or s == 0], columns=["shard", "docs", "run"])

    def write_words(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        keys, checks, counts = _merge([_unpack(x) for x in rows["run"]], True)
        low = keys & np.uint64((1 << shift) - 1) if shift < 64 else keys
        _write(f"{uri}/words-{key[0]}", {**_arrays("hash", EliasFano.build(low)), "count": counts.astype(np.int64), "check": checks.astype(np.uint32)})
        hot = np.flatnonzero(counts > counts.sum() / shards) if shards > 1 else np.zeros(0, np.int64)
        return pd.DataFrame([(key[0], int(rows["docs"].sum()), len(keys), int((keys[1:] == keys[:-1]).sum()), int(counts.sum()), hot.tolist(), counts[hot].tolist())], columns=["shard", "docs", "words", "shared", "total", "hot", "hot_count"])

    level1 = docs.mapInPandas(words, "shard int, docs long, run binary").groupBy("shard").applyInPandas(write_words, "shard int, docs long, words long, shared long, total long, hot array<long>, hot_count array<long>").collect()
    if any(r["shared"] for r in level1):
        return train(docs, uri, shards, seed + 2)
    sizes = np.zeros(shards, np.int64)
    for r in level1:
        sizes[r["shard"]] = r["words"]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    total, n_docs = sum(r["total"] for r in level1), sum(r["docs"] for r in level1)
    share = max(1, total // shards)
    hot = {int(offsets[-1]): (shards, 1 + n_docs // share, n_docs)}  # the start of a text
    at = shards + hot[int(offsets[-1])][1]
    for r in level1:  # no more than `shards` words have more than their share
        for i, c in zip(r["hot"], r["hot_count"], strict=True):
            if c > share:
                hot[int(offsets[r["shard"]] + i)] = (at, 1 + c // share, c)
                at += 1 + c // share
    head = {"offsets": offsets.tolist(), "total": total, "docs": n_docs, "shift": shift, "seed": seed, "hot": {str(k): v for k, v in hot.items()}, "sizes": {}, "successors": {}}
    trie = Trie(uri, head)

    def bigrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            reader = Reader(trie)
            runs = []
            for r in tokens(batch["text"].tolist(), trie.seed):
                first, second, _ = reader.read(r)
                runs.append(_counted(first.astype(np.uint64), second.astype(np.uint64), trie.wide))
            if runs:
                first, second, counts = _merge(runs, trie.wide)
                part = trie.parts(first.astype(np.int64), second.astype(np.int64))
                order = np.argsort(part, kind="stable")
                first, second, counts, part = first[order], second[order], counts[order], part[order]
                cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
                yield pd.DataFrame([(int(part[a]), _pack(first[a:b], second[a:b], counts[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], columns=["part", "run"])

    def write_bigrams(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        first, second, counts = _merge([_unpack(x) for x in rows["run"]], trie.wide)
        first = first.astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
        contexts, n = first[starts], np.diff(np.concatenate([starts, [len(first)]]))
        seen = trie.counts(contexts)
        rank = np.repeat(np.arange(len(contexts)), n)
        prob, prob_book = _quantise(np.log10(np.maximum(counts - DISCOUNT, 1e-9) / seen[rank]))
        back, back_book = _quantise(DISCOUNT * n / seen)
        relative = rank.astype(np.uint64) * np.uint64(trie.words + 1) + second
        arrays = {**_arrays("context", EliasFano.build(contexts)), **_arrays("pointer", EliasFano.build(np.concatenate([starts, [len(first)]]))), **_arrays("next", EliasFano.build(relative))}
        _write(trie.bigram_file(key[0]), {**arrays, "prob": prob, "prob.book": prob_book, "back": back, "back.book": back_book})
        return pd.DataFrame([(key[0], len(first), int(contexts[0]) if len(contexts) == 1 else -1)], columns=["part", "bigrams", "only"])

    level2 = docs.mapInPandas(bigrams, "part int, run binary").groupBy("part").applyInPandas(write_bigrams, "part int, bigrams long, only long").collect()
    for r in level2:
        head["sizes"][str(r["part"])] = r["bigrams"]
        if r["part"] >= shards:
            head["successors"][str(r["only"])] = head["successors"].get(str(r["only"]), 0) + r["bigrams"]
    with fs.open_output_stream(f"{path}/manifest") as out:
        out.write(json.dumps(head).encode())
    return Trie(uri, head)


def load(uri: str) -> Trie:
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_stream(f"{path}/manifest") as source:
        return Trie(uri, json.loads(source.read()))


def score(docs: DataFrame, trie: Trie) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of each row of docs (doc_id, text), in log10.

    Null texts are empty: their one token is the end. Repeated rows each give a row, an empty table gives none, other
    columns are ignored. With a model without words every token has the probability of an unknown one.
    """

    def make():
        def values(texts: list[str | None]) -> dict:
            reader = Reader(trie)
            sums = {k: np.zeros(len(texts)) for k in ("n_tokens", "n_known", "base_score", "score")}
            for r in tokens(texts, trie.seed):
                before, ids, counts = reader.read(r)
                single = trie.unigram(counts)
                p = single.copy()
                # after a known context: its successor's probability, if it is one, and the rest by the word's own
                known = np.flatnonzero(before >= 0)
                first, second = before[known].astype(np.uint64), np.where(ids[known] >= 0, ids[known], trie.words + 1).astype(np.uint64)
                order, new = _sorted_pairs(first, second, trie.wide)
                at = np.empty(len(order), np.int64)
                at[order] = np.cumsum(np.isin(np.arange(len(order)), new, assume_unique=True)) - 1
                given, back = trie.conditional(first[order][new].astype(np.int64), second[order][new].astype(np.int64))
                p[known] = given[at] + back[at] * single[known]
                doc = r.first + np.repeat(np.arange(len(r.bounds) - 1), np.diff(r.bounds))
                for name, x in (("n_tokens", np.ones(len(p))), ("n_known", counts > 0), ("base_score", np.log10(single)), ("score", np.log10(p))):
                    sums[name] += np.bincount(doc, x, minlength=len(texts))
            return sums | {k: sums[k].astype(np.int64) for k in ("n_tokens", "n_known")}

        return values

    return map_texts(docs, "text", make, "n_tokens long, n_known long, base_score double, score double", ["doc_id"])


def held_out(doc_id):
    """Whether a document is kept from training: crc32 of its id as text, modulo 5, is 1; a null id is the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1


def train_and_score(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out and score all: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    trie = train(docs.where(~held_out(F.col("doc_id"))))
    scored = score(docs, trie)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(trie.total).cast("long").alias("train_tokens"), "base_score", "score")


def remove(spark: SparkSession, trie: Trie) -> None:
    """Delete a model's files."""
    fs, path = pafs.FileSystem.from_uri(trie.uri)
    if fs.get_file_info(path).type != pafs.FileType.NotFound:
        fs.delete_dir(path)
    _read.cache_clear()
