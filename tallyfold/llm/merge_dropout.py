"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

The vocabulary is that of a SentencePiece BPE model file. A text gets a leading space, spaces become
the word mark, and starting from single characters the adjacent pair whose union has the best score
is merged, leftmost first, until no pair is left. With dropout, a pair that comes to the top of the
agenda is thrown away when a keyed hash of (seed, document, start, middle, end) falls under the rate.
A discarded pair does not come back, so the same document, seed and rate always give the same pieces,
and other seeds give other segmentations. Characters outside the vocabulary become UTF-8 byte pieces.

One step handles the top pair of every word of a block at once with numpy; words longer than
``LONG_WORD`` characters (tables of digits, base64) go through a heap, which has the same order.

Cases: null text is the empty text; the empty text has no pieces and decodes to the empty text; a word
mark inside a text is kept as bytes; white space, control characters and line ends are kept; equal
documents with different ids get different pieces when the rate is above 0; an empty table gives no rows; extra columns are ignored
by ``round_trip`` and kept by ``encode_column``.
"""

from __future__ import annotations

import functools
import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.llm.common import shipped, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
LONG_WORD = 40
BLOCK_CHARS = 1 << 19
NONE = np.int32(2**30)
_MASK = (1 << 64) - 1
_K = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93]


def keyed_hash(key, start, middle, end):
    """64-bit hash of a candidate merge; arguments are uint64 arrays or ints below 2**64."""
    if isinstance(key, np.ndarray):
        with np.errstate(over="ignore"):
            h = key + start * np.uint64(_K[0]) ^ middle * np.uint64(_K[1]) ^ end * np.uint64(_K[2])
            h = (h ^ (h >> np.uint64(31))) * np.uint64(_K[3])
            return (h ^ (h >> np.uint64(29))) * np.uint64(_K[0])
    h = (key + start * _K[0] & _MASK) ^ (middle * _K[1] & _MASK) ^ (end * _K[2] & _MASK)
    h = (h ^ (h >> 31)) * _K[3] & _MASK
    return (h ^ (h >> 29)) * _K[0] & _MASK


class Vocabulary:
    """Pieces of a model by merge rank (0 is merged first), and the table of pairs that merge."""

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        normal.sort(key=lambda i: (-sp.get_score(i), i))
        self.id_of_rank = np.array(normal, np.int32)
        rank = {self.pieces[i]: r for r, i in enumerate(normal)}
        self.byte_id = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        byte_of = {int(i): b for b, i in enumerate(self.byte_id)}
        #: What each id adds to the decoded text, as UTF-8.
        self.as_bytes = [bytes([byte_of[i]]) if i in byte_of else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.rank_of_char = np.full(0x110000, -1, np.int32)
        for p, r in rank.items():
            if len(p) == 1:
                self.rank_of_char[ord(" " if p == MARK else p)] = r
        self.rank_of_char[ord(MARK)] = -1
        self.splits_at_space = not any(MARK in p.lstrip(MARK) for p in rank)
        pairs = {}
        for p, r in rank.items():
            for k in range(1, len(p)):
                a, b = rank.get(p[:k]), rank.get(p[k:])
                if a is not None and b is not None:
                    pairs[a << 15 | b] = r
        self.pairs = pairs
        self._table(pairs)

    def _table(self, pairs: dict[int, int]) -> None:
        """Open addressing, so that numpy can look up many pairs at once."""
        self.bits = max(12, (len(pairs) * 5).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.full(size + 64, -1, np.int32), np.full(size + 64, NONE, np.int32)
        self.probes = 1
        for key, value in pairs.items():
            at = (key * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - self.bits)
            k = 0
            while self.keys[at + k] != -1:
                k += 1
            self.keys[at + k], self.values[at + k] = key, value
            self.probes = max(self.probes, k + 1)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the union of two pieces; NONE where the vocabulary lacks it or a side is unknown."""
        key = (left << 15) | right
        at = ((key.astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)).astype(np.int32)
        found = self.keys[at]
        out = np.where(found == key, self.values[at], NONE)
        rest = np.flatnonzero((found != key) & (found != -1))
        for k in range(1, self.probes):
            if not len(rest):
                break
            there = self.keys[at[rest] + k]
            hit = there == key[rest]
            out[rest[hit]] = self.values[at[rest[hit]] + k]
            rest = rest[~hit & (there != -1)]
        out[(left | right) < 0] = NONE
        return out


@functools.lru_cache(maxsize=2)
def vocabulary(model: str) -> Vocabulary:
    return Vocabulary(model)


def _heap_merge(v: Vocabulary, ranks: list[int], base: int, key: int, limit: int) -> list[tuple[int, int]]:
    """(rank, position) of the pieces of one word by an agenda of pairs; ``base`` is the word's start."""
    n = len(ranks)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    agenda: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and ranks[i] >= 0 and ranks[j] >= 0 and (r := v.pairs.get(ranks[i] << 15 | ranks[j])) is not None:
            heapq.heappush(agenda, (r, i, j, after[j]))

    for i in range(n - 1):
        offer(i)
    while agenda:
        r, i, j, end = heapq.heappop(agenda)
        if not (alive[i] and j < n and alive[j] and after[i] == j and after[j] == end):
            continue
        if limit and keyed_hash(key, base + i, base + j, base + end) >> 11 < limit:
            continue
        ranks[i], alive[j], after[i] = r, False, end
        if end < n:
            before[end] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append((ranks[i], i))
        i = after[i]
    return out


def _merge_block(v: Vocabulary, code: np.ndarray, doc_start: np.ndarray, keys: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Start positions and ranks (-1: unknown character) of all pieces of a block of documents."""
    n = len(code)
    ranks = v.rank_of_char[code]
    first = np.zeros(n, bool)
    first[doc_start] = True
    doc = np.cumsum(first, dtype=np.int32) - 1
    if v.splits_at_space:
        space = code == 32
        first[1:] |= space[1:] & ~space[:-1]
    out = np.full(n, -2, np.int32)
    begin = np.flatnonzero(first)
    length = np.diff(np.append(begin, n))
    for k in np.flatnonzero(length > LONG_WORD):
        b, e = int(begin[k]), int(begin[k] + length[k])
        d = int(doc[b])
        for r, i in _heap_merge(v, ranks[b:e].tolist(), b - int(doc_start[d]), int(keys[d]), limit):
            out[b + i] = r
    short = length <= LONG_WORD
    sym, pos = ranks, np.arange(n, dtype=np.int32)
    if not short.all():
        keep = np.repeat(short, length)
        sym, pos, begin, length = sym[keep], pos[keep], begin[short], length[short]
    if not len(sym):
        return np.flatnonzero(out != -2), out[out != -2]
    length = length.astype(np.int32)
    word = np.repeat(np.arange(len(length), dtype=np.int32), length)
    pair = np.full(len(sym), NONE, np.int32)
    pair[:-1] = v.merged(sym[:-1], sym[1:])
    pair[np.cumsum(length) - 1] = NONE
    while len(sym):
        start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        best = np.minimum.reduceat(pair, start)
        size = np.diff(np.append(start, len(sym)))
        if not (active := best < NONE).all():
            keep = np.repeat(active, size)
            done = ~keep
            out[pos[done]] = sym[done]
            sym, pos, word, pair, best, size = sym[keep], pos[keep], word[keep], pair[keep], best[active], size[active]
            if not len(sym):
                break
        at = np.flatnonzero(pair == np.repeat(best, size))
        w = word[at]
        at = at[np.append(True, w[1:] != w[:-1])]
        m = len(sym)
        if limit:
            begin_, middle = pos[at], pos[at + 1]
            nxt = np.minimum(at + 2, m - 1)
            # the second piece ends where the next one of its word starts; at a word's end its length comes from its rank
            end = np.where((at + 2 < m) & (word[nxt] == word[at]), pos[nxt], middle + v.rank_length[np.maximum(sym[at + 1], 0)])
            base = doc_start[doc[begin_]]
            h = keyed_hash(keys[doc[begin_]], (begin_ - base).astype(np.uint64), (middle - base).astype(np.uint64), (end - base).astype(np.uint64))
            skipped = (h >> np.uint64(11)) < np.uint64(limit)
            pair[at[skipped]] = NONE
            at = at[~skipped]
            if not len(at):
                continue
        sym[at] = pair[at]
        keep = np.ones(m, bool)
        keep[at + 1] = False
        shift = np.cumsum(keep, dtype=np.int32) - 1
        sym, pos, word, pair = sym[keep], pos[keep], word[keep], pair[keep]
        at = shift[at]
        m = len(sym)
        nxt = np.minimum(at + 1, m - 1)
        pair[at] = np.where((nxt > at) & (word[nxt] == word[at]), v.merged(sym[at], sym[nxt]), NONE)
        left = at - 1
        left = left[(left >= 0) & (word[np.maximum(left, 0)] == word[at])]
        pair[left] = v.merged(sym[left], sym[left + 1])
    got = np.flatnonzero(out != -2)
    return got, out[got]


def encode(texts: list[str], keys: np.ndarray, model: str = MODEL, rate: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts, one after the other, and where each text's ids start (one entry more)."""
    v = vocabulary(model)
    if not hasattr(v, "rank_length"):
        v.rank_length = np.array([len(v.pieces[i]) for i in v.id_of_rank], np.int32)
    limit = int(rate * (1 << 53))
    ids, sizes = [], []
    i = 0
    while i < len(texts):
        j, chars = i, 0
        while j < len(texts) and (j == i or chars + len(texts[j]) < BLOCK_CHARS):
            chars += len(texts[j])
            j += 1
        block = [" " + t if t else "" for t in texts[i:j]]
        lengths = np.array([len(t) for t in block])
        full = lengths > 0
        count = np.zeros(j - i, np.int64)
        if full.any():
            code = np.frombuffer("".join(block).encode("utf-32-le", "surrogatepass"), np.uint32)
            starts = np.cumsum(lengths[full]) - lengths[full]
            at, rank = _merge_block(v, code, starts, keys[i:j][full], limit)
            piece = v.id_of_rank[np.maximum(rank, 0)]
            unknown = np.flatnonzero(rank < 0)
            owner = np.searchsorted(starts, at, "right") - 1
            if len(unknown):
                raw = [chr(c).encode("utf-8", "surrogatepass") for c in code[at[unknown]].tolist()]
                width = np.ones(len(at), np.int64)
                width[unknown] = [len(b) for b in raw]
                piece, owner = np.repeat(piece, width), np.repeat(owner, width)
                first = np.cumsum(width) - width
                every = np.repeat(first[unknown], width[unknown]) + np.concatenate([np.arange(len(b)) for b in raw])
                piece[every] = v.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
            count[full] = np.bincount(owner, minlength=int(full.sum()))
            ids.append(piece)
        sizes.append(count)
        i = j
    sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    return (np.concatenate(ids) if ids else np.zeros(0, np.int32)), np.append(0, np.cumsum(sizes))


def decode(ids, model: str = MODEL) -> str:
    """The text of a list of piece ids."""
    as_bytes = vocabulary(model).as_bytes
    return b"".join([as_bytes[i] for i in ids])[1:].decode("utf-8", "surrogatepass")


def document_keys(ids: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = ids.astype(np.int64).astype(np.uint64) * np.uint64(_K[1]) + np.uint64(seed % (1 << 64)) * np.uint64(_K[2])
        return (h ^ (h >> np.uint64(32))) * np.uint64(_K[3])


def id_numbers(ids: pa.Array) -> np.ndarray:
    """A whole number for each id: itself, 0 for null; a hash for ids that are no whole numbers."""
    if pa.types.is_integer(ids.type):
        return pc.fill_null(ids.cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
    return np.array([0 if x is None else xxhash.xxh64_intdigest(str(x)) for x in ids.to_pylist()], np.uint64).view(np.int64)


def _batches(batches, seed: int, rate: float, local, check: bool):
    model = local()
    for batch in slices(batches, 1):
        ids = id_numbers(batch.column(0))
        texts = [t or "" for t in batch.column(1).to_pylist()]
        pieces, starts = encode(texts, document_keys(ids, seed), model, rate)
        lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(pieces, pa.int32()))
        columns = [batch.column(0), lists]
        if check:
            columns.append(pa.array([decode(pieces[a:b].tolist(), model) == t for a, b, t in zip(starts[:-1].tolist(), starts[1:].tolist(), texts)]))
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "pieces", "lossless"][: len(columns)])


def round_trip(docs: DataFrame, seed: int = 7, rate: float = 0.1, model: str = MODEL) -> DataFrame:
    """(doc_id, pieces, lossless): pieces of each text, and whether decoding them gives the text back."""
    local = shipped(docs.sparkSession, model)
    return docs.select("doc_id", "text").mapInArrow(lambda b: _batches(b, seed, rate, local, True), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, pieces array<int>, lossless boolean")


def encode_column(docs: DataFrame, seed: int = 7, rate: float = 0.1, model: str = MODEL, out: str = "pieces") -> DataFrame:
    """``docs`` with the piece ids of ``text`` in column ``out``."""

    docs = docs.drop(out)
    names, schema = docs.columns, T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])
    id_at, text_at = names.index("doc_id"), names.index("text")
    local = shipped(docs.sparkSession, model)

    def run(batches):
        path = local()
        for batch in slices(batches, text_at):
            ids = id_numbers(batch.column(id_at))
            got, starts = encode([t or "" for t in batch.column(text_at).to_pylist()], document_keys(ids, seed), path, rate)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(got, pa.int32()))], [*names, out])

    return docs.mapInArrow(run, schema)


def decode_column(encoded: DataFrame, model: str = MODEL, pieces: str = "pieces", out: str = "text") -> DataFrame:
    """``encoded`` with the text of column ``pieces`` in column ``out``."""

    local = shipped(encoded.sparkSession, model)

    @F.pandas_udf(T.StringType())
    def text(lists: pd.Series) -> pd.Series:
        path = local()
        return pd.Series([None if x is None else decode(x.tolist(), path) for x in lists], dtype=object)

    return encoded.withColumn(out, text(F.col(pieces)))
