"""Removing repeated passages of at least ``LENGTH`` bytes, found on Burrows-Wheeler transforms.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller id. Matches
never cross documents.

1. Anchors. Of the ``SEED_BYTES``-grams of each ``LENGTH``-byte string the one with the smallest hash is its anchor
   (leftmost of equals), so equal strings have equal anchors at the same place. Hashes of anchors are dealt into
   buckets; those that occur in two documents or more go back to their documents.
2. Windows. For each such anchor a document cuts out the window of all strings that it anchors, split where the
   string reaches further to the right or to the left of it; the anchor with 16 more bytes on that side is the
   window's key. Windows with equal bytes count once, with the smallest id; the others are repeats as they stand.
3. Intervals. The different windows of one key are concatenated, their suffixes sorted, and the boundaries of the
   common prefixes found by breadth-first backward extension on the transform: intervals of all strings of 0, 1, 2,
   ... bytes, each extended to the left by every byte that precedes it, give the boundaries in order of the length
   of the common prefix. It stops at ``LENGTH``: suffixes that no boundary parts share that many bytes. In each
   such class the smallest id stays. A key with over ``SORT_BYTES`` of windows is taken in parts: its strings are
   dealt by their first bytes, so that equal ones meet.
4. The spans go back to their documents, which drop the covered bytes.

A chunk of documents sends each hash and each window once, so a passage that a third of the documents share
arrives once per chunk, not once per document. The number of tasks follows the bytes of the table. Windows count as
equal when two 64-bit hashes are, that of the key and that of all their bytes.

Cases: null text is the empty text; texts under ``LENGTH`` bytes lose nothing; rows with equal ids do not remove
from each other; rows with a null id neither lose nor remove anything; a text that repeats itself loses nothing by
that; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import expand, partitions, release, settle, slices, squeeze

LENGTH, SEED_BYTES = 50, 16
REACH = LENGTH - SEED_BYTES
#: Bytes of text whose anchors, and bytes of windows, a task gathers before it sends them.
CHUNK_TEXT, CHUNK_WINDOWS = 16 << 20, 8 << 20
#: Anchors that a bucket holds at most on average, and bytes of windows that are sorted in one go.
BUCKET_ANCHORS, SORT_BYTES = 1 << 20, 1 << 20
#: Bytes of text that a task reads on average, if there are more of them than shuffle partitions take.
TASK_TEXT = 64 << 20
#: Documents of a block, to which what is found goes back, and findings that a task gathers before it sends them.
BLOCK_DOCS, HELD_FINDINGS = 2000, 1 << 19
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_FLOW = "bucket int, known boolean, data binary"
_ROW = "block int, kind int, doc_id long, tie long, data binary"


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _K[1]
    x = (x ^ (x >> np.uint64(27))) * _K[2]
    return x ^ (x >> np.uint64(31))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one value."""
    return b"".join(np.int64(len(a.tobytes())).tobytes() + a.tobytes() for a in arrays)


def unpack(data: bytes, *kinds) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        n = int(np.frombuffer(data, np.int64, 1, at)[0])
        out.append(np.frombuffer(data, kind, n // np.dtype(kind).itemsize, at + 8))
        at += 8 + n
    return out


def words_of(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as a number; the last seven positions have none."""
    x = data.astype(np.uint64)
    x = x[:-1] | x[1:] << np.uint64(8)
    x = x[:-2] | x[2:] << np.uint64(16)
    return x[:-4] | x[4:] << np.uint64(32)


def content_of(word: np.ndarray, start: np.ndarray, strings: np.ndarray) -> np.ndarray:
    """A hash of the bytes of windows, from the words of their text."""
    end = start + strings + LENGTH - 1
    h = mix(strings.astype(np.uint64) + _K[1])
    for k in range(0, LENGTH + REACH, 8):
        h = mix(h * _K[0] + word[np.minimum(start + k, end - 8)])
    return h


def _slide(x: np.ndarray, width: int, what) -> np.ndarray:
    """``what`` (minimum or maximum) over each run of ``width`` values."""
    done = 1
    while done * 2 <= width:
        x = what(x[:-done], x[done:])
        done *= 2
    return what(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


class Grams:
    """Hashes of all seeds of some texts, one after the other, and their anchors."""

    def __init__(self, texts: list[bytes]):
        size = np.array([len(t) for t in texts], np.int64)
        self.start = np.cumsum(size) - size
        self.end = self.start + size
        # the padding lets every position have a seed
        self.bytes = np.frombuffer(b"".join(texts) + bytes(LENGTH + SEED_BYTES), np.uint8)
        n = int(size.sum())
        self.word = words_of(self.bytes)
        m = mix(self.word)
        self.hash = mix(m[:-8] * _K[0] + m[8:])[: n + REACH]
        self.doc = np.repeat(np.arange(len(texts)), size)
        least = _slide(self.hash, REACH + 1, np.minimum)[:n]
        self.valid = np.arange(n) + LENGTH <= self.end[self.doc]
        self.least = least
        shown = np.where(self.valid, least, np.uint64(0))
        most = _slide(np.concatenate([np.zeros(REACH, np.uint64), shown, np.zeros(REACH, np.uint64)]), REACH + 1, np.maximum)[:n] if n else shown
        self.anchor = np.flatnonzero((most == self.hash[:n]) & (most > 0))

    def windows(self, wanted: np.ndarray):
        """(key, document, start, strings) of the windows of the wanted anchors (a mask over ``anchor``)."""
        s = np.flatnonzero(self.valid)
        at = np.searchsorted(self.anchor, s)
        least, of = self.least[s], self.hash[self.anchor]
        rest = np.flatnonzero(of[at] != least)
        while len(rest):
            at[rest] += 1
            rest = rest[of[at[rest]] != least[rest]]
        keep = wanted[at]
        s, at = s[keep], at[keep]
        if not len(s):
            return tuple(np.zeros(0, k) for k in (np.uint64, np.int64, np.int64, np.int64))
        a = self.anchor[at]
        right = a - s <= REACH // 2
        first = np.append(True, (at[1:] != at[:-1]) | (right[1:] != right[:-1]) | (s[1:] != s[:-1] + 1))
        begin = np.flatnonzero(first)
        a, right = a[begin], right[begin]
        here = self.hash[a]
        more = self.hash[np.where(right, a + SEED_BYTES, np.maximum(a - SEED_BYTES, 0))]
        key = mix(here * _K[0] + more + right.astype(np.uint64))
        return key, self.doc[s[begin]], s[begin], np.diff(np.append(begin, len(s)))


def _flow(rows: list[tuple[int, bool, bytes]]) -> pa.RecordBatch:
    bucket, known, data = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(known, pa.bool_()), pa.array(data, pa.binary())], ["bucket", "known", "data"])


def block_of(ids: np.ndarray, blocks: int) -> np.ndarray:
    """The block of a document; ``block_column`` gives the same."""
    return (ids ^ (ids >> 15)) % blocks


def block_column(blocks: int):
    return F.pmod(F.col("doc_id").bitwiseXOR(F.shiftright("doc_id", 15)), F.lit(blocks)).cast("int")


class Findings:
    """What a task has found for documents, to be sent as one row per block."""

    def __init__(self, blocks: int):
        self.blocks, self.held, self.size = blocks, [], 0

    def add(self, ids: np.ndarray, ties: np.ndarray, values: np.ndarray):
        """``values`` has a row for each finding. Yields rows when enough are held."""
        if len(ids):
            self.held.append((ids, ties, values))
            self.size += len(ids)
        if self.size >= HELD_FINDINGS:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        out: tuple[list, list] = ([], [])
        if self.held:
            ids, ties, values = (np.concatenate(x) for x in zip(*self.held))
            block = block_of(ids, self.blocks)
            order = np.lexsort((ties, ids, block))
            ids, ties, values, block = ids[order], ties[order], values[order], block[order]
            first = np.append(True, (ids[1:] != ids[:-1]) | (ties[1:] != ties[:-1]))
            begin = np.flatnonzero(first)
            count = np.diff(np.append(begin, len(ids))).astype(np.int32)
            cut = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(ids))
            at = np.searchsorted(begin, cut)
            for k in range(len(cut) - 1):
                docs = slice(at[k], at[k + 1])
                out[0].append(int(block[cut[k]]))
                out[1].append(pack(ids[begin[docs]], ties[begin[docs]], count[docs], values[cut[k] : cut[k + 1]]))
        self.held, self.size = [], 0
        none = np.zeros(len(out[0]), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(none.astype(np.int32)), pa.array(none), pa.array(none), pa.array(out[1], pa.binary())], ["block", "kind", "doc_id", "tie", "data"])


def _send_anchors(n_buckets: int):
    def run(batches):
        ids, ties, hashes, docs, size, n = [], [], [], [], 0, 0

        def flush():
            i, t, h, d = (np.concatenate(x) for x in (ids, ties, hashes, docs))
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            once = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]))
            h, d = h[once], d[once]
            begin = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            count = np.diff(np.append(begin, len(h)))
            several = np.repeat(count > 1, count)
            rows = []
            if several.any():
                # shared within the chunk: nothing more has to be known of these
                use, inverse = np.unique(d[several], return_inverse=True)
                rows.append((int(h[0] % np.uint64(n_buckets)), True, pack(i[use], t[use], inverse.astype(np.uint32), h[several])))
            head = h[begin]
            owner = np.where(count > 1, -1, d[begin])
            bucket = ((head >> np.uint64(20)) % np.uint64(n_buckets)).astype(np.int64)
            order = np.lexsort((owner, bucket))
            head, owner, bucket = head[order], owner[order], bucket[order]
            cut = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
            for b, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
                use, inverse = np.unique(owner[b:e], return_inverse=True)
                one = use[0] == -1
                rows.append((int(bucket[b]), False, pack(np.where(use < 0, 0, i[use]), np.where(use < 0, 0, t[use]), np.where(one & (inverse == 0), 0xFFFFFFFF, inverse).astype(np.uint32), head[b:e])))
            for x in (ids, ties, hashes, docs):
                x.clear()
            return _flow(rows)

        for batch in slices(batches, 2):
            g = Grams([x or b"" for x in batch.column(2).to_pylist()])
            ids.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            ties.append(batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64))
            hashes.append(g.hash[g.anchor])
            docs.append(g.doc[g.anchor] + n)
            n += batch.num_rows
            size += len(g.bytes)
            if size >= CHUNK_TEXT:
                if sum(map(len, hashes)):
                    yield flush()
                else:
                    for x in (ids, ties, hashes, docs):
                        x.clear()
                size = n = 0
        if sum(map(len, hashes)):
            yield flush()

    return run


def _by_bucket(batches):
    """(known, values) of each known row, and (False, list of the values) of each bucket."""
    at, held = None, []
    for batch in batches:
        for bucket, known, data in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if known:
                yield True, data
                continue
            if bucket != at and held:
                yield False, held
                held = []
            at = bucket
            held.append(data)
    if held:
        yield False, held


def _shared_anchors(blocks: int):
    kinds = (np.int64, np.int64, np.uint32, np.uint64)

    def run(batches):
        out = Findings(blocks)
        for known, data in _by_bucket(batches):
            if known:
                i, t, d, h = unpack(data, *kinds)
                yield from out.add(i[d], t[d], h)
                continue
            parts = [unpack(x, *kinds) for x in data]
            h = np.concatenate([p[3] for p in parts])
            none = np.concatenate([p[2] == 0xFFFFFFFF for p in parts])
            pick = [np.where(p[2] == 0xFFFFFFFF, 0, p[2]) for p in parts]
            i = np.concatenate([p[0][d] for p, d in zip(parts, pick)])
            t = np.concatenate([p[1][d] for p, d in zip(parts, pick)])
            order = np.argsort(h, kind="stable")
            h, i, t, none = h[order], i[order], t[order], none[order]
            count = np.diff(np.append(np.flatnonzero(np.append(True, h[1:] != h[:-1])), len(h)))
            use = np.repeat(count > 1, count) & ~none
            yield from out.add(i[use], t[use], h[use])
        yield out.flush()

    return run


def _with_findings(batches, kind_of, width: int = 1, size_limit: int = 1 << 20):
    """Lists of (doc_id, tie, bytes, findings) of documents; the findings of a block come before its texts."""
    at, known, out, size = None, {}, [], 0
    for batch in slices(batches, 4, 1 << 22):
        for block, kind, doc_id, tie, data in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if block != at:
                at, known = block, {}
            if kind == 0:
                ids, ties, count, values = unpack(data, np.int64, np.int64, np.int32, kind_of)
                ends = np.cumsum(count) * width
                for d, t, b, e in zip(ids.tolist(), ties.tolist(), (ends - count * width).tolist(), ends.tolist()):
                    known.setdefault((d, t), []).append(values[b:e])
            else:
                found = known.get((doc_id, tie))
                out.append((doc_id, tie, data or b"", None if found is None else np.concatenate(found)))
                size += len(data or b"")
                if size >= size_limit:
                    yield out
                    out, size = [], 0
    if out:
        yield out


def _send_windows(n_buckets: int):
    def run(batches):
        held: list[tuple] = []

        def flush():
            doc_ids, doc_ties, doc, key, content, start, strings, body = (np.concatenate(x) for x in zip(*held))
            owner = doc + np.repeat(np.cumsum([0, *(len(h[0]) for h in held[:-1])]), [len(h[2]) for h in held])
            i, t = doc_ids[owner], doc_ties[owner]
            length = strings + LENGTH - 1
            first = np.cumsum(length) - length
            order = np.lexsort((i, content, key))
            k, c, j = key[order], content[order], i[order]
            begin = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])))
            least = np.repeat(j[begin], np.diff(np.append(begin, len(k))))
            later = np.zeros(len(i), bool)
            later[order] = j > least
            rows = []
            if later.any():
                rows.append((int(k[0] % np.uint64(n_buckets)), True, pack(i[later], t[later], np.stack([start[later], start[later] + length[later]], 1).astype(np.int32))))
            bucket = ((key >> np.uint64(20)) % np.uint64(n_buckets)).astype(np.int64)
            mine = np.flatnonzero(~later)
            mine = mine[np.argsort(bucket[mine], kind="stable")]
            cut = np.append(np.flatnonzero(np.append(True, bucket[mine][1:] != bucket[mine][:-1])), len(mine))
            for b, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
                w = mine[b:e]
                n = length[w]
                every = np.repeat(first[w], n) + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
                use, inverse = np.unique(owner[w], return_inverse=True)
                # documents and places come in order, so that differences are small; the hash of the bytes is made again
                step = lambda x: np.frombuffer(squeeze(np.diff(x.astype(np.int32), prepend=np.int32(0))), np.uint8)
                rows.append((int(bucket[w[0]]), False, pack(doc_ids[use], doc_ties[use], step(inverse), key[w], step(start[w]), n.astype(np.uint8), np.frombuffer(squeeze(body[every]), np.uint8))))
            held.clear()
            return _flow(rows)

        total = 0
        for group in _with_findings(batches, np.uint64):
            group = [x for x in group if x[3] is not None]
            if not group:
                continue
            g = Grams([x[2] for x in group])
            shared = [x[3] for x in group]
            tag = lambda h, d: h + (d.astype(np.uint64) + np.uint64(1)) * _K[0]
            owned = tag(np.concatenate(shared), np.repeat(np.arange(len(group)), [len(x) for x in shared]))
            wanted = np.isin(tag(g.hash[g.anchor], g.doc[g.anchor]), owned)
            key, doc, start, strings = g.windows(wanted)
            if not len(key):
                continue
            n = strings + LENGTH - 1
            every = np.repeat(start, n) + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
            ids, ties = np.array([x[0] for x in group], np.int64), np.array([x[1] for x in group], np.int64)
            held.append((ids, ties, doc, key, content_of(g.word, start, strings), start - g.start[doc], strings, g.bytes[every]))
            total += len(every)
            if total >= CHUNK_WINDOWS:
                yield flush()
                total = 0
        if held:
            yield flush()

    return run


def suffix_order(text: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Suffixes of ``text`` (bytes + 1, 0 ends a window) in order, equal ones by position; windows end within 128."""
    n = len(text)
    pad = np.concatenate([text, np.zeros(128, text.dtype)]).astype(np.uint64)
    # what follows an end does not count
    end = np.repeat(np.append(first[1:], n), np.diff(np.append(first, n))) - np.arange(n)
    # seven symbols of nine bits
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = key << np.uint64(9) | np.where(end > k, pad[k : k + n], np.uint64(0))
    step = 7
    order = np.argsort(key, kind="stable")
    while True:
        k = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(0, k[1:] != k[:-1]))
        if step >= LENGTH + REACH + 1:
            return order
        after = np.concatenate([rank, np.zeros(step, np.int64)])[step : step + n]
        key = (rank * (n + 1) + np.where(end > step, after + 1, 0)).astype(np.uint64)
        order = np.argsort(key, kind="stable")
        step *= 2


def prefix_classes(text: np.ndarray, first: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Class of each suffix: equal for those with equal first ``length`` symbols (where no window ends in them)."""
    n = len(text)
    order = suffix_order(text, first)
    before = np.where(order > 0, text[order - 1], 0)
    by_symbol = np.argsort(before, kind="stable")
    last_to_first = np.empty(n, np.int64)
    last_to_first[by_symbol] = np.arange(n)
    parted = np.zeros(n + 1, bool)
    parted[0] = parted[n] = True
    # intervals of the single symbols, ends included
    counts = np.bincount(text)
    hi = np.cumsum(counts)
    lo = (hi - counts)[counts > 0]
    hi = hi[counts > 0]
    parted[hi] = True
    for _ in range(1, length):
        if not len(lo):
            break
        size = hi - lo
        owner = np.repeat(np.arange(len(lo)), size)
        at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        symbol = before[at]
        inside = symbol > 0
        owner, symbol, to = owner[inside], symbol[inside], last_to_first[at[inside]]
        if not len(to):
            break
        o = np.argsort(to)
        owner, symbol, to = owner[o], symbol[o], to[o]
        begin = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1])))
        lo, hi = to[begin], to[np.append(begin[1:], len(to)) - 1] + 1
        new = ~parted[hi]
        parted[hi] = True
        lo, hi = lo[new], hi[new]
    out = np.empty(n, np.int64)
    out[order] = np.cumsum(parted[:n])
    return out


def _later(body: np.ndarray, first: np.ndarray, n: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, offset) of the strings that a window with a smaller id holds too; windows are ``n`` bytes from ``first`` on."""
    start = np.cumsum(n + 1) - (n + 1)
    text = np.zeros(int((n + 1).sum()), np.int16)
    inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    text[np.repeat(start, n) + inner] = body[np.repeat(first, n) + inner].astype(np.int16) + 1
    classes = prefix_classes(text, start)
    strings = n - LENGTH + 1
    owner = np.repeat(np.arange(len(n)), strings)
    offset = np.arange(int(strings.sum())) - np.repeat(np.cumsum(strings) - strings, strings)
    of, doc = classes[start[owner] + offset], ids[owner]
    o = np.lexsort((doc, of))
    head = np.flatnonzero(np.append(True, of[o][1:] != of[o][:-1]))
    least = np.empty(len(o), np.int64)
    least[o] = np.repeat(doc[o][head], np.diff(np.append(head, len(o))))
    hit = np.flatnonzero(doc > least)
    return owner[hit], offset[hit]


def _later_in_parts(body: np.ndarray, first: np.ndarray, n: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``_later``, for a key with more windows than are sorted in one go: its strings are dealt by their first bytes."""
    strings = n - LENGTH + 1
    owner = np.repeat(np.arange(len(n)), strings)
    offset = np.arange(int(strings.sum())) - np.repeat(np.cumsum(strings) - strings, strings)
    word, at = words_of(body), first[owner] + offset
    parts = int(len(at)) * (LENGTH + 1) // SORT_BYTES + 1
    part = (mix(mix(word[at]) * _K[0] + word[at + 8]) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    found = []
    for b, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
        mine = order[b:e]
        if len(mine) > 1:
            found.append(mine[_later(body, at[mine], np.full(len(mine), LENGTH), ids[owner[mine]])[0]])
    hit = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return owner[hit], offset[hit]


def _spans(key, ids, body, length):
    """(window, from, to) of strings that a window with a smaller id holds; one window per (key, content)."""
    out = []
    first = np.cumsum(length) - length
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    ends = np.append(begin[1:], len(key))
    b = 0
    while b < len(begin):
        e = b
        while e < len(begin) and (e == b or first[ends[e] - 1] + length[ends[e] - 1] - first[begin[b]] <= SORT_BYTES):
            e += 1
        w = slice(begin[b], ends[e - 1])
        hot = int(length[w].sum()) > SORT_BYTES
        owner, offset = (_later_in_parts if hot else _later)(body, first[w], length[w], ids[w])
        if len(owner):
            run = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1)))
            last = np.append(run[1:], len(owner)) - 1
            out.append(np.stack([owner[run] + begin[b], offset[run], offset[last] + LENGTH], 1))
        b = e
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def _shared_windows(blocks: int):
    kinds = (np.int64, np.int64, np.uint8, np.uint64, np.uint8, np.uint8, np.uint8)

    def run(batches):
        out = Findings(blocks)
        for known, data in _by_bucket(batches):
            if known:
                i, t, s = unpack(data, np.int64, np.int64, np.int32)
                yield from out.add(i, t, s.reshape(-1, 2))
                continue
            parts = [unpack(x, *kinds) for x in data]
            owner = [np.cumsum(expand(p[2], np.int32)) for p in parts]
            i, t = (np.concatenate([p[k][o] for p, o in zip(parts, owner)]) for k in (0, 1))
            key, length = (np.concatenate([p[k] for p in parts]) for k in (3, 5))
            start = np.concatenate([np.cumsum(expand(p[4], np.int32)) for p in parts])
            texts = [expand(p[6], np.uint8) for p in parts]
            content = []
            for text, p in zip(texts, parts):
                n = p[5].astype(np.int64)
                content.append(content_of(words_of(np.append(text, np.zeros(8, np.uint8))), np.cumsum(n) - n, n - LENGTH + 1))
            content, body = np.concatenate(content), np.concatenate(texts)
            start, length = start.astype(np.int64), length.astype(np.int64)
            first = np.cumsum(length) - length
            order = np.lexsort((i, content, key))
            i, t, key, content, start, length, first = (x[order] for x in (i, t, key, content, start, length, first))
            begin = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (content[1:] != content[:-1])))
            group = np.cumsum(np.append(True, (key[1:] != key[:-1]) | (content[1:] != content[:-1]))) - 1
            later = i > i[begin][group]
            yield from out.add(i[later], t[later], np.stack([start[later], start[later] + length[later]], 1).astype(np.int32))
            # keys with several different windows
            k = key[begin]
            several = np.append(False, k[1:] == k[:-1]) | np.append(k[1:] == k[:-1], False)
            rep = begin[several]
            if not len(rep):
                continue
            n = length[rep]
            every = np.repeat(first[rep] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            found = _spans(key[rep], i[rep], body[every], n)
            if not len(found):
                continue
            # a span holds for all places of its window in the document with the smallest id
            of_group = np.flatnonzero(several)[found[:, 0]]
            sizes = np.diff(np.append(begin, len(key)))[of_group]
            row = np.repeat(begin[of_group] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
            span = np.repeat(np.arange(len(found)), sizes)
            keep = ~later[row]
            row, span = row[keep], span[keep]
            yield from out.add(i[row], t[row], np.stack([start[row] + found[span, 1], start[row] + found[span, 2]], 1).astype(np.int32))
        yield out.flush()

    return run


def _cut(batches):
    for group in _with_findings(batches, np.int32, 2):
        ids, sizes, removed, spans, digests = [], [], [], [], []
        for doc_id, _, data, values in group:
            kept, at, gone, runs = [], 0, 0, 0
            if values is not None:
                s = values.reshape(-1, 2)
                s = s[np.argsort(s[:, 0], kind="stable")]
                reach = np.maximum.accumulate(s[:, 1])
                new = np.append(True, s[1:, 0] > reach[:-1])
                for b, e in zip(s[new, 0].tolist(), reach[np.append(np.flatnonzero(new)[1:], len(s)) - 1].tolist()):
                    kept.append(data[at:b])
                    at, gone, runs = e, gone + e - b, runs + 1
            kept.append(data[at:])
            ids.append(doc_id)
            sizes.append(len(data))
            removed.append(gone)
            spans.append(runs)
            digests.append(b"".join(kept))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def strip_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): each text without its repeated bytes."""
    spark = docs.sparkSession
    body = F.coalesce("text", F.lit("")).cast("binary")
    total, count = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    n = partitions(spark)
    buckets, blocks = max(n, int(total * 2 / (REACH + 2)) // BUCKET_ANCHORS), max(n, count // BLOCK_DOCS)
    # a bucket has a task of its own where there are many
    by_bucket, by_block = buckets, max(n, total // TASK_TEXT)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"), body.alias("data"))
    anchors = rows.where("doc_id is not null").mapInArrow(_send_anchors(buckets), _FLOW)
    shared = settle(anchors.repartition(by_bucket, "bucket").sortWithinPartitions("bucket").mapInArrow(_shared_anchors(blocks), _ROW), "repeat-anchors")
    del anchors
    release(spark)
    texts = rows.select(F.coalesce(block_column(blocks), F.pmod("tie", F.lit(blocks)).cast("int")).alias("block"), F.lit(1).alias("kind"), "doc_id", "tie", "data")

    def with_texts(findings):
        return texts.union(findings).repartition(by_block, "block").sortWithinPartitions("block", "kind", "doc_id", "tie")

    windows = with_texts(shared).mapInArrow(_send_windows(buckets), _FLOW)
    spans = settle(windows.repartition(by_bucket, "bucket").sortWithinPartitions("bucket").mapInArrow(_shared_windows(blocks), _ROW), "repeat-spans")
    del windows, shared
    release(spark)
    return with_texts(spans).mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
