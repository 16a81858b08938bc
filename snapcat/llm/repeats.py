"""Exact removal of byte strings that also start in an earlier document: a suffix order in two distributed steps.

Step 1 finds where repeats can be. Of every document the anchors are taken: 20-byte strings whose hash is the least
of 31 neighbours (winnowing), so every 50-byte string holds an anchor, chosen by its own bytes alone. Two equal
50-byte strings therefore hold the same anchor at the same offset, and only anchors that occur in two different
texts matter. Only their hashes are shuffled. Anchors that tasks see often while they name the texts are counted first:
those found to be very common are known to recur, and their occurrences are dealt by document, so that no task gathers
a line that stands in all documents.

Step 2 decides. Around each such anchor the 80 bytes that 50-byte strings holding it can cover form a context.
Contexts are dealt by anchor, so all equal 50-byte strings meet in one task. It joins its distinct contexts into one
string, puts all suffixes in order by the difference-cover algorithm (triples of sampled positions, recursion on
their names, merge with the remaining suffixes), compares the 50-byte prefixes of neighbours, and takes the smallest
document of every class of equal prefixes.

An anchor found in very many documents is dealt to several tasks: each gets all distinct contexts with their smallest
documents (few, combined before the shuffle) and a share of the occurrences. Equal texts are one text, named by its
smallest document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .components import checkpoint_dir, release
from .keyfilter import key_filter
from .suffix import prefix_classes

GRAM = 20
#: anchors held by a task before it passes them on, anchors and contexts in a bucket
FLUSH, BUCKET, CONTEXTS = 1_000_000, 400_000, 12_000
#: occurrences of an anchor in a task, and most rows of the list of anchors that are dealt to several
SHARE, MOST_HOT = 20_000, 1 << 20
#: an anchor is counted for the list where a task sees it so often among FLUSH ones
OFTEN = 4
#: level of zstd for texts, and for packed columns
TEXT_LEVEL, PACK_LEVEL = 3, 1
_NONE = (1 << 63) - 1


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every window of `width` neighbours."""
    size = 1
    while size * 2 <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return pick(x[:-rest], x[rest:]) if rest else x


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Numbers of all elements of the stretches that begin at `starts`, one stretch after the other."""
    total = np.cumsum(sizes)
    return np.arange(int(total[-1]) if len(total) else 0) + np.repeat(starts - total + sizes, sizes)


class Anchors:
    """Anchors of a block of documents; every `width`-byte string inside a document chooses one.

    at, hashes: positions and 64-bit hashes; sums, down: running sums from which any substring's hash follows.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, width: int):
        self.span, self.width = width - GRAM + 1, width
        self.n = n = len(data) - width + 1
        self.at, self.hashes = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        up, self.down = tx.powers(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(tx._CODE[data] * up[: len(data)], out=self.sums[1:])
        if n < 1:
            self.n = 0
            return
        h = tx.mix64((self.sums[GRAM:] - self.sums[:-GRAM]) * self.down[: len(data) - GRAM + 1]) | np.uint64(1)
        self.least = _sliding(h, self.span, np.minimum)
        # strings that run over the end of a document choose nothing
        for e in offsets[1:-1].tolist():
            self.least[max(0, e - width + 1) : min(e, n)] = 0
        padded = np.zeros(n + 2 * (self.span - 1), np.uint64)
        padded[self.span - 1 : self.span - 1 + n] = self.least
        self.at = np.flatnonzero(_sliding(padded, self.span, np.maximum) == h)
        self.hashes = h[self.at]

    def chosen(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor numbers, first and last start) of the strings that choose the wanted anchors, one run for each.

        Among equal hashes the last one in the string is chosen.
        """
        if not len(self.at):
            return (np.zeros(0, np.int64),) * 3
        near = np.zeros(self.n, bool)
        spots = self.at[wanted]
        for k in range(self.span):
            near[np.minimum(spots[spots >= k] - k, self.n - 1)] = True
        start = np.flatnonzero(near & (self.least > 0))
        which = np.searchsorted(self.at, start + self.span - 1, "right") - 1
        off = np.flatnonzero(self.hashes[which] != self.least[start])
        while len(off):
            which[off] -= 1
            off = off[self.hashes[which[off]] != self.least[start[off]]]
        mine = wanted[which]
        start, which = start[mine], which[mine]
        if not len(start):
            return (np.zeros(0, np.int64),) * 3
        new = np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1])))
        last = np.concatenate((new[1:], [len(start)])) - 1
        return which[new], start[new], start[last]

    def substring_hashes(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return tx.mix64((self.sums[hi] - self.sums[lo]) * self.down[lo] + (hi - lo).astype(np.uint64))


def anchor_name(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, 40 further bits) of an anchor hash; together its name. Anchors that share a name only cost time."""
    return ((hashes & np.uint64(0x7FFFFF)) % np.uint64(buckets)).astype(np.int32), hashes >> np.uint64(24)


#: a marked anchor is one number: 40 bits, this bit if the document is the first that has it, 23 bits of its bucket
_FIRST = np.int64(1 << 23)


def text_key(data: bytes) -> int:
    """Signed 64-bit name of a text."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(data)).astype(np.int64))


def _documents(batches: Iterator[pa.RecordBatch], column: str):
    """Blocks: (ids or None, bytes, offsets, text keys)."""
    for batch in batches:
        ids = batch.column(0)
        for lo, hi, data, offsets in tx.blocks(batch.column(batch.schema.get_field_index(column))):
            raw = data.tobytes()
            keys = [text_key(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield ids.slice(lo, hi - lo), raw, data, offsets, keys


def _cut(order_by: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    order = np.argsort(order_by, kind="stable")
    edges = np.searchsorted(order_by[order], np.arange(buckets + 1))
    return order, edges, [b for b in range(buckets) if edges[b] < edges[b + 1]]


def _named(docs: DataFrame, width: int) -> DataFrame:
    """(id, key, n_bytes, sha) of every row, and rows (anchor, n) of anchors that a task has seen often, with id and key null.

    A task counts a text that it has seen before once.
    """
    columns = ["id", "key", "n_bytes", "sha", "anchor", "n"]

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def often() -> Iterator[pa.RecordBatch]:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            values, counts = values[counts >= OFTEN], counts[counts >= OFTEN]
            if k := len(values):
                none = [pa.nulls(k, pa.int64())] * 3
                yield pa.RecordBatch.from_arrays([*none, pa.nulls(k, pa.string()), pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], columns)

        for ids, raw, data, offsets, keys in _documents(batches, "text"):
            ends = offsets.tolist()
            sha = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            none = [pa.nulls(len(keys), pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([ids, pa.array(keys, pa.int64()), pa.array(np.diff(offsets)), pa.array(sha), *none], columns)
            new = np.array([not (k in seen or seen.add(k)) for k in keys], bool)
            a = Anchors(data, offsets, width)
            hashes = a.hashes[new[np.searchsorted(offsets, a.at, "right") - 1]]
            if len(hashes):
                held.append(hashes)
                size += len(hashes)
            if size >= FLUSH:
                yield from often()
                held, size = [], 0
        if held:
            yield from often()

    return docs.mapInArrow(name, "id long, key long, n_bytes long, sha string, anchor long, n long")


def anchor_number(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The name of an anchor as one number."""
    bucket, name = anchor_name(hashes, buckets)
    return name.astype(np.int64) << 24 | bucket


def _recurring(docs: DataFrame, heads, width: int, buckets: int, share: int, common) -> DataFrame:
    """(id, anchor) of anchors that occur under two ids; under id null, once for every `share` ids more, the hot ones.

    heads: filter of (text, smallest id); most other copies of a text are passed over. common: sorted numbers of anchors
    known to be very common; they are marked wherever they occur, and their rows are dealt by id.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_copies = heads.value
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def deal() -> pa.RecordBatch:
            h, doc = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            bucket, name = anchor_name(h, buckets)
            home, known = bucket.astype(np.int32), np.zeros(len(h), bool)
            if len(common.value):
                number = anchor_number(h, buckets)
                known = common.value[np.minimum(np.searchsorted(common.value, number), len(common.value) - 1)] == number
                bucket = np.where(known, buckets + (tx.mix64(doc.view(np.uint64)) % np.uint64(buckets)).astype(np.int32), bucket)
            order, edges, rows = _cut(bucket, 2 * buckets)
            low, high, doc = (name & np.uint64(0xFFFFFFFF)).astype(np.uint32)[order], (name >> np.uint64(32)).astype(np.uint8)[order], doc[order]
            home = home[order]
            part = lambda x: pa.array([x[edges[b] : edges[b + 1]].tobytes() for b in rows], pa.binary())
            homes = pa.array([home[edges[b] : edges[b + 1]].tobytes() if b >= buckets else b"" for b in rows], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), part(low), part(high), part(doc), homes], ["bucket", "low", "high", "id", "home"])

        for ids, _, data, offsets, keys in _documents(batches, "text"):
            ids = ids.to_numpy(zero_copy_only=False).astype(np.int64)
            fresh = np.array([copy_key(k, i) in first_copies for k, i in zip(keys, ids.tolist(), strict=True)], bool)
            a = Anchors(data, offsets, width)
            doc = np.searchsorted(offsets, a.at, "right") - 1
            mine = fresh[doc]
            if mine.any():
                held.append((a.hashes[mine], ids[doc[mine]]))
                size += int(mine.sum())
            if size >= FLUSH:
                yield deal()
                held, size = [], 0
        if held:
            yield deal()

    def meet(table: pa.Table) -> pa.Table:
        get = lambda name, kind: np.concatenate([np.frombuffer(x.as_py(), kind) for x in table.column(name)])
        name = get("low", np.uint32).astype(np.int64) | (get("high", np.uint8).astype(np.int64) << 32)
        doc = get("id", np.int64)
        if (own := table.column("bucket")[0].as_py()) >= buckets:
            seen = np.unique(np.stack([doc, name << 24 | get("home", np.int32)]), axis=1)
            return pa.table({"id": seen[0], "anchor": seen[1]})
        order = np.argsort(name, kind="stable")
        name, doc = name[order], doc[order]
        same = np.zeros(len(name) + 1, bool)
        same[1:-1] = name[1:] == name[:-1]
        kept = same[1:] | same[:-1]
        name, doc = name[kept], doc[kept]
        order = np.lexsort((doc, name))
        name, doc = name[order], doc[order]
        new = np.ones(len(name), bool)
        new[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
        name, doc = name[new], doc[new]
        runs = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1]))) if len(name) else np.zeros(0, np.int64)
        n = np.diff(np.concatenate((runs, [len(name)])))
        anchor = name << 24 | int(own)
        hot = np.repeat(anchor[runs], n // share)
        anchor[runs] |= _FIRST
        kept = np.repeat(n, n) > 1
        return pa.table({"id": pa.concat_arrays([pa.array(doc[kept]), pa.nulls(len(hot), pa.int64())]), "anchor": np.concatenate((anchor[kept], hot))})

    made = docs.mapInArrow(make, "bucket int, low binary, high binary, id binary, home binary")
    return made.groupBy("bucket").applyInArrow(meet, "id long, anchor long")


def copy_key(key: int, doc: int) -> int:
    """Name of a text under an id, for a filter."""
    return (key ^ (doc * 0x9E3779B97F4A7C15 + 0x1D8E4E27C47D124F)) & (2**64 - 1)


def _copy_keys(classes: DataFrame) -> DataFrame:
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [copy_key(k, i) for k, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64), pa.int64())], ["key"])

    return classes.select("key", "least").mapInArrow(name, "key long")


def _texts(docs: DataFrame, heads, wanted, by_id: bool) -> DataFrame:
    """(id, key, text compressed) of first copies whose id (or else key) is in a filter; some others may be among them."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_copies, filter_, seen, pack = heads.value, wanted.value, set(), zstandard.ZstdCompressor(TEXT_LEVEL)
        for ids, raw, _, offsets, names in _documents(batches, "text"):
            out = []
            for i, (d, k) in enumerate(zip(ids.to_pylist(), names, strict=True)):
                if (d, k) not in seen and (d if by_id else k) in filter_ and copy_key(k, d) in first_copies:
                    seen.add((d, k))
                    out.append((d, k, pack.compress(raw[int(offsets[i]) : int(offsets[i + 1])])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["id", "key", "z"])

    return docs.mapInArrow(make, "id long, key long, z binary")


_PACKED = {"anchor": np.int64, "size": np.int32, "bytes": np.uint8, "least": np.int64, "context": np.int32, "id": np.int64, "key": np.int64, "base": np.int32}


class _Held:
    """Contexts and occurrences that a task holds back until it deals them out."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.clear()

    def clear(self) -> None:
        self.contexts: list[tuple] = []  # name, anchor, shares, smallest id, size, bytes
        self.seen: list[tuple] = []  # name, id, key, base, shares, anchor
        self.rows = 0

    def add(self, name, anchor, shares, doc, key, lo, hi, begin, data, answers) -> None:
        """Contexts data[lo:hi] (named by hashes) of documents; `answers` marks the occurrences that want one."""
        order = np.lexsort((doc, name))
        head = order[np.concatenate(([True], name[order][1:] != name[order][:-1]))]
        size = (hi - lo)[head]
        self.contexts.append((name[head], anchor[head], shares[head], doc[head], size, data[ragged(lo[head], size)]))
        a = answers
        self.seen.append((name[a], doc[a], key[a], (lo - begin)[a].astype(np.int32), shares[a], anchor[a]))
        self.rows += len(head) + int(a.sum())

    def _slot(self, anchor: np.ndarray, share: np.ndarray) -> np.ndarray:
        return (tx.mix64(anchor.view(np.uint64) + share.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.buckets)).astype(np.int64)

    def deal(self) -> pa.RecordBatch:
        name, anchor, shares, least, size = (np.concatenate([c[k] for c in self.contexts]) for k in range(5))
        data = np.concatenate([c[5] for c in self.contexts])
        begin = np.cumsum(size) - size
        order = np.lexsort((least, name))
        order = order[np.concatenate(([True], name[order][1:] != name[order][:-1]))]  # sorted by name, smallest id first
        name, anchor, shares, least, size, begin = (x[order] for x in (name, anchor, shares, least, size, begin))
        # a context goes to the bucket of each share of its anchor
        which = np.repeat(np.arange(len(name)), shares)
        share = ragged(np.zeros(len(name), np.int64), shares)
        placed = np.unique(self._slot(anchor[which], share) * len(name) + which)
        bucket, which = placed // len(name), placed % len(name)
        o_name, o_id, o_key, o_base, o_shares, o_anchor = (np.concatenate([s[k] for s in self.seen]) for k in range(6))
        at = np.searchsorted(placed, self._slot(o_anchor, o_id % o_shares) * len(name) + np.searchsorted(name, o_name))
        order = np.argsort(at, kind="stable")
        at, o_id, o_key, o_base = at[order], o_id[order], o_key[order], o_base[order]
        rows = np.unique(bucket)
        edge, o_edge = np.searchsorted(bucket, [rows, rows + 1]), np.searchsorted(bucket[at], [rows, rows + 1])
        columns = {"bucket": pa.array(rows.astype(np.int32))}
        pack = zstandard.ZstdCompressor(PACK_LEVEL).compress
        parts = {"anchor": anchor[which], "size": size[which].astype(np.int32), "least": least[which]}
        columns |= {k: pa.array([pack(x[a:b].tobytes()) for a, b in edge.T], pa.binary()) for k, x in parts.items()}
        columns["bytes"] = pa.array([pack(data[ragged(begin[w], size[w])].tobytes()) for w in (which[a:b] for a, b in edge.T)], pa.binary())
        columns["context"] = pa.array([pack((at[a:b] - e).astype(np.int32).tobytes()) for (a, b), e in zip(o_edge.T, edge[0], strict=True)], pa.binary())
        columns |= {k: pa.array([pack(x[a:b].tobytes()) for a, b in o_edge.T], pa.binary()) for k, x in (("id", o_id), ("key", o_key), ("base", o_base))}
        self.clear()
        return pa.RecordBatch.from_arrays([columns[c] for c in ("bucket", *_PACKED)], ["bucket", *_PACKED])


def _contexts(marked: DataFrame, width: int, anchor_buckets: int, buckets: int, hot) -> DataFrame:
    """Packed contexts and occurrences by bucket, from rows (id, key, z, marks); hot: anchors and their further shares."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, held = zstandard.ZstdDecompressor(), _Held(buckets)
        for batch in batches:
            ids, keys = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            zs, marks = batch.column(2), batch.column(3)
            marked_anchor, edges = marks.values.to_numpy(zero_copy_only=False), marks.offsets.to_numpy()
            hot_anchor, hot_shares = hot.value
            lo = 0
            while lo < batch.num_rows:
                texts, size, hi = [], 0, lo
                while hi < batch.num_rows and (not texts or size < tx.BLOCK_BYTES):
                    texts.append(unpack.decompress(zs[hi].as_buffer()))
                    size += len(texts[-1])
                    hi += 1
                data = np.frombuffer(b"".join(texts), np.uint8)
                offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
                a = Anchors(data, offsets, width)
                own = anchor_number(a.hashes, anchor_buckets)
                cuts = np.searchsorted(a.at, offsets)
                mark = np.full(len(own), -1, np.int64)
                for d in range(hi - lo):
                    s, e = edges[lo + d], edges[lo + d + 1]
                    mine = marked_anchor[s:e]
                    order = np.argsort(mine & ~_FIRST)
                    mine = mine[order]
                    x = own[cuts[d] : cuts[d + 1]]
                    at = np.minimum(np.searchsorted(mine & ~_FIRST, x), len(mine) - 1)
                    mark[cuts[d] : cuts[d + 1]] = np.where(mine[at] & ~_FIRST == x, (mine[at] & _FIRST) != 0, -1)
                which, first, last = a.chosen(mark >= 0)
                if len(which):
                    doc = np.searchsorted(offsets, first, "right") - 1
                    end = last + width
                    anchor, shares = own[which], np.ones(len(which), np.int64)
                    if len(hot_anchor):
                        at = np.minimum(np.searchsorted(hot_anchor, anchor), len(hot_anchor) - 1)
                        shares += np.where(hot_anchor[at] == anchor, hot_shares[at], 0)
                    named = tx.mix64(a.substring_hashes(first, end) ^ tx.mix64(anchor.view(np.uint64)))
                    owner = ids[lo + doc]
                    held.add(named, anchor, shares, owner, keys[lo + doc], first, end, offsets[doc], data, mark[which] == 0)
                    if held.rows >= FLUSH // 4:
                        yield held.deal()
                lo = hi
        if held.rows:
            yield held.deal()

    return marked.mapInArrow(make, "bucket int, " + ", ".join(f"{c} binary" for c in _PACKED))


def resolve(anchor: np.ndarray, size: np.ndarray, begin: np.ndarray, data: np.ndarray, least: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The smallest document of every `width`-byte string of the contexts data[begin : begin + size].

    Returns (first string of each context, number of strings of each, smallest document of each string).
    """
    windows = np.maximum(size - width + 1, 0)
    first = np.cumsum(windows) - windows
    smallest = np.repeat(least, windows)
    # a context that is the only one of its anchor shares no string with another
    _, inverse, counts = np.unique(anchor, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(counts[inverse] > 1)
    if len(shared):
        sizes, many = size[shared], windows[shared]
        joined = data[ragged(begin[shared], sizes)]
        classes = prefix_classes(joined, ragged(np.cumsum(sizes) - sizes, many), width)
        low = np.full(int(classes.max()) + 1, _NONE, np.int64)
        np.minimum.at(low, classes, np.repeat(least[shared], many))
        smallest[ragged(first[shared], many)] = low[classes]
    return first, windows, smallest


def _ranges(packed: DataFrame, width: int) -> DataFrame:
    """(key, id, lo, hi): byte ranges to remove from a text as its copy under that id, from packed contexts."""

    def decide(table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        get = lambda name: [np.frombuffer(unpack(x.as_py()), _PACKED[name]) for x in table.column(name)]
        parts = get("anchor")
        counts = [len(x) for x in parts]
        anchor, size, least, data = np.concatenate(parts), np.concatenate(get("size")).astype(np.int64), np.concatenate(get("least")), np.concatenate(get("bytes"))
        begin = np.cumsum(size) - size
        # one context may come from several tasks
        up, down = tx.powers(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(tx._CODE[data] * up[: len(data)], out=sums[1:])
        name = tx.mix64(((sums[begin + size] - sums[begin]) * down[begin] + size.astype(np.uint64)) ^ tx.mix64(anchor.view(np.uint64)))
        order = np.lexsort((least, name))
        new = np.concatenate(([True], name[order][1:] != name[order][:-1]))
        number = np.empty(len(name), np.int64)
        number[order] = np.cumsum(new) - 1
        head = order[new]
        first, windows, smallest = resolve(anchor[head], size[head], begin[head], data, least[head], width)
        shift = np.cumsum(counts) - counts
        at = number[np.concatenate([c + s for c, s in zip(get("context"), shift, strict=True)])]
        doc, key, base = (np.concatenate(get(c)) for c in ("id", "key", "base"))
        # runs of strings that a smaller document has too: each removes one range of bytes
        many = windows[at]
        total = np.cumsum(many)
        gone = smallest[ragged(first[at], many)] < np.repeat(doc, many)
        edge = np.zeros(len(gone) + 1, bool)
        edge[total] = edge[total - many] = True
        before = np.concatenate(([False], gone[:-1])) if len(gone) else gone
        after = np.concatenate((gone[1:], [False])) if len(gone) else gone
        starts, ends = np.flatnonzero(gone & (~before | edge[:-1])), np.flatnonzero(gone & (~after | edge[1:]))
        occ = np.searchsorted(total, starts, "right")
        shift = base[occ] - (total - many)[occ]
        return pa.table({"key": key[occ], "id": doc[occ], "lo": (starts + shift).astype(np.int32), "hi": (ends + shift + width).astype(np.int32)})

    return packed.groupBy("bucket").applyInArrow(decide, "key long, id long, lo int, hi int")


def merge_ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open ranges as maximal runs (touching ones are one)."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.concatenate(([True], lo[1:] > hi[:-1]))
    return lo[new], hi[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(hi) - 1]))]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50) -> DataFrame:
    """Return id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the remaining UTF-8 bytes).

    A byte is removed if a `width`-byte string that covers it also starts in a document with a smaller id; strings
    are judged on the input and never cross documents. Null and empty texts have no bytes; ids are whole numbers,
    null counts as larger than any. Rows with equal ids do not count against each other. Equal texts of larger ids
    are removed whole. Very long texts are cut into blocks of anchors and stay whole. Other columns are ignored; an empty
    table gives an empty one. Texts and contexts (of up to 80 bytes, with their anchor) are named by 64-bit hashes, and
    the result rests on those not colliding; a collision of anchors costs time only.
    """
    spark = docs.sparkSession
    checkpoint_dir(spark)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE)).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    made = _named(rows, width).checkpoint()
    info = made.filter("anchor is null").select("id", "key", "n_bytes", "sha")
    classes = info.groupBy("key").agg(F.min("id").alias("least"), F.max("n_bytes").alias("n")).filter(F.col("n") >= width).checkpoint()
    total = info.agg(F.sum("n_bytes")).first()[0] or 0
    density = 2 / (width - GRAM + 2)
    anchor_buckets = int(max(16, total * density // BUCKET))
    heads = key_filter(_copy_keys(classes))
    share = max(SHARE, int(total * density) // MOST_HOT)
    # anchors of very many documents: their counts add up to the anchors there are, so their shares to MOST_HOT at most
    counted = made.filter("anchor is not null").groupBy("anchor").agg(F.sum("n").alias("n")).filter(F.col("n") >= share).toPandas()
    common, at = np.unique(anchor_number(counted["anchor"].to_numpy(np.int64).view(np.uint64), anchor_buckets), return_inverse=True)
    shares = np.zeros(len(common), np.int64)
    np.add.at(shares, at, counted["n"].to_numpy(np.int64) // share)
    found = _recurring(rows, heads, width, anchor_buckets, share, spark.sparkContext.broadcast(common))
    made = found.groupBy("id").agg(F.collect_list("anchor").alias("marks")).checkpoint()
    release(spark)
    hot = made.filter("id is null").select(F.explode("marks").alias("anchor")).groupBy("anchor").count().toPandas()
    hot_anchor, hot_shares = np.concatenate((hot["anchor"].to_numpy(np.int64), common)), np.concatenate((hot["count"].to_numpy(np.int64), shares))
    order = np.argsort(hot_anchor)
    hot = spark.sparkContext.broadcast((hot_anchor[order], hot_shares[order]))
    marks = made.filter("id is not null")
    many = marks.agg(F.sum(F.size("marks"))).first()[0] or 0
    texts = _texts(rows, heads, key_filter(marks.select(F.col("id").alias("key"))), True)
    marked = texts.join(marks, "id").select("id", "key", "z", "marks")
    ranges = _ranges(_contexts(marked, width, anchor_buckets, int(max(16, many // CONTEXTS)), hot), width)
    # the filter lets some later copies through; what they find in the first copy is dropped here
    ranges = ranges.groupBy("key").agg(F.collect_list(F.struct("id", "lo", "hi")).alias("ranges")).join(classes.select("key", "least"), "key")
    own = F.transform(F.filter("ranges", lambda r: r["id"] == F.col("least")), lambda r: F.struct(r["lo"].alias("lo"), r["hi"].alias("hi")))
    ranges = ranges.select("key", own.alias("ranges")).filter(F.size("ranges") > 0).checkpoint()
    release(spark)
    both = _texts(rows, heads, key_filter(ranges.select("key")), False).join(ranges, "key").select("key", "z", "ranges")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            keys, zs = (batch.column(k).to_pylist() for k in range(2))
            flat, edges = batch.column(2).values, batch.column(2).offsets.to_numpy()
            low, high = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(2))
            out: list[tuple[int, int, str]] = []
            for i in range(len(keys)):
                lo, hi = merge_ranges(low[edges[i] : edges[i + 1]], high[edges[i] : edges[i + 1]])
                raw, end, sha = unpack.decompress(zs[i]), 0, hashlib.sha256()
                for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
                    sha.update(raw[end:a])
                    end = b
                sha.update(raw[end:])
                out.append((int((hi - lo).sum()), len(lo), sha.hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), *(pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string())))], ["k", "removed", "spans", "kept"]
            )

    done = both.mapInArrow(cut, "k long, removed long, spans long, kept string").dropDuplicates(["k"])
    # a row per text first, so that the join with its copies is one of two plain shuffles, which adaptive execution splits
    texts = classes.select("key", "least").join(done, F.col("key") == F.col("k"), "left").drop("k").checkpoint()
    out = info.join(texts, "key", "left")
    copy = F.coalesce(F.col("id") > F.col("least"), F.lit(False))
    empty = hashlib.sha256().hexdigest()
    return out.select(
        F.when(F.col("id") < _NONE, F.col("id")).cast(docs.schema[id_col].dataType).alias(id_col),
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.coalesce("spans", F.lit(0).cast("long"))).alias("n_spans"),
        F.when(copy, F.lit(empty)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )
