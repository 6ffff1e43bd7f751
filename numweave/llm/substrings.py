"""Suffix-array dedup: cut every byte that a long string shared with an earlier document covers.

The comparison is dealt out by content. In each window of ``length`` bytes the smallest hash of its 16-byte grams is the
window's anchor, so equal windows have equal anchors; consecutive windows with one anchor make a segment. Anchors that
two documents share are found first, with few bytes an anchor; only their segments are shuffled, and each task sorts the
suffixes of its segments, derives longest-previous-factor arrays, and reports the windows that an earlier document has.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.order import ordinal
from .common import by_key, chunks, stored, utf8

GRAM = 16
MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
#: Most hot anchors that are broadcast, at eight bytes each.
MOST_HOT = 1 << 22
#: Anchors collected before a map task combines and sends them; text bytes worked on at once; windows of hot anchors that
#: a task remembers as sent.
FLUSH, PIECE, SEEN = 1_500_000, 2_000_000, 200_000
#: Text bytes to a part, the unit that a task compares at once, and most tasks of a shuffle; a task has eight parts or more.
PART, MOST_TASKS = 1 << 20, 1 << 16


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 16 bytes from each place (zeros beyond the end)."""
    padded = np.zeros(len(text) + 2 * GRAM, np.uint8)
    padded[: len(text)] = text
    words = np.array(np.ndarray((len(text) + 8,), "<u8", padded.data, strides=(1,)))
    out = words[: len(text)] * MIX[0]
    out ^= out >> np.uint64(31)
    out += words[8 : len(text) + 8] * MIX[1]
    out ^= out >> np.uint64(29)
    out *= MIX[2]
    out ^= out >> np.uint64(32)
    return out


def window_min(hashes: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive hashes, by doubling."""
    out, span = hashes, 1
    while span < w:
        step = min(span, w - span)
        out = np.minimum(out[: len(out) - step], out[step:])
        span += step
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of the ranges [start, start + length)."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def runs(text: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Row, first window, number of windows and anchor of each segment, and the gram hashes. at: offsets of the rows."""
    hashes = gram_hashes(text)
    empty = np.zeros(0, np.int64)
    if len(text) < length:
        return empty, empty, empty, empty.astype(np.uint64), hashes
    low = window_min(hashes[: len(text) - GRAM + 1], length - GRAM + 1)
    inside = np.ones(len(low) + 1, bool)
    inside[-1] = False
    for end in at[1:-1].tolist():
        inside[max(0, end - length + 1) : end] = False
    inside = inside[:-1]
    fresh = inside.copy()
    fresh[1:] &= (low[1:] != low[:-1]) | ~inside[:-1]
    last = inside.copy()
    last[:-1] &= fresh[1:] | ~inside[1:]
    first, end = np.flatnonzero(fresh), np.flatnonzero(last)
    row = np.searchsorted(at, first, "right") - 1
    return row, first, end - first + 1, low[first] >> np.uint64(16), hashes


def window_hashes(hashes: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """A hash of the whole window from each place."""
    out = np.zeros(len(at), np.uint64)
    for k in (*range(0, length - GRAM, GRAM), length - GRAM):
        out = (out ^ hashes[at + k]) * MIX[0]
        out ^= out >> np.uint64(32)
    return out


def firsts(*keys: np.ndarray) -> np.ndarray:
    """Of sorted keys: true where a new combination begins."""
    out = np.zeros(len(keys[0]), bool)
    out[:1] = True
    for x in keys:
        out[1:] |= x[1:] != x[:-1]
    return out


def lists(key: np.ndarray, *values: np.ndarray, kind=np.int64) -> list[pa.Array]:
    """Key column and list columns with the values of each key."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(firsts(key)) if len(key) else np.zeros(0, np.int64)
    offsets = pa.array(np.append(at, len(key)).astype(np.int32), pa.int32())
    return [pa.array(key[at], pa.int64()), *(pa.ListArray.from_arrays(offsets, pa.array(v[order].astype(kind))) for v in values)]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of bytes or of integers (as differences to the least, in as few bytes as hold them), compressed."""
    parts = []
    for x in arrays:
        base = int(x.min(initial=0)) if x.dtype.kind == "i" else 0
        x = x - base if base else x
        if x.dtype != np.uint8:
            x = x.astype(np.min_scalar_type(int(x.max(initial=0))))
        parts.append(np.array([base, x.itemsize, x.nbytes], "<i8").tobytes() + x.tobytes())
    data = b"".join(parts)
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    out, at = [], 0
    while at < len(raw):
        base, width, size = np.frombuffer(raw, "<i8", 3, at)
        x = np.frombuffer(raw, f"<u{width}", size // width, at + 24)
        out.append(x if width == 1 and not base else x.astype(np.int64) + base)
        at += 24 + int(size)
    return out


def contents(hashes: np.ndarray, first: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """A hash of each segment: its first bytes, and the hashes of its windows."""
    sums = np.append(np.uint64(0), np.cumsum(window_hashes(hashes, ragged(first, n), length)))
    ends = np.cumsum(n)
    return (sums[ends] - sums[ends - n]) ^ (hashes[first] * MIX[1]) ^ n.astype(np.uint64)


def alike(data: np.ndarray, first: np.ndarray, size: np.ndarray, order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Of segments in order, whether each has the very bytes of the first of its group (groups begin at ``new``)."""
    at = np.flatnonzero(new)
    lead = np.repeat(order[at], np.diff(np.append(at, len(order))))
    good = size[order] == size[lead]
    other = np.flatnonzero(good & (order != lead))
    if len(other):
        n = size[order[other]]
        differ = data[ragged(first[order[other]], n)] != data[ragged(first[lead[other]], n)]
        good[other] = np.add.reduceat(differ, np.cumsum(n) - n) == 0
    return good


# ---- anchors that documents share


def send_anchors(batches: Iterator[pa.RecordBatch], length: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Anchors of a task's documents, combined: an anchor goes out once, for its smallest document, with a count. That
    several documents here share it is known at once, and goes to the next step as it is (a negative part)."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        anchor, doc = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((doc, anchor))
        anchor, doc = anchor[order], doc[order]
        keep = firsts(anchor, doc)
        anchor, doc = anchor[keep], doc[keep]
        at = np.flatnonzero(firsts(anchor))
        count = np.diff(np.append(at, len(anchor)))
        many = np.repeat(count > 1, count)
        rows = [(-1 - len(anchor) % 1024, doc[many].tobytes(), anchor[many].tobytes(), b"")] if many.any() else []
        anchor, doc = anchor[at], doc[at]
        part = (anchor % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        anchor, doc, count, part = anchor[order], doc[order], count[order], part[order]
        cut = np.flatnonzero(firsts(part))
        for a, b in zip(cut, [*cut[1:], len(part)]):
            base = int(doc[a:b].min())
            wide = int(doc[a:b].max()) - base >= 1 << 32
            docs = np.append(np.array([base], "<i8").view(np.uint8), (doc[a:b] - base).astype("<i8" if wide else "<u4").view(np.uint8))
            high, low = (anchor[a:b] >> np.uint64(32)).astype("<u2"), (anchor[a:b] & np.uint64(0xFFFFFFFF)).astype("<u4")
            more = np.flatnonzero(count[a:b] > 1)
            rows.append((int(part[a]), docs.tobytes(), high.tobytes() + low.tobytes(), np.concatenate([more, count[a:b][more]]).astype("<u4").tobytes()))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["part", "docs", "anchors", "counts"])

    for chunk in chunks(batches, "text", PIECE):
        text, at = utf8(chunk.column("text").combine_chunks())
        row, _, _, anchor, _ = runs(text, at, length)
        doc = chunk.column("doc").to_numpy()[row]
        if len(doc):
            held.append((anchor, doc))
            size += len(doc)
        if size >= FLUSH:
            yield flush()
            size = 0
    if held:
        yield flush()


def meet_anchors(batches: Iterator[pa.RecordBatch], hot: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """(kind, bucket, data, anchor, n), part by part: shared anchors by bucket of documents (kind 0), as their low 32 bits
    (others that have these too cost work, not results); anchors with over ``hot`` documents (kind 1); the number of all
    (2). Kinds 1 and 2 have bucket -1."""
    known: list[tuple[np.ndarray, np.ndarray]] = []
    names = ["kind", "bucket", "data", "anchor", "n"]

    def flush() -> Iterator[pa.RecordBatch]:
        doc, anchor = (np.concatenate(x) for x in zip(*known))
        known.clear()
        bucket, low = doc % buckets, (anchor & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        order = np.lexsort((low, doc, bucket))
        bucket, doc, low = bucket[order], doc[order], low[order]
        cut = np.flatnonzero(firsts(bucket))
        rows = [(int(bucket[a]), pack(doc[a:b], low[a:b])) for a, b in zip(cut, [*cut[1:], len(doc)])]
        for k in range(0, len(rows), 256):
            ids, data = zip(*rows[k : k + 256])
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(ids), np.int32)), pa.array(ids, pa.int64()), pa.array(data, pa.binary()), *[pa.nulls(len(ids), pa.int64())] * 2], names=names)

    for table in by_key(batches, ["part"]):
        anchors, docs, counts = [], [], []
        for part, d, a, c in zip(*(x.to_pylist() for x in table.columns)):
            if part < 0:
                known.append((np.frombuffer(d, "<i8"), np.frombuffer(a, "<u8")))
                continue
            n = len(a) // 6
            anchors.append((np.frombuffer(a, "<u2", n).astype(np.uint64) << np.uint64(32)) | np.frombuffer(a, "<u4", n, 2 * n))
            docs.append(np.frombuffer(d, "<i8", 1)[0] + np.frombuffer(d, "<u4" if len(d) == 8 + 4 * n else "<i8", n, 8).astype(np.int64))
            count, more = np.ones(n, np.int64), np.frombuffer(c, "<u4")
            count[more[: len(more) // 2]] = more[len(more) // 2 :]
            counts.append(count)
        if anchors:
            anchor, doc, count = np.concatenate(anchors), np.concatenate(docs), np.concatenate(counts)
            order = np.argsort(anchor, kind="stable")
            anchor, doc, count = anchor[order], doc[order], count[order]
            at = np.flatnonzero(firsts(anchor))
            size = np.diff(np.append(at, len(anchor)))
            total = np.add.reduceat(count, at)
            shared = np.repeat(size > 1, size)
            known.append((doc[shared], anchor[shared]))
            many = np.flatnonzero(total > hot)
            kind = np.append(np.ones(len(many), np.int32), np.int32(2))
            which = np.append(anchor[at[many]].astype(np.int64), 0)
            number = np.append(total[many], count.sum())
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.full(len(kind), -1)), pa.nulls(len(kind), pa.binary()), pa.array(which), pa.array(number)], names=names)
        if sum(len(x[0]) for x in known) > 2 * FLUSH:
            yield from flush()
    if known:
        yield from flush()


def gather_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document with shared anchors, bucket by bucket; the other rows as they are."""
    names = ["doc", "anchors", "anchor", "n"]
    for table in by_key(batches, ["bucket"]):
        held = [unpack(x) for x in table.column("data").to_pylist() if x is not None]
        if not held:
            hot = table.column("kind").to_numpy() == 1
            anchor = pa.array(table.column("anchor").to_numpy(), mask=~hot)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(table), pa.int64()), pa.nulls(len(table), pa.list_(pa.int32())), anchor, table.column("n").combine_chunks()], names=names)
            continue
        doc, low = (np.concatenate([y.astype(np.int64) for y in x]) for x in zip(*held))
        order = np.lexsort((low, doc))
        order = order[firsts(doc[order], low[order])]
        key, values = lists(doc[order], low[order].astype(np.uint32), kind=np.uint32)
        values = pa.ListArray.from_arrays(values.offsets, values.values.view(pa.int32()))
        yield pa.RecordBatch.from_arrays([key, values, *[pa.nulls(len(key), pa.int64())] * 2], names=names)


# ---- segments of shared anchors


def send_segments(batches: Iterator[pa.RecordBatch], length: int, parts: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Segments of shared anchors with their bytes. Of equal segments in one chunk only the smallest document's go out;
    the others are covered (a negative part). Segments of hot anchors are dealt out window by window; of these a task
    remembers which it has sent for which document, and later documents' are covered too, without meeting there."""
    seen_hash, seen_doc, seen = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, length), np.uint8)
    for chunk in chunks(batches, "text", PIECE):
        chunk = chunk.filter(chunk.column("anchors").is_valid())
        if not len(chunk):
            continue
        shared = np.unique(chunk.column("anchors").combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint32))
        text, at = utf8(chunk.column("text").combine_chunks())
        row, first, n, anchor, hashes = runs(text, at, length)
        keep = np.isin((anchor & np.uint64(0xFFFFFFFF)).astype(np.uint32), shared)
        row, first, n, anchor = row[keep], first[keep], n[keep], anchor[keep]
        if not len(row):
            continue
        split = np.zeros(len(anchor), bool)
        if len(hot):
            split = hot[np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)] == anchor
        windows = 0
        if split.any():
            w, k = ragged(first[split], n[split]), n[split]
            own = np.repeat(anchor[split], k) ^ (window_hashes(hashes, w, length) >> np.uint64(16))
            row, first = np.append(row[~split], np.repeat(row[split], k)), np.append(first[~split], w)
            n, anchor = np.append(n[~split], np.ones(len(w), np.int64)), np.append(anchor[~split], own)
            windows = len(w)
        doc = chunk.column("doc").to_numpy()[row]
        start = first - at[row]
        content = contents(hashes, first, n, length)
        order = np.lexsort((doc, content))
        new = firsts(content[order])
        least = np.repeat(doc[order][new], np.diff(np.append(np.flatnonzero(new), len(order))))
        same = alike(text, first, n + length - 1, order, new)
        later = order[same & (doc[order] > least)]
        sent = order[~same | (doc[order] == least)]
        if windows:
            x = sent[sent >= len(n) - windows]
            if len(seen):
                at = np.minimum(np.searchsorted(seen_hash, content[x]), len(seen) - 1)
                known = (seen_hash[at] == content[x]) & (seen_doc[at] < doc[x])
                known[known] = (text[first[x[known]][:, None] + np.arange(length)] == seen[at[known]]).all(1)
                later, sent = np.append(later, x[known]), np.append(sent[sent < len(n) - windows], x[~known])
                x = x[~known]
            if len(seen) < SEEN:
                x = x[: SEEN - len(seen)]
                seen_hash, seen_doc = np.append(seen_hash, content[x]), np.append(seen_doc, doc[x])
                seen = np.concatenate([seen, text[first[x][:, None] + np.arange(length)]])
                by = np.argsort(seen_hash, kind="stable")
                seen_hash, seen_doc, seen = seen_hash[by], seen_doc[by], seen[by]
        rows = [(-1 - len(text) % 1024, pack(doc[later], start[later], n[later]))] if len(later) else []
        part = (anchor[sent] % np.uint64(parts)).astype(np.int64)
        by = np.lexsort((anchor[sent], part))
        sent, part = sent[by], part[by]
        size = n[sent] + length - 1
        data = text[ragged(first[sent], size)]
        byte = np.append(0, np.cumsum(size))
        cut = np.flatnonzero(firsts(part))
        for a, b in zip(cut, [*cut[1:], len(part)]):
            x = sent[a:b]
            rows.append((int(part[a]), pack(doc[x], start[x], n[x], data[byte[a] : byte[b]])))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.binary()))], names=["part", "data"])


def previous_factor(ranks: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """Longest previous factor of each suffix, in suffix order: the longer of the common prefixes with the previous and
    the next suffix of smaller rank. lcp[i]: common prefix of suffixes i-1 and i. Values under ``least`` come out as 0.

    The smaller neighbours are found by jumping over candidates: what lies between a suffix and its candidate never
    has a smaller rank, so a candidate that isn't smaller hands over its own candidate.
    """
    out = np.zeros(len(ranks), np.int64)
    for turn in (slice(None), slice(None, None, -1)):
        r = ranks[turn]
        common = lcp if turn.step is None else np.append(0, lcp[:0:-1])
        to, reach = np.arange(-1, len(r) - 1), common.copy()
        open_ = np.flatnonzero(reach >= least)
        while len(open_):
            open_ = open_[r[to[open_]] >= r[open_]]
            over = to[open_]
            reach[open_], to[open_] = np.minimum(reach[open_], reach[over]), to[over]
            ended = reach[open_] < least
            open_ = open_[~ended]
        out[turn] = np.maximum(out[turn], np.where(reach >= least, reach, 0))
    return out


def earlier_windows(doc: np.ndarray, n: np.ndarray, data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, window) pairs whose window also starts in a segment of a smaller document."""
    begin = np.append(0, np.cumsum(n + length - 1))[:-1]
    segment, place = np.repeat(np.arange(len(n)), n), ragged(begin, n)
    hashes = window_hashes(gram_hashes(data), place, length)
    order = np.argsort(hashes)
    new = firsts(hashes[order])
    alone = new & np.append(new[1:], True)
    some = np.sort(order[~alone])  # a window with a hash of its own has no equal
    segment, place = segment[some], place[some]
    if not len(some):
        return segment, place
    rows = data[place[:, None] + np.arange(length)]
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{length}")[:, 0], kind="stable")  # suffixes to this depth
    rows = rows[order]
    differ = rows[1:] != rows[:-1]
    lcp = np.append(0, np.where(differ.any(1), differ.argmax(1), length))
    found = order[previous_factor(doc[segment[order]], lcp, length) >= length]
    return segment[found], place[found] - begin[segment[found]]


def meet_segments(batches: Iterator[pa.RecordBatch], length: int, own: int = 0) -> Iterator[pa.RecordBatch]:
    """(doc, starts, ends) of what an earlier document covers, part by part. The lowest ``own`` bits of doc tell rows of one
    document apart and make none earlier."""
    names = ["doc", "starts", "ends"]
    for table in by_key(batches, ["part"]):
        held = [[y.astype(np.int64) if k < 3 else y for k, y in enumerate(unpack(x))] for x in table.column("data").to_pylist()]
        if table.column("part")[0].as_py() < 0:
            doc, start, n = (np.concatenate(x) for x in zip(*held))
            yield pa.RecordBatch.from_arrays(lists(doc, start, start + n + length - 1), names=names)
            continue
        doc, start, n, data = (np.concatenate(x) for x in zip(*held))
        size = n + length - 1
        begin = np.cumsum(size) - size
        content = contents(gram_hashes(data), begin, n, length)
        order = np.lexsort((doc, content))
        new = firsts(content[order])
        rank = doc >> own
        least = np.repeat(rank[order][new], np.diff(np.append(np.flatnonzero(new), len(order))))
        same = alike(data, begin, size, order, new)
        later = order[same & (rank[order] > least)]
        kept = order[~same | (rank[order] == least)]
        kept = kept[np.argsort(doc[kept], kind="stable")]
        segment, window = earlier_windows(rank[kept], n[kept], data[ragged(begin[kept], size[kept])], length)
        by = np.lexsort((window, segment))
        segment, window = segment[by], window[by]
        a = np.flatnonzero(firsts(segment, window - np.arange(len(window))))
        b = np.append(a[1:], len(window)) - 1 if len(a) else a
        x = kept[segment[a]]
        docs = np.append(doc[later], doc[x])
        starts = np.append(start[later], start[x] + window[a])
        ends = np.append(start[later] + size[later], start[x] + window[b] + length)
        if len(docs):
            yield pa.RecordBatch.from_arrays(lists(docs, starts, ends), names=names)


# ---- the operator


def cut_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds what stays of each text, and the spans cut."""
    for batch in batches:
        kept, spans = [], []
        for text, starts, ends in zip(*(batch.column(c) for c in ("text", "starts", "ends"))):
            data = (text.as_py() or "").encode()
            cut: list[list[int]] = []
            for a, b in sorted(zip(starts.as_py() or (), ends.as_py() or ())):
                b = min(b, len(data))
                if cut and a <= cut[-1][1]:
                    cut[-1][1] = max(cut[-1][1], b)
                elif a < b:
                    cut.append([a, b])
            edges = [0, *(x for span in cut for x in span), len(data)]
            kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
            spans.append(cut)
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.list_(pa.int64())))], names=["doc", "kept", "spans"])


def digest_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in cut_spans(batches):
        kept, spans = batch.column("kept").to_pylist(), batch.column("spans").to_pylist()
        removed = [sum(b - a for a, b in x) for x in spans]
        columns = [batch.column("doc"), [len(k) + r for k, r in zip(kept, removed)], removed, [len(x) for x in spans]]
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns), pa.array([hashlib.sha256(k).hexdigest() for k in kept])], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def told_apart(rows: DataFrame, named: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """``rows`` (doc, text) and ``named`` (doc, n, h) with a number of its own for each different text of an id, and how many
    of its lowest bits tell the texts of one id apart. Where no id has two texts all stays as it is, and the bits are 0;
    else the number is the place of the id among all, then that of the text, and ``id`` holds the id."""
    texts = named.select("doc", "h").distinct()
    most = texts.groupBy("doc").count().agg(F.max("count")).first()[0] or 1
    if most == 1:
        return rows, named, 0
    own = (most - 1).bit_length()
    places = ordinal(texts, ["h"], ("doc",), "k").join(ordinal(texts.select("doc").distinct(), ["doc"], (), "rank"), "doc")
    places = stored(places.select(F.col("doc").alias("id"), "h", F.shiftleft("rank", own).bitwiseOR(F.col("k")).alias("doc")), "places")
    rows = rows.withColumnRenamed("doc", "id").withColumn("h", F.unhex(F.sha2("text", 256))).join(places, ["id", "h"], "left").drop("h")
    return rows, named.withColumnRenamed("doc", "id").join(places, ["id", "h"]).drop("id"), own


def shared_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, parts: int | None = None) -> DataFrame:
    """``doc``, ``text``, ``starts``, ``ends``: rows with the byte ranges to cut (null lists: none); ranges may overlap.

    A byte goes if a string of ``length`` bytes over it also starts in a document with a smaller id; the first copy
    stays. Null texts count as empty; texts under ``length`` bytes lose nothing; rows with a null id lose nothing and
    take nothing from others. Rows with one id are one document: none is cut for the other's sake, and each loses what
    its own text shares with a smaller id (``told_apart``). Documents meet by anchor only, combined in each task before the shuffle. An anchor
    in very many documents (over 1000, and fewer than MOST_HOT such anchors in all) is dealt out by whole windows.

    Copies of whole texts are told by SHA-256 and go at once; equal segments that meet are compared byte by byte, and only
    the first of them goes on. Suffixes are ordered to the depth of ``length`` bytes, over windows that repeat within a
    part, so the factor arrays tell "``length`` or less", which is all that is asked.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} at least")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    named = stored(rows.where("doc IS NOT NULL").select("doc", F.octet_length("text").cast("long").alias("n"), F.unhex(F.sha2("text", 256)).alias("h")), "named")
    rows, named, own = told_apart(rows, named)
    known = rows.where("doc IS NOT NULL").select("doc", "text")
    # later copies of a whole text go as a whole; of their group only the first is compared
    named, rank = named.where(F.col("n") >= length), F.shiftright("doc", own)
    first = stored(named.groupBy("h", "n").agg(F.min(rank).alias("first"), F.max(rank).alias("last")).where("first < last").drop("last"), "first")
    copies = named.join(first, ["h", "n"]).where(rank > F.col("first")).select("doc", F.array(F.lit(0).cast("long")).alias("starts"), F.array("n").alias("ends"))
    size = named.agg(F.sum("n")).first()[0] or 0
    parts = parts or 8 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / (8 * PART)))
    tasks = min(math.ceil(parts / 8), MOST_TASKS)
    buckets = max(tasks, parts // 64)
    sent = known.mapInArrow(lambda x: send_anchors(x, length, parts), "part int, docs binary, anchors binary, counts binary")
    spread = lambda payload: F.when(F.col("part") < 0, F.xxhash64(payload)).otherwise(F.col("part").cast("long"))
    met = sent.repartition(tasks, spread("docs")).sortWithinPartitions("part").mapInArrow(lambda x: meet_anchors(x, 1000, buckets), "kind int, bucket long, data binary, anchor long, n long")
    met = met.repartition(tasks, F.when(F.col("bucket") < 0, F.xxhash64("anchor", "n")).otherwise(F.col("bucket"))).sortWithinPartitions("bucket")
    met = stored(met.mapInArrow(gather_anchors, "doc long, anchors array<int>, anchor long, n long"), "anchors")
    total = met.where("doc IS NULL AND anchor IS NULL").agg(F.sum("n")).first()[0] or 0
    hot_rows = met.where(F.col("anchor").isNotNull() & (F.col("n") > total / MOST_HOT)).select("anchor").toArrow()
    hot = spark.sparkContext.broadcast(np.sort(hot_rows.column(0).to_numpy().astype(np.uint64)))
    by_doc = met.where("doc IS NOT NULL").select("doc", "anchors").join(copies.select("doc"), "doc", "left_anti")
    # both joins read this one exchange of the texts, so nothing is filtered between it and Python
    placed = rows.repartition("doc")
    found = placed.join(by_doc.hint("shuffle_hash"), "doc", "left").select("doc", "text", "anchors")
    segments = found.mapInArrow(lambda x: send_segments(x, length, parts, hot.value), "part int, data binary")
    covered = segments.repartition(tasks, spread("data")).sortWithinPartitions("part").mapInArrow(lambda x: meet_segments(x, length, own), "doc long, starts array<long>, ends array<long>")
    ranges = covered.union(copies).groupBy("doc").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))
    whose = F.col("id" if own else "doc").alias("doc")
    return placed.join(ranges.hint("shuffle_hash"), "doc", "left").select(whose, "text", "starts", "ends")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """``doc``, ``kept`` (bytes) and ``spans`` (pairs of byte offsets cut, merged); see ``shared_spans``."""
    return shared_spans(docs, id_col, text_col, length).mapInArrow(cut_spans, "doc long, kept binary, spans array<array<long>>")


def dedup_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """Sizes, spans and the SHA-256 of the bytes that stay; the bytes themselves do not leave the tasks."""
    return shared_spans(docs, id_col, text_col, length).mapInArrow(digest_spans, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
