"""Removal of repeated byte strings: winnowed segments, and suffix arrays by linear grouping that decide their windows.

A window is a string of LENGTH bytes. Its anchor is one of its GRAM-byte grams, chosen by the window's bytes alone, so equal windows
have equal anchors at equal places. A segment is a run of windows of one text with the same anchor. Only segments whose anchor's
gram occurs more than once can hold repeated windows. Of segments of equal bytes two go on, of the others one; all segments of a
gram meet in one suffix array, and windows that stand next to each other there are compared byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import materialise, small_batches
from lamina.llm.text import mix, powers, prefix_hash, text_bytes

LENGTH, GRAM = 200, 32
PIECE, ROWS = 256 << 10, 500
# Segments of a gram that meet in one suffix array, and bytes of segments whose arrays are sorted side by side.
BLOCK, HELD = 512, 2 << 20
# Grams with more segments are cut by these numbers of places that an anchor has in its windows; longer keys then tell the parts apart.
WIDTHS = (29, 5, 1)
END, BREAK, BYTE, CORE = 0, 1, 2, 258


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each range of size numbers, one range after the other."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())


def group_sort(text: np.ndarray, lanes: np.ndarray) -> np.ndarray:
    """The suffix arrays of many texts side by side: those of text[lanes[k]:lanes[k + 1]], as places in text.

    The last symbol of each text is END, its only smallest one. Suffixes are grouped by their longest Lyndon prefix. The groups of a
    text are taken in descending order, one of each text at a time: each suffix of the group points to the previous suffix of a
    smaller group, and what is pointed at moves into new groups right after its own, by how often it is pointed at. Then the groups
    are emitted in ascending order: a suffix goes on after its Lyndon prefix with a smaller suffix, whose place is known, or with its
    own group, where shorter runs come first. Nothing is renamed or sorted again; the steps are linear in the symbols.
    """
    n = len(text)
    key = np.repeat(np.arange(len(lanes) - 1), np.diff(lanes)) * 1024 + text
    sa = np.argsort(key, kind="stable")
    key = key[sa]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    slot, group, stop = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n + 1, np.int64)
    slot[sa] = np.arange(n)
    ends = np.append(new[1:], n)
    group[sa] = np.repeat(new, ends - new)
    stop[new] = ends
    group[lanes[1:] - 1] = -1
    before, prefix, flag = np.full(n, -1), np.ones(n, np.int64), np.zeros(n, bool)
    top, low = lanes[1:].copy(), lanes[:-1] + 1
    open_ = np.flatnonzero(top > low)
    while len(open_):
        g = group[sa[top[open_] - 1]]
        m = np.sort(sa[ranges(g, top[open_] - g)])
        own, p = group[m], m - 1
        go = np.flatnonzero(group[p] > own)
        while len(go):
            q = before[p[go]]
            p[go] = q
            go = go[group[q] > own[go]]
        before[m] = p
        go = np.flatnonzero(group[p] == own)
        while len(go):
            q = before[p[go]]
            p[go] = q
            before[m[go]] = q
            go = go[group[q] == own[go]]
        top[open_] = g
        open_ = open_[g > low[open_]]
        real = group[p] >= 0
        p = p[real]
        if not len(p):
            continue
        at = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        times = np.diff(np.append(at, len(p)))
        p = p[at]
        prefix[p] += np.add.reduceat(prefix[m[real]], at)
        most = times.max()
        for t in [1] if most == 1 else np.unique(times)[::-1]:
            moved = p if most == 1 else p[times == t]
            b = group[moved]
            order = np.argsort(b, kind="stable")
            moved, b = moved[order], b[order]
            at = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
            k, b = np.diff(np.append(at, len(b))), b[at]
            end = stop[b]
            first = end - k
            x, into = slot[moved], np.repeat(first, k)
            out = x < into
            if out.any():
                places = ranges(first, k)
                flag[moved] = True
                free = places[~flag[sa[places]]]
                flag[moved] = False
                q, x, one = sa[free], x[out], moved[out]
                sa[x], slot[q], sa[free], slot[one] = q, x, one, free
            group[moved] = into
            part = first > b
            stop[first], stop[b[part]] = end, first[part]
    ordered = group[sa]
    first = np.flatnonzero((ordered == np.arange(n)) | (ordered < 0))
    size = np.diff(np.append(first, n))
    first, size = first[size > 1], size[size > 1]
    lane = np.searchsorted(lanes, first, "right") - 1
    turn = np.arange(len(lane)) - np.searchsorted(lane, lane)
    order = np.argsort(turn, kind="stable")
    bounds = np.append(0, np.cumsum(np.bincount(turn)))
    for a, b in zip(bounds, bounds[1:], strict=False):
        g, k = first[order[a:b]], size[order[a:b]]
        places = ranges(g, k)
        m = sa[places]
        own, x = np.repeat(g, k), m + prefix[m]
        go = np.flatnonzero(group[x] == own)
        if len(go):
            run = np.zeros(len(m), np.int64)
            while len(go):
                run[go] += 1
                x[go] += prefix[m[go]]
                go = go[group[x[go]] == own[go]]
            m = m[np.lexsort((slot[x], run, own))]
        else:
            m = m[np.argsort(slot[x])]
        sa[places], slot[m] = m, places
    return sa


def common(raw: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, step: int = 1) -> np.ndarray:
    """How many symbols from a and from b on, forwards or backwards, are equal, most at most."""
    out = np.zeros(len(a), np.int64)
    go, k = np.flatnonzero(most > 0), 0
    while len(go):
        go = go[raw[a[go] + k * step] == raw[b[go] + k * step]]
        k += 1
        out[go] = k
        go = go[most[go] > k]
    return out


def shared(hashes: tuple[np.ndarray, np.ndarray], group: np.ndarray, place: np.ndarray, room: np.ndarray, step: int = 1) -> np.ndarray:
    """For each place a bound of how many bytes from it on, forwards or backwards, another place of its group has as well.

    Bytes are compared in blocks of 8 by hashes of all bytes from the place on, so that the bound is too large by 7 at most.
    """
    h, inverse = hashes
    out = room.copy()
    at, k = np.flatnonzero(room >= 8), 8
    while len(at):
        low = place[at] if step > 0 else place[at] - k
        value = mix((h[low + k] - h[low]) * inverse[low] + mix(group[at].astype(np.uint64)))
        order = np.argsort(value, kind="stable")
        same = np.flatnonzero(value[order[1:]] == value[order[:-1]])
        more = np.zeros(len(at), bool)
        more[order[same]] = more[order[same + 1]] = True
        out[at[~more]] = k - 1
        at, k = at[more], k + 8
        at = at[room[at] >= k]
    return out


def repeated(raw: np.ndarray, offsets: np.ndarray, shift: np.ndarray, count: np.ndarray, first: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which windows of segments occur more than once among the segments of the same gram; one segment's windows after the other's.

    Segment i is raw[offsets[i]:offsets[i + 1]], with shift[i] bytes before its anchor and count[i] windows. first holds the first
    segment of each gram and the number of segments. What all segments of a gram share around their anchors is one symbol of their
    suffix array; bytes farther away than any two of them agree aren't symbols.
    """
    n, size = len(shift), np.diff(first)
    group = np.repeat(np.arange(len(size)), size)
    start, end = offsets[:-1], offsets[1:]
    anchor, one = start + shift, first[group]
    left = np.minimum.reduceat(common(raw, anchor - 1, anchor[one] - 1, np.minimum(shift, shift[one]), -1), first[:-1])[group]
    right = np.minimum.reduceat(common(raw, anchor, anchor[one], np.minimum(end - anchor, (end - anchor)[one])), first[:-1])[group]
    hashes = prefix_hash(raw), powers(len(raw) + 1)[1]
    before = shared(hashes, group, anchor - left, shift - left, -1)
    after = shared(hashes, group, anchor + right, end - anchor - right)
    # windows from low to high - 1 lie within these bytes
    low = np.maximum(shift - left - before, 0)
    high = np.minimum(count, shift - np.maximum(length - right - after, 0) + 1)
    windows = np.concatenate([[0], np.cumsum(count)])
    many = np.zeros(windows[-1], bool)
    on = np.flatnonzero(low < high)
    lonely = np.bincount(group[on], minlength=len(size)) < 2
    on = on[~lonely[group[on]]]
    if not len(on):
        return many
    group, start, anchor, shift, left, right, before, after, low, high, base = (x[on] for x in (group, start, anchor, shift, left, right, before, after, low, high, windows[:-1]))
    edges = np.append(np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])), len(group))
    at = np.concatenate([[0], np.cumsum(before + after + 2)])
    text = np.full(at[-1], BREAK, np.int64)
    text[ranges(at[:-1], before)] = raw[ranges(anchor - left - before, before)].astype(np.int64) + BYTE
    core = at[:-1] + before
    text[core] = CORE
    text[ranges(core + 1, after)] = raw[ranges(anchor + right, after)].astype(np.int64) + BYTE
    lanes = at[edges]
    text[lanes[1:] - 1] = END
    slot = np.empty(len(text), np.int64)
    slot[group_sort(text, lanes)] = np.arange(len(text))
    # windows that begin before the shared bytes: neighbours in the suffix array
    own = np.clip(shift - left - low, 0, high - low)
    window, symbol, byte = ranges(base + low, own), ranges(core - (shift - left - low), own), ranges(start + low, own)
    order = np.argsort(slot[symbol])
    held, places = raw.tobytes(), byte[order].tolist()
    same = np.array([held[a : a + length] == held[b : b + length] for a, b in zip(places, places[1:], strict=False)], bool)
    many[window[order[1:]]] |= same
    many[window[order[:-1]]] |= same
    # windows that begin in them: how far the neighbour goes on after them decides all of a segment's at once
    order = np.argsort(slot[core])
    a, b = order[:-1], order[1:]
    near = group[a] == group[b]
    a, b = a[near], b[near]
    far = common(text, core[a] + 1, core[b] + 1, np.minimum(after[a], after[b]))
    reach = np.full(len(on), -1)
    np.maximum.at(reach, a, far)
    np.maximum.at(reach, b, far)
    last = np.where(reach >= 0, np.minimum(high, shift - np.maximum(length - right - reach, 0) + 1), 0)
    many[ranges(base + low + own, np.maximum(last - low - own, 0))] = True
    return many


def _reach(place: np.ndarray, value: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each candidate the first and the last window in which it is the leftmost smallest one."""
    n, low, high = len(place), place - (width - 1), place.copy()
    for right in (False, True):
        at, k = np.arange(n), 1
        while len(at):
            j = at + k if right else at - k
            inside = j < n if right else j >= 0
            at, j = at[inside], j[inside]
            near = np.abs(place[j] - place[at]) < width
            at, j = at[near], j[near]
            stop = value[j] < value[at] if right else value[j] <= value[at]
            s, t = at[stop], place[j[stop]]
            if right:
                high[s] = np.minimum(high[s], t - width)
            else:
                low[s] = np.maximum(low[s], t + 1)
            at, k = at[~stop], k + 1
    return low, high


def winnow(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Segments of a chunk: document, first window, number of windows, bytes before the anchor, hashes of its gram and of the segment.

    A window's anchor is its leftmost gram with the smallest hash among those that begin with a space and have a hash in the lowest
    quarter; in a window without any, among those with a hash in the lowest eighth, and then among all.
    """
    n, width = len(raw), length - gram + 1
    nothing = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    has = np.flatnonzero(np.diff(offsets) >= length)
    if not len(has):
        return nothing
    h, inverse = prefix_hash(raw), powers(n + 1)[1]
    first, last = offsets[:-1][has], offsets[1:][has] - length
    found: list[tuple[np.ndarray, ...]] = []
    for level in range(3):
        if level:
            place = ranges(first, last - first + width)
        else:
            place = np.flatnonzero((raw[: n - gram + 1] == 0x20) | (raw[: n - gram + 1] == 0x0A))
            span = np.searchsorted(first, place, "right") - 1
            place = place[(span >= 0) & (place < (last + width)[span])]
        value = mix((h[place + gram] - h[place]) * inverse[place])
        if level < 2:
            low = value < np.uint64(1 << 62 - level)
            place, value = place[low], value[low]
        span = np.searchsorted(first, place, "right") - 1
        begin, end = _reach(place, value, width)
        begin, end = np.maximum(begin, first[span]), np.minimum(end, last[span])
        real = begin <= end
        found.append((place[real], value[real], begin[real], end[real]))
        # windows without a candidate
        spans = np.arange(len(first))
        marks, owner = np.concatenate([first - 1, place, last + width]), np.concatenate([spans, span, spans])
        order = np.lexsort((marks, owner))
        marks, owner = marks[order], owner[order]
        bare = np.flatnonzero((owner[1:] == owner[:-1]) & (marks[1:] - marks[:-1] > width))
        first, last = marks[bare] + 1, marks[bare + 1] - width
        if not len(first):
            break
    anchor, value, begin, end = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(begin, kind="stable")
    anchor, value, begin, end = anchor[order], value[order], begin[order], end[order]
    doc = np.searchsorted(offsets, begin, "right") - 1
    count, shift = end - begin + 1, anchor - begin
    segment = mix((h[end + length] - h[begin]) * inverse[begin] + mix((shift * 1024 + count).astype(np.uint64)))
    return doc, begin - offsets[:-1][doc], count, shift, value, segment


def pieces(offsets: np.ndarray, length: int = LENGTH) -> Iterator[tuple[int, int, int, int]]:
    """Ranges (first document, last document, first byte, last byte) of about PIECE bytes; longer texts in pieces that overlap."""
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1)
        a, b = int(offsets[at]), int(offsets[to])
        if b - a <= PIECE:
            yield at, to, a, b
        else:
            for x in range(a, max(b - length + 1, a + 1), PIECE):
                yield at, to, x, min(b, x + PIECE + length - 1)
        at = to


def segments(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """k1, k2, gram, segment, first, shift, count for each segment of docs (k1, k2, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column(2))
            for a, b, x, y in pieces(offsets, length):
                own = np.clip(offsets[a : b + 1], x, y) - x
                doc, first, count, shift, gram, segment = winnow(raw[x:y], own, length)
                if len(doc):
                    first = first + np.maximum(x - offsets[a:b][doc], 0)
                    k1, k2 = (batch.column(i).slice(a, b - a).take(pa.array(doc)) for i in (0, 1))
                    yield pa.RecordBatch.from_arrays([k1, k2, pa.array(gram.view(np.int64)), pa.array(segment.view(np.int64)), pa.array(first), pa.array(shift.astype(np.int16)), pa.array(count.astype(np.int16))], ["k1", "k2", "gram", "segment", "first", "shift", "count"])

    return docs.mapInArrow(cut, "k1 long, k2 long, gram long, segment long, first long, shift short, count short")


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, at most ROWS at a time, so that few whole texts are held at once."""
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            yield batch.slice(a, ROWS)


def squeezed(docs: DataFrame) -> DataFrame:
    """The texts of docs compressed for the shuffles that follow: the other columns and packed."""
    names = [c for c in docs.columns if c != "text"]

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in parts(batches):
            packed = [pack.compress((x.as_py() or "").encode("utf-8", "surrogatepass")) for x in batch.column(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(packed, pa.binary())], [*names, "packed"])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name != "text")
    return docs.select(*names, "text").mapInArrow(squeeze, f"{kept}packed binary")


PART = "gram long, segment long, copy boolean, shift short, count short, bytes binary"


def decided(segments_: DataFrame, length: int = LENGTH) -> DataFrame:
    """gram, segment, lo, hi: the runs of repeated windows of the segments (PART), as bytes from the segment's first one on.

    The segments of a gram are in one group of at most 2 * BLOCK rows; two rows of equal bytes differ in copy.
    """

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.get_total_buffer_size() for x in held) > HELD:
                table = pa.Table.from_batches(held).combine_chunks()
                gram = np.asarray(table.column(0))
                whole = int(np.searchsorted(gram, gram[-1]))  # the last gram may go on
                if whole:
                    yield answer(table.slice(0, whole))
                held = table.slice(whole).to_batches()
        if sum(x.num_rows for x in held):
            yield answer(pa.Table.from_batches(held).combine_chunks())

    def answer(table: pa.Table) -> pa.RecordBatch:
        gram, segment, copy, shift, count = (np.asarray(table.column(i)) for i in range(5))
        order = np.lexsort((copy, segment, gram))
        new = np.ones(len(order), bool)  # equal rows of docs are fetched twice
        new[1:] = (gram[order][1:] != gram[order][:-1]) | (segment[order][1:] != segment[order][:-1]) | (copy[order][1:] != copy[order][:-1])
        order = order[new]
        table = table.take(pa.array(order))
        gram, segment, copy = gram[order], segment[order], copy[order]
        shift, count = shift[order].astype(np.int64), count[order].astype(np.int64)
        raw, offsets = text_bytes(table.column(5))
        first = np.append(np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])), len(gram))
        many = repeated(raw, offsets, shift, count, first, length)
        begin = np.cumsum(count) - count
        edge = np.zeros(len(many) + 1, bool)
        edge[begin] = edge[-1] = True
        on = np.flatnonzero(many & (edge[:-1] | ~np.concatenate([[False], many[:-1]])))
        off = np.flatnonzero(many & (edge[1:] | ~np.concatenate([many[1:], [False]])))
        row = np.searchsorted(begin, on, "right") - 1
        keep = ~copy[row]
        on, off, row = on[keep], off[keep], row[keep]
        return pa.RecordBatch.from_arrays([pa.array(gram[row]), pa.array(segment[row]), pa.array(on - begin[row]), pa.array(off - begin[row] + length)], ["gram", "segment", "lo", "hi"])

    dealt = segments_.repartition("gram").sortWithinPartitions("gram")
    return dealt.mapInArrow(sort, "gram long, segment long, lo long, hi long")


def narrowed(segments_: DataFrame, width: int, length: int = LENGTH) -> DataFrame:
    """Parts of segments (origin, source, at and those of PART without copy): windows with the anchor in one of the ranges of width places.

    A part's gram is a hash of the old one and of the bytes that all windows with the anchor in that range have, at most width - 1
    bytes less than a window; its segment is a hash of its own bytes. origin and source are gram and segment of the whole one, at
    the place of the part's first window in it.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for origin, source, at, gram, shift, count, raw in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                x = 0
                while x < count:
                    j = (shift - x) // width
                    n = min(count, shift - j * width + 1) - x
                    part = raw[x : x + n - 1 + length]
                    key = raw[max(shift - j * width, 0) : shift - (j + 1) * width + 1 + length]
                    rows.append((origin, source, at + x, _number(gram.to_bytes(8, "little", signed=True) + bytes([j]) + key), _number(bytes([shift - x, n]) + part), shift - x, n, part))
                    x += n
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            types = (*[pa.int64()] * 5, pa.int16(), pa.int16(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["origin", "source", "at", "gram", "segment", "shift", "count", "bytes"])

    rows = segments_.select("origin", "source", "at", "gram", "shift", "count", "bytes")
    return rows.mapInArrow(cut, "origin long, source long, at long, gram long, segment long, shift short, count short, bytes binary")


def _number(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


def _twice(n: Column) -> Column:
    """copy: false, and true where there are n > 1 segments of equal bytes."""
    return F.explode(F.when(n > 1, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))


def _spans(docs: DataFrame, length: int) -> DataFrame:
    """k1, k2, lo, hi: the repeated bytes of docs (k1, k2, text)."""
    every = materialise(segments(docs, length), "segments")
    grams = materialise(every.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "repeated-grams")
    found = materialise(every.join(grams, "gram"), "found")
    place = F.struct("k1", "k2", "first")
    kinds = materialise(found.groupBy("gram", "segment", "shift", "count").agg(F.count("*").alias("n"), F.min(place).alias("one"), F.max(place).alias("other")), "kinds")
    sizes = kinds.groupBy("gram").agg(F.count("*").alias("kinds"))
    ends = kinds.join(sizes, "gram").withColumn("copy", _twice(F.col("n"))).withColumn("place", F.when(F.col("copy"), F.col("other")).otherwise(F.col("one")))
    wanted = ends.groupBy("place.k1", "place.k2").agg(F.collect_list(F.struct("gram", "segment", "copy", "shift", "count", (F.col("kinds") > BLOCK).alias("heavy"), "place.first")).alias("wanted"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in parts(batches):
            for packed, wanted in zip(batch.column(0), batch.column(1), strict=True):
                raw = unpack.decompress(packed.as_py())
                columns = wanted.values.flatten()
                first, count = np.asarray(columns[6]), np.asarray(columns[4])
                cut = [raw[a : a + n - 1 + length] for a, n in zip(first.tolist(), count.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*columns[:6], pa.array(cut, pa.binary())], ["gram", "segment", "copy", "shift", "count", "heavy", "bytes"])

    fetched = squeezed(docs).join(wanted, ["k1", "k2"]).select("packed", "wanted").mapInArrow(fetch, "gram long, segment long, copy boolean, shift short, count short, heavy boolean, bytes binary")
    fetched = materialise(fetched, "fetched")
    spans = materialise(decided(fetched.where("not heavy").drop("heavy"), length), "decided")
    heavy = fetched.where("heavy").select(F.col("gram").alias("origin"), F.col("segment").alias("source"), F.lit(0).cast("long").alias("at"), "gram", "shift", "count", "bytes").distinct()
    copies = kinds.select(F.col("gram").alias("origin"), F.col("segment").alias("source"), "n")
    for width in WIDTHS:
        if heavy.isEmpty():
            break
        cut = materialise(narrowed(heavy, width, length).join(copies, ["origin", "source"]), "narrowed")
        kinds_ = cut.groupBy("gram", "segment", "shift", "count").agg(F.sum("n").alias("n"), F.min("bytes").alias("bytes"))
        sizes = materialise(cut.groupBy("gram", "segment").agg(F.sum("n").alias("n")).groupBy("gram").agg(F.sum("n").alias("all"), F.count("*").alias("kinds")).where("all > 1"), "narrowed-sizes")
        known = materialise(kinds_.join(sizes, "gram"), "narrowed-kinds")
        ready = known.where(F.col("kinds") <= BLOCK).select("gram", "segment", _twice(F.col("n")).alias("copy"), "shift", "count", "bytes")
        part = decided(ready, length).join(cut.select("origin", "source", "at", "gram", "segment"), ["gram", "segment"])
        spans = spans.unionByName(materialise(part.select(F.col("origin").alias("gram"), F.col("source").alias("segment"), (F.col("lo") + F.col("at")).alias("lo"), (F.col("hi") + F.col("at")).alias("hi")), "narrowed-decided"))
        heavy = cut.join(sizes.where(F.col("kinds") > BLOCK).select("gram"), "gram").drop("n", "segment")
    return found.join(spans, ["gram", "segment"]).select("k1", "k2", (F.col("first") + F.col("lo")).alias("lo"), (F.col("first") + F.col("hi")).alias("hi"))


def remove(docs: DataFrame, length: int = LENGTH, characters: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that no repeated string of length bytes covers) and the columns to keep, for each row.

    docs has doc_id and text; other columns are ignored. Texts are UTF-8 bytes, null is empty;
    matches never cross texts. A row that repeats another one counts as a text of its own, so its strings repeat. Texts shorter
    than length stay whole. With characters, the bytes of a character that is removed in part go as well, so that kept is valid.
    """
    small_batches(docs.sparkSession)
    id_ = F.col("doc_id").cast("long")
    keyed = docs.select(id_.alias("doc_id"), F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", F.lit(7), "doc_id").alias("k2"), F.coalesce("text", F.lit("")).alias("text"), *keep)
    spans = _spans(keyed.select("k1", "k2", "text"), length).groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in parts(batches):
            rows = []
            for packed, spans in zip(batch.column(0), batch.column(1), strict=True):
                raw = np.frombuffer(unpack.decompress(packed.as_py()), np.uint8)
                if not spans.is_valid:
                    rows.append((len(raw), 0, 0, raw.tobytes()))
                    continue
                gone = np.zeros(len(raw) + 1, np.int32)
                lo, hi = (np.asarray(x) for x in spans.values.flatten())
                np.add.at(gone, lo, 1)
                np.add.at(gone, hi, -1)
                mask = np.cumsum(gone[:-1]) > 0
                if characters:
                    mask = whole_characters(raw, mask)
                rows.append((len(raw), int(mask.sum()), len(runs(mask)), raw[~mask].tobytes()))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(2), *(pa.array(c, t) for c, t in zip(columns, (*[pa.int64()] * 3, pa.binary()), strict=True)), *batch.columns[3:]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", *keep])

    joined = squeezed(keyed).join(spans, ["k1", "k2"], "left").select("packed", "spans", "doc_id", *keep)
    kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[3:])
    return joined.mapInArrow(drop, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept binary{kept}")


def whole_characters(raw: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """mask with all bytes of each UTF-8 character of which one is set."""
    if not len(raw):
        return mask
    begins = np.flatnonzero((raw & 0xC0) != 0x80)
    return np.repeat(np.logical_or.reduceat(mask, begins), np.diff(np.append(begins, len(raw))))


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """Half-open ranges of true places."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
