"""SentencePiece encoding with the byte span of every piece in the original text, and decoding.

A text is normalised by the longest prefixes that the model's compiled character map knows; each normalised byte records where its source
begins. The normalised text is cut where no piece of the vocabulary can stand across, so each different unit is merged once a task, and
the ends of its pieces go back through the alignment to spans of the original bytes. Merging is byte-pair encoding by piece scores.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

SPACE = "▁"
# Units longer than this aren't remembered; of shorter ones a task remembers so many at a time.
LONG_UNIT, REMEMBERED = 64, 1 << 19
# Texts that are handed on together: at most so many characters, or one text.
CHUNK_CHARACTERS = 1 << 21
NEVER = np.int64(1 << 40)
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def charsmap_entries(blob: bytes) -> dict[str, str]:
    """The rules of a compiled character map: a double-array trie over UTF-8 bytes, then the replacements, each ended by a zero."""
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units, texts = np.frombuffer(blob[4 : 4 + size], "<u4"), blob[4 + size :]

    def child(node: np.ndarray) -> np.ndarray:
        unit = units[node]
        return node ^ ((unit >> 10) << ((unit & 512) >> 6))

    out = {}
    node, keys = np.zeros(1, np.uint32), [b""]
    letters = np.arange(1, 256, dtype=np.uint32)
    while len(node):
        to = child(node)[:, None] ^ letters[None, :]
        inside = to < len(units)
        label = np.where(inside, units[np.where(inside, to, 0)], 0)
        at, letter = np.nonzero(inside & ((label & 0x800000FF) == letters[None, :]))
        node, keys = to[at, letter], [keys[a] + bytes([b + 1]) for a, b in zip(at.tolist(), letter.tolist(), strict=True)]
        ends = np.flatnonzero((units[node] >> 8) & 1)
        for k, place in zip(ends.tolist(), (units[child(node[ends])] & 0x7FFFFFFF).tolist(), strict=True):
            out[keys[k].decode()] = texts[place : texts.index(b"\0", place)].decode()
    return out


class Merges:
    """Byte-pair merges of many units at once: in each round every part of a unit merges its best pair, the leftmost of equals."""

    TABLE = 1 << 21
    SHORT = 64

    def __init__(self, rank: dict[str, tuple[float, int]]):
        symbols = list(dict.fromkeys([*rank, *(c for p in rank for c in p)]))
        number = {p: k for k, p in enumerate(symbols)}
        self.symbols = symbols
        self.piece_id = np.array([rank[p][1] if p in rank else -1 for p in symbols] + [-1])
        self.of_point = np.full(0x110000, -1, np.int32)
        for p, k in number.items():
            if len(p) == 1:
                self.of_point[ord(p)] = k
        order = {v: k for k, v in enumerate(sorted({score for score, _ in rank.values()}))}
        best: dict[int, tuple[int, int]] = {}
        beside = set()
        for p, (score, _) in rank.items():
            for cut in range(1, len(p)):
                left, right = number.get(p[:cut]), number.get(p[cut:])
                beside.add((number[p[cut - 1]] << 32) + number[p[cut]])
                if left is not None and right is not None:
                    best[(left << 32) + right] = (order[score], number[p])
        self.best = best
        keys = np.array(sorted(set(best) | beside), np.int64)
        self.keys, self.order, self.made = np.full(self.TABLE, -1, np.int64), np.full(self.TABLE, -1, np.int64), np.full(self.TABLE, -1, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            self.keys[slot[free]] = keys[free]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) % self.TABLE
        none = (-1, -1)
        self.order[slot] = [best.get(k, none)[0] for k in keys.tolist()]
        self.made[slot] = [best.get(k, none)[1] for k in keys.tolist()]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.TABLE.bit_length() + 1)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slot of each pair of symbols; -1 if no piece has the two side by side."""
        keys = (left.astype(np.int64) << 32) + right
        slot, open_ = self._slot(keys), np.arange(len(keys))
        slot[(left < 0) | (right < 0)] = -1
        open_ = open_[slot >= 0]
        while len(open_):
            there = self.keys[slot[open_]]
            slot[open_[there < 0]] = -1
            open_ = open_[(there >= 0) & (there != keys[open_])]
            slot[open_] = (slot[open_] + 1) % self.TABLE
        return slot

    def run(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbol (-1 if unknown), number of characters and unit of each piece, in order."""
        size = np.fromiter(map(len, units), np.int64, len(units))
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbol = self.of_point[points]
        unit = np.repeat(np.arange(len(units)), size)
        n = len(symbol)
        if not n:
            return symbol, symbol.astype(np.int64), unit
        slot = self.find(symbol[:-1], symbol[1:])
        joint = (slot >= 0) & (unit[1:] == unit[:-1])
        start = np.concatenate([[0], np.flatnonzero(~joint) + 1])
        length = np.diff(np.append(start, n))
        order = np.full(n, NEVER)
        usable = np.flatnonzero(joint & (self.order[slot] >= 0))
        order[usable] = self.order[slot[usable]]
        after = np.arange(1, n + 1)
        before = np.arange(-1, n - 1)
        alive = np.ones(n, bool)
        for k in np.flatnonzero(length > self.SHORT).tolist():
            self._long(symbol, alive, int(start[k]), int(start[k] + length[k]))
        busy = np.flatnonzero((length > 1) & (length <= self.SHORT))
        part = np.repeat(np.arange(len(start)), length)
        while len(busy):
            # Characters of the busy parts, one after the other, and their keys: order, then place.
            span = length[busy]
            edge = np.cumsum(span) - span
            at = np.repeat(start[busy] - edge, span) + np.arange(span.sum())
            least = np.minimum.reduceat(order[at] * self.SHORT + (at - np.repeat(start[busy], span)), edge)
            moves = least < NEVER * self.SHORT
            busy = busy[moves]
            left = start[busy] + least[moves] % self.SHORT
            right = after[left]
            symbol[left] = self.made[self.find(symbol[left], symbol[right])]
            alive[right] = False
            order[right] = NEVER
            after[left] = after[right]
            inside = after[left] < n
            before[after[left][inside]] = left[inside]
            for a, b in ((left, after[left]), (before[left], left)):
                ok = (a >= 0) & (b < n)
                ok[ok] = part[a[ok]] == part[b[ok]]
                found = self.find(symbol[a[ok]], symbol[b[ok]])
                order[a[ok]] = np.where((found >= 0) & (self.order[found] >= 0), self.order[found], NEVER)
                if a is left:
                    order[left[~ok]] = NEVER
        kept = np.flatnonzero(alive)
        return symbol[kept], np.diff(np.append(kept, n)), unit[kept]

    def _long(self, symbol: np.ndarray, alive: np.ndarray, start: int, end: int) -> None:
        """The same for one part of many characters, by a heap of its pairs."""
        n = end - start
        now, before, after = array("i", symbol[start:end].tolist()), array("i", range(-1, n - 1)), array("i", [*range(1, n), -1])
        heap: list[tuple[int, int, int, int]] = []

        def offer(left: int) -> None:
            right = after[left]
            found = self.best.get((now[left] << 32) + now[right]) if right >= 0 else None
            if found:
                heapq.heappush(heap, (found[0], left, right, found[1]))

        for k in range(n):
            offer(k)
        while heap:
            _, left, right, made = heapq.heappop(heap)
            if now[left] < 0 or after[left] != right or self.best.get((now[left] << 32) + now[right], (0, -1))[1] != made:
                continue
            now[left], now[right] = made, -1
            after[left] = after[right]
            if after[left] >= 0:
                before[after[left]] = left
            if before[left] >= 0:
                offer(before[left])
            offer(left)
        symbol[start:end] = now
        alive[start:end] = symbol[start:end] >= 0


class Model:
    """Pieces, scores and the normaliser of a model file."""

    def __init__(self, blob: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(blob)
        if proto.trainer_spec.model_type != proto.trainer_spec.BPE:
            raise ValueError("the model is no byte-pair encoding")
        kinds = [p.type for p in proto.pieces]
        if USER_DEFINED in kinds or UNUSED in kinds or proto.trainer_spec.treat_whitespace_as_suffix or proto.HasField("denormalizer_spec") and proto.denormalizer_spec.precompiled_charsmap or not proto.normalizer_spec.escape_whitespaces:
            raise ValueError("models with pieces of the user, unused pieces, a denormaliser or unescaped white space aren't handled")
        self.pieces = [p.piece for p in proto.pieces]
        self.rank = {p.piece: (-p.score, k) for k, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.unknown = kinds.index(UNKNOWN)
        self.bytes = {int(p.piece[3:5], 16): k for k, p in enumerate(proto.pieces) if p.type == BYTE} if proto.trainer_spec.byte_fallback else {}
        self.byte_of = {k: b for b, k in self.bytes.items()}
        self.raw_ids = np.array(list(self.byte_of), np.int64)
        self.surface = [proto.trainer_spec.unk_surface if kind == UNKNOWN else "" if kind == CONTROL else p.piece.replace(SPACE, " ") for p, kind in zip(proto.pieces, kinds, strict=True)]
        spec = proto.normalizer_spec
        self.prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.rules = charsmap_entries(spec.precompiled_charsmap)
        self.longest = max(map(len, self.rules), default=0)
        single = "".join(sorted(k for k in self.rules if len(k) == 1))
        first, second = ("".join(sorted({k[i] for k in self.rules if len(k) > 1})) for i in (0, 1))
        forms = [f"[{re.escape(single)}]"] if single else []
        forms += [f"[{re.escape(first)}](?=[{re.escape(second)}])"] if first else []
        self.rule_start = re.compile("|".join(forms)) if forms else None
        self.merges = Merges(self.rank)
        pairs = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        # If no piece has a space after another character, a run of spaces always begins a unit.
        self.unit = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+") if not any(a != SPACE and b == SPACE for a, b in pairs) else re.compile("(?s:.+)")

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and, for each of its characters and its end, the place of its source among the text's characters."""
        out, source = [], []
        if self.rule_start is None:
            out, source = [text], [np.arange(len(text))]
        else:
            at = 0
            while at < len(text):
                found = self.rule_start.search(text, at)
                to = found.start() if found else len(text)
                if to > at:
                    out.append(text[at:to])
                    source.append(np.arange(at, to))
                at = to
                if found:
                    size = next((n for n in range(min(self.longest, len(text) - at), 0, -1) if text[at : at + n] in self.rules), 0)
                    new = self.rules[text[at : at + size]] if size else text[at]
                    out.append(new)
                    source.append(np.full(len(new), at))
                    at += max(size, 1)
        made, place = "".join(out), np.concatenate([*source, [len(text)]]).astype(np.int64)
        if self.squeeze:
            made, place = squeezed(made, place)
        if made and self.prefix:
            made, place = " " + made, np.concatenate([place[:1], place])
        return made.replace(" ", SPACE), place

    def leading(self, ids: np.ndarray) -> int:
        """How many spaces decoding leaves out before the first piece: one, or one of each piece that is nothing else."""
        out = 0
        for k in ids if self.prefix or self.squeeze else []:
            out += self.surface[k].startswith(" ")
            if self.surface[k] != " " or not self.squeeze:
                break
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of the ids, with the spaces of a unit kept; bytes that make no character become U+FFFD each."""
        out, raw = [], bytearray()
        for k in ids:
            if k in self.byte_of:
                raw.append(self.byte_of[k])
                continue
            if raw:
                out.append(bytes_text(bytes(raw)))
                raw.clear()
            out.append(self.surface[k])
        return "".join(out) + bytes_text(bytes(raw))


def bytes_text(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return re.sub("[\udc80-\udcff]", "�", raw.decode(errors="surrogateescape"))


def byte_places(text: str) -> np.ndarray:
    """For each character of a text and its end, the number of bytes before it."""
    if text.isascii():
        return np.arange(len(text) + 1)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), dtype=np.int64)])


def squeezed(text: str, place: np.ndarray) -> tuple[str, np.ndarray]:
    """The text without leading and trailing spaces and with one space for each inner run; an inner run's source is its first space.

    The space symbol counts as a space at the end only.
    """
    end = len(text.rstrip(" " + SPACE))
    space = np.array([c == " " for c in text[:end]], bool)
    kept = ~space
    kept[1:] |= ~space[:-1]
    kept[: len(text) - len(text.lstrip(" "))] = False
    at = np.flatnonzero(kept)
    return "".join([text[k] for k in at.tolist()]), np.concatenate([place[at], place[end : end + 1]])


@lru_cache(2)
def model(path: str) -> Model:
    with open(path, "rb") as f:
        return Model(f.read())


class Units:
    """What is known of the units met so far: ids and ends of their pieces in one flat array each, and decoded texts."""

    def __init__(self, m: Model):
        self.m, self.number, self.decoded = m, {}, []
        self.ids, self.ends, self.first = array("i"), array("i"), array("q", [0])

    def add(self, new: list[str]) -> None:
        """Merges units that aren't known yet. An unknown character becomes its bytes, which all end after it but for the others' sake."""
        m = self.m
        piece, size, unit = m.merges.run(new)
        ids = np.where(piece >= 0, m.merges.piece_id[piece], -1)
        end = np.cumsum(size)
        end -= np.concatenate([[0], np.cumsum([len(u) for u in new])])[unit]
        unknown = np.flatnonzero(ids < 0)
        if len(unknown):
            pieces = [[m.bytes[b] for b in new[unit[k]][end[k] - size[k] : end[k]].encode()] if m.bytes else [m.unknown] for k in unknown.tolist()]
            count = np.ones(len(ids), np.int64)
            count[unknown] = [len(p) for p in pieces]
            last = np.cumsum(count) - 1
            ids, end, unit = np.repeat(ids, count), np.repeat(end, count), np.repeat(unit, count)
            inner = np.ones(len(ids), bool)
            inner[last] = False
            end[inner] -= np.repeat(size, count)[inner]
            ids[ids < 0] = [k for p in pieces for k in p]
        count = np.bincount(unit, minlength=len(new))
        self.first.extend((np.cumsum(count) + len(self.ids)).tolist())
        flat = ids.astype(np.int32).tolist()
        self.ids.extend(flat)
        self.ends.extend(end.astype(np.int32).tolist())
        plain = np.ones(len(new), bool)
        plain[unit[np.isin(ids, m.raw_ids)]] = False
        surfaces, to = [m.surface[k] for k in flat], np.cumsum(count).tolist()
        at = 0
        for n, as_is in zip(to, plain.tolist(), strict=True):
            self.decoded.append("".join(surfaces[at:n]) if as_is else m.decode(flat[at:n]))
            at = n

    def numbers(self, units: list[str]) -> np.ndarray:
        out = list(map(self.number.get, units))
        if None in out:
            missing = list(dict.fromkeys(u for u, k in zip(units, out, strict=True) if k is None))
            own = dict(zip(missing, range(len(self.decoded), len(self.decoded) + len(missing)), strict=True))
            self.add(missing)
            self.number.update((u, k) for u, k in own.items() if len(u) <= LONG_UNIT)
            out = [own[u] if k is None else k for u, k in zip(units, out, strict=True)]
        return np.array(out, np.int64)


def encode_texts(units: Units, texts: list[str], spans: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Numbers of ids before each text, then ids, begins and ends (bytes of the own text) of all pieces; the decoded texts."""
    m = units.m
    normal = [m.normalise(t) for t in texts]
    found = [m.unit.findall(t) for t, _ in normal]
    number = units.numbers([u for f in found for u in f])
    first = np.array(units.first, np.int64)
    count = first[number + 1] - first[number]
    done = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(first[number] - done[:-1], count) + np.arange(done[-1])
    ids = np.array(units.ids, np.int32)[at]
    edge = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)
    begins = ends = np.zeros(0, np.int64)
    if spans:
        size = np.fromiter((len(u) for f in found for u in f), np.int64, len(number))
        end = np.repeat(np.cumsum(size) - size, count) + np.array(units.ends, np.int32)[at]
        # One place more than characters for each text: its end.
        place = np.concatenate([byte_places(t)[p] for t, (_, p) in zip(texts, normal, strict=True)])
        text = np.repeat(np.repeat(np.arange(len(texts)), np.diff(edge)), count)
        begin = np.concatenate([[0], end[:-1]])[: len(end)]
        begins, ends = place[begin + text], place[end + text]
    decoded, known, order = [], units.decoded, number.tolist()
    for k in range(len(texts)):
        out = "".join([known[n] for n in order[edge[k] : edge[k + 1]]])
        decoded.append(out[m.leading(ids[done[edge[k]] : done[edge[k + 1]]]) :])
    return done[edge], ids, begins, ends, decoded


def _encode(path: str, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        units = Units(m)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                to, held = at + 1, len(texts[at])
                while to < len(texts) and held + len(texts[to]) <= CHUNK_CHARACTERS:
                    held += len(texts[to])
                    to += 1
                offsets, ids, begins, ends, decoded = encode_texts(units, texts[at:to], spans)
                lists = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(x)) for x in ([ids, begins, ends] if spans else [ids])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), *lists, pa.array(decoded, pa.string())], ["doc_id", "ids", *(["begins", "ends"] if spans else []), "decoded"])
                at = to
                if len(units.decoded) > REMEMBERED or len(units.ids) > 8 * REMEMBERED:
                    units = Units(m)

    return run


def encode(documents: DataFrame, path: str, spans: bool = True) -> DataFrame:
    """doc_id, ids, begins, ends and decoded for each row of documents (doc_id, text); other columns are ignored.

    begins and ends are byte places in the text, one for each id (left out without spans); the bytes of a character that no piece covers
    are ids of their own, of which the last one spans the character. decoded is what the ids decode to. A null text is empty and has
    no ids. Repeated rows stay. An empty table gives no rows.
    """
    kinds = [StructField("ids", ArrayType(IntegerType()))] + ([StructField(n, ArrayType(LongType())) for n in ("begins", "ends")] if spans else [])
    schema = StructType([documents.schema["doc_id"], *kinds, StructField("decoded", StringType())])
    return documents.select("doc_id", "text").mapInArrow(_encode(path, spans), schema)
