"""SentencePiece encoding and decoding that keeps the source offsets of every piece.

The model file is read on the driver and broadcast. A text is normalised by the longest prefix found
in the compiled character map, and every normalised character remembers which source bytes it stands
for; byte-pair merges then run on the normalised text, and a piece's span is the source bytes of its
first to its last character. Merging is local to a stretch between word starts (no piece of such a
model has a word start inside, which is checked when it is loaded), so a stretch is merged once per
worker and remembered.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import released

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Merged stretches that a worker remembers, and the length from which a heap finds the next merge.
REMEMBERED, LONG = 300_000, 96


class CharacterMap:
    """The compiled map: a double-array trie over UTF-8 prefixes and the texts that replace them."""

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix of data[at:] and its replacement."""
        units = self.units
        if not units:
            return None
        node, found = self._offset(units[0]), None
        for i in range(at, len(data)):
            byte = data[i]
            node ^= byte
            if node >= len(units) or units[node] & 0x800000FF != byte:
                break
            unit = units[node]
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(0, found[1])]

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << (unit >> 6 & 8)


def normalise(data: bytes, charmap: CharacterMap, prefix: bool, squeeze: bool, escape: bool = True):
    """Normalised text, and for each of its characters the source bytes [start, end) it stands for."""
    chars: list[tuple[str, int, int]] = []
    at = 0
    while at < len(data):
        hit = charmap.longest(data, at)
        if hit is None:
            lead = data[at]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            put = data[at : at + width]
        else:
            width, put = hit
        chars += [(c, at, at + width) for c in put.decode()]
        at += width
    if squeeze:
        kept = []
        for c in chars:
            if c[0] != " " or kept and kept[-1][0] != " ":
                kept.append(c)
        while kept and kept[-1][0] == " ":
            kept.pop()
        chars = kept
    if prefix and chars:
        chars.insert(0, (" ", chars[0][1], chars[0][1]))
    text = "".join(c for c, _, _ in chars)
    text = text.replace(" ", SPACE) if escape else text
    return text, np.array([a for _, a, _ in chars], np.int64), np.array([b for _, _, b in chars], np.int64)


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Field numbers and values of one protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


@dataclass
class PieceModel:
    """Vocabulary and rules read from a model file of the BPE kind."""

    blob: bytes

    def __post_init__(self):
        self.pieces: list[tuple[str, float, int]] = []
        spec: dict[int, bytes | int] = {}
        trainer: dict[int, bytes | int] = {}
        for number, value in _fields(self.blob):
            if number == 1:
                piece = dict(_fields(value))
                score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
                self.pieces.append((piece.get(1, b"").decode(), score, piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                spec = dict(_fields(value))
        if trainer.get(3, 1) != 2 or trainer.get(24, 0):
            raise ValueError("only BPE models with leading word starts are handled")
        self.charmap = CharacterMap(spec.get(2, b""))
        self.prefix, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        self.fallback = bool(trainer.get(35, 0))
        kinds = {kind for _, _, kind in self.pieces}
        if kinds & {USER, UNUSED}:
            raise ValueError("user-defined and unused pieces are not handled")
        self.ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind == NORMAL}
        self.unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(self.pieces) if k == BYTE}
        self.begin = next((i for i, p in enumerate(self.pieces) if p[0] == "<s>"), 1)
        self.end = next((i for i, p in enumerate(self.pieces) if p[0] == "</s>"), 2)
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece has a word start inside")
        self.rank = {p: -self.pieces[i][1] for p, i in self.ids.items()}
        line = "\n" if not any("\n" in p for p in self.ids) else ""
        self.stretches = re.compile(f"{SPACE}+[^{SPACE}{line}]*|{line}|[^{SPACE}{line}]+" if line else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.memory: dict[str, bytes] = {}

    @cached_property
    def source_bytes(self) -> np.ndarray:
        """Source bytes of each piece when every character stands for itself and a word start for one space."""
        return np.array([1 if k == BYTE else len(p.replace(SPACE, " ").encode()) if k == NORMAL else 0 for p, _, k in self.pieces], np.int64)

    @cached_property
    def surfaces(self) -> list[bytes]:
        def surface(p, kind):
            return bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.replace(SPACE, " ").encode()

        return [surface(p, kind) for p, _, kind in self.pieces]

    def merge(self, stretch: str) -> list[str]:
        """Symbols after all merges: best score first, leftmost among equals."""
        parts, rank, never = list(stretch), self.rank, float("inf")
        if len(parts) > LONG:
            return self._merge_long(parts)
        costs = [rank.get(a + b, never) for a, b in zip(parts, parts[1:], strict=False)]
        while costs:
            best = min(costs)
            if best == never:
                break
            i = costs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i < len(costs):
                costs[i] = rank.get(parts[i] + parts[i + 1], never)
            if i:
                costs[i - 1] = rank.get(parts[i - 1] + parts[i], never)
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        n, rank = len(parts), self.rank
        after, before, heap = [*range(1, n), -1], [-1, *range(n - 1)], []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else -1
            if j >= 0 and (r := rank.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (r, i, j, len(parts[i]) + len(parts[j])))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, size = heapq.heappop(heap)
            if not parts[i] or not parts[j] or after[i] != j or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i], parts[j] = parts[i] + parts[j], ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [p for p in parts if p]

    def packed(self, stretch: str) -> bytes:
        """Ids of one stretch as little-endian 32-bit integers."""
        out: list[int] = []
        for part in self.merge(stretch):
            piece = self.ids.get(part)
            if piece is not None:
                out.append(piece)
            elif self.fallback:
                out += [self.bytes[b] for b in part.encode()]
            else:
                out.append(self.unknown)
        if len(self.memory) >= REMEMBERED:
            self.memory.clear()
        self.memory[stretch] = ids = struct.pack(f"<{len(out)}I", *out)
        return ids

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids without begin and end, and the source byte span [start, end) of each piece."""
        plain = not self.charmap.units and not self.squeeze and SPACE not in text
        if plain:
            norm = text.replace(" ", SPACE)
            norm = SPACE + norm if self.prefix and text else norm
        else:
            norm, first, last = normalise(text.encode(), self.charmap, self.prefix, self.squeeze)
        memory, make = self.memory, self.packed
        ids = np.frombuffer(b"".join([memory.get(s) or make(s) for s in self.stretches.findall(norm)]), "<u4")
        if plain:
            ends = np.cumsum(self.source_bytes[ids]) - (1 if self.prefix else 0)
            return ids, np.maximum(np.r_[0, ends[:-1]], 0)[: len(ids)], ends
        return ids, *self._project(ids, norm, first, last)

    def _project(self, ids, norm, first, last):
        """Spans by the recorded alignment. Pieces from one fallback character share its source bytes."""
        starts, ends = np.empty(len(ids), np.int64), np.empty(len(ids), np.int64)
        at = left = 0
        for k, i in enumerate(ids.tolist()):
            text, _, kind = self.pieces[i]
            if kind == BYTE:
                starts[k], ends[k] = first[at], last[at]
                left = left or len(norm[at].encode())
                left -= 1
                at += left == 0
            else:
                size = len(text) if kind == NORMAL else 1
                starts[k], ends[k] = first[at], last[at + size - 1]
                at += size
        return starts, ends

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; begin and end say nothing, and the word start that was put first goes."""
        kinds = self.pieces
        out = b"".join(map(self.surfaces.__getitem__, ids.tolist()))
        head = next((kinds[i][0] for i in ids.tolist() if kinds[i][2] != CONTROL), "")
        if self.prefix and head.startswith(SPACE):
            out = out[1:]
        return out.decode("utf-8", "replace")


_LOADED: dict[int, PieceModel] = {}


def encode(df: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: (doc_id, n_tokens, ids, starts, ends, ids_le, source_bytes, decoded).

    ``ids`` has begin and end ids; ``starts`` and ``ends`` are byte offsets into the source text, and
    begin and end have empty spans. ``ids_le`` packs the ids as little-endian 32-bit integers;
    ``decoded`` is the text of the ids. A null text is empty: its ids are begin and end only. Repeated
    rows give repeated results, a null id stays null, other columns are ignored.
    """
    with open(model_path, "rb") as f:
        shipped = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blob = shipped.value
        model = _LOADED.get(hash(blob)) or _LOADED.setdefault(hash(blob), PieceModel(blob))
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                ids, starts, ends, decoded, sizes = [], [], [], [], []
                for t in batch.column(1).to_pylist():
                    t = t or ""
                    i, a, b = model.encode(t)
                    size = len(t.encode())
                    full = np.concatenate(([model.begin], i, [model.end])).astype("<u4")
                    ids.append(full)
                    starts.append(np.r_[0, a, size].astype(np.int32))
                    ends.append(np.r_[0, b, size].astype(np.int32))
                    sizes.append(size)
                    decoded.append(model.decode(full))
                cuts = pa.array(np.cumsum([0, *map(len, ids)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(x).astype(np.int32))) for x in (ids, starts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(i) for i in ids], pa.int64()), *lists,
                     pa.array([i.tobytes() for i in ids], pa.binary()), pa.array(sizes, pa.int64()), pa.array(decoded, pa.string())],
                    ["doc_id", "n_tokens", "ids", "starts", "ends", "ids_le", "source_bytes", "decoded"],
                )

    kind = df.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids array<int>, starts array<int>, ends array<int>, ids_le binary, source_bytes long, decoded string"
    return df.select(df[doc_id].alias("doc_id"), df[text].alias("text")).mapInArrow(released(run), schema)
