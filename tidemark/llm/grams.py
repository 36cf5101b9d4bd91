"""Counting byte windows and words inside tasks, with bounded memory."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tidemark.llm.common import pack_windows

#: Bytes that are windowed at once; distinct keys and words that a task holds before it hands them on.
SLICE, HELD_KEYS, HELD_WORDS = 2_000_000, 4_000_000, 400_000


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One sorted part of all, which are taken from the list so that they go before the sort."""
    if len(parts) == 1:
        return parts.pop()
    keys, n = (np.concatenate(c) for c in zip(*parts, strict=True))
    parts.clear()
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    n = n[order]
    del order
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(n, first)


class WindowCounter:
    """Counts of all windows of ``width`` bytes, handed on when many distinct ones are held."""

    def __init__(self, width: int):
        self.width, self.open, self.size = width, [], 0
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, data: bytes, pad: bytes, mark: int | None = None) -> None:
        """Windows that end inside ``data``; ``pad`` is what stands before it, width - 1 bytes.

        A ``mark`` of one bit (of windows of at most 7 bytes) is counted as a part of the window, below it.
        """
        at = 0
        while at < len(data):
            piece = data[at : at + SLICE]
            before = pad if at == 0 else data[at - self.width + 1 : at]
            windows = pack_windows(np.frombuffer(before + piece, np.uint8), self.width)
            self.open.append(windows if mark is None else windows << np.uint64(1) | np.uint64(mark))
            self.size += len(piece)
            at += SLICE
            if self.size >= SLICE:
                self.close()

    def close(self) -> None:
        if self.open:
            # Sorted in place, and pieces let go first: every worker of an executor holds these at once.
            windows, self.open, self.size = np.concatenate(self.open), [], 0
            windows.sort()
            first = np.flatnonzero(np.r_[True, windows[1:] != windows[:-1]])
            self.parts.append((windows[first], np.diff(np.r_[first, len(windows)])))
            del windows, first
            # Most distinct windows come again, so merging at once holds far fewer; sizes that double keep it cheap.
            while len(self.parts) > 1 and 2 * len(self.parts[-1][0]) >= len(self.parts[-2][0]):
                last = [self.parts.pop(), self.parts.pop()]
                self.parts.append(_merged(last))

    def full(self) -> bool:
        if sum(len(k) for k, _ in self.parts) < HELD_KEYS:
            return False
        self.parts = [self.merged()]
        return len(self.parts[0][0]) >= HELD_KEYS // 2

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        self.close()
        if not self.parts:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        parts, self.parts = self.parts, []
        return _merged(parts)

    def drain(self) -> tuple[np.ndarray, np.ndarray]:
        return self.merged()


def batches_of(names: list[str], *columns, size: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``size`` rows."""
    n = len(columns[0])
    for at in range(0, n, size):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + size]) for c in columns], names)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words; white space is blank and 0x09 to 0x0D."""
    return (text or "").encode().lower().split()


def count_words(batches: Iterator[pa.RecordBatch], end: str) -> Iterator[pa.RecordBatch]:
    """(word, n) of the texts in the first column, with one ``end`` for each text."""
    held: Counter[bytes] = Counter()
    for batch in batches:
        for text in batch.column(0):
            held.update(words_of(text.as_py()))
        held[end.encode()] += len(batch)
        if len(held) >= HELD_WORDS:
            yield from batches_of(["word", "n"], [w.decode() for w in held], list(held.values()))
            held = Counter()
    if held:
        yield from batches_of(["word", "n"], [w.decode() for w in held], list(held.values()))
