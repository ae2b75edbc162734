"""A minimal acyclic transducer: sorted words in, the word's number out, suffixes shared.

Each transition carries how many words sort before it in its state, so the sum along a path is
the word's number among all words; the id sequences stand in a table by that number. The
arrays lie one after another in a file that workers map into memory.
"""

from __future__ import annotations

import hashlib
import os
import tempfile

import numpy as np


class Lexicon:
    def __init__(self, blob: memoryview | np.ndarray):
        head = np.frombuffer(blob, np.int64, 6)
        at, self.parts = 48, []
        for n, kind in zip(head, (np.int64, np.int32, np.int32, np.uint8, np.int64, np.int32), strict=True):
            self.parts.append(np.frombuffer(blob, kind, int(n), at))
            at += -(-int(n) * np.dtype(kind).itemsize // 8) * 8
        self.keys, self.targets, self.skips, self.final, self.starts, self.outputs = self.parts

    def __len__(self) -> int:
        return len(self.starts) - 1

    @property
    def states(self) -> int:
        return len(self.final)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 where it is not in the lexicon; all words walk together, a byte a step."""
        n = len(words)
        if not n or not len(self):
            return np.full(n, -1, np.int64)
        sizes = np.fromiter(map(len, words), np.int64, n)
        data, offsets = np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], np.cumsum(sizes)[:-1]])
        state, number = np.zeros(n, np.int64), np.zeros(n, np.int64)
        live = np.arange(n)
        for step in range(int(sizes.max(initial=0))):
            live = live[sizes[live] > step]
            if not len(live):
                break
            key = state[live] << 8 | data[offsets[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            number[live[~hit]], sizes[live[~hit]] = -1, 0
            live, at = live[hit], at[hit]
            number[live] += self.skips[at]
            state[live] = self.targets[at]
        return np.where((number >= 0) & (self.final[state] == 1), number, -1)

    def ids(self, number: int) -> tuple[int, ...]:
        return tuple(self.outputs[self.starts[number] : self.starts[number + 1]].tolist())


def compiled(entries: dict[bytes, tuple[int, ...]]) -> bytes:
    """Builds the automaton from sorted words, merging equal states as soon as they are finished."""
    words = sorted(entries)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, list[tuple[int, int]]]] = []

    def finish(node) -> int:
        final, edges = node[0], tuple(node[1])
        key = (final, edges)
        if key not in register:
            register[key] = len(states)
            states.append((final, list(edges)))
        return register[key]

    path: list[list] = [[False, []]]
    previous = b""
    for word in words:
        common = 0
        while common < min(len(word), len(previous)) and word[common] == previous[common]:
            common += 1
        while len(path) - 1 > common:
            done = finish(path.pop())
            path[-1][1].append((previous[len(path) - 1], done))
        path += [[False, []] for _ in word[common:]]
        path[-1][0] = True
        previous = word
    while len(path) > 1:
        done = finish(path.pop())
        path[-1][1].append((previous[len(path) - 1], done))
    root = finish(path[0])
    order = {root: 0}  # the start is state 0
    for s in range(len(states)):
        order.setdefault(s, len(order))
    count = [0] * len(states)
    for s, (final, edges) in enumerate(states):  # targets are finished before their sources
        count[s] = final + sum(count[t] for _, t in edges)
    rows = []
    for s, (final, edges) in enumerate(states):
        before = int(final)
        for label, t in edges:
            rows.append((order[s] << 8 | label, order[t], before))
            before += count[t]
    rows.sort()
    final = np.zeros(len(states), np.uint8)
    for s, (f, _) in enumerate(states):
        final[order[s]] = f
    outputs = [entries[w] for w in words]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in outputs])]).astype(np.int64) if outputs else np.zeros(1, np.int64)
    parts = [np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int32), np.array([r[2] for r in rows], np.int32), final, starts, np.array([i for x in outputs for i in x], np.int32)]
    out = np.array([len(p) for p in parts], np.int64).tobytes()
    for p in parts:
        raw = p.tobytes()
        out += raw + b"\0" * (-len(raw) % 8)
    return out


_mapped: dict[str, Lexicon] = {}


def mapped(blob: bytes) -> Lexicon:
    """The lexicon mapped from a file in the worker's own temporary folder. The name is removed at once; the pages stay as long as the map."""
    name = hashlib.sha256(blob).hexdigest()
    if name not in _mapped:
        fd, path = tempfile.mkstemp(prefix="lexicon-")
        try:
            with os.fdopen(fd, "wb") as f:
                f.write(blob)
            _mapped.clear()
            _mapped[name] = Lexicon(np.memmap(path, np.uint8, "r"))
        finally:
            os.unlink(path)
    return _mapped[name]
