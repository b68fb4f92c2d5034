"""A minimal acyclic transducer: byte strings to id sequences, in one buffer that can be memory-mapped.

Words are added in byte order; equal suffix states are shared as the automaton grows (incremental minimisation). Each
arc carries how many words sort before the words through it, so the sum along a path is the word's index, which
addresses its id sequence in the output table.

Layout (little-endian uint32): magic, states, arcs, words, ids; then whether each state is final, the arcs' keys
(256 * state + byte, ascending), targets and counts, the first id of each word (words + 1), and the ids.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterable, Iterator, Sequence
from struct import pack

import numpy as np

MAGIC = 0x4D415432


class _State:
    __slots__ = ("arcs", "final", "number", "words")

    def __init__(self):
        self.arcs: dict[int, _State] = {}
        self.final = False
        self.number = -1
        self.words = -1

    def signature(self):
        return (self.final, *((label, id(target)) for label, target in self.arcs.items()))


def compile_lexicon(entries: Iterable[tuple[bytes, Sequence[int]]]) -> bytes:
    """The transducer of distinct (word, ids) entries, in any order."""
    entries = sorted(entries)
    root, shared, path = _State(), {}, []  # path: (parent, label, child) not yet minimised

    def minimise(depth: int) -> None:
        while len(path) > depth:
            parent, label, child = path.pop()
            parent.arcs[label] = shared.setdefault(child.signature(), child)

    last = b""
    for word, _ in entries:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        minimise(common)
        state = path[-1][2] if path else root
        for label in word[common:]:
            state.arcs[label] = child = _State()
            path.append((state, label, child))
            state = child
        state.final = True
        last = word
    minimise(0)

    order: list[_State] = []
    todo = [root]
    while todo:
        state = todo.pop()
        if state.number < 0:
            state.number = len(order)
            order.append(state)
            todo.extend(state.arcs.values())

    def count(top: _State) -> int:
        stack = [top]
        while stack:
            state = stack[-1]
            rest = [x for x in state.arcs.values() if x.words < 0]
            if rest:
                stack.extend(rest)
            else:
                state.words = state.final + sum(x.words for x in state.arcs.values())
                stack.pop()
        return top.words

    count(root)
    final, keys, targets, counts = [], [], [], []
    for state in order:
        final.append(int(state.final))
        before = int(state.final)
        for label, target in sorted(state.arcs.items()):
            keys.append(256 * state.number + label)
            targets.append(target.number)
            counts.append(before)
            before += target.words
    starts, ids = [0], []
    for _, out in entries:
        ids.extend(out)
        starts.append(len(ids))
    numbers = [MAGIC, len(order), len(keys), len(entries), len(ids), *final, *keys, *targets, *counts, *starts, *ids]
    return pack(f"<{len(numbers)}I", *numbers)


class Lexicon:
    """Read-only view of a compiled transducer."""

    def __init__(self, buffer):
        view = np.frombuffer(buffer, np.uint32)
        magic, states, arcs, words, ids = view[:5].tolist()
        if magic != MAGIC:
            raise ValueError("not a compiled lexicon")
        parts, at = [], 5
        for size in (states, arcs, arcs, arcs, words + 1, ids):
            parts.append(view[at : at + size])
            at += size
        self.final, self.keys, self.targets, self.counts, self.starts, self.ids = parts
        self.states, self.size = states, words

    @classmethod
    def open(cls, path: str) -> Lexicon:
        """Memory-map a compiled file; the pages are shared by all processes of a machine."""
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def find(self, words: list[bytes]) -> np.ndarray:
        """The index of each word, -1 for those the lexicon lacks; all words walk the automaton together."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        found = np.full(len(words), -1, np.int64)
        if not self.size:
            return found
        data = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(sizes) - sizes
        walking = np.arange(len(words))
        state, index = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        step = 0
        while len(walking):
            ended = sizes[walking] == step
            last = ended & (self.final[state] > 0)
            found[walking[last]] = index[last]
            walking, state, index = walking[~ended], state[~ended], index[~ended]
            key = 256 * state + data[starts[walking] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
            there = self.keys[arc] == key if len(self.keys) else np.zeros(len(key), bool)
            walking, arc = walking[there], arc[there]
            state, index = self.targets[arc].astype(np.int64), index[there] + self.counts[arc]
            step += 1
        return found

    def outputs(self, index: int) -> np.ndarray:
        """The ids of the word with this index."""
        return self.ids[self.starts[index] : self.starts[index + 1]]

    def __iter__(self) -> Iterator[bytes]:
        """All words, in byte order."""
        stack = [(0, b"")]
        while stack:
            state, prefix = stack.pop()
            if self.final[state]:
                yield prefix
            low, high = np.searchsorted(self.keys, [256 * state, 256 * state + 256])
            for arc in reversed(range(low, high)):
                stack.append((int(self.targets[arc]), prefix + bytes([int(self.keys[arc]) % 256])))
