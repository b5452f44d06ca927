"""A minimal acyclic transducer from words to id sequences, built from sorted words and read from a mapped file.

States of the same transitions, outputs and finality are one state, so that words share suffixes as well as prefixes. The
output of a word is what stands on its path; outputs are pushed towards the start as far as the words of a state agree.
The file holds the transitions sorted by state and label, so that all words of a batch take a step by one search.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

Ids = tuple[int, ...]


class _State:
    __slots__ = ("final", "last", "next")

    def __init__(self) -> None:
        self.next: dict[int, list] = {}  # label -> [state, output]
        self.final: Ids | None = None  # what follows at the end of a word, None where none ends
        self.last = -1

    def signature(self) -> tuple:
        return self.final, tuple((label, id(state), out) for label, (state, out) in self.next.items())


def _common(a: Ids, b: Ids) -> int:
    n = 0
    while n < len(a) and n < len(b) and a[n] == b[n]:
        n += 1
    return n


def compiled(words: Iterable[tuple[bytes, Ids]]) -> bytes:
    """The file of the transducer of distinct words in the order of their bytes."""
    root, register, path = _State(), {}, [_State()]
    path, before = [root], b""

    def close(down_to: int) -> None:
        while len(path) - 1 > down_to:
            state = path.pop()
            label = path[-1].last
            path[-1].next[label][0] = register.setdefault(state.signature(), state)

    for word, ids in words:
        same = 0
        while same < len(before) and same < len(word) and before[same] == word[same]:
            same += 1
        close(same)
        for depth in range(same):  # what the words so far don't share with this one moves down
            edge = path[depth].next[word[depth]]
            n = _common(edge[1], ids)
            edge[1], rest, ids = edge[1][:n], edge[1][n:], ids[n:]
            if rest:
                state = edge[0]
                for e in state.next.values():
                    e[1] = rest + e[1]
                if state.final is not None:
                    state.final = rest + state.final
        for label in word[same:]:
            state = _State()
            path[-1].next[label], path[-1].last, ids = [state, ids], label, ()
            path.append(state)
        path[-1].final = ids if path[-1].final is None else path[-1].final
        before = word
    close(0)
    return _file(root)


def _file(root: _State) -> bytes:
    number, order, pool, outputs = {id(root): 0}, [root], [()], {(): 0}

    def output(ids: Ids) -> int:
        if ids not in outputs:
            outputs[ids] = len(pool)
            pool.append(ids)
        return outputs[ids]

    keys, targets, outs, finals = [], [], [], []
    for state in order:  # grows as states are met
        finals.append(-1 if state.final is None else output(state.final))
        for label, (to, out) in sorted(state.next.items()):
            if id(to) not in number:
                number[id(to)] = len(order)
                order.append(to)
            keys.append(number[id(state)] << 8 | label)
            targets.append(number[id(to)])
            outs.append(output(out))
    ends = np.cumsum([0, *map(len, pool)])
    parts = [np.array(x, dtype="<i8") for x in (keys, targets, outs, finals, ends, [i for ids in pool for i in ids])]
    return b"".join(p.tobytes() for p in (np.array([len(p) for p in parts], dtype="<i8"), *parts))


class Transducer:
    """A compiled transducer, mapped into memory: processes of a machine share its pages."""

    def __init__(self, path: str):
        raw = np.asarray(np.memmap(path, dtype="<i8", mode="r"))
        ends = np.cumsum([6, *raw[:6].tolist()])
        self.keys, self.targets, self.outs, self.finals, self.pool, self.ids = (raw[i:j] for i, j in zip(ends, ends[1:], strict=False))

    def __len__(self) -> int:
        return len(self.finals)

    def look_up(self, words: list[bytes]) -> list[Ids | None]:
        """The ids of each word, None for those that aren't in it; all words take a step at a time."""
        found: list[Ids | None] = [None] * len(words)
        length = np.array([len(w) for w in words], dtype=np.int64)
        flat, begin = np.frombuffer(b"".join(words), dtype=np.uint8), np.cumsum(length) - length
        live, state, step = np.arange(len(words)), np.zeros(len(words), dtype=np.int64), 0
        held: dict[int, Ids] = {}

        def add(which: np.ndarray, outs: np.ndarray) -> None:
            some = outs > 0
            outs = outs[some]
            for w, i, j in zip(which[some].tolist(), self.pool[outs].tolist(), self.pool[outs + 1].tolist(), strict=True):
                held[w] = held.get(w, ()) + tuple(self.ids[i:j].tolist())

        while len(live):
            ended = length[live] == step
            final = self.finals[state[ended]]
            done = live[ended][final >= 0]
            add(done, final[final >= 0])
            for w in done.tolist():
                found[w] = held.get(w, ())
            live, state = live[~ended], state[~ended]
            wanted = state << 8 | flat[begin[live] + step]
            at = np.searchsorted(self.keys, wanted)
            at[at == len(self.keys)] = 0
            there = self.keys[at] == wanted if len(self.keys) else np.zeros(len(live), dtype=bool)
            live, at = live[there], at[there]
            add(live, self.outs[at])
            state, step = self.targets[at], step + 1
        return found
