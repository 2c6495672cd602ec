"""Weighted finite-state transducers: composition and best paths.

A transducer reads one symbol at a time, writes one for it and adds the arc's weight. It may have several arcs for a
symbol, which lets it guess what comes later; a guess that does not come true ends in a state that is not final.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Transducer:
    start: int = 0
    final: set[int] = field(default_factory=set)
    arcs: dict[tuple[int, str], list[tuple[int, str, float]]] = field(default_factory=dict)  # (state, read) -> to, written, weight

    def add(self, state: int, read: str, to: int, write: str | None = None, weight: float = 0.0) -> None:
        self.arcs.setdefault((state, read), []).append((to, read if write is None else write, weight))

    @property
    def alphabet(self) -> set[str]:
        return {read for _, read in self.arcs}


def compose(first: Transducer, second: Transducer) -> Transducer:
    """Reads what ``first`` reads and writes what ``second`` makes of its output; weights add up. Only pairs of states
    that can be reached are made."""
    out, names, open_ = Transducer(), {(first.start, second.start): 0}, [(first.start, second.start)]
    alphabet = sorted(first.alphabet)
    while open_:
        pair = open_.pop()
        a, b = pair
        if a in first.final and b in second.final:
            out.final.add(names[pair])
        for read in alphabet:
            for to_a, middle, w in first.arcs.get((a, read), ()):
                for to_b, write, v in second.arcs.get((b, middle), ()):
                    to = (to_a, to_b)
                    if to not in names:
                        names[to] = len(names)
                        open_.append(to)
                    out.add(names[pair], read, names[to], write, w + v)
    return out


def best_path(machine: Transducer, symbols: list[str]) -> tuple[float, list[str]] | None:
    """Largest weight of a path that reads all symbols and ends in a final state, and what it writes; None without one.

    Of equally heavy paths the one with the first output in order.
    """
    reached: dict[int, float] = {machine.start: 0.0}
    steps: list[dict[int, tuple[int, str]]] = []
    for symbol in symbols:
        following: dict[int, float] = {}
        back: dict[int, tuple[int, str]] = {}
        for state, weight in reached.items():
            for to, write, w in machine.arcs.get((state, symbol), ()):
                value = weight + w
                if to not in following or value > following[to] or value == following[to] and write < back[to][1]:
                    following[to], back[to] = value, (state, write)
        reached = following
        steps.append(back)
    ends = [(weight, -state) for state, weight in reached.items() if state in machine.final]
    if not ends:
        return None
    weight, state = max(ends)
    state, written = -state, []
    for back in reversed(steps):
        state, write = back[state]
        written.append(write)
    return weight, written[::-1]
