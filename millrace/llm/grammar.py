"""Weighted finite-state transducers over clause symbols, their composition, and the best path of a clause.

All transducers here write one symbol for each that they read, so composition is a product of states. Weights are
added along a path and the greatest sum wins.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field


@dataclass
class Transducer:
    """Arcs by state and input symbol: (output, weight, next state). State 0 is the start; states with a final weight may end."""

    arcs: list[dict[str, list[tuple[str, float, int]]]] = field(default_factory=lambda: [{}])
    final: dict[int, float] = field(default_factory=dict)

    def state(self, final: float | None = None) -> int:
        self.arcs.append({})
        if final is not None:
            self.final[len(self.arcs) - 1] = final
        return len(self.arcs) - 1

    def arc(self, start: int, read: str, end: int, write: str | None = None, weight: float = 0.0) -> None:
        self.arcs[start].setdefault(read, []).append((read if write is None else write, weight, end))

    def best(self, symbols: Sequence[str]) -> tuple[float, str] | None:
        """Weight and output of the best path over ``symbols``; of equal weights the path that was first declared."""
        ends: dict[int, tuple[float, int]] = {0: (0.0, -1)}
        trail: list[tuple[str, int]] = []  # output symbol and what came before it
        for read in symbols:
            after: dict[int, tuple[float, int]] = {}
            for state, (weight, before) in ends.items():
                for write, more, to in self.arcs[state].get(read, ()):
                    if to not in after or weight + more > after[to][0]:
                        trail.append((write, before))
                        after[to] = weight + more, len(trail) - 1
            ends = after
        done = [(weight + self.final[state], at) for state, (weight, at) in ends.items() if state in self.final]
        if not done:
            return None
        weight, at = max(done, key=lambda x: x[0])
        out = []
        while at >= 0:
            write, at = trail[at]
            out.append(write)
        return weight, "".join(reversed(out))


def composed(*machines: Transducer) -> Transducer:
    """The machine that feeds what each writes to the next one."""
    first, *rest = machines
    for second in rest:
        first = _product(first, second)
    return first


def _product(a: Transducer, b: Transducer) -> Transducer:
    out, number, todo = Transducer(), {(0, 0): 0}, [(0, 0)]
    while todo:
        x, y = pair = todo.pop()
        here = number[pair]
        if x in a.final and y in b.final:
            out.final[here] = a.final[x] + b.final[y]
        for read, arcs in a.arcs[x].items():
            for middle, w1, nx in arcs:
                for write, w2, ny in b.arcs[y].get(middle, ()):
                    if (nx, ny) not in number:
                        number[nx, ny] = out.state()
                        todo.append((nx, ny))
                    out.arc(here, read, number[nx, ny], write, w1 + w2)
    return out


def window(alphabet: Iterable[str], opens: str, reach: int, rewrite: dict[str, str], weight: float = 0.0) -> Transducer:
    """Rewrites symbols that stand within ``reach`` symbols after one of ``opens``, at ``weight`` each."""
    out = Transducer(final={0: 0.0})
    states = [0, *[out.state(0.0) for _ in range(reach)]]  # by how many symbols are still in reach
    for left, state in enumerate(states):
        for symbol in alphabet:
            to = states[reach] if symbol in opens else states[max(0, left - 1)]
            if left and symbol in rewrite:
                out.arc(state, symbol, to, rewrite[symbol], weight)
            else:
                out.arc(state, symbol, to)
    return out


def promise(alphabet: Iterable[str], needs: str, reach: int, rewrite: dict[str, str], weight: float = 0.0) -> Transducer:
    """Rewrites symbols after which one of ``needs`` follows within ``reach`` symbols: a guess that only such a clause can end."""
    out, alphabet = Transducer(final={0: 0.0}), list(alphabet)
    waiting = [None, *[out.state() for _ in range(reach)]]  # by how many symbols may still come
    for symbol in alphabet:
        out.arc(0, symbol, 0)
        if symbol in rewrite:
            out.arc(0, symbol, waiting[reach], rewrite[symbol], weight)
        for left in range(1, reach + 1):
            if symbol in needs:
                out.arc(waiting[left], symbol, 0)
            elif left > 1:
                out.arc(waiting[left], symbol, waiting[left - 1], rewrite.get(symbol), weight if symbol in rewrite else 0.0)
    return out


def onward(alphabet: Iterable[str], opens: str, rewrite: dict[str, str], weight: float = 0.0) -> Transducer:
    """Rewrites all symbols after one of ``opens``, up to the clause's end."""
    out = Transducer(final={0: 0.0})
    rest = out.state(0.0)
    for symbol in alphabet:
        out.arc(0, symbol, rest if symbol in opens else 0)
        out.arc(rest, symbol, rest, rewrite.get(symbol), weight if symbol in rewrite else 0.0)
    return out
