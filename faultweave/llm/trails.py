"""Cheapest edits of a run of conversation rows, as linked prefixes that are never copied.

A prefix of edits is a node: its last edit, its parent, its length, a rolling hash of all
its edits and its ancestors at powers of two. Prefixes share their beginnings, so a step
adds one node per state. Of prefixes that cost the same the ASCII-least stays: binary
lifting finds, by the hashes, the longest beginning that two have in common; where its ends
are different nodes they are compared edit by edit, so a collision of hashes cannot decide.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache
from typing import NamedTuple

#: What the kept role initials end in: nothing yet, s, u or a.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
ROLES = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: The role that may follow each state, besides a system row at the very beginning.
NEXT = (USER, USER, ASSISTANT, USER)
#: How a repaired conversation may end: state, inserts that are missing.
ENDS = ((START, 0), (SYSTEM, 2), (USER, 1), (ASSISTANT, 0))

MODULUS = (1 << 61) - 1
BASE = 911_382_323


class Step(NamedTuple):
    """A row: the initial of its role, whether it must go, whether it is truncated, copies after it that go."""

    initial: str
    forced: bool
    truncated: bool
    copies: int


def follows(state: int, initial: str) -> int | None:
    """The state after a row of this initial is kept, or None."""
    if initial == "s":
        return SYSTEM if state == START else None
    return NEXT[state] if initial and "  ua"[NEXT[state]] == initial else None


@cache
def moves(initial: str, forced: bool, truncated: bool) -> tuple[tuple[tuple[int, int, str], ...], ...]:
    """For each state after a row, the ways to get there: state before, cost, edits.

    An insertion before a deletion is left out: after it costs as much and sorts earlier.
    Two insertions at most are of use, since a third gives the state after the first.
    """
    ways: list[list[tuple[int, int, str]]] = [[] for _ in range(STATES)]
    extra = TRUNCATED if truncated else 0
    for before in range(STATES):
        ways[before].append((before, DELETE, "D"))
        if forced:
            continue
        state, seen = before, set()
        for n in range(3):
            if state in seen:
                break
            seen.add(state)
            kept = follows(state, initial)
            if kept is not None:
                ways[kept].append((before, INSERT * n + extra, "I" * n + "K"))
            ways[NEXT[state]].append((before, INSERT * n + extra + REROLE, "I" * n + "R"))
            state = NEXT[state]
    return tuple(map(tuple, ways))


class Trails:
    """Prefixes of edits as linked nodes; node 0 is the empty prefix."""

    def __init__(self, modulus: int = MODULUS) -> None:
        self.modulus = modulus
        self.edit = [""]
        self.depth = [0]
        self.hash = [0]
        self.up: list[tuple[int, ...]] = [()]
        self.same: set[tuple[int, int]] = set()

    def add(self, parent: int, edits: str) -> int:
        for edit in edits:
            node = len(self.edit)
            ups, at, k = [], parent, 0
            while True:
                ups.append(at)
                if len(self.up[at]) <= k:
                    break
                at = self.up[at][k]
                k += 1
            self.edit.append(edit)
            self.depth.append(self.depth[parent] + 1)
            self.hash.append((self.hash[parent] * BASE + ord(edit)) % self.modulus)
            self.up.append(tuple(ups))
            parent = node
        return parent

    def _at_depth(self, node: int, depth: int) -> int:
        surplus = self.depth[node] - depth
        while surplus:
            k = surplus.bit_length() - 1
            node = self.up[node][k]
            surplus -= 1 << k
        return node

    def _first_difference(self, a: int, b: int) -> tuple[int, int] | None:
        """Of two nodes of equal depth, their earliest ancestors whose edits differ, by a walk."""
        found, x, y = None, a, b
        while x != y and (x, y) not in self.same:
            if self.edit[x] != self.edit[y]:
                found = (x, y)
            x, y = self.up[x][0], self.up[y][0]
        if found is None:
            self.same.add((a, b))
        return found

    def less(self, a: int, b: int) -> bool:
        """Whether the edits of ``a`` sort before those of ``b``."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self._at_depth(a, depth), self._at_depth(b, depth)
        if self.hash[x] != self.hash[y]:
            for k in range(depth.bit_length(), -1, -1):
                ups, others = self.up[x], self.up[y]
                if k < len(ups) and k < len(others) and self.hash[ups[k]] != self.hash[others[k]]:
                    x, y = ups[k], others[k]
            # the longest common prefix ends at the parents of x and y, if their hashes tell the truth
            differ = self._first_difference(self.up[x][0], self.up[y][0]) or (x, y)
        else:
            differ = self._first_difference(x, y)
        if differ is None:
            return self.depth[a] < self.depth[b]
        return self.edit[differ[0]] < self.edit[differ[1]]

    def text(self, node: int) -> str:
        edits = []
        while node:
            edits.append(self.edit[node])
            node = self.up[node][0]
        return "".join(reversed(edits))


def run(steps: Sequence[Step], start: int, trails: Trails) -> list[tuple[int, int] | None]:
    """For each state after ``steps`` the cheapest cost from ``start`` and its node, ASCII-least."""
    best: list[tuple[int, int] | None] = [None] * STATES
    best[start] = (0, 0)
    for step in steps:
        after: list[tuple[int, int] | None] = [None] * STATES
        for state, ways in enumerate(moves(step.initial, step.forced, step.truncated)):
            least, chosen = None, []
            for before, cost, edits in ways:
                held = best[before]
                if held is None:
                    continue
                cost += held[0]
                if least is None or cost < least:
                    least, chosen = cost, [(held[1], edits)]
                elif cost == least:
                    chosen.append((held[1], edits))
            if least is None:
                continue
            node = trails.add(*chosen[0])
            for other in chosen[1:]:
                rival = trails.add(*other)
                if trails.less(rival, node):
                    node = rival
            after[state] = (least + DELETE * step.copies, node)
        best = after
    return best


class Summary(NamedTuple):
    """What a run of rows does to each state before it: costs (-1: none) and ranks by edits, 16 each."""

    costs: list[int]
    ranks: list[int]


def ranks(ends: Sequence[tuple[int, int] | None], trails: Trails) -> list[int]:
    """The place of each state's edits in ASCII order; none is the beginning of another."""
    rank = [0] * STATES
    for a in range(STATES):
        for b in range(STATES):
            if a != b and ends[a] and ends[b] and trails.less(ends[b][1], ends[a][1]):
                rank[a] += 1
    return rank


def summarise(steps: Sequence[Step], starts: Sequence[int]) -> Summary:
    costs, order = [-1] * STATES**2, [0] * STATES**2
    for start in starts:
        trails = Trails()
        ends = run(steps, start, trails)
        costs[start * STATES : (start + 1) * STATES] = [-1 if e is None else e[0] for e in ends]
        order[start * STATES : (start + 1) * STATES] = ranks(ends, trails)
    return Summary(costs, order)


def compose(costs: Sequence[int], rank: Sequence[int], nxt: Summary) -> tuple[list[int], list[int], list[int]]:
    """Costs, ranks and states before, for each state after one more run of rows.

    All prefixes that reach a bound between rows hold an edit per row and end in one, so none
    is the beginning of another and the first difference decides: ties go by rank alone.
    """
    total, back = [-1] * STATES, [-1] * STATES
    for after in range(STATES):
        for before in range(STATES):
            more = nxt.costs[before * STATES + after]
            if costs[before] < 0 or more < 0:
                continue
            cost = costs[before] + more
            if total[after] < 0 or (cost, rank[before]) < (total[after], rank[back[after]]):
                total[after], back[after] = cost, before
    keys = [(rank[b], nxt.ranks[b * STATES + a]) if b >= 0 else (0, 0) for a, b in enumerate(back)]
    order = [sum(keys[b] < keys[a] for b in range(STATES) if back[b] >= 0) for a in range(STATES)]
    return total, order, back


def best_end(costs: Sequence[int], rank: Sequence[int]) -> tuple[int, int]:
    """The state in which a conversation should end, and the insertions missing there."""
    return min(
        (costs[state] + INSERT * missing, rank[state], state, missing) for state, missing in ENDS if costs[state] >= 0
    )[2:]


def spell(edits: str, steps: Sequence[Step], missing: int) -> str:
    """The edits with those of the copies after each row, and the insertions at the end."""
    rows = iter(steps)
    return "".join(e if e == "I" else e + "D" * next(rows).copies for e in edits) + "I" * missing


def apply(edits: str, missing: int, start: int, roles: Sequence[str], texts: Sequence[str]) -> list[tuple[str, str]]:
    """The rows that these edits (without those of copies) leave."""
    state, at, rows = start, 0, []
    for edit in edits + "I" * missing:
        if edit == "I":
            state = NEXT[state]
            rows.append((ROLES[state], ""))
            continue
        if edit == "K":
            state = follows(state, roles[at][:1])
            rows.append((roles[at], texts[at]))
        elif edit == "R":
            state = NEXT[state]
            rows.append((ROLES[state], texts[at]))
        at += 1
    return rows
