"""Steps of a path, as each mode reads them.

``multi`` keeps a state for every entity and knows select, exec and global type seeds; ``single`` follows one set, and
keeps the sources of a type step.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

OPEN, CLOSE, SEPARATOR = "<PATH>", "</PATH>", "<SEP>"
_PATH = re.compile(f"{OPEN}(.*?){CLOSE}")


@dataclass(frozen=True)
class Hop:
    """To the targets of a label."""

    label: str


@dataclass(frozen=True)
class TypeSeed:
    """All sources of a label, whatever the state was."""

    label: str


@dataclass(frozen=True)
class TypeKeep:
    """Only nodes that are a source of a label."""

    label: str


@dataclass(frozen=True)
class Filter:
    """Only nodes with a description that has all, or any, of the words."""

    words: tuple[str, ...]
    every: bool
    text: str


@dataclass(frozen=True)
class Select:
    """Changes nothing."""

    text: str


@dataclass(frozen=True)
class Combine:
    """Nodes of a type that all entities reached ("common"), or an odd number of them ("difference")."""

    operation: str
    node_type: str


Step = Hop | TypeSeed | TypeKeep | Filter | Select | Combine


def parse_path(text: str) -> list[str]:
    """Steps of the first tagged path of a text; none without one."""
    found = _PATH.search(text)
    return found[1].split(SEPARATOR) if found else []


def render_path(steps: Sequence[str]) -> str:
    return OPEN + SEPARATOR.join(steps) + CLOSE


def parse_filter(expression: str) -> Filter:
    text = expression.strip().lower()
    for word, every in ((" and ", True), (" or ", False)):
        if word in text:
            return Filter(tuple(c.strip() for c in text.split(word)), every, expression.strip())
    return Filter((text,), True, expression.strip())


def parse_step(step: str, mode: str) -> Step:
    """Precedence: multi reads select, exec, type, filter, hop; single reads filter, type, hop."""
    if mode == "multi":
        if step.startswith("select"):
            return Select(step)
        if step.startswith("exec_"):
            operation, _, node_type = step.removeprefix("exec_").partition(" ")
            return Combine(operation.strip(), node_type.strip())
        if "_type" in step:
            return TypeSeed(step)
    if step.startswith("filter "):
        return parse_filter(step.removeprefix("filter "))
    return TypeKeep(step) if "_type" in step else Hop(step)


def compile_path(path: str | Sequence[str], mode: str) -> list[Step]:
    steps = parse_path(path) if isinstance(path, str) else path
    return [parse_step(s, mode) for s in steps]


@dataclass(frozen=True)
class TrieStep:
    """A step as a node of a trie: it follows ``parent`` (0: the start), ``depth`` steps from the start."""

    node: int
    parent: int
    depth: int
    step: Step


@dataclass(frozen=True)
class Trie:
    """Many paths, their common beginnings once.  ends: the last node of each path."""

    steps: tuple[TrieStep, ...]
    ends: dict[int, int]

    def route(self, node: int) -> list[int]:
        """The nodes from the start to ``node``."""
        out: list[int] = []
        while node:
            out.append(node)
            node = self.steps[node - 1].parent
        return out[::-1]

    def depth(self, node: int) -> int:
        return self.steps[node - 1].depth if node else 0


def path_trie(paths: Mapping[int, str | Sequence[str]]) -> Trie:
    """The trie of single-mode paths; steps that mean the same are one, however they are spelled."""
    steps: list[TrieStep] = []
    known: dict[tuple, int] = {}
    ends: dict[int, int] = {}
    for path_id, path in paths.items():
        at = 0
        for depth, step in enumerate(compile_path(path, "single"), 1):
            meaning = (at, (step.words, step.every) if isinstance(step, Filter) else step)
            if meaning not in known:
                steps.append(TrieStep(len(steps) + 1, at, depth, step))
                known[meaning] = len(steps)
            at = known[meaning]
        ends[path_id] = at
    return Trie(tuple(steps), ends)


def without_no_ops(steps: Sequence[Step]) -> list[Step]:
    return [s for s in steps if not isinstance(s, Select)]


def is_dead(steps: Sequence[Step], labels: frozenset[str]) -> bool:
    """Whether a step's label is in no edge, so that the final set is empty whatever the data."""
    return any(isinstance(s, Hop | TypeSeed | TypeKeep) and s.label not in labels for s in steps)
