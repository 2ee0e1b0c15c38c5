"""The command language: 'op' 'argument' pairs separated by semicolons.

ce<int> toggles a level's expansion; se<id-id> toggles a path's selection;
sp<int> sizes a level by specialization; qc<spec> switches the spec if known;
mi<digit><id,id> replaces a level's include list; sl<seconds> waits, which
means nothing in a batch.  Unknown opcodes and levels that do not exist are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from ..model import Control, QuerySpec
from ..operators.selection import toggled


@dataclass(frozen=True)
class State:
    """What a view shows: the spec, its controls, the selection and the expanded level."""

    spec: QuerySpec
    controls: tuple[Control, ...]
    selection: frozenset[str] = field(default_factory=frozenset)
    expanded: int | None = None


def start(spec: QuerySpec) -> State:
    return State(spec, tuple(spec.controls()))


def leading_int(text: str) -> int | None:
    """The whole number that a text begins with."""
    m = re.match(r"\s*([+-]?\d+)", text)
    return int(m[1]) if m else None


def apply_command(state: State, command: str, specs: dict[str, QuerySpec]) -> State:
    op, arg = command[:2], command[2:]
    number = leading_int(arg)
    if op == "ce" and number is not None:
        return replace(state, expanded=None if state.expanded == number else number)
    if op == "se":
        return replace(state, selection=toggled(state.selection, arg))
    if op == "sp" and number is not None and 0 <= number < len(state.controls):
        return _with_control(state, number, size_base="specialization")
    if op == "qc" and arg in specs:
        return start(specs[arg])
    if op == "mi" and arg[:1].isdigit() and int(arg[0]) < len(state.controls):
        return _with_control(state, int(arg[0]), include=tuple(arg[1:].split(",")))
    return state


def _with_control(state: State, level: int, **changes: object) -> State:
    changed = replace(state.controls[level], **changes)
    return replace(state, controls=(*state.controls[:level], changed, *state.controls[level + 1 :]))


def replay(state: State, text: str, specs: dict[str, QuerySpec]) -> State:
    """The state after all commands of a text, from the loaded state on."""
    for command in text.split(";"):
        state = apply_command(state, command, specs)
    return state
