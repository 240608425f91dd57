"""SQL templates: parameters that are bound, and blocks that are there only if their parameters have values.

``{{name}}`` is a parameter, with or without quotes around it; inside a longer string constant it stands for
its text.  ``{? ... ?}`` is a block, left out if a parameter in it has no value; blocks may hold blocks.  A
template is read once, into pieces; values never become text of a query.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any


@dataclass
class Block:
    """Pieces of SQL, names of parameters and inner blocks, in order."""

    parts: list[str | tuple[str, bool] | Block] = field(default_factory=list)

    def names(self) -> set[str]:
        """All parameters, those of inner blocks too."""
        return set().union(*(p.names() if isinstance(p, Block) else {p[0]} if isinstance(p, tuple) else set() for p in self.parts))

    def own(self) -> set[str]:
        return {p[0] for p in self.parts if isinstance(p, tuple)}


#: What matters in a template; of alternatives at one place the first counts.
_TOKEN = re.compile(
    r"(?P<comment>--[^\n]*|/\*.*?\*/)|(?P<string>'(?:[^'\\]|''|\\.)*')|(?P<quoted>`[^`]*`|\"(?:[^\"\\]|\"\"|\\.)*\")"
    r"|\{\{\s*(?P<name>\w+)\s*\}\}|(?P<open>\{\?)|(?P<close>\?\})|(?P<odd>\{\{|\}\}|/\*|')",
    re.DOTALL,
)
_NAME = re.compile(r"\{\{\s*(\w+)\s*\}\}")


def _line(text: str, at: int) -> str:
    return f"line {text.count(chr(10), 0, at) + 1}"


def parse(text: str) -> Block:
    """A template's pieces; raises ValueError where blocks or braces do not fit.

    Comments are left out, so that what stands in them is neither block nor parameter.
    """
    stack, opened, at = [Block()], [], 0
    for m in _TOKEN.finditer(text):
        stack[-1].parts.append(text[at : m.start()])
        at, kind = m.end(), m.lastgroup
        if kind == "string":
            stack[-1].parts += _string(m["string"])
        elif kind == "quoted":
            stack[-1].parts.append(m[0])
        elif kind == "comment":
            stack[-1].parts.append(" ")
        elif kind == "name":
            stack[-1].parts.append((m["name"], False))
        elif kind == "open":
            opened.append(m.start())
            stack.append(Block())
        elif kind == "close" and opened:
            inner = stack.pop()
            opened.pop()
            stack[-1].parts.append(inner)
        else:
            raise ValueError(f"{_line(text, m.start())}: {m[0]} does not fit")
    if opened:
        raise ValueError(f"{_line(text, opened[-1])}: a block is not closed")
    stack[0].parts.append(text[at:])
    return stack[0]


def _string(constant: str) -> list[str | tuple[str, bool]]:
    """A string constant: itself, the parameter that it consists of, or its pieces joined."""
    pieces = _NAME.split(constant[1:-1])
    if len(pieces) == 1:
        return [constant]
    if pieces[0] == pieces[2] == "" and len(pieces) == 3:
        return [(pieces[1], False)]
    out: list[str | tuple[str, bool]] = ["concat("]
    for i, piece in enumerate(pieces):
        out += [", "] if i else []
        out.append((piece, True) if i % 2 else f"'{piece}'")
    return [*out, ")"]


def render(block: Block, values: dict[str, Any]) -> tuple[str, dict[str, Any]]:
    """SQL with named markers, and the values to bind to them.  Outside of blocks a parameter without a value is null."""
    if missing := block.names() - set(values):
        raise ValueError(f"unknown parameters: {', '.join(sorted(missing))}")
    out, used = [], {}

    def walk(b: Block) -> None:
        for part in b.parts:
            if isinstance(part, Block):
                if all(values[n] is not None for n in part.own()):
                    walk(part)
            elif isinstance(part, tuple):
                name, as_text = part
                used[name] = values[name]
                out.append(f"CAST(:{name} AS STRING)" if as_text else f":{name}")
            else:
                out.append(part)

    walk(block)
    return "".join(out).strip().rstrip(";"), used
