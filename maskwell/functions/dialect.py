"""Regex building blocks for Java's engine that mean what they mean in Python's.

Python's ``\\b \\d \\s`` on text are Unicode-aware in a way neither Java's
default nor its ``(?U)`` mode reproduces, so the classes are spelled out.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import Any

WORD = r"[\p{L}\p{N}_]"
DIGIT = r"\p{Nd}"
# members of a white-space class; use inside square brackets
SPACE = (
    r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)

NOT_AFTER_WORD = rf"(?<!{WORD})"
NOT_BEFORE_WORD = rf"(?!{WORD})"
EDGE = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
NO_EDGE = rf"(?:(?<={WORD})(?={WORD})|(?<!{WORD})(?!{WORD}))"

def behind_group(regex: str) -> str:
    """The regex for a place behind one more capture group: numbered back-references move up by one."""
    return re.sub(
        r"\\(?:([1-9][0-9]?)|.)",
        lambda m: rf"\{int(m[1]) + 1}" if m[1] else m[0],
        regex,
        flags=re.DOTALL,
    )


# Members of Python's classes, for use inside square brackets, with and without its ASCII flag.
_MEMBERS = {
    "digit": (DIGIT, "0-9"),
    "space": (SPACE, r"\t-\r\x20"),
    "word": (r"\p{L}\p{N}_", "A-Za-z0-9_"),
}


class _Writer:
    """Writes the tree that Python's own parser makes of a regex for Java's engine.

    Comments, white space of verbose patterns, names, octal escapes and so on are gone from the tree; flags are looked up
    where they apply. What Java cannot say is refused.
    """

    def __init__(self, regex: str, tree: Any):
        self.regex = regex
        self.tree = tree

    def refuse(self, what: str) -> str:
        raise ValueError(f"{what} cannot be used here: {self.regex!r}")

    def whole(self) -> str:
        flags = self.tree.state.flags
        return self.scoped(self.sequence(self.tree, flags), 0, flags)

    def scoped(self, inner: str, before: int, flags: int) -> str:
        """A group for a change of case rules; Python's ignore case beyond ASCII unless told otherwise."""
        case = re.IGNORECASE | re.ASCII if flags & re.IGNORECASE else re.IGNORECASE
        if before & case == flags & case:
            return inner
        if not flags & re.IGNORECASE:
            return f"(?-iu:{inner})"
        return f"(?i-u:{inner})" if flags & re.ASCII else f"(?iu:{inner})"

    def sequence(self, items: Iterable[tuple[Any, Any]], flags: int) -> str:
        return "".join(getattr(self, str(op).lower())(value, flags) for op, value in items)

    def literal(self, code: int, _flags: int) -> str:
        char = chr(code)
        return char if char.isascii() and (char.isalnum() or char in " _@,;:/=<>~%!'\"") else rf"\x{{{code:x}}}"

    def not_literal(self, code: int, flags: int) -> str:
        return f"[^{self.literal(code, flags)}]"

    def any(self, _value: None, flags: int) -> str:
        return "(?s:.)" if flags & re.DOTALL else r"[^\n]"

    def members(self, name: str, flags: int) -> str:
        return _MEMBERS[name][bool(flags & re.ASCII)]

    def category(self, value: Any, flags: int) -> tuple[str, bool]:
        """Members of a class and whether all others are meant."""
        name = str(value).lower().removeprefix("category_")
        return self.members(name.removeprefix("not_"), flags), name.startswith("not_")

    def in_(self, items: list[tuple[Any, Any]], flags: int) -> str:
        negated, plain, others = False, [], []
        for op, value in items:
            kind = str(op)
            if kind == "NEGATE":
                negated = True
            elif kind == "LITERAL":
                plain.append(rf"\x{{{value:x}}}")
            elif kind == "RANGE":
                plain.append(rf"\x{{{value[0]:x}}}-\x{{{value[1]:x}}}")
            else:
                members, rest = self.category(value, flags)
                (others if rest else plain).append(members)
        if not others:
            return f"[{'^' if negated else ''}{''.join(plain)}]"
        choices = ([f"[{''.join(plain)}]"] if plain else []) + [f"[^{o}]" for o in others]
        either = choices[0] if len(choices) == 1 else f"(?:{'|'.join(choices)})"
        return f"(?:(?!{either})(?s:.))" if negated else either

    def branch(self, value: tuple[None, list[Any]], flags: int) -> str:
        return f"(?:{'|'.join(self.sequence(b, flags) for b in value[1])})"

    def subpattern(self, value: tuple[int | None, int, int, Any], flags: int) -> str:
        group, add, drop, inner = value
        now = (flags | add) & ~drop
        if add & re.ASCII:
            now &= ~re.UNICODE
        if add & re.UNICODE:
            now &= ~re.ASCII
        text = self.scoped(self.sequence(inner, now), flags, now)
        return f"(?:{text})" if group is None else f"({text})"

    def repeat(self, value: tuple[int, Any, Any], flags: int, suffix: str) -> str:
        low, high, inner = value
        times = f"{{{low},}}" if str(high) == "MAXREPEAT" else f"{{{low},{high}}}"
        return f"(?:{self.sequence(inner, flags)}){times}{suffix}"

    def max_repeat(self, value: tuple[int, Any, Any], flags: int) -> str:
        return self.repeat(value, flags, "")

    def min_repeat(self, value: tuple[int, Any, Any], flags: int) -> str:
        return self.repeat(value, flags, "?")

    def possessive_repeat(self, value: tuple[int, Any, Any], flags: int) -> str:
        return self.repeat(value, flags, "+")

    def atomic_group(self, inner: Any, flags: int) -> str:
        return f"(?>{self.sequence(inner, flags)})"

    def assert_(self, value: tuple[int, Any], flags: int) -> str:
        return f"(?{'=' if value[0] > 0 else '<='}{self.sequence(value[1], flags)})"

    def assert_not(self, value: tuple[int, Any], flags: int) -> str:
        return f"(?{'!' if value[0] > 0 else '<!'}{self.sequence(value[1], flags)})"

    def failure(self, _value: None, _flags: int) -> str:
        return "(?!)"

    def groupref(self, group: int, _flags: int) -> str:
        if group > 98:
            self.refuse("a reference to a group beyond the 98th")
        return rf"(?:\{group})"

    def groupref_exists(self, _value: Any, _flags: int) -> str:
        return self.refuse("a choice by whether a group has matched")

    def at(self, value: Any, flags: int) -> str:
        name = str(value).lower().removeprefix("at_")
        lines = flags & re.MULTILINE
        word = f"[{self.members('word', flags)}]"
        return {
            "beginning": r"(?:\A|(?<=\n))" if lines else r"\A",
            "beginning_string": r"\A",
            # only \n is a line end
            "end": r"(?=\n|\z)" if lines else r"(?=\n?\z)",
            "end_string": r"\z",
            "boundary": rf"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))",
            "non_boundary": rf"(?:(?<={word})(?={word})|(?<!{word})(?!{word}))",
        }[name]


# names of the tree's nodes that are words of the language
setattr(_Writer, "in", _Writer.in_)
setattr(_Writer, "assert", _Writer.assert_)


def from_python(regex: str) -> str:
    """Restate a user's Python regex for Spark's regex functions, so that it means the same.

    Raises ``ValueError`` for what Java's engine cannot say: choices by whether a group has matched.
    """
    tree = re._parser.parse(regex)  # what re.compile itself works on
    return _Writer(regex, tree).whole()
