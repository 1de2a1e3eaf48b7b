"""Regular expressions of matchers and relabel rules: RE2's syntax, translated to Java's.

RE2 has no look-around, back references, atomic groups or possessive quantifiers, and Java would take
them; Java reads [ and && inside a class as operators, RE2 as characters; names of groups and some
classes are spelled differently. A pattern is read once, checked and respelled.
"""

from __future__ import annotations

import re as _re
from dataclasses import dataclass
from functools import cache

import regex as _engine

#: POSIX classes by the characters in them.
POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9",
    "graph": "!-~", "lower": "a-z", "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r ", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
BLANK = r"\t\n\f\r "
REPEAT = _re.compile(r"[*+?]|\{\d+(?:,\d*)?\}")
MOST_REPEATS = 1000


class PatternError(ValueError):
    """A pattern that is not of RE2's syntax."""


@dataclass(frozen=True)
class Pattern:
    java: str
    groups: int
    names: tuple[tuple[str, int], ...]

    @property
    def index(self) -> dict[str, int]:
        return dict(self.names)

    def accepts(self, value: str) -> bool:
        """Whether the whole value matches, on the driver."""
        return _engine.compile(_for_driver(self.java), _engine.S | _engine.V1).fullmatch(value) is not None


def _for_driver(java: str) -> str:
    """The pattern in the spelling of the driver's engine."""
    return _re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: rf"\U{int(m[1], 16):08X}", java.replace(r"\z", r"\Z"))


class _Reader:
    def __init__(self, text: str) -> None:
        self.text, self.at, self.out = text, 0, []
        self.groups, self.names = 0, []
        self.open: list[int] = []

    def fail(self, why: str) -> None:
        raise PatternError(f"{why} at {self.at} in {self.text!r}")

    def read(self) -> Pattern:
        repeatable = False
        while self.at < len(self.text):
            c = self.text[self.at]
            if m := REPEAT.match(self.text, self.at):
                if not repeatable:
                    self.fail("nothing to repeat")
                if m[0][0] == "{" and max(int(n) for n in _re.findall(r"\d+", m[0])) > MOST_REPEATS:
                    self.fail("too many repeats")
                self.out.append(m[0])
                self.at = m.end()
                if self.text.startswith("?", self.at):
                    self.out.append("?")
                    self.at += 1
                if REPEAT.match(self.text, self.at):
                    self.fail("a repeat of a repeat")
                repeatable = False
                continue
            repeatable = True
            if c == "(":
                repeatable = self.group()
            elif c == ")":
                if not self.open:
                    self.fail("unopened group")
                self.open.pop()
                self.take(")")
            elif c == "[":
                self.char_class()
            elif c == "\\":
                self.out.append(self.escape(False))
            elif c == "{":
                self.take(r"\{")
            else:
                repeatable = c != "|"
                self.take(c)
        if self.open:
            self.fail("unclosed group")
        return Pattern("".join(self.out), self.groups, tuple(self.names))

    def take(self, spelled: str, n: int = 1) -> None:
        self.out.append(spelled)
        self.at += n

    def group(self) -> bool:
        """Whether what was read can't be repeated yet: an opening never can."""
        rest = self.text[self.at :]
        if not rest.startswith("(?"):
            self.groups += 1
            self.open.append(self.at)
            self.take("(")
        elif m := _re.match(r"\(\?P?<(\w+)>", rest):
            if any(n == m[1] for n, _ in self.names):
                self.fail("a name twice")
            self.groups += 1
            # Java's names have no underscore; the group is known by its number.
            self.names.append((m[1], self.groups))
            self.open.append(self.at)
            self.take("(", m.end())
        elif m := _re.match(r"\(\?([ims]*(?:-[ims]+)?)([:)])", rest):
            if m[2] == ":":
                self.open.append(self.at)
            elif not m[1]:
                self.fail("no flags")
            self.take(m[0], m.end())
        else:
            self.fail("unknown group")
        return False

    def escape(self, inside: bool) -> str:
        if self.at + 1 >= len(self.text):
            self.fail("trailing backslash")
        c = self.text[self.at + 1]
        rest = self.text[self.at :]
        if c in "sS":
            self.at += 2
            return BLANK if inside and c == "s" else f"[{'^' if c == 'S' else ''}{BLANK}]"
        if c == "Q" and not inside:
            end = self.text.find(r"\E", self.at)
            end = len(self.text) if end < 0 else end
            body = self.text[self.at + 2 : end]
            self.at = min(len(self.text), end + 2)
            return "(?:" + _re.escape(body) + ")"
        if m := _re.match(r"\\([pP])(?:\{(\^?)(\w+)\}|(\w))", rest):
            self.at += m.end()
            kind = m[1] if not m[2] else "P" if m[1] == "p" else "p"
            name = m[3] or m[4]
            return rf"\{kind}{{{name if len(name) <= 2 else 'Is' + name}}}"
        if m := _re.match(r"\\x(?:\{([0-9A-Fa-f]{1,6})\}|([0-9A-Fa-f]{2}))", rest):
            self.at += m.end()
            return rf"\x{{{m[1]}}}" if m[1] else rf"\x{m[2]}"
        if m := _re.match(r"\\0[0-7]{0,2}", rest):
            self.at += m.end()
            return rf"\x{int(m[0][1:], 8):02X}"
        if c in "dDwWabBAzftnrv" and not (inside and c in "bBAz"):
            self.at += 2
            return {"v": r"\x0B", "a": r"\x07"}.get(c, "\\" + c)
        if c.isascii() and c.isalnum():
            self.fail("unknown escape")
        self.at += 2
        return "\\" + c

    def char_class(self) -> None:
        self.take("[")
        if self.text.startswith("^", self.at):
            self.take("^")
        first = True
        while True:
            if self.at >= len(self.text):
                self.fail("unclosed class")
            c = self.text[self.at]
            if c == "]" and not first:
                self.take("]")
                return
            first = False
            if m := _re.match(r"\[:(\^?)(\w+):\]", self.text[self.at :]):
                if m[2] not in POSIX:
                    self.fail("unknown class")
                self.take(f"[^{POSIX[m[2]]}]" if m[1] else POSIX[m[2]], m.end())
            elif c == "\\":
                self.out.append(self.escape(True))
            else:
                self.take("\\" + c if c in "[]&^~" or (c == "-" and self.text.startswith("-", self.at + 1)) else c)


@cache
def read(text: str) -> Pattern:
    """The pattern, or a PatternError."""
    out = _Reader(text).read()
    try:
        _engine.compile(_for_driver(out.java), _engine.S | _engine.V1)
    except _engine.error as e:
        raise PatternError(f"{text!r}: {e}") from e
    return out


def whole(text: str) -> str:
    """Java's pattern for a value that matches as a whole; a dot matches a newline too."""
    return rf"(?s)^(?:{read(text).java})\z"
