"""A one-pass lexer of program text: tokens, comments and an index of brackets.

What a character means depends on the mode it stands in: code, a string, a comment, a regular expression, or a template, whose ``${}``
holds code again. A stack of open brackets keeps the modes.
"""

from __future__ import annotations

import re
from bisect import bisect_right

#: Kinds of tokens: names, numbers, strings, templates, regular expressions, signs.
NAME, NUMBER, STRING, TEMPLATE, REGEX, SIGN = "n", "i", "s", "t", "r", "p"
_NEXT = re.compile(
    r"""(?P<w>\s+)|(?P<c>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<s>'(?:\\.|[^'\\\n])*+'?|"(?:\\.|[^"\\\n])*+"?)|(?P<i>\d[\w.]*)|(?P<n>[A-Za-z_$\u0080-\U0010ffff][\w$]*)|(?P<p>\?\.(?!\d)|=>|\.\.\.|===|!==|==|!=|<=|>=|&&|\|\||\?\?|\+\+|--|.)""",
    re.S,
)
_TEMPLATE = re.compile(r"(?:\\.|[^`\\$]|\$(?!\{))*+", re.S)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*+\]|[^/\\\[\n])++/[A-Za-z]*")
#: Names after which an expression begins, so that a slash does.
_BEFORE = frozenset("return typeof instanceof in of new delete void throw case do else await yield".split())
_CLOSES = {")": "(", "]": "[", "}": "{"}


class Tokens:
    """The tokens of a text: ``kind``, ``value``, ``start`` and ``end`` by number, ``close`` from opening to closing brackets and ``open`` back, ``comments`` as (start, end)."""

    def __init__(self, text: str):
        self.text = text
        self.kind: list[str] = []
        self.value: list[str] = []
        self.start: list[int] = []
        self.end: list[int] = []
        self.close: dict[int, int] = {}
        self.open: dict[int, int] = {}
        self.comments: list[tuple[int, int]] = []
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self._read()

    def _add(self, kind: str, start: int, end: int) -> None:
        self.kind.append(kind)
        self.value.append(self.text[start:end])
        self.start.append(start)
        self.end.append(end)

    def _read(self) -> None:
        text, at, size = self.text, 0, len(self.text)
        held: list[tuple[str, int, int]] = []  # sign, token, where the template that it stands in begins or -1
        while at < size:
            m = _NEXT.match(text, at)
            kind, end = m.lastgroup, m.end()
            if kind == "w":
                at = end
                continue
            if kind == "c":
                self.comments.append((at, end))
                at = end
                continue
            if kind != "p":
                self._add(kind, at, end)
                at = end
                continue
            sign = m[0]
            if sign == "/" and self._expression() and (r := _REGEX.match(text, at)):
                self._add(REGEX, at, r.end())
                at = r.end()
            elif sign == "`":
                at = self._template(at, at + 1, held)
            else:
                self._add(SIGN, at, end)
                here = len(self.kind) - 1
                at = end
                if sign in "([{":
                    held.append((sign, here, -1))
                elif sign in _CLOSES:
                    within = self._closed(sign, here, held)
                    if within >= 0:
                        at = self._template(within, end, held)

    def _expression(self) -> bool:
        """Whether an expression may begin here."""
        if not self.kind:
            return True
        kind, value = self.kind[-1], self.value[-1]
        return value in _BEFORE if kind == NAME else kind == SIGN and value not in (")", "]", "}", "++", "--")

    def _template(self, start: int, at: int, held: list) -> int:
        """Read on in a template's text; its code goes between signs of its own."""
        end = _TEMPLATE.match(self.text, at).end()
        if self.text.startswith("${", end):
            self._add(SIGN, end, end + 2)
            held.append(("{", len(self.kind) - 1, start))
            return end + 2
        end = min(end + 1, len(self.text))
        self._add(TEMPLATE, start, end)
        return end

    def _closed(self, sign: str, here: int, held: list) -> int:
        """Match a closing sign. A brace also ends what was left open in it; other signs that close nothing are passed over. Returns the begin of the template that goes on, or -1."""
        wanted = _CLOSES[sign]
        if sign == "}":
            while held and held[-1][0] != "{":
                held.pop()
        if not held or held[-1][0] != wanted:
            return -1
        _, opened, within = held.pop()
        self.close[opened], self.open[here] = here, opened
        return within

    def __len__(self) -> int:
        return len(self.kind)

    def is_(self, k: int, *values: str) -> bool:
        """Whether token ``k`` is a name or sign among ``values``."""
        return 0 <= k < len(self.kind) and self.kind[k] in (NAME, SIGN) and self.value[k] in values

    def named(self, k: int) -> bool:
        return 0 <= k < len(self.kind) and self.kind[k] == NAME

    def line(self, at: int) -> int:
        return bisect_right(self.lines, at)

    def code(self, n: int) -> str:
        """Line ``n`` without white space around it."""
        return self.text[self.lines[n - 1] : self.lines[n] if n < len(self.lines) else len(self.text)].strip()

    def first(self, k: int) -> bool:
        """Whether only white space stands before token ``k`` in its line."""
        return not self.text[self.lines[self.line(self.start[k]) - 1] : self.start[k]].strip()

    def past_types(self, k: int) -> int | None:
        """The token behind type arguments that begin at ``k``, all in one line."""
        depth, n = 0, self.line(self.start[k])
        while k < len(self.kind):
            value = self.value[k]
            if self.kind[k] == SIGN:
                if value == "<":
                    depth += 1
                elif value == ">":
                    depth -= 1
                    if depth == 0:
                        return k + 1
                elif value in (";", "{", "}", "&&", "||", "=>"):
                    return None
            if self.line(self.start[k]) != n:
                return None
            k += 1
        return None

    def before_types(self, k: int) -> int | None:
        """The token before type arguments that end at ``k``, all in one line, made of names, dots, commas and nested arguments only."""
        depth, n = 0, self.line(self.start[k])
        while k >= 0 and self.line(self.start[k]) == n:
            value, kind = self.value[k], self.kind[k]
            if kind == SIGN and value == ">":
                depth += 1
            elif kind == SIGN and value == "<":
                depth -= 1
                if depth == 0:
                    return k - 1
            elif not (kind in (NAME, STRING) or value in (".", ",", "[", "]", "|", "&")):
                return None
            k -= 1
        return None
