"""Tokens of Turtle, N-Triples, N-Quads and SPARQL, with their places."""

from __future__ import annotations

import re
from typing import NamedTuple
from urllib.parse import urlsplit

NAME = "A-Za-z0-9_\\-\u0080-\U0010ffff"


class ParseError(ValueError):
    """A syntax error at a line and column, both from 1."""

    def __init__(self, message: str, line: int, column: int) -> None:
        super().__init__(f"line {line}, column {column}: {message}")
        self.message, self.line, self.column = message, line, column

    def __reduce__(self):
        return ParseError, (self.message, self.line, self.column)


class Token(NamedTuple):
    kind: str
    text: str
    at: int
    end: int


_SKIP = re.compile(r"(?:[ \t\r\n\x0b\x0c]+|#[^\n]*)*")
#: In the place of a term; the first that matches counts.
_TERM = re.compile(
    "|".join(
        f"(?P<{kind}>{form})"
        for kind, form in (
            ("iri", r"<(?:[^<>\"{}|^`\\\x00-\x20]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>"),
            ("string", r'"""(?:"{0,2}(?:[^"\\]|\\.))*"""' + r"|'''(?:'{0,2}(?:[^'\\]|\\.))*'''" + r'|"(?!"")(?:[^"\\\n\r]|\\[^\n])*"' + r"|'(?!'')(?:[^'\\\n\r]|\\[^\n])*'|\"\"|''"),
            ("blank", f"_:[{NAME}](?:[{NAME}.]*[{NAME}])?"),
            ("pname", f"(?:[{NAME}](?:[{NAME}.]*[{NAME}])?)?:(?:(?:[{NAME}:%]|\\.+(?=[{NAME}:%]))*)"),
            ("var", r"[?$][A-Za-z0-9_]+"),
            ("double", r"[+-]?(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+"),
            ("decimal", r"[+-]?\d*\.\d+"),
            ("integer", r"[+-]?\d+"),
            ("lang", r"@[A-Za-z]+(?:-[A-Za-z0-9]+)*"),
            ("word", r"[A-Za-z]+"),
            ("mark", r"\^\^|&&|\|\||[!<>]=|[^\s]"),
        )
    ),
    re.DOTALL,
)
#: In the place of an operator: signs and < stand for themselves.
_OPERATOR = re.compile(r"(?P<mark>&&|\|\||[!<>]=|[^\sA-Za-z])|(?P<word>[A-Za-z]+)")
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.DOTALL)
_PLAIN = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


class Tokens:
    """A text read token by token; the reader says whether it awaits a term or an operator."""

    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0
        self.prefixes: dict[str, str] = {}
        self.base = ""
        self._seen: tuple[int, bool, Token] = (-1, False, Token("end", "", 0, 0))

    def fail(self, message: str, at: int | None = None) -> ParseError:
        at = min(self.at if at is None else at, len(self.text))
        return ParseError(message, self.text.count("\n", 0, at) + 1, at - (self.text.rfind("\n", 0, at) + 1) + 1)

    def peek(self, operator: bool = False) -> Token:
        at, kind, token = self._seen
        if at == self.at and kind is operator:
            return token
        begin = _SKIP.match(self.text, self.at).end()
        if begin >= len(self.text):
            token = Token("end", "", begin, begin)
        else:
            found = (_OPERATOR if operator else _TERM).match(self.text, begin)
            token = Token(found.lastgroup, found.group(), begin, found.end())
        self._seen = (self.at, operator, token)
        return token

    def next(self, operator: bool = False) -> Token:
        token = self.peek(operator)
        self.at = token.end
        return token

    def take(self, *texts: str, operator: bool = False) -> str:
        """The text of the next token if it is one of these marks, else nothing."""
        token = self.peek(operator)
        if token.kind == "mark" and token.text in texts:
            self.at = token.end
            return token.text
        return ""

    def expect(self, mark: str, operator: bool = False) -> Token:
        token = self.next(operator)
        if token.kind != "mark" or token.text != mark:
            raise self.fail(f"expected '{mark}', found {describe(token)}", token.at)
        return token

    def keyword(self, *words: str, take: bool = True) -> str:
        """The next word in upper case if it is one of these, else nothing."""
        token = self.peek()
        if token.kind == "word" and token.text.upper() in words:
            if take:
                self.at = token.end
            return token.text.upper()
        return ""

    # --- what tokens stand for ---

    def string(self, token: Token) -> str:
        quotes = 3 if token.text[:3] in ('"""', "'''") and len(token.text) >= 6 else 1
        return self.unescape(token.text[quotes:-quotes], token.at + quotes)

    def unescape(self, text: str, at: int) -> str:
        if "\\" not in text:
            return text

        def one(m: re.Match) -> str:
            if m[3] is None:
                code = int(m[1] or m[2], 16)
                if code > 0x10FFFF or 0xD800 <= code <= 0xDFFF:
                    raise self.fail("not a character", at + m.start())
                return chr(code)
            if m[3] not in _PLAIN:
                raise self.fail(f"unknown escape \\{m[3]}", at + m.start())
            return _PLAIN[m[3]]

        return _ESCAPE.sub(one, text)

    def iri(self, token: Token) -> str:
        return resolve(self.base, self.unescape(token.text[1:-1], token.at + 1))

    def pname(self, token: Token) -> str:
        prefix, _, local = token.text.partition(":")
        if prefix not in self.prefixes:
            raise self.fail(f"the prefix '{prefix}:' is not declared", token.at)
        return self.prefixes[prefix] + local

    def directive(self, base: bool) -> None:
        """What follows @prefix, PREFIX, @base or BASE."""
        if base:
            token = self.next()
            if token.kind != "iri":
                raise self.fail("expected an IRI in angle brackets", token.at)
            self.base = self.iri(token)
            return
        name = self.next()
        if name.kind != "pname" or not name.text.endswith(":") or name.text.count(":") != 1:
            raise self.fail("expected a prefix name and a colon", name.at)
        token = self.next()
        if token.kind != "iri":
            raise self.fail("expected an IRI in angle brackets", token.at)
        self.prefixes[name.text[:-1]] = self.iri(token)


def describe(token: Token) -> str:
    return "the end of the text" if token.kind == "end" else f"'{token.text[:30]}'"


def resolve(base: str, ref: str) -> str:
    """ref seen from base: empty, absolute, #fragment, ?query, /path and relative paths with dot segments."""
    if not base or re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", ref):
        return ref
    if not ref:
        return base.split("#")[0]
    parts = urlsplit(base)
    root = f"{parts.scheme}:" + (f"//{parts.netloc}" if parts.netloc or base[len(parts.scheme) + 1 :].startswith("//") else "")
    if ref.startswith("#"):
        return base.split("#")[0] + ref
    if ref.startswith("?"):
        return base.split("#")[0].split("?")[0] + ref
    if ref.startswith("//"):
        return f"{parts.scheme}:{ref}"
    path, mark, rest = re.match(r"([^?#]*)([?#]?)(.*)", ref, re.DOTALL).groups()
    if not path.startswith("/"):
        path = parts.path[: parts.path.rfind("/") + 1] + path if "/" in parts.path else "/" + path
    kept: list[str] = []
    steps = path.split("/")
    for i, step in enumerate(steps):
        last = i == len(steps) - 1
        if step == "..":
            if len(kept) > 1:
                kept.pop()
            if last:
                kept.append("")
        elif step == ".":
            if last:
                kept.append("")
        else:
            kept.append(step)
    return root + "/".join(kept) + mark + rest
