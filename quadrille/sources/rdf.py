"""Turtle, N-Triples and N-Quads texts to terms, in plain Python; Spark runs this on its workers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from ..functions.terms import BLANK, BOOLEAN, DECIMAL, DOUBLE, INTEGER, RDF, TYPE, Term, iri, literal
from .tokens import ParseError, Token, Tokens, describe

Triple = tuple[Term, Term, Term]
_NUMBERS = {"integer": INTEGER, "decimal": DECIMAL, "double": DOUBLE}


class _Reader:
    def __init__(self, text: str, scope: str) -> None:
        self.tokens, self.scope, self.fresh = Tokens(text), scope, 0

    def fail(self, what: str, token: Token) -> ParseError:
        return self.tokens.fail(f"expected {what}, found {describe(token)}", token.at)

    def label(self, name: str) -> Term:
        return Term(BLANK, f"{self.scope}_{name}" if self.scope else name)

    def new_blank(self) -> Term:
        self.fresh += 1
        return self.label(f"genid{self.place}{self.fresh - 1}")

    place = ""

    def literal(self, token: Token) -> Term:
        """A string with what may follow it at once: a language tag or a datatype."""
        t = self.tokens
        text = t.string(token)
        if t.text.startswith("@", t.at):
            tag = t.next()
            if tag.kind != "lang":
                raise self.fail("a language tag", tag)
            return literal(text, lang=tag.text[1:])
        if t.text.startswith("^^", t.at):
            t.next()
            kind = t.next()
            if kind.kind == "iri":
                return literal(text, datatype=t.iri(kind))
            if kind.kind == "pname" and self.abbreviated:
                return literal(text, datatype=t.pname(kind))
            raise self.fail("a datatype", kind)
        return literal(text)

    abbreviated = True


class TurtleReader(_Reader):
    """A whole document. Statements are found by their marks, not by lines."""

    def __init__(self, text: str, scope: str = "") -> None:
        super().__init__(text, scope)
        self.out: list[Triple] = []

    def read(self) -> list[Triple]:
        t = self.tokens
        while (token := t.peek()).kind != "end":
            if token.kind == "lang" and token.text in ("@prefix", "@base"):
                t.next()
                t.directive(token.text == "@base")
                t.expect(".")
            elif word := t.keyword("PREFIX", "BASE"):
                t.directive(word == "BASE")
            else:
                self.statement()
        return self.out

    def directives(self) -> int:
        """Read the declarations at the document's beginning, and tell where they end."""
        t, end = self.tokens, 0
        while True:
            token = t.peek()
            if token.kind == "lang" and token.text in ("@prefix", "@base"):
                t.next()
                t.directive(token.text == "@base")
                t.expect(".")
            elif word := t.keyword("PREFIX", "BASE"):
                t.directive(word == "BASE")
            else:
                return end
            end = t.at

    def statement(self) -> None:
        t = self.tokens
        alone = t.peek().text == "["
        subject = self.node(subject=True)
        if not (alone and t.peek().text == "."):
            self.properties(subject, ".")
        t.expect(".")

    def properties(self, subject: Term, end: str) -> None:
        """predicate object, object ; predicate object ... up to, not with, `end`."""
        t = self.tokens
        while True:
            predicate = self.predicate()
            while True:
                self.out.append((subject, predicate, self.node()))
                if not t.take(","):
                    break
            if not t.take(";"):
                return
            while t.take(";"):
                pass
            if t.peek().text == end:
                return

    def predicate(self) -> Term:
        token = self.tokens.next()
        if token.kind == "word" and token.text == "a":
            return iri(TYPE)
        if token.kind == "iri":
            return iri(self.tokens.iri(token))
        if token.kind == "pname":
            return iri(self.tokens.pname(token))
        raise self.fail("a predicate", token)

    def node(self, subject: bool = False) -> Term:
        t = self.tokens
        token = t.next()
        if token.kind == "iri":
            return iri(t.iri(token))
        if token.kind == "pname":
            return iri(t.pname(token))
        if token.kind == "blank":
            return self.label(token.text[2:])
        if token.text == "[":
            node = self.new_blank()
            if not t.take("]"):
                self.properties(node, "]")
                t.expect("]")
            return node
        if token.text == "(":
            return self.collection()
        if not subject:
            if token.kind == "string":
                return self.literal(token)
            if token.kind in _NUMBERS:
                return literal(token.text, datatype=_NUMBERS[token.kind])
            if token.kind == "word" and token.text in ("true", "false"):
                return literal(token.text, datatype=BOOLEAN)
        raise self.fail("a subject" if subject else "an object", token)

    def collection(self) -> Term:
        t, nil, items = self.tokens, iri(RDF + "nil"), []
        while not t.take(")"):
            if t.peek().kind == "end":
                raise self.fail("')'", t.peek())
            items.append((self.new_blank(), self.node()))
        for (cell, item), rest in zip(items, [c for c, _ in items[1:]] + [nil]):
            self.out += [(cell, iri(RDF + "first"), item), (cell, iri(RDF + "rest"), rest)]
        return items[0][0] if items else nil


class LineReader(_Reader):
    """N-Triples and N-Quads: full terms only. A line may hold several statements."""

    abbreviated = False

    def __init__(self, text: str, scope: str = "", quads: bool = False) -> None:
        super().__init__(text, scope)
        self.quads = quads

    def read(self) -> Iterator[tuple[Term, Term, Term, Term | None]]:
        t = self.tokens
        while t.peek().kind != "end":
            s = self.node("a subject", ("iri", "blank"))
            p = self.node("a predicate", ("iri", "blank") if self.quads else ("iri",))
            o = self.node("an object", ("iri", "blank", "string"))
            g = self.node("a graph name", ("iri", "blank")) if self.quads and t.peek().text != "." else None
            t.expect(".")
            yield s, p, o, g

    def node(self, what: str, kinds: tuple[str, ...]) -> Term:
        token = self.tokens.next()
        if token.kind not in kinds or token.kind == "string" and (token.text[0] == "'" or token.text.startswith('"""')):
            raise self.fail(what, token)
        if token.kind == "iri":
            return iri(self.tokens.iri(token))
        return self.label(token.text[2:]) if token.kind == "blank" else self.literal(token)


# --- pieces of a document ---
#: Characters of a piece, about.
CHUNK = 1 << 19
#: All but brackets and long strings, up to where that ends; group 1 is the last end of a statement in it.
_RUN = re.compile(r"""(?:[^"'<#.\[\](){}]++|"(?!"")(?:[^"\\\n\r]|\\[^\n])*+"|""(?!")|'(?!'')(?:[^'\\\n\r]|\\[^\n])*+'|''(?!')|<[^<>"{}|^`\x00-\x20]*+>|#[^\n]*+(?=\n)|(\.)(?=\s)|\.(?=\S))*+""")
_LONG = re.compile(r'"""(?:"{0,2}(?:[^"\\]|\\.))*"""|' + r"'''(?:'{0,2}(?:[^'\\]|\\.))*'''", re.DOTALL)
_DIRECTIVE = re.compile(r"@(?:prefix|base)\b|(?<![\w:])(?:prefix|base)\s+(?:[^\s<>\"']*:)?\s*<", re.IGNORECASE)


@dataclass
class Piece:
    """Whole statements of a document from its character `at` on, which stands at line and column, with what was declared before."""

    text: str
    at: int = 0
    line: int = 1
    column: int = 1
    prefixes: dict[str, str] = field(default_factory=dict)
    base: str = ""


def pieces(text: str, chunk: int = CHUNK) -> Iterator[Piece]:
    """A document cut between statements, every `chunk` characters or so; as one where it is short, declares prefixes later on, or can't be cut."""
    if len(text) <= chunk:
        yield Piece(text)
        return
    reader = TurtleReader(text)
    try:
        head = reader.directives()
    except ParseError:
        head = None
    if head is None or _DIRECTIVE.search(text, head):
        yield Piece(text)
        return
    prefixes, base = dict(reader.tokens.prefixes), reader.tokens.base
    begin, line, start = head, text.count("\n", 0, head) + 1, text.rfind("\n", 0, head) + 1
    for end in [*_cuts(text, head, chunk), len(text)]:
        yield Piece(text[begin:end], begin, line, begin - start + 1, prefixes, base)
        line, start = line + text.count("\n", begin, end), max(start, text.rfind("\n", begin, end) + 1)
        begin = end


def _cuts(text: str, at: int, chunk: int) -> Iterator[int]:
    """Ends of statements outside brackets, strings, IRIs and comments."""
    begin, size, last = at, chunk, 0
    while begin + size < len(text):
        m = _RUN.match(text, at, begin + size)
        last = max(last, m.end(1))
        at = m.end()
        if at < begin + size and text[at] in "[(":
            at = _closed(text, at)
        elif at < begin + size and (long := _LONG.match(text, at)):
            at = long.end()
        elif last > begin:  # the window's end, or what doesn't stand whole in it
            yield last
            at = begin = last
            size = chunk
        else:
            size *= 2


def _closed(text: str, at: int) -> int:
    """Behind the bracket that closes the one at `at`, or the text's end."""
    depth = 0
    while at < len(text):
        c = text[at]
        depth += (c in "[(") - (c in "])")
        at += 1
        if not depth:
            return at
        if c not in "[](){}":
            m = _LONG.match(text, at - 1) or _RUN.match(text, at - 1)
            at = max(at, m.end())
    return at


def parse_piece(piece: Piece, scope: str = "") -> list[Triple]:
    """A piece's triples; errors tell the document's line and column. Nodes without a label are named by the piece's place, but for the first."""
    reader = TurtleReader(piece.text, scope)
    reader.tokens.prefixes, reader.tokens.base = dict(piece.prefixes), piece.base
    reader.place = f"{piece.at}_" if piece.at else ""
    try:
        return reader.read()
    except ParseError as e:
        raise ParseError(e.message, e.line + piece.line - 1, e.column + (piece.column - 1 if e.line == 1 else 0)) from None


def parse_turtle(text: str, scope: str = "") -> list[Triple]:
    return TurtleReader(text, scope).read()


def parse_ntriples(text: str, scope: str = "") -> list[Triple]:
    return [x[:3] for x in LineReader(text, scope).read()]


def parse_nquads(text: str, scope: str = "") -> list[tuple[Term, Term, Term, Term | None]]:
    return list(LineReader(text, scope, quads=True).read())
