"""RDF files to quads DataFrames."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.terms import Term
from ..operators.store import SCHEMA, QuadStore
from .rdf import CHUNK, LineReader, Piece, parse_nquads, parse_ntriples, parse_piece, parse_turtle, pieces
from .tokens import ParseError

_IRI = r"<([^<>\"{}|^`\\\x00-\x20]*)>"
_BLANK = r"_:([A-Za-z0-9_\-]+)"
_LITERAL = r'"([^"\\\n\r]*)"(?:@([A-Za-z]+(?:-[A-Za-z0-9]+)*)|\^\^<([^<>\"{}|^`\\\x00-\x20]*)>)?'
#: Lines of one plain statement; all others go through the full reader.
_PLAIN = re.compile(rf"[ \t]*(?:{_IRI}|{_BLANK})[ \t]*{_IRI}[ \t]*(?:{_IRI}|{_BLANK}|{_LITERAL})[ \t]*(?:(?:{_IRI}|{_BLANK})[ \t]*)?\.[ \t]*\r?$")
_FLAT = "gk tinyint, gv string, sk tinyint, sv string, pk tinyint, pv string, ok tinyint, ov string, ol string, od string"
_ARROW = pa.schema([(n.split()[0], pa.int8() if n.split()[1] == "tinyint" else pa.string()) for n in _FLAT.split(", ")])


def scope_of(path: str) -> str:
    """The file's stem with all but letters and digits as underscores."""
    stem = path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
    return re.sub(r"[^A-Za-z0-9]", "_", stem)


def _quads(flat: DataFrame) -> DataFrame:
    """Terms from flat columns; numbers are recognised here, in the JVM."""
    node = lambda x: T.make(F.col(f"{x}k"), F.col(f"{x}v"))
    lit = F.col("ok") == T.LITERAL
    o = T.make(F.col("ok"), F.col("ov"), F.col("ol"), F.col("od"), F.when(lit, T.numeric(F.col("ov"), F.col("od"))))
    return flat.select(F.when(F.col("gk").isNotNull(), node("g")).alias("g"), node("s").alias("s"), node("p").alias("p"), o.alias("o"))


def _flat_row(q: tuple) -> tuple:
    s, p, o = q[:3]
    g = q[3] if len(q) > 3 else None
    return (g.k if g else None, g.v if g else None, s.k, s.v, p.k, p.v, o.k, o.v, o.l, o.d)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in _ARROW]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def read_turtle(spark: SparkSession, path: str | list[str], scope: str | None = None, strict: str = "", chunk: int = CHUNK) -> DataFrame:
    """Turtle documents, cut between statements by one cheap pass each and parsed in many tasks. Blank nodes are named after their file.

    A document whose prefixes change behind its first statement is parsed whole. strict: "ntriples" or
    "nquads" reads those by the full grammar, statements over several lines included, whole. A
    document is one value, so of 2 GB at most. A syntax error stops the job before anything is stored.
    """

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = {"ntriples": parse_ntriples, "nquads": parse_nquads}[strict]
        for batch in batches:
            for text, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield from _batches(read(text, scope_of(name) if scope is None else scope))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for part in pieces(text, chunk):
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (part.text, name, part.at, part.line, part.column, json.dumps(part.prefixes), part.base)], names=_CUT)

    def parsed_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, name, at, line, column, prefixes, base in zip(*(c.to_pylist() for c in batch.columns)):
                piece = Piece(text, at, line, column, json.loads(prefixes), base)
                yield from _batches(parse_piece(piece, scope_of(name) if scope is None else scope))

    files = spark.read.text(path, wholetext=True).select("value", F.input_file_name())
    if strict:
        return _quads(files.mapInArrow(parsed, _FLAT))
    cuts = files.mapInArrow(cut, "text string, name string, at long, line long, col long, prefixes string, base string")
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return _quads(cuts.repartition(tasks, "name", "at").mapInArrow(parsed_pieces, _FLAT))


_CUT = ["text", "name", "at", "line", "col", "prefixes", "base"]


def _batches(found: list[tuple]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(found), 20_000):
        yield _batch([_flat_row(q) for q in found[at : at + 20_000]])


def parsed_lines(lines: DataFrame, scope: str | None, quads: bool) -> DataFrame:
    """Lines (value, file name) to quads."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scopes: dict[str, str] = {}
        match = _PLAIN.match
        for batch in batches:
            rows = []
            for line, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (mark := scopes.get(name)) is None:
                    mark = scope_of(name) if scope is None else scope
                    scopes[name] = mark = f"{mark}_" if mark else ""
                m = match(line)
                if m is None or not quads and (m[9] is not None or m[10] is not None):
                    rows += [_flat_row(q) for q in LineReader(line, mark.rstrip("_") if mark else "", quads).read()]
                    continue
                si, sb, p, oi, ob, text, lang, kind, gi, gb = m.groups()
                s = (T.IRI, si) if si is not None else (T.BLANK, mark + sb)
                if oi is not None:
                    o = (T.IRI, oi, "", "")
                elif ob is not None:
                    o = (T.BLANK, mark + ob, "", "")
                else:
                    o = (T.LITERAL, text, lang.lower(), T.LANG_STRING) if lang else (T.LITERAL, text, "", kind or T.STRING)
                g = (T.IRI, gi) if gi is not None else (T.BLANK, mark + gb) if gb is not None else (None, None)
                rows.append((*g, *s, T.IRI, p, *o))
            yield _batch(rows)

    return _quads(lines.mapInArrow(parsed, _FLAT))


def _lines(spark: SparkSession, path: str | list[str], scope: str | None, quads: bool) -> DataFrame:
    return parsed_lines(spark.read.text(path).select("value", F.input_file_name()), scope, quads)


def read_ntriples(spark: SparkSession, path: str | list[str], scope: str | None = None) -> DataFrame:
    """Line by line, files split over tasks. Statements that span lines need read_turtle(..., strict="ntriples")."""
    return _lines(spark, path, scope, quads=False)


def read_nquads(spark: SparkSession, path: str | list[str], scope: str | None = None) -> DataFrame:
    return _lines(spark, path, scope, quads=True)


def load_text(spark: SparkSession, text: str, syntax: str = "turtle", scope: str = "") -> QuadStore:
    """A store from a text in memory; a syntax error leaves nothing behind."""
    read = {"turtle": parse_turtle, "ntriples": parse_ntriples, "nquads": parse_nquads}[syntax]
    return QuadStore.of(spark, read(text, scope))


__all__ = ["SCHEMA", "ParseError", "Term", "load_text", "parsed_lines", "read_nquads", "read_ntriples", "read_turtle", "scope_of"]
