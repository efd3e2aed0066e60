"""RDF terms as Spark columns.

A term is a struct <k, v, l, d, n>: kind, lexical value, language, datatype and the numeric
value of a numeric literal. Absent l and d are empty strings, so equality of structs is
identity of terms; n follows from v and d, so it doesn't disturb that. An unbound variable
is a null struct. n is filled once, where a term is made: comparisons, sums and sort keys
read it as a plain double.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

IRI, BLANK, LITERAL = 1, 2, 3
TERM = "struct<k:tinyint,v:string,l:string,d:string,n:double>"
XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
STRING, BOOLEAN, INTEGER, DOUBLE, DECIMAL = (XSD + x for x in ("string", "boolean", "integer", "double", "decimal"))
DATETIME, LANG_STRING, TYPE = XSD + "dateTime", RDF + "langString", RDF + "type"
INTEGRAL_TYPES = tuple(XSD + x for x in ("integer", "long", "int", "short", "byte", "nonNegativeInteger", "positiveInteger"))
NUMERIC_TYPES = (*INTEGRAL_TYPES, DECIMAL, DOUBLE, XSD + "float")
NUMBER = r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"
SPECIAL = {"INF": float("inf"), "+INF": float("inf"), "-INF": float("-inf"), "NaN": float("nan")}


class Term(NamedTuple):
    """A term outside of Spark."""

    k: int
    v: str
    l: str = ""  # noqa: E741
    d: str = ""

    @property
    def n(self) -> float | None:
        if self.d not in NUMERIC_TYPES:
            return None
        if self.v in SPECIAL:
            return SPECIAL[self.v]
        return float(self.v) if re.match(NUMBER, self.v) else None

    def row(self) -> tuple:
        return (*self, self.n)

    def __str__(self) -> str:
        if self.k == IRI:
            return f"<{self.v}>"
        if self.k == BLANK:
            return f"_:{self.v}"
        text = self.v
        for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            text = text.replace(a, b)
        return f'"{text}"' + (f"@{self.l}" if self.l else "" if self.d in ("", STRING) else f"^^<{self.d}>")


def iri(v: str) -> Term:
    return Term(IRI, v)


def literal(v: str, lang: str = "", datatype: str = "") -> Term:
    return Term(LITERAL, v, lang.lower(), LANG_STRING if lang else datatype or STRING)


def constant(t: Term) -> Column:
    return make(F.lit(t.k), F.lit(t.v), F.lit(t.l), F.lit(t.d), F.lit(t.n))


def make(k: Column, v: Column, l: Column | None = None, d: Column | None = None, n: Column | None = None) -> Column:  # noqa: E741
    blank = F.lit("")
    fields = (k.cast("tinyint").alias("k"), v.alias("v"), (blank if l is None else l).alias("l"), (blank if d is None else d).alias("d"), (F.lit(None) if n is None else n).cast("double").alias("n"))
    return F.struct(*fields)


def unbound() -> Column:
    return F.lit(None).cast(TERM)


def text_term(v: Column) -> Column:
    return F.when(v.isNotNull(), make(F.lit(LITERAL), v, None, F.lit(STRING)))


def iri_term(v: Column) -> Column:
    return F.when(v.isNotNull(), make(F.lit(IRI), v))


def bool_term(b: Column) -> Column:
    return F.when(b.isNotNull(), make(F.lit(LITERAL), F.when(b, "true").otherwise("false"), None, F.lit(BOOLEAN)))


def number_term(n: Column, integral: Column) -> Column:
    """The literal of a computed number: integer if it may be and is below 9e15, else double with 15 digits."""
    whole = integral & (F.abs(n) < 9e15)
    text = F.when(whole, n.cast("bigint").cast("string")).otherwise(double_text(n))
    return F.when(n.isNotNull(), make(F.lit(LITERAL), text, None, F.when(whole, INTEGER).otherwise(DOUBLE), n))


def double_text(n: Column) -> Column:
    """n with up to 15 significant digits, in exponent form below 1e-5 and from 1e15, without zeros at the end."""
    sci = F.format_string("%.14e", n)
    exponent = F.regexp_extract(sci, r"e([+-]\d+)$", 1).cast("int")
    mantissa = F.regexp_replace(F.regexp_replace(sci, r"e.*$", ""), r"\.?0+$", "")
    digits = F.regexp_replace(F.regexp_replace(sci, r"e.*$", ""), r"\.", "")
    sign = F.when(digits.startswith("-"), "-").otherwise("")
    bare = F.regexp_replace(digits, "^-", "")
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), bare)
    large = F.concat(sign, F.substring(bare, F.lit(1), exponent + 1), F.lit("."), F.substring(bare, exponent + 2, F.lit(20)))
    plain = F.regexp_replace(F.when(exponent < 0, small).otherwise(large), r"\.?0+$", "")
    form = (exponent < -4) | (exponent >= 15)
    return (
        F.when(F.isnan(n), "nan").when(n == float("inf"), "inf").when(n == float("-inf"), "-inf").when(n == 0, "0")
        .when(form, F.concat(mantissa, F.lit("e"), F.format_string("%+03d", exponent))).otherwise(plain)
    )


def numeric(v: Column, d: Column) -> Column:
    """The number that (lexical value, datatype) stands for, else null. Hexadecimal forms are no numbers here."""
    special = F.when(v.isin("INF", "+INF"), float("inf")).when(v == "-INF", float("-inf")).when(v == "NaN", float("nan"))
    return F.when(d.isin(*NUMERIC_TYPES), F.coalesce(special, F.when(v.rlike(NUMBER), F.trim(v).try_cast("double"))))


def ntriples(t: Column) -> Column:
    """The N-Triples text of a term; null stays null."""
    text = t["v"]
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(a), F.lit(b))
    tail = F.when(t["l"] != "", F.concat(F.lit("@"), t["l"])).when(t["d"].isin("", STRING), "").otherwise(F.concat(F.lit("^^<"), t["d"], F.lit(">")))
    return (
        F.when(t["k"] == IRI, F.concat(F.lit("<"), t["v"], F.lit(">")))
        .when(t["k"] == BLANK, F.concat(F.lit("_:"), t["v"]))
        .when(t["k"] == LITERAL, F.concat(F.lit('"'), text, F.lit('"'), tail))
    )


def sort_key(t: Column) -> Column:
    """Unbound < blank < IRI < literal; numbers by value and before other literals, which go by value, language, datatype.

    Equal numbers of different texts have equal keys, so a further ORDER BY key decides.
    """
    no = t["n"].isNull()
    rank = F.when(t["k"] == BLANK, 1).when(t["k"] == IRI, 2).otherwise(3)
    key = F.struct(rank.alias("r"), no.alias("t"), t["n"].alias("n"), F.when(no, t["v"]).otherwise("").alias("v"), F.when(no, t["l"]).otherwise("").alias("l"), F.when(no, t["d"]).otherwise("").alias("d"))
    return F.when(t.isNotNull(), key)
