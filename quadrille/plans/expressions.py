"""SPARQL expressions as Spark columns with three outcomes: bound, unbound, error.

A value keeps the plainest form that it can: a boolean, a number, a text, or else a term.
In the first three null means error, so logic over them is SQL's own three-valued logic and
Catalyst may push it down; a term is null where unbound or in error and says apart which.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from .algebra import Call, Expr, Op, Var

Scope = dict[str, Column]
_FLIP = {"=": "=", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass
class Value:
    form: str  # term, bool, number, text
    col: Column
    error: Column | None = None  # of terms: where null means error; None: nowhere
    integral: Column | None = None  # of numbers
    const: T.Term | None = None

    def term(self) -> Column:
        match self.form:
            case "bool":
                return T.bool_term(self.col)
            case "number":
                return T.number_term(self.col, self.integral)
            case "text":
                return T.text_term(self.col)
        return self.col

    def bound(self) -> Column:
        return self.col.isNotNull()

    def is_error(self) -> Column:
        if self.form == "term":
            return F.lit(False) if self.error is None else self.error
        return self.col.isNull()

    def number(self) -> Column:
        return self.col if self.form == "number" else self.col["n"] if self.form == "term" else F.lit(None).cast("double")

    def is_integral(self) -> Column:
        if self.const is not None:
            return F.lit(self.const.d in T.INTEGRAL_TYPES)
        return self.integral if self.form == "number" else self.col["d"].isin(*T.INTEGRAL_TYPES) if self.form == "term" else F.lit(False)

    def string(self) -> Column:
        """The text of a plain or language-tagged literal, else null."""
        if self.const is not None:
            return F.lit(self.const.v if is_text(self.const) else None).cast("string")
        if self.form == "text":
            return self.col
        if self.form == "term":
            return F.when(text_like(self.col), self.col["v"])
        return F.lit(None).cast("string")

    def truth(self) -> Column:
        """The effective boolean value, false where there is none; never null."""
        match self.form:
            case "bool":
                found = self.col
            case "number":
                found = (self.col != 0) & ~F.isnan(self.col)
            case "text":
                found = self.col != ""
            case _:
                t = self.col
                found = F.when((t["k"] == T.LITERAL) & (t["d"] == T.BOOLEAN), t["v"].isin("true", "1")).when(t["n"].isNotNull(), (t["n"] != 0) & ~F.isnan(t["n"])).when(text_like(t), t["v"] != "")
        return F.coalesce(found, F.lit(False))


def is_text(t: T.Term) -> bool:
    return t.k == T.LITERAL and (bool(t.l) or t.d in ("", T.STRING))


def text_like(t: Column) -> Column:
    return (t["k"] == T.LITERAL) & ((t["l"] != "") | t["d"].isin("", T.STRING))


def boolean(c: Column) -> Value:
    return Value("bool", c)


def compile_expr(e: Expr, scope: Scope) -> Value:
    match e:
        case Var():
            return Value("term", scope.get(e.name, T.unbound()))
        case T.Term():
            return Value("term", T.constant(e), const=e)
        case Op():
            return _op(e, [compile_expr(a, scope) for a in e.args])
        case Call():
            return _call(e, [compile_expr(a, scope) for a in e.args], scope)
    raise TypeError(e)


def truth(e: Expr, scope: Scope) -> Column:
    """True where the expression's effective boolean value is; false or null elsewhere. For filters and join conditions."""
    if isinstance(e, Op):
        if e.name == "&&":
            return truth(e.args[0], scope) & truth(e.args[1], scope)
        if e.name == "||":
            return truth(e.args[0], scope) | truth(e.args[1], scope)
        if e.name in _FLIP and e.name != "!=":
            a, b = e.args
            op = e.name
            if isinstance(a, T.Term) and not isinstance(b, T.Term):
                a, b, op = b, a, _FLIP[op]
            if isinstance(b, T.Term) and not isinstance(a, T.Term):
                fast = _against_constant(op, compile_expr(a, scope), b)
                if fast is not None:
                    return fast
    value = compile_expr(e, scope)
    return value.col if value.form == "bool" else value.truth()


def _against_constant(op: str, left: Value, t: T.Term) -> Column | None:
    """left op constant as a plain comparison that a scan can use."""
    if t.n is not None and t.n == t.n:
        n, c = left.number(), F.lit(t.n)
        match op:
            case "=":
                return n == c
            case "<":
                return n < c
            case "<=":
                return n <= c
            case ">":
                return (n > c) & ~F.isnan(n)
        return (n >= c) & ~F.isnan(n)
    if op == "=" and left.form == "term":
        x = left.col
        return (x["v"] == t.v) & (x["k"] == t.k) & (x["l"] == t.l) & (x["d"] == t.d)
    if is_text(t):
        x = left.string()
        return {"<": x < t.v, "<=": x <= t.v, ">": x > t.v, ">=": x >= t.v}.get(op)
    return None


def _op(e: Op, args: list[Value]) -> Value:
    a = args[0]
    b = args[-1]
    match e.name:
        case "||":
            if a.form == b.form == "bool":
                return boolean(a.col | b.col)
            return boolean(F.when(a.truth() | b.truth(), True).when(a.is_error() | b.is_error(), F.lit(None)).otherwise(False))
        case "&&":
            if a.form == b.form == "bool":
                return boolean(a.col & b.col)
            no = (a.bound() & ~a.truth()) | (b.bound() & ~b.truth())
            return boolean(F.when(no, False).when(a.bound() & b.bound(), True))
        case "!":
            if a.form == "bool":
                return boolean(~a.col)
            return boolean(F.when(~a.is_error(), ~a.truth()))
        case "neg":
            return Value("number", -a.number(), integral=a.is_integral())
        case "+" | "-" | "*":
            x, y = a.number(), b.number()
            found = x + y if e.name == "+" else x - y if e.name == "-" else x * y
            return Value("number", found, integral=a.is_integral() & b.is_integral())
        case "/":
            return Value("number", F.try_divide(a.number(), b.number()), integral=F.lit(False))
        case "=":
            return boolean(_equal(a, b))
        case "!=":
            return boolean(~_equal(a, b))
    return boolean(_less(e.name, a, b))


def _equal(a: Value, b: Value) -> Column:
    x, y = a.number(), b.number()
    if a.form == b.form == "number":
        same = (x == y) & ~F.isnan(x)
        return same
    s, t = a.term(), b.term()
    return F.when(x.isNotNull() & y.isNotNull(), (x == y) & ~F.isnan(x)).otherwise(s == t)


def _less(op: str, a: Value, b: Value) -> Column:
    compare = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
    x, y = a.number(), b.number()
    numbers = F.when(x.isNotNull() & y.isNotNull(), compare(x, y) & ~F.isnan(x) & ~F.isnan(y))
    if "number" in (a.form, b.form):
        return numbers
    texts = compare(a.string(), b.string())
    if a.form == b.form == "term":
        s, t = a.col, b.col
        iris = F.when((s["k"] == T.IRI) & (t["k"] == T.IRI), compare(s["v"], t["v"]))
        return F.coalesce(numbers, texts, iris)
    return F.coalesce(numbers, texts)


def _bytes(text: Column, start: Column, size: Column | None) -> Column:
    data = text.cast("binary")
    return F.substring(data, start, F.lit(1 << 30) if size is None else size).cast("string")


def _call(e: Call, args: list[Value], scope: Scope) -> Value:
    a = args[0]
    t = a.term() if a.form != "term" else a.col
    whole = F.lit(True)
    match e.name:
        case "BOUND":
            return boolean(a.bound())
        case "COALESCE":
            found = F.coalesce(*(x.term() for x in args))
            return Value("term", found, error=found.isNull())
        case "IF":
            yes = a.truth()
            return Value("term", F.when(yes, args[1].term()).otherwise(args[2].term()), error=F.when(yes, args[1].is_error()).otherwise(args[2].is_error()))
        case "ISIRI" | "ISURI":
            return boolean(t["k"] == T.IRI)
        case "ISLITERAL":
            return boolean(t["k"] == T.LITERAL)
        case "ISBLANK":
            return boolean(t["k"] == T.BLANK)
        case "ISNUMERIC":
            return boolean(F.when(t.isNotNull(), t["n"].isNotNull()))
        case "STR":
            return Value("text", t["v"])
        case "LANG":
            return Value("text", F.when(t["k"] == T.LITERAL, t["l"]))
        case "DATATYPE":
            found = T.iri_term(F.when(t["k"] == T.LITERAL, F.when(t["d"] == "", T.STRING).otherwise(t["d"])))
            return Value("term", found, error=found.isNull())
        case "SAMETERM":
            return boolean(t == args[1].term())
        case "LANGMATCHES":
            tag, wanted = F.lower(a.string()), F.lower(args[1].string())
            return boolean(F.when(wanted == "*", tag != "").otherwise((tag == wanted) | F.startswith(tag, F.concat(wanted, F.lit("-")))))
        case "ABS":
            return Value("number", F.abs(a.number()), integral=a.is_integral())
        case "CEIL" | "FLOOR" | "ROUND":
            n = a.number() + 0.5 if e.name == "ROUND" else a.number()
            step = F.ceil(n) if e.name == "CEIL" else F.floor(n)
            return Value("number", F.when(F.abs(n) < 9e15, step.cast("double")).otherwise(n), integral=whole)
    text = a.string()
    match e.name:
        case "STRLEN":
            return Value("number", F.octet_length(text).cast("double"), integral=whole)
        case "UCASE" | "LCASE":
            return _same_kind(a, F.translate(text, *((LOWER, UPPER) if e.name == "UCASE" else (UPPER, LOWER))))
        case "CONTAINS":
            return boolean(F.contains(text, args[1].string()))
        case "STRSTARTS":
            return boolean(F.startswith(text, args[1].string()))
        case "STRENDS":
            return boolean(F.endswith(text, args[1].string()))
        case "SUBSTR":
            start = F.greatest(F.lit(1.0), args[1].number()).cast("int")
            size = F.greatest(F.lit(0.0), F.least(F.lit(float(1 << 30)), args[2].number())).cast("int") if len(args) > 2 else None
            ok = args[1].number().isNotNull() if size is None else args[1].number().isNotNull() & args[2].number().isNotNull()
            past = start > F.octet_length(text)
            cut = F.when(ok, F.when(past, "").otherwise(_bytes(text, start, size)))
            if a.form == "text":
                return Value("text", cut)
            kept = F.when(cut.isNotNull(), F.when(past, T.make(F.lit(T.LITERAL), F.lit(""), None, F.lit(T.STRING))).otherwise(T.make(F.lit(T.LITERAL), cut, t["l"], t["d"])))
            return Value("term", kept, error=kept.isNull())
        case "REGEX":
            return boolean(_regex(text, args))
    raise ValueError(e.name)


def _same_kind(a: Value, text: Column) -> Value:
    """A literal of a's language and datatype with another text."""
    if a.form == "text":
        return Value("text", text)
    found = F.when(text.isNotNull(), T.make(F.lit(T.LITERAL), text, a.col["l"], a.col["d"]))
    return Value("term", found, error=found.isNull())


def _regex(text: Column, args: list[Value]) -> Column:
    """Java's dialect. A pattern that doesn't compile, constant or from the data, is an error for its row; data's are tried in the JVM first."""
    fold = F.lit("")
    if len(args) > 2:
        flags = args[2].const
        fold = F.lit("(?i)" if "i" in flags.v else "") if flags is not None else F.when(F.contains(args[2].string(), F.lit("i")), "(?i)").otherwise("")
    pattern = args[1].const
    if pattern is not None:
        java = SparkSession.getActiveSession()._jvm.java.util.regex
        try:
            java.Pattern.compile(pattern.v)
        except Exception:
            return F.lit(None).cast("boolean")
        return F.rlike(text, F.concat(fold, args[1].string()))
    found = F.concat(fold, args[1].string())
    compiles = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.coalesce(found, F.lit("")))
    return F.rlike(text, F.when(compiles.isNotNull(), found))
