"""SPARQL algebra and expressions as plain data, and their printed form."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions.terms import Term


@dataclass(frozen=True)
class Var:
    name: str

    @property
    def hidden(self) -> bool:
        """A blank node of the query: a variable that no projection can name."""
        return self.name.startswith("_bnode_")


Slot = Var | Term


# --- expressions ---
@dataclass(frozen=True)
class Op:
    """|| && ! = != < <= > >= + - * / and neg."""

    name: str
    args: tuple[Expr, ...]


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple[Expr, ...]


Expr = Var | Term | Op | Call


# --- patterns ---
@dataclass(frozen=True)
class Triple:
    s: Slot
    p: Slot
    o: Slot

    def slots(self) -> tuple[Slot, Slot, Slot]:
        return self.s, self.p, self.o

    def variables(self) -> list[str]:
        return [x.name for x in self.slots() if isinstance(x, Var)]


@dataclass(frozen=True)
class Bgp:
    triples: tuple[Triple, ...] = ()


@dataclass(frozen=True)
class Join:
    left: Node
    right: Node


@dataclass(frozen=True)
class LeftJoin:
    left: Node
    right: Node
    conditions: tuple[Expr, ...] = ()


@dataclass(frozen=True)
class Union:
    left: Node
    right: Node


@dataclass(frozen=True)
class Filter:
    child: Node
    condition: Expr


@dataclass(frozen=True)
class Graph:
    name: Slot
    child: Node


@dataclass(frozen=True)
class Aggregate:
    func: str
    argument: Expr | None
    distinct: bool
    out: str


@dataclass(frozen=True)
class Group:
    child: Node
    keys: tuple[str, ...]
    aggregates: tuple[Aggregate, ...]


@dataclass(frozen=True)
class OrderBy:
    child: Node
    keys: tuple[tuple[Expr, bool], ...]  # descending if true


@dataclass(frozen=True)
class Project:
    child: Node
    names: tuple[str, ...]


@dataclass(frozen=True)
class Distinct:
    child: Node


@dataclass(frozen=True)
class Slice:
    child: Node
    offset: int
    limit: int | None


Node = Bgp | Join | LeftJoin | Union | Filter | Graph | Group | OrderBy | Project | Distinct | Slice


@dataclass
class Query:
    root: Node
    projection: list[str]
    star: bool
    text: str
    prefixes: dict[str, str] = field(default_factory=dict)


def expr_variables(e: Expr | None) -> list[str]:
    if isinstance(e, Var):
        return [e.name]
    if isinstance(e, (Op, Call)):
        return [v for a in e.args for v in expr_variables(a)]
    return []


def mentioned(node: Node) -> list[str]:
    """Variables in order of first appearance: filters count, sort keys don't."""
    found: dict[str, None] = {}

    def add(*names: str) -> None:
        found.update(dict.fromkeys(names))

    def walk(n: Node) -> None:
        match n:
            case Bgp():
                for t in n.triples:
                    add(*t.variables())
            case Join() | Union():
                walk(n.left)
                walk(n.right)
            case LeftJoin():
                walk(n.left)
                walk(n.right)
                for c in n.conditions:
                    add(*expr_variables(c))
            case Filter():
                walk(n.child)
                add(*expr_variables(n.condition))
            case Graph():
                if isinstance(n.name, Var):
                    add(n.name.name)
                walk(n.child)
            case Group():
                walk(n.child)
                add(*n.keys, *(a.out for a in n.aggregates))
            case _:
                walk(n.child)

    walk(node)
    return list(found)


def show_expr(e: Expr) -> str:
    match e:
        case Var():
            return f"?{e.name}"
        case Op(name, (a,)):
            return f"({'-' if name == 'neg' else name} {show_expr(a)})"
        case Op(name, (a, b)):
            return f"({show_expr(a)} {name} {show_expr(b)})"
        case Call():
            return f"{e.name}({', '.join(map(show_expr, e.args))})"
    return str(e)


def show(node: Node, depth: int = 0) -> str:
    """The algebra as an indented tree."""
    pad = "  " * depth
    slot = lambda x: f"?{x.name}" if isinstance(x, Var) else str(x)
    match node:
        case Bgp():
            return f"{pad}BGP\n" + "".join(f"{pad}  {' '.join(map(slot, t.slots()))}\n" for t in node.triples)
        case Join() | Union():
            return f"{pad}{type(node).__name__}\n" + show(node.left, depth + 1) + show(node.right, depth + 1)
        case LeftJoin():
            on = " on " + " && ".join(map(show_expr, node.conditions)) if node.conditions else ""
            return f"{pad}LeftJoin{on}\n" + show(node.left, depth + 1) + show(node.right, depth + 1)
        case Filter():
            head = f"Filter {show_expr(node.condition)}"
        case Graph():
            head = f"Graph {slot(node.name)}"
        case Group():
            head = "Group " + " ".join([*(f"?{k}" for k in node.keys), *(f"({a.func}({'DISTINCT ' if a.distinct else ''}{show_expr(a.argument) if a.argument is not None else '*'}) AS ?{a.out})" for a in node.aggregates)])
        case OrderBy():
            head = "OrderBy " + " ".join(f"{'DESC' if d else 'ASC'}({show_expr(e)})" for e, d in node.keys)
        case Project():
            head = "Project " + " ".join(f"?{v}" for v in node.names)
        case Slice():
            head = f"Slice offset {node.offset} limit {'none' if node.limit is None else node.limit}"
        case _:
            head = type(node).__name__
    return f"{pad}{head}\n" + show(node.child, depth + 1)
