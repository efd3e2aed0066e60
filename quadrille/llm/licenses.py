"""License scans: ordered signature rules over the words of a text.

A rule is a regular expression over words, written by hand (signatures.py), with keywords. One
pass of a keyword automaton tells which rules can match at all; only those run. Detections
are then taken by priority: one that lies within an interval already taken is dropped, so
"apache license version 2 0" doesn't also count as a bare "apache license". Base rules
(plain phrases) always stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .signatures import SIGNATURES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {ord(a): a.lower() for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}

#: Phrases that are always reported, whatever else covers them.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


@dataclass(frozen=True)
class Rule:
    label: str
    #: Words of which any text that the pattern matches has one at least.
    keywords: tuple[str, ...]
    pattern: re.Pattern
    weight: float
    base: bool = False


@cache
def rules() -> tuple[Rule, ...]:
    """All rules in order of priority: the base phrases, then the signatures."""

    def rule(label: str, keywords: str, pattern: str, weight: float, base: bool = False) -> Rule:
        # over " w1 w2 ... wn ", so a match begins behind a space and ends before one
        return Rule(label, tuple(keywords.split()), re.compile(rf"(?<= )(?:{pattern})(?= )"), weight, base)

    return (*(rule(label, phrase.split()[0], phrase, 0.9, base=True) for phrase, label in BASE), *(rule(*s) for s in SIGNATURES))


@cache
def keywords() -> tuple[ahocorasick.Automaton, dict[str, tuple[int, ...]]]:
    by: dict[str, list[int]] = {}
    for i, r in enumerate(rules()):
        for k in r.keywords:
            by.setdefault(k, []).append(i)
    found = ahocorasick.Automaton()
    for k in by:
        found.add_word(f" {k} ", k)  # whole words
    found.make_automaton()
    return found, {k: tuple(v) for k, v in by.items()}


@dataclass(frozen=True)
class Detection:
    label: str
    rule: int
    #: Words from, and to before.
    begin: int
    end: int
    weight: float
    base: bool


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(_LOWER))


def scan(text: str | None, gated: bool = True) -> tuple[int, list[Detection]]:
    """The number of words, and the detections that stay, by their place. Without the gate of keywords the same, but slower."""
    words = words_of(text)
    line = f" {' '.join(words)} " if words else " "
    automaton, by = keywords()
    # words share their spaces, which an automaton over " word " needs twice only where two keywords touch: it reports overlaps
    hit = {k for _, k in automaton.iter(line)} if gated else set(by)
    if not hit:
        return len(words), []
    chars = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    spaces = np.flatnonzero(chars == 32)
    found: list[Detection] = []
    # intervals taken so far: their begins, ascending, and the largest end up to each
    begins, ends, reach = (np.empty(0, np.int64),) * 3
    for i in sorted({i for k in hit for i in by[k]}):
        r = rules()[i]
        places, labels = _matches(r, line)
        if not len(places):
            continue
        own = np.searchsorted(spaces, places)
        own[:, 0] -= 1
        own[:, 1] = np.maximum(own[:, 1], own[:, 0] + 1)
        if not r.base:
            at = np.searchsorted(begins, own[:, 0], side="right") - 1
            free = np.flatnonzero(~((at >= 0) & (reach[at] >= own[:, 1]))) if len(begins) else np.arange(len(own))
            own, labels = own[free], [labels[j] for j in free.tolist()]
            begins, ends = np.concatenate([begins, own[:, 0]]), np.concatenate([ends, own[:, 1]])
            order = np.argsort(begins, kind="stable")
            begins, ends = begins[order], ends[order]
            reach = np.maximum.accumulate(ends)
        found += [Detection(label, i, begin, end, r.weight, r.base) for label, (begin, end) in zip(labels, own.tolist())]
    return len(words), sorted(found, key=lambda d: (d.begin, d.end, d.rule))


def _matches(r: Rule, line: str) -> tuple[np.ndarray, list[str]]:
    """Where a rule matches in a line, begins and ends (n, 2), and the labels. A base phrase's places may overlap, others don't."""
    places, labels, at = [], [], 0
    while m := r.pattern.search(line, at):
        places.append((m.start(), m.end()))
        labels.append(r.label.replace("{v}", (m["v"] or "").strip().replace(" ", ".")).rstrip("-") if "{v}" in r.label else r.label)
        at = m.start() + 1 if r.base else max(m.end(), m.start() + 1)
    return np.array(places, np.int64).reshape(-1, 2), labels


SPAN = pa.struct([("label", pa.string()), ("rule", pa.int32()), ("begin", pa.int64()), ("end", pa.int64()), ("weight", pa.float64()), ("base", pa.bool_())])


def license_scan(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to (doc_id, n_words, detections): label, rule, begin and end in words, weight, base.

    Whole texts are read, A-Z in lower case. Null texts count as empty and have no word. Every
    row is scanned by itself, repeated ids and rows too. An empty table gives no row.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, spans = [], []
            for text in batch.column(1).to_pylist():
                n, found = scan(text)
                counts.append(n)
                spans.append([d.__dict__ for d in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(SPAN))], names=["doc_id", "n_words", "detections"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(of, "doc_id long, n_words long, detections array<struct<label:string,rule:int,begin:bigint,end:bigint,weight:double,base:boolean>>")


def digest(found: DataFrame) -> DataFrame:
    """One flat row for each document."""
    base = F.filter("detections", lambda d: d["base"])
    labels = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda d: d["label"]))), ",")
    starts = F.transform(base, lambda d: d["begin"])
    miss = F.aggregate("detections", F.lit(1.0), lambda s, d: s * (1 - d["weight"]))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("detections")).alias("labels"), (1 - miss).alias("score"),
    )
