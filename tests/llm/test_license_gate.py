"""The keyword gate of the license scan leaves out no rule that would match."""

import random
import re._parser as parser

import pytest

from quadrille.llm import licenses


def made(rng, items):
    """A text that the parsed pattern matches, alternatives and repeats taken by chance."""
    out = ""
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "BRANCH":
            out += made(rng, rng.choice(arg[1]))
        elif name == "SUBPATTERN":
            out += made(rng, arg[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            out += "".join(made(rng, arg[2]) for _ in range(rng.randint(arg[0], min(int(arg[1]), arg[0] + 2))))
        elif name == "IN":
            kind, value = rng.choice(arg)
            out += chr(value) if str(kind) == "LITERAL" else chr(rng.randint(*value)) if str(kind) == "RANGE" else "7"
        elif not name.startswith("ASSERT"):
            raise ValueError(name)
    return out


def test_gated_scan_equals_the_ungated_one():
    rng = random.Random(6)
    for r in licenses.rules():
        for _ in range(40):
            text = made(rng, parser.parse(r.pattern.pattern))
            assert set(r.keywords) & set(licenses.words_of(text)), (r, text)
    for r in licenses.rules():
        text = made(rng, parser.parse(r.pattern.pattern))
        assert licenses.scan(text) == licenses.scan(text, gated=False), text


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("GNU Library General Public License version 2", "lgpl-2.0"), ("PSF License Version 2", "psf-2.0"), ("Open Font License Version 1.1", "ofl-1.1"),
        ("University of Illinois Open Source License", "ncsa"), ("Creative Commons Zero License Version 1.0", "cc0-1.0"),
    ],
)
def test_names_without_the_usual_keyword(text, label):
    assert label in {d.label for d in licenses.scan(text)[1]}
    assert not {d.label for d in licenses.scan("an open source license")[1]}


def scan_by_hand(text):
    """All rules in their order, without a gate; a detection goes if any taken one contains it."""
    words = licenses.words_of(text)
    line, found, taken = f" {' '.join(words)} " if words else " ", [], []
    for i, r in enumerate(licenses.rules()):
        at = 0
        while m := r.pattern.search(line, at):
            begin = line[: m.start()].count(" ") - 1
            end = max(begin + 1, line[: m.end()].count(" "))
            at = m.start() + 1 if r.base else max(m.end(), m.start() + 1)
            if r.base or not any(a <= begin and end <= b for a, b in taken):
                found.append((begin, end, i, r.base))
                taken += [] if r.base else [(begin, end)]
    return len(words), sorted(found)


def test_suppression_by_brute_force():
    """Texts put together from matches of several rules, repeated and overlapping, long and empty ones too."""
    rng = random.Random(8)
    texts = ["", "x", "copyright " * 300, "MIT License " * 400 + "public domain"]
    for _ in range(120):
        parts = [made(rng, parser.parse(rng.choice(licenses.rules()).pattern.pattern)) for _ in range(rng.randint(1, 8))]
        if rng.random() < 0.3:
            parts *= 2
        texts.append(rng.choice([" ", ", ", " the "]).join(parts))
    dropped = 0
    for text in texts:
        n, found = licenses.scan(text)
        want = scan_by_hand(text)
        assert (n, sorted((d.begin, d.end, d.rule, d.base) for d in found)) == want, text
        dropped += sum(len(r.pattern.findall(f" {' '.join(licenses.words_of(text))} ")) for r in licenses.rules()) - len(found)
    assert dropped > 100


def test_versions_and_very_long_texts():
    import time

    labels = lambda text: {d.label for d in licenses.scan(text)[1]}
    assert labels("CC BY-NC-SA 4.0") == {"cc-by-nc-sa-4.0", "cc-by"} and "apache-2.0" in labels("Apache License, Version 2.0") and "cc0-1.0" in labels("CC0 1.0 Universal")
    assert "gpl-3.0" in labels("under the GNU General Public License v3.0 or later") and "lgpl-2.1" in labels("LGPL-2.1-or-later")
    began = time.time()
    assert len(licenses.scan("copyright foo " * 75_000)[1]) == 75_000  # a megabyte
    assert time.time() - began < 5
