"""Spelling variants against brute force, and their edges."""

import random
import zlib
from collections import Counter
import re

import numpy as np
import pytest

from fleetstats.llm import spelling

from .test_edges import table


def counted(docs, letters=6, least=5, misspelt=199):
    out = Counter()
    for i, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % misspelt == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= letters and n >= least}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def grouped(docs, letters=6, least=5, misspelt=199):
    n = counted(docs, letters, least, misspelt)
    forms, counts = {}, {}
    for w in n:
        own = sorted((v for v in n if near(w, v)), key=lambda v: (-n[v], v))
        counts[w] = len(own)
        forms[w] = own[0] if own and n[own[0]] >= 5 * n[w] else None
    roots = {}
    for w in n:
        at = w
        while forms[at]:
            at = forms[at]
        roots[w] = at
    return {w: (forms[w], roots[w], n[w], counts[w], n[forms[w]] if forms[w] else None) for w in n}


def found(df):
    rows = df.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: tuple(r[1:]) for r in rows}


@pytest.fixture
def said():
    """Words with edited copies, chains of forms, equal counts and accents, in few and many documents."""
    rng = random.Random(3)
    words, docs = [], []
    for _ in range(60):
        w = "".join(rng.choice("abcdeéü") for _ in range(rng.randint(6, 9)))
        words.append(w)
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(w))
            w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abé") + w[k:], w[:k] + rng.choice("abü") + w[k + 1 :]])
            words.append(w)
    for i in range(40):
        docs.append((i, " ".join(rng.choice(("{}", "{},", "x{}1")).format(w if rng.random() < 0.8 else w.upper()) for w in rng.choices(words, weights=[2.0 ** rng.randint(0, 7) for _ in words], k=120))))
    return docs


def test_against_brute_force(spark, said):
    docs = [*said, (None, "abcdef " * 7), (90, None), (91, ""), (92, "short w"), (93, "chainaa " * 5 + "chainab " * 25 + "chainbb " * 125), *said[:3]]
    assert found(spelling.variant_groups(table(spark, docs))) == grouped(docs)
    want = grouped(docs, 4, 2, 7)
    assert found(spelling.variant_groups(table(spark, docs), letters=4, least=2, misspelt=7)) == want and any(f for f, *_ in want.values())


def test_tiles_of_few_words(spark, said, monkeypatch):
    want = found(spelling.variant_groups(table(spark, said)))
    monkeypatch.setattr(spelling, "TILE", 3)
    assert found(spelling.variant_groups(table(spark, said))) == want == grouped(said)


def test_very_long_words(spark):
    long = "ab" * 3000
    docs = [(i, f"{long} {long}c {long[:-1]}x {long[::-1]}") for i in range(6)]
    assert found(spelling.variant_groups(table(spark, docs), misspelt=1 << 33)) == grouped(docs, misspelt=1 << 33)


def test_nothing(spark):
    assert spelling.variant_groups(table(spark, [])).count() == 0
    assert spelling.variant_groups(table(spark, [(1, None), (2, "a b")])).count() == 0


def test_one_edit_by_hand():
    def code(*ws):
        return np.frombuffer("".join(ws).encode("latin-1"), np.uint8).reshape(len(ws), -1)

    x, y, z = code("abcdef", "abcdeg"), code("abcdefg", "xabcdef", "abcxdef", "abdcefg"), code("abcdeg", "abdcef")
    both = [(i, j) for i in range(2) for j in range(4)]
    i, j = (np.array(c) for c in zip(*both))
    assert [bool(v) for v in spelling._one_edit(x, y, i, j)] == [near("abcdef abcdeg".split()[a], "abcdefg xabcdef abcxdef abdcefg".split()[b]) for a, b in both]
    assert list(spelling._one_edit(x, z, np.array([0, 0, 1]), np.array([0, 1, 0]))) == [True, False, False]
