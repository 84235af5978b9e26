"""The trie of conversation prefixes against brute force, cut into any number of shards."""

import random
import re
import zlib

import pytest

from fleetstats.llm import prefix_trie
from fleetstats.llm.queries import QUERIES

from .helpers import sha

CONV = "conv_id long, turn long, role string, text string, node binary, shard int, id long, words string, n long"


def table(spark, rows):
    """Turns with columns that clash with names the operator uses within."""
    return spark.createDataFrame([(*r, b"x", 7, 7, "w", 7) for r in rows], CONV)


def brute(rows, rebuild=True):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(ts, key=lambda x: (x[0], x[1], x[2], x[3]))] for c, ts in own.items()}
    if rebuild:
        size = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
        own = {c: own.get(c - c % 20, [])[: size[c]] + ts[size[c] :] for c, ts in own.items()}
    nodes = {}
    for c, ts in own.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    kids, leaves, saved = ({p: 0 for p in nodes} for _ in range(3))
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    for p, cs in nodes.items():
        w = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(cs) - 1) * w
    return sorted(
        (min(cs), len(p), min(nodes[p[:-1]]) if p else None, len(cs), kids[p], leaves[p], saved[p], sha(",".join(str(c) for c in sorted(cs) if len(own[c]) == len(p)))) for p, cs in nodes.items()
    )


def got(df):
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def rows():
    """Common starts, equal conversations, nulls, empty texts, repeated rows and one very long conversation."""
    rng = random.Random(9)
    out = []
    for c in range(160):
        for t in range(rng.randint(1, 6)):
            out.append((c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["same first words", "", "a b"]) if t < 2 else rng.choice("xyz") * rng.randint(1, 2)))
    out += [(c, t, "user", f"copy {t}") for c in range(300, 340) for t in range(3)]
    out += [(400, None, None, None), (400, 1, "user", None), (400, 1, "user", None), (None, 0, "user", "lost"), (421, 0, "user", "short"), (-5, 0, "user", "same first words"), (500, 0, "user", "word " * 50_000)]
    out += [(440, t, "user", f"turn {t % 7}") for t in range(300)]
    return out


@pytest.mark.parametrize("turns", [65_536, 40, 3, 1])
def test_against_brute_force(spark, rows, turns):
    made = prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.turn_sequences(table(spark, rows))), turns)
    some = [r for r in rows if r[0] is None or r[0] >= 0]
    want = brute(some)
    found = got(made)
    if turns == 65_536:
        plain = prefix_trie.prefix_trie(prefix_trie.turn_sequences(table(spark, rows)))
        assert got(plain) == brute(rows, rebuild=False)
    less = prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.turn_sequences(table(spark, some))), turns)
    assert got(less) == want and sum(r[1] == 0 for r in found) == 1


def test_registered(spark, duck, sf_dir):
    rows = duck.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    assert got(QUERIES["op11_prefix_trie"](spark, sf_dir)) == brute(rows)


def test_turnless_and_empty(spark):
    # Conversation 21 has one turn; its checksum takes up to three away, and there is no conversation 20.
    turnless = [c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4]
    rows = [(c, 0, "user", "x y") for c in turnless]
    made = got(prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.turn_sequences(table(spark, rows)))))
    assert made == [(min(turnless), 0, None, len(turnless), 0, 1, 0, sha(",".join(map(str, turnless))))]
    assert prefix_trie.prefix_trie(prefix_trie.turn_sequences(table(spark, []))).count() == 0


def test_tree_is_balanced():
    tree = prefix_trie.SearchTree()
    for i in prefix_trie._halves(1023):
        tree.insert([i], [1], 1, i, (i, i + 1))

    def height(at):
        return 1 + max(height(tree.lower[at]), height(tree.higher[at])) if at else 0

    assert height(tree.equal[0]) == 10 and tree.members[0] == 1023
