"""Brute-force versions that the operators are held against."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict


class Groups:
    """Smallest member of each group."""

    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def shingle_set(text):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    if len(w) >= 5:
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    return {tuple(w)} if w else set()


def jaccard_groups(docs):
    """{doc_id: (n_shingles, component_id)} of {doc_id: text}."""
    sets = {i: shingle_set(t) for i, t in docs.items()}
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    groups = Groups(sets)
    for a, s in sets.items():
        shared = Counter(b for x in s for b in where[x] if b > a)
        for b, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(sets[b]) - n):
                groups.join(a, b)
    return {i: (len(s), groups.find(i)) for i, s in sets.items()}


def without_repeats(docs, length=100):
    """{doc_id: (n_bytes, n_removed, n_spans, kept)} of {doc_id: text}, in the order of ids."""
    seen, out = set(), {}
    for i in sorted(docs):
        data, spans = (docs[i] or "").encode(), []
        for s in range(len(data) - length + 1):
            said = data[s : s + length]
            if said not in seen:
                seen.add(said)
            elif spans and s <= spans[-1][1]:
                spans[-1][1] = s + length
            else:
                spans.append([s, s + length])
        kept, at = [], 0
        for a, b in spans:
            kept.append(data[at:a])
            at = b
        kept = b"".join([*kept, data[at:]])
        out[i] = (len(data), len(data) - len(kept), len(spans), kept)
    return out


def test_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contaminated(docs, items, size=10):
    """{doc_id: (n_words, n_hit, items)} of {doc_id: text} and {item: text}."""
    windows = defaultdict(set)
    for k, t in items.items():
        w = test_words(t)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[i : i + size])].add(k)
    out = {}
    for d, t in docs.items():
        w, hit, found = test_words(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= own
        out[d] = (len(w), len(hit), found)
    return out


def near_items(docs, items, slop=5, size=10, rarest=3):
    """{doc_id: items with a window whose rarest words all stand within ``slop`` of their places by the rarest}."""
    texts = {d: test_words(t) for d, t in docs.items()}
    df = Counter(x for w in texts.values() for x in set(w))
    windows = defaultdict(set)
    for k, t in items.items():
        w = test_words(t)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[i : i + size])].add(k)
    plans = [(sorted((df[x], x.encode(), i) for i, x in enumerate(w))[:rarest], own) for w, own in windows.items() if all(df[x] for x in w)]
    out = {}
    for d, w in texts.items():
        at = defaultdict(list)
        for i, x in enumerate(w):
            at[x.encode()].append(i)
        out[d] = set()
        for plan, own in plans:
            starts = [p - plan[0][2] for p in at[plan[0][1]] if p >= plan[0][2]]
            if any(all(any(abs(p - off - s) <= slop for p in at[x]) for _, x, off in plan) for s in starts):
                out[d] |= own
    return out


test_words.__test__ = False


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()
