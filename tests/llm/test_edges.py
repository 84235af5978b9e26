"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetstats.llm import chat, components, decontamination, jaccard_join, langid, packing, paragraph_dedup, quality, suffix_dedup, url_filter, warc

from .helpers import contaminated, jaccard_groups, near_items, sha, without_repeats

DOC = "doc_id long, text string, lang string, source string, n_chars long, n long, key long, node long, _salt int, words int"


def table(spark, docs, schema=DOC):
    """Documents with columns that clash with names the operators use within."""
    return spark.createDataFrame([(i, t, "en", "s", 1, 7, 7, 7, 7, 7) for i, t in docs], schema)


def sentences(rng, n, words=9):
    return " ".join(" ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(words)).capitalize() + "." for _ in range(n))


@pytest.fixture(scope="module")
def mixed():
    """Copies, edited copies, shared passages, repeats within a text, very short and very long texts."""
    rng = random.Random(5)
    base, passage = sentences(rng, 14), sentences(rng, 8)
    docs = {0: base, 1: base, 2: "", 3: None, 4: "A b c", 5: "a B c", 6: passage * 3, 7: "é" * 150, 8: "x" * 400}
    for i in range(10, 60):
        w = base.split()
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = "z" + str(rng.randrange(10**6))
        docs[i] = " ".join(w)
    for i in range(60, 100):
        docs[i] = sentences(rng, rng.randint(1, 9)) + " " + passage + " " + sentences(rng, rng.randint(1, 9))
    docs[100] = sentences(rng, 3000)
    docs[101] = sentences(rng, 5) + " " + docs[100][1000:30000]
    return docs


EMPTY = [("op1", lambda d: suffix_dedup.remove_repeats(d)), ("op3", lambda d: paragraph_dedup.remove_paragraphs(d)), ("op4", lambda d: quality.judge(d)), ("op6", lambda d: langid.identify(d)), ("op7", lambda d: packing.pack(packing.cut(d))), ("op9", lambda d: jaccard_join.similar_groups(d))]


@pytest.mark.parametrize("name,run", EMPTY)
def test_empty_table(spark, name, run):
    assert run(table(spark, [])).count() == 0


@pytest.mark.parametrize("name,run", EMPTY)
def test_nulls_only(spark, name, run):
    got = run(table(spark, [(None, None), (1, None), (2, "")]))
    assert got.count() == 3


def test_other_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filter.filter_urls(pages, url_filter.RULES).count() == 0 and warc.captures(pages).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digest(chat.format_conversations(turns)).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    got = decontamination.contamination(table(spark, [(1, "a b c")]), items).collect()
    assert [(r["n_words"], r["n_hit"]) for r in got] == [(3, 0)]


def test_suffix_dedup(spark, mixed, monkeypatch):
    want = without_repeats(mixed)
    got = suffix_dedup.remove_repeats(table(spark, mixed.items()).repartition(5)).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got} == want


def test_suffix_dedup_of_repeated_rows_and_as_text(spark):
    text = sentences(random.Random(1), 20)
    got = suffix_dedup.remove_repeats(table(spark, [(1, text), (1, text), (2, "é" + text)]), ("lang", "n"), as_text=True).collect()
    assert sorted((r["doc_id"], r["n_removed"], r["lang"], r["n"]) for r in got) == [(1, 0, "en", 7), (1, 0, "en", 7), (2, len(text), "en", 7)]
    assert [r["kept"] for r in got if r["doc_id"] == 2] == ["é"]


def test_many_contexts_of_one_anchor(spark):
    """More contexts than MANY around one passage, so that strings are dealt one by one."""
    rng = random.Random(9)
    passage = sentences(rng, 3)
    docs = {i: sentences(rng, 2) + " " + passage + " " + sentences(rng, 2) for i in range(700)}
    got = suffix_dedup.remove_repeats(table(spark, docs.items()).coalesce(1)).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got} == without_repeats(docs)


def test_suffix_order():
    rng = random.Random(3)
    data = bytes(rng.choice(b"ab") for _ in range(40)) * 12 + bytes(rng.choice(b"ab") for _ in range(400))
    starts = np.arange(len(data) - 100 + 1)
    group = np.array([rng.randrange(2) for _ in starts])
    order, segment = suffix_dedup.multikey_quicksort(np.frombuffer(data, np.uint8)[starts[:, None] + np.arange(24)].view(">u8").astype(np.uint64), group)
    keys = [(group[i], data[i : i + 24]) for i in order]
    assert keys == sorted(keys) and [a == b for a, b in zip(keys, keys[1:])] == [a == b for a, b in zip(segment, segment[1:])]
    same = {}
    for i in starts:
        same.setdefault((group[i], data[i : i + 100]), set()).add(int(i))
    found = [set(map(int, x)) for x in suffix_dedup.sort_suffixes(data, starts, group)]
    assert sorted(map(sorted, found)) == sorted(sorted(v) for v in same.values() if len(v) > 1)
    names = [(group[min(f)], data[min(f) : min(f) + 100]) for f in found]
    assert names == sorted(names)


def test_long_documents_by_parts(spark, monkeypatch):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    monkeypatch.setattr(suffix_dedup, "PART", 512)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 600)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([long, long[100:2900]])], names=["doc_id", "text"])
    covered = set()
    starts = {1: set(), 2: set()}
    for b in suffix_dedup._runs(iter([batch])):
        for doc, span, kind in zip(b["doc_id"].to_pylist(), b["span"].to_pylist(), b["kind"].to_pylist()):
            if kind != suffix_dedup.NOTICE:
                starts[doc] |= set(range(span >> 8, (span >> 8) + (span & 255) + 1))
                covered |= {doc}
    assert starts[1] == set(range(2901)) and starts[2] == set(range(2701))


def test_jaccard_join(spark, mixed):
    got = jaccard_join.similar_groups(table(spark, mixed.items()).repartition(6)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == jaccard_groups(mixed)


def test_jaccard_join_of_chains(spark):
    """Each text is like the next only; the order of ids isn't that of the chain."""
    words = [f"w{i}" for i in range(400)]
    docs = {(i * 37) % 60: " ".join(words[i * 4 : i * 4 + 100]) for i in range(60)}
    want = jaccard_groups(docs)
    assert len({c for _, c in want.values()}) == 1
    got = jaccard_join.similar_groups(table(spark, docs.items())).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_jaccard_join_of_frequent_lists(spark, mixed, monkeypatch):
    """All lists as if they were frequent."""
    real = jaccard_join.postings
    monkeypatch.setattr(jaccard_join, "postings", lambda docs, sketch, _: real(docs, sketch, 0))
    got = jaccard_join.similar_groups(table(spark, mixed.items())).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == jaccard_groups(mixed)


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)] + [(5, 5)]
    from .helpers import Groups

    groups = Groups({x for a, b in edges if a != b for x in (a, b)})
    for a, b in edges:
        if a != b:
            groups.join(a, b)
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == {i: groups.find(i) for i in groups.up}


@pytest.mark.parametrize(("rounds", "named"), [(0, 64), (0, 2), (3, 64)])
def test_links_of_long_lists(spark, monkeypatch, rounds, named):
    """The last pass, by blocks, finds each link that no hub has found, in whichever lists of its prefixes a pair meets."""
    monkeypatch.setattr(components, "ROUNDS", rounds)
    monkeypatch.setattr(components, "MOST_NAMED", named)
    monkeypatch.setattr(components, "HUB_MEMBERS", 7)
    rng = random.Random(41)
    sets = [set(rng.sample(range(60), 44)) for _ in range(60)]
    for i in range(20):
        near = set(sets[i])
        for x in rng.sample(sorted(near), 4):
            near.remove(x)
        sets.append(near | set(rng.sample(range(60), 3)))
    # Names of lists don't go by their order.
    name = rng.sample(range(1000), 60)
    rows = [(name[x], i, len(s), at) for i, s in enumerate(sets) for at, x in enumerate(sorted(s)) if at <= len(s) - (4 * len(s) + 4) // 5]
    many = {}
    for r in rows:
        many[r[0]] = many.get(r[0], 0) + 1
    lists = spark.createDataFrame([(*r, many[r[0]]) for r in rows], "s long, node long, n int, pos int, m int")
    links = {(i, j) for j, y in enumerate(sets) for i, x in enumerate(sets[:j]) if 100 * len(x & y) >= 80 * len(x | y)}
    linked = spark.createDataFrame(sorted(links), "a long, b long")
    labels, found = components.link_lists(lists, lambda pairs: pairs.join(linked, ["a", "b"]).select("a", "b"), jaccard_join.BOUND)
    want = {r["node"]: r["component"] for r in components.connected_components(linked).collect()}
    assert {r["node"]: r["component"] for r in labels.collect()} == want
    if not rounds:
        assert sorted((r["a"], r["b"]) for r in found.collect()) == sorted(links)


def test_paragraph_dedup(spark, mixed):
    got = {r["doc_id"]: r for r in paragraph_dedup.remove_paragraphs(table(spark, mixed.items()).repartition(3)).collect()}
    assert set(got) == set(mixed)
    assert got[1]["n_removed"] > 0.6 * got[1]["n_bytes"] and 0 in got[1]["sources"] and got[0]["n_removed"] == 0
    assert all(got[i]["n_removed"] > 150 and got[i]["sources"] for i in range(61, 100)) and got[101]["n_removed"] > 20000
    assert got[2]["n_removed"] == got[3]["n_removed"] == got[4]["n_removed"] == 0 and got[3]["n_bytes"] == 0


def test_paragraph_classes_are_exact_jaccard(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    docs = {0: " ".join(base) + "."}
    for i in range(1, 40):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(60)] = f"v{rng.randrange(10**6)}"
        docs[i] = " ".join(w) + "."
    groups = jaccard_groups(docs)
    # Long paragraphs alone: texts of J under 0.8 may still share a short one.
    got = {r["doc_id"]: r["n_removed"] > 0 for r in paragraph_dedup.remove_paragraphs(table(spark, docs.items()), span=None).collect()}
    assert got == {i: groups[i][1] != i for i in docs}


def test_paragraph_dedup_of_passages_at_any_place(spark):
    """Passages of 50 to 120 words without stops, in sentences of 11 words or in one long sentence, against brute force."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))

    def around(n, stops):
        return [word() + ("." if stops and i % 11 == 10 else "") for i in range(n)]

    docs, places = {}, {}
    for k, n in enumerate([50, 55, 60, 70, 80, 100, 120] * 6):
        passage = around(n, k % 3 == 2)
        for i in (2 * k, 2 * k + 1):
            head, tail = around(rng.randint(0, 90), k % 2), around(rng.randint(0, 90), k % 2)
            docs[i], places[i] = " ".join([*head, *passage, *tail]), n
    repeats = without_repeats(docs)
    got = {r["doc_id"]: r for r in paragraph_dedup.remove_paragraphs(table(spark, docs.items()).repartition(3)).collect()}
    for i, n in places.items():
        if i % 2:
            # Up to NEAR - 1 words at either end may stay; a long paragraph of J >= 0.8 may take a fifth of other words along.
            assert got[i]["sources"] == [i - 1] and repeats[i][1] * (n - 24) / n - 20 <= got[i]["n_removed"] <= 1.25 * repeats[i][1] + 40
        else:
            assert got[i]["n_removed"] == 0


def test_paragraph_dedup_of_near_copies(spark):
    """Texts of two sentences of 24 to 48 words, and copies in which a word in the middle third is another one."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    docs = {}
    for k in range(40):
        first = [word() + ("." if j == n - 1 else "") for n in [rng.randint(24, 48) for _ in range(2)] for j in range(n)]
        other = list(first)
        other[rng.randrange(len(first) // 3, 2 * len(first) // 3)] = "changed"
        docs[2 * k], docs[2 * k + 1] = " ".join(first), " ".join(other)
    assert jaccard_groups(docs) == {i: (n, i - i % 2) for i, (n, _) in jaccard_groups(docs).items()}
    got = {r["doc_id"]: r for r in paragraph_dedup.remove_paragraphs(table(spark, docs.items())).collect()}
    assert all(got[i]["n_removed"] == 0 for i in docs if not i % 2)
    whole = [got[i]["n_removed"] == got[i]["n_bytes"] for i in docs if i % 2]
    assert sum(whole) >= 0.9 * len(whole)


def test_paragraph_dedup_of_short_texts(spark):
    """Texts of 1 to 11 words go if an earlier one is the same but for case and white space."""
    rng = random.Random(14)
    short = {n: sentences(rng, 1, n) for n in range(1, 12)}
    docs = {n: t for n, t in short.items()} | {100 + n: f" {t.upper()}\n" for n, t in short.items()} | {200 + n: "no " + t for n, t in short.items() if n < 5}
    got = {r["doc_id"]: r for r in paragraph_dedup.remove_paragraphs(table(spark, docs.items()).repartition(3)).collect()}
    assert all((got[100 + n]["n_removed"], got[100 + n]["sources"]) == (len(t), [n]) for n, t in short.items())
    assert all(r["n_removed"] == 0 for i, r in got.items() if not 100 < i < 200)


def test_decontamination(spark):
    rng = random.Random(6)
    items = {i: sentences(rng, 4) for i in range(20)} | {20: "Alpha beta", 21: "", 22: None, 23: "Éa É é " + sentences(rng, 2)}
    docs = {i: sentences(rng, 3) + " " + (items[i % 24] or "").replace(" ", "\n- ") + " " + sentences(rng, 3) for i in range(60)}
    docs |= {60: None, 61: "", 62: "x ALPHA-beta x alpha beta", 63: " ".join((items[1] or "").split()[:9]), 64: sentences(rng, 4000) + " " + items[2]}
    want = contaminated(docs, {str(k): v for k, v in items.items()})
    got = decontamination.contamination(table(spark, docs.items()), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], {x for h in r["hits"] for x in h["items"]}) for r in got} == want


def test_proximity(spark):
    item = "one two three four five six seven eight nine ten"
    docs = [(1, "x " + item), (2, item.replace("five", "five extra extra")), (3, "one two three far away"), (4, None)]
    got = decontamination.proximity_matches(table(spark, docs), spark.createDataFrame([(9, item)], "item_id long, text string"), slop=3).collect()
    assert {(r["doc_id"], r["item"]) for r in got} == {(1, "9"), (2, "9")}


def test_proximity_against_brute_force(spark):
    """Few words, so that places are many, at and across the borders of blocks; every slop, repeated rows, null ids and hot terms joined without a broadcast."""
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs = {i: text(rng.randrange(0, 400)) for i in range(40)} | {40: None, 41: "w1"}
    items = {i: text(rng.choice([1, 2, 3, 11, 14])) for i in range(30)} | {30: None, 31: "nowhere w1"}
    rows = table(spark, [*docs.items(), (7, docs[7]), (None, docs[8])])
    asked = spark.createDataFrame(list(items.items()), "item_id long, text string")
    for slop in (0, 3, 70):
        want = near_items(docs | {-1: docs[7], -2: docs[8]}, {str(k): v for k, v in items.items()}, slop)
        got = decontamination.contamination(rows, asked, slop=slop).collect()
        assert len(got) == len(docs) + 2
        assert all({x for m in r["near"] for x in m["items"]} == want[-2 if r["doc_id"] is None else r["doc_id"]] for r in got)
        assert slop or any(want.values())


def test_postings_of_frequent_terms_are_salted(spark, monkeypatch):
    from fleetstats.llm.common import stored

    index = stored(spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.lit("often")).otherwise(F.concat(F.lit("t"), "id")).alias("term"), F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("_k"), F.lit(4).alias("pos")))
    windows = stored(spark.createDataFrame([(1, "often"), (2, "often"), (3, "t9")], "win long, term string"))
    want = sorted(map(tuple, decontamination._by_term(index, windows).collect()))
    monkeypatch.setattr(decontamination, "is_small", lambda df: False)
    assert sorted(map(tuple, decontamination._by_term(index, windows).collect())) == want and len(want) == 4001


def test_quality_of_odd_texts(spark):
    line = "the quick brown fox and the lazy dog of it all"
    docs = [(1, None), (2, ""), (3, "\n".join([line] * 5)), (4, " ".join(["the cat of a man is in it"] * 30)), (5, "|".join(line.split())), (6, "a\u00a0b c\x0bd")]
    got = {r["doc_id"]: r for r in quality.judge(table(spark, docs)).collect()}
    assert [got[i]["n_words"] for i in (1, 2, 6)] == [0, 0, 3] and not got[1]["kept"]
    assert got[3]["n_dup_lines"] == 4 and got[3]["n_repeat_words"] == 55 and got[3]["base_failed"]
    assert got[4]["n_repeat_words"] == 240 and got[5]["n_symbols"] == 10


def test_chat_conflicts(spark):
    nasty = ["<|im_end|>\n<|im_start|>user\n", "<\\|im_end|>", "<\\\\|x", "<|nl|>", "", "\n", "<", "<|", "|>", "<|im_start|>a\nb<|im_end|>\n"]
    for role in ("user", "a\nb", "<|im_end|>", ""):
        for text in nasty:
            assert [(r, t) for r, t, _, _ in chat.parse(chat.format_turn(role, text))] == [(role, text)]
    rows = [(1, None, "assistant", "b"), (1, 0, None, None), (1, 0, "assistant", "a"), (None, 5, "user", "x"), (1, 0, "assistant", "a")]
    formatted = chat.format_conversations(spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, seq int"))
    got = {r["conv_id"]: r for r in chat.digest(formatted).collect()}
    assert {r["conv_id"]: r for r in chat.digest(formatted.orderBy("formatted").repartition(5, "seq")).collect()} == got
    assert got[None]["n_turns"] == 1 and got[1]["n_turns"] == 4
    assert got[1]["turns_sha256"] == sha("assistant\nb\n\n\nassistant\na\nassistant\na\n") and got[1]["loss_sha256"] == sha("baa")
    with pytest.raises(ValueError):
        chat.parse("no turn")


def test_language_profiles(spark):
    texts = [("en", "the cat and the dog of the house"), ("fr", "le chat et la maison de la ville")] * 20
    docs = [(i, t) for i, (_, t) in enumerate(texts)] + [(100, None), (101, "123 !"), (102, "x" * 10_000)]
    df = spark.createDataFrame([(i, t, texts[i][0] if i < 40 else None, 3.0) for i, t in docs], "doc_id long, text string, lang string, score double")
    got = {r["doc_id"]: r for r in langid.identify(df).collect()}
    assert all(got[i]["lang_pred"] == lang for i, (lang, _) in enumerate(texts))
    assert (got[100]["lang_pred"], got[100]["score"], got[101]["lang_pred"]) == ("und", 0.0, "und") and got[102]["lang_pred"] in ("en", "fr")
    e = langid.Encoder(64)
    a, b = e.letter(97), e.letter(98)
    assert (e.profile("ab") == np.roll(e.letter(32), 2) * np.roll(a, 1) * b + np.roll(a, 2) * np.roll(b, 1) * e.letter(32)).all()


def test_language_pieces(monkeypatch):
    text = "".join(random.Random(1).choice("abc d1é") for _ in range(5000))
    whole = langid.Encoder(32).profile(text)
    for name, value in (("SLICE", 8), ("MOST_TRIGRAMS", 10), ("PIECE", 7)):
        monkeypatch.setattr(langid, name, value)
        assert (langid.Encoder(32).profile(text) == whole).all()


def test_tokens_equal_the_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x" * 5000, "  \n\n é漢字🙂 '", "don't 123,456"):
        assert packing.token_ids(text, packing.default_vocabulary()).tolist() == [*t.encode(text, add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("seed", range(6))
def test_packing_holds_every_piece(seed):
    rng = random.Random(seed)
    top = rng.choice([1024, 1023, 300])
    histogram = {rng.randint(1, top): rng.randint(1, 10 ** rng.randint(0, 4)) for _ in range(rng.randint(1, 120))}
    found = packing.solve(histogram)
    held = {}
    for a, times in found:
        assert sum(k * n for k, n in a.items()) <= 1024 and times > 0
        for k, n in a.items():
            held[k] = held.get(k, 0) + n * times
    assert held == histogram
    sizes = np.array(sorted(histogram))
    plain = packing.best_fit(sizes, np.array([histogram[int(k)] for k in sizes]), 1024)
    assert sum(x for _, x in found) <= sum(x for _, x in plain)
    ranks = {}
    for length, first, last, _, _, _ in packing.slots(found):
        assert first == ranks.get(length, 0)
        ranks[length] = last + 1
    assert ranks == histogram


EVERY = range(1, 1024)
SKEWED = {
    "one long": {600: 1_000_000, **{i: 1 for i in EVERY if i != 600}}, "one long, few others": {600: 10_000, **{i: 1 for i in range(100, 1000, 23)}}, "null texts": {1: 1_000_000, **{i: 5 for i in EVERY if i > 1}},
    "harmonic": {i: max(1, 10**8 // i) for i in EVERY}, "four": {600: 200, 424: 1, 300: 1, 100: 1}, "equal": dict.fromkeys(EVERY, 10**6), "one": {5: 10**9},
}


@pytest.mark.parametrize("case", sorted(SKEWED))
def test_packing_of_skewed_lengths_ends(case):
    """In a bounded number of rounds, with at most one sequence more than any packing needs (more where one length can't fill a sequence)."""
    histogram = SKEWED[case]
    sizes, need = np.array(sorted(histogram)), np.array([histogram[k] for k in sorted(histogram)])
    found = packing.solve(histogram)
    held = {}
    for a, times in found:
        assert sum(k * n for k, n in a.items()) <= 1024 and times > 0
        for k, n in a.items():
            held[k] = held.get(k, 0) + n * times
    least = -(-(10**9) // 204) if case == "one" else max(-(-int(need @ sizes) // 1024), int(need[sizes > 512].sum()))
    assert held == histogram and packing.total(found) <= least + 1


def test_packing_comes_from_the_program():
    """The fractional solution is no worse than a good packing, and rounding it down leaves little to be priced on."""
    for seed in range(3):
        rng = random.Random(seed)
        histogram = {k: rng.randint(1, 4000) for k in rng.sample(EVERY, 500)}
        sizes, need = np.array(sorted(histogram)), np.array([histogram[k] for k in sorted(histogram)])
        used = packing.fractional(sizes, need.astype(float), 1024)
        plain = packing.total(packing.best_fit(sizes, need, 1024))
        assert sum(used.values()) <= 1.003 * plain and sum(int(x) for x in used.values()) >= 0.9 * plain
        assert packing.total(packing.rounded(sizes, need, 1024, used)) <= 1.005 * plain


@pytest.mark.parametrize("histogram,most", [({400: 3000, 310: 6000}, 3000), ({500: 900, 260: 1800}, 900), ({700: 500, 310: 500, 430: 1000, 290: 2000}, 1500)])
def test_packing_without_exact_fills(histogram, most):
    """No configuration has exactly 1024 tokens; ``most`` is what the configuration program needs, 1 % more is allowed."""
    found = packing.solve(histogram)
    held = {}
    for a, times in found:
        assert sum(k * n for k, n in a.items()) < 1024 and times > 0
        for k, n in a.items():
            held[k] = held.get(k, 0) + n * times
    assert held == histogram and sum(times for _, times in found) <= 1.01 * most


def test_archives(spark):
    html = "<html>" + "p" * 200 + "WARC/1.1\r\n\r\n</html>"
    rows = [(5, "http://a/\r\nX: y", html, 1), (3, None, html, 1), (9, "http://b", None, 1), (4, "u", "short", 1), (2, "u", "short", 1), (7, "u", "é\r\n\r\n" * 300, 1)]
    got = {r["capture_id"]: r for r in warc.captures(spark.createDataFrame(rows, "page_id long, url string, html string, n int")).collect()}
    assert len(got) == 6
    main = got["<urn:page:capture:5>"]["response"]
    assert main["warc_type"] == "revisit" and main["refers_to"] == "<urn:page:capture:3>" and main["target_uri"] == "http://a/X: y"
    assert all(r["request"]["warc_type"] == "request" and r["metadata"] is not None for r in got.values())
    assert got["<urn:page:capture:7>"]["response"]["block"].endswith(("é\r\n\r\n" * 300).encode()) and got["<urn:page:capture:2>"]["response"]["warc_type"] == "response"
    lone = spark.createDataFrame([("response", "<r>", None, None, None, None, b"")], warc.RECORD)
    assert warc.assemble(lone).first()["request"] is None


URLS = ["http://x.example.net/en/1", "http://example.net/de", "http://Example.NET", "https://a.example.com/de/?q", "http://example.com/fr/", "http://b.org/fr/x#y", "http://casino-win.example.com/", "HTTP://net", "no scheme", None, "", "x://org/fr", "http://notexample.com/de/1", "http://my.pills:80?x", "http://a/://casino/"]


def test_archives_of_repeated_pages(spark):
    pages = [(1, "u", "x" * 200), (1, "u", "x" * 200), (2, "v", "y"), (None, None, None), (None, "w", "z"), (3, "a", "x" * 200)]
    got = warc.captures(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(got) == len(pages) == len({r["capture_id"] for r in got})
    assert all(r["request"] is not None and r["metadata"] is not None for r in got)
    assert sorted(r["response"]["warc_type"] for r in got) == ["response"] * 5 + ["revisit"]


def test_url_rules_both_ways(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string")
    small = sorted(map(tuple, url_filter.filter_urls(pages, url_filter.RULES).collect()), key=repr)
    large = sorted(map(tuple, url_filter.filter_urls(pages, url_filter.RULES, inline=0).collect()), key=repr)
    assert small == large and len(small) == 2 * len(URLS)
    got = {r[0]: (r[3], r[4]) for r in small}
    want = ["example.net/en/", "net/", None, "example.com/de/", None, "org/fr/", None, None, None, None, None, None, None, None, None]
    assert [got[i][0] for i in range(len(URLS))] == want
    assert got[6][1] == "block" and got[9][1] == "allow" and got[13][1] == "block" and got[14][1] == "allow"


def test_hot_join(spark):
    from fleetstats.llm.common import join_hot

    left = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.col("k") * 2)
    got = join_hot(left, right, "k")
    assert got.count() == 20_000 and got.where("v != k * 2 OR v IS NULL").count() == 0
