"""The stages of the corpus pipeline, each and together, against brute force."""

import random

import corpus_pipeline
import pytest

from .helpers import contaminated, jaccard_groups, without_repeats
from .test_edges import sentences

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, docs, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t in docs.items()], DOC)


def test_language_stage_keeps_short_texts(spark):
    """Only texts without letters go, whatever the cosine."""
    rng = random.Random(21)
    docs = {i: sentences(rng, 12) for i in range(60)}
    short = {100 + i: t for i, t in enumerate(["A.", "Avec.", "Qu", "Zyx.", "Vwz vuq.", "Wyvern"] * 4)}
    bare = {200: None, 201: "", 202: "12 3.", 203: "!? - 7"}
    got = corpus_pipeline.language(spark, documents(spark, docs | short | bare), "").collect()
    assert {r["doc_id"]: r["text"] for r in got} == docs | short


def test_language_stage_without_labels(spark):
    docs = {1: "Some words.", 2: "12", 3: None, 4: "élan"}
    got = corpus_pipeline.language(spark, documents(spark, docs, None), "").collect()
    assert {r["doc_id"] for r in got} == {1, 4}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder of documents and benchmark items, with what is planted; documents has columns whose names stages use too."""
    rng = random.Random(31)
    items = {i: sentences(rng, 3) for i in range(6)}
    passage = sentences(rng, 8)
    docs = {i: sentences(rng, 25) for i in range(30)}
    near = docs[3].split()
    near[40] = "other"
    docs |= {40: docs[1], 41: " ".join(near), 42: docs[2] + " " + sentences(rng, 1, 4)}
    docs |= {50 + k: sentences(rng, 9) + " " + passage + " " + sentences(rng, 9) for k in range(4)}
    docs |= {60 + k: sentences(rng, 6) + " " + items[k] + " " + sentences(rng, 6) for k in range(3)}
    docs |= {70: None, 71: "", 72: "12 - 3", 73: "Two words", 74: "Two words", 75: sentences(rng, 3000), 76: "Éa ß " + sentences(rng, 10)}
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows = documents(spark, docs).selectExpr("*", "1 AS kept", "'x' AS node", "2 AS component_id", "3 AS piece", "'y' AS lang_pred", "4 AS n_bytes")
    rows.repartition(5).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, items


def test_stages_and_the_whole_by_brute_force(spark, corpus):
    folder, docs, items = corpus
    stages = dict(corpus_pipeline.STAGES)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "suffix-array dedup", "benchmark decontamination", "best-fit packing"]

    def step(name, rows):
        out = corpus_pipeline.stored(stages[name](spark, rows, folder))
        assert tuple(out.columns) == corpus_pipeline.COLUMNS
        return out, {r["doc_id"]: r["text"] for r in out.collect()}

    rows, got = step("language ID", spark.read.parquet(f"{folder}/documents.parquet"))
    want = {i: t for i, t in docs.items() if any(c.isalpha() for c in t or "")}
    assert got == want
    rows, got = step("n-gram Jaccard join", rows)
    groups = jaccard_groups(want)
    want = {i: t for i, t in want.items() if groups[i][1] == i}
    assert got == want and not {40, 41, 42, 74} & set(want)
    rows, got = step("suffix-array dedup", rows)
    cut = without_repeats(want)
    want = {i: k.decode(errors="ignore") for i, (n, removed, _, k) in cut.items() if removed < n}
    assert got == want and all(cut[50 + k][1] > 0 for k in range(1, 4))
    assert all(r["n_chars"] == len(r["text"]) for r in rows.collect())
    rows, got = step("benchmark decontamination", rows)
    hits = contaminated(want, {str(k): t for k, t in items.items()})
    want = {i: t for i, t in want.items() if not hits[i][1]}
    assert got == want and not {60, 61, 62} & set(want)

    import public_tokenizers
    from tokenizers import Tokenizer

    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = {i: len(tokens.encode(t, add_special_tokens=False).ids) + 1 for i, t in want.items()}
    for packed in (stages["best-fit packing"](spark, rows, folder).collect(), corpus_pipeline.run(spark, folder).collect()):
        found, sequences = {}, {}
        for r in packed:
            found[r["doc_id"]] = found.get(r["doc_id"], 0) + r["length"]
            sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert found == sizes
        for own in sequences.values():
            assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 1024


def test_empty_table_and_repeated_rows(spark, corpus, tmp_path):
    folder, docs, _ = corpus
    for name, rows in (("none", documents(spark, {0: "x"}).where("false")), ("twice", documents(spark, {1: docs[1], 2: docs[2]}).unionByName(documents(spark, {1: docs[1]})))):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    got = corpus_pipeline.run(spark, f"{tmp_path}/twice").collect()
    assert sorted(r["doc_id"] for r in got if r["piece"] == 0) == [1, 1, 2]
