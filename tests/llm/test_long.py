"""Very long texts, repeated rows and ties, for operators whose other edges are tested elsewhere."""

import random

import numpy as np
from pyspark.sql import functions as F

from fleetstats.llm import chat, langid, paragraph_dedup, quality, url_filter, warc

from .helpers import sha
from .test_edges import sentences, table


def test_quality_of_long_texts_and_repeated_rows(spark):
    words = 200_000
    text = "\n".join(f"line {i} # of many" for i in range(words // 5))
    got = [r.asDict() for r in quality.judge(table(spark, [(1, text), (2, "a b"), (2, "a b"), (2, "a c")])).collect()]
    assert len(got) == 4 and sorted(r["n_words"] for r in got) == [2, 2, 2, words]
    long = next(r for r in got if r["doc_id"] == 1)
    assert (long["n_symbols"], long["n_dup_lines"], long["n_repeat_words"]) == (words // 5, 0, 0) and long["word_chars"] == len("".join(text.split()))


def test_chat_of_long_texts(spark):
    text = "<|im_end|> é" * 300_000
    rows = [(1, 0, "user", text), (1, 1, "assistant", text + "x")]
    got = chat.digest(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert got["turns_sha256"] == sha(f"user\n{text}\nassistant\n{text}x\n") and got["loss_sha256"] == sha(text + "x") and got["loss_chars"] == len(text) + 1


def test_archives_of_long_payloads(spark, tmp_path):
    """Payloads that lie in many pieces, more of them than a file takes, beside short ones."""
    rng = random.Random(2)
    word = ["".join(rng.choice("abcdefgh\r\n") for _ in range(40)) for _ in range(500)]
    rows = [(i, f"http://a/{i}", f"<p>{i}" + "".join(rng.choices(word, k=100_000 if i < 4 else 5_000)), 1) for i in range(12)] + [(20 + i, "u", "short" * 30, 1) for i in range(3)] + [(30, "http://a/0", None, 1)]
    rows.append((40, "http://copy", rows[0][2], 1))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n int")
    warc.write_archives(warc.plan(pages), str(tmp_path / "w"), 5)
    got = {r["record_id"]: r for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    assert len(got) == 3 * len(rows)
    for i, _, html, _ in rows:
        r = got[f"<urn:page:capture:{i}>"]
        assert r["payload_digest"] == f"sha256:{sha(html or '')}"
        assert r["block"].endswith((html or "").encode()) if r["warc_type"] == "response" else i in (21, 22, 40) and r["refers_to"] == f"<urn:page:capture:{0 if i == 40 else 20}>"


def test_small_pieces_give_the_same_records(spark, tmp_path, monkeypatch):
    import gzip

    import pyarrow as pa

    rows = [(i, "u", "x\r\n\r\n" * i, 1) for i in range(40)]
    warc.write_archives(warc.plan(spark.createDataFrame(rows, "page_id long, url string, html string, n int")), str(tmp_path))
    files = [pa.py_buffer(p.read_bytes()) for p in sorted(tmp_path.glob("*.gz"))]
    whole = [r for f in files for r in warc._records(f)]
    monkeypatch.setattr(warc, "PIECE", 7)
    assert [r for f in files for r in warc._records(f)] == whole and len(whole) == 120
    broken = pa.py_buffer(gzip.compress(gzip.decompress(files[0].to_pybytes())[:-9]))
    try:
        list(warc._records(broken))
        raise AssertionError("a record without its end was taken")
    except ValueError:
        pass


def test_long_urls(spark):
    rules = [url_filter.host_rule("block", "net"), url_filter.host_rule("allow", "example.net", "/en/")]
    rows = [(1, "http://a.net/" + "p/" * 100_000, 1), (2, "https://x.example.net/en/" + "q" * 300_000 + "?net", 1), (3, "x" * 200_000, 1), (1, "http://b.org/", 1)]
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, rule int"), rules).collect()
    assert len(got) == 4 and {(r["page_id"], r["rule"]) for r in got} >= {(1, "net/"), (2, "example.net/en/")}
    assert {r["verdict"] for r in got if r["rule"] == "net/"} == {"block"}


def test_equal_languages_by_name(spark):
    docs = spark.createDataFrame([(i, "same words here", lang) for i, lang in enumerate(["zz", "aa", "mm"] * 4)], "doc_id long, text string, lang string")
    found = langid.identify(docs, docs.withColumn("doc_id", F.lit(0).cast("long")))
    assert {r["lang_pred"] for r in found.collect()} == {"aa"}


def test_paragraphs_of_repeated_rows(spark):
    """Rows that repeat id and text are one document: as it isn't repeated elsewhere, nothing goes."""
    rng = random.Random(7)
    text, other = sentences(rng, 30), sentences(rng, 30)
    got = paragraph_dedup.remove_paragraphs(table(spark, [(1, text), (1, text), (2, other), (3, text)])).collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(r["n_removed"])
    assert by_id[2] == [0] and min(by_id[3]) > 0.9 * len(text) and np.all(np.array(by_id[1]) == by_id[1][0]) and by_id[1][0] == 0
