"""One text of several megabytes, and tables whose columns are named like internal ones."""

import hashlib

import pytest

import corpus_pipeline
from foliospark.llm import byte_duplicates, decontaminate, licences, near_duplicates, personal_data, pieces, quality, secrets, warc, word_duplicates

SF = "/root/testdata/sf0.001"
N = 300_000
PLANTED = " write to jane@mail.example.org token=abcdef123 under the MIT license " + " ".join(f"item{k}" for k in range(12))


@pytest.fixture(scope="module")
def long():
    return " ".join(f"w{k}" for k in range(N)) + PLANTED


@pytest.fixture(scope="module")
def docs(spark, long):
    return spark.createDataFrame([(1, long), (2, "short text"), (3, long)], "doc_id long, text string")


def row(df):
    return df.where("doc_id = 1").first()


def test_narrow_operators(spark, docs, long):
    n = len(long.split())
    assert len(long) > 2_000_000
    assert row(quality.quality(docs)).n_words == n
    at = long.index("token=")
    assert f"assign:{at}:{at + 15}" in row(secrets.secrets(docs)).spans
    got = row(licences.licences(docs))
    assert (got.n_base, got.base_labels, got.n_words) == (1, "mit", n + 4)  # the mail address and the token fall into several words
    items = spark.createDataFrame([(7, " ".join(f"item{k}" for k in range(12)))], "item_id long, text string")
    assert row(decontaminate.contamination(docs, items)).n_hit == 12
    assert "item5" not in row(decontaminate.decontaminate(docs, items)).text
    assert row(pieces.encode(docs)).round_trip


def test_personal_data(docs, long):
    at = long.index("jane@")
    assert row(personal_data.personal_data(docs)).spans.startswith(f"email:{at}:{at + 21}")
    assert row(personal_data.redact(docs)).text == long.replace("jane@mail.example.org", "<EMAIL>")


def test_dedup(docs, long):
    got = {r.doc_id: r for r in byte_duplicates.repeated_bytes(docs).collect()}
    assert (got[1].n_removed, got[3].n_removed, got[3].n_spans) == (0, len(long), 1) and got[1].kept_sha256 == hashlib.sha256(long.encode()).hexdigest()
    assert {r.doc_id: r.n_removed for r in word_duplicates.repeated_words(docs).collect()} == {1: len(long.split()), 2: 0, 3: len(long.split())}
    assert {r.doc_id: r.component_id for r in near_duplicates.duplicate_classes(docs).collect()} == {1: 1, 2: 2, 3: 1}


def test_archives(spark, long):
    pages = spark.createDataFrame([(1, "http://a.org/", long), (2, "http://a.org/", long + "\r\n\r\nWARC/1.1\r\n"), (3, "http://b.org/", long)], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.capture_histories(pages).collect()}
    assert all(r.intact for r in got.values()) and got[1].refers_to == 3 and got[2].payload_bytes == len(long) + 14


def test_stages_with_clashing_columns(spark):
    """Two texts under one id both stay, a null id does not save a near copy, and no column name is reserved."""
    text = " ".join(f"v{k}" for k in range(120))
    other = " ".join(f"u{k}" for k in range(120))
    names = "n_chars long, found string, new string, known string, key string, text_key string, same string, id string, of string, component string, __m string, __id string, __row string, __spans string"
    rows = [(1, text), (1, other), (None, text + " end"), (None, "t " * 3 + " ".join(f"x{k}" for k in range(90))), (5, other), (5, other), (None, None)]
    extra = ["x"] * (names.count(",") + 1)
    docs = spark.createDataFrame([(i, t, None, *extra[1:]) for i, t in rows], f"doc_id long, text string, {names}")
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), (r.text or "")[:4]) for r in kept.collect()) == [("1", "u0 u"), ("1", "v0 v"), ("None", ""), ("None", "t t ")]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert all(r.__getitem__("__row") == "x" and r["known"] == "x" for r in docs.collect())
