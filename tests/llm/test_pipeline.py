"""The pipeline end to end, each stage against what its operator says about its own input."""

import re

import corpus_pipeline
from foliospark.llm import decontaminate, near_duplicates, quality
from foliospark.llm.runtime import stored, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    made = {}
    for name, stage in corpus_pipeline.STAGES:
        made[name] = docs, (docs := stored(stage(spark, docs, SF), "test"))
    before, after = made["quality rules"]
    assert after.columns == columns
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in quality.quality(before).where("kept").collect()}
    before, after = made["minhash near-dedup"]
    assert after.columns == columns
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in near_duplicates.duplicate_classes(before).where("kept").collect())
    before, after = made["benchmark decontamination"]
    assert after.columns == columns
    assert decontaminate.contamination(after, table(spark, SF, "benchmark")).where("contaminated").count() == 0
    clean = {r.doc_id: r.text for r in before.collect()}
    hit = {r.doc_id for r in decontaminate.contamination(before, table(spark, SF, "benchmark")).where("contaminated").collect()}
    assert all(clean[r.doc_id] == r.text for r in after.collect() if r.doc_id not in hit) and {*clean} - {r.doc_id for r in after.collect()} <= hit
    before, after = made["pii"]
    assert after.columns == columns and after.count() == before.count()
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    assert not any(email.search(r.text) for r in after.collect()) and all(r.n_chars == len(r.text) for r in after.collect())
    before, after = made["sentencepiece"]
    assert after.where("round_trip").count() == before.count()


def test_repeated_and_null_rows(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text, "en", "s", 0), (1, text, "en", "s", 0), (2, text + " x", "en", "s", 0), (None, text + " y z", None, None, None), (None, None, None, None, None), (None, " ".join(f"q{i}" for i in range(60)), None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicate_stage(spark, docs.where("text IS NOT NULL"), SF).collect()
    assert sorted(str(r.doc_id) for r in kept).count("1") == 1 and 2 not in {r.doc_id for r in kept}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), "test")
    assert docs.count() >= 2
    none = table(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, SF)
    assert none.count() == 0


def test_decontaminate_by_shards(spark):
    words = [f"w{i}" for i in range(400)]
    text = lambda a, b: " ".join(words[a:b])
    other = " ".join(f"o{i}" for i in range(40))
    items = [(0, text(0, 12)), (1, text(12, 24)), (2, text(24, 36)), (3, text(100, 112)), (4, text(106, 118)), (5, text(200, 202)), *((10 + k, text(210 + 10 * k, 221 + 10 * k)) for k in range(12))]
    rows = [
        (1, text(0, 36) + " " + " ".join(f"p{i}" for i in range(12))),  # three items, 75% in all
        (2, other + " " + text(100, 118) + " " + other),  # windows of two items overlap
        (3, " ".join(f"p{i}" for i in range(300)) + " " + text(210, 331)),  # adjacent hits make one span
        (4, other + " " + text(200, 202) + " " + other),
        (5, other),
        (None, None),
    ]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long")
    items = spark.createDataFrame(items, "item_id long, text string")
    # As expected, worked out by hand: 1 and 3 go, and nothing of an item stays.
    expected = {(2, f"{other}  {other}"), (4, f"{other}  {other}"), (5, other), (None, None)}
    for shard_words in (5, 30, 200_000):
        made = decontaminate.decontaminate(docs, items, max_span=100, shard_words=shard_words).collect()
        assert {(r.doc_id, r.text) for r in made} == expected and all(r.n_chars == len(r.text or "") for r in made), shard_words
