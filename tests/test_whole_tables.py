"""Queries over whole tables, against brute force."""

import duckdb
import pytest

from foliospark.functions import text as T
from foliospark.operators import numbering
from foliospark.operators import retrieval as operators
from foliospark.plans import knowledge, retrieval
from foliospark.session import table

from . import compare

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def part(spark):
    return table(spark, SF, "part").collect()


def letters(n):
    out = ""
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def test_shard_manifest_all(spark, part):
    keys = [r.p_partkey for r in sorted(part, key=lambda r: (r.p_name, r.p_partkey))]
    got = {r.p_partkey: r.shard for r in knowledge.shard_manifest(spark, SF).collect()}
    assert got == {k: f"shard-{i // 6 + 1:04d}" for i, k in enumerate(keys)}


def test_shard_of_five_digits(spark, tmp_path):
    spark.range(60_001).selectExpr("'x' AS p_name", "id AS p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.p_partkey: r.shard for r in knowledge.shard_manifest(spark, str(tmp_path)).collect()}
    assert len(got) == 60_001 and got[60_000] == "shard-10001" and got[59_999] == "shard-10000" and got[59_993] == "shard-9999"


def test_eviction_all(spark, part):
    held, want = 0, {}
    for r in sorted(part, key=lambda r: (r.p_size, r.p_partkey)):
        held += 0 if r.p_size > 45 else int(r.p_retailprice + 0.5)
        want[r.p_partkey] = r.p_size > 45 or held > 20000
    assert {r.p_partkey: r.evicted for r in knowledge.eviction_lru_budget(spark, SF).collect()} == want


def test_column_names_all(spark, part):
    got = {r.p_partkey: r.col for r in knowledge.column_names(spark, SF).collect()}
    assert got == {r.p_partkey: letters(r.p_partkey) for r in part}
    numbers = [1, 26, 27, 702, 703, 18_278, 18_279, 475_254, 475_255, 2**31, 10**15]
    df = spark.createDataFrame([(n,) for n in numbers], "n long")
    assert [r.c for r in df.select(T.column_name(df.n).alias("c")).collect()] == [letters(n) for n in numbers]


def test_chunk_totals_all(spark, tmp_path):
    texts = ["one line", "\n\n".join(["a" * 1000] * 5), "b" * 1000 + "\n \n" + "c" * 10, "d" * 9000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.n_chars for r in knowledge.chunk_totals(spark, str(tmp_path)).collect()}
    # Of five paragraphs two with the blank line between them fill a chunk.
    assert got == {0: 8, 1: 2002 + 2002 + 1000, 2: 1013, 3: 9000}


def test_page_budget_beyond_500(spark, tmp_path):
    spark.createDataFrame([(i, 20) for i in range(3000)], "doc_id long, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.k) for r in knowledge.page_budget(spark, str(tmp_path)).collect())
    assert got == [(i, i + 1) for i in range(1000)]


def test_running(spark):
    rows = [(None, 5), (None, None), *((i * 7 % 1009, i % 13) for i in range(1009))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, a long, v long")
    got = sorted(numbering.running(df, ["a", "id"], sums={"s": df.v}).collect(), key=lambda r: r.k)
    want, s = [], 0
    for i, (a, v) in sorted(enumerate(rows), key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0])):
        s += v or 0
        want.append((i, s))
    assert [(r.id, r.s) for r in got] == want and [r.k for r in got] == list(range(1, len(rows) + 1))
    assert numbering.running(df.limit(0), ["a"]).count() == 0


@pytest.mark.parametrize("bound", [10_000, 0])
def test_short_quotes(spark, tmp_path, monkeypatch, bound):
    monkeypatch.setattr(knowledge, "_SHORT_QUOTES", bound, raising=False)
    quotes = ["one", "ne tw", "one two three four five six", "wo three four five si", "two three four five six seven eight", "wo three four five six seven eig", "absent", "", None]
    texts = ["zero one two three four five sixth", "one  two\nthree four five six seven eight", "one", "nothing", None]
    spark.createDataFrame(list(enumerate(quotes)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.item_id, r.doc_id) for r in knowledge.quote_in_chunk(spark, str(tmp_path)).collect())
    flat = [" ".join(t.split()) if t is not None else None for t in texts]
    assert got == [(i, d) for i, q in enumerate(quotes) for d, t in enumerate(flat) if q is not None and t is not None and q in t]


def _odd_tables(spark, path):
    words = [f"w{k}" for k in range(40)]
    texts = [(i % 90 if i % 7 else i, " ".join(words[(i * k) % 40] for k in range(i % 23))) for i in range(120)]  # some ids stand twice
    docs = [*texts, (500, None), (501, ""), (None, "w1 w2 w3"), (502, "w1 w2 w3"), (503, "the x W1 w1")]
    items = [(i, " ".join(words[(i * 3 + k) % 40] for k in range(i % 9))) for i in range(30)] + [(4, "w1 w9 w1"), (100, None), (101, "the of"), (102, "w1 w2 w3")]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").repartition(2).write.parquet(f"{path}/benchmark.parquet")


@pytest.mark.parametrize(("terms", "pairs"), [(100_000, 4_000_000), (10, 40), (1, 1)])
def test_benchmark_queries_in_blocks_and_packs(spark, tmp_path, monkeypatch, terms, pairs):
    """Repeated and missing ids and texts, ties, several blocks of queries and packs of texts."""
    monkeypatch.setattr(operators, "BLOCK_TERMS", terms)
    monkeypatch.setattr(operators, "PACK_PAIRS", pairs)
    _odd_tables(spark, tmp_path)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    assert compare.differences(spark, con, str(tmp_path), retrieval.benchmark_queries, retrieval.SQL["benchmark_queries"]) == ""


def test_benchmark_queries_send_only_the_best(spark):
    """A task kept and sent a row for every pair of item and text that share a word; now it sends 5 an item at most."""
    made = retrieval.benchmark_queries(spark, SF)
    sent = [p for p in made._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in p or "Join" in p]
    items, tasks = table(spark, SF, "benchmark").count(), table(spark, SF, "documents").rdd.getNumPartitions()
    files = {f for f in made.inputFiles() if "most-shared" in f}
    assert not sent and 0 < spark.read.parquet(*files).count() <= 5 * items * tasks
