import json

import numpy as np

from foliospark.operators import analysis, embedding, schema

CANDIDATE = "batch_id string, collection string, idx int, local_id string, confidence string, text string, refs array<struct<chunk_id:string,quote:string>>"


def test_analysis_rules(spark):
    title = [("c1", "Product Model")]
    rows = [("b1", "claims", k, f"x{k}", "0.9", f"statement number {k} about shipping costs", title) for k in range(12)]
    rows += [
        ("b2", "relations", 0, "r", None, "Alpha uses Beta", [("c2", "“Alpha” **uses** Beta daily")]),
        ("b2", "entities", 0, "e", "91%", "Alpha", [("c2", "Alpha")]),
        ("b3", "entities", 0, "e", "1", "Gamma", []),
        ("b3", "entities", 1, "e", "0.5", "Gamma", [("zz", "Gamma")]),
        ("b3", "reviewItems", 0, None, None, " ", [("c3", "not there")]),
    ]
    chunks = spark.createDataFrame([("b1", "c1", "Product Model"), ("b2", "c2", 'Here "Alpha" uses Beta daily. Alpha'), ("b3", "c3", "text")], "batch_id string, chunk_id string, text string")
    got = {(r.batch_id, r.code, r.path) for r in analysis.validate(spark.createDataFrame(rows, CANDIDATE), chunks).collect()}
    assert {("b1", "UNSUPPORTED", f"claims[{k}]") for k in range(12)} | {("b1", "REUSED_SOURCE", "c1")} == {g for g in got if g[0] == "b1"}
    assert {g for g in got if g[0] == "b2"} == {("b2", "CONFIDENCE", "entities[0]")}
    assert {g for g in got if g[0] == "b3"} == {
        ("b3", "NO_SOURCE", "entities[0]"),
        ("b3", "UNKNOWN_CHUNK", "entities[1]"),
        ("b3", "EMPTY_CONTENT", "reviewItems[0]"),
        ("b3", "QUOTE_NOT_FOUND", "reviewItems[0]"),
        ("b3", "DUPLICATE_ID", "e"),
    }


def test_schema(spark):
    files = {
        "all_domains.json": {"domains": [{"key": "sales", "name": "Sales"}]},
        "sales/sales_domain.json": {"domain": {"key": "sales"}, "abes": [{"key": "orders", "file": "orders.json"}]},
        "sales/orders.json": {"abe": {"key": "orders"}, "entities": [{"key": "order", "name": "Order"}, {"key": "line_item", "name": "Line Item"}]},
        "stock/items.json": {"entities": []},
    }
    df = spark.createDataFrame([(p, json.dumps(c)) for p, c in files.items()], "relative_path string, raw string")
    assert {(r.relative_path, r.error) for r in schema.problems(df).collect()} == {("stock/stock_domain.json", "domain file is missing")}
    assert json.loads(schema.disclose(df, "abe", "sales", "orders.json").first().raw)["abe"]["key"] == "orders"
    assert schema.snapshot(df).first().snapshot_hash == schema.snapshot(df.repartition(3)).first().snapshot_hash
    asked = spark.createDataFrame([(1, "SALES", "line-item"), (2, "sales", "#/entities/0"), (3, "sales", "nothing"), (4, "sales", "orders")], "id int, domain string, be string")
    got = {r.id: (r.status, r.pointer) for r in schema.resolve(asked, schema.flatten(df)).collect()}
    assert got == {1: ("classified", "/entities/1"), 2: ("classified", "/entities/0"), 3: ("unresolved", None), 4: ("unresolved", None)}


def test_embedding(spark):
    texts = spark.createDataFrame([(1, "a car"), (2, "an automobile"), (3, "fail"), (4, "a car")], "id int, text string").coalesce(1)

    def provider(batch):
        if "fail" in batch:
            raise RuntimeError("down")
        return [[3.0, 4.0]] * len(batch)

    got = {r.id: r for r in embedding.embed(texts, "text", provider, batch=1).collect()}
    assert got[1].vector == [0.6, 0.8] and not got[1].degraded
    assert got[3].degraded and "down" in got[3].reason and abs(np.linalg.norm(got[3].vector) - 1) < 1e-9
    cache = spark.createDataFrame([], "content_hash string, vector array<double>")
    every, fresh = embedding.embed_cached(texts.where("id <> 3"), "text", cache, provider)
    assert every.count() == 3 and fresh.count() == 2
    every, fresh = embedding.embed_cached(texts.where("id <> 3"), "text", fresh, provider)
    assert every.count() == 3 and fresh.count() == 0
