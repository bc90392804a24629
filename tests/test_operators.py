"""Operators on tiny tables with known results."""

import math
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loamspark.functions import providers, scoring, vectors
from loamspark.functions import text as tx
from loamspark.operators import extract, graph, knowledge, retrieval, timeline
from loamspark.sources import stores
from loamspark.streaming import gates


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_fusion_orders_by_summed_ranks(spark):
    a = spark.createDataFrame([(1, i, r) for r, i in enumerate("abc", 1)], "query_id long, id string, rank int")
    b = spark.createDataFrame([(1, i, r) for r, i in enumerate("bcd", 1)], "query_id long, id string, rank int")
    rows = retrieval.reciprocal_rank_fusion([a, b]).orderBy("rank").collect()
    assert [r["id"] for r in rows] == ["b", "c", "a", "d"]
    assert rows[0]["rrf"] == pytest.approx(1 / 61 + 1 / 62, abs=1e-8)


def test_budget_packing_skips_what_does_not_fit(spark):
    items = spark.createDataFrame([(1, 1, 3), (1, 2, 2), (1, 3, 1)], "g long, o long, c long")
    row = timeline.budget_pack(items, "g", "o", "c", 4).first()
    assert row["kept"] == [1, 3] and row["left"] == 0


def test_turns_count_a_leading_group(spark):
    rows = [("s", i, t) for i, t in enumerate(["system", "user", "agent", "user"])]
    df = spark.createDataFrame(rows, "session_id string, seq int, type string")
    assert [r["turn"] for r in timeline.number_turns(df).orderBy("seq").collect()] == [0, 1, 1, 2]
    assert timeline.last_turns(df, 1).count() == 3


def test_pagerank_falls_along_a_chain(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("x",)], "node string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    reset = spark.createDataFrame([("a", 1.0)], "node string, p double")
    rank = {r["node"]: r["rank"] for r in graph.personalized_pagerank(nodes, edges, reset, damping=0.5).collect()}
    assert rank["a"] > rank["b"] > rank["c"] > 0 and rank["x"] == 0
    assert sum(rank.values()) == pytest.approx(1, abs=1e-6)


def test_label_propagation_splits_components(spark):
    edges = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "x", "y")], "scope int, src string, dst string")
    label = {r["node"]: r["label"] for r in graph.label_propagation(edges).collect()}
    assert label["a"] == label["b"] == label["c"] != label["x"] == label["y"]


def test_paths_end_at_depth_or_dead_end(spark):
    edges = spark.createDataFrame([("a", "b", "t"), ("b", "c", "t"), ("c", "d", "t")], "src string, dst string, type string")
    assert sorted(map(tuple, (r["path"] for r in graph.simple_paths(edges, 3).collect()))) == [("a", "b", "c"), ("b", "c", "d"), ("c", "d")]


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, vectors.norm(a)) == 5
    assert one(spark, vectors.cosine(a, a)) == pytest.approx(1)
    assert one(spark, vectors.cosine(a, b)) == 0
    assert one(spark, vectors.euclidean(a, F.array(F.lit(1.0)))) == math.inf
    assert one(spark, vectors.normalized(b)) == [0.0, 0.0]
    unit = one(spark, providers.hashed_embedding(F.array(F.lit("x"), F.lit("y")), 8))
    assert sum(x * x for x in unit) == pytest.approx(1)


def test_text_functions(spark):
    assert one(spark, tx.references(F.lit("a [ref:x,y] b [ref:y]"))) == ["x", "y"]
    assert one(spark, tx.strip_references(F.lit("a [ref:x] ."))) == "a."
    assert one(spark, tx.parse_confidence(F.lit("80%"))) == 0.8 and one(spark, tx.parse_confidence(F.lit("80"))) == 0.8
    assert one(spark, tx.clean_extraction(F.lit("that he left"))) == "He left."
    assert one(spark, tx.ambiguity(F.lit("What did they say about it yesterday"))) == "pronoun"
    assert one(spark, tx.knowledge_type(F.lit("You must always verify that it works")))["type"] == "rule"
    assert one(spark, tx.keyword_match(tx.tokens(F.lit("red fox")), tx.tokens(F.lit("the Fox")))) == 0.5
    assert one(spark, scoring.effectiveness_boost(F.lit(0), F.lit(9))) == pytest.approx(-0.18)


def test_extraction(spark):
    df = spark.createDataFrame([(1, "I love tea. My name is Ann, and I live in Rome.")], "id long, text string")
    assert {r["content"] for r in extract.apply_rules(df).collect()} == {"User loves tea", "User's name is Ann", "User lives in Rome"}
    text = "One two. " * 300 + "x" * 700
    chunks = extract.chunk(spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string"), 500).orderBy("start").collect()
    assert "".join(c["text"] for c in chunks) == text and max(len(c["text"]) for c in chunks) <= 500
    rows = spark.createDataFrame([(1, "the quick brown fox", "Quick brown"), (2, "the quick brown fox", "quick red fox"), (3, "abc", "zzz yyy")], "id long, text string, extraction string")
    assert {r["id"]: r["status"] for r in extract.align(rows).collect()} == {1: "exact", 2: "none", 3: "none"}
    assert one(spark, extract.ace_line(F.lit("[a-1] helpful=2 harmful=0 :: do it")))["helpful"] == 2
    assert one(spark, extract.grade(F.lit("about 1,000.0005"), F.lit("1000"), "numeric"))
    assert one(spark, extract.grade(F.lit("The answer is (B)"), F.lit("b"), "choice"))
    row = spark.createDataFrame([('say ```json\n{"a": [1]}``` ok',)], "t string").select(extract.json_from_text(F.col("t")).alias("v")).first()
    assert row["v"] == '{"a": [1]}'


def test_layers_and_stores(spark, tmp_path):
    base = spark.createDataFrame([(1, 2, "a"), (2, 1, "b")], "k long, v long, s string")
    changes = spark.createDataFrame([(1, 1, "old"), (2, 1, "new"), (3, 1, "c")], "k long, v long, s string")
    merged, rejected = knowledge.guarded_merge(base, changes, ["k"], "v")
    assert {r["k"]: r["s"] for r in merged.collect()} == {1: "a", 2: "new", 3: "c"} and [r["k"] for r in rejected.collect()] == [1]
    table = stores.Table(spark, str(tmp_path), "k long, v long, s string", ["k"], "v")
    table.upsert(base)
    assert table.save(changes).count() == 1
    table.delete(spark.createDataFrame([(3,)], "k long"))
    assert sorted(r["k"] for r in table.read().collect()) == [1, 2]
    again = stores.Table(spark, str(tmp_path), "k long, v long, s string", ["k"], "v")
    assert again.generation == 3 and sorted(r["k"] for r in again.read().collect()) == [1, 2]
    again.delete(spark.createDataFrame([(1,)], "k long"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        table.delete(spark.createDataFrame([(2,)], "k long"))
    assert [r["k"] for r in stores.Table(spark, str(tmp_path), "k long, v long, s string", ["k"], "v").read().collect()] == [2]
    assert table.read().where(stores.compile_filters([("k", "gte", 2), ("s", "in", ["new"])])).count() == 1
    (tmp_path / "x.md").write_text("---\nname: a-b\n---\nbody")
    row = stores.read_frontmatter(spark, str(tmp_path / "x.md")).first()
    assert row["fields"] == {"name": "a-b"} and row["body"] == "body"
    code = spark.createDataFrame([(1, "python", "class A:\n    def f(self): pass")], "id long, language string, text string")
    assert {(r["kind"], r["name"]) for r in stores.code_symbols(code).collect()} == {("class", "A"), ("function", "f")}


def test_limiters():
    rows = pd.DataFrame({"t": [0.0, 0.0, 0.0, 10.0]})
    assert gates.token_bucket((), rows, 0.1, 2)[1] == [True, True, False, True]
    assert gates.sliding_log((), rows, 2, 5.0)[1] == [True, True, False, True]
    assert gates.fixed_window((), rows, 1, 5.0)[1] == [True, False, False, True]


def test_stream_equals_batch(spark, tmp_path):
    """The limiter gives the same decisions as a stream of two files as over the whole table."""
    rows = [(k, i, float(i // 3)) for i in range(40) for k in (1, 2)]
    df = spark.createDataFrame(rows, "key long, id long, t double")
    df.where("id < 20").coalesce(1).write.parquet(str(tmp_path / "in"))
    df.where("id >= 20").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    want = {(r["key"], r["id"]): r["allowed"] for r in gates.rate_limit(df, "token_bucket", rate=0.5, capacity=2).collect()}
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run = gates.rate_limit(source, "token_bucket", stream=True, rate=0.5, capacity=2).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {(r["key"], r["id"]): r["allowed"] for r in spark.table("limited").collect()} == want


def test_all_patterns_of_personal_data(spark):
    texts = ["call (988) 555-2485 now", "me+1 555-123-4567 ok", "4111 1111 1111 1111", "2001:db8:0:0:0:0:0:1", "DOB: 1/2/90", "a@b.co 555-123-4567 1/2/1990 10.0.0.1"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = df.select("text", extract.pii_redact("text").alias("out"), *extract.pii_counts("text")).collect()
    got = {r["text"]: r for r in rows}
    assert [got[t][k] for t, k in zip(texts, ["phone", "phone", "card", "ip", "date_of_birth"], strict=False)] == [1] * 5
    assert [got[t]["out"] for t in texts] == ["call [PHONE] now", "me[PHONE] ok", "[CARD]", "[IP]", "[DATE_OF_BIRTH]", "[EMAIL] [PHONE] [DATE_OF_BIRTH] [IP]"]


def test_all_rules(spark):
    text = "My favorite color is blue. I'm 40 years old. I speak French. I went to Rome last May. Last week I swam. I just ate. I used to smoke. I want to run. I'm interested in art. I'm learning Go. I'm trying to rest. I know Ada. I'm good at chess. I can cook."
    got = {r["content"] for r in extract.apply_rules(spark.createDataFrame([(1, text)], "id long, text string")).collect()}
    want = "favorite color is blue|is 40 years old|speaks French|visited Rome|recently ate|used to smoke|wants to run|is interested in art|is learning Go|is working on rest|knows Ada|is skilled at chess|can cook"
    assert got == {"User" + ("'s " if x.startswith("favorite") else " ") + x for x in want.split("|")} | {"Recently, user swam"}


def test_dependency_levels_refuse_cycles(spark):
    from loamspark.operators import assembly

    edges = spark.createDataFrame([("deploy", "build"), ("build", "fetch"), ("deploy", "fetch")], "node string, needs string")
    assert {r.node: r.level for r in assembly.dependency_levels(edges).collect()} == {"fetch": 0, "build": 1, "deploy": 2}
    ring = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a")], "node string, needs string")
    with pytest.raises(ValueError):
        assembly.dependency_levels(ring)


def test_redaction_modes(spark):
    from loamspark.operators import assembly

    row = spark.createDataFrame([("mail jane.doe@example.com or 555-123-4567 now",), (None,)], "t string").select(*[assembly.redact("t", m).alias(m) for m in assembly.MODES]).collect()
    assert row[0].partial == "mail j*******@e******.com or ***-***-4567 now"
    assert row[0].mask == "mail ****.***@*******.*** or ***-***-**** now"
    assert row[0].remove == "mail  or  now"
    assert re.fullmatch("mail [0-9a-f]{8} or [0-9a-f]{8} now", row[0].hash)
    assert row[1].mask is None


def test_conflicts(spark):
    from loamspark.operators import assembly

    rows = [("user likes green tea", "user hates green tea"), ("user is 25 years old", "user is 30 years old"), ("likes tea", "hates coal")]
    df = spark.createDataFrame([(a, b, 0.7 if i < 2 else 0.0) for i, (a, b) in enumerate(rows)], "new string, old string, o double")
    assert [r.c for r in df.select(assembly.conflicting("new", "old", F.col("o")).alias("c")).collect()] == [True, True, False]


def test_vector_search_keeps_its_memory_bounded_and_its_ties_exact(spark):
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(3000, 4)), 1)
    x[::3] = x[0]  # a third are copies: ties across blocks
    frame = pd.DataFrame({"id": rng.permutation(3000), "embedding": list(x), "group": np.arange(3000) % 2})
    rows = [(int(r.id), r.embedding.tolist(), int(r.group)) for r in frame.itertuples()]
    vectors = spark.createDataFrame(rows, "id long, embedding array<double>, group long").repartition(3)
    q = frame[frame["id"] % 100 == 0]
    asked = vectors.where("id % 100 = 0").withColumnRenamed("id", "query_id")
    for metric, same in (("cosine", True), ("dot", False), ("l2", False)):
        found = retrieval.similar_topk(asked, vectors, 7, metric, same_group=same, drop_self=True)
        got = sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in found.collect())
        wanted = []
        for r in q.itertuples():
            s = -np.linalg.norm(x - r.embedding, axis=1) if metric == "l2" else x @ r.embedding
            if metric == "cosine":
                s = s / (np.linalg.norm(x, axis=1) * np.linalg.norm(r.embedding))
            s = np.round(s, 6) + 0.0
            ok = (frame["id"] != r.id) & ((frame["group"] == r.group) | (not same))
            order = sorted(zip(-s[ok], frame["id"][ok], strict=True))[:7]
            wanted += [(r.id, n, i, -v + 0.0) for n, (v, i) in enumerate(order, 1)]
        assert [g[:3] for g in got] == [w[:3] for w in sorted(wanted)], metric
        assert [g[3] for g in got] == pytest.approx([w[3] for w in sorted(wanted)], abs=1e-9)
    best = retrieval.Best(512, 5)
    tracemalloc.start()
    for at in range(0, 20_000, retrieval.VECTOR_BLOCK):  # all scores tie, ids fall: every row is among the best when it comes
        best.add(np.ones((512, retrieval.VECTOR_BLOCK)), np.ones((512, retrieval.VECTOR_BLOCK), bool), 20_000 - np.arange(at, at + retrieval.VECTOR_BLOCK))
    best.merge()
    assert tracemalloc.get_traced_memory()[1] < 64 << 20
    tracemalloc.stop()
    assert len(best.query) == 5 * 512


def test_vector_search_of_null_groups_and_text_ids(spark):
    rows = [("a", [1.0, 0.0], None), ("b", [1.0, 0.0], None), ("c", [1.0, 0.0], "x"), ("d", [0.0, 1.0], "x")]
    vectors = spark.createDataFrame(rows, "id string, embedding array<double>, group string")
    found = retrieval.similar_topk(vectors.withColumnRenamed("id", "query_id"), vectors, 1, same_group=True)
    assert sorted((r["query_id"], r["id"]) for r in found.collect()) == [("c", "c"), ("d", "d")]
