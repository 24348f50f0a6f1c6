"""Chat formatting, source mixing, the pipeline and the contract."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from paperloom.llm import chat_format, mixing
from tests.llm.rows import PROSE, awkward, documents, empty, write

TURNS = "conv_id long, turn long, role string, text string"


def formatted(df):
    return chat_format.format_chats(df.withColumn("parts", chat_format.text_parts(F.col("text"))))


def test_round_trip_of_hostile_texts(spark):
    rng = random.Random(9)
    bits = ["<|turn|>", "<|end|>", "\n", "assistant", "&amp;", "&", "&lt;", "<", "[INST]", "</s>", "&lsqb;", "é", "😀", " "]
    rows = [(c, t, rng.choice(["user", "assistant", "sys\ntem", "a<b"]), rng.choice([None, "", *["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(6)]])) for c in range(40) for t in range(rng.randrange(1, 7))]
    out = formatted(spark.createDataFrame(rows, TURNS)).select("conv_id", "formatted", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.read_masked(F.col("formatted"), F.col("mask")).alias("loss")).collect()
    want = defaultdict(list)
    for c, _, role, text in rows:
        want[c].append((role, text or ""))
    for r in out:
        assert [tuple(t) for t in r["turns"]] == want[r["conv_id"]]
        assert r["loss"] == "".join(t for role, t in want[r["conv_id"]] if role == "assistant")
        assert "[INST]" not in r["formatted"] and "</s>" not in r["formatted"]


def test_typed_parts_keep_their_order(spark):
    part = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
    rows = [(1, 0, "user", [("text", "look <|image_1|> ", None, None, None, None, None), ("image", None, "a.png", 56, 29, None, None), None, ("audio", None, "b.wav", None, None, 2.0, None), ("text", None, None, None, None, None, None), ("document", None, "c.pdf", None, None, None, 3), (None, None, "d", None, None, None, None)]), (1, 1, "assistant", None)]
    out = chat_format.format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {part}")).collect()[0]
    assert out["formatted"] == "<|turn|>user\nlook &lt;|image_1|> <|image_1|><|audio_2|><|document_3|><|unknown_4|><|end|>\n<|turn|>assistant\n<|end|>\n"
    assert [(a["turn_number"], a["n"], a["ref"], a["tokens"]) for a in out["attachments"]] == [(1, 1, "a.png", 4), (1, 2, "b.wav", 50), (1, 3, "c.pdf", 1800), (1, 4, "d", 0)]
    assert out["expanded_tokens"] == 1854


def test_chat_edges(spark):
    rows = [(None, None, None, None), (1, None, "assistant", "first"), (1, 1, "user", "tie b"), (1, 1, "user", "tie a"), (1, 1, "user", "tie a")]
    out = {r["conv_id"]: r["formatted"] for r in formatted(spark.createDataFrame(rows, TURNS).withColumn("n", F.lit(1))).collect()}
    assert out[None] == "<|turn|>\n<|end|>\n" and out[1].index("first") < out[1].index("tie a") < out[1].index("tie b") and out[1].count("tie a") == 2
    assert formatted(spark.createDataFrame([], TURNS)).count() == 0


def test_chat_plan_is_native_with_one_shuffle(spark):
    plan = formatted(spark.createDataFrame([(1, 1, "user", "x")], TURNS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        level = (total - sum(3 * sizes[s] for s in capped)) / max(1e-9, sum(weight[s] for s in names if s not in capped))
        above = {s for s in names if s not in capped and weight[s] * level > 3 * sizes[s] + 1e-9}
        if not above:
            return {s: 3 * sizes[s] if s in capped else weight[s] * level for s in names}
        capped |= above


@pytest.mark.parametrize("block_rows", [mixing.BLOCK_ROWS, 20])
def test_mix_meets_its_targets(spark, block_rows):
    rng = random.Random(8)
    sources = [rng.choice(["a", "a", "a", "a", "B", "é", "tiny", None]) for _ in range(700)]
    sources = [s if s != "tiny" or i < 60 else "a" for i, s in enumerate(sources)]
    docs = documents(spark, ["w " * rng.randrange(0, 60) for _ in range(700)], source=sources)
    out = mixing.mix_sources(docs, block_rows=block_rows).collect()
    where = dict(enumerate(sources, 1))
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in out:
        s = where[r["doc_id"]]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    want = brute_targets(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - target[s]) <= 1
    assert sorted(out) == sorted(mixing.mix_sources(docs.repartition(3), block_rows=block_rows).collect())


def test_blocks_of_one_source_fly_in_many_tasks(spark):
    units = spark.range(2000).select(F.lit("hot").alias("stratum"), "id", (F.col("id") % 9 + 1).alias("size"), F.lit(0.4).alias("share"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        drawn = mixing.cube_sample(units, block_rows=100)
        closed = drawn.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(closed) >= 4 and max(r["n"] for r in closed) < 1200


def test_flight_keeps_totals():
    rng = random.Random(1)
    share, size = [0.37] * 500, [float(rng.randrange(1, 90)) for _ in range(500)]
    before = sum(s * p for s, p in zip(size, share))
    mixing.flight(share, size, random.Random(2), land=False)
    assert sum(0 < p < 1 for p in share) <= 2
    assert abs(sum(share) - 0.37 * 500) < 1e-6 and abs(sum(s * p for s, p in zip(size, share)) - before) < 1e-6


def test_mix_edges(spark):
    out = mixing.mix_sources(awkward(spark)).collect()
    assert len(out) == 9 and all(r["taken"] == 0 for r in out if r["doc_id"] in (2, 3, 7))
    assert mixing.mix_sources(empty(spark)).count() == 0
    assert mixing.mix_sources(documents(spark, [None, ""])).agg(F.sum("taken")).first()[0] == 0


def test_pipeline_stages_take_effect(spark, tmp_path):
    abuse = [f"{PROSE[i:i + 60]} you total moron {i}" for i in range(40)]
    item = "what is the sum of all whole numbers between one and one hundred inclusive please"
    clean = [f"{i} {PROSE[::-1]} {i * 7919} {PROSE[i:]}" for i in range(3)]
    texts = abuse + [PROSE * 2, PROSE * 2, f"{clean[0]} {item}", clean[1], f"{clean[2][:80]} password = hunter2hunter2 end", None]
    texts += [f"{PROSE[i:i + 60]} a fine day {i}" for i in range(40)]
    docs = documents(spark, texts).withColumn("extra", F.lit("kept"))
    write(docs, tmp_path, "documents")
    write(docs.where("doc_id <= 42 OR doc_id > 46").select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") <= 40).cast("int").alias("toxic")), tmp_path, "labels")
    write(spark.createDataFrame([(1, item)], "item_id long, text string"), tmp_path, "benchmark")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = spark.createDataFrame(stage(spark, seen, str(tmp_path)).collect(), docs.schema)
        assert seen.columns == docs.columns, name
    kept = {r["doc_id"]: r["text"] for r in seen.collect() if r["doc_id"] <= 46}
    assert set(kept) == {41, 44, 45, 46} and "hunter2" not in kept[45] and kept[44] == texts[43]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect() if r["doc_id"] <= 46} == {41, 44, 45, 46}


def test_near_dedup_stage_keeps_the_clean_text_of_a_repeated_id(spark, tmp_path):
    lone = "quite another text that nothing else in the table holds, not even in part, one would hope"
    docs = documents(spark, [PROSE * 2, PROSE * 2, lone, lone, None, None], doc_id=[1, 2, 2, 2, None, None])
    out = corpus_pipeline.near_dedup_stage(spark, docs, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in out if r["doc_id"]) == [(1, PROSE * 2), (2, lone)]
    assert sum(r["doc_id"] is None for r in out) == 2


def test_pipeline_on_awkward_tables(spark, tmp_path):
    write(spark.createDataFrame([], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    write(spark.createDataFrame([], "item_id long, text string"), tmp_path, "benchmark")
    for table, rows in ((awkward(spark), 7), (empty(spark), 0)):
        seen = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            seen = spark.createDataFrame(stage(spark, seen, str(tmp_path)).collect(), table.schema)
        assert seen.count() == rows
        assert corpus_pipeline.STAGES[-1][1](spark, seen, str(tmp_path)).count() == rows


def test_contract_has_all_queries():
    names = contract.queries()
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14))
