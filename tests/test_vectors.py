import numpy as np
import pytest

from pyspark.sql import functions as F

from threadloom.operators import blocks, search, vector_index as cells, vectors as vx


def table(spark, array, name="vec_id"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(array)], f"{name} int, embedding array<float>")


def brute(stored, asked, k):
    a = np.asarray(stored, np.float32).astype(float)
    q = np.asarray(asked, np.float32).astype(float)
    scores = (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (q / np.linalg.norm(q, axis=1, keepdims=True)).T
    return {j: sorted(range(len(a)), key=lambda i: (-round(scores[i, j], 9), i))[:k] for j in range(len(q))}


@pytest.mark.parametrize("broadcast_bytes, block_bytes", [(32 << 20, 1 << 20), (0, 200)])
def test_exact_top_k(spark, monkeypatch, broadcast_bytes, block_bytes):
    """Few large blocks and a broadcast, or many small ones dealt over lanes."""
    monkeypatch.setattr(blocks, "BROADCAST_BYTES", broadcast_bytes)
    monkeypatch.setattr(blocks, "BLOCK_BYTES", block_bytes)
    pick = np.random.default_rng(0)
    stored = pick.normal(size=(300, 6))
    stored[100:200] = stored[7]  # a third of the rows are copies
    asked = pick.normal(size=(9, 6))
    asked[0] = stored[7]
    out = vx.vector_search(table(spark, stored).repartition(5), table(spark, asked, "query_id"), k=4, ids=["vec_id"]).collect()
    found = {q: [r.vec_id for r in sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)] for q in range(9)}
    assert found == brute(stored, asked, 4)


def test_two_blocks_hold_few_scores_at_a_time():
    import tracemalloc

    import pandas as pd
    pick = np.random.default_rng(7)
    stored, asked = pick.normal(size=(3000, 4)), pick.normal(size=(3000, 4))
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    best = vx._Best(len(asked), ["vec_id"], 3)
    tracemalloc.start()
    best.add(pd.DataFrame({"vec_id": np.arange(3000)}), unit(stored), unit(asked))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * 3000 * 3000  # all scores at once
    found = best.rows.groupby("query")["vec_id"].apply(list).to_dict()
    scores = np.round(unit(asked) @ unit(stored).T, 9)
    assert found == {q: np.lexsort((np.arange(3000), -scores[q]))[:3].tolist() for q in range(3000)}


def test_no_queries(spark):
    stored = table(spark, [[1.0, 0.0]])
    assert vx.vector_search(stored, table(spark, [[1.0, 0.0]], "query_id").limit(0), ids=["vec_id"]).collect() == []


def test_embed_skips_done_and_checks_width(spark, messages, tmp_path):
    rows = messages([("c", str(i), "user", "2024-01-01", f"word{i} x") for i in range(6)])
    done = rows.where("msg_id < '2'").select("conv_id", "msg_id")
    embed = vx.hashing_embedder(16)
    made = vx.embed_messages(rows, done, embed, 16, "hash-16").collect()
    assert {r.msg_id for r in made} == {"2", "3", "4", "5"}
    one = next(r for r in made if r.msg_id == "2")
    assert np.allclose(one.embedding, embed(["word2 x"])[0])
    with pytest.raises(Exception, match="8-dimensional"):
        vx.embed_messages(rows, done, embed, 8, "hash").collect()

    mark = str(tmp_path / "failed")

    def flaky(texts):
        import os
        if not os.path.exists(mark):
            open(mark, "w").close()
            raise RuntimeError("provider is away")
        return embed(texts)

    assert vx.embed_messages(rows.coalesce(1), done, flaky, 16, "m", retries=1, delay=0).count() == 4
    assert len(vx.embed_messages(rows.coalesce(1), done, flaky, 16, "m", retries=1, delay=0).collect()) == 4


def test_embedding_shuffles_no_text_of_done_messages(spark, messages):
    """Repeated messages are embedded as often as they stand, and so are messages with null keys."""
    rows = messages([("c", "1", "user", "2024-01-01", "a"), ("c", "1", "user", "2024-01-01", "b"), ("c", None, "user", "2024-01-01", "n"),
                     (None, "2", "user", "2024-01-01", "o"), ("c", "3", "user", "2024-01-01", "d")])
    done = rows.where("msg_id = '3' or msg_id is null").select("conv_id", "msg_id")
    todo = vx.embed_messages(rows, done, vx.hashing_embedder(4), 4, "m")
    assert sorted((str(r.conv_id), str(r.msg_id)) for r in todo.collect()) == [("None", "2"), ("c", "1"), ("c", "1"), ("c", "None")]
    plan = todo._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


@pytest.mark.parametrize("rows", [1, 3, 4096])
def test_blocks_hold_every_row_once(spark, monkeypatch, rows):
    table_ = spark.range(50).select((F.col("id") % 4).alias("key"), F.col("id")).repartition(3)
    packed = blocks.packed(table_, "key", block_rows=rows).collect()
    got = [(r.key, x) for r in packed for x in blocks.opened(bytes(r.block))["id"].to_pylist()]
    assert sorted(got) == sorted((i % 4, i) for i in range(50)) and all(r.n <= rows for r in packed)
    assert blocks.packed(table_.where("id < 0"), "key").collect() == []


def test_a_search_reads_the_vectors_once(spark):
    stored = table(spark, np.eye(6)).repartition(3)
    plan = vx.vector_search(stored, table(spark, np.eye(6), "query_id"), ids=["vec_id"])._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def clustered(n, dim=8, seed=2):
    pick = np.random.default_rng(seed)
    centres = pick.normal(size=(20, dim))
    return centres[pick.integers(0, 20, n)] + pick.normal(size=(n, dim)) * 0.2


def test_index_holds_every_vector_and_finds_most(spark, tmp_path):
    stored = clustered(2000)
    stored[5] = 0
    vectors = table(spark, stored)
    index = cells.build_index(vectors, str(tmp_path / "index"), ids=["vec_id"])
    assert sorted(r.vec_id for r in index.vectors(spark).select("vec_id").collect()) == list(range(2000))
    asked = vectors.where("vec_id % 20 = 0 AND vec_id > 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = vx.vector_search(vectors, asked, 10, ["vec_id"])
    quality = cells.search_quality(index, asked, exact, 10).collect()
    assert len(quality) == 99 and sum(r.found for r in quality) >= 0.9 * 990
    assert all(r.of == 10 and r.stored == 2000 for r in quality) and sum(r.read for r in quality) < 0.5 * 99 * 2000

    again = cells.open_index(spark, str(tmp_path / "index"), ["vec_id"])
    whole = cells.search_index(again, asked, 10, probes=len(again.centres))
    key = lambda rows: {(r.query_id, r.rank, r.vec_id, r.score) for r in rows.collect()}
    assert np.allclose(again.centres, index.centres) and again.probes == index.probes and key(whole) == key(exact)


def test_probes_follow_the_wanted_recall(spark, tmp_path):
    """Vectors without clusters: most of the cells have to be probed, and are."""
    vectors = table(spark, np.random.default_rng(5).normal(size=(1200, 16)))
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = vx.vector_search(vectors, asked, 10, ["vec_id"])
    probes = []
    for recall in (0.5, 0.95):
        index = cells.build_index(vectors, str(tmp_path / str(recall)), ids=["vec_id"], cells=20, recall=recall)
        rows = cells.search_quality(index, asked, exact, 10).collect()
        assert sum(r.found for r in rows) >= (recall - 0.05) * 600
        probes.append(index.probes)
    assert probes[0] < probes[1] <= 20


def test_index_grows(spark, tmp_path):
    stored = clustered(600)
    vectors = table(spark, stored)
    index = cells.build_index(vectors.where("vec_id < 400"), str(tmp_path / "index"), ids=["vec_id"], cells=6)
    cells.extend_index(index, vectors.where("vec_id >= 400"))
    asked = vectors.where("vec_id >= 590").select(F.col("vec_id").alias("query_id"), "embedding")
    hits = {(r.query_id, r.vec_id) for r in cells.search_index(index, asked, 1, probes=6).collect()}
    assert hits == {(i, i) for i in range(590, 600)}


def test_only_probed_cells_are_opened(spark, tmp_path):
    vectors = table(spark, clustered(500))
    index = cells.build_index(vectors, str(tmp_path / "index"), ids=["vec_id"], cells=10)
    asked = vectors.where("vec_id = 7").select(F.col("vec_id").alias("query_id"), "embedding")
    plan = cells.search_index(index, asked, 3, probes=2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan


def fused_plainly(words, near, k):
    """Fusion of the whole lists."""
    out = {}
    for q in {q for q, _ in [*words, *near]}:
        keys = {m for p, m in [*words, *near] if p == q}
        score = {m: round(sum(1 / (60.0 + r[q, m]) for r in (words, near) if (q, m) in r), 9) for m in keys}
        out[q] = [(m, score[m]) for m in sorted(keys, key=lambda m: (-score[m], m))[:k]]
    return out


@pytest.mark.parametrize("k", [1, 3])
def test_hybrid_equals_the_fusion_of_whole_lists(spark, messages, k):
    """Messages that are good in one list only, and others whose second rank is far below any fixed depth."""
    pick = np.random.default_rng(8)
    words = ["alpha", "beta", "gamma", "delta", "x", "y", "z"]
    rows = [(f"c{i % 3}", f"{i:04}", "user", "2024-01-01", " ".join(pick.choice(words, pick.integers(1, 9)))) for i in range(700)]
    table_ = messages(rows)
    embed = vx.hashing_embedder(4)
    table_ = table_.withColumn("text", F.when(F.col("msg_id").isin("0300", "0500"), F.concat("text", F.lit(" rare"))).otherwise(F.col("text")))
    made = vx.embed_messages(table_.where("msg_id > '0004'"), table_.limit(0), embed, 4, "h")
    asked = spark.createDataFrame([("q1", "alpha beta"), ("q2", "gamma"), ("q3", "alpha alpha z"), ("q4", "nothing here"), ("q5", "rare")],
                                  "query_id string, q string")
    matches = search.ranked_matches(search.scored_matches(table_, asked, None), 10**6).collect()
    vectors = vx._embed_column(asked, ["query_id"], "q", embed, 4)
    near = vx.vector_search(made, vectors, 10**6).collect()
    ranks = [{(r.query_id, (r.conv_id, r.msg_id)): r.rank for r in rows_} for rows_ in (matches, near)]
    want = fused_plainly(*ranks, k)
    got = {}
    found = vx.hybrid_search(table_, made, asked, embed, 4, k=k, stemmer=None).collect()
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(((r.conv_id, r.msg_id), r.score))
        places = [(r.query_id, (r.conv_id, r.msg_id)) in x and x[r.query_id, (r.conv_id, r.msg_id)] or None for x in ranks]
        assert [r.word_rank, r.vector_rank] == places
    assert got == want
    assert max(max(r.word_rank or 0, r.vector_rank or 0) for r in found) > 2 * (60 + k)


def test_hybrid_adds_reciprocal_ranks(spark, messages):
    rows = messages([("c", "1", "user", "2024-01-01", "alpha beta"), ("c", "2", "user", "2024-01-02", "alpha alpha"),
                     ("c", "3", "user", "2024-01-03", "gamma")])
    embed = vx.hashing_embedder(32)
    made = vx.embed_messages(rows, rows.limit(0), embed, 32, "h")
    asked = spark.createDataFrame([("q", "alpha")], "query_id string, q string")
    out = {r.msg_id: r for r in vx.hybrid_search(rows, made, asked, embed, 32, k=3).collect()}
    assert out["2"].rank == 1 and out["2"].score == pytest.approx(1 / 61 + 1 / 61)
    assert out["1"].score == pytest.approx(1 / 62 + 1 / 62) and out["3"].word_rank is None
