"""Spelling variants, hard negatives and token files against plain Python."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from threadloom.llm import negatives, queries, tokens, variants, wavelet

SF = "/root/testdata/sf0.001"


def as_docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# ---------------------------------------------------------------- spelling variants

def plain_counts(rows, slip=97):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            code = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if slip and code % slip == 0:
                at = code % len(run)
                run = run[:at] + run[at + 1:]
            found[run] += 1
    return found


def plain_variants(rows, slip=97, least=3):
    words = {w: n for w, n in plain_counts(rows, slip).items() if len(w) >= 5 and n >= least}
    # Two words within one edit share a word or a word less one letter at the same place.
    groups = defaultdict(set)
    for w in words:
        groups[w].add(w)
        for i in range(len(w)):
            groups[w[:i] + w[i + 1:]].add(w)
            groups[w[:i], w[i + 1:]].add(w)
    near = defaultdict(set)
    for key, members in groups.items():
        for w in members:
            for v in members:
                if v != w and (isinstance(key, tuple) or v == key or w == key):
                    near[w].add(v)
    forms = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.add((w, forms[w], root, n, len(near[w]), words.get(forms[w])))
    return out


def rows_of(result):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in result.collect()}


def test_variants_of_the_given_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op11_spelling_variants(spark, SF)
    assert got.count() > 1000
    assert rows_of(got) == plain_variants([(r.doc_id, r.text) for r in docs.collect()])


def test_variants_of_dense_words(spark):
    """Few letters, many words: every kind of edit at every place, long chains of forms."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(4, 8))) for _ in range(400)]
    texts = [" ".join(rng.choice(words[:rng.randint(1, 400)]) for _ in range(300)) for _ in range(20)]
    texts += ["x" * n + " " + "x" * n for n in (50, 51, 52, 400, 401)] * 2 + ["ab" * 300 + "c " + "ab" * 150 + "d" + "ab" * 150 + "c"] * 3
    texts += ["Stra×e STRA÷E straße", "ÉCOLE École école ecole", "one-two don't"] * 3
    rows = list(enumerate(texts))
    assert rows_of(variants.spelling_variants(as_docs(spark, texts), slip=3)) == plain_variants(rows, slip=3)


def test_variants_join_heavy_nodes_apart(spark, monkeypatch):
    monkeypatch.setattr(variants, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(variants, "HEAVY", 20)
    rng = random.Random(6)
    texts = [" ".join("pre" + "".join(rng.choice("abc") for _ in range(4)) for _ in range(200)) for _ in range(10)]
    assert rows_of(variants.spelling_variants(as_docs(spark, texts), slip=None)) == plain_variants(list(enumerate(texts)), None)


def test_variants_odd_inputs(spark):
    docs = spark.createDataFrame([(None, "hello " * 4, "x"), (1, None, "x"), (1, "", "x"), (1, "HELLO hallo hallo", "x"),
                                  (1, "HELLO hallo hallo", "x")], "doc_id long, text string, word string")
    assert rows_of(variants.spelling_variants(docs, slip=None)) == {
        ("hello", None, "hello", 6, 1, None), ("hallo", None, "hallo", 4, 1, None)}
    assert variants.spelling_variants(docs.limit(0)).collect() == []


# ---------------------------------------------------------------- hard negatives

def plain_negatives(rows):
    rows = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows
            if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda p: (-p[0], p[1] is None, p[1] or 0)
    out = Counter()
    for at, (i, label, v) in enumerate(rows):
        if i is None or i % 100:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, other) for k, (j, other, w) in enumerate(rows) if k != at]
        same = sorted([(s, j) for s, j, other in scored if other == label], key=order)[:5]
        for score, j in same:
            fits = sorted([(s, k) for s, k, other in scored if other != label and 80 * score <= 100 * s <= 100 * score], key=order)
            for rank, (s, k) in enumerate(fits[:5], 1):
                out[i, j, rank, k, score, s] += 1
    return out


def as_vectors(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")


def counted(result):
    return Counter((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in result.collect())


@pytest.mark.parametrize("scale, kind", [(0.2, "float"), (3.0, "double"), (1e4, "double")])
def test_negatives(spark, monkeypatch, scale, kind):
    monkeypatch.setattr(negatives, "TILE", (2, 16))
    rng = np.random.default_rng(3)
    rows = [(i * 10, [float(x) for x in np.float32(rng.normal(0.1, 1, 70) * scale)], int(rng.integers(0, 3))) for i in range(120)]
    got = counted(negatives.hard_negatives(as_vectors(spark, rows, kind), F.col("vec_id") % 100 == 0))
    assert got == plain_negatives(rows) and sum(got.values()) > 20


def test_negatives_odd_inputs(spark):
    fine, inf, nan = [0.5, 0.25], [float("inf"), 0.0], [float("nan"), 0.0]
    rows = [(0, fine, 1), (1, fine, 1), (2, fine, 2), (3, fine, 2), (4, [0.5], 2), (5, None, 2), (6, inf, 2), (8, nan, 2),
            (9, fine, None), (10, [None, 0.5], 2), (11, [], 2), (None, fine, 2), (200, fine, 2), (300, [-0.5, 0.0], 3), (301, fine, 3),
            (12, fine, 2), (13, fine, 2), (15, fine, 1)]
    table = as_vectors(spark, rows).withColumn("score", F.lit("x")).withColumn("cell", F.lit("x"))
    got = counted(negatives.hard_negatives(table, F.col("vec_id") % 100 == 0))
    assert got == plain_negatives(rows)
    # Scores of zero: a positive of zero has negatives of zero; a negative positive has none.
    assert negatives.hard_negatives(table.limit(0), F.col("vec_id") % 100 == 0).collect() == []
    assert negatives.hard_negatives(table.where("vec_id = 1"), F.col("vec_id") % 100 == 0).collect() == []
    # A repeated anchor is another row: each of the two has the other for a positive.
    twice = [(0, fine, 1), (0, fine, 1), (1, fine, 2)]
    assert counted(negatives.hard_negatives(as_vectors(spark, twice), F.col("vec_id") % 100 == 0)) == {(0, 0, 1, 1, 20480, 20480): 2}


def test_residue_products_are_exact():
    rng = np.random.default_rng(4)
    for top in (1, 300, 10**5, 10**6):
        a, b = (rng.integers(-top, top + 1, (5, 130)).astype(float) for _ in range(2))
        a[0], b[0] = top, -top
        moduli = negatives.primes(top * top * 130)
        got = negatives.exact_scores([negatives.residues(a, p) for p in moduli], [negatives.residues(b, p) for p in moduli], moduli)
        assert (got == a.astype(object) @ b.T.astype(object)).all()


# ---------------------------------------------------------------- token files

@pytest.fixture(scope="module")
def encode():
    tokenizer = Tokenizer.from_file(tokens.JSON_PATH)
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, wavelet.END_ID]


@pytest.mark.parametrize("n, top", [(0, 5), (1, 0), (1, 1), (70_000, 3), (200_000, 50_257), (65_536, 70_000)])
def test_shard_answers(n, top):
    ids = np.random.default_rng(n).integers(0, top + 1, n).astype(np.uint32)
    data = wavelet.shard_bytes(pa.table({"doc_id": [1], "n_tokens": [n]}), ids)
    shard = wavelet.Shard(pa.BufferReader(data), cached=3)
    assert (shard.decoded() == ids).all() and shard.documents().to_pylist() == [{"doc_id": 1, "n_tokens": n}]
    if n:
        places = np.random.default_rng(1).integers(0, n, 50)
        assert (shard.tokens(places) == ids[places]).all()
    for token in {0, 1, top, top // 2, 10**6}:
        assert (shard.places(token) == np.flatnonzero(ids == token)).all()
        for first, last in ((0, n), (n // 3, n // 2), (n, n)):
            assert shard.count(token, first, last) == int((ids[first:last] == token).sum())
            assert (shard.places(token, first, last) == first + np.flatnonzero(ids[first:last] == token)).all()


def test_files_of_the_given_texts(spark, encode):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    start, want = 0, []
    for r in sorted(docs, key=lambda r: r.doc_id):
        ids = encode(r.text)
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = queries.op13_token_files(spark, SF).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == want


def test_lookups_over_shards(spark, encode, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    whole = np.array([x for r in sorted(docs.collect(), key=lambda r: r.doc_id) for x in encode(r.text)])
    shards = wavelet.write_shards(docs, str(tmp_path), shard=2000)
    listed = shards.collect()
    assert len(listed) > 5 and sum(r.n_tokens for r in listed) == len(whole) and sum(r.n_docs for r in listed) == 60
    places = [0, 5, 1999, 2000, len(whole) - 1, len(whole), 12345 % len(whole)]
    asked = spark.createDataFrame([(p,) for p in places], "place long")
    assert {(r.place, r.token) for r in wavelet.tokens_at(shards, asked).collect()} == {(p, whole[p]) for p in places if p < len(whole)}
    some = [int(whole[10]), wavelet.END_ID, 50_256]
    assert {(r.token, r.n) for r in wavelet.token_counts(shards, some).collect()} == {(t, int((whole == t).sum())) for t in some}
    found = {(r.token, r.place) for r in wavelet.occurrences(shards, some).collect()}
    assert found == {(t, int(p)) for t in some for p in np.flatnonzero(whole == t)}


def test_files_of_odd_texts(spark, encode):
    texts = [(None, "null id"), (None, None), (3, "b"), (3, "a"), (1, ""), (2, "word " * 30_000), (7, "same"), (7, "same"),
             (9, " " * 5000 + "é\U0001f600#"), (8, "z" * 50_000)]
    docs = spark.createDataFrame([(i, t, "x", "x") for i, t in texts], "doc_id long, text string, ids string, start string")
    got = wavelet.round_trip(docs).collect()
    ordered = sorted(got, key=lambda r: r.start)
    at = 0
    for r in ordered:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    assert [r.doc_id for r in ordered] == sorted((i for i, _ in texts), key=lambda i: (i is not None, i))
    want = Counter((i, np.array(encode(t), "<u4").tobytes()) for i, t in texts)
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == want
    assert wavelet.round_trip(docs.limit(0)).collect() == []


def test_repeated_rows_are_dealt_apart(spark, tmp_path):
    """A third of all rows with one id and text do not end in one shard."""
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"),
                                    F.lit("some words of a text").alias("text")).repartition(4, "doc_id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        shards = wavelet.write_shards(docs, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r.n_docs for r in shards) == 3000 and max(r.n_docs for r in shards) < 1000
