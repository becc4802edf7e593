"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

import pytest

import corpus_pipeline
from threadloom.llm import (chats, fingerprints, html_text, lengths, mixing, near_dup, packing, quality, secrets,
                            suffix_tree, variants, wavelet)

LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
TEXTS = [(None, None), (None, "null id"), (1, ""), (1, ""), (2, None), (3, "word"), (4, " \t\n "), (5, LONG), (5, LONG),
         (6, "É\U0001f600" * 40), (7, "Same text here, twice over and over for the ties."),
         (8, "Same text here, twice over and over for the ties."), (9, "z" * 50_000)]
# Names that operators use inside, as columns of the input.
CLASH = ["row", "words", "node", "key", "body", "p", "spans", "kept", "length", "marked", "lines", "slab", "rank", "_text"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i == 3 else "s", 1, *["x"] * len(CLASH)) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                 + ", ".join(f"{c} string" for c in CLASH))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(7, 1, 0), (7, 1, 0), (5, 0, 0), (3, None, 0), (None, 1, 1), (99, 1, 1)],
                                 "doc_id long, quality int, toxic int")


OPERATORS = {
    "quality": quality.quality_rules, "secrets": secrets.scan, "redacted": secrets.redacted,
    "packing": packing.pack, "pieces": lambda d: packing.pieces(d, with_ids=True),
    "lengths": lambda d: lengths.totals_by_limit(lengths.length_histogram(d)), "suffix_tree": suffix_tree.scores,
    "near_dup": near_dup.near_duplicates, "one_of_each": near_dup.one_of_each,
    "variants": variants.spelling_variants, "files": wavelet.round_trip,
    "fingerprints": fingerprints.with_edits, "plain_fingerprints": fingerprints.fingerprints,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(docs, name):
    assert OPERATORS[name](docs.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["quality", "secrets", "redacted", "suffix_tree", "near_dup", "fingerprints",
                                  "plain_fingerprints", "files"])
def test_one_row_for_each(docs, name):
    ids = [r.doc_id for r in OPERATORS[name](docs).select("doc_id").collect()]
    assert sorted(map(str, ids)) == sorted(str(i) for i, _ in TEXTS)


@pytest.mark.parametrize("stage", [secrets.redacted, near_dup.one_of_each, quality.kept_documents])
def test_columns_stay(docs, stage):
    out = stage(docs)
    assert out.columns == docs.columns
    assert all(r.spans == r.kept == r.lines == "x" for r in out.collect())


def test_clashing_columns_are_replaced(docs):
    judged = quality.quality_rules(docs)
    assert len(set(judged.columns)) == len(judged.columns) and judged.columns[-1] == "kept"
    row = judged.where("doc_id = 3").first()
    assert (row.row, row.words, row.n_words, row.base_failed, row.kept) == ("x", "x", 1, True, False)


def test_quality_of_odd_texts(docs):
    rows = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    assert (rows[2].n_words, rows[2].lost_share, rows[2].clean_text) == (0, 0.0, "")
    assert rows[4].n_words == 0 and rows[5].n_words == 60_000 and rows[9].word_chars == 50_000
    assert rows[6].word_chars == 80


def test_redaction_leaves_clean_rows(docs):
    assert sorted(map(str, ((r.doc_id, r.text) for r in secrets.redacted(docs).collect()))) == sorted(map(str, TEXTS))


def test_packing_places_every_piece(docs):
    rows = packing.pack(docs, capacity=64).collect()
    lengths_ = {}
    for r in rows:
        lengths_.setdefault((r.doc_id, r.piece, r.start), []).append(r.length)
    assert len(lengths_[1, 0, 0]) == 2 and lengths_[1, 0, 0] == [1, 1]
    assert sum(r.length for r in rows if r.doc_id == 4) == 5
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in used.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))]
        assert sum(n for _, n in places) <= 64


def test_near_duplicates_of_odd_texts(docs):
    rows = near_dup.near_duplicates(docs).collect()
    classes = {}
    for r in rows:
        classes.setdefault(r.doc_id, set()).add(r.class_id)
    assert classes[7] == classes[8] == {7} and classes[5] == {5} and classes[4] == {4}
    # Null and empty texts are equal; the least id of a group is null if one of its rows has none.
    assert classes[1] == classes[2]
    kept = [r.doc_id for r in near_dup.one_of_each(docs).collect()]
    assert kept.count(5) == 1 and kept.count(7) == 1 and 8 not in kept and len(kept) == 8


def test_chats(spark):
    schema = "conv_id long, turn int, role string, text string, slab string, nth string"
    rows = [(1, 0, "user", "hi", "", ""), (1, 1, None, None, "", ""), (None, 0, "user", "hi", "", ""), (2, None, "user", "", "", ""),
            (2, None, "user", "", "", ""), (3, 0, "user", None, "", "")]
    got = {(r.conv_id, r.nth): r.rendered for r in chats.chat_turns(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1), (2, 2), (3, 1)}  # the null conversation is a prefix of 1
    assert got[1, 2] == "<|im_start|>\n<|im_end|>\n"
    assert chats.chat_turns(spark.createDataFrame([], schema)).collect() == []


def test_mixing(docs, labels):
    rows = mixing.document_rates(docs, labels).collect()
    assert len(rows) == len(TEXTS) and all(r.rate >= 0 and r.copies >= 0 for r in rows)
    out = mixing.mixed(docs, labels)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in rows)
    assert mixing.mixed(docs.limit(0), labels).collect() == []
    none = mixing.document_rates(docs, labels.limit(0)).collect()
    assert {r.domain for r in none} == {"all"} and {round(r.rate, 6) for r in none} == {1.0}


def test_pages(spark):
    rows = [(1, None, None, "x"), (None, "u", "", "x"), (2, "u", "<p>a &amp; b<br>c", "x"), (2, "u", "<p>a &amp; b<br>c", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text, r.n_chars) for r in html_text.extract(pages).collect()]
    assert sorted(got, key=str) == [(1, "", 0), (2, "a & b c", 7), (2, "a & b c", 7), (None, "", 0)]
    assert html_text.extract(pages.limit(0)).collect() == []


def test_pipeline_stages(docs, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(docs.sparkSession, table, str(tmp_path)).columns == docs.columns
        corpus_pipeline.STAGES[-1][1](docs.sparkSession, table, str(tmp_path)).count()
