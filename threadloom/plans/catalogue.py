"""Every registered query: name -> function of (spark, sf_dir) over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from threadloom.functions.highlights import highlights
from threadloom.functions.normalise import content_hash as content_hash_of
from threadloom.functions.redact import redact, redact_table
from threadloom.functions.lengths import estimate_tokens
from threadloom.functions import text as tx
from threadloom.functions.times import iso_timestamp, minute_text
from threadloom.operators import (browse, filters, ingest, loads, ordered, packs, paging, prompts, search, thread_index, threads, topic_index, topics,
                                  vector_index as vector_cells, vectors, vocabulary)
from threadloom.plans import fixtures as fx
from threadloom.session import scratch_path, write_scratch
from threadloom.sources import archives
from threadloom.sources.chat_export import register
from threadloom.sources.tables import read_conversations, read_table
from threadloom.streaming import ingest as streams

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    _REGISTRY[function.__name__] = function
    return function


def all_queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def _anchor_ids(topic_rows: DataFrame) -> DataFrame:
    ids = F.transform("anchors", lambda a: F.concat_ws("/", a["conv_id"], a["msg_id"]))
    return topic_rows.withColumn("anchors", F.array_join(ids, ","))


# Topics

@query
def topic_map(spark, sf_dir):
    return _anchor_ids(topics.topic_map(fx.messages(spark, sf_dir), max_messages=None))


@query
def window_cap(spark, sf_dir):
    return _anchor_ids(topics.topic_map(fx.messages(spark, sf_dir), max_messages=300))


@query
def topic_map_range(spark, sf_dir):
    return _anchor_ids(topics.topic_map(fx.messages(spark, sf_dir), date_from="2024-01-02T00:00:00Z",
                                        date_to="2024-01-03", limit=20, max_messages=None))


@query
def indexed_topic_map(spark, sf_dir):
    """The map of a window from stored counts, in two loads; its bounds cut hours."""
    rows, path = fx.messages(spark, sf_dir), scratch_path(spark, "topics")
    topic_index.write_topics(rows.where(F.col("role") == "user"), path, "a")
    topic_index.write_topics(rows.where(F.col("role") != "user"), path, "b")
    return _anchor_ids(topic_index.indexed_topic_map(rows, path, date_from="2024-01-01T07:02:00Z", date_to="2024-01-03T00:03:00",
                                                     limit=20))


@query
def topic_map_conv(spark, sf_dir):
    return _anchor_ids(topics.topic_map(fx.messages(spark, sf_dir), conv_id="3", min_occurrences=1))


@query
def topic_map_documents(spark, sf_dir):
    return _anchor_ids(topics.topic_map(fx.document_messages(spark, sf_dir), limit=50, sample_limit=5,
                                        max_messages=None))


@query
def topic_anchors(spark, sf_dir):
    scope = fx.messages(spark, sf_dir)
    return topics.topic_anchors(scope, topics.top_topics(scope), sample_limit=5)


@query
def topic_map_wide(spark, sf_dir):
    """More topics and samples than one screen shows."""
    return _anchor_ids(topics.topic_map(fx.messages(spark, sf_dir), limit=400, min_occurrences=25, sample_limit=8))


@query
def topic_document_frequency(spark, sf_dir):
    return topics.topic_document_frequency(fx.document_messages(spark, sf_dir))


@query
def topic_window_summary(spark, sf_dir):
    return topics.topic_window_summary(fx.messages(spark, sf_dir), max_messages=None)


@query
def timeline_topics(spark, sf_dir):
    return topics.timeline_topics(fx.messages(spark, sf_dir))


# Redaction and content

@query
def redact_documents(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents")
    return docs.select("doc_id", redact(F.col("text")).alias("text"))


@query
def redact_counts(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select("source", "text")
    hits = [F.sum(f"{kind}_hits").alias(f"{kind}_hits") for kind in ("email", "phone", "ip", "url")]
    return redact_table(docs).groupBy("source").agg(*hits)


@query
def content_hash(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents")
    return docs.select("doc_id", content_hash_of(F.col("text")).alias("hash"))


@query
def duplicate_messages(spark, sf_dir):
    docs = fx.document_messages(spark, sf_dir).withColumn("hash", content_hash_of(F.col("text")))
    return browse.duplicate_messages(docs)


@query
def trim_text(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents")
    return docs.select("doc_id", tx.trim_text(F.col("text")).alias("preview"))


@query
def parse_search_terms(spark, sf_dir):
    return fx.messages(spark, sf_dir).select(
        "conv_id", "msg_id", F.array_join(tx.search_terms(F.col("text")), " ").alias("terms"))


# Browsing

@query
def count_conversations(spark, sf_dir):
    return browse.count_conversations(fx.conversations(spark, sf_dir), "owner_3")


@query
def conversation_summary(spark, sf_dir):
    return browse.conversation_summary(fx.messages(spark, sf_dir))


@query
def list_conversations(spark, sf_dir):
    return browse.list_conversations(fx.conversations(spark, sf_dir), fx.messages(spark, sf_dir))


@query
def list_page2(spark, sf_dir):
    return browse.list_conversations(fx.conversations(spark, sf_dir), fx.messages(spark, sf_dir), limit=20, offset=20)


@query
def listing_page(spark, sf_dir):
    """A page far down a stored listing: only the slabs that hold it are opened."""
    path = scratch_path(spark, "listing")
    paging.write_listing(fx.conversations(spark, sf_dir), fx.messages(spark, sf_dir), path, slab_rows=20)
    return paging.listing_page(spark, path, limit=15, offset=52)


@query
def listing_page_owner(spark, sf_dir):
    path = scratch_path(spark, "listing")
    paging.write_listing(fx.conversations(spark, sf_dir), fx.messages(spark, sf_dir), path, slab_rows=20)
    return paging.listing_page(spark, path, limit=8, offset=9, owner_id="owner_1")


@query
def list_total(spark, sf_dir):
    """A page of one owner's conversations with the number of all of them."""
    return browse.list_conversations(fx.conversations(spark, sf_dir), fx.messages(spark, sf_dir), owner_id="owner_1",
                                     limit=5, offset=2, with_total=True)


@query
def list_owner(spark, sf_dir):
    return browse.list_conversations(fx.conversations(spark, sf_dir), fx.messages(spark, sf_dir), owner_id="owner_3",
                                     limit=2000)


@query
def conversation_stats(spark, sf_dir):
    stats = browse.conversation_stats(fx.messages(spark, sf_dir))
    return stats.withColumn("participant_roles", F.array_join("participant_roles", ","))


@query
def timeline(spark, sf_dir):
    return browse.timeline(fx.messages(spark, sf_dir))


@query
def timeline_conversation(spark, sf_dir):
    return browse.timeline(fx.messages(spark, sf_dir), "5")


@query
def conversation_checksum(spark, sf_dir):
    hashed = fx.messages(spark, sf_dir).withColumn("hash", content_hash_of(F.col("text")))
    return browse.conversation_checksum(hashed)


@query
def table_counts(spark, sf_dir):
    return browse.table_counts(fx.conversations(spark, sf_dir), fx.messages(spark, sf_dir))


# Threads

@query
def thread_ancestors(spark, sf_dir):
    rows = fx.messages(spark, sf_dir)
    return threads.thread_ancestors(rows, rows.select("conv_id", "msg_id")).drop("text")


@query
def thread_descendants(spark, sf_dir):
    rows = fx.messages(spark, sf_dir)
    return threads.thread_descendants(rows, rows.select("conv_id", "msg_id"), depth=3).drop("text")


@query
def thread(spark, sf_dir):
    rows = fx.messages(spark, sf_dir)
    openings = rows.where(F.col("role") == "assistant").select("conv_id", "msg_id")
    return threads.thread(rows, openings, depth=1)


@query
def labelled_thread(spark, sf_dir):
    """Every message's neighbourhood by interval labels, half of them updated by an import."""
    rows, path = fx.messages(spark, sf_dir), scratch_path(spark, "labels")
    late = rows.where((F.col("conv_id").cast("long") % 2 == 0) & (F.col("msg_id").cast("long") >= 3))
    thread_index.write_labels(rows.join(late.select("conv_id", "msg_id"), ["conv_id", "msg_id"], "left_anti"), path)
    thread_index.update_labels(rows, late, path)
    return thread_index.labelled_thread(rows, thread_index.read_labels(spark, path), rows.select("conv_id", "msg_id"), depth=2)


def _with_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages whose first turn answers the fourth, if there is one, and turn 5 itself."""
    rows = fx.messages(spark, sf_dir)
    parent = F.when(F.col("msg_id") == "0", F.lit("3")).when(F.col("msg_id") == "5", F.lit("5")).otherwise(F.col("parent_id"))
    return rows.withColumn("parent_id", parent)


@query
def thread_cycles(spark, sf_dir):
    rows = _with_cycles(spark, sf_dir)
    return threads.ancestor_links(rows, rows.select("conv_id", "msg_id"))


@query
def thread_last_messages(spark, sf_dir):
    """Neighbourhood of one anchor per conversation, its latest message."""
    rows = fx.messages(spark, sf_dir)
    last = rows.groupBy("conv_id").agg(F.max_by("msg_id", "ts").alias("msg_id"))
    return threads.thread(rows, last, depth=2).drop("text")


# Filters

@query
def dynamic_where(spark, sf_dir):
    wanted = {"role": "user", "date_from": "2024-01-01T12:00:00", "date_to": "2024-01-04", "colour": "ignored"}
    return filters.search_filters(fx.messages(spark, sf_dir), wanted)


@query
def filter_ids(spark, sf_dir):
    rows = fx.messages(spark, sf_dir)
    replies = rows.where(F.col("role") == "assistant")
    ids = replies.select(F.concat_ws("/", "conv_id", "parent_id").alias("message_id"))
    return filters.by_ids(rows, ids).select("conv_id", "msg_id", "role", "ts")


@query
def tag_filter(spark, sf_dir):
    rows = fx.messages(spark, sf_dir)
    tags = rows.select("conv_id", "msg_id", F.explode(F.array(
        "role", F.when(F.length("text") > 500, "long").otherwise("short"))).alias("tag"))
    return filters.with_tags(rows, tags, ["assistant", "long"], match="all").select("conv_id", "msg_id")


@query
def validate_messages(spark, sf_dir):
    rows = fx.messages(spark, sf_dir)
    damaged = rows.withColumn("role", F.when(F.col("role") == "system", "moderator").otherwise(F.col("role"))) \
        .withColumn("text", F.when(F.length("text") >= 100, F.col("text")))
    known = fx.conversations(spark, sf_dir).where(F.col("owner_id") != "owner_2")
    rejected = filters.split_valid(damaged, known)[1]
    return rejected.select("conv_id", "msg_id", F.array_join("reason", ",").alias("reason"))


@query
def fk_orphans(spark, sf_dir):
    known = fx.conversations(spark, sf_dir).where(F.col("owner_id") != "owner_3")
    return filters.fk_orphans(fx.messages(spark, sf_dir), known).select("conv_id", "msg_id")


@query
def filter_owner(spark, sf_dir):
    return filters.owned_by(fx.conversations(spark, sf_dir), "owner_1")


@query
def filter_conv(spark, sf_dir):
    return filters.window(fx.document_messages(spark, sf_dir), conv_id="src3").select("conv_id", "msg_id", "ts")


@query
def filter_role(spark, sf_dir):
    return filters.search_filters(fx.messages(spark, sf_dir), {"role": "assistant"}).select("conv_id", "msg_id")


@query
def filter_ts_range(spark, sf_dir):
    rows = fx.messages(spark, sf_dir)
    return filters.window(rows, "2024-01-01T06:00:00+02:00", "2024-01-02").select("conv_id", "msg_id", "ts")


@query
def normalise_iso(spark, sf_dir):
    rows = fx.messages(spark, sf_dir)
    text = F.concat(F.date_format("ts", " yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z "))
    return rows.select("conv_id", "msg_id", iso_timestamp(text).cast("timestamp_ntz").alias("moment"))


@query
def split_message_id(spark, sf_dir):
    rows = fx.messages(spark, sf_dir).select(F.concat_ws("/", "conv_id", "msg_id", "role").alias("message_id"))
    conv_id, msg_id = tx.split_message_id(F.col("message_id"))
    return rows.select("message_id", conv_id.alias("conv_id"), msg_id.alias("msg_id"))


@query
def parent_child_self_join(spark, sf_dir):
    return threads.reply_pairs(fx.messages(spark, sf_dir)).select("conv_id", "msg_id", "reply_id", "reply_role")


@query
def conv_left_join_messages(spark, sf_dir):
    return browse.conversations_with_counts(fx.conversations(spark, sf_dir), fx.messages(spark, sf_dir))


@query
def message_orphans(spark, sf_dir):
    rows = fx.messages(spark, sf_dir)
    tags = rows.select("conv_id", "msg_id", F.col("role").alias("tag"))
    return filters.message_orphans(tags, rows.where(F.length("text") > 200))


@query
def anchor(spark, sf_dir):
    rows = fx.messages(spark, sf_dir)
    return threads.anchor_messages(rows, rows.where(F.col("role") == "user"))


@query
def missing_anchors(spark, sf_dir):
    rows = fx.messages(spark, sf_dir)
    next_turn = (F.col("msg_id").cast("int") + 1).cast("string")
    asked = rows.select("conv_id", next_turn.alias("msg_id")) \
        .union(rows.select(F.concat(F.lit("x"), "conv_id"), "msg_id"))
    return threads.missing_anchors(rows, asked)


@query
def tokenise(spark, sf_dir):
    words = F.array_join(F.sort_array(tx.topic_tokens(F.col("text"))), " ")
    return fx.document_messages(spark, sf_dir).select("msg_id", words.alias("tokens"))


@query
def canonical_text(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.lower(tx.strip_space(F.col("text"))).alias("canonical"))


@query
def shorten(spark, sf_dir):
    return fx.messages(spark, sf_dir).select("conv_id", "msg_id", tx.shorten(F.col("text")).alias("summary"))


# Search

@query
def cover_density_score(spark, sf_dir):
    rows = fx.document_messages(spark, sf_dir)
    return search.score_messages(rows, ["the", "than", "und"], stemmer=None).select("conv_id", "msg_id", "score")


@query
def search_simple(spark, sf_dir):
    hits = search.search(fx.messages(spark, sf_dir), "The tion, und der?", k=50, stemmer=None)
    return hits.drop("highlights")


@query
def search_filtered(spark, sf_dir):
    wanted = {"role": "system", "date_from": "2024-01-01T06:00:00"}
    hits = search.search(fx.messages(spark, sf_dir), "est que", k=200, filters=wanted, stemmer=None)
    return hits.drop("highlights")


@query
def search_documents(spark, sf_dir):
    hits = search.search(fx.document_messages(spark, sf_dir), "than from", k=100, stemmer=None, pad=False)
    return hits.drop("highlights")


@query
def search_english(spark, sf_dir):
    return search.search(fx.messages(spark, sf_dir), "the tioned things", k=50).drop("highlights")


def _label_queries(rows: DataFrame) -> DataFrame:
    """The window's top words, one query each: bounded, and found by Spark."""
    labels = topics.top_topics(rows, limit=20)
    return labels.select(F.col("label").alias("query_id"), F.col("label").alias("q"))


@query
def search_many_simple(spark, sf_dir):
    rows = fx.messages(spark, sf_dir)
    return search.search_many(rows, _label_queries(rows), k=10, stemmer=None)


@query
def search_many_postings(spark, sf_dir):
    rows = fx.document_messages(spark, sf_dir)
    index = write_scratch(search.build_postings(rows, stemmer=None), "postings")
    return search.search_many(rows, _label_queries(rows), k=10, stemmer=None, postings=index)


@query
def search_many_english(spark, sf_dir):
    rows = fx.messages(spark, sf_dir)
    wanted = write_scratch(_label_queries(rows), "queries")
    hits = search.search_many(rows, wanted, k=10, highlighted=True)
    return hits.withColumn("highlights", F.array_join("highlights", "\n"))


def light_stem(word: str) -> str:
    """A stemmer of one rule, which SQL can repeat: a final s or ed is dropped."""
    return word[:-2] if word.endswith("ed") else word[:-1] if word.endswith("s") else word


@query
def search_many_stemmer(spark, sf_dir):
    """Batch search with the caller's own stemmer and English stop words."""
    rows = fx.messages(spark, sf_dir)
    return search.search_many(rows, _label_queries(rows), k=10, stemmer=light_stem)


@query
def search_stemmer(spark, sf_dir):
    return search.search(fx.messages(spark, sf_dir), "tions the ored", k=50, stemmer=light_stem).drop("highlights")


@query
def search_none(spark, sf_dir):
    """A search for no results, and a batch search for none: both empty."""
    rows = fx.messages(spark, sf_dir)
    batch = search.search_many(rows, _label_queries(rows), k=0, stemmer=None).select("conv_id", "msg_id", "score")
    return search.search(rows, "tion", k=-3, stemmer=None).select("conv_id", "msg_id", "score").unionByName(batch) \
        .agg(F.count("*").alias("results"))


@query
def unusable_queries(spark, sf_dir):
    """Every message as a query; in every third turn only its marks are left."""
    rows = fx.messages(spark, sf_dir)
    marks = F.regexp_replace("text", r"[\p{L}\p{N}_]+", "")
    asked = rows.select(F.concat_ws("/", "conv_id", "msg_id").alias("query_id"),
                        F.when(F.col("msg_id").cast("int") % 3 == 0, marks).otherwise(F.col("text")).alias("q"))
    return search.unusable_queries(asked)


@query
def build_postings(spark, sf_dir):
    return search.build_postings(fx.messages(spark, sf_dir), stemmer=None)


@query
def english_lexemes(spark, sf_dir):
    words = vocabulary.vocabulary(fx.document_messages(spark, sf_dir))
    return words.groupBy("lexeme").agg(F.sum("n").alias("positions"))


@query
def build_postings_english(spark, sf_dir):
    """Postings of lexemes: words are counted per message, stemmed once and summed."""
    return search.build_postings(fx.messages(spark, sf_dir))


@query
def new_words(spark, sf_dir):
    """What the assistants' messages add to the vocabulary of the users' messages."""
    rows = fx.messages(spark, sf_dir)
    stored = vocabulary.vocabulary(rows.where(F.col("role") == "user")).select("word", "lexeme")
    return vocabulary.new_words(stored, rows.where(F.col("role") == "assistant"))


@query
def search_highlights(spark, sf_dir):
    terms = F.array(F.lit("tion"), F.lit("the"))
    return fx.messages(spark, sf_dir).select(
        "conv_id", "msg_id", F.array_join(highlights(F.col("text"), terms), "\n").alias("highlights"))


# Packs and prompts

def _requests(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(F.col("conv_id").alias("pack_id"), F.concat_ws("/", "conv_id", "msg_id").alias("message_id"), *more)


@query
def context_pack(spark, sf_dir):
    rows = fx.messages(spark, sf_dir)
    return packs.context_pack(rows, _requests(rows))


@query
def context_pack_truncated(spark, sf_dir):
    rows = fx.messages(spark, sf_dir)
    return packs.context_pack(rows, _requests(rows), max_tokens=200)


@query
def context_pack_documents(spark, sf_dir):
    rows = fx.document_messages(spark, sf_dir)
    return packs.context_pack(rows, _requests(rows), max_tokens=16384)


@query
def pack_rejects(spark, sf_dir):
    """Packs whose requests carry missing, differing or impossible budgets."""
    rows = fx.messages(spark, sf_dir)
    turn, conv = F.col("msg_id").cast("int"), F.col("conv_id").cast("int")
    budget = F.when((conv % 5 == 0) & (turn == 1), F.lit(None)).when(conv % 5 == 1, 200 + turn) \
        .when(conv % 5 == 2, conv - 50).when(conv % 5 == 3, 16000 + 100 * conv).otherwise(F.lit(6000))
    return packs.pack_rejects(_requests(rows.withColumn("max_tokens", budget), "max_tokens"))


@query
def context_pack_budgets(spark, sf_dir):
    """A budget of its own for every pack; impossible ones give no pack."""
    rows = fx.messages(spark, sf_dir)
    budget = F.col("conv_id").cast("int") * 7 - 20
    return packs.context_pack(rows, _requests(rows.withColumn("max_tokens", budget), "max_tokens"), max_tokens=400, largest=400)


@query
def format_pack_line(spark, sf_dir):
    return fx.messages(spark, sf_dir).select("conv_id", "msg_id", packs.pack_line().alias("line"),
                                             minute_text(F.col("ts")).alias("minute"))


@query
def build_prompts(spark, sf_dir):
    rows = fx.messages(spark, sf_dir)
    wanted = write_scratch(_label_queries(rows), "queries")
    history = wanted.select("query_id", F.lit(1).alias("turn"), F.lit("user").alias("role"),
                            F.lit("Hello").alias("content"))
    return prompts.build_prompts(rows, wanted, " Answer briefly. ", history=history, stemmer=None)


@query
def pack_running_tokens(spark, sf_dir):
    rows = fx.messages(spark, sf_dir).select("conv_id", "msg_id", "ts", estimate_tokens(packs.pack_line()).alias("tokens"))
    slabs = ordered.write_slabs(rows, ["conv_id"], ["ts", "msg_id"], F.col("tokens"))
    return ordered.running_sum(slabs, ["conv_id"], ["ts", "msg_id"], "used", below=300)


@query
def memory_block(spark, sf_dir):
    rows = fx.messages(spark, sf_dir)
    return prompts.memory_block(search.search_many(rows, _label_queries(rows), k=5, stemmer=None))


# Loads

@query
def dedupe_by_key(spark, sf_dir):
    docs = fx.document_messages(spark, sf_dir).select(content_hash_of(F.col("text")).alias("hash"), "ts", "msg_id")
    return loads.dedupe_by_key(docs, ["hash"], ["ts", "msg_id"])


@query
def insert_ignore(spark, sf_dir):
    rows = fx.messages(spark, sf_dir)
    stored = rows.where(F.col("role") == "user")
    return loads.insert_ignore(stored, rows.unionByName(rows), order=["ts"])


@query
def upsert_title(spark, sf_dir):
    rows = fx.conversations(spark, sf_dir)
    stored = rows.where(F.col("owner_id").isin("owner_0", "owner_1"))
    incoming = rows.where(F.col("owner_id") != "owner_0") \
        .select("conv_id", F.concat(F.lit("New "), F.col("conv_id")).alias("title"), F.lit("importer").alias("owner_id"))
    return loads.upsert_title(stored, incoming)


@query
def cascade_delete(spark, sf_dir):
    rows = fx.messages(spark, sf_dir)
    deleted = rows.where(F.col("role") == "system").select("conv_id")
    return loads.cascade_delete(deleted, messages=rows)["messages"].select("conv_id", "msg_id")


def _exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as export conversations: one JSON object per document."""
    docs = fx.document_messages(spark, sf_dir)
    message = F.struct(
        F.struct(F.lit("assistant").alias("role")).alias("author"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("create_time"),
        F.struct(F.array("text").alias("parts")).alias("content"),
        F.lit("model-1").alias("model"))
    node = F.struct(F.lit("root").alias("parent"), message.alias("message"))
    body = F.struct(F.col("conv_id").alias("id"), F.concat(F.lit("From "), F.col("conv_id")).alias("title"),
                    F.create_map("msg_id", node).alias("mapping"))
    return docs.select(
        F.col("conv_id").alias("archive"), F.lit("2024-06-01").cast("timestamp").alias("modified"),
        F.col("msg_id").cast("bigint").alias("ordinal"), F.to_json(body).alias("conversation"),
        F.lit(None).cast("string").alias("error"))


def _shaped_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as export conversations whose messages have six different shapes."""
    docs = fx.document_messages(spark, sf_dir)
    shape = F.col("msg_id").cast("bigint") % 6
    minute = F.unix_timestamp(F.col("ts").cast("timestamp")).alias("create_time")
    stamp = F.lit("2024-02-03T04:05:06Z").alias("timestamp")
    author = F.struct(F.lit("assistant").alias("role")).alias("author")
    image = F.struct(F.lit(1).alias("image"))
    parts = F.concat(F.lit('{"parts":['), F.to_json(F.array("text")).substr(F.lit(2), F.length(F.to_json(F.array("text"))) - 2),
                     F.lit(","), F.to_json(image), F.lit(',"end"]}'))
    members = lambda *fields: F.substring(F.to_json(F.struct(*fields)), 2, (1 << 31) - 1)
    message = (
        F.when(shape == 0, F.concat(F.lit('{"content":'), parts, F.lit(","), members(author, minute)))
        .when(shape == 1, F.to_json(F.struct(F.concat(F.lit("m"), "msg_id").alias("id"), F.lit("tool").alias("role"), stamp,
                                             F.col("text").alias("content"))))
        .when(shape == 2, F.to_json(F.struct(F.struct(F.col("msg_id").cast("bigint").alias("n")).alias("content"), stamp,
                                             F.concat(F.lit("p"), "msg_id").alias("parent"))))
        .when(shape == 3, F.concat(F.lit('{"content":null,'), members(F.col("text"))))
        .when(shape == 4, F.to_json(F.struct("text", author)))
        .otherwise(F.lit('{"model":"x"}')))
    started = F.when(shape == 3, F.lit('"create_time":1700000000,')).otherwise(F.lit(""))
    body = F.concat(F.lit('{"id":"'), "conv_id", F.lit('",'), started, F.lit('"mapping":{"'), "msg_id",
                    F.lit('":{"parent":"root","message":'), message, F.lit("}}}"))
    return docs.select(
        F.col("conv_id").alias("archive"), F.lit(None).cast("timestamp").alias("modified"),
        F.col("msg_id").cast("bigint").alias("ordinal"), body.alias("conversation"), F.lit(None).cast("string").alias("error"))


@query
def normalise_shapes(spark, sf_dir):
    """Every content shape, time field and fallback; messages without any time take the time of the import."""
    parsed, _ = ingest.parse_exports(_shaped_exports(spark, sf_dir))
    rows = ingest.normalise_messages(ingest.explode_messages(parsed), ingest_ts=F.lit("2024-06-01").cast("timestamp"))
    return rows.select("conv_id", "msg_id", "role", F.col("ts").cast("timestamp_ntz").alias("ts"), "text", "parent_id", "hash")


def _stored_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.table(spark, sf_dir, "documents").where(F.col("lang") == "en")
    return docs.select(F.col("source").alias("conv_id"), F.col("doc_id").cast("string").alias("msg_id"))


@query
def normalise_export(spark, sf_dir):
    parsed, _ = ingest.parse_exports(_exports(spark, sf_dir))
    rows = ingest.normalise_messages(ingest.explode_messages(parsed))
    return rows.select("conv_id", "msg_id", "role", F.col("ts").cast("timestamp_ntz").alias("ts"), "text",
                       "parent_id", "hash", F.col("meta.model").alias("model"), F.col("meta.source").alias("source"))


@query
def ingest_export(spark, sf_dir):
    none = fx.conversations(spark, sf_dir).where(F.lit(False))
    done = ingest.ingest_export(_exports(spark, sf_dir), none, _stored_english(spark, sf_dir))
    return done.new_messages.select("conv_id", "msg_id", "hash")


@query
def import_summary(spark, sf_dir):
    none = fx.conversations(spark, sf_dir).where(F.lit(False))
    return ingest.ingest_export(_exports(spark, sf_dir), none, _stored_english(spark, sf_dir)).summary


def _export_folder(spark: SparkSession, sf_dir: str) -> str:
    folder = scratch_path(spark, "drop")
    _exports(spark, sf_dir).select("conversation").write.text(folder)
    return folder


@query
def read_export_json(spark, sf_dir):
    raw = archives.read_exports(spark, _export_folder(spark, sf_dir))
    parsed, _ = ingest.parse_exports(raw)
    return ingest.project_conversations(parsed).groupBy("conv_id", "title", "owner_id") \
        .agg(F.count("*").alias("conversations"))


@query
def read_export_zip(spark, sf_dir):
    folder = scratch_path(spark, "archives")
    fx.write_archives(_exports(spark, sf_dir), folder)
    parsed, _ = ingest.parse_exports(archives.read_exports(spark, folder))
    rows = ingest.normalise_messages(ingest.explode_messages(parsed))
    return rows.select("conv_id", "msg_id", "hash")


def _named_archives(spark: SparkSession, sf_dir: str) -> str:
    """A folder with an archive for every 200 documents, and a broken one for every 2,000."""
    folder = scratch_path(spark, "archives")
    rows = _exports(spark, sf_dir)
    part = F.floor(F.col("ordinal") / 200).cast("string")
    good = rows.select(F.concat(F.lit("export-"), part).alias("name"), "conversation")
    broken = rows.where(F.col("ordinal") % 2000 == 0).select(
        F.concat(F.lit("broken-"), F.floor(F.col("ordinal") / 2000).cast("string")), F.lit(None).cast("string"))
    fx.write_archives(good.union(broken), folder, "name")
    return folder


def _file_name(column: str):
    return F.element_at(F.split(column, "/"), -1).alias(column)


@query
def list_archives(spark, sf_dir):
    listed = archives.list_archives(spark, _named_archives(spark, sf_dir))
    return listed.select(_file_name("archive"), "member", "status")


def _read_rows(raw: DataFrame) -> DataFrame:
    """Keys and hashes of the messages read, and the broken archives with their error."""
    parsed, rejects = ingest.parse_exports(raw)
    rows = ingest.normalise_messages(ingest.explode_messages(parsed))
    return rows.select("conv_id", "msg_id", "hash", F.lit(None).cast("string").alias("broken"), F.lit(None).cast("string").alias("reason")) \
        .union(rejects.select(F.lit(None), F.lit(None), F.lit(None), _file_name("archive"), "reason"))


@query
def chat_export(spark, sf_dir):
    """Archives read through the registered data source."""
    register(spark)
    return _read_rows(spark.read.format("chat_export").load(_named_archives(spark, sf_dir)).repartition("archive", "ordinal"))


@query
def chat_export_pruned(spark, sf_dir):
    """Conversations per archive, for archives chosen by name: the others are not opened, the texts stay behind."""
    register(spark)
    raw = spark.read.format("chat_export").schema("archive string, ordinal long").load(_named_archives(spark, sf_dir))
    return raw.where(F.col("archive").contains("/export-") & F.col("archive").endswith("0.zip")).groupBy(_file_name("archive")).agg(F.count("*").alias("conversations"))


@query
def chat_export_stream(spark, sf_dir):
    """Archives read by a stream, in two runs of which the second finds nothing new."""
    register(spark)
    folder, found, state = _named_archives(spark, sf_dir), scratch_path(spark, "arrived"), scratch_path(spark, "arrivals")
    for _ in range(2):
        arrivals = spark.readStream.format("chat_export").option("log", f"{state}/log").option("max_files", 7).load(folder)
        arrivals.repartition("archive", "ordinal").writeStream.format("parquet").option("checkpointLocation", f"{state}/offsets") \
            .trigger(availableNow=True).start(found).awaitTermination()
    return _read_rows(spark.read.parquet(found))


def _streamed_root(spark: SparkSession, sf_dir: str) -> str:
    root = scratch_path(spark, "tables")
    folder = _export_folder(spark, sf_dir)
    for run in ("first", "second"):  # the second run re-imports everything and must add nothing
        streams.stream_ingest(spark, folder, root, scratch_path(spark, f"offsets-{run}")).awaitTermination()
    return root


@query
def stream_ingest(spark, sf_dir):
    rows = read_table(spark, _streamed_root(spark, sf_dir), "messages")
    return rows.select("conv_id", "msg_id", "role", F.col("ts").cast("timestamp_ntz").alias("ts"), "text", "hash")


@query
def stream_ingest_conversations(spark, sf_dir):
    return read_conversations(spark, _streamed_root(spark, sf_dir)).select("conv_id", "title", "owner_id")


@query
def stream_embed(spark, sf_dir):
    root = _streamed_root(spark, sf_dir)
    for _ in range(2):
        streams.stream_embed(spark, root, scratch_path(spark, "offsets-embed"), letter_counts, len(LETTERS),
                             "letters").awaitTermination()
    done = read_table(spark, root, "message_embeddings")
    return done.select("conv_id", "msg_id", "model", _numbers("embedding"))


# Vectors

LETTERS = "abcdehinorstu"


def letter_counts(texts) -> np.ndarray:
    """An embedder that SQL can repeat: how often each of some letters occurs."""
    return np.array([[t.count(c) for c in LETTERS] for t in texts], dtype=np.float32).reshape(len(texts), len(LETTERS))


def _numbers(column: str):
    return F.array_join(F.transform(column, lambda x: x.cast("int").cast("string")), ",").alias("vector")


@query
def embed_messages(spark, sf_dir):
    rows = fx.messages(spark, sf_dir)
    done = rows.where(F.col("role") == "user").select("conv_id", "msg_id")
    made = vectors.embed_messages(rows, done, letter_counts, len(LETTERS), "letters", delay=0)
    return made.select("conv_id", "msg_id", "model", _numbers("embedding"))


def _label_centres(stored: DataFrame) -> DataFrame:
    """The mean vector of each label as queries."""
    means = stored.select("label", F.posexplode("embedding").alias("i", "x")) \
        .groupBy("label", "i").agg(F.avg("x").alias("x"))
    centres = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c")) \
        .select(F.col("label").alias("query_id"), F.transform("c", lambda p: p["x"]).alias("embedding"))
    return write_scratch(centres, "centres")


@query
def vector_search(spark, sf_dir):
    """Nearest vectors to the mean of each label."""
    stored = fx.table(spark, sf_dir, "embeddings")
    hits = vectors.vector_search(stored, _label_centres(stored), k=10, ids=["vec_id"])
    return hits.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


def _asked_vectors(stored: DataFrame) -> DataFrame:
    return stored.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), "embedding")


@query
def vector_search_many(spark, sf_dir):
    """Nearest vectors of every twentieth vector."""
    stored = fx.table(spark, sf_dir, "embeddings")
    hits = vectors.vector_search(stored, _asked_vectors(stored), k=10, ids=["vec_id"])
    return hits.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@query
def vector_index(spark, sf_dir):
    """How many of the exact best ten the cell index finds, and how many vectors it reads, for every twentieth vector."""
    stored = fx.table(spark, sf_dir, "embeddings")
    asked = _asked_vectors(stored)
    index = vector_cells.build_index(stored, scratch_path(spark, "cells"), ids=["vec_id"])
    exact = write_scratch(vectors.vector_search(stored, asked, k=10, ids=["vec_id"]), "exact")
    return vector_cells.search_quality(index, asked, exact, k=10)


@query
def vector_index_whole(spark, sf_dir):
    """A search of all cells of the index is the exact search."""
    stored = fx.table(spark, sf_dir, "embeddings")
    index = vector_cells.build_index(stored, scratch_path(spark, "cells"), ids=["vec_id"])
    hits = vector_cells.search_index(index, _label_centres(stored), k=10, probes=len(index.centres))
    return hits.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@query
def hybrid_search(spark, sf_dir):
    rows = fx.messages(spark, sf_dir)
    wanted = write_scratch(_label_queries(rows), "queries")
    made = write_scratch(vectors.embed_messages(rows, rows.where(F.lit(False)), letter_counts, len(LETTERS), "letters"), "vectors")
    hits = vectors.hybrid_search(rows, made, wanted, letter_counts, len(LETTERS), k=10, stemmer=None)
    return hits.select("query_id", "rank", "conv_id", "msg_id", "word_rank", "vector_rank", F.round("score", 8).alias("score"))
