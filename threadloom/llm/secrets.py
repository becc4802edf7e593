"""Secrets in text, with column functions only: strong patterns and linked parts.

Strong matches (``assign``, ``access``, ``hex``) are always reported. A weak
candidate - an identifier, a secret-looking value or an endpoint - says little on its
own; it is reported only when a complementary part stands within ``scope`` characters
of it in the same text. That test is an interval join: parts are laid on cells of
``scope`` characters, reduced to one interval per text, cell and part, and each weak
candidate meets the cells around it. No pairs within a text are formed, so a text
full of parts costs no more than its length.

Defined cases: a null text counts as empty; equal texts have equal spans, so parts are
keyed by a digest of the text and repeated rows or equal ids do no harm; a weak
candidate inside a strong span is not reported again; spans are in code points, end
exclusive; an empty table gives an empty result; the columns that an operator adds replace
input columns of the same name, others are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from threadloom.llm.rows import boxed, text_of, unboxed
from threadloom.session import broadcast_if_small

# Strong patterns, in the order in which kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
STRONG = [("assign", ASSIGN, "secret"), ("access", ACCESS, "id"), ("hex", HEX, "secret")]

# Weak patterns with the part of a credential that they stand for.
WEAK = [
    ("link_id", r"""(?i)(?<![A-Za-z0-9_])(?:user(?:_?name|_?id)?|login|client_?id|access_?key(?:_?id)?|account_?id)["']?"""
                r"""\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@=-]{3,}""", "id"),
    ("link_secret", r"""(?i)(?<![A-Za-z0-9_])(?:(?:pwd|pass(?:phrase|code)?|credential|auth(?:orization)?|private_?key|"""
                    r"""signature)["']?\x20*[:=]\x20*|bearer\x20+)["']?(?=[A-Za-z+/_.=-]{0,200}[0-9])[A-Za-z0-9+/_.=-]{6,}""",
     "secret"),
    ("link_endpoint", r"""(?i)(?:https?|ftp|sftp|ssh|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D"'<>]+|"""
                      r"""(?<![A-Za-z0-9_])(?:host(?:name)?|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:/_-]{3,}""", "endpoint"),
]
KINDS = [kind for kind, _, _ in STRONG + WEAK]
COMPLEMENT = {"id": ["secret"], "secret": ["id", "endpoint"], "endpoint": ["secret"]}
SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _possible(text: Column, kind: str) -> Column:
    """Whether a text has the characters that every match of the kind contains: cheaper than its pattern."""
    if kind == "hex":
        return F.lit(True)
    if kind == "access":
        return text.contains("AKIA")
    assigned = text.contains("=") | text.contains(":")
    return assigned | F.lower(text).contains("bearer ") if kind == "link_secret" else assigned


def pattern_spans(text: Column, pattern: str, kind: str, min_group2: int = 0) -> Column:
    """Spans of the leftmost non-overlapping matches: the pieces between matches give the positions."""
    pieces = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    lengths = F.transform(whole, lambda x: F.char_length(x))
    values = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda x: F.char_length(x)) \
        if min_group2 else lengths
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
    rank = KINDS.index(kind)

    def step(seen: Column, m: Column) -> Column:
        begin = seen.at + m.gap
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), (begin + m.size).alias("end"),
                        F.lit(kind).alias("kind"))
        out = F.when(m.value >= min_group2, F.array_append(seen.out, span)).otherwise(seen.out)
        return F.struct((begin + m.size).alias("at"), out.alias("out"))

    matches = F.transform(
        F.arrays_zip(pieces.alias("gap"), lengths.alias("size"), values.alias("value")), lambda m: m)
    found = F.aggregate(F.filter(matches, lambda m: m.size.isNotNull()), start, step)["out"]
    return F.when(_possible(text, kind) & text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(
        ":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def scan(docs: DataFrame, scope: int = 200) -> DataFrame:
    """``docs`` with base_spans (strong) and spans (strong and linked), both sorted arrays of structs."""
    return unboxed(_scanned(docs, scope), docs.columns, ["base_spans", "spans"])


def _scanned(docs: DataFrame, scope: int) -> DataFrame:
    """The rows as one column each, beside base_spans and spans."""
    strong = F.sort_array(F.concat(*[pattern_spans(F.col("body"), rx, kind, 6 if kind == "assign" else 0)
                                     for kind, rx, _ in STRONG]))
    weak = F.concat(*[pattern_spans(F.col("body"), rx, kind) for kind, rx, _ in WEAK])
    has_weak = _possible(F.col("body"), "link_secret") & F.col("body").rlike("|".join(f"(?:{rx})" for _, rx, _ in WEAK))
    read = boxed(docs, body=text_of())
    # Few texts have a weak candidate: only their parts are listed and linked.
    parts = read.where(has_weak).select(F.sha2("body", 256).alias("key"), strong.alias("base_spans"), weak.alias("weak")) \
        .withColumn("weak", F.filter("weak", lambda w: ~F.exists(
            F.col("base_spans"), lambda b: (b.start < w.end) & (w.start < b.end)))) \
        .select("key", F.explode(F.concat("base_spans", "weak")).alias("s")).select("key", "s.*")
    # Links are few: sent to the texts if they measure small, else met in a join that spreads the texts without any.
    links = broadcast_if_small(_links(parts, scope))
    keyed = read.select("row", strong.alias("base_spans"), F.when(has_weak, F.sha2("body", 256)).otherwise(
        F.xxhash64("body").cast("string")).alias("text_key"))
    return keyed.join(links, F.col("text_key") == F.col("key"), "left").select("row", "base_spans", F.sort_array(F.concat(
        "base_spans", F.coalesce(F.col("links"), F.array().cast(SPAN)))).alias("spans"))


def _links(parts: DataFrame, scope: int) -> DataFrame:
    """Weak parts that have a complementary part within ``scope``, as one array per text."""
    part_of = F.create_map(*[F.lit(x) for kind, _, part in STRONG + WEAK for x in (kind, part)])
    parts = parts.distinct().withColumn("part", part_of[F.col("kind")])
    cell_of = lambda c: F.floor(c / scope)
    cells = (
        parts.withColumn("cell", F.explode(F.sequence(cell_of(F.col("start")), cell_of(F.col("end") - 1))))
        .groupBy("key", "cell", F.col("part").alias("other"))
        .agg(F.min(F.greatest("start", F.col("cell") * scope)).alias("low"),
             F.max(F.least("end", (F.col("cell") + 1) * scope)).alias("high"))
    )
    weak = parts.where(F.col("kind").isin([kind for kind, _, _ in WEAK])).withColumn(
        "cell", F.explode(F.sequence(cell_of(F.col("start")) - 1, cell_of(F.col("end") - 1) + 1)))
    wanted = F.create_map(*[x for part, others in COMPLEMENT.items()
                            for x in (F.lit(part), F.array(*map(F.lit, others)))])
    met = weak.join(cells, ["key", "cell"]).where(
        F.array_contains(wanted[F.col("part")], F.col("other"))
        & (F.col("low") - F.col("end") <= scope) & (F.col("start") - F.col("high") <= scope))
    spans = met.select("key", F.struct("start", "rank", "end", "kind").alias("span")).distinct()
    return spans.groupBy("key").agg(F.collect_list("span").alias("links"))


def redacted(docs: DataFrame, mask: str = "[SECRET]", scope: int = 200) -> DataFrame:
    """Every document, the spans of its secrets replaced by ``mask``; columns as given."""
    text = F.col("row.text")

    def step(seen: Column, s: Column) -> Column:
        gap = F.substring(text, seen.at + 1, s.start - seen.at)
        return F.struct(F.greatest(seen.at, s.end).alias("at"),
                        F.when(s.start >= seen.at, F.concat(seen.out, gap, F.lit(mask))).otherwise(seen.out).alias("out"))

    masked = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                         lambda x: F.concat(x.out, F.substring(text, x.at + 1, F.char_length(text))))
    found = _scanned(docs, scope).withColumn("masked", F.when(F.size("spans") > 0, masked))
    changes = {"text": F.coalesce("masked", text)}
    if "n_chars" in docs.columns:
        changes["n_chars"] = F.when(F.col("masked").isNull(), F.col("row.n_chars")).otherwise(
            F.char_length("masked").cast(docs.schema["n_chars"].dataType))
    return found.select(*[changes.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
