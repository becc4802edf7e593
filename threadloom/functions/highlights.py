"""Highlighted excerpts of search hits, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def any_term(terms: Column) -> Column:
    """Pattern for any of the literal terms, whatever the case."""
    literal = F.transform(terms, lambda t: F.concat(F.lit("\\Q"), F.replace(t, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    return F.concat(F.lit("(?iu)"), F.array_join(literal, "|"))


def highlights(text: Column, terms: Column, window: int = 40, limit: int = 3) -> Column:
    """Up to ``limit`` excerpts of ``window`` characters on either side of a marked hit.

    What stands between the hits gives their places. From left to right a hit is shown if its
    surroundings do not reach into the excerpt before; only shown hits cut the text.
    """
    given = F.filter(terms, lambda t: t != "")
    pattern = any_term(given)
    between = F.split(text, pattern)
    hits = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)),
                       lambda hit, i: F.struct(F.length(F.get(between, i)).alias("gap"), hit.alias("hit")))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("shown_to"), F.length(text).alias("size"),
                     F.array().cast("array<string>").alias("found"))

    def step(state: Column, hit: Column) -> Column:
        first = state["at"] + hit["gap"]
        end = first + F.length(hit["hit"])
        low, high = F.greatest(first - window, F.lit(0)), F.least(end + window, state["size"])
        excerpt = F.concat(F.when(low > 0, "…").otherwise(""), text.substr(low + 1, first - low), F.lit("**"), hit["hit"], F.lit("**"),
                           text.substr(end + 1, high - end), F.when(high < state["size"], "…").otherwise(""))
        shown = (F.size(state["found"]) < limit) & (low >= state["shown_to"])
        return F.struct(end.alias("at"), F.when(shown, high).otherwise(state["shown_to"]).alias("shown_to"),
                        state["size"].alias("size"),
                        F.when(shown, F.concat(state["found"], F.array(excerpt))).otherwise(state["found"]).alias("found"))

    found = F.aggregate(hits, start, step, lambda state: state["found"])
    return F.when((F.size(given) > 0) & (F.length(text) > 0), found).otherwise(F.array().cast("array<string>"))
