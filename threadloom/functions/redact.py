"""PII redaction as JVM regular expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from threadloom.functions.text import SPACE_SET, WORD, safe_text

# One e-mail hit covers a whole run of non-blank characters, so the pattern is
# anchored at the start of the run: linear even on very long runs.
_EMAIL = f"(?<![^{SPACE_SET}])[^{SPACE_SET}][^{SPACE_SET}@]*+@[^{SPACE_SET}]++"
# The first digit is matched before the look-behind, which then runs on digits only.
_DIGIT = r"\p{Nd}"
_START = f"{_DIGIT}(?<!{WORD}{_DIGIT})"
_PHONE = rf"{_START}{_DIGIT}{{2}}[-.]?{_DIGIT}{{3}}[-.]?{_DIGIT}{{4}}(?!{WORD})"
_IPV4 = rf"{_START}{_DIGIT}{{0,2}}(?:\.{_DIGIT}{{1,3}}){{3}}(?!{WORD})"
_URL = r"https?://[a-z!$-_]++"

# The kinds in the order they are applied, and their markers.
KINDS = [
    ("email", _EMAIL, "«EMAIL»"),
    ("phone", _PHONE, "«PHONE»"),
    ("ip", _IPV4, "«IP»"),
    ("url", _URL, "«URL»"),
]


def _replace(text: Column, kind: str, pattern: str, marker: str) -> Column:
    replaced = F.regexp_replace(text, pattern, marker)
    # Most texts hold no @ and skip the pattern that looks at every run of characters.
    return F.when(F.contains(text, F.lit("@")), replaced).otherwise(text) if kind == "email" else replaced


def redact(col: Column, enable_pii: bool = True) -> Column:
    text = safe_text(col)
    if enable_pii:
        for kind, pattern, marker in KINDS:
            text = _replace(text, kind, pattern, marker)
    return text


def redact_table(df: DataFrame, column: str = "text", enable_pii: bool = True) -> DataFrame:
    """Replace ``column`` by its redacted form and add one hit count per kind."""
    staged = df.withColumn("_step", safe_text(F.col(column)))
    for kind, pattern, marker in KINDS:
        if not enable_pii:
            staged = staged.withColumn(f"{kind}_hits", F.lit(0))
            continue
        # A hit can only exist where the marker was written, so untouched rows skip the count.
        staged = (
            staged.withColumn("_next", _replace(F.col("_step"), kind, pattern, marker))
            .withColumn(f"{kind}_hits", F.when(F.col("_next") == F.col("_step"), F.lit(0))
                        .otherwise(F.regexp_count(F.col("_step"), F.lit(pattern))))
            .withColumn("_step", F.col("_next")).drop("_next")
        )
    return staged.withColumn(column, F.col("_step")).drop("_step")
