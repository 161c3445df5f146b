"""Text views for matching, as column expressions.

:func:`exact_views` is what ingestion uses: built-in functions for ASCII texts, the
full Unicode definitions (NFC, case folding, removal of non-spacing marks) in an
Arrow-batched function for the others. :func:`views` is the built-in path alone;
it is exact for ASCII and close for other Latin text.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACES = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"
DIGITS = r"(\p{Nd}+)"
VIEWS = ("unicode", "clean", "punct", "accent_fold")
#: Literals that a delimited-text reader takes for a missing value.
MISSING_LITERALS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def latin_folds() -> tuple[str, str]:
    """Letters up to U+024F that are a base letter with marks, and those base letters."""
    pairs = []
    for code in range(0xC0, 0x250):
        parts = unicodedata.normalize("NFD", chr(code))
        base = "".join(c for c in parts if unicodedata.category(c) != "Mn")
        if base != chr(code) and len(base) == 1:
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FOLD_FROM, FOLD_TO = latin_folds()


def or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACES, " "))


def casefold(c: Column) -> Column:
    return F.replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def clean(c: Column) -> Column:
    return whitespace(casefold(or_empty(c)))


def punctuation(c: Column) -> Column:
    """'&' becomes 'and'; hyphens inside words stay; other punctuation becomes a space."""
    spelled = F.replace(c, F.lit("&"), F.lit(" and "))
    loose = F.regexp_replace(spelled, r"(?<![\p{L}\p{N}_])-|-(?![\p{L}\p{N}_])", " ")
    return whitespace(F.regexp_replace(loose, r"[\p{P}&&[^-]]", " "))


def accent_fold(c: Column) -> Column:
    return F.translate(F.regexp_replace(c, r"\p{Mn}", ""), FOLD_FROM, FOLD_TO)


def numeric_tokens(raw: Column) -> Column:
    """All digit runs in order, duplicates kept, joined by spaces."""
    return F.array_join(F.regexp_extract_all(or_empty(raw), F.lit(DIGITS), F.lit(1)), " ")


def word_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(whitespace(c), " "), lambda t: t != ""))


def views(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Adds ``prefix``_norm_unicode, _clean, _punct and _accent_fold of ``column``."""
    df = df.withColumns({f"{prefix}_norm_unicode": or_empty(F.col(column)), f"{prefix}_norm_clean": clean(F.col(column))})
    return df.withColumns({f"{prefix}_norm_punct": punctuation(F.col(f"{prefix}_norm_clean")), f"{prefix}_norm_accent_fold": accent_fold(F.col(f"{prefix}_norm_clean"))})


def exact_text(value: str | None) -> tuple[str, str, str, str]:
    """(unicode, clean, punct, accent_fold) by the full Unicode definitions."""
    if value is None:
        return ("", "", "", "")
    composed = unicodedata.normalize("NFC", value)
    tidy = " ".join(composed.casefold().split())
    spelled = tidy.replace("&", " and ")
    is_word = lambda ch: ch == "_" or unicodedata.category(ch)[0] in "LN"
    out = []
    for i, ch in enumerate(spelled):
        inner = ch == "-" and 0 < i < len(spelled) - 1 and is_word(spelled[i - 1]) and is_word(spelled[i + 1])
        out.append(ch if inner or unicodedata.category(ch)[0] != "P" else " ")
    folded = "".join(ch for ch in unicodedata.normalize("NFD", tidy) if unicodedata.category(ch) != "Mn")
    return composed, tidy, " ".join("".join(out).split()), folded


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in VIEWS]))
def exact_udf(values: pd.Series) -> pd.DataFrame:
    codes, distinct = pd.factorize(values)
    rows = [exact_text(v) for v in distinct]
    return pd.DataFrame([rows[k] if k >= 0 else (None,) * len(VIEWS) for k in codes], columns=list(VIEWS))


def exact_views(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Like :func:`views`, by the full definitions. Only texts with other than ASCII characters are sent to the batched function, the rest as nulls."""
    other = F.coalesce(F.col(column).rlike(r"[^\x00-\x7f]"), F.lit(False))
    marked = df.withColumn("_other", other)
    native = views(marked.withColumn("_v", exact_udf(F.when(F.col("_other"), F.col(column)))), column, prefix)
    return native.withColumns({f"{prefix}_norm_{n}": F.when(F.col("_other"), F.col(f"_v.{n}")).otherwise(F.col(f"{prefix}_norm_{n}")) for n in VIEWS}).drop("_other", "_v")


def is_missing(c: Column) -> Column:
    """Null, blank, or one of the literals that a reader takes for a missing value."""
    return c.isNull() | F.trim(c).isin(*MISSING_LITERALS)


def match_bucket(n: Column) -> Column:
    """ZERO_MATCH, SINGLE_MATCH or MULTI_MATCH; a negative count is an error."""
    return F.when(n < 0, F.raise_error(F.lit("negative match count"))).when(n == 0, "ZERO_MATCH").when(n == 1, "SINGLE_MATCH").otherwise("MULTI_MATCH")


def source_pattern(ids: Column) -> Column:
    """NONE, S2_ONLY, S3_ONLY or BOTH by the prefixes of an id array."""
    s2, s3 = F.exists(ids, lambda x: x.startswith("S2-")), F.exists(ids, lambda x: x.startswith("S3-"))
    return F.when(s2 & s3, "BOTH").when(s2, "S2_ONLY").when(s3, "S3_ONLY").otherwise("NONE")


def id_list(joined: Column) -> Column:
    """The ids of a comma list, distinct; none for an empty one."""
    return F.array_distinct(F.filter(F.transform(F.split(or_empty(joined), ","), lambda x: F.trim(x)), lambda x: x != ""))
