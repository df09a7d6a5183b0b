"""Text expressions: printing values, tokenising, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# The markers of a serialized entity.
COL_TAG = "[COL] "
VAL_TAG = "[VAL] "
PAIR_SEPARATOR = " [SEP] "

# Fixed value: a token is a run of two or more word characters.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"

_FLOATING = (T.DoubleType, T.FloatType)


def _double_text(col: Column) -> Column:
    """Shortest decimal text: plain digits from 1e-4 up to 1e16, else 1.5e+16."""
    size = F.abs(col)
    java = col.cast("string")
    plain = F.regexp_replace(java.try_cast("decimal(38,21)").cast("string"), "0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    # decimal(38,21) keeps 18 digits before the point; zero prints in exponent form
    mantissa = F.regexp_replace(F.substring_index(java, "E", 1), r"\.0$", "")
    power = F.substring_index(java, "E", -1).try_cast("int")
    power_text = F.concat(
        F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.lit(2), F.lit("0"))
    )
    power_text = F.when(F.abs(power) > 99, F.concat(F.when(power < 0, "-").otherwise("+"),
                                                    F.abs(power).cast("string"))).otherwise(power_text)
    return (
        F.when(col.isNull() | F.isnan(col), F.lit(None).cast("string"))
        .when(size == float("inf"), F.when(col > 0, "inf").otherwise("-inf"))
        .when(~java.contains("E"), java)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(F.concat(mantissa, F.lit("e"), power_text))
    )


def value_text(col: Column, dtype: T.DataType) -> Column:
    """How a cell reads inside a serialized entity; null stays null."""
    if isinstance(dtype, T.BooleanType):
        return F.initcap(col.cast("string"))
    if isinstance(dtype, T.FloatType):
        return _double_text(col.cast("string").cast("double"))
    if isinstance(dtype, _FLOATING):
        return _double_text(col)
    return col.cast("string")


def once(value: Column, use) -> Column:
    """use(value), with the value computed once however often `use` names it; a column
    named in a lambda is computed again for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def text_fingerprint(text: Column) -> Column:
    """Stands for the whole text wherever copies are grouped, so that the
    shuffle carries 64 characters and not the text."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def edit_ratio(left: Column, right: Column) -> Column:
    """1 - distance / longer length; two empty texts are equal."""
    longer = F.greatest(F.length(left), F.length(right))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(left, right) / longer)


def token_jaccard(left: Column, right: Column) -> Column:
    a, b = F.array_distinct(tokens(left)), F.array_distinct(tokens(right))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def length_ratio(left: Column, right: Column) -> Column:
    short, long = F.least(F.length(left), F.length(right)), F.greatest(F.length(left), F.length(right))
    return F.coalesce(F.try_divide(short, long), F.lit(1.0))
