"""Records to comparable text and back, and the column bookkeeping around it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sameas.functions.text import COL_TAG, PAIR_SEPARATOR, VAL_TAG, once, value_text


def _features(df: DataFrame, id_col: str) -> list[str]:
    return [c for c in df.columns if c != id_col]


def _cell(df: DataFrame, name: str) -> Column:
    return value_text(F.col(f"`{name}`"), df.schema[name].dataType)


def drop_columns(df: DataFrame, names: Sequence[str] = ()) -> DataFrame:
    """Names the table does not have are ignored."""
    return df.drop(*names)


def schema_compare(a: DataFrame, b: DataFrame, id_col: str = "id") -> DataFrame:
    """(name, in_a, in_b, pos_a, pos_b), one row per feature column of either side."""
    cols_a, cols_b = _features(a, id_col), _features(b, id_col)
    place = lambda cols, name: cols.index(name) + 1 if name in cols else None
    rows = [(n, n in cols_a, n in cols_b, place(cols_a, n), place(cols_b, n)) for n in dict.fromkeys(cols_a + cols_b)]
    return a.sparkSession.createDataFrame(rows, "name string, in_a boolean, in_b boolean, pos_a int, pos_b int")


def column_widths(df: DataFrame, id_col: str = "id") -> DataFrame:
    """(name, width): longest text per feature column, a null counting as 'nan'."""
    names = _features(df, id_col)
    widest = df.agg(*[F.max(F.length(F.coalesce(_cell(df, n), F.lit("nan")))).alias(n) for n in names])
    return widest.unpivot([], names, "name", "width")


def order_columns(a: DataFrame, b: DataFrame, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """Narrow columns first; equal names on both sides share A's order."""
    def by_width(df: DataFrame) -> list[str]:
        rows = column_widths(df, id_col).collect()      # one row per column
        return [r["name"] for r in sorted(rows, key=lambda r: (r["width"] or 0, r["name"]))]

    order_a = by_width(a)
    order_b = order_a if set(order_a) == set(_features(b, id_col)) else by_width(b)
    return a.select(id_col, *order_a), b.select(id_col, *order_b)


def serialize(df: DataFrame, id_col: str = "id", column_names: bool = True) -> DataFrame:
    """(id, text). Tagged: '[COL] c [VAL] v ...'; else the values alone. A null
    becomes the empty text and keeps its place."""
    names = _features(df, id_col)
    filled = [F.coalesce(_cell(df, n), F.lit("")) for n in names]
    if column_names:
        filled = [F.concat(F.lit(f"{COL_TAG}{n} {VAL_TAG}"), v) for n, v in zip(names, filled)]
    return df.select(F.col(id_col).alias("id"), F.concat_ws(" ", *filled).alias("text"))


def pair_texts(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs with the texts of both sides; `a`, `b` are (id, text)."""
    return (
        pairs.join(a.select(F.col("id").alias("a_id"), F.col("text").alias("a_text")), "a_id")
        .join(b.select(F.col("id").alias("b_id"), F.col("text").alias("b_text")), "b_id")
    )


def serialize_pairs(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_id, b_id, text) with text 'A [SEP] B'."""
    return pair_texts(pairs, a, b).select(
        "a_id", "b_id", F.concat("a_text", F.lit(PAIR_SEPARATOR), "b_text").alias("text"))


def _entity_map(text: Column) -> Column:
    """Tagged text to MAP<column, value>; the space before the next tag is not part
    of a value. Of columns that a value's own tags repeat the last one counts; a field
    without a value tag is a column with a null value."""
    parts = F.split(text, r"\[COL\] ")
    fields, last = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), F.size(parts) - 2

    def entry(field: Column, place: Column) -> Column:
        cut = F.instr(field, VAL_TAG)
        value = F.substring(field, cut + len(VAL_TAG), F.length(field))
        value = F.when(place < last, F.regexp_replace(value, " $", "")).otherwise(value)
        name = F.when(cut > 0, F.substring(field, F.lit(1), cut - 2)).otherwise(F.trim(field))
        return F.struct(name.alias("key"), F.when(cut > 0, value).alias("value"))

    def last_of_each(entries: Column) -> Column:
        keys = F.transform(entries, lambda e: e["key"])
        final = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"]))
        return F.when(F.size(keys) == F.size(F.array_distinct(keys)), entries).otherwise(final)

    return F.map_from_entries(once(F.transform(fields, entry), last_of_each))


def deserialize(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds entity_a and entity_b (null for the text of a single entity)."""
    sides = F.split(F.col(text_col), r" \[SEP\] ")
    return df.withColumn("entity_a", _entity_map(sides[0])).withColumn(
        "entity_b", F.when(F.size(sides) > 1, _entity_map(F.get(sides, F.lit(1)))))


def get_entity(df: DataFrame, entity_id, id_col: str = "id") -> DataFrame:
    """One record; the filter reaches the scan."""
    return df.filter(F.col(id_col) == entity_id)


def search_entities(entities: DataFrame, term: str, limit: int = 10) -> DataFrame:
    """First `limit` rows whose text contains the term, case-sensitive, by id."""
    return entities.filter(F.col("text").contains(term)).orderBy("id").limit(limit)


def column_preview(df: DataFrame, id_col: str = "id") -> DataFrame:
    """(name, example): the value of the row with the smallest id."""
    names = _features(df, id_col)
    firsts = df.agg(*[F.min_by(F.coalesce(_cell(df, n), F.lit("")), F.col(id_col)).alias(n) for n in names])
    return firsts.unpivot([], names, "name", "example")


def entity_diff(pairs: DataFrame, a: DataFrame, b: DataFrame, id_col: str = "id") -> DataFrame:
    """Cells of both sides of each pair: (a_id, b_id, feature, part, a_value, b_value)
    with part 'common', 'only a' or 'only b'. Which features are common is known
    from the schemas, so each pair is met once per side."""
    names_a, names_b = _features(a, id_col), _features(b, id_col)
    side = lambda df, names, tag: df.select(
        F.col(id_col).alias(f"{tag}_id"), *[_cell(df, n).alias(f"{tag}_{i}") for i, n in enumerate(names)])
    both = pairs.select("a_id", "b_id").join(side(a, names_a, "a"), "a_id").join(side(b, names_b, "b"), "b_id")
    absent = F.lit(None).cast("string")
    rows = []
    for name in dict.fromkeys(names_a + names_b):
        in_a, in_b = name in names_a, name in names_b
        part = "common" if in_a and in_b else "only a" if in_a else "only b"
        rows.append(F.struct(
            F.lit(name).alias("feature"), F.lit(part).alias("part"),
            (F.col(f"a_{names_a.index(name)}") if in_a else absent).alias("a_value"),
            (F.col(f"b_{names_b.index(name)}") if in_b else absent).alias("b_value")))
    return both.select("a_id", "b_id", F.inline(F.array(*rows)))
