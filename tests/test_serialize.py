import pytest
from hypothesis import given, settings, strategies as st, HealthCheck
from pyspark.sql import functions as F, types as T

from conftest import rows_of
from sameas.functions import text as X
from sameas.operators import serialize as P


@pytest.mark.parametrize("value, expected", [
    (5.0, "5.0"), (0.0, "0.0"), (-0.0, "-0.0"), (1863.84, "1863.84"), (1e7, "10000000.0"), (12345678.25, "12345678.25"),
    (1e15, "1000000000000000.0"), (1e16, "1e+16"), (1.5e16, "1.5e+16"), (0.0001, "0.0001"), (0.00025, "0.00025"),
    (1e-5, "1e-05"), (2.5e-7, "2.5e-07"), (1e100, "1e+100"), (float("inf"), "inf"), (-123456789.5, "-123456789.5")])
def test_double_text(make, value, expected):
    df = make([(value,)], "v double")
    assert df.select(X.value_text(F.col("v"), T.DoubleType()).alias("t")).head()["t"] == expected


def test_missing_and_booleans(make):
    df = make([(None, True), (float("nan"), False)], "v double, b boolean")
    got = df.select(X.value_text(F.col("v"), T.DoubleType()), X.value_text(F.col("b"), T.BooleanType())).collect()
    assert [tuple(r) for r in got] == [(None, "True"), (None, "False")]


def test_serialize_keeps_places_of_nulls(make):
    df = make([(1, "x", None, 3), (2, None, None, None)], "id long, a string, b string, c int")
    assert rows_of(P.serialize(df), "id", "text") == [
        (1, "[COL] a [VAL] x [COL] b [VAL]  [COL] c [VAL] 3"), (2, "[COL] a [VAL]  [COL] b [VAL]  [COL] c [VAL] ")]
    assert rows_of(P.serialize(df, column_names=False), "id", "text") == [(1, "x  3"), (2, "  ")]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text("abcé ñ1.", max_size=8), st.text("xyz[]| ", max_size=8)), min_size=1, max_size=6))
def test_deserialize_undoes_serialize(make, cells):
    df = make([(i, a, b) for i, (a, b) in enumerate(cells)], "id long, left string, right string")
    back = P.deserialize(P.serialize(df)).select("id", F.col("entity_a")["left"].alias("l"), F.col("entity_a")["right"].alias("r"))
    assert rows_of(back, "id", "l", "r") == [(i, a, b) for i, (a, b) in enumerate(cells)]


def test_deserialize_pair(make):
    df = make([("[COL] a [VAL] x y [COL] b [VAL] 1 [SEP] [COL] a [VAL] z",), ("[COL] a [VAL] q",)], "text string")
    first, second = P.deserialize(df).collect()
    assert first["entity_a"] == {"a": "x y", "b": "1"} and first["entity_b"] == {"a": "z"}
    odd = make([("[COL] a [VAL] x [COL] a [VAL] y [COL] bare",)], "text string")
    assert P.deserialize(odd).first()["entity_a"] == {"a": "y", "bare": None}
    assert second["entity_a"] == {"a": "q"} and second["entity_b"] is None


def test_column_order_and_schema(make):
    a = make([(1, "long text", None, 10)], "id long, name string, gap string, n int")
    b = make([(1, 1, "zz", "wide value")], "id long, n int, gap string, name string")
    assert rows_of(P.column_widths(a), "name", "width") == [("gap", 3), ("n", 2), ("name", 9)]
    oa, ob = P.order_columns(a, b)
    assert oa.columns == ob.columns == ["id", "n", "gap", "name"]
    c = make([(1, "wide", 7)], "id long, other string, n int")
    assert P.order_columns(a, c)[1].columns == ["id", "n", "other"]
    got = {r["name"]: tuple(r)[1:] for r in P.schema_compare(a, c).collect()}
    assert got == {"name": (True, False, 1, None), "gap": (True, False, 2, None), "n": (True, True, 3, 2), "other": (False, True, None, 1)}


def test_drop_search_preview_get(make):
    df = make([(2, "b", 2), (1, "a", 1), (3, "ab", 3)], "id long, t string, n int")
    assert P.drop_columns(df, ["n", "gone"]).columns == ["id", "t"]
    texts = df.select("id", F.col("t").alias("text"))
    assert rows_of(P.search_entities(texts, "a", 1), "id") == [(1,)]
    assert P.search_entities(texts, "A").count() == 0
    assert rows_of(P.column_preview(df), "name", "example") == [("n", "1"), ("t", "a")]
    assert rows_of(P.get_entity(df, 3), "t") == [("ab",)]


def test_entity_diff(make):
    a = make([(1, "x", None)], "id long, name string, only string")
    b = make([(9, 5, "y")], "id long, extra int, name string")
    diff = P.entity_diff(make([(1, 9)], "a_id long, b_id long"), a, b)
    assert {tuple(r) for r in diff.collect()} == {
        (1, 9, "name", "common", "x", "y"), (1, 9, "only", "only a", None, None), (1, 9, "extra", "only b", None, "5")}


def test_pair_serialization(make):
    side = make([(1, "A"), (2, "B")], "id long, text string")
    assert rows_of(P.serialize_pairs(make([(1, 2)], "a_id long, b_id long"), side, side), "text") == [("A [SEP] B",)]


def test_tokens(make):
    df = make([("Éa x CD_1, y-z2 ñandú 9",)], "t string")
    assert df.select(X.tokens(F.col("t")).alias("w")).head()["w"] == ["éa", "cd_1", "z2", "ñandú"]
