import pytest

from isotwin.operators.schema_drift import correspond, lossy_casts, schema_changes, unify


def changes(spark, a, b, key="id"):
    return sorted((r["change_kind"], r["col_from"], r["col_to"]) for r in schema_changes(spark, [("a", a), ("b", b)], key).collect())


def test_changes(spark):
    a = spark.createDataFrame([(i, f"run{i}", 10.0 + i, "2", 0.1 * i) for i in range(30)], "id bigint, Run string, RT double, `p.charge` string, q double")
    b = spark.createDataFrame([(i, f"run{i}.raw", f"{(10.0 + i) * 60} s", 2, 7.0 + i * 3, True) for i in range(20, 50)], "id bigint, `raw.name` string, rt_text string, charge int, score double, decoy boolean")
    want = [("added", "", "decoy"), ("added", "", "score"), ("removed", "q", ""), ("renamed", "RT", "rt_text"), ("renamed", "Run", "raw.name"), ("renamed", "p.charge", "charge"), ("retyped", "RT", "rt_text"), ("retyped", "p.charge", "charge")]
    assert changes(spark, a, b) == sorted(want)
    whole = unify([("a", a), ("b", b)], "id")
    assert whole.count() == 60
    r = whole.where("source_table = 'b' and id = 25").first()
    assert (r["RT"], r["p.charge"], r["decoy"], r["q"]) == (35.0, 2, True, None)


def test_no_shared_rows_nulls_and_empty_files(spark):
    a = spark.createDataFrame([(1, "x", None), (1, "x", None), (None, None, None)], "id bigint, name string, v double")
    b = spark.createDataFrame([], "id bigint, Name string, v float")
    assert changes(spark, a, b) == [("renamed", "name", "Name"), ("retyped", "v", "v")]
    assert unify([("a", a), ("b", b)], "id").count() == 3
    assert changes(spark, a, a) == []
    assert changes(spark, a, b, key="other") == [("renamed", "name", "Name"), ("retyped", "v", "v")]


def test_same_name_other_quantity_is_kept_apart_from_a_better_match(spark):
    a = spark.createDataFrame([(i, float(i), 100.0 - i) for i in range(1, 30)], "id bigint, x double, y double")
    b = spark.createDataFrame([(i, 100.0 - i, float(i) * 7 + 0.5) for i in range(1, 30)], "id bigint, x2 double, z double")
    assert changes(spark, a, b) == [("added", "", "z"), ("removed", "x", ""), ("renamed", "y", "x2")]


def test_propagation_decides_where_names_and_rows_say_little(spark):
    """Columns of drifting names between columns that stay, and two shared rows: the start scores alone lose them."""
    a = spark.createDataFrame([(i, f"r{i}", 1.5 * i, f"g{i}", i + 0.25, True) for i in range(20)], "id bigint, sample string, weight double, gene string, elution double, decoy boolean")
    b = spark.createDataFrame([(i, f"r{i}", 1.5 * i if i != 19 else 7.0, f"g{i}", i + 0.25, True) for i in range(18, 40)], "id bigint, sample string, m_kg double, gene string, t_gone double, decoy boolean")
    assert changes(spark, a, b) == [("renamed", "elution", "t_gone"), ("renamed", "weight", "m_kg")]
    without_rows = lambda rounds: {(p[0], q[0]) for p, q in correspond(a.schema, b.schema, {}, rounds) if p != q}
    assert without_rows(200) == {("elution", "t_gone"), ("weight", "m_kg")}
    assert without_rows(0) == set()


def test_few_shared_rows_speak_against_the_order_of_columns(spark):
    a = spark.createDataFrame([(1, "abc", "xyz"), (2, "d", "e"), (9, "w", "q")], "id bigint, left_one string, right_one string")
    b = spark.createDataFrame([(1, "xyz", "abc"), (9, "q", "w")], "id bigint, p string, q string")
    assert changes(spark, a, b) == [("renamed", "left_one", "q"), ("renamed", "right_one", "p")]


def test_fields_within_structs_and_lists(spark):
    a = spark.createDataFrame([(i, (i, f"q{i}", 0.5 * i), [(i, "m")]) for i in range(20)], "id bigint, s struct<charge:int,name:string,old:double>, mods array<struct<site:int,what:string>>")
    b = spark.createDataFrame([(i, (f"q{i}", i, True), [("m", i, 1)]) for i in range(10, 30)], "id bigint, s struct<label:string,charge:bigint,fresh:boolean>, mods array<struct<what:string,site:bigint,rank:int>>")
    assert changes(spark, a, b) == [("added", "", "mods.rank"), ("added", "", "s.fresh"), ("removed", "s.old", ""), ("renamed", "s.name", "s.label"), ("retyped", "mods.site", "mods.site"), ("retyped", "s.charge", "s.charge")]
    whole = unify([("a", a), ("b", b)], "id")
    assert whole.schema["s"].dataType.simpleString() == "struct<charge:bigint,name:string,old:double,fresh:boolean>"
    assert whole.count() == 40
    rows = {(r["source_table"], r["id"]): r for r in whole.collect()}
    assert tuple(rows["a", 3]["s"]) == (3, "q3", 1.5, None) and tuple(rows["b", 29]["s"]) == (29, "q29", None, True)
    assert [tuple(x) for x in rows["b", 29]["mods"]] == [(29, "m", 1)] and [tuple(x) for x in rows["a", 3]["mods"]] == [(3, "m", None)]


def test_texts_are_read_as_what_the_rows_show_and_nothing_is_lost(spark):
    a = spark.createDataFrame([(i, 100.0 + i, 10.0 + i, 2, i) for i in range(30)], "id bigint, mass double, RT double, charge bigint, n int")
    texts = lambda i: (f"{145 if i == 29 else 100 + i} s" if i in (28, 29) else "145 kDa" if i == 27 else f"{100.0 + i}", f"{(10 + i) * 60} s" if i % 2 else f"{10 + i}", "2.7" if i == 40 else "2", "many" if i == 41 else str(i))
    b = spark.createDataFrame([(i, *texts(i)) for i in range(10, 50)], "id bigint, mass string, RT string, charge string, n string")
    whole = unify([("a", a), ("b", b)], "id")
    rows = {r["id"]: r for r in whole.where("source_table = 'b'").collect()}
    assert rows[20]["mass"] == 120.0 and rows[21]["RT"] == 31.0 and rows[20]["RT"] == 30.0
    # A time in a column of masses stays what it is; a fraction widens whole numbers.
    assert rows[29]["mass"] is None and rows[29]["unread"] == {"mass": "145 s"} and rows[27]["unread"] == {"mass": "145 kDa"}
    assert rows[40]["charge"] == 2.7 and rows[40]["unread"] is None and rows[41]["n"] is None and rows[41]["unread"] == {"n": "many"}
    assert dict(whole.dtypes)["charge"] == "double" and dict(whole.dtypes)["n"] == "bigint"
    assert sorted((r["source_table"], r["column"], r["text"], r["n"]) for r in lossy_casts(whole).collect()) == [("b", "mass", "128 s", 1), ("b", "mass", "145 kDa", 1), ("b", "mass", "145 s", 1), ("b", "n", "many", 1)]


def test_a_key_stored_very_often_in_both_files(spark):
    rows = [(7, float(i % 3), f"x{i % 3}") for i in range(3000)] + [(i, float(i), f"x{i}") for i in range(100, 130)]
    a, b = spark.createDataFrame(rows, "id bigint, v double, w string"), spark.createDataFrame(rows, "id bigint, value double, w string")
    assert changes(spark, a, b) == [("renamed", "v", "value")]
    assert unify([("a", a), ("b", b)], "id").count() == 6060


@pytest.mark.parametrize("kind", ["map<string,int>", "struct<x:int>", "array<int>"])
def test_unlike_types_meet_as_text_or_list(spark, kind):
    a = spark.createDataFrame([(1, "t")], "id bigint, v string")
    b = spark.range(1).selectExpr("id", f"cast(null as {kind}) as v", "'x' as unread", "1 as source_table")
    whole = unify([("a", a), ("b", b)], "id")
    assert whole.count() == 2 and {"unread_", "source_table_"} <= set(whole.columns)
