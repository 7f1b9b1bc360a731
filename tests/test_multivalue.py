from isotwin.operators.multivalue import split_fields


def rows(spark, values, **extra):
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(values)], "psm_id bigint, `pg.genes` string, val string")
    return sorted(tuple(r) for r in split_fields(df, ["psm_id"], ["pg.genes"]).select("psm_id", "pos", "val").collect())


def test_ways_of_writing(spark):
    values = ["A;B", "A ; B|C,D", '"A;1";B', "['A', 'B']", "{A}", "A B\tC", '"P ""b""@C"', "A,,B,", ";A", "A/B", "GFY16\"z\"", "a:b-c.d@e^f>g_h(i)", "'A b'"]
    want = [
        (0, 1, "A"), (0, 2, "B"), (1, 1, "A"), (1, 2, "B"), (1, 3, "C"), (1, 4, "D"), (2, 1, "A;1"), (2, 2, "B"), (3, 1, "A"), (3, 2, "B"), (4, 1, "A"),
        (5, 1, "A B"), (5, 2, "C"), (6, 1, 'P "b"@C'), (7, 1, "A"), (7, 3, "B"), (8, 2, "A"), (9, 1, "A"), (9, 2, "B"), (10, 1, 'GFY16"z"'), (11, 1, "a:b-c.d@e^f>g_h(i)"), (12, 1, "A b"),
    ]
    assert rows(spark, values) == sorted(want)


def test_nothing_and_much(spark):
    assert rows(spark, [None, "", "  ", ";;", "[]"]) == []
    long = ";".join(f"v{i}" for i in range(5000))
    assert len(rows(spark, [long])) == 5000
    assert rows(spark, ["A;A", "A;A"]) == [(0, 1, "A"), (0, 2, "A"), (1, 1, "A"), (1, 2, "A")]
    assert rows(spark, []) == []
