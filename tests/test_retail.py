from __future__ import annotations

from termlens.sources import retail


def _write(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def _tables(spark, folder):
    return _write(
        spark, folder,
        lineitem=(
            [(1, 1, 7, 0, 0.05), (1, 1, 9, 3, 0.05), (1, 2, 7, 1, 0.1), (2, 1, 8, 2, None), (3, 1, 7, 0, 0.0), (2, 2, None, 0, 0.0), (2, 3, 7, None, 0.0), (None, 1, 7, 0, 0.0)],
            "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_discount double",
        ),
        orders=([(1, "1-URGENT"), (2, None), (2, "5-LOW")], "o_orderkey bigint, o_orderpriority string"),
        conversations=(
            [(0, 1, "b c  d e"), (0, 0, "a"), (0, 2, "f g h"), (1, 0, "x y"), (1, None, "w")],
            "conv_id bigint, turn bigint, text string",
        ),
        part=([(7, "bolt", "B#1"), (7, "nut", "B#2"), (8, "pin", None)], "p_partkey bigint, p_name string, p_brand string"),
    )


def test_terms_and_titles_of_pairs(spark, tmp_path):
    got = sorted(map(tuple, retail.pairs(spark, _tables(spark, tmp_path)).collect()), key=str)
    assert got == [
        (11, 7, "bolt B#1", "b c d e f 1-URGENT", "2.0"),
        (11, 7, "nut B#2", "b c d e f 1-URGENT", "2.0"),
        (12, 7, "bolt B#1", "w x y 1-URGENT", "3.0"),
        (12, 7, "nut B#2", "w x y 1-URGENT", "3.0"),
        (21, 8, None, "a b c d e 5-LOW", None),
        (21, 8, None, None, None),
    ]


def test_a_conversation_does_not_travel_to_the_products(spark, tmp_path):
    plan = retail.pairs(spark, _tables(spark, tmp_path))._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Join":
        plan = plan.children().head()
    shuffled = plan.left().output().mkString(" ")
    assert "search_term" in shuffled and "words" not in shuffled
