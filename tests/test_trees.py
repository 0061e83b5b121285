"""Trees from a text dump, against a plain walk."""

import math

import pytest

from tickloom.operators import trees as TR

DUMP = """booster[0]:
0:[a b<1.5] yes=1,no=2,missing=2
	1:[c<=-2e-1] yes=3,no=4,missing=3
		3:leaf=0.5
		4:leaf=-0.25
	2:leaf=1e-1
booster[1]:
0:leaf=-1
"""


@pytest.fixture
def nodes(spark, tmp_path):
    path = tmp_path / "model.txt"
    path.write_text(DUMP)
    return TR.read_dump(spark, str(path), "m")


def test_dump_becomes_a_node_table(nodes):
    rows = {(r.tree, r.node): r for r in nodes.collect()}
    assert len(rows) == 6 and rows[0, 0].feature == "a b" and rows[0, 1].threshold == -0.2
    assert (rows[0, 0].missing, rows[0, 1].missing, rows[0, 1].test) == (2, 3, "<=")
    assert rows[1, 0].value == -1 and rows[0, 2].value == 0.1


def test_margin_follows_each_direction(spark, nodes):
    nan = float("nan")
    rows = [(1.0, -0.2), (1.0, 0.0), (1.5, 0.0), (None, 0.0), (1.0, None), (nan, 9.0), (1.0, nan)]
    frame = spark.createDataFrame([(i, *r, "k") for i, r in enumerate(rows)],
                                  "id int, `a b` double, c double, margin string")
    got = {r["id"]: r["m"] for r in TR.tree_margin(frame, nodes, "m", 2.0).collect()}
    want = [0.5, -0.25, 0.1, 0.1, 0.5, 0.1, 0.5]
    assert [got[i] for i in range(7)] == pytest.approx([1 + w for w in want])
    p = TR.tree_chance(frame, nodes, ("p0", "p1")).orderBy("id").first()
    assert p["p1"] == pytest.approx(1 / (1 + math.exp(0.5))) and p["p0"] + p["p1"] == 1


def test_many_trees_and_broken_models(spark, nodes):
    frame = spark.createDataFrame([(1.0, 0.0)], "`a b` double, c double")
    many = spark.createDataFrame(
        [("m", t, 0, None, None, None, None, None, None, 0.5) for t in range(30)], TR.NODE)
    assert TR.tree_margin(frame, many, "m").first()["m"] == 15.0
    assert TR.tree_margin(frame, many.limit(0), "m", 3.0).first()["m"] == 3.0
    for broken in (nodes.filter("node <> 3 OR tree <> 0"), nodes.unionByName(nodes)):
        with pytest.raises(ValueError):
            TR.tree_margin(frame, broken, "m")
