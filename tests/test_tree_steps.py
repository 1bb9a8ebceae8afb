"""Only nodes with children take steps in the walk around a tree."""

from docuflux.operators import trees as tr

from .test_trees import ROW, ordered, walked


def test_leaves_take_no_steps(spark, monkeypatch):
    rows = [(1, 0, None, 0)] + [(1, i, 0, i) for i in range(1, 40)] + [(1, 100 + i, 7, -i) for i in range(30)] + [(2, 5, None, 1), (2, 6, None, 0), (2, 7, 9, 2)]
    rows += [(3, 1, None, 0), (3, 2, None, 1), (3, 3, 2, 0), (3, 4, None, 2), (3, 5, None, 3), (3, 6, 5, 0), (3, 7, None, 4)]
    taken, write = [], tr.written
    monkeypatch.setattr(tr, "written", lambda df, folder, step: (out := write(df, folder, step), taken.append(out.count()) if isinstance(step, int) else None)[0])
    assert ordered(spark, rows) == walked(rows)
    assert max(taken) == 8  # two for each of the four nodes with children; each of all nodes had two before
    nodes = spark.createDataFrame([(*r, "x") for r in rows], ROW)
    assert tr.preorder(nodes.withColumnRenamed("order", "text"), "page").count() == len(rows)
