"""The forest of MLlib's settings that grows on histograms."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier

from loantriad.catalog import modelling
from loantriad.models import histograms as hi
from loantriad.models import learners as le
from loantriad.plans import credit_flow as cf


@pytest.fixture(scope="module")
def table(spark):
    rng, n = np.random.default_rng(7), 3000
    x = rng.normal(size=(n, len(cf.FEATURES)))
    y = (x[:, 0] + 0.6 * x[:, 1] * x[:, 2] + 0.3 * x[:, 3] + rng.normal(size=n) > 0.2).astype(int)
    rows = [(i, int(y[i]), i % 5, 10.0, 30.0, *map(float, x[i])) for i in range(n)]
    kinds = "loan_id long, y int, fold int, lam_pn double, lam_np double, " + ", ".join(f"{c} double" for c in cf.FEATURES)
    return spark.createDataFrame(rows, kinds).repartition(4).cache()


def test_merged_leaves_by_hand():
    tree = hi.Tree()
    for node, feature in ((0, 0), (1, 1), (2, 2), (3, 3)):  # 0 -> 1, 2; 1 -> 3, 4; 2 -> 5, 6; 3 -> 7, 8
        tree.split(node, feature, 0)
        tree.gain[node] = float(node + 1)
    tree.value = [0.4, 0.3, 0.6, 0.2, 0.5, 0.4, 0.9, 0.1, 0.45]
    tree.prune()  # 7 and 8 both call 0, then 3 and 4 do (a half calls 0); 5 and 6 differ
    assert tree.feature[:3] == [0, -1, 2] and tree.gain == {0: 1.0, 2: 3.0}
    x = np.array([[0, 0, 0, 0], [0, 1, 0, 0], [1, 0, 0, 0], [1, 0, 1, 0]], np.uint8)
    assert list(tree.scores(x)) == [0.3, 0.3, 0.4, 0.9]


def test_as_good_as_the_forest_it_stands_for(table):
    train, test = (le.assemble(p, cf.FEATURES) for p in cf.fold_rows(table, 0))
    ours, theirs = hi.random_forest(60, 6).fit(train), le.random_forest(60, 6).fit(train)
    a, b = le.area(le.score(ours, test)), le.area(le.score(theirs, test))
    assert a > 0.75 and a == pytest.approx(b, abs=0.03)
    assert np.allclose(ours.featureImportances.toArray(), theirs.featureImportances.toArray(), atol=0.05)
    assert len(ours.trees) == 60 and max(tree.depth() for tree in ours.trees) <= 6
    assert len(hi.random_forest(200).fit(train).trees) == 200


def test_nodes_try_the_root_of_the_features(table, monkeypatch):
    seen, grow = [], hi.grow_together
    monkeypatch.setattr(hi, "grow_together", lambda data, bags, how: seen.append(how.node_features) or grow(data, bags, how))
    hi.HistogramForest(2, prune=True, depth=2, bins=32, node_features=-1).fit(le.assemble(table, cf.FEATURES))
    assert seen == [3]


def test_queries_keep_no_number_a_row_and_tree(spark, table, monkeypatch):
    def no(*_):
        raise AssertionError("MLlib's forest keeps four bytes a row and tree")

    monkeypatch.setattr(RandomForestClassifier, "_fit", no)
    monkeypatch.setattr(cf, "model_table", lambda *_: table)
    row = modelling.ml2(spark, "none").collect()
    assert len(row) == 1 and row[0].tp + row[0].tn + row[0].fp + row[0].fn == 600 and row[0].auc > 0.7
    found = {r.feature: r for r in modelling.ml16(spark, "none").collect()}
    assert set(found) == set(cf.FEATURES)
