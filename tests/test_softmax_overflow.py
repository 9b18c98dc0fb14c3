import pytest

from communa.operators.moves import softmax_choices


@pytest.mark.parametrize("draw", [0.0, 0.5, 0.999])
def test_best_choice_where_weights_overflow(spark, draw):
    rows = [(1, 4, 1.0, draw), (1, 6, 900.0, draw), (1, 9, 1000.0, draw), (2, 7, 800.0, draw), (2, 3, 800.0, draw), (3, 5, 0.0, draw), (3, 8, -1.0, draw), (4, 2, -1.0, draw)]
    df = spark.createDataFrame(rows, "node long, cluster long, gain double, u double")
    assert sorted(map(tuple, softmax_choices(df, 0.1, "u").collect())) == [(1, 9), (2, 3), (3, 5)]
