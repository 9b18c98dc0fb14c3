from communa import graphs

SF = "/root/testdata/sf0.001"
NAME = "spark.sql.shuffle.partitions"


def test_partitions_of_a_graph_follow_its_tables(spark, monkeypatch):
    """The joins and sums behind a graph run with a partition for each PART_ROWS rows, and the session's setting is put back."""
    before, seen, plain = spark.conf.get(NAME), [], graphs.number_rows
    monkeypatch.setattr(graphs, "number_rows", lambda *a, **k: (seen.append(int(spark.conf.get(NAME))), plain(*a, **k))[1])
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    whole = sorted(map(tuple, graphs.graph(spark, SF, "part_copurchase").collect()))
    monkeypatch.setattr(graphs, "PART_ROWS", 500)
    assert sorted(map(tuple, graphs.graph(spark, SF, "part_copurchase").collect())) == whole
    assert seen == [int(before), -(-rows // 500)] and spark.conf.get(NAME) == before
