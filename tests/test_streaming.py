from graphsieve import streaming


def test_edges_follow_the_stream(spark, tmp_path):
    links, out, mark = (str(tmp_path / x) for x in ("links", "edges", "mark"))
    add = lambda *rows: spark.createDataFrame(rows, "src string, dst string, score long").write.mode("append").parquet(links)
    run = lambda: streaming.append_edges(streaming.read_links(spark, links), out, mark, 2).awaitTermination(120)
    add(("b", "a", 2), ("a", "b", 3), ("c", "a", 1), ("d", "d", 9))
    run()
    assert [tuple(r) for r in streaming.current_edges(spark, out).collect()] == [("a", "b", 3)]
    add(("a", "b", 7), ("c", "b", 4))
    run()
    assert sorted(map(tuple, streaming.current_edges(spark, out).collect())) == [("a", "b", 7), ("b", "c", 4)]
