import socket
import threading

import pytest
from pyspark.sql import functions as F

from quillon import session
from quillon.functions.plain import TABLE
from quillon.operators import reject_rows
from quillon.sources import files


def test_types_come_from_all_rows(spark, tmp_path):
    rows = [str(i) for i in range(150)] + ["12.5", "abc"]
    (tmp_path / "a.csv").write_text("x,y,z,e\n" + "".join(f"{v},{i},{i if i < 151 else i + 0.5},\n" for i, v in enumerate(rows)))
    df = files.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.dtypes == [("x", "string"), ("y", "bigint"), ("z", "double"), ("e", "string")]
    assert sorted(r.x for r in df.collect()) == sorted(rows)
    assert files.read_csv(spark, str(tmp_path / "a.csv"), types={"x": "bigint"}).where("x is null").count() == 2


def test_empty_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n")
    df = files.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["x", "y"] and df.count() == 0


def test_an_unset_shared_folder_raises_on_a_cluster(spark, monkeypatch):
    monkeypatch.setattr(session, "is_local", lambda s: False)
    if spark.conf.get("spark.checkpoint.dir", None) is None and not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        with pytest.raises(ValueError):
            session.shared_dir(spark)


def test_materialised_tables_lie_in_one_folder_of_the_run(spark):
    a, b = session.scratch(spark, "x"), session.scratch(spark, "x")
    assert a != b and a.rsplit("/", 1)[0] == b.rsplit("/", 1)[0]
    assert session.materialise(spark.range(5), "five").count() == 5


def test_packed_files(spark, tmp_path):
    fields, path = (("id", "<i8"), ("v", "<f8")), str(tmp_path / "packed")
    df = spark.range(1000).withColumn("v", F.col("id") / 4)
    files.write_nab(df.repartition(3), path, fields)
    assert sorted(map(tuple, files.read_nab(spark, path, fields).collect())) == sorted(map(tuple, df.collect()))
    (tmp_path / "packed" / "keep.me").write_text("x")
    with pytest.raises(ValueError):
        files.write_nab(df, path, fields)
    assert (tmp_path / "packed" / "keep.me").exists()


def test_line_breaks_inside_scores(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb"), (2, "c  d"), (3, None)], "k long, t string")
    files.write_scores(df, str(tmp_path / "s"))
    assert sorted(map(tuple, files.read_scores(spark, str(tmp_path / "s"), "k long, t string").collect())) == [(1, "a\nb"), (2, "c  d"), (3, None)]


def test_framed_xml(spark, tmp_path):
    (tmp_path / "f.bin").write_text("noise <Event><a>1</a>\n<b>x</b></Event><Event><a>2</a></Event> tail")
    assert sorted(map(tuple, files.read_framed(spark, str(tmp_path / "f.bin"), "a long, b string").collect())) == [(1, "x"), (2, None)]


def test_streams_of_files_and_sockets(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("x,y\n1,a\n2,b\n")
    (tmp_path / "xml").mkdir()
    (tmp_path / "xml" / "a.txt").write_text("<row><x>1</x></row>\n<row><x>2</x></row>\n")
    from quillon.streaming import online

    assert online.drain(files.stream_csv(spark, str(tmp_path / "in"), "x long, y string"), str(tmp_path / "o")).count() == 2
    assert online.drain(files.stream_xml(spark, str(tmp_path / "xml"), "x long"), str(tmp_path / "p")).agg(F.sum("x")).first()[0] == 3
    server = socket.create_server(("127.0.0.1", 0))

    def serve():
        peer, _ = server.accept()
        peer.sendall(b"1,a\n2,b\n3,c\n")
        threading.Event().wait(4)
        peer.close()

    threading.Thread(target=serve, daemon=True).start()
    got = []
    query = files.stream_lines(spark, "127.0.0.1", server.getsockname()[1], "x long, y string").writeStream.foreachBatch(lambda b, n: got.extend(map(tuple, b.collect()))).start()
    for _ in range(60):
        if len(got) >= 3:
            break
        query.awaitTermination(0.25)
    query.stop()
    server.close()
    assert sorted(got) == [(1, "a"), (2, "b"), (3, "c")]


def test_avro_without_its_module(spark, tmp_path):
    with pytest.raises(ValueError, match="spark-avro"):
        files.read_any(spark, str(tmp_path / "a.avro"))


def test_jdbc(spark):
    """The database that Spark brings along."""
    url = "jdbc:derby:memory:quillon;create=true"
    spark.range(20).withColumn("v", F.col("id") * 2).write.format("jdbc").options(url=url, dbtable="t", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").save()
    df = files.read_jdbc(spark, url, "t", '"id"', 0, 20, 3, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert df.count() == 20 and df.rdd.getNumPartitions() == 3


def test_shifts_and_signs(spark):
    big = 9007199254740993
    df = spark.createDataFrame([(big, 1, -0.0, 3.0), (-5, 62, 0.0, 3.0), (None, 1, None, 3.0)], "a long, b long, x double, y double")
    got = df.select(TABLE["left_shift"](F.col("a"), F.col("b")), TABLE["right_shift"](F.col("a"), F.col("b") - F.col("b")), TABLE["signbit"](F.col("x")), TABLE["copysign"](F.col("y"), F.col("x"))).collect()
    assert tuple(got[0]) == (big << 1, big, True, -3.0)
    assert tuple(got[1])[1:] == (-5, False, 3.0) and got[2][0] is None


def test_lines_of_an_unknown_feed(spark):
    df = spark.createDataFrame([(1, "other", "a\tb"), (2, None, "c"), (3, "test_data", "s\t5"), (4, "other", None)], "line_id long, feed string, line_text string")
    got = {(r.line_id, r.reason) for r in reject_rows.split_lines(df, unknown=True).collect()}
    assert got == {(1, "feed"), (2, "feed"), (3, None)}
    assert [r.line_id for r in reject_rows.split_lines(df).collect()] == [3]
