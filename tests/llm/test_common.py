import pyarrow as pa
import pytest

from urlspark.llm import common as C


def test_gathered_batches_keep_all_rows_in_order():
    batches = [pa.RecordBatch.from_arrays([pa.array(["x" * 10] * n), pa.array(range(n))], ["a", "b"]) for n in (3, 0, 5, 7, 1, 30, 2)]
    out = list(C.gathered(iter(batches), 200))
    assert [len(b) for b in out] == [15, 31, 2] and out[0].schema.names == ["a", "b"]
    assert [v for b in out for v in b.column("b").to_pylist()] == [v for b in batches for v in b.column("b").to_pylist()]
    assert list(C.gathered(iter([]), 5)) == [] and list(C.gathered(iter(batches[1:2]), 5)) == []


def test_batches_are_bounded_in_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], ["n"])

    docs = spark.range(60, numPartitions=1).selectExpr("repeat('x', 1000000) AS text")
    got = [r.n for r in C.map_batches(docs, sizes, "n long").collect()]
    assert sum(got) == 60 and max(got) <= 10


def test_place_of_a_column(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["Text", "b", "c"])
    assert C.place(df, "text") == 0 and C.place(df, "c") == 2
    with pytest.raises(ValueError):
        C.place(df, "d")
