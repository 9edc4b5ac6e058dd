import pyarrow as pa

from latentfield.llm.common import BATCH_BYTES, BATCH_SETTING, by_size, in_parts, small


def test_parts_hold_all_rows_in_order():
    texts = ["x" * n for n in (0, 5, 3000, 10, 9000, 1)] + [None]
    parts = list(small([pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"]), pa.RecordBatch.from_arrays([pa.array([], pa.string())], names=["t"])], "t", 2000))
    assert [x for b in parts for x in b.column("t").to_pylist()] == texts and len(parts) > 2
    assert list(by_size([1, 2, 3, 9, 1], int, 4)) == [[1, 2, 3], [9], [1]]


def test_batches_are_bounded_and_lower_settings_stay(spark):
    before = spark.conf.get(BATCH_SETTING)
    try:
        for value, want in (("64m", f"{BATCH_BYTES}b"), ("1m", "1m")):
            spark.conf.set(BATCH_SETTING, value)
            in_parts(spark.range(1))
            assert spark.conf.get(BATCH_SETTING) == want
    finally:
        spark.conf.set(BATCH_SETTING, before)
