import pyarrow as pa

from sparkcols.llm import shipping


def test_batches_are_bounded_by_bytes(spark):
    """Long texts: fewer rows in a batch, none lost."""
    docs = spark.range(0, 4_000, numPartitions=1).selectExpr("id", "repeat('some text ', 1000) AS text")

    def run(batches):
        for batch in batches:
            size = len(batch) * 10_000
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)]), pa.array([size])], ["n", "size"])

    got = shipping.map_arrow(docs, run, "n long, size long").collect()
    assert sum(r.n for r in got) == 4_000 and max(r.size for r in got) <= shipping.BATCH + 2 * 10_000


def test_a_lower_bound_of_the_session_stays(spark):
    before = spark.conf.get(shipping.SETTING)
    try:
        spark.conf.set(shipping.SETTING, "100000")
        shipping.map_arrow(spark.range(1), lambda batches: batches, "id long")
        assert spark.conf.get(shipping.SETTING) == "100000"
    finally:
        spark.conf.set(shipping.SETTING, before)
