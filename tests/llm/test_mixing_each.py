import duckdb

from sparkcols.llm import mixing


def test_every_source_has_a_stream_within_a_block_of_its_share(spark):
    sources = ["src0", "src1", "src8", "src9", "hot", None]
    rows = [(1000 * i + j, "x" * 100, s) for i, s in enumerate(sources) for j in range(400 if s == "hot" else 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    null, rest = "(null)", mixing.WEIGHTS[mixing.OTHERS] / 4
    weights = mixing.WEIGHTS | dict.fromkeys(("src8", "src9", "hot", null), rest)
    period = sum(mixing.WEIGHTS.values())
    done = mixing.schedule(df, block_chars=100, each=True).collect()
    assert len(done) == len(rows)
    for name in ("src0", "src8", "hot", null):
        own = sorted(r.mix_slot for r in done if r.mix_stream == name)
        assert len(set(own)) == len(own)
        for t in range(1, own[-1] + 1, 7):
            assert abs(sum(s < t for s in own) - t * weights[name] / period) < 1


def test_sql_twin_on_odd_sources(spark):
    sources = ["src0", "(null)", "((null))", None, "(others)", "", "é", "z", "src5"]
    rows = [(i, "y" * (i % 7) if i % 11 else None, s) for i, s in enumerate(sources * 9)] + [(5, "twice", "z")] * 2
    rows.append((None, "no key", None))
    for part in (rows, [r for r in rows if r[2] in ("src0", "src5")], []):
        df = spark.createDataFrame(part, "doc_id long, text string, source string")
        done = mixing.schedule(df.withColumnsRenamed({}), block_chars=5, each=True)
        got = done.select("doc_id", "mix_stream", "mix_block", "mix_slot").collect()
        documents = df.toArrow()
        with duckdb.connect() as db:
            db.register("documents", documents)
            want = db.sql(mixing.schedule_sql(block_chars=5, each=True)).fetchall()
        order = lambda r: tuple((v is not None, v) for v in r)
        assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
