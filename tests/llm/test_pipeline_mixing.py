import corpus_pipeline
from sparkcols.llm import mixing
from sparkcols.session import staged


def test_slots_of_the_mixing_stage_reach_the_result(spark):
    rows = [(i, f"text number {i} " * 900, "en", s, 1) for i, s in enumerate(["src0", "src9", "src8", None] * 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = {r.doc_id: r.mix_slot for r in mixing.schedule(docs, each=True).collect()}
    mixed = staged(corpus_pipeline.mix(spark, docs, ""), "mixed")
    got = corpus_pipeline.tokens(spark, mixed, "").collect()
    assert {r.doc_id: r.mix_slot for r in got} == want and len(set(want.values())) > 3
    assert all(r.n_tokens > 0 for r in got)
