"""The pipeline against its stages' brute-force versions, each on the input that it was given."""

import corpus_pipeline
from conftest import DATA
from loamline.llm.common import written
from test_operators import brute_components, brute_repeats


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    held = [docs]
    for _, stage in corpus_pipeline.STAGES:
        held.append(written(stage(spark, held[-1], DATA), "test-stage"))
    assert all(x.columns == corpus_pipeline.COLUMNS for x in held[1:-1])
    rows = [{r.doc_id: r for r in x.collect()} for x in held]
    good = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1").collect()}
    assert len(good - set(rows[1])) <= 0.03 * len(good) and set(rows[1]) <= set(rows[0])
    least = brute_components([(k, r.text) for k, r in rows[1].items()], 5, 80)
    assert set(rows[2]) == {k for k, n, c in least if not n or k == c}
    want = {k: (n, gone, text) for k, n, gone, text in brute_repeats([(k, r.text) for k, r in rows[2].items()], 20)}
    assert set(rows[3]) == {k for k, (n, gone, _) in want.items() if not gone or gone < n}
    assert all(r.text == (want[k][2] if want[k][1] else rows[2][k].text) and r.n_chars == len(r.text) for k, r in rows[3].items())
    grams = lambda t: {tuple(w) for w in zip(*[t.lower().split()[i:] for i in range(5)])}
    items = [grams(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert set(rows[4]) == {k for k, r in rows[3].items() if not any(10 * len(i & grams(r.text)) >= 8 * len(i) for i in items)}
    assert set(rows[5]) <= set(rows[4]) and all(r.mix_taken >= 0 and r.text == rows[4][k].text for k, r in rows[5].items())
    total = sum(len(r.text.split()) for r in rows[4].values())
    assert 0 <= int(total * 0.6) - sum(r.mix_taken for r in rows[5].values()) <= 200


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0
