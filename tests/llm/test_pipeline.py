import corpus_pipeline
import pytest

from roadglass.llm import pii, quality, toxicity
from tests.llm.test_neardedup import brute as near_brute
from tests.llm.test_packing import check as packing_check

SF = "/root/testdata/sf0.001"


def text(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_stages_against_brute_force(spark, sf_documents):
    """Each stage on what its predecessor kept."""
    docs = sf_documents
    out = dict(corpus_pipeline.STAGES)
    assert list(out) == ["quality_rules", "toxicity", "near_dedup", "pii", "packing"]
    kept = out["quality_rules"](spark, docs, SF)
    assert kept.columns == docs.columns
    rules = lambda t: (lambda w, c, s, d, r, n, a: not (w < 50 or 2 * r > w or 10 * s > w or 100 * d > 60 * n or c < 2 * w or c > 15 * w or 100 * a < 70 * w))(*quality.measure(t))
    assert text(kept) == [x for x in text(docs) if rules(x[1])]

    docs, kept = kept, out["toxicity"](spark, kept, SF)
    assert kept.columns == docs.columns
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = text(docs)
    assert text(kept) == [x for x, s in zip(rows, model.scores([t for _, t in rows])) if s < 0.5]

    docs, kept = kept, out["near_dedup"](spark, kept, SF)
    assert kept.columns == docs.columns
    rows = text(docs)
    assert text(kept) == [x for x, (_, c) in zip(rows, near_brute(rows, corpus_pipeline.NEAR_LINK)) if c == x[0]]

    docs, kept = kept, out["pii"](spark, kept, SF)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert not any(pii.base_spans(t) for _, t in text(kept))

    packing_check(out["packing"](spark, kept, SF).collect(), text(kept))


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and rows.count() > 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_and_empty(spark, odd, empty, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    for docs in (odd, empty):
        got = stage(spark, docs, SF)
        if name != "packing":
            assert got.columns == docs.columns
        got.collect()


def test_repeated_rows_are_one_document(spark):
    words = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(5, words), (5, words), (6, words + " x"), (7, "other " * 3 + " ".join(f"v{i}" for i in range(70)))], "doc_id long, text string")
    got = corpus_pipeline.near_dedup(spark, docs, SF)
    assert sorted(r["doc_id"] for r in got.collect()) == [5, 7]
