"""The pipeline's stages on null and repeated ids, ties, empty tables and further columns."""

import corpus_pipeline
from tests.llm.test_edges import WORDS

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _hash string, uid int"


def _docs(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", len(t or ""), "h", 1) for k, t in rows], SCHEMA)


def test_one_row_of_each_component_stays(spark):
    base = WORDS[:100]
    near = [" ".join([*base[:99 - k], *[f"x{k}{i}" for i in range(k + 1)]]) for k in range(4)]  # linked, not equal
    other = " ".join(WORDS[100:150])
    rows = [(7, near[0]), (7, near[1]), (7, near[2]), (None, near[3]), (None, near[3]), (None, other), (None, other),
            (7, " ".join(WORDS[20:60])), (3, None), (3, ""), (3, None)]
    docs = _docs(spark, rows).repartition(4)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    # one of the linked texts, of an id; one of the equal ones without; the one that is like no other
    assert sum(t in near for _, t in got) == 1 and next(k for k, t in got if t in near) == 7
    assert got.count((None, other)) == 1 and got.count((7, " ".join(WORDS[20:60]))) == 1
    assert sorted((k, t or "-") for k, t in got if k == 3) == [(3, "-"), (3, "-")] and len(got) == 5


def test_stages_of_an_empty_table(spark, sf_dir):
    docs = _docs(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
