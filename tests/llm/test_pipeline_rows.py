"""The pipeline's stages on odd rows: nulls, repeated ids, clashing columns, no rows; nothing that differs may go."""

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row int, member string, component_id string"


def words(seed, n=80):
    return " ".join(f"w{seed}x{(i * 7 + seed * 13) % 997}" for i in range(n))


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t), 5, "m", "c") for d, t in docs], SCHEMA)


def near_duplicates(spark, docs):
    out = corpus_pipeline.near_duplicates(spark, frame(spark, docs), "")
    assert out.columns == frame(spark, []).columns
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)


def test_texts_under_a_repeated_id_are_judged_apart(spark):
    a, b, c = words(1), words(2), words(3)
    kept = near_duplicates(spark, [(1, a), (1, b), (2, b), (3, c), (3, c), (4, c + " more"), (7, None), (7, None), (8, ""), (None, words(4))])
    assert kept == sorted([(1, a), (1, b), (3, c), (7, None), (7, None), (8, ""), (None, words(4))], key=repr)


def test_rows_without_an_id_come_last(spark):
    a = words(1)
    assert near_duplicates(spark, [(None, a), (9, a + " more"), (None, words(2)), (None, words(2))]) == sorted(
        [(9, a + " more"), (None, words(2))], key=repr)


def test_no_rows(spark):
    assert near_duplicates(spark, []) == []
    for name, stage in corpus_pipeline.STAGES:
        if name in ("quality_rules", "personal_data", "best_fit_packing"):
            assert stage(spark, frame(spark, []), "").collect() == [], name
