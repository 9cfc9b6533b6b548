"""The pipeline over a small folder, stage by stage."""

import corpus_pipeline
from lodestrand.llm import exact_dedup, near_dedup, queries


def test_stages(spark, docs, tmp_path):
    one = docs.dropDuplicates(["doc_id"]).selectExpr("doc_id", "text", "lang", "'s' AS source", "cast(length(text) AS long) AS n_chars")
    one.write.parquet(f"{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.dtypes == one.dtypes
        left.append({r["doc_id"]: r["text"] for r in now.collect()})
    assert not {0, 1, 2} & left[0].keys() and {3, 4, 7, 10, 60, 85} <= left[0].keys()
    assert {80, 81} & left[1].keys() == set() and 82 in left[1]
    assert left[3].keys() == left[2].keys() and "AKIA" not in left[3][85] and left[3][85].endswith("[secret]")
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == left[3].keys()


def test_repeated_rows_and_rows_without_id(spark, docs):
    one = docs.dropDuplicates(["doc_id"]).select("doc_id", "text", "lang")
    text = {r["doc_id"]: r["text"] for r in one.collect()}
    more = [(7, text[7], "en"), (7, text[7], "en"), (85, text[85], None), (None, text[7], "en"), (None, "quite another text of its own, with some words", "en"), (None, "quite another text of its own, with some words", "en"), (900, text[3], "en"), (85, text[3], "en")]
    rows = one.union(spark.createDataFrame(more, one.schema))
    exact = exact_dedup.keep_first(rows)
    got = [(r["doc_id"], r["text"]) for r in exact.collect()]
    assert exact.columns == rows.columns and len(got) == len(set(got)) == len({"".join((t or "").split()) for t in [*text.values(), *[m[1] for m in more]]})
    assert {(7, text[7]), (85, text[85]), (None, more[4][1])} <= set(got) and not {(None, text[7]), (85, text[3]), (900, text[3])} & set(got)
    near = near_dedup.keep_representatives(rows, words=5)
    got = [(r["doc_id"], r["text"]) for r in near.collect()]
    assert near.columns == rows.columns and len(got) == len(set(got))
    assert {(7, text[7]), (85, text[85]), (None, text[7]), (None, more[4][1])} <= set(got)
    alone = {r["doc_id"] for r in near_dedup.keep_representatives(one, words=5).collect()}
    assert {k for k, _ in got} == alone | {None}


def test_language_stage_drops_foreign_and_mixed_rows_and_keeps_clean_ones(spark, tmp_path):
    import random

    r = random.Random(11)
    syllables = {"en": ["the", "ing", "and", "th", "er", "on", "an", "ou"], "de": ["ch", "ein", "der", "ung", "sch", "keit", "ge", "zu"], "fi": ["kk", "ää", "yt", "vu", "jok", "pii", "uo", "hy"]}
    text = lambda lang, n: " ".join("".join(r.choice(syllables[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))
    clean = [(k, text(lang, r.randint(3, 120)), lang) for k, lang in enumerate(["en", "de"] * 200)]
    bad = [(1000 + k, text("fi", 60), None) for k in range(30)] + [(1100 + k, text("en", 60) + " " + text("de", 47), None) for k in range(30)] + [(1200, "4 5 6", "en"), (1201, None, "de"), (None, "", None)]
    schema = "doc_id long, text string, lang string, id int, known string"
    docs = spark.createDataFrame([(k, t, lang, 7, "x") for k, t, lang in clean + bad + clean[:1]], schema)
    kept = corpus_pipeline.language_id(spark, docs, str(tmp_path))
    got = [r_["doc_id"] for r_ in kept.collect()]
    assert kept.dtypes == docs.dtypes and got.count(0) == 2
    assert len({k for k in got if k is not None and k < 1000}) >= 0.99 * len(clean)
    assert not {1200, 1201, None} & set(got) and sum(1000 <= (k or 0) < 1100 for k in got) == 0
    assert sum(1100 <= (k or 0) < 1200 for k in got) <= 8


def test_stages_of_an_empty_table(spark, empty, tmp_path):
    now = empty.selectExpr("doc_id", "text", "lang", "'s' AS source", "cast(0 AS long) AS n_chars")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, now, str(tmp_path)).count() == 0


def test_registered():
    assert {f"op{k}" for k in range(1, 14)} == {name.split("_")[0] for name in queries.queries()}
    assert set(queries.oracle_sql()) <= set(queries.queries()) and "pipeline" in corpus_pipeline.queries()
