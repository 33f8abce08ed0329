"""Each stage on its own input, and the whole."""

import corpus_pipeline
from lumenwatch.llm import queries

from .conftest import SF


def test_stages_keep_columns_and_survive_odd_input(spark, docs, none, rows):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert out.count() <= len(rows)
        assert stage(spark, none, SF).count() == 0
    assert stage(spark, none, SF).columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).where("doc_id IS NOT NULL").select("doc_id").distinct().count() == len({r[0] for r in rows} - {None})


def test_stages_take_effect(spark, docs, rows):
    stages = dict(corpus_pipeline.STAGES)
    spoken = {r.doc_id for r in stages["language"](spark, docs, SF).collect()}
    assert {r[0] for r in rows if r[1] and r[1].startswith("12 34")}.isdisjoint(spoken) and 9 in spoken
    unique = [r.doc_id for r in stages["near_duplicates"](spark, docs, SF).where("doc_id IS NOT NULL").collect()]
    assert len(unique) == len(set(unique)) and 8 in unique and not {21, 22, 23, 24} & set(unique)
    private = {r.doc_id: r for r in stages["pii"](spark, docs, SF).collect()}
    masked = next(r for r in private.values() if r.text and "[EMAIL]" in r.text)
    assert masked.n_chars == len(masked.text)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    leaked = spark.createDataFrame([(1, f"before {bench} after", "en", "s", 1), (2, "clean words only", "en", "s", 16), (3, bench, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    left = {r.doc_id: r.text for r in stages["decontamination"](spark, leaked, SF).collect()}
    assert left == {1: left[1], 2: "clean words only"} and left[1].startswith("before ") and left[1].endswith(" after") and len(left[1]) < 30


def test_mixtures_of_languages_stay(spark):
    texts = {"en": "the cat and the dog sat with them ", "de": "der hund und die katze sitzen noch ", "es": "el perro y los gatos duermen juntos ", "fr": "le chien dort avec ses beaux chats "}
    rows = [(i, text * 30, lang) for i, (lang, text) in enumerate(texts.items())]
    rows += [(8, texts["en"] * 12 + texts["de"] * 9 + texts["es"] * 9, None), (9, "12 34 --", None)]
    kept = corpus_pipeline.languages(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), SF)
    assert {r.doc_id for r in kept.collect()} == {0, 1, 2, 3, 8}


def test_run_gives_packed_pieces(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "sequence_id", "offset", "length", "ids"} <= set(out.columns) and out.count() > 0
    assert out.where("size(ids) <> length").count() == 0
    assert set(queries.oracle_sql()) <= set(queries.queries()) and len(queries.queries()) == 13
