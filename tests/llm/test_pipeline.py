"""The pipeline, stage by stage, against brute force on the smallest tables."""

import duckdb
import pandas as pd

import corpus_pipeline
from tessera.llm import near_dup, quality, queries, secrets
from tests.llm.test_corpus import brute_components, brute_contamination

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "near duplicates", "decontamination", "secret scan", "sentencepiece"]
    given = {r["doc_id"]: r for r in docs.collect()}

    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = corpus_pipeline.quality_stage(spark, docs, SF).cache()
    tails = {i: model.tails([model.score(r["text"].encode())])[0][1] for i, r in given.items()}
    assert {r["doc_id"] for r in good.collect()} == {i for i, t in tails.items() if t >= 0.5} and good.columns == columns

    one = corpus_pipeline.near_duplicate_stage(spark, good, SF).cache()
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    component = brute_components(rows)
    assert {r["doc_id"] for r in one.collect()} == {i for i in component if component[i] == i} and one.columns == columns

    clean = corpus_pipeline.decontamination_stage(spark, one, SF).cache()
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    hit = {r[0] for r in brute_contamination([(r["doc_id"], r["text"]) for r in one.collect()], items) if r[5]}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in one.collect()} - hit and clean.columns == columns

    letters = secrets.letter_costs(clean)
    masked = corpus_pipeline.secret_stage(spark, clean, SF).cache()
    assert masked.columns == columns and masked.count() == clean.count()
    for r in masked.collect():
        assert r["text"] == secrets.redact_text(given[r["doc_id"]]["text"], letters=letters) and r["n_chars"] == len(r["text"])
        assert not secrets.scan(r["text"], letters=letters)

    tokens = corpus_pipeline.token_stage(spark, masked, SF)
    assert tokens.count() == masked.count()
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == {r["doc_id"] for r in masked.collect()}


def test_deduplicate_keeps_one_row_of_rows_that_repeat_an_id(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None), (None, "x")], "doc_id long, text string")
    assert sorted(map(repr, (tuple(r) for r in near_dup.deduplicate(docs).collect()))) == sorted(
        map(repr, [(1, "a b c d e f"), (3, None), (None, "x")]))


def test_sql_of_the_operators(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        mine = queries.QUERIES[name](spark, SF).toPandas()
        other = con.sql(sql).df()[list(mine.columns)]
        # a long column with nulls comes as floats from one engine, as nullable integers from the other
        value = lambda v: None if pd.isna(v) else int(v) if isinstance(v, float) and v.is_integer() else v
        plain = lambda df: sorted(repr([value(v) for v in row]) for row in df.astype(object).values.tolist())
        assert plain(mine) == plain(other), name
