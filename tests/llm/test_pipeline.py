import pytest

import corpus_pipeline as P
from tests.llm.test_corpus import TEXTS

SF = "/root/testdata/sf0.001"
#: Columns of documents, and such as the operators use themselves.
ODD = "doc_id long, text string, lang string, source string, n_chars long, __gone long, __id long, id long, a long, b long, key string, score double, spans string"


@pytest.fixture(scope="module")
def odd(spark):
    insult = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1"), "doc_id").orderBy("doc_id").limit(3).collect()]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    texts = TEXTS + [(100 + k, t) for k, t in enumerate(insult)] + [(200, item), (200, item), (None, item)]
    rows = [(i, t, None if k % 2 else "en", None if k % 3 else "web", None if k % 5 else 7, i, k, k, i, 1, None, 0.5, "s") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, ODD).repartition(3).cache()


@pytest.mark.parametrize("name,stage", P.STAGES)
def test_odd_tables(spark, odd, name, stage):
    """Nulls in every column, empty and long texts, repeated rows, clashing columns, no rows."""
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] if name == "packing" else odd.columns
    empty = stage(spark, odd.limit(0), SF)
    assert empty.count() == 0 and set(columns) <= set(empty.columns)
    out = stage(spark, odd, SF)
    rows, given = out.collect(), odd.collect()
    assert set(columns) <= set(out.columns)
    if name == "packing":
        assert {r.doc_id for r in rows} == {r.doc_id for r in given}
        return
    assert out.columns == columns
    # columns beside the text and its length go through; a row with a null id is never taken out
    key = lambda r: tuple(v for c, v in r.asDict().items() if c not in ("text", "n_chars"))
    assert {key(r) for r in rows} <= {key(r) for r in given}
    assert sum(r.doc_id is None for r in rows) == sum(r.doc_id is None for r in given)
    ids = {r.doc_id for r in rows}
    plain = {5, 6, 7, 8, 10, 12}
    assert plain <= ids
    if name == "near_dedup":
        assert 1 in ids and not {2, 3, 9, 11} & ids and sum(r.doc_id == 200 for r in rows) == 2
    elif name == "decontamination":
        assert 200 not in ids and len(ids) == len({r.doc_id for r in given}) - 1
    elif name == "pii":
        assert len(rows) == len(given) and all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
        assert "[EMAIL]" in next(r.text for r in rows if r.doc_id == 12)


def test_stages(spark):
    from runnel.llm.common import documents, written
    from runnel.llm.op2_pii import personal_spans
    from runnel.llm.op5_lsh_forest import near_duplicates
    from runnel.llm.op9_decontamination import contaminated

    sf = SF
    docs = documents(spark, sf)
    columns, kept = docs.columns, docs.count()
    for name, stage in P.STAGES[:-1]:
        docs = written(stage(spark, docs, sf), f"test-{name}")
        assert docs.columns == columns and 0 < docs.count() <= kept
        kept = docs.count()
        if name == "near_dedup":
            assert near_duplicates(docs).where("not kept").count() == 0
        if name == "decontamination":
            assert contaminated(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0
        if name == "pii":
            assert personal_spans(docs).where("size(base) > 0").count() == 0
    pieces = P.STAGES[-1][1](spark, docs, sf).toPandas()
    assert set(pieces.doc_id) == {r[0] for r in docs.select("doc_id").collect()}
    assert (pieces.groupby("doc_id").length.sum() == pieces.groupby("doc_id").doc_tokens.first()).all()
    # ``run`` packs the same documents into the same number of ids
    whole = P.run(spark, sf).toPandas()
    assert len(whole) > 0 and sorted(set(zip(whole.doc_id, whole.doc_tokens))) == sorted(set(zip(pieces.doc_id, pieces.doc_tokens)))
    assert whole.groupby("sequence_id").length.sum().max() <= 2048
