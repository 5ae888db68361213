"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for each operator and stage."""

import hashlib

import pytest

from strata.llm import decontam, langid, linededup, ngram_lm, quality, sentencepiece_scan, simhash, token_shards, topk, warc

from .edge import LONG, ROWS, documents, empty


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (3, 0, 0), (4, 0, None), (None, 1, 1), (5, None, 0), (7, 1, 0), (9, 7, 0), (8, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "this is the first document and it has more than a few words"), (2, None), (None, "hello"), (3, ""), (4, "a line of text that several of the documents share"), (4, "...")], "item_id long, text string")


RUNS = {
    "line_dedup": lambda d, labels, benchmark: linededup.dedup_lines(d),
    "simhash": lambda d, labels, benchmark: simhash.near_duplicates(d),
    "quality": lambda d, labels, benchmark: quality.classify(d, labels),
    "langid": lambda d, labels, benchmark: langid.identify(d),
    "lm": lambda d, labels, benchmark: ngram_lm.train_and_score(d),
    "sentencepiece": lambda d, labels, benchmark: sentencepiece_scan.encode(d, size=4096),
    "decontamination": lambda d, labels, benchmark: decontam.decontaminate(d, benchmark),
}


@pytest.mark.parametrize("name", RUNS)
def test_every_row_has_a_result(spark, name, labels, benchmark):
    out = RUNS[name](documents(spark), labels, benchmark).toPandas()
    assert sorted(out["doc_id"].dropna().astype("int64")) == sorted(r[0] for r in ROWS if r[0] is not None)
    assert out["doc_id"].isna().sum() == 2
    twice = out[out["doc_id"] == 1].map(str)
    assert len(twice) == 2 and (twice.iloc[0] == twice.iloc[1]).all()


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(spark, name, labels, benchmark):
    assert RUNS[name](empty(spark), labels, benchmark).count() == 0
    assert RUNS[name](empty(spark), labels.limit(0), benchmark.limit(0)).count() == 0


@pytest.mark.parametrize("name", RUNS)
def test_nothing_to_learn_or_match(spark, name, labels, benchmark):
    assert RUNS[name](documents(spark), labels.limit(0), benchmark.limit(0)).count() == len(ROWS)


def test_line_dedup_results(spark):
    out = {r["doc_id"]: r for r in linededup.dedup_lines(documents(spark)).collect() if r["doc_id"] is not None}
    # ids -3, 1, 7 and 9 hold the shared line; the row without an id doesn't count and keeps it
    assert [out[i]["n_dropped"] for i in (-3, 1, 7, 9)] == [1, 1, 1, 0]
    assert out[2]["n_lines"] == 1 and out[3]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    lost = [r for r in linededup.dedup_lines(documents(spark)).collect() if r["doc_id"] is None]
    assert all(r["n_dropped"] == 0 for r in lost)


def test_simhash_results(spark):
    out = [r.asDict() for r in simhash.near_duplicates(documents(spark)).collect()]
    blank = [r for r in out if r["fingerprint"] == "0" * 16]
    assert {r["doc_id"] for r in blank} == {2, 3, 4, None} and {r["component_id"] for r in blank} == {2}


def test_quality_without_one_label(spark, labels):
    out = quality.classify(documents(spark), labels.where("quality = 1")).collect()
    assert {(r["score"], r["predicted"]) for r in out} == {(0.7, 1)}


def test_langid_of_texts_without_letters(spark):
    out = {r["doc_id"]: r for r in langid.identify(documents(spark)).collect() if r["doc_id"] is not None}
    assert [out[i]["lang_pred"] for i in (2, 3, 4, 8)] == ["und"] * 4 and out[2]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in out.values()) and out[5]["lang_pred"] in ("de", "en", "fr")


def test_lm_of_empty_texts(spark):
    out = [r for r in ngram_lm.train_and_score(documents(spark)).collect() if r["doc_id"] in (2, 3, 4)]
    assert {r["n_tokens"] for r in out} == {1} and all(r["score"] <= 0 for r in out)
    alone = ngram_lm.train_and_score(documents(spark).where("doc_id is null")).collect()
    assert {(r["train_tokens"], r["base_score"], r["score"]) for r in alone} == {(0, 0.0, 0.0)}


def test_sentencepiece_round_trips(spark):
    out = sentencepiece_scan.encode(documents(spark), size=4096).collect()
    assert all(r["round_trip"] for r in out) and {r["n_tokens"] for r in out if r["doc_id"] in (2, 3)} == {0}


def test_decontamination_results(spark, benchmark):
    out = {r["doc_id"]: r for r in decontam.decontaminate(documents(spark), benchmark).collect()}
    assert out[9]["item_ids"] == [4] and out[7]["item_ids"] == [4] and not out[5]["contaminated"] and not out[2]["contaminated"]


def test_token_shards(spark, tmp_path):
    path = f"file://{tmp_path}/shards"
    meta = token_shards.write_shards(documents(spark), path, seq_len=128, shard_slots=100)
    spans = spark.read.parquet(f"{path}/spans")
    assert spans.where("from_token = 0").count() == len(ROWS) and meta["sequences"] == token_shards.read_records(spark, path).count()
    none = token_shards.write_shards(empty(spark), f"{path}-none")
    assert none["sequences"] == 0 and token_shards.read_records(spark, f"{path}-none").count() == 0
    assert token_shards.shard_documents(empty(spark)).count() == 0


def test_warc_cases(spark):
    rows = [(1, "http://a/\r\nX: y", "same"), (2, None, "same"), (2, None, "same"), (3, "http://c", None), (4, "http://d", ""), (None, "http://e", "same"), (5, "http://f", LONG), (None, "http://g", "own")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as key", "'x' as header", "'x' as payload")
    out = warc.archive_pages(pages).toPandas().astype(object)
    got = sorted((str(r.page_id).replace(".0", ""), r.record_type, str(r.refers_to).replace(".0", ""), r.payload_bytes) for r in out.itertuples())
    assert got == sorted([("1", "response", "nan", 4), ("2", "revisit", "1", 4), ("2", "revisit", "1", 4), ("3", "response", "nan", 0), ("4", "revisit", "3", 0), ("nan", "revisit", "1", 4), ("5", "response", "nan", len(LONG)), ("nan", "response", "nan", 3)])
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_topk_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [0.5, 0.5]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (8, []), (200, []), (1, [1.0, 0.0]), (300, [1.0, 2.0, 3.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' as id", "'x' as dim", "'x' as rank", "'x' as score", "'x' as row", "'x' as wide")
    out = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(v, k=3).orderBy("query_id", "rank").collect()]
    # both rows of id 1 count
    assert out == [(0, 1, 1, 1048576), (0, 2, 1, 1048576), (0, 3, 2, 1048576), (100, 1, 0, 524288), (100, 2, 1, 524288), (100, 3, 1, 524288), (200, 1, 8, 0)]
    assert topk.top_k(v.limit(0)).count() == 0


def test_language_of_one_document(spark):
    rows = [(i, "the quick brown fox jumps over the lazy dog", "en") for i in range(40)]
    lone = next(i for i in range(100, 200) if not spark.range(i, i + 1).select(langid.held_out(langid.F.col("id"), 4, 2)).first()[0])
    rows += [(lone, "zażółć gęślą jaźń według każdego", "pl")]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[lone] == "pl" and got[0] == "en"


def test_pipeline_stages(spark, tmp_path, labels, benchmark):
    import corpus_pipeline

    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    for make in (documents, empty):
        docs = make(spark)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == corpus_pipeline.COLUMNS, name
            out.write.mode("overwrite").parquet(f"{tmp_path}/{name}-{make.__name__}")
            docs = spark.read.parquet(f"{tmp_path}/{name}-{make.__name__}")
    docs = spark.read.parquet(f"{tmp_path}/near_dedup-documents")
    ids = [r["doc_id"] for r in docs.collect()]
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None}) and ids.count(None) <= 2
