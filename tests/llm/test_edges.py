"""Every operator on odd rows and on empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mendery.llm import decontamination, licenses, mixing, near_duplicates, private, quality, repeats, secrets, sharding, urls


def shard(d):
    return sharding.shard_documents(d, sharding.topology(8), sharding.topology(8, 1))


PER_ROW = {
    "mixing": lambda d: mixing.mix_plan(d, mixing.calibrate(d, mixing.PRODUCTION)),
    "secrets": secrets.secret_spans,
    "repeats": repeats.dedup_report,
    "near duplicates": lambda d: near_duplicates.near_duplicate_report(d, near_duplicates.CONTRACT),
    "sharding": shard,
    "quality": lambda d: quality.quality_verdicts(d, quality.FIXED),
    "private": lambda d: private.private_spans(d, private.fit(d)),
    "licenses": licenses.license_spans,
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_per_document(name, make_documents, odd_rows):
    d = make_documents(odd_rows)
    rows = PER_ROW[name](d).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in odd_rows)
    # repeated rows have equal results, but for the slot each of them takes
    same = [tuple(v for k, v in r.asDict().items() if k != "slot") for r in rows if r.doc_id == 1]
    assert len(same) == 2 and same[0] == same[1]


@pytest.mark.parametrize("name", PER_ROW)
def test_empty_table(name, make_documents):
    assert PER_ROW[name](make_documents([])).collect() == []


def test_null_and_blank_texts(make_documents, odd_rows):
    d = make_documents(odd_rows)
    by_id = lambda f: {r.doc_id: r for r in f.collect() if r.doc_id in (2, 3, 4)}
    found = by_id(PER_ROW["near duplicates"](d))
    assert all(r.n_shingles == 0 and r.component_id == i and r.kept for i, r in found.items())
    assert all(r.n_words == 0 and r.n_removed == 0 for r in by_id(PER_ROW["repeats"](d)).values())
    assert all(r.base_failed and not r.kept for r in by_id(PER_ROW["quality"](d)).values())
    assert all(r.spans == "" for r in by_id(PER_ROW["secrets"](d)).values())
    assert by_id(PER_ROW["sharding"](d))[2].size == 1


def test_leaks_on_odd_and_empty_tables(spark, make_documents, odd_rows):
    schema = "item_id bigint, text string, doc_id string"
    none = spark.createDataFrame([], schema)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "a b c d e f", "x"), (3, odd_rows[0][1], "x"), (3, odd_rows[0][1], "x")], schema)
    assert decontamination.leaks(make_documents(odd_rows), none).count() == 0
    assert decontamination.leaks(make_documents([]), odd).count() == 0
    found = {(r.doc_id, r.item_id) for r in decontamination.leaks(make_documents(odd_rows), odd).collect()}
    assert found == {(1, 3), (7, 3), (9, 3), (None, 3)}


def test_pages_on_odd_and_empty_tables(spark):
    schema = "page_id bigint, url string, html string, bag string, token string"
    assert urls.judge_pages(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, None, None), (2, "no scheme", ""), (3, "://", "<p>a</p>"), (4, "http://A.COM/x", None), (4, "http://A.COM/x", None), (None, "http://b.org", ""), (5, "http://" + "ab" * 5000 + ".org/", "ab " * 9)]
    got = urls.judge_pages(spark.createDataFrame([(*r, "x", "x") for r in rows], schema)).collect()
    # no page is blocked by a rule, so there is nothing to learn from and the model allows
    assert sorted((str(r.page_id), r.host[:8], r.path, r.rule, r.verdict) for r in got) == [
        ("1", "", "", None, "allow"),
        ("2", "", "", None, "allow"),
        ("3", "", "", None, "allow"),
        ("4", "a.com", "/x", "com/", "allow"),
        ("4", "a.com", "/x", "com/", "allow"),
        ("5", "abababab", "/", None, "allow"),
        ("None", "b.org", "", None, "allow"),
    ]


def test_quality_fit_without_labels(spark, make_documents, odd_rows):
    d = make_documents(odd_rows)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert quality.fit(d, none) is quality.FIXED
    odd = spark.createDataFrame([(None, 1, 0), (1, None, None), (1, 1, 0), (1, 1, 0), (99, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert quality.fit(d, odd) is quality.FIXED


def test_filters_keep_all_columns(spark, make_documents, odd_rows):
    d = make_documents(odd_rows)
    bench = spark.createDataFrame([(3, odd_rows[0][1])], "item_id bigint, text string")
    for f in (
        quality.keep_good(d, quality.FIXED),
        near_duplicates.without_near_duplicates(d, near_duplicates.PIPELINE),
        decontamination.without_leaks(d, bench),
        mixing.sample(d, mixing.calibrate(d, mixing.PRODUCTION)),
    ):
        assert f.schema.names == d.schema.names
        assert f.filter(F.col("number") != "x").count() == 0
    kept = [r.doc_id for r in near_duplicates.without_near_duplicates(d, near_duplicates.PIPELINE).collect()]
    assert sorted(x for x in kept if x is not None) == [1, 2, 3, 4, 5, 6, 8, 10, 11]
    assert kept.count(None) == 2


def test_pipeline_on_a_folder(spark, make_documents, odd_rows, prose, tmp_path):
    good = [(100 + i, ". ".join(" ".join(prose(12, 50 + 7 * i + k)).capitalize() for k in range(9)) + ".") for i in range(12)]
    copies = [(200 + i, good[0][1] + f" w{i}") for i in range(3)]
    d = make_documents(odd_rows + good + copies)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    leak = " ".join(good[5][1].split()[10:50])
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(100, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    after = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == d.columns
        after[name] = {r.doc_id for r in docs.collect()}
    ids = {i for i, _ in good}
    assert ids <= after["quality rules"] and not {2, 3, 4, 6, 10} & after["quality rules"]
    assert ids <= after["near duplicates"] and not {200, 201, 202} & after["near duplicates"]
    assert after["decontamination"] == after["near duplicates"] - {105}
    assert after["mixing"] <= after["decontamination"]
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == after["mixing"]
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
