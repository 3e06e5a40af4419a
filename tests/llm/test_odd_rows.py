"""Every query and stage on tables with nulls, empty and long texts, repeated rows, clashing columns, and on empty tables."""

import corpus_pipeline
import odd
import pytest
from sparktape.llm import registry

PER_DOCUMENT = ["op2_mix_sources", "op3_token_counts", "op5_simhash_near_dedup", "op6_quality_classifier", "op7_quality_rules", "op8_toxicity", "op9_language_id", "op10_license_scan"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    return odd.write(spark, tmp_path_factory.mktemp("odd"))


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return odd.write(spark, tmp_path_factory.mktemp("empty"), [])


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_one_row_per_document(spark, folder, name):
    found = registry.queries()[name](spark, folder).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(r[0]) for r in odd.documents())
    for r in found:
        if "score" in r:
            assert 0 <= r.score <= 1
    again = registry.queries()[name](spark, folder).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


PAGES = [*range(12), 20, 21, 22, 23, None, 0, 30]


@pytest.mark.parametrize("name", ["op4_warc", "op13_html_extraction"])
def test_one_row_per_page(spark, folder, name):
    found = registry.queries()[name](spark, folder).collect()
    assert sorted(str(r.page_id) for r in found) == sorted(map(str, PAGES))
    again = registry.queries()[name](spark, folder).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    of = {str(r.page_id): r for r in found}
    if name == "op4_warc":
        assert (of["20"].payload_bytes, of["20"].record_type, of["20"].refers_to) == (0, "response", None)
        assert of["30"].payload_bytes == 600_000 and (of["3"].record_type, of["3"].refers_to) == ("revisit", 0)
        assert of["22"].record_type == of["23"].record_type == "response"  # too short to be revisited
    else:
        assert of["20"].text == of["21"].text == "" and of["30"].n_chars == len(of["30"].text)


def test_items_are_found_in_odd_documents(spark, folder):
    found = registry.queries()["op1_benchmark_decontamination"](spark, folder).collect()
    pairs = {(r.doc_id, r.item_id) for r in found}
    texts = {r[0]: r[1] for r in odd.documents()}
    assert {(5, 1), (6, 2)} <= pairs and {i for _, i in pairs} == {1, 2}  # neither the null item nor the short one
    assert all(texts[d] for d, _ in pairs)
    again = registry.queries()["op1_benchmark_decontamination"](spark, folder).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_odd_vectors(spark, folder):
    found = registry.queries()["op11_centroid_clustering"](spark, folder).collect()
    assert sorted(str(r.vec_id) for r in found) == sorted(map(str, [*range(120), 0, None, 200]))
    assert len({r.inertia for r in found}) == 1 and found[0].inertia == sum(r.distance for r in found)
    mined = registry.queries()["op12_hard_negatives"](spark, folder).collect()
    assert mined and {r.anchor_id for r in mined} <= {0, 100} and all(1 <= r.rank <= 5 for r in mined)
    assert sorted(map(str, registry.queries()["op12_hard_negatives"](spark, folder).collect())) == sorted(map(str, mined))


@pytest.mark.parametrize("name", list(registry.queries()))
def test_empty_tables(spark, empty, name):
    assert registry.queries()[name](spark, empty).collect() == []


def test_stages(spark, folder, empty):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.columns == columns
        kept[name] = [r.doc_id for r in out.select("doc_id").collect()]
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert not {i for i in kept["quality_classifier"] if i is not None and i < 80 and i % 10 == 3}
    assert {i for i in range(80) if i % 10 not in (3,)} <= set(kept["quality_classifier"])
    assert not {93, 94, 95, 96} & set(kept["quality_rules"])
    assert len(kept["near_dedup"]) == len(set(kept["near_dedup"])) and 0 in kept["near_dedup"] and 90 not in kept["near_dedup"]
    assert 5 not in kept["benchmark_decontamination"] and 6 not in kept["benchmark_decontamination"]
    assert corpus_pipeline.run(spark, empty).collect() == []


def test_each_stage_alone_keeps_odd_rows_whole(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert set(map(tuple, out.collect())) <= set(map(tuple, docs.collect()))
