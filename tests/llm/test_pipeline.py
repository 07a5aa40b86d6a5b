"""The pipeline on tables with planted cases, and the stages against brute force."""

import collections

import corpus_pipeline
from tests.llm.cases import documents
from tests.llm.test_models_and_pii import PEOPLE, brute_spans
from tests.llm.test_pairs_and_packs import brute_components, brute_mark
from tests.llm.test_text_rules import ITEM, brute_base, contamination


def test_stages(spark, tmp_path):
    _, items = contamination(spark)
    extra = [(200, "before it " + ITEM + " and after", "en"), *PEOPLE[:3]]
    documents(spark, extra).write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    before = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path}/{name}.parquet"
        stage(spark, before, str(tmp_path)).write.parquet(path)
        after = spark.read.parquet(path)
        seen[name] = (before.collect(), after.collect())
        if name != names[-1]:
            assert after.columns == docs.columns
        before = after
    raw, good = seen["quality_rules"]
    assert all(not brute_base(r.text)[-1] for r in good) and {r.doc_id for r in raw} - {r.doc_id for r in good} >= {100, 101, 102, 108, 109}
    raw, unique = seen["near_duplicates"]
    root = brute_components({brute_mark(r.text) for r in raw if r.doc_id is not None})
    first = {}
    for r in raw:
        if r.doc_id is not None:
            m = root[brute_mark(r.text)]
            first[m] = min(first.get(m, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in unique if r.doc_id is not None) == sorted(first.values())
    raw, clean = seen["decontamination"]
    assert {r.doc_id for r in raw} - {r.doc_id for r in clean} == {200}
    raw, private = seen["personal_data"]
    assert collections.Counter(r.doc_id for r in raw) == collections.Counter(r.doc_id for r in private)
    assert not any(brute_spans(r.text) for r in private)
    raw, packed = seen["packing"]
    assert {r.doc_id for r in packed} == {r.doc_id for r in raw}
    whole = corpus_pipeline.run(spark, str(tmp_path))
    key = lambda r: (str(r.doc_id), r.piece, r.ids_crc32)
    assert sorted(map(key, whole.collect())) == sorted(map(key, packed))
