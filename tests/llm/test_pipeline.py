from __future__ import annotations

import __spark_entry__
import corpus_pipeline
from quern.llm import decontamination, near_duplicates, packing, secrets, toxicity
from quern.llm.tokens import default_tokenizer, encoder


def test_stages_against_their_operators(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    benchmark = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = docs
    results = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, sf)
        results[name] = out
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            kept = spark.createDataFrame(out.collect(), docs.schema)
            results[name] = kept
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = toxicity.trained(toxicity.training_sample(docs, spark.read.parquet(f"{sf}/labels.parquet")))
    clean = {d for d, t in texts.items() if model.score(t) < 0.3}
    assert {r.doc_id for r in results["toxicity"].collect()} == clean
    one = {r.doc_id for r in results["near_dedup"].collect()}
    seen = {}
    for d in sorted(clean):
        seen.setdefault(texts[d], d)
    assert one <= set(seen.values())
    links = [(a, b) for a in one for b in one if a < b and near_duplicates.similarity([*texts[a].split()], [*texts[b].split()])] if len(one) < 60 else []
    assert not links
    match = decontamination.Matcher(benchmark, 0.15)
    assert {r.doc_id for r in results["decontamination"].collect()} == {d for d in one if next(match(texts[d]), None) is None}
    for r in results["secret_scan"].collect():
        assert not secrets.base_spans(r.text) or r.text.count("[SECRET]")
        assert r.n_chars == len(r.text)
    encode = encoder(default_tokenizer())
    wanted = sorted((r.doc_id, p, s, n) for r in results["secret_scan"].collect() for p, (s, n) in enumerate(packing.cut(len(encode(r.text)) + 1, 2048)))
    assert wanted == sorted((r.doc_id, r.piece, r.start, r.length) for r in results["best_fit_packing"].collect())


def test_run_is_the_stages(spark, sf):
    rows = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "sequence_id", "offset"} <= set(rows.columns) and rows.count() > 0


def test_stages_on_hard_rows(spark, hard, none, tmp_path):
    """Nulls, empty and long texts, ties, repeats and clashing columns through every stage; then an empty table."""
    spark.createDataFrame([(i, i % 2, i % 2) for i in range(10)] + [(1, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "seven more words follow here nowhere else"), (2, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out, empty = stage(spark, hard, str(tmp_path)), stage(spark, none, str(tmp_path))
        assert empty.count() == 0, name
        if name == "best_fit_packing":
            pieces = out.collect()
            assert sum(r.piece == 0 for r in pieces) == hard.count()
            continue
        assert out.columns == hard.columns and [f.dataType for f in out.schema] == [f.dataType for f in hard.schema]
        ids = sorted((r.doc_id for r in out.collect()), key=str)
        every = sorted((r.doc_id for r in hard.collect()), key=str)
        assert {"toxicity": set(ids) <= set(every), "near_dedup": ids == sorted([1, 4, 6, 7, 8, 9, None], key=str), "decontamination": ids == every, "secret_scan": ids == every}[name], name


def test_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= names


def test_queries_do_not_fail_on_empty_tables(spark, sf, tmp_path):
    for t in ("documents", "labels", "benchmark", "pages"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    for name, f in __spark_entry__.queries().items():
        if name == "pipeline" or name[:3] in ("op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9"):
            if name[:2] == "op" or name == "pipeline":
                assert f(spark, str(tmp_path)).count() == 0, name
