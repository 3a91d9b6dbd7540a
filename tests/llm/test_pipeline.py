"""The corpus pipeline, stage by stage, against plain definitions."""

import brute
import corpus_pipeline as pipeline
from panelforge.llm import quality, secrets
from pyspark.sql import functions as F
from test_operators import CLASH, check_packing, tokens  # noqa: F401

from panelforge.llm.common import fold


def test_run(spark, sf, tokens):  # noqa: F811
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    net = quality.fit(docs.filter(fold("doc_id", 3) != 1), spark.read.parquet(f"{sf}/labels.parquet"))
    rows = docs.collect()
    good = quality.text_scores(net, [r.text for r in rows]) >= 0.5
    left = {r.doc_id: r for r, g in zip(rows, good) if g}
    label, _ = brute.components({d: r.text for d, r in left.items()})
    left = {d: r for d, r in left.items() if label[d] == d}
    found = brute.windows((r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect())
    left = {d: r for d, r in left.items() if not brute.contaminated(r.text, found)}
    scanner, texts = secrets.train(secrets.example_findings()), {}
    for d, r in left.items():
        some = list(secrets.find(r.text or ""))
        text = r.text
        for f, s in reversed(list(zip(some, scanner.judge([(*f[2:], r.source or "") for f in some])))):
            text = text[: f[0]] + "[SECRET]" + text[f[0] + f[1] :] if s >= 0.5 else text
        texts[d] = text
    assert 0 < len(texts) < len(rows)
    check_packing(pipeline.run(spark, sf).collect(), texts, tokens)


def test_stages_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60).withColumns({c: F.lit(1) for c in CLASH})
    for name, stage in pipeline.STAGES[:-1]:
        for some in (docs, docs.limit(0)):
            assert stage(spark, some, sf).columns == docs.columns, name
            assert stage(spark, some, sf).count() <= some.count()


def test_stages_judge_rows(spark, sf):
    """Null ids, repeated ids and rows, null, empty and long texts."""
    item = spark.read.parquet(f"{sf}/benchmark.parquet").filter("length(text) > 80").first().text
    clean = "a clean text of some plain words that nothing else holds here"
    rows = [(None, item), (None, clean), (None, clean), (8, item), (8, "quite another text under the same number as the one before"), (3, None), (4, ""), (4, ""), (5, "lorem ipsum dolor " * 50_000)]
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    scratch = pipeline.materialize(docs.repartition(1), "rows")
    kept = [(r.doc_id, r.text) for r in pipeline.minhash_near_dedup(spark, scratch, sf).collect()]
    assert sorted(kept, key=repr) == sorted([(8, item), *rows[1:2], *rows[4:]], key=repr)  # the smallest id of two copies, one row of two
    kept = [(r.doc_id, r.text) for r in pipeline.benchmark_decontamination(spark, scratch, sf).collect()]
    assert sorted(kept, key=repr) == sorted([*rows[1:3], *rows[4:]], key=repr)
    assert pipeline.secret_scan(spark, scratch, sf).count() == len(rows) and pipeline.best_fit_packing(spark, scratch, sf).filter("piece = 0").count() == len(rows)
    assert pipeline.quality_classifier(spark, scratch, sf).count() <= len(rows)


def test_clean_documents_stay(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").select("doc_id").distinct()
    kept = pipeline.quality_classifier(spark, docs, sf)
    assert kept.join(good, "doc_id", "left_semi").count() >= 0.97 * docs.join(good, "doc_id", "left_semi").count()


def test_stage_names():
    assert [n for n, _ in pipeline.STAGES] == ["quality_classifier", "minhash_near_dedup", "benchmark_decontamination", "secret_scan", "best_fit_packing"]
