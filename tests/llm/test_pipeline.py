"""The corpus pipeline on the smallest tables, stage by stage against brute force."""

import hashlib

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import DATA, ODD, prose
from tests.llm.test_corpus_operators import brute_classes
from tests.llm.test_text_operators import brute_spans
from tidemark.llm import bpe, quality


def test_stages(spark, small, tmp_path):
    docs, seen = small, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        if name != "BPE encoding":
            assert out.columns == small.columns
        out.write.parquet(str(tmp_path / name.replace(" ", "_")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
    rows = {r["doc_id"]: r for r in small.collect()}
    model = quality.train(small, spark.read.parquet(f"{DATA}/labels.parquet"))
    kept = {r["doc_id"] for r in quality.with_quality(small, model).where("kept").collect()}
    assert set(seen["quality rules"]) == kept
    classes = brute_classes([(d, rows[d]["text"]) for d in sorted(kept)])
    assert set(seen["n-gram Jaccard join"]) == {c for _, c, _ in classes}
    assert set(seen["benchmark decontamination"]) < set(seen["n-gram Jaccard join"])
    before, after = seen["benchmark decontamination"], seen["personal data"]
    assert set(before) == set(after)
    for d, r in after.items():
        assert (r["text"] != before[d]["text"]) >= bool(brute_spans(before[d]["text"])) and not brute_spans(r["text"]) and r["n_chars"] == len(r["text"])
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    for d, r in seen["BPE encoding"].items():
        assert r["ids"] == library.encode(after[d]["text"], add_special_tokens=False).ids
    run = {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, DATA).collect()}
    assert run == {d: hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest() for d, r in seen["BPE encoding"].items()}


def test_stages_on_odd_rows(spark, docs_of):
    """Nulls, repeated rows, an empty table, and columns named as the operators' own."""
    text = prose(11, 120)
    rows = [*ODD, (20, text), (20, text), (21, text + " mail me at a.b@c.dd now"), (22, prose(12, 200)), (23, None)]
    clash = ("kept", "n_words", "word_chars", "quality_score", "base_failed", "pii_spans", "redacted_text", "leaks", "class_id", "rep_id", "n_links", "ids", "features", "__own0")
    docs = docs_of(rows)
    for c in clash:
        docs = docs.withColumn(c, F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, DATA)
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            for r in out.collect():
                assert all(r[c] == f"{c} of {'none' if r['doc_id'] is None else r['doc_id']}" for c in clash), name
    out = corpus_pipeline.pii_stage(spark, docs, DATA).where("doc_id = 21").first()
    assert out["text"].endswith("<EMAIL> now") and out["n_chars"] == len(out["text"])
    assert corpus_pipeline.pii_stage(spark, docs, DATA).count() == len(rows)
    left = [r["doc_id"] for r in corpus_pipeline.duplicate_stage(spark, docs, DATA).collect()]
    assert left.count(20) == 1 and left.count(4) == 1 and 21 not in left and 22 in left
    assert corpus_pipeline.bpe_stage(spark, docs, DATA).count() == len(rows) and corpus_pipeline.bpe_stage(spark, docs.limit(0), DATA).count() == 0
