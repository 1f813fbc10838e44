"""The pipeline against its operators, stage by stage."""

from pyspark.sql import functions as F

import corpus_pipeline
from folioloom.llm import language_id, line_dedup, near_dedup, quality_rules
from folioloom.plans.scratch import shared_dir


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    good = stages["quality rules"](spark, docs, sf_dir)
    verdict = {r.doc_id: r.kept for r in quality_rules.op1_quality_rules(spark, sf_dir).collect()}
    assert good.columns == columns and {r.doc_id for r in good.select("doc_id").collect()} == {d for d, k in verdict.items() if k}
    known = stages["language ID"](spark, good, sf_dir)
    model = language_id.fit(good)
    assert known.columns == columns and {r.doc_id for r in known.collect()} == {r.doc_id for r in good.collect() if model.predict(r.text)[2]}
    lines = stages["line dedup"](spark, known, sf_dir)
    want = {r.doc_id: r.text for r in line_dedup.dedup_lines(known).collect()}
    assert lines.columns == columns and {r.doc_id: r.text for r in lines.collect()} == want
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    one = stages["MinHash near-dedup"](spark, lines, sf_dir)
    kept = {r.doc_id for r in near_dedup.near_duplicates(lines).collect() if r.kept}
    assert one.columns == columns and {r.doc_id for r in one.collect()} == kept
    packed = stages["best-fit packing"](spark, one, sf_dir)
    assert {r.doc_id for r in packed.collect()} == kept


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_stages_on_edges(spark, sf_dir):
    """Nulls, empty and very long texts, ties, repeated rows and columns named as the stages name theirs."""
    good = [r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) between 300 and 900").limit(6).collect()]
    rows = [(r.doc_id, r.text, r.lang, "s", True, 1.0) for r in good] + [(good[0].doc_id, good[0].text, good[0].lang, "s", True, 1.0)]
    rows += [(9001, None, None, None, None, None), (9002, "", "en", "s", True, 0.0), (None, good[1].text, "en", "s", False, 0.0), (9003, "x" * 200_000, None, "s", True, 0.0), (9004, "word " * 40_000, "en", "s", True, 0.0)]
    schema = "doc_id long, text string, lang string, source string, kept boolean, llr double, lang_pred string, score double, found string, node long, piece int, w long, extra string, dropped boolean"
    docs = spark.createDataFrame([r + ("x", 0.5, "f", 1, 2, 3, "e", False) for r in rows], schema)
    none = spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES:
        for given in (docs, none):
            out = stage(spark, given, sf_dir)
            found = out.collect()
            if name != "best-fit packing":
                assert out.columns == docs.columns, name
                assert len(found) <= given.count() and {r.doc_id for r in found} <= {r.doc_id for r in given.collect()}, name
            assert found == [] if given is none else len(found) > 0 or name == "language ID", name
    near = dict(corpus_pipeline.STAGES)["MinHash near-dedup"](spark, docs, sf_dir).collect()
    assert sum(r.doc_id == good[0].doc_id for r in near) == 2 and any(r.doc_id is None for r in near)  # rows of one id stay together


def test_operators_with_clashing_columns(spark, sf_dir):
    from folioloom.llm import fingerprints, license_scan, packing, pieces, pseudo_likelihood, token_files
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(12).select("doc_id", "text", "lang")
    plain = {r.doc_id for r in docs.collect()}
    for c in ("lang_pred", "score", "accepted", "found", "part", "n_tokens", "text_hash", "dropped", "extra", "key", "bucket", "node", "v", "fingerprint", "n_chars", "piece", "start", "sequence_id", "segmentations", "pll", "n_lines"):
        docs = docs.withColumn(c, F.lit("clash"))
    byte, word = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
    outs = [
        language_id.identify(docs, language_id.fit(docs)), license_scan.scan(docs, license_scan.fit(docs)), packing.pack(docs, byte),
        pseudo_likelihood.score_in_corpus(docs, pseudo_likelihood.fit(docs)), fingerprints.fingerprint_documents(docs),
        pieces.encode_nbest(docs, public_tokenizers.path("piece_bpe_32k.model"), 2), near_dedup.near_duplicates(docs), line_dedup.dedup_lines(docs),
        quality_rules.judge(docs, docs.select("doc_id")), token_files.read_ids(docs, token_files.write_ids(docs, f"{shared_dir(spark)}/clash", word)),
    ]
    assert all({r.doc_id for r in out.select("doc_id").collect()} == plain for out in outs)
