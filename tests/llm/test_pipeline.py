import public_tokenizers

import corpus_pipeline as P
from roundel.llm import decontamination, language_id, ngram_join, piece_codec, secret_scan

DATA = "/root/testdata/sf0.001"


def test_stages_name_the_operators_in_order():
    assert [n for n, _ in P.STAGES] == ["language_id", "near_duplicates", "decontamination", "secrets", "pieces"]


def test_run_equals_its_steps_by_hand(spark):
    from pyspark.sql import functions as F

    source = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("found", F.lit("clash"))
    rows = {r.doc_id: r for r in source.collect()}
    known = language_id.predict(source, language_id.learn(source)).select("row.doc_id", "lang_pred", "score").collect()
    left = {r.doc_id for r in known if r.lang_pred != "und" and r.score >= P.MIN_SCORE}
    group = {r.doc_id: r.component_id for r in ngram_join.ngram_components(source.where(F.col("doc_id").isin(*left))).collect()}
    left = {i for i in left if group[i] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    match = decontamination.Matcher(items, decontamination.PERCENT)
    left = {i for i in left if not match.find(rows[i].text)}
    spans = {r.doc_id: r.found for r in secret_scan.scan_secrets(source).collect()}
    codec = piece_codec.PieceCodec(public_tokenizers.path("piece_bpe_32k.model"))
    out = {r.doc_id: r for r in P.run(spark, DATA).collect()}
    assert set(out) == left and all(r.round_trip for r in out.values())
    for i, r in out.items():
        text, at, parts = rows[i].text, 0, []
        for s in spans[i]:
            if s.start >= at:
                parts += [text[at : s.start], "[SECRET]"]
            at = max(at, s.stop)
        assert r.text == "".join(parts) + text[at:]
        assert r.ids == codec.encode([r.text])[0].tolist()


def test_all_but_the_last_stage_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name


def test_stages_judge_rows_not_ids(spark):
    base = [f"w{i}" for i in range(60)]
    near, other = " ".join([*base[:59], "x"]), " ".join(f"v{i}" for i in range(60))
    one, two = (r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").limit(2).collect())
    rows = [(1, " ".join(base)), (2, near), (2, other), (3, "own text of one row here"), (3, "own text of one row here"), (None, near), (None, f"{two} x"), (4, f"a {one}"), (4, "clean text under the same id"), (5, ""), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row_hash int")
    left = P.drop_near_duplicates(spark, docs, DATA)
    assert left.columns == docs.columns
    got = sorted((x.doc_id or 0, x.text) for x in left.collect())
    assert got == sorted([(1, " ".join(base)), (2, other), (3, "own text of one row here"), (0, f"{two} x"), (4, f"a {one}"), (4, "clean text under the same id"), (5, ""), (5, "")])
    clean = P.drop_contaminated(spark, left, DATA)
    assert sorted((x.doc_id or 0) for x in clean.collect()) == [1, 2, 3, 4, 5, 5] and clean.columns == docs.columns
