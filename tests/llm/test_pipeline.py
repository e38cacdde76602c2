import corpus_pipeline as P
from quarrymill.llm import chosen_path, decontam, pfair_mix, toxicity_fm

SF = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]


def test_run_is_what_its_operators_decide(spark):
    docs, labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    toxic = {r.doc_id for r in toxicity_fm.score_toxicity(docs, labels).collect() if r.predicted}
    left = docs.where(~docs.doc_id.isin(list(toxic)))
    classes = {}
    for r in chosen_path.near_duplicates(left).collect():
        classes.setdefault(r.class_id, set()).add(r.doc_id)
    left = left.where(left.doc_id.isin([min(c) for c in classes.values()]))
    leaked = {r.doc_id for r in decontam.leaks(left, bench).collect()}
    left = left.where(~left.doc_id.isin(list(leaked)))
    order = [r.doc_id for r in sorted(pfair_mix.mix(left).collect(), key=lambda r: r.mix_order)]
    got = P.run(spark, SF)
    assert got.columns == [*docs.columns, "shard", "position"]
    rows = got.collect()
    assert [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.position))] == order
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(text[r.doc_id] == r.text for r in rows)


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_stages_take_any_table(spark):
    """Nulls in every column, empty and long texts, repeated rows, names that clash, no rows at all."""
    rows = [(None, None, None, None, None, 1, 1, 1), (1, "", "en", "s", 0, 1, 1, 1), (1, "", "en", "s", 0, 1, 1, 1), (2, "long " * 60_000, None, "s", 5, None, 1, 1), (3, "idiot", "en", None, 5, 1, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _d int, mix_slot int, _f int")
    for _, stage in P.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns and 1 <= got.count() <= len(rows)
        assert stage(spark, docs.limit(0), SF).count() == 0
    last = P.STAGES[-1][1]
    assert last(spark, docs, SF).count() == len(rows) and last(spark, docs.limit(0), SF).count() == 0
