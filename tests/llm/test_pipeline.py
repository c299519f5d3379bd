"""The pipeline's stages against what each has to do on its own input."""

import re

import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before) and after, name
        if name == "quality_rules":
            assert all(len(WORD.findall(r.text)) >= 50 for r in after.values())
        if name == "line_dedup":
            assert all(r.n_chars == len(r.text) for r in after.values())
        before = after
    items = {r.item_id: WORD.findall(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    held = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (WORD.findall(r.text) for r in before.values())]
    for w in items.values():
        s = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        assert not any(len(s & h) >= 0.8 * len(s) for h in held)
    packed = cp.packed(spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == set(before)


def test_stages_on_odd_rows(spark):
    """Rows without doc_id, repeated rows, null texts, clashing extra columns and an empty table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = docs.orderBy("doc_id").where("length(text) > 500").first().text
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 200").first().text
    clean = " ".join(f"alone{i}" for i in range(90))
    rows = [(None, clean), (None, f"{clean} {item}"), (None, clean), (7, None), (None, None), (8, text), (9, text), (8, f"other words {clean[::-1]}")]
    odd = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 5, 6) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, removed_chunks int, row int")
    for name, stage in cp.STAGES[1:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns, name
        kept = [(r.doc_id, r.text) for r in out.collect()]
        assert all(r.removed_chunks == 5 and r.row == 6 for r in out.collect()), name
        if name == "benchmark_decontamination":
            assert sorted(kept, key=str) == sorted((r for r in rows if item not in (r[1] or "")), key=str)
        if name == "ngram_jaccard_join":
            assert kept.count((None, clean)) == 1 and (8, text) in kept and (9, text) not in kept and (7, None) in kept and (None, None) in kept
        assert stage(spark, odd.limit(0), SF).count() == 0
    first = cp.STAGES[0][1](spark, odd, SF)
    assert first.columns == odd.columns and cp.STAGES[0][1](spark, odd.limit(0), SF).count() == 0
    assert cp.packed(spark, odd, SF).where("piece = 0").count() == len(rows)


def test_keep_one_reads_the_classes_from_storage(spark):
    """What tells the classes is made once: the plan of the kept rows has no join or shuffle of the classes' own, three times over."""
    from cairnlake.llm import ngram_join

    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "h i j k l m n"), (None, None)], "doc_id long, text string")
    kept = ngram_join.keep_one(docs)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ExistingRDD") <= 3 and plan.count("Join") == 1
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 1), (False, 3), (True, None)]


def test_settled_edges_in_one_count(spark):
    """A graph is told to be settled by one count by node; jobs of the adaptive plan are its two shuffles and the result."""
    from cairnlake.operators import graph

    sc = spark.sparkContext
    for k, (edges, want) in enumerate([([], True), ([(2, 1), (3, 1), (9, 8)], True), ([(3, 1), (3, 2)], False), ([(3, 2), (2, 1)], False), ([("c", "b"), ("b", "a")], False)]):
        df = spark.createDataFrame(edges, "a string, b string" if want is False and isinstance(edges[0][0], str) else "a long, b long")
        sc.setJobGroup(f"settled-{k}", "")
        assert graph._settled(df) is want
        assert len(sc.statusTracker().getJobIdsForGroup(f"settled-{k}")) <= 3
    sc.setJobGroup("", "")
