import corpus_pipeline
from tests.llm.frames import awkward_documents, folded_words, plain_words
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_simhash import brute as components
from tests.llm.test_substring_dedup import brute as repeats


def test_stages_against_brute_force(spark, tmp_path):
    documents = awkward_documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    items = [(1, documents.collect()[4].text), (2, "nothing of this is there at all")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], str(tmp_path))
        if name != "mixing":
            assert out.columns == docs.columns
        path = str(tmp_path / name)
        out.write.parquet(path)
        seen.append(spark.read.parquet(path))
    start, spoken, one, cut, clean, mixed = ([(r.doc_id, r.text) for r in s.collect()] for s in seen)
    key = lambda rows: sorted(map(str, rows))
    assert key(spoken) == key(r for r in start if r[1] and any(c.isalpha() for c in r[1]))
    assert sorted(str(d) for d, _ in one) == sorted(str(x) for x in {c for _, _, c in components(spoken)})
    want = {d: (n, g) for d, n, g, _ in repeats(one)}
    assert {d: len(plain_words(t)) for d, t in cut} == {d: n - g for d, (n, g) in want.items() if not g or g < n}
    bad = {k[0] for k in contaminated(cut, items) if k[5]}
    assert bad and key(clean) == key(r for r in cut if r[0] not in bad)
    assert key(mixed) == key(clean)
    assert all(folded_words(t) or t for _, t in mixed)


def test_run_is_all_stages(spark, tmp_path):
    awkward_documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "one")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert [r.mix_position for r in out.collect()] == list(range(out.count()))


def test_near_dedup_keeps_unrelated_texts_of_one_id(spark, tmp_path):
    texts = [" ".join(f"{a}{i}" for i in range(30)) for a in "abcdef"]
    rows = [(None if i < 3 else 9, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, *rows[2:4]], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.text for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()) == texts


def test_unlabelled_corpus_passes_the_language_stage(spark, tmp_path):
    rows = [(i, t, None, "s", 1) for i, t in enumerate(["some text", "Ünï", "12 -- 3", "", None, "a"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.text for r in corpus_pipeline.identify_language(spark, docs, str(tmp_path)).collect()) == ["a", "some text", "Ünï"]
