"""Readers, writers, stores and the flows that use them."""

import pytest
from pyspark.sql import functions as F

from precis.functions import text
from precis.operators import forest, models, sentences, transcripts
from precis.plans import lectures, training
from precis.sources import files, store


def test_csv_round_trip_with_row_positions(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('transcript,title,playlist_name\n"a ""q"", \nb",t1,p\n,t2,p\nc,t3,\n', encoding="utf-8")
    rows = files.read_transcripts_csv(spark, str(path)).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in rows] == [0, 1, 2]
    assert rows[0]["transcript"] == 'a "q", \nb' and rows[1]["transcript"] is None
    assert rows[2]["playlist_name"] is None


def test_row_positions_run_on_over_partitions(spark):
    df = spark.range(0, 1000, 1, 7).withColumn("x", F.col("id"))
    got = files.with_row_position(df.drop("id"), "n").where("n != x")
    assert got.count() == 0


def test_notes(spark, tmp_path):
    (tmp_path / "notes_a.txt").write_text("First one. Second one.\n", encoding="utf-8")
    (tmp_path / "notes_b.txt").write_text("", encoding="utf-8")
    notes = files.read_notes(spark, str(tmp_path / "notes_*.txt"))
    assert [r["file_name"] for r in notes.collect()] == ["notes_a.txt"]
    hand = spark.createDataFrame([("notes_a.txt", "Second one.")], "file_name string, sentence string")
    rows = training.training_sentences(notes=notes, hand_labels=hand).orderBy("sentence_id").collect()
    assert [(r["source"], r["label"]) for r in rows] == [("notes", 0), ("notes", 1)]
    assert files.read_note(spark, str(tmp_path / "missing.txt")).count() == 0
    assert files.read_note(spark, str(tmp_path / "notes_a.txt")).count() == 1


def test_empty_pairs_fall_back_to_notes(spark):
    empty = spark.createDataFrame([], "doc_id long, document string, summary string")
    notes = spark.createDataFrame([("a", "Yes. No.")], "file_name string, document string")
    hand = spark.createDataFrame([("a", "No.")], "file_name string, sentence string")
    got = training.training_sentences(empty, notes=notes, hand_labels=hand)
    assert {r["sentence"]: r["label"] for r in got.collect()} == {"Yes.": 0, "No.": 1}
    with pytest.raises(ValueError):
        training.training_sentences()


def test_first_n_and_field_names(spark):
    df = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("t").alias("article"), F.lit("s").alias("gold"))
    got = files.to_pairs(df.repartition(5), "article", "gold", n=7)
    assert got.columns == ["doc_id", "document", "summary"]
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(7))
    assert files.to_pairs(df, "article", "gold", n=99).count() == 50


def test_annotation_sheet(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a b", "c"])], "doc_id long, lecture_section array<string>")
    files.write_annotation_sheet(df, str(tmp_path / "sheet"))
    back = spark.read.options(header=True, escape='"').csv(str(tmp_path / "sheet")).first()
    assert back["lecture_section"] == '["a b","c"]' and not back["paraphrased_summary"]


def test_run_scope_removes_its_tables(spark):
    with store.run_scope(spark) as folder:
        df = store.staged(spark.range(7), "seven")
        assert df.count() == 7 and files.exists(spark, folder)
        assert all(f.startswith("file:") and "/run-" in f for f in df.inputFiles())
    assert not files.exists(spark, folder)
    assert "/run-" not in store.fresh_path(spark, "x")


def test_csv_without_line_breaks_can_be_split(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('file_name,sentence\na,"x, y"\nb,\n', encoding="utf-8")
    from precis import schemas

    for multi_line in (True, False):
        got = files.read_csv(spark, str(path), schemas.HAND_LABELS, multi_line).orderBy("file_name").collect()
        assert [tuple(r) for r in got] == [("a", "x, y"), ("b", None)]


def test_shared_folder_is_the_session_setting(spark):
    assert store.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    df = store.staged(spark.range(5), "five")
    assert df.count() == 5


def corpus(spark):
    words = ["alpha beta gamma", "delta river stone", "cloud rain water", "green apple tree"]
    rows = []
    for d in range(40):
        parts = [f"{words[(d + i) % 4].capitalize()} number {i} keeps going on for a while." for i in range(6)]
        rows.append((d, " ".join(parts), words[d % 4]))
    return spark.createDataFrame(rows, "doc_id long, document string, summary string")


@pytest.fixture(scope="module")
def labeled(spark):
    found = training.training_sentences(corpus(spark), stem=False)
    return store.staged(training.split_by_document(found), "labeled")


@pytest.mark.parametrize("name, params", [
    ("rf", {"num_trees": 5, "max_depth": 4}), ("nb", {}), ("svm", {"max_iter": 10}), ("logreg", {"max_iter": 10}),
    ("linreg", {"max_iter": 10}),
    ("ffn", {"hidden": (4,), "max_iter": 5}),
])
def test_classifiers(spark, labeled, name, params):
    trained = training.train(labeled, [], name, max_features=50, **params)
    rows = training.score(trained, labeled).collect()
    assert len(rows) == labeled.count()
    assert {r["prediction"] for r in rows} <= {0, 1}
    if name != "linreg":
        assert all(0 <= r["score"] <= 1 for r in rows)
    cut = models.THRESHOLDS.get(name)
    if cut is not None:
        assert all(r["prediction"] == int(r["score"] >= cut) for r in rows)
    assert training.report(trained, labeled).count() >= 4


def test_save_load_and_unknown(spark, labeled, tmp_path):
    trained = training.train(labeled, [], "logreg", max_n=2, max_features=50, max_iter=10)
    training.save(trained, str(tmp_path / "m"))
    loaded = training.load(spark, str(tmp_path / "m"), "logreg")
    a = training.score(trained, labeled).orderBy("doc_id", "sentence_id").select("score").collect()
    b = training.score(loaded, labeled).orderBy("doc_id", "sentence_id").select("score").collect()
    assert a == b
    with pytest.raises(FileNotFoundError):
        training.load(spark, str(tmp_path / "none"), "svm")
    with pytest.raises(ValueError):
        training.load(spark, str(tmp_path / "m"), "tree")
    with pytest.raises(ValueError):
        models.fit_classifier("tree", labeled)


def test_summaries_are_ordered_parts_of_the_text(spark, labeled):
    trained = training.train(labeled, [], "logreg", max_features=50, max_iter=10)
    docs = corpus(spark).unionByName(spark.createDataFrame([(99, " ", "x")], "doc_id long, document string, summary string"))
    texts = {r["doc_id"]: r["text"] for r in training.summarize(trained, docs, 3).collect()}
    assert texts.pop(99) == "" and len(texts) == 40
    for row in sentences.plain_sentences(docs.where("doc_id < 99")).collect():
        parts = [s for s in row["sentences"] if s in texts[row["doc_id"]]]
        assert " ".join(parts) == texts[row["doc_id"]] and len(parts) == 3
    means = training.evaluate_summaries(trained, corpus(spark), 3).first()
    assert means["n_docs"] == 40 and 0 < means["rouge1_f"] <= 1


def test_out_of_bag(spark, labeled):
    rows = labeled.withColumn("held", F.lit(False))
    prepared, n_terms = forest.rows_of(rows, [], labeled)
    got = forest.out_of_bag(forest.fit(prepared, n_terms, forest.Settings(num_trees=4, max_depth=3))[1]).first()
    assert got["n"] == labeled.count() and 0 < got["n_voted"] <= got["n"] and 0 <= got["oob_score"] <= 1


def test_two_systems(spark, labeled):
    first = training.train(labeled, [], "logreg", max_features=50, max_iter=10)
    second = training.train(labeled, [], "nb", max_features=50)
    docs = corpus(spark).withColumnRenamed("document", "transcript")
    found = lectures.summarize([first, training.Trained(first.vectorizer, second.classifier, "nb")], docs, 2)
    assert found.count() == 80
    golds = docs.withColumnRenamed("summary", "paraphrased_summary")
    assert lectures.score_systems(found, golds).columns == ["system", "doc_id", "rouge1", "rouge2", "rougeL"]


def test_row_local_operators_run_on_a_stream(spark, tmp_path):
    source = tmp_path / "in"
    raw = spark.createDataFrame([(1, ">> One thing is here. [x] Two things are there, which is more than one.")], "doc_id long, transcript string")
    raw.write.parquet(str(source))
    stream = spark.readStream.schema(raw.schema).parquet(str(source))
    cleaned = stream.select("doc_id", text.clean_transcript(F.col("transcript")).alias("transcript_clean"))
    rows = sentences.sentence_rows(sentences.lecture_sentences(cleaned))
    query = rows.writeStream.format("memory").queryName("stream_out").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("stream_out").count() == 2


def test_hot_copies_do_not_need_one_task(spark):
    """A text that makes up a third of the table is one row per task in the shuffle of digests."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("transcript"))
    kept = transcripts.first_of_copies(df)
    assert kept.count() == 2001
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "partial_min" in plan
