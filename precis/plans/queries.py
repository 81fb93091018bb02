"""Registered queries: every operator over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from precis import fixed_values as fixed
from precis import schemas
from precis.functions import text
from precis.operators import (
    chat, evaluation, features, forest, labels, linear, models, naive_bayes, ranking, rouge, sentences, sequences,
    splits, summaries, transcripts,
)
from precis.plans import inputs, lectures, training
from precis.sources import files, store


# --- cleaning, sentences, topics -------------------------------------------------------------


def _lectures(spark: SparkSession, folder: str) -> DataFrame:
    return lectures.prepare(inputs.transcripts(spark, folder))


def clean_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = transcripts.clean(inputs.transcripts(spark, folder))
    return cleaned.select("doc_id", "transcript_clean", "token_count")


def dedup_first(spark: SparkSession, folder: str) -> DataFrame:
    kept = transcripts.drop_missing(inputs.transcripts(spark, folder))
    return transcripts.first_of_copies(kept).select("doc_id", "title")


def word_sections(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = transcripts.clean(inputs.transcripts(spark, folder))
    return transcripts.with_sections(cleaned).select(
        "doc_id", F.posexplode(text.whole(F.col("lecture_section"))).alias("section_id", "section")
    )


def sentences_merged(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = transcripts.clean(inputs.transcripts(spark, folder))
    return sentences.sentence_rows(sentences.lecture_sentences(cleaned))


def sentences_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """All texts without their end-of-sentence marks, which leaves commas, ``so`` and ``and``."""
    unmarked = inputs.documents(spark, folder).select(
        "doc_id",
        text.clean_transcript(F.translate("document", ".!?", "")).alias("transcript_clean"),
    )
    return sentences.sentence_rows(sentences.lecture_sentences(unmarked))


def sentence_cap(spark: SparkSession, folder: str) -> DataFrame:
    capped = sentences.plain_sentences(
        inputs.documents(spark, folder), cap=fixed.MAX_SENTENCES_PER_DOC
    )
    return sentences.sentence_rows(capped)


def topic_buckets(spark: SparkSession, folder: str) -> DataFrame:
    tagged = transcripts.with_topic(inputs.transcripts(spark, folder))
    return transcripts.group_sizes(tagged, "topic", "playlist_name")


def topic_names(spark: SparkSession, folder: str) -> DataFrame:
    return transcripts.with_topic(inputs.transcripts(spark, folder)).select("topic").distinct()


def topic_weights(spark: SparkSession, folder: str) -> DataFrame:
    tagged = transcripts.with_topic(transcripts.clean(inputs.transcripts(spark, folder)))
    weighted = transcripts.balanced_weights(tagged, "topic")
    return weighted.withColumn("weight", F.round("weight", 6))


def topic_sample(spark: SparkSession, folder: str) -> DataFrame:
    tagged = transcripts.with_topic(transcripts.clean(inputs.transcripts(spark, folder)))
    sample = transcripts.sample_per_topic(tagged)
    return sample.select("doc_id", "topic", "token_count", F.lit("").alias("paraphrased_summary"))


def annotation_sheet(spark: SparkSession, folder: str) -> DataFrame:
    """The sampled lectures written as the CSV sheet for annotators and read back."""
    sample = transcripts.sample_per_topic(_lectures(spark, folder))
    sheet = sample.select("doc_id", "topic", "lecture_section", "transcript")
    path = store.fresh_path(spark, "sheet")
    files.write_annotation_sheet(sheet, path)
    schema = "doc_id long, topic string, lecture_section string, transcript string, paraphrased_summary string"
    back = files.read_csv(spark, path, sheet.sparkSession.createDataFrame([], schema).schema)
    sections = F.from_json("lecture_section", "array<string>")
    return back.select(
        "doc_id", "topic", F.size(sections).alias("n_sections"),
        F.array_join(sections, " ").alias("joined_sections"), "transcript",
        F.coalesce("paraphrased_summary", F.lit("")).alias("paraphrased_summary"),
    )


def final_join(spark: SparkSession, folder: str) -> DataFrame:
    prepared = _lectures(spark, folder)
    golds = inputs.with_summary(prepared.select("doc_id", "topic"), spark, folder)
    golds = golds.withColumnRenamed("summary", "paraphrased_summary")
    return transcripts.join_hand_summaries(lectures.sentence_table(prepared), golds)


# --- labels ----------------------------------------------------------------------------------


def hand_label_join(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences of all documents, labelled by the list of all sentences of ``benchmark``."""
    docs = inputs.documents(spark, folder)
    rows = sentences.sentence_rows(sentences.plain_sentences(docs)).withColumn("file_name", F.lit("documents"))
    listed = sentences.plain_sentences(inputs.table(spark, folder, "benchmark"), "text").select(
        F.lit("documents").alias("file_name"), F.explode(text.whole(F.col("sentences"))).alias("sentence")
    )
    return labels.label_by_hand(rows, listed).select("doc_id", "sentence_id", "label")


def _overlap_labels(spark: SparkSession, folder: str, cap: int | None) -> DataFrame:
    return labels.label_by_overlap(inputs.pairs(spark, folder), cap=cap, stem=False)


def rougeL_labels(spark: SparkSession, folder: str) -> DataFrame:
    found = _overlap_labels(spark, folder, None)
    return found.select("doc_id", "sentence_id", F.round("score", 6).alias("score"), "label")


def rougeL_labels_capped(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the training set's own limit of sentences per document."""
    found = _overlap_labels(spark, folder, fixed.MAX_SENTENCES_PER_DOC)
    return found.select("doc_id", "sentence_id", F.round("score", 6).alias("score"), "label")


def rougeL_labels_stemmed(spark: SparkSession, folder: str) -> DataFrame:
    found = labels.label_by_overlap(inputs.pairs(spark, folder))
    return found.select("doc_id", "sentence_id", F.round("score", 6).alias("score"), "label")


def label_distribution(spark: SparkSession, folder: str) -> DataFrame:
    found = labels.label_distribution(_overlap_labels(spark, folder, None))
    return found.withColumn("positive_fraction", F.round("positive_fraction", 6))


def positive_weight(spark: SparkSession, folder: str) -> DataFrame:
    found = labels.positive_weight(_overlap_labels(spark, folder, None))
    return found.withColumn("positive_weight", F.round("positive_weight", 6))


def class_weights(spark: SparkSession, folder: str) -> DataFrame:
    weighted = transcripts.balanced_weights(_overlap_labels(spark, folder, None), "label")
    return weighted.withColumn("weight", F.round("weight", 6))


def union_sources(spark: SparkSession, folder: str) -> DataFrame:
    found = training.training_sentences(
        inputs.pairs(spark, folder), inputs.conversation_pairs(spark, folder), cap=None, stem=False
    )
    by_source = labels.label_distribution(found, "source")
    return by_source.withColumn("positive_fraction", F.round("positive_fraction", 6))


def _gold_lectures(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, sentences, summary)`` of all cleaned lectures."""
    cleaned = transcripts.clean(inputs.transcripts(spark, folder))
    split = sentences.lecture_sentences(cleaned).select("doc_id", "sentences")
    return inputs.with_summary(split, spark, folder)


def cosine_labels(spark: SparkSession, folder: str) -> DataFrame:
    golds = store.staged(_gold_lectures(spark, folder), "lectures")
    found = labels.label_by_cosine(golds, text.english_stop_words())
    return found.withColumn("score", F.round("score", 6))


# --- ROUGE -----------------------------------------------------------------------------------


def _document_candidates(spark: SparkSession, folder: str) -> DataFrame:
    docs = inputs.documents(spark, folder)
    return docs.select(F.lit("document").alias("system"), "doc_id", F.col("document").alias("text"))


def _one_metric(metric: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        records = rouge.score_systems(
            _document_candidates(spark, folder), inputs.gold_summaries(spark, folder), (metric,), stem=False
        )
        return records.select("doc_id", *rouge.flat(records, metric))

    return query


def rouge_stemmed(spark: SparkSession, folder: str) -> DataFrame:
    records = rouge.score_systems(
        _document_candidates(spark, folder), inputs.gold_summaries(spark, folder)
    )
    columns = [c for m in rouge.METRICS for c in rouge.flat(records, m)]
    return records.select("system", "doc_id", *columns)


def _replies(spark: SparkSession, folder: str) -> DataFrame:
    """Reply bodies for all documents: the passage after their own; cut-off JSON where flagged toxic."""
    passages = inputs.numbered_passages(spark, folder)
    n = passages.agg(F.count(F.lit(1)).alias("n")).scalar()
    ids = inputs.table(spark, folder, "documents").select("doc_id")
    flagged = inputs.table(spark, folder, "labels").where(F.col("toxic") == 1).select("doc_id", F.lit(True).alias("_bad"))
    content = F.concat(F.lit(" "), F.col("text"), F.lit(" "))
    message = F.struct(F.struct(F.lit("assistant").alias("role"), content.alias("content")).alias("message"))
    body = F.to_json(F.struct(F.array(message).alias("choices")))
    return (
        ids.withColumn("item_id", F.pmod(F.coalesce("doc_id", F.lit(0)) + 1, n))
        .join(passages, "item_id")
        .join(flagged, "doc_id", "left")
        .select("doc_id", F.when(F.col("_bad"), F.lit('{"choices":[{')).otherwise(body).alias("body"))
    )


def chat_requests(spark: SparkSession, folder: str) -> DataFrame:
    made = chat.requests(inputs.documents(spark, folder), model="summary-model")
    shape = "model string, messages array<struct<role string, content string>>, temperature double, max_tokens int"
    parsed = made.select("doc_id", F.from_json("body", shape).alias("b"))
    return parsed.select(
        "doc_id", "b.model", "b.temperature", "b.max_tokens",
        F.col("b.messages")[0]["role"].alias("first_role"),
        F.col("b.messages")[0]["content"].alias("prompt"),
        F.col("b.messages")[1]["role"].alias("second_role"),
        F.col("b.messages")[1]["content"].alias("content"),
    )


def chat_replies(spark: SparkSession, folder: str) -> DataFrame:
    return chat.reply_texts(_replies(spark, folder))


def system_rouge_mean(spark: SparkSession, folder: str) -> DataFrame:
    """Mean scores of the outside replies, failed ones skipped, and of the whole documents."""
    golds = inputs.gold_summaries(spark, folder)
    outside = rouge.score_systems(
        chat.reply_texts(_replies(spark, folder)), golds, ("rouge1", "rougeL"), stem=False, skip_empty=True
    )
    whole = rouge.score_systems(
        _document_candidates(spark, folder), golds, ("rouge1", "rougeL"), stem=False
    )
    means = rouge.mean_scores(outside.unionByName(whole), "rouge1", "rougeL")
    return means.select(
        "system", "n_docs", F.round("rouge1_f", 6).alias("rouge1_f"), F.round("rougeL_f", 6).alias("rougeL_f")
    )


# --- features and splits ---------------------------------------------------------------------


def _sentence_terms(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = transcripts.clean(inputs.transcripts(spark, folder))
    rows = sentences.sentence_rows(sentences.lecture_sentences(cleaned))
    return features.with_term_counts(rows, "sentence", text.english_stop_words())


def tfidf_unigram(spark: SparkSession, folder: str) -> DataFrame:
    counted = store.staged(
        _sentence_terms(spark, folder).select(*features.ROW_KEY, "terms"), "term-counts"
    )
    found = features.weights(counted, features.fit_idf(counted))
    return found.withColumn("weight", F.round("weight", 6))


def term_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    return features.term_stats(_sentence_terms(spark, folder))


def tfidf_bigram_topk(spark: SparkSession, folder: str) -> DataFrame:
    golds = store.staged(_gold_lectures(spark, folder), "lectures")
    found = labels.fit_summary_idf(golds, text.english_stop_words())
    return found.withColumn("idf", F.round("idf", 6))


def split_by_doc(spark: SparkSession, folder: str) -> DataFrame:
    """The split, stored and read back."""
    ids = inputs.table(spark, folder, "documents").select("doc_id")
    return store.staged(splits.split_documents(ids), "split")


def split_members(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences per side: documents of the training part, and all others."""
    split = split_by_doc(spark, folder)
    split_texts = sentences.plain_sentences(inputs.documents(spark, folder))
    sizes = split_texts.select("doc_id", F.size("sentences").alias("n"))
    inside = splits.members(sizes, split, "train").withColumn("side", F.lit("train"))
    outside = splits.others(sizes, split, "train").withColumn("side", F.lit("rest"))
    return inside.unionByName(outside).where(F.col("n") > 0).groupBy("side").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_sentences")
    )


def split_stratified(spark: SparkSession, folder: str) -> DataFrame:
    found = _overlap_labels(spark, folder, None).select("doc_id", "sentence_id", "label")
    return splits.split_rows(store.staged(found, "labels"))


def frozen_transform(spark: SparkSession, folder: str) -> DataFrame:
    """Vectorizer fitted on the training documents, applied to the others."""
    counted = store.staged(
        _sentence_terms(spark, folder).select(*features.ROW_KEY, "terms"), "term-counts"
    )
    split = split_by_doc(spark, folder)
    idf = features.fit_idf(splits.members(counted, split, "train"))
    found = features.weights(splits.others(counted, split, "train"), idf)
    return found.withColumn("weight", F.round("weight", 6))


# --- models ----------------------------------------------------------------------------------


def _labeled(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The lectures with their summaries, and their sentences with cosine labels and the part of their
    document; both written once."""
    golds = store.staged(_gold_lectures(spark, folder), "lectures")
    path = store.fresh_path(spark, "labeled")
    with store.run_scope(spark):  # what the labels come from goes once they are written
        found = labels.label_by_cosine(golds, text.english_stop_words())
        rows = labels.attach_labels(golds.join(split_by_doc(spark, folder), "doc_id"), found, "part")
        return golds, store.staged(rows, "labeled", path)


def _labeled_terms(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The same with the terms of the sentences in their place, which the Bayes model reads for its fit and its scores."""
    golds = store.staged(_gold_lectures(spark, folder), "lectures")
    path = store.fresh_path(spark, "term-counts")
    with store.run_scope(spark):
        tokens = labels.unit_tokens(golds, text.english_stop_words())
        found = labels.label_by_cosine(golds, text.english_stop_words(), tokens=tokens)
        rows = labels.attach_to_terms(tokens.join(split_by_doc(spark, folder), "doc_id"), found, "part")
        return golds, store.staged(rows, "term-counts", path)


def _bayes(spark: SparkSession, labeled: DataFrame) -> naive_bayes.NaiveBayes:
    train = labeled.where(F.col("part") == "train")
    return naive_bayes.fit(train, text.english_stop_words())


def nb_scores(spark: SparkSession, folder: str) -> DataFrame:
    _, labeled = _labeled_terms(spark, folder)
    found = naive_bayes.score(_bayes(spark, labeled), labeled)
    return found.withColumn("score", F.round("score", 6))


def nb_report(spark: SparkSession, folder: str) -> DataFrame:
    _, labeled = _labeled_terms(spark, folder)
    test = labeled.where(F.col("part") == "test")
    scored = naive_bayes.score(_bayes(spark, labeled), test)
    return _rounded(evaluation.classification_report(test.join(scored, ["doc_id", "sentence_id"])))


def threshold_report(spark: SparkSession, folder: str) -> DataFrame:
    """The Bayes scores of the test part cut at the network's threshold."""
    _, labeled = _labeled_terms(spark, folder)
    test = labeled.where(F.col("part") == "test")
    scored = naive_bayes.score(_bayes(spark, labeled), test).select("doc_id", "sentence_id", "score")
    cut = evaluation.with_threshold(scored, fixed.FFN_THRESHOLD)
    return _rounded(evaluation.classification_report(test.join(cut, ["doc_id", "sentence_id"])))


def nb_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Summaries of all lectures: the five most probable sentences in document order."""
    golds, labeled = _labeled_terms(spark, folder)
    scored = naive_bayes.score(_bayes(spark, labeled), labeled)
    return summaries.from_scores(golds.select("doc_id", "sentences"), scored)


def nb_summary_rouge_mean(spark: SparkSession, folder: str) -> DataFrame:
    """Mean scores of the generated summaries of the test lectures against the written ones."""
    golds, labeled = _labeled_terms(spark, folder)
    test = labeled.where(F.col("part") == "test")
    scored = naive_bayes.score(_bayes(spark, labeled), test)
    lectures_ = splits.members(golds, labeled.select("doc_id", "part").distinct(), "test")
    found = summaries.from_scores(lectures_.select("doc_id", "sentences"), scored)
    records = rouge.score_systems(
        found.withColumn("system", F.lit("nb")), golds, ("rouge1", "rougeL"), stem=False
    )
    means = rouge.mean_scores(records, "rouge1", "rougeL")
    return means.select(
        "system", "n_docs", F.round("rouge1_f", 6).alias("rouge1_f"), F.round("rougeL_f", 6).alias("rougeL_f")
    )


def report_val(spark: SparkSession, folder: str) -> DataFrame:
    """Report of the Bayes model on the validation part."""
    _, labeled = _labeled_terms(spark, folder)
    held = labeled.where(F.col("part") == "val")
    scored = naive_bayes.score(_bayes(spark, labeled), held)
    return _rounded(evaluation.classification_report(held.join(scored, ["doc_id", "sentence_id"])))


def summary_last_ties(spark: SparkSession, folder: str) -> DataFrame:
    """Ten sentences by ROUGE-L with the passage, later ones winning ties, in document order."""
    scored = _overlap_labels(spark, folder, None)
    return summaries.from_sentence_rows(scored, fixed.TOP_K_COSINE, ties="last")


def _rounded(report: DataFrame) -> DataFrame:
    return report.select(
        "class", *[F.round(m, 6).alias(m) for m in ("precision", "recall", "f1")], "support"
    )


def _model_report(name: str, part: str = "test", **params) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        _, labeled = _labeled(spark, folder)
        trained = training.train(labeled, text.english_stop_words(), name, **params)
        return _rounded(training.report(trained, labeled, part))

    return query


# The network reads the most frequent 1-2-grams, as many as its input layer has.
NETWORK_TERMS = {"max_n": 2, "max_features": fixed.MAX_FEATURES}


def _forest_votes(spark: SparkSession, folder: str, parts: tuple[str, ...]) -> DataFrame:
    """The votes of a forest fitted on all training rows; rows of other parts are held."""
    _, labeled = _labeled(spark, folder)
    rows = labeled.where(F.col("part").isin(*parts)).withColumn("held", F.col("part") != "train")
    prepared, n_terms = forest.rows_of(rows, text.english_stop_words(), labeled.where(F.col("part") == "train"))
    return forest.fit(store.staged(prepared, "forest-input"), n_terms)[1]


def rf_report(spark: SparkSession, folder: str) -> DataFrame:
    """Report of the forest on the test part, whose rows go down the trees while these grow."""
    votes = _forest_votes(spark, folder, ("train", "test"))
    return _rounded(evaluation.classification_report(forest.voted(votes.where("held"))))


def rf_oob(spark: SparkSession, folder: str) -> DataFrame:
    found = forest.out_of_bag(_forest_votes(spark, folder, ("train",)))
    return found.withColumn("oob_score", F.round("oob_score", 6))


OPTIMUM = 1e-2  # length of the gradient, relative to that at zero


def _logistic_table(spark: SparkSession, folder: str) -> tuple[linear.LinearModel, DataFrame]:
    """The logistic model as a table, fitted on all training rows and all their terms."""
    _, labeled = _labeled(spark, folder)
    train = labeled.where(F.col("part") == "train")
    return linear.fit(train, text.english_stop_words(), tolerance=OPTIMUM), labeled


def logreg_optimum(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the gradient vanishes at the fitted model, taken anew from its parameters and all training rows."""
    model, _ = _logistic_table(spark, folder)
    # Twice the bound leaves room for the order of sums alone.
    reached = F.lit(linear.gradient_length(model)) <= 2 * OPTIMUM * model.start
    counted = model.rows.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("label").cast("long")).alias("positives"))
    n_terms = model.terms.agg(F.count(F.lit(1)).alias("n_terms"))
    return counted.withColumn("n_terms", n_terms.scalar()).withColumns(
        {"start_gradient": F.round(F.lit(model.start), 4), "at_optimum": reached}
    )


def logreg_table_report(spark: SparkSession, folder: str) -> DataFrame:
    """Report of the logistic model that is a table, on the test part."""
    model, labeled = _logistic_table(spark, folder)
    test = labeled.where(F.col("part") == "test")
    return _rounded(evaluation.classification_report(test.join(linear.score(model, test), ["doc_id", "sentence_id"])))


def model_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Rows on which a saved and reloaded model differs from the fitted one: expected 0."""
    _, labeled = _labeled(spark, folder)
    trained = training.train(labeled, text.english_stop_words(), "logreg")
    path = store.fresh_path(spark, "model")
    training.save(trained, path)
    loaded = training.load(spark, path, "logreg")
    before = training.score(trained, labeled).select("doc_id", "sentence_id", "score")
    after = training.score(loaded, labeled).select("doc_id", "sentence_id", F.col("score").alias("again"))
    both = before.join(after, ["doc_id", "sentence_id"])
    return both.agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("score") != F.col("again")).cast("long")).alias("n_different")
    )


def lecture_two_systems(spark: SparkSession, folder: str) -> DataFrame:
    """Two systems on all test lectures, scored against their summaries."""
    _, labeled = _labeled(spark, folder)
    stop_words = text.english_stop_words()
    first = training.train(labeled, stop_words, "logreg", max_iter=500, **NETWORK_TERMS)
    vectors = models.vectorize(first.vectorizer, labeled.where(F.col("part") == "train"))
    net = models.fit_network(store.staged(vectors.select("label", "features"), "vectors"))
    second = training.Trained(first.vectorizer, net, "ffn")
    test = splits.members(inputs.transcripts(spark, folder), labeled.select("doc_id", "part").distinct(), "test")
    found = lectures.summarize([first, second], test)
    golds = inputs.gold_summaries(spark, folder).withColumnRenamed("summary", "paraphrased_summary")
    records = lectures.score_systems(found, golds)
    columns = [c for m in rouge.METRICS for c in rouge.flat(records, m)]
    return records.select("system", "doc_id", *columns)


# --- sources, sinks, sequences ---------------------------------------------------------------


def first_n_pairs(spark: SparkSession, folder: str) -> DataFrame:
    docs = inputs.table(spark, folder, "documents").withColumnRenamed("text", "article")
    named = inputs.with_summary(docs, spark, folder).withColumnRenamed("summary", "highlights")
    return files.to_pairs(named, "article", "highlights", n=100)


def padded_sequences(spark: SparkSession, folder: str) -> DataFrame:
    pairs = inputs.pairs(spark, folder)
    made = sequences.prepare(pairs, sequences.fit_vocabulary(pairs))
    as_text = lambda c: F.array_join(F.col(c).cast("array<string>"), " ").alias(c)
    return made.select("doc_id", as_text("input_ids"), as_text("labels"))


def csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = store.fresh_path(spark, "csv")
    inputs.transcripts(spark, folder).write.options(header=True, escape='"', emptyValue="").csv(path)
    return files.read_transcripts_csv(spark, path, keyed=True)


def parquet_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """The prepared lectures stored by topic and read back."""
    path = store.fresh_path(spark, "lectures")
    files.write_table(_lectures(spark, folder), path, partition_by="topic")
    return files.read_table(spark, path).select(
        "doc_id", "topic", "token_count", F.size("lecture_section").alias("n_sections"),
        F.array_join("sentences", " ").alias("joined_sentences"),
    )


def notes_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """No pairs: the training sentences come from whole-file notes and the sentences listed for them.

    Each passage is a note; listed are the sentences of the first half of its characters."""
    path = store.fresh_path(spark, "notes")
    passages = inputs.table(spark, folder, "benchmark").select("item_id", "text")
    passages.write.partitionBy("item_id").option("lineSep", "\n").text(path)
    item = F.regexp_extract("_metadata.file_path", r"item_id=(\d+)", 1)
    notes = files.read_notes(spark, f"{path}/item_id=*/*", item)
    halves = passages.select(
        F.col("item_id").cast("string").alias("file_name"),
        F.left("text", (F.length("text") / 2).cast("int")).alias("document"),
    )
    listed = sentences.plain_sentences(halves).select(
        "file_name", F.explode(text.whole(F.col("sentences"))).alias("sentence")
    )
    nothing = inputs.pairs(spark, folder).where(F.length("document") < 0)
    found = training.training_sentences(nothing, notes=notes, hand_labels=listed)
    return found.select("source", "sentence_id", "sentence", "label")


def text_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Each passage written as one text file, read back whole, and labelled by the long sentences of
    the document set: a passage sentence is positive where some document holds it verbatim."""
    path = store.fresh_path(spark, "notes")
    passages = inputs.table(spark, folder, "benchmark")
    passages.select("item_id", "text").write.partitionBy("item_id").option("lineSep", "\n").text(path)
    item = F.regexp_extract("_metadata.file_path", r"item_id=(\d+)", 1).cast("long")
    notes = spark.read.text(f"{path}/item_id=*/*", wholetext=True).select(
        item.alias("item_id"), F.col("value").alias("document")
    )
    rows = sentences.plain_sentences(notes).select(
        "item_id", F.posexplode(text.whole(F.col("sentences"))).alias("sentence_id", "sentence")
    ).withColumn("file_name", F.lit("documents"))
    listed = sentences.plain_sentences(inputs.documents(spark, folder)).select(
        F.lit("documents").alias("file_name"), F.explode(text.whole(F.col("sentences"))).alias("sentence")
    )
    return labels.label_by_hand(rows, listed).select("item_id", "sentence_id", "sentence", "label")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "clean_transcripts": clean_transcripts,
    "dedup_first": dedup_first,
    "word_sections": word_sections,
    "sentences_merged": sentences_merged,
    "sentences_fallback": sentences_fallback,
    "sentence_cap": sentence_cap,
    "topic_buckets": topic_buckets,
    "topic_names": topic_names,
    "topic_weights": topic_weights,
    "topic_sample": topic_sample,
    "annotation_sheet": annotation_sheet,
    "final_join": final_join,
    "hand_label_join": hand_label_join,
    "rouge1": _one_metric("rouge1"),
    "rouge2": _one_metric("rouge2"),
    "rougeL": _one_metric("rougeL"),
    "rouge_stemmed": rouge_stemmed,
    "rougeL_labels": rougeL_labels,
    "rougeL_labels_capped": rougeL_labels_capped,
    "rougeL_labels_stemmed": rougeL_labels_stemmed,
    "label_distribution": label_distribution,
    "positive_weight": positive_weight,
    "class_weights": class_weights,
    "union_sources": union_sources,
    "cosine_labels": cosine_labels,
    "chat_requests": chat_requests,
    "chat_replies": chat_replies,
    "system_rouge_mean": system_rouge_mean,
    "tfidf_unigram": tfidf_unigram,
    "term_frequencies": term_frequencies,
    "tfidf_bigram_topk": tfidf_bigram_topk,
    "split_by_doc": split_by_doc,
    "split_members": split_members,
    "split_stratified": split_stratified,
    "frozen_transform": frozen_transform,
    "nb_scores": nb_scores,
    "nb_report": nb_report,
    "threshold_report": threshold_report,
    "nb_summary": nb_summary,
    "summary_last_ties": summary_last_ties,
    "nb_summary_rouge_mean": nb_summary_rouge_mean,
    "rf_report": rf_report,
    "nb_mllib_report": _model_report("nb"),
    "svm_report": _model_report("svm"),
    "logreg_report": _model_report("logreg"),
    "logreg_optimum": logreg_optimum,
    "logreg_table_report": logreg_table_report,
    "linreg_report": _model_report("linreg"),
    "ffn_report": _model_report("ffn", **NETWORK_TERMS),
    "report_val": report_val,
    "rf_oob": rf_oob,
    "model_roundtrip": model_roundtrip,
    "lecture_two_systems": lecture_two_systems,
    "first_n_pairs": first_n_pairs,
    "padded_sequences": padded_sequences,
    "csv_roundtrip": csv_roundtrip,
    "parquet_roundtrip": parquet_roundtrip,
    "text_notes": text_notes,
    "notes_fallback": notes_fallback,
}
