"""SQL twins of the registered queries, for DuckDB on the same tables.

They are written from the definitions, not from the Spark plans: gaps-and-islands for merged
sentences, row numbers for splits, plain counts for overlaps.
"""

from __future__ import annotations

import zipfile
from pathlib import Path

from pyspark import SparkContext

from precis import fixed_values as fixed
from precis.functions.text import ABBREVIATIONS, english_stop_words
from precis.operators import sequences
from precis.plans.inputs import PLAYLISTS, TURN_BITS

SPACE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"


def _literal(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _stop_words() -> list[str]:
    """Spark's English list; read from its jar when no Spark is running."""
    if SparkContext._active_spark_context is not None:
        return english_stop_words()
    import pyspark

    jar = next(Path(pyspark.__path__[0], "jars").glob("spark-mllib_*.jar"))
    with zipfile.ZipFile(jar) as z:
        return z.read("org/apache/spark/ml/feature/stopwords/english.txt").decode().split()


# --- expressions -----------------------------------------------------------------------------


def _collapse(e: str) -> str:
    return f"trim(regexp_replace({e}, '{SPACE}+', ' ', 'g'))"


def _clean(e: str) -> str:
    no_tags = rf"regexp_replace(lower({e}), '\[[^\]]+\]', ' ', 'g')"
    return _collapse(f"regexp_replace({no_tags}, '>+{SPACE}*', ' ', 'g')")


def _split(e: str) -> str:
    names = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    kept = rf"regexp_replace({e}, '(^|[^\p{{L}}\p{{N}}_])({names})\.', '\1\2'||chr(2), 'gi')"
    marked = rf"""regexp_replace({kept}, '([.!?]["'')\]]*){SPACE}+', '\1'||chr(1), 'g')"""
    parts = f"string_split(replace({marked}, chr(2), '.'), chr(1))"
    stripped = rf"list_transform({parts}, lambda s: regexp_replace(s, '\A{SPACE}+|{SPACE}+\z', '', 'g'))"
    return f"list_filter({stripped}, lambda s: s <> '')"


def _fallback(e: str) -> str:
    at_commas = f"regexp_replace({e}, '{SPACE}*,{SPACE}*', '. ', 'g')"
    at_so = f"regexp_replace({at_commas}, '{SPACE}+so{SPACE}+', '. so ', 'g')"
    return f"regexp_replace({at_so}, '{SPACE}+and{SPACE}+', '. and ', 'g')"


def _rouge_tokens(e: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower({e}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: t <> '')"


def _f1(overlap: str, n: str, m: str) -> str:
    return f"CASE WHEN {n} + {m} > 0 THEN 2.0::DOUBLE * {overlap} / ({n} + {m}) ELSE 0.0 END"


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN ({a})::DOUBLE / ({b}) ELSE 0.0 END"


def _topic(e: str) -> str:
    name = f"lower(coalesce({e}, ''))"
    whens = " ".join(
        "WHEN " + " OR ".join(f"contains({name}, {_literal(k)})" for k in keywords)
        + f" THEN {_literal(topic)}"
        for topic, keywords in fixed.TOPIC_RULES
    )
    return f"CASE {whens} ELSE {_literal(fixed.OTHER_TOPIC)} END"


# --- common table expressions; each list is in order of use -----------------------------------

_PLAYLISTS = ", ".join(f"({_literal(s)}, {_literal(p)})" for s, p in PLAYLISTS.items())

TRANSCRIPTS = [
    f"playlists(source, playlist_name) AS (VALUES {_PLAYLISTS})",
    """transcripts AS (
        SELECT doc_id, text AS transcript, 'doc-' || doc_id AS title, playlist_name
        FROM documents LEFT JOIN playlists USING (source))""",
    f"""firsts AS (
        SELECT * FROM transcripts
        WHERE transcript IS NOT NULL AND {_collapse('transcript')} <> ''
        QUALIFY row_number() OVER (PARTITION BY transcript ORDER BY doc_id) = 1)""",
]
CLEANED = TRANSCRIPTS + [
    f"cleaned0 AS MATERIALIZED (SELECT * REPLACE ({_collapse('transcript')} AS transcript), {_clean('transcript')} AS transcript_clean FROM firsts)",
    """cleaned1 AS (
        SELECT *, CASE WHEN transcript_clean = '' THEN 0
                       ELSE len(string_split(transcript_clean, ' ')) END::INTEGER AS token_count
        FROM cleaned0)""",
    f"cleaned AS (SELECT * FROM cleaned1 WHERE token_count >= {fixed.MIN_TRANSCRIPT_TOKENS})",
]


def _merged(source: str, column: str) -> list[str]:
    """Sentences of a cleaned text with short ones glued on: gaps and islands over the raw ones."""
    return [
        f"parts0 AS MATERIALIZED (SELECT doc_id, {column} AS c, {_split(column)} AS p FROM {source})",
        f"parts AS (SELECT doc_id, CASE WHEN len(p) <= 1 THEN {_split(_fallback('c'))} ELSE p END AS p FROM parts0)",
        "raw AS (SELECT doc_id, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS s FROM parts)",
        f"""grouped AS (
            SELECT *, sum(CASE WHEN i = 1 OR length(s) >= {fixed.MIN_SENTENCE_CHARS} THEN 1 ELSE 0 END)
                      OVER (PARTITION BY doc_id ORDER BY i) AS g FROM raw)""",
        """merged AS MATERIALIZED (
            SELECT doc_id, (g - 1)::INTEGER AS sentence_id, string_agg(s, ' ' ORDER BY i) AS sentence
            FROM grouped GROUP BY doc_id, g)""",
    ]


MERGED = CLEANED + _merged("cleaned", "transcript_clean")
GOLDS = [
    "gold_texts AS MATERIALIZED (SELECT row_number() OVER (ORDER BY item_id) - 1 AS item_no, text FROM benchmark)",
    "gold_size AS MATERIALIZED (SELECT count(*) AS n_golds FROM benchmark)",
    "gold_keys AS MATERIALIZED (SELECT doc_id, doc_id % n_golds AS item_no, (doc_id + 1) % n_golds AS next_no FROM documents, gold_size)",
    "golds AS MATERIALIZED (SELECT doc_id, text AS summary FROM gold_keys JOIN gold_texts USING (item_no))",
]
PLAIN = [
    f"plain0 AS MATERIALIZED (SELECT doc_id, {_split('text')} AS p FROM documents)",
    """plain AS MATERIALIZED (
        SELECT doc_id, unnest(range(len(p)))::INTEGER AS sentence_id, unnest(p) AS sentence FROM plain0)""",
]


def _lcs(key: str) -> list[str]:
    """LCS length per row of ``lcs_in(<key>, reference, candidate)`` by bit vectors.

    References have at most 126 tokens here, so a 128-bit integer holds one bit per token.
    """
    return [
        f"""lcs_tok AS MATERIALIZED (
            SELECT {key}, {_rouge_tokens('reference')} AS r, {_rouge_tokens('candidate')} AS c FROM lcs_in)""",
        f"""ref_tok AS (
            SELECT {key}, t, bit_or(1::UHUGEINT << (i - 1)::UHUGEINT) AS mask
            FROM (SELECT {key}, unnest(range(1, len(r) + 1)) AS i, unnest(r) AS t FROM lcs_tok)
            GROUP BY {key}, t)""",
        f"cand_tok AS (SELECT {key}, unnest(range(1, len(c) + 1)) AS i, unnest(c) AS t FROM lcs_tok)",
        f"""lcs_masks AS (
            SELECT {key}, list(mask ORDER BY i) AS masks FROM cand_tok JOIN ref_tok USING ({key}, t)
            GROUP BY {key})""",
        f"""lcs_bits AS (
            SELECT {key}, len(r) AS m, len(c) AS n, masks, (1::UHUGEINT << len(r)::UHUGEINT) - 1 AS full_bits
            FROM lcs_tok LEFT JOIN lcs_masks USING ({key}))""",
        f"""lcs_out AS MATERIALIZED (
            SELECT {key}, m, n, CASE WHEN masks IS NULL THEN 0 ELSE m - bit_count(list_reduce(
                masks, lambda v, x: ((v + (v & x)) | (v - (v & x))) & full_bits, full_bits)::BIT) END AS hit
            FROM lcs_bits)""",
    ]


def _overlap_labels(capped: bool) -> list[str]:
    """Scores of plain sentences against the passage, and the best k of each document."""
    limit = f"WHERE sentence_id < {fixed.MAX_SENTENCES_PER_DOC}" if capped else ""
    return PLAIN + GOLDS + [
        f"""lcs_in AS (
            SELECT doc_id, sentence_id, summary AS reference, sentence AS candidate
            FROM plain JOIN golds USING (doc_id) {limit})""",
        *_lcs("doc_id, sentence_id"),
        f"scored AS (SELECT doc_id, sentence_id, {_f1('hit', 'n', 'm')} AS score FROM lcs_out)",
        f"""labeled AS MATERIALIZED (
            SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, sentence_id)
                       <= {fixed.TOP_K_ROUGE})::INTEGER AS label FROM scored)""",
    ]


def _terms(source: str, key: str, column: str, stop: list[str], bigrams: bool = False) -> str:
    """Rows ``(<key>, term, tf)`` of a text column."""
    listed = "[" + ", ".join(_literal(w) for w in stop) + "]"
    tokens = (
        rf"list_filter(regexp_extract_all(lower({column}), '[\p{{L}}\p{{N}}_]{{2,}}'), "
        f"lambda t: NOT list_contains({listed}, t))"
    )
    terms = "toks"
    if bigrams:
        terms = "list_concat(toks, list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1]))"
    return (
        f"SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest({terms}) AS term FROM "
        f"(SELECT {key}, {tokens} AS toks FROM {source})) GROUP BY {key}, term"
    )


def _split_docs(ids: str) -> list[str]:
    return [
        f"""ranked_docs AS (
            SELECT doc_id, row_number() OVER (ORDER BY md5('{fixed.SEED}:' || doc_id), doc_id) AS r,
                   count(*) OVER () AS n FROM {ids})""",
        f"""split AS MATERIALIZED (
            SELECT doc_id, CASE WHEN r <= ceil(ceil(n * {fixed.TEST_FRACTION}) * 0.5) THEN 'test'
                                WHEN r <= ceil(n * {fixed.TEST_FRACTION}) THEN 'val' ELSE 'train' END AS part
            FROM ranked_docs)""",
    ]


def _cosine(stop: list[str]) -> list[str]:
    """TF-IDF of merged sentences and passages (1-2-grams), cosine and the best k of each document."""
    key = "doc_id, sentence_id"
    n_units = "(SELECT sum(CASE WHEN sentence_id = -1 THEN n_sent ELSE 1 END) FROM units)"
    return MERGED + GOLDS + [
        "sizes AS (SELECT doc_id, count(*) AS n_sent FROM merged GROUP BY doc_id)",
        """units AS MATERIALIZED (
            SELECT doc_id, sentence_id, sentence AS unit, n_sent FROM merged JOIN sizes USING (doc_id)
            UNION ALL SELECT doc_id, -1, summary, n_sent FROM golds JOIN sizes USING (doc_id))""",
        f"unit_terms AS MATERIALIZED ({_terms('units', key, 'unit', stop, bigrams=True)})",
        """stats AS (
            SELECT term, sum(CASE WHEN sentence_id = -1 THEN n_sent ELSE 1 END)::BIGINT AS df,
                   sum(tf * CASE WHEN sentence_id = -1 THEN n_sent ELSE 1 END)::BIGINT AS total_tf
            FROM unit_terms JOIN sizes USING (doc_id) GROUP BY term)""",
        f"""vocab AS MATERIALIZED (
            SELECT *, ln((1.0::DOUBLE + {n_units}) / (1.0::DOUBLE + df)) + 1 AS idf
            FROM (SELECT * FROM stats ORDER BY total_tf DESC, term LIMIT {fixed.MAX_FEATURES}))""",
        "w AS MATERIALIZED (SELECT doc_id, sentence_id, term, tf * idf AS v FROM unit_terms JOIN vocab USING (term))",
        "norms AS (SELECT doc_id, sentence_id, sqrt(sum(v * v)) AS norm FROM w GROUP BY doc_id, sentence_id)",
        """dots AS (
            SELECT s.doc_id, s.sentence_id, sum(s.v * y.v) AS dot FROM w s
            JOIN w y ON y.doc_id = s.doc_id AND y.term = s.term AND y.sentence_id = -1
            WHERE s.sentence_id >= 0 GROUP BY ALL)""",
        """cosines AS (
            SELECT m.doc_id, m.sentence_id, m.sentence, coalesce(d.dot / (a.norm * b.norm), 0.0) AS score
            FROM merged m LEFT JOIN dots d USING (doc_id, sentence_id)
            LEFT JOIN norms a USING (doc_id, sentence_id)
            LEFT JOIN norms b ON b.doc_id = m.doc_id AND b.sentence_id = -1)""",
        f"""labeled AS MATERIALIZED (
            SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, sentence_id DESC)
                       <= {fixed.TOP_K_COSINE})::INTEGER AS label FROM cosines)""",
    ]


def _idf_weights(train: str, apply: str) -> list[str]:
    """Unit-length unigram weights of ``apply`` under the idf of ``train`` (both term-count tables)."""
    return [
        f"""idf AS MATERIALIZED (
            SELECT term, ln((1.0::DOUBLE + (SELECT n FROM n_train)) / (1.0::DOUBLE + count(*))) + 1 AS idf
            FROM {train} GROUP BY term)""",
        f"""weighted AS MATERIALIZED (
            SELECT doc_id, sentence_id, term, tf, tf * idf
                   / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id, sentence_id)) AS weight
            FROM {apply} JOIN idf USING (term))""",
    ]


def _bayes(stop: list[str]) -> list[str]:
    key = "doc_id, sentence_id"
    log_p = lambda c: (
        f"ln((sum{c} + 1) / ((SELECT sum(sum{c}) FROM class_sums) + (SELECT count(*) FROM class_sums)))"
    )
    prior = lambda c: f"ln((SELECT count(*) FILTER (WHERE label = {c})::DOUBLE / count(*) FROM train))"
    return _cosine(stop) + _split_docs("documents") + [
        "train AS MATERIALIZED (SELECT * FROM labeled SEMI JOIN (SELECT doc_id FROM split WHERE part = 'train') USING (doc_id))",
        "n_train AS (SELECT count(*) AS n FROM train)",
        f"sent_terms AS MATERIALIZED ({_terms('labeled', key, 'sentence', stop)})",
        "train_terms AS MATERIALIZED (SELECT * FROM sent_terms SEMI JOIN (SELECT doc_id FROM split WHERE part = 'train') USING (doc_id))",
        *_idf_weights("train_terms", "sent_terms"),
        """class_sums AS MATERIALIZED (
            SELECT term, sum(CASE WHEN label = 0 THEN weight ELSE 0 END) AS sum0,
                   sum(CASE WHEN label = 1 THEN weight ELSE 0 END) AS sum1
            FROM weighted JOIN train USING (doc_id, sentence_id) GROUP BY term)""",
        f"params AS MATERIALIZED (SELECT term, {log_p(1)} - {log_p(0)} AS gain FROM class_sums)",
        f"""logits AS (
            SELECT l.doc_id, l.sentence_id, any_value(l.label) AS label,
                   {prior(1)} - {prior(0)} + coalesce(sum(weight * gain), 0.0) AS logit
            FROM labeled l LEFT JOIN (weighted JOIN params USING (term)) USING (doc_id, sentence_id)
            GROUP BY l.doc_id, l.sentence_id)""",
        """bayes AS MATERIALIZED (
            SELECT doc_id, sentence_id, label, 1.0 / (1.0 + exp(-logit)) AS score, (logit > 0)::INTEGER AS prediction
            FROM logits)""",
    ]


def _report(source: str) -> str:
    classes = f"""
        SELECT c, count(*) FILTER (WHERE label = c) AS support, count(*) FILTER (WHERE prediction = c) AS pred,
               count(*) FILTER (WHERE label = c AND prediction = c) AS tp
        FROM {source}, (SELECT DISTINCT unnest([label, prediction]) AS c FROM {source}) GROUP BY c"""
    return f"""
        , conf AS ({classes}),
        per_class AS (
            SELECT c, support, tp, {_ratio('tp', 'pred')} AS precision, {_ratio('tp', 'support')} AS recall,
                   {_ratio('2.0 * tp', 'pred + support')} AS f1 FROM conf),
        report AS (
            SELECT c::VARCHAR AS class, precision, recall, f1, support FROM per_class
            UNION ALL SELECT 'accuracy', NULL, NULL, sum(tp)::DOUBLE / sum(support), sum(support) FROM per_class
            UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM per_class
            UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support),
                sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM per_class)
        SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
               support::BIGINT AS support FROM report"""


def _with(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def _weights_of(source: str, column: str) -> str:
    return f"""
        SELECT {column}, count(*) AS n,
               round(sum(count(*)) OVER () / (count(*) OVER () * count(*)::DOUBLE), 6) AS weight
        FROM {source} GROUP BY {column}"""


def _ngram_overlap(n: int) -> str:
    grams = "toks" if n == 1 else "list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1])"
    side = lambda text, source: (
        f"SELECT doc_id, unnest({grams}) AS g FROM (SELECT doc_id, {_rouge_tokens(text)} AS toks FROM {source})"
    )
    name = f"rouge{n}"
    return _with(GOLDS + [
        f"c AS MATERIALIZED ({side('text', 'documents')})",
        f"r AS MATERIALIZED ({side('summary', 'golds')})",
        "cc AS (SELECT doc_id, g, count(*) AS k FROM c GROUP BY ALL)",
        "rc AS (SELECT doc_id, g, count(*) AS k FROM r GROUP BY ALL)",
        "hits AS (SELECT doc_id, sum(least(cc.k, rc.k)) AS hit FROM cc JOIN rc USING (doc_id, g) GROUP BY doc_id)",
        "nc AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id)",
        "nr AS (SELECT doc_id, count(*) AS m FROM r GROUP BY doc_id)",
        """counts AS (
            SELECT doc_id, coalesce(hit, 0) AS hit, coalesce(n, 0) AS n, coalesce(m, 0) AS m
            FROM golds LEFT JOIN hits USING (doc_id) LEFT JOIN nc USING (doc_id) LEFT JOIN nr USING (doc_id))""",
    ], f"""SELECT doc_id, round({_ratio('hit', 'n')}, 6) AS {name}_p, round({_ratio('hit', 'm')}, 6) AS {name}_r,
                  round({_f1('hit', 'n', 'm')}, 6) AS {name}_f FROM counts""")


REPLIES = """replies AS (
    SELECT k.doc_id, CASE WHEN l.toxic = 1 THEN '' ELSE trim(b.text, ' ') END AS text FROM gold_keys k
    JOIN gold_texts b ON b.item_no = k.next_no LEFT JOIN labels l USING (doc_id))"""


def _mean_scores() -> str:
    """Unigram and subsequence scores of two systems; the subsequence input holds both."""
    return _with(GOLDS + [
        REPLIES,
        """cands AS (
            SELECT 'external' AS system, doc_id, text FROM replies WHERE text <> ''
            UNION ALL SELECT 'document', doc_id, text FROM documents)""",
        "lcs_in AS MATERIALIZED (SELECT system, doc_id, summary AS reference, text AS candidate FROM cands JOIN golds USING (doc_id))",
        *_lcs("system, doc_id"),
        "c AS (SELECT system, doc_id, t, count(*) AS k FROM cand_tok GROUP BY ALL)",
        "r AS (SELECT system, doc_id, t, count(*) AS k FROM (SELECT system, doc_id, unnest(r) AS t FROM lcs_tok) GROUP BY ALL)",
        "hits AS (SELECT system, doc_id, sum(least(c.k, r.k)) AS hit1 FROM c JOIN r USING (system, doc_id, t) GROUP BY ALL)",
        "both_hits AS (SELECT system, doc_id, n, m, hit, coalesce(hit1, 0) AS hit1 FROM lcs_out LEFT JOIN hits USING (system, doc_id))",
    ], f"""SELECT system, count(*) AS n_docs, round(avg({_f1('hit1', 'n', 'm')}), 6) AS rouge1_f,
                  round(avg({_f1('hit', 'n', 'm')}), 6) AS rougeL_f FROM both_hits GROUP BY system""")


def _nb_rouge_mean(bayes: list[str]) -> str:
    """Scores of the summaries that the Bayes model makes of the test lectures."""
    return _with(bayes + [
        f"""best AS (
            SELECT doc_id, sentence_id FROM test_rows QUALIFY row_number() OVER (
                PARTITION BY doc_id ORDER BY round(score, 9) DESC, sentence_id) <= {fixed.TOP_K_ROUGE})""",
        """made AS (
            SELECT doc_id, string_agg(sentence, ' ' ORDER BY sentence_id) AS text
            FROM best JOIN labeled USING (doc_id, sentence_id) GROUP BY doc_id)""",
        "lcs_in AS MATERIALIZED (SELECT doc_id, summary AS reference, text AS candidate FROM made JOIN golds USING (doc_id))",
        *_lcs("doc_id"),
        "c AS (SELECT doc_id, t, count(*) AS k FROM cand_tok GROUP BY ALL)",
        "r AS (SELECT doc_id, t, count(*) AS k FROM (SELECT doc_id, unnest(r) AS t FROM lcs_tok) GROUP BY ALL)",
        "hits AS (SELECT doc_id, sum(least(c.k, r.k)) AS hit1 FROM c JOIN r USING (doc_id, t) GROUP BY ALL)",
        "both_hits AS (SELECT doc_id, n, m, hit, coalesce(hit1, 0) AS hit1 FROM lcs_out LEFT JOIN hits USING (doc_id))",
    ], f"""SELECT 'nb' AS system, count(*) AS n_docs, round(avg({_f1('hit1', 'n', 'm')}), 6) AS rouge1_f,
                  round(avg({_f1('hit', 'n', 'm')}), 6) AS rougeL_f FROM both_hits""")


def _union_sources() -> str:
    """The same labelling over two pair sources; the source is part of the key."""
    return _with(GOLDS + [
        f"""pairs AS (
            SELECT 'pairs' AS source, d.doc_id, d.text AS document, summary FROM documents d JOIN golds USING (doc_id)
            UNION ALL
            SELECT 'extra_pairs', a.conv_id * {TURN_BITS} + a.turn, a.text, u.text FROM conversations a
            JOIN conversations u ON u.conv_id = a.conv_id AND u.turn + 1 = a.turn
            WHERE a.role = 'assistant' AND u.role = 'user')""",
        f"split_pairs AS MATERIALIZED (SELECT source, doc_id, len({_split('document')}) AS n FROM pairs)",
        f"tops AS (SELECT source, n, least(n, {fixed.TOP_K_ROUGE}) AS k FROM split_pairs WHERE n > 0)",
    ], """SELECT source, sum(k)::BIGINT AS positives, sum(n - k)::BIGINT AS negatives,
                 round(sum(k)::DOUBLE / sum(n), 6) AS positive_fraction FROM tops GROUP BY source""")


def _padded() -> str:
    words = lambda c: rf"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+')"

    def padded(c: str, n: int) -> str:
        return f"""
            SELECT t.doc_id, array_to_string(list_resize(coalesce(list(coalesce(v.id, {sequences.UNKNOWN_ID}) ORDER BY t.i)
                   FILTER (WHERE t.word IS NOT NULL), []), {n}, {sequences.PAD_ID}), ' ') AS ids
            FROM (SELECT doc_id, i, ws[i] AS word FROM (
                    SELECT doc_id, ws, unnest(range(1, {n} + 1)) AS i FROM (SELECT doc_id, {words(c)} AS ws FROM pairs))) t
            LEFT JOIN vocab v ON v.word = t.word GROUP BY t.doc_id"""

    return _with(GOLDS + [
        "pairs AS (SELECT d.doc_id, d.text AS document, summary FROM documents d JOIN golds USING (doc_id))",
        f"""every AS (SELECT unnest({words('document')}) AS word FROM pairs
            UNION ALL SELECT unnest({words('summary')}) FROM pairs)""",
        "word_counts AS (SELECT word, count(*) AS n FROM every GROUP BY word)",
        f"""vocab AS MATERIALIZED (
            SELECT word, (row_number() OVER (ORDER BY n DESC, word) + {sequences.FIRST_WORD_ID - 1})::INTEGER AS id
            FROM word_counts ORDER BY n DESC, word LIMIT {sequences.VOCABULARY_SIZE})""",
        f"a AS ({padded('document', fixed.INPUT_LENGTH)})",
        f"b AS ({padded('summary', fixed.TARGET_LENGTH)})",
    ], "SELECT a.doc_id, a.ids AS input_ids, b.ids AS labels FROM a JOIN b ON a.doc_id = b.doc_id")


def oracles() -> dict[str, str]:
    stop = _stop_words()
    key = "doc_id, sentence_id"
    sections = f"""
        SELECT doc_id, (start // {fixed.SECTION_WORDS})::INTEGER AS section_id,
               array_to_string(ws[start + 1 : start + {fixed.SECTION_WORDS}], ' ') AS section
        FROM (SELECT doc_id, ws, unnest(range(0, len(ws), {fixed.SECTION_WORDS})) AS start
              FROM (SELECT doc_id, string_split(transcript_clean, ' ') AS ws FROM cleaned))"""
    topic = _topic("playlist_name")
    sampled = [
        f"""sampled AS (
            SELECT *, {topic} AS topic FROM cleaned
            WHERE token_count BETWEEN {fixed.SAMPLE_TOKEN_RANGE[0]} AND {fixed.SAMPLE_TOKEN_RANGE[1]}
            QUALIFY row_number() OVER (PARTITION BY topic ORDER BY md5('{fixed.SEED}:' || doc_id), doc_id)
                    <= {fixed.SAMPLES_PER_TOPIC})""",
    ]
    terms = [f"sent_terms AS MATERIALIZED ({_terms('merged', key, 'sentence', stop)})"]
    labels = _overlap_labels(capped=False)
    bayes = _bayes(stop)
    scores = f"SELECT {key}, round(score, 6) AS score, label FROM labeled"
    test_rows = "test_rows AS (SELECT * FROM bayes SEMI JOIN (SELECT doc_id FROM split WHERE part = 'test') USING (doc_id))"
    return {
        "clean_transcripts": _with(CLEANED, "SELECT doc_id, transcript_clean, token_count FROM cleaned"),
        "dedup_first": _with(TRANSCRIPTS, "SELECT doc_id, title FROM firsts"),
        "word_sections": _with(CLEANED, sections),
        "sentences_merged": _with(MERGED, f"SELECT {key}, sentence FROM merged"),
        "sentences_fallback": _with([
            f"unmarked AS MATERIALIZED (SELECT doc_id, {_clean('''translate(text, '.!?', '')''')} AS c0 FROM documents)",
            *_merged("unmarked", "c0"),
        ], f"SELECT {key}, sentence FROM merged"),
        "sentence_cap": _with(PLAIN, f"SELECT {key}, sentence FROM plain WHERE sentence_id < {fixed.MAX_SENTENCES_PER_DOC}"),
        "topic_buckets": _with(TRANSCRIPTS[:2], f"SELECT {topic} AS topic, playlist_name, count(*) AS n FROM transcripts GROUP BY ALL"),
        "topic_names": _with(TRANSCRIPTS[:2], f"SELECT DISTINCT {topic} AS topic FROM transcripts"),
        "topic_weights": _with(CLEANED + [f"tagged AS (SELECT {topic} AS topic FROM cleaned)"], _weights_of("tagged", "topic")),
        "topic_sample": _with(CLEANED + sampled, "SELECT doc_id, topic, token_count, '' AS paraphrased_summary FROM sampled"),
        "annotation_sheet": _with(CLEANED + sampled, f"""
            SELECT doc_id, topic, ceil(token_count / {fixed.SECTION_WORDS}.0)::INTEGER AS n_sections,
                   transcript_clean AS joined_sections, transcript, '' AS paraphrased_summary FROM sampled"""),
        "final_join": _with(MERGED + GOLDS, f"""
            SELECT {key}, sentence, title, playlist_name AS playlist, summary AS paraphrased_summary, {topic} AS topic
            FROM merged JOIN cleaned USING (doc_id) JOIN golds USING (doc_id)"""),
        "hand_label_join": _with(PLAIN + [
            f"listed AS (SELECT DISTINCT unnest({_split('text')}) AS sentence FROM benchmark)",
        ], f"""SELECT {key}, (l.sentence IS NOT NULL)::INTEGER AS label
               FROM plain p LEFT JOIN listed l ON l.sentence = p.sentence"""),
        "rouge1": _ngram_overlap(1),
        "rouge2": _ngram_overlap(2),
        "rougeL": _with(GOLDS + [
            "lcs_in AS (SELECT d.doc_id, summary AS reference, text AS candidate FROM documents d JOIN golds USING (doc_id))",
            *_lcs("doc_id"),
        ], f"""SELECT doc_id, round({_ratio('hit', 'n')}, 6) AS rougeL_p, round({_ratio('hit', 'm')}, 6) AS rougeL_r,
                      round({_f1('hit', 'n', 'm')}, 6) AS rougeL_f FROM lcs_out"""),
        "rougeL_labels": _with(labels, scores),
        "rougeL_labels_capped": _with(_overlap_labels(capped=True), scores),
        "label_distribution": _with(labels, """
            SELECT sum(label)::BIGINT AS positives, sum(1 - label)::BIGINT AS negatives,
                   round(sum(label)::DOUBLE / greatest(count(*), 1), 6) AS positive_fraction FROM labeled"""),
        "positive_weight": _with(labels, "SELECT round(sum(1 - label)::DOUBLE / sum(label), 6) AS positive_weight FROM labeled"),
        "class_weights": _with(labels, _weights_of("labeled", "label")),
        "union_sources": _union_sources(),
        "cosine_labels": _with(_cosine(stop), scores),
        "chat_requests": f"""
            SELECT doc_id, 'summary-model' AS model, {fixed.CHAT_TEMPERATURE}::DOUBLE AS temperature,
                   {fixed.CHAT_MAX_TOKENS} AS max_tokens, 'system' AS first_role, {_literal(fixed.SUMMARY_PROMPT)} AS prompt,
                   'user' AS second_role, text AS content FROM documents""",
        "chat_replies": _with(GOLDS + [REPLIES], "SELECT 'external' AS system, doc_id, text FROM replies"),
        "system_rouge_mean": _mean_scores(),
        "tfidf_unigram": _with(MERGED + terms + [
            "n_train AS (SELECT count(*) AS n FROM merged)", *_idf_weights("sent_terms", "sent_terms"),
        ], f"SELECT {key}, term, tf, round(weight, 6) AS weight FROM weighted"),
        "term_frequencies": _with(MERGED + terms, """
            SELECT term, count(*) AS df, sum(tf)::BIGINT AS total_tf FROM sent_terms GROUP BY term"""),
        "tfidf_bigram_topk": _with(_cosine(stop), "SELECT term, df, total_tf, round(idf, 6) AS idf FROM vocab"),
        "split_by_doc": _with(_split_docs("documents"), "SELECT doc_id, part FROM split"),
        "split_members": _with(PLAIN + _split_docs("documents"), """
            SELECT CASE WHEN part = 'train' THEN 'train' ELSE 'rest' END AS side, count(*) AS n_docs,
                   sum(len(p))::BIGINT AS n_sentences
            FROM plain0 JOIN split USING (doc_id) WHERE len(p) > 0 GROUP BY ALL"""),
        "split_stratified": _with(labels, f"""
            SELECT {key}, label, CASE WHEN row_number() OVER (
                       PARTITION BY label ORDER BY md5('{fixed.SEED}:' || doc_id || ':' || sentence_id), doc_id, sentence_id)
                   <= round(count(*) OVER (PARTITION BY label) * {fixed.TEST_FRACTION}) THEN 'test' ELSE 'train' END AS part
            FROM labeled"""),
        "frozen_transform": _with(MERGED + _split_docs("documents") + terms + [
            "train_ids AS (SELECT doc_id FROM split WHERE part = 'train')",
            "n_train AS (SELECT count(*) AS n FROM merged SEMI JOIN train_ids USING (doc_id))",
            "train_terms AS (SELECT * FROM sent_terms SEMI JOIN train_ids USING (doc_id))",
            "rest_terms AS (SELECT * FROM sent_terms ANTI JOIN train_ids USING (doc_id))",
            *_idf_weights("train_terms", "rest_terms"),
        ], f"SELECT {key}, term, tf, round(weight, 6) AS weight FROM weighted"),
        "nb_scores": _with(bayes, f"SELECT {key}, round(score, 6) AS score, prediction FROM bayes"),
        "nb_report": _with(bayes + [test_rows], "")[:-1] + _report("test_rows"),
        "threshold_report": _with(bayes + [test_rows, f"""
            cut AS (SELECT label, (score >= {fixed.FFN_THRESHOLD})::INTEGER AS prediction FROM test_rows)"""], "")[:-1] + _report("cut"),
        "nb_summary": _with(bayes + [
            f"""best AS (
                SELECT doc_id, sentence_id FROM bayes QUALIFY row_number() OVER (
                    PARTITION BY doc_id ORDER BY round(score, 9) DESC, sentence_id) <= {fixed.TOP_K_ROUGE})""",
        ], """SELECT doc_id, string_agg(sentence, ' ' ORDER BY sentence_id) AS text
              FROM best JOIN labeled USING (doc_id, sentence_id) GROUP BY doc_id"""),
        "nb_summary_rouge_mean": _nb_rouge_mean(bayes + [test_rows]),
        "report_val": _with(bayes + [test_rows.replace("'test'", "'val'")], "")[:-1] + _report("test_rows"),
        "logreg_optimum": _with(bayes, """
            SELECT n_rows, positives, n_terms, TRUE AS at_optimum,
                   round(sqrt(steepness) * n_rows / 4, 4) AS start_gradient
            FROM (SELECT count(*) AS n_rows, sum(label)::BIGINT AS positives FROM train),
                 (SELECT count(*) AS n_terms,
                         sum(power(sum0 / (SELECT count(*) FILTER (WHERE label = 0) FROM train)
                                   - sum1 / (SELECT count(*) FILTER (WHERE label = 1) FROM train), 2)) AS steepness
                  FROM class_sums)"""),
        "model_roundtrip": _with(_cosine(stop), "SELECT count(*) AS n, 0::BIGINT AS n_different FROM labeled"),
        "notes_fallback": f"""
            WITH items AS (SELECT item_id, {_split('text')} AS p FROM benchmark),
            rows AS (SELECT item_id, unnest(range(len(p)))::INTEGER AS sentence_id, unnest(p) AS sentence FROM items),
            listed AS (SELECT DISTINCT item_id, unnest({_split('left(text, length(text) // 2)')}) AS sentence FROM benchmark)
            SELECT 'notes' AS source, sentence_id, r.sentence, (l.sentence IS NOT NULL)::INTEGER AS label
            FROM rows r LEFT JOIN listed l ON l.item_id = r.item_id AND l.sentence = r.sentence""",
        "summary_last_ties": _with(labels + [
            f"""best AS (
                SELECT doc_id, sentence_id FROM scored QUALIFY row_number() OVER (
                    PARTITION BY doc_id ORDER BY round(score, 9) DESC, sentence_id DESC) <= {fixed.TOP_K_COSINE})""",
        ], """SELECT doc_id, string_agg(sentence, ' ' ORDER BY sentence_id) AS text
              FROM best JOIN plain USING (doc_id, sentence_id) GROUP BY doc_id"""),
        "first_n_pairs": _with(GOLDS, """
            SELECT d.doc_id, d.text AS document, summary FROM documents d JOIN golds USING (doc_id)
            ORDER BY d.doc_id LIMIT 100"""),
        "padded_sequences": _padded(),
        "csv_roundtrip": _with(TRANSCRIPTS[:2], "SELECT doc_id, transcript, title, playlist_name FROM transcripts"),
        "parquet_roundtrip": _with(MERGED, f"""
            SELECT doc_id, {topic} AS topic, token_count, ceil(token_count / {fixed.SECTION_WORDS}.0)::INTEGER AS n_sections,
                   string_agg(sentence, ' ' ORDER BY sentence_id) AS joined_sentences
            FROM merged JOIN cleaned USING (doc_id) GROUP BY doc_id, playlist_name, token_count"""),
        "text_notes": _with(PLAIN + [
            f"items AS (SELECT item_id, {_split('text')} AS p FROM benchmark)",
            "rows AS (SELECT item_id, unnest(range(len(p)))::INTEGER AS sentence_id, unnest(p) AS sentence FROM items)",
            "listed AS (SELECT DISTINCT sentence FROM plain)",
        ], """SELECT item_id, sentence_id, r.sentence, (l.sentence IS NOT NULL)::INTEGER AS label
              FROM rows r LEFT JOIN listed l ON l.sentence = r.sentence"""),
    }
