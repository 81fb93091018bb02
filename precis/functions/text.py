"""Row-local text expressions. All of them stay in the JVM and need no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from precis import fixed_values as fixed

# Unicode whitespace as a pattern class (Java's ``\s`` is ASCII only) and as characters.
SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
NOT_SPACE = r"[^\s\x0B\x1C-\x1F\x85\p{Z}]"
NOT_BLANK_SPACE = r"[\t-\r\x1C-\x1F\x85\p{Z}&&[^ ]]"  # all of SPACE but the blank
SPACE_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(
    map(chr, range(0x2000, 0x200B))
) + "\u2028\u2029\u202f\u205f\u3000"
WORD = r"[\p{L}\p{N}_]"

# A full stop after one of these does not end a sentence.
ABBREVIATIONS = (
    "dr", "mr", "mrs", "ms", "prof", "st", "jr", "sr", "vs", "cf", "fig", "e.g", "i.e", "u.s",
    "inc", "ltd", "corp",
)

_BREAK = "\u0001"  # marks a sentence boundary while a text is being cut


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` uses it.

    Neighbouring projections are merged by the optimizer, which can put a costly expression inside a
    per-element lambda; a lambda variable cannot be inlined.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def whole(array: Column) -> Column:
    """The array as it is, to be exploded.

    For a bare array column the optimizer adds a test for emptiness and pushes it below the
    projection that makes the array, which is then made twice. An expression gets no such test.
    """
    return F.transform(array, lambda x: x)


def _empty_strings() -> Column:
    return F.array().cast("array<string>")


def collapse_space(text: Column) -> Column:
    """Every run of whitespace becomes one space; both ends are stripped. Runs that are one space stay as they are."""
    return F.trim(F.regexp_replace(text, f"{NOT_BLANK_SPACE}{SPACE}*| {SPACE}+", " "))


def strip_space(text: Column) -> Column:
    return F.trim(text, F.lit(SPACE_CHARS))


def is_blank(text: Column) -> Column:
    return ~F.rlike(text, F.lit(NOT_SPACE))


def clean_transcript(text: Column) -> Column:
    """Lower-case, then drop ``[bracket tags]`` and ``>>`` speaker marks and collapse whitespace."""
    no_tags = F.regexp_replace(F.lower(text), r"\[[^\]]+\]", " ")
    return collapse_space(F.regexp_replace(no_tags, f">+{SPACE}*", " "))


def words(clean: Column) -> Column:
    """Whitespace tokens of an already collapsed text; ``''`` has none."""
    return let(clean, lambda c: F.when(c == "", _empty_strings()).otherwise(F.split(c, " ")))


def token_count(clean: Column) -> Column:
    return let(clean, lambda c: F.when(c == "", F.lit(0)).otherwise(F.size(F.split(c, " "))))


def word_sections(tokens: Column, size: int = fixed.SECTION_WORDS) -> Column:
    """Cut a word array into runs of ``size`` words; the last one may be short."""
    def cut(ts: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(ts), F.lit(size))
        runs = F.transform(starts, lambda s: F.array_join(F.slice(ts, s, F.lit(size)), " "))
        return F.when(F.size(ts) > 0, runs).otherwise(_empty_strings())

    return let(tokens, cut)


def split_sentences(text: Column, abbreviations: tuple[str, ...] = ABBREVIATIONS) -> Column:
    """Cut after ``.``, ``!`` or ``?`` plus closing quotes or brackets when whitespace follows.

    A piece that ends in an abbreviation is joined to the next one again; only the last characters
    of each piece are looked at for that. Sentences are stripped and empty ones dropped. The marker
    is blanked in the input first, so that a text that happens to hold it is not cut there.
    """
    marked = F.regexp_replace(
        F.replace(text, F.lit(_BREAK), F.lit(" ")), rf"""([.!?]["')\]]*)({SPACE}+)""", f"$1{_BREAK}$2"
    )
    pieces = F.split(marked, _BREAK)
    if abbreviations:
        names = "|".join(a.replace(".", r"\.") for a in abbreviations)
        pattern = F.lit(rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:{names})\.$")
        tail = F.lit(max(map(len, abbreviations)) + 2)
        goes_on = lambda piece: F.rlike(F.right(piece, tail), pattern)
        rejoined = lambda ps: F.array_join(
            F.transform(
                ps,
                lambda p, i: F.when((i == 0) | goes_on(F.get(ps, i - 1)), p).otherwise(
                    F.concat(F.lit(_BREAK), p)
                ),
            ),
            "",
        )
        pieces = F.split(let(pieces, rejoined), _BREAK)
    return F.filter(F.transform(pieces, strip_space), lambda s: s != "")


def add_fallback_stops(text: Column) -> Column:
    """Put full stops at commas and before ``so`` / ``and``, for text without punctuation."""
    at_commas = F.regexp_replace(text, f"{SPACE}*,{SPACE}*", ". ")
    at_so = F.regexp_replace(at_commas, f"{SPACE}+so{SPACE}+", ". so ")
    return F.regexp_replace(at_so, f"{SPACE}+and{SPACE}+", ". and ")


def merge_short(sentences: Column, min_chars: int = fixed.MIN_SENTENCE_CHARS) -> Column:
    """Glue each sentence shorter than ``min_chars`` to its predecessor.

    Whether a sentence opens a new group depends on that sentence alone, so one join with two kinds
    of separators and one split do the whole fold in linear time.
    """
    def merged(parts: Column) -> Column:
        glued = F.transform(
            parts,
            lambda s, i: F.when(i == 0, s)
            .when(F.length(s) >= min_chars, F.concat(F.lit(_BREAK), s))
            .otherwise(F.concat(F.lit(" "), s)),
        )
        joined = F.split(F.array_join(glued, ""), _BREAK)
        return F.when(F.size(parts) > 0, joined).otherwise(_empty_strings())

    return let(sentences, merged)


def lecture_sentences(clean: Column, min_chars: int = fixed.MIN_SENTENCE_CHARS) -> Column:
    """Sentences of a cleaned transcript: split, fall back to commas, merge short ones."""
    fallback = split_sentences(add_fallback_stops(clean))
    parts = let(split_sentences(clean), lambda p: F.when(F.size(p) <= 1, fallback).otherwise(p))
    return merge_short(parts, min_chars)


def rouge_text(text: Column) -> Column:
    """ROUGE tokens joined by single spaces: lower-case, everything but ``[a-z0-9]`` separates."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def feature_tokens(text: Column, stop_words: list[str]) -> Column:
    """Lower-case words of two or more word characters without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(f"({WORD}{{2,}})"), F.lit(1))
    if not stop_words:
        return found
    return F.filter(found, lambda t: ~t.isin(stop_words))


def bigrams(tokens: Column) -> Column:
    def pairs(ts: Column) -> Column:
        n = F.size(ts)
        joined = F.zip_with(
            F.slice(ts, F.lit(1), n - 1),
            F.slice(ts, F.lit(2), n - 1),
            lambda a, b: F.concat_ws(" ", a, b),
        )
        return F.when(n > 1, joined).otherwise(_empty_strings())

    return let(tokens, pairs)


def feature_terms(text: Column, stop_words: list[str], max_n: int = 1) -> Column:
    """Feature terms of a text: unigrams, or unigrams and bigrams (``max_n`` 2)."""
    tokens = feature_tokens(text, stop_words)
    if max_n == 1:
        return tokens
    if max_n == 2:
        return let(tokens, lambda ts: F.concat(ts, bigrams(ts)))
    raise ValueError(f"max_n must be 1 or 2, not {max_n}")


def topic_of(playlist_name: Column) -> Column:
    """Topic bucket of a playlist name; a null name is ``Other``."""
    name = F.lower(F.coalesce(playlist_name, F.lit("")))
    topic = F.lit(fixed.OTHER_TOPIC)
    for label, keywords in reversed(fixed.TOPIC_RULES):
        hit = F.lit(False)
        for keyword in keywords:
            hit = hit | F.contains(name, F.lit(keyword))
        topic = F.when(hit, F.lit(label)).otherwise(topic)
    return topic


def english_stop_words() -> list[str]:
    """Spark's own English list; pass another list where a different one is wanted."""
    from pyspark.ml.feature import StopWordsRemover

    return StopWordsRemover.loadDefaultStopWords("english")
