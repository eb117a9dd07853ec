"""Text preparation as column expressions, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone import constants as C

#: An identifier can only start where a word starts. Saying so spares the regex
#: engine a retry at every later letter of every plain word.
_IDENTIFIER = "(?<![a-z0-9])" + C.IDENTIFIER


def tokenize(text: Column) -> Column:
    """Identifiers whole and in parts, then the remaining words, in that order."""
    lowered = F.lower(text)
    identifiers = F.regexp_extract_all(lowered, F.lit(_IDENTIFIER), F.lit(0))
    with_parts = F.flatten(
        F.transform(
            identifiers,
            lambda i: F.concat(F.array(i), F.split(i, C.IDENTIFIER_PARTS)),
        )
    )
    rest = F.regexp_extract_all(
        F.regexp_replace(lowered, _IDENTIFIER, " "), F.lit(C.WORD), F.lit(0)
    )
    return F.filter(
        F.concat(with_parts, rest),
        lambda t: (F.length(t) >= C.MIN_TOKEN_CHARS) & ~t.isin(*C.STOPWORDS),
    )


def words(text: Column) -> Column:
    """Whitespace-separated words, empty for blank text."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def token_estimate(text: Column) -> Column:
    scaled = F.floor(F.size(words(text)) * F.lit(C.TOKENS_PER_WORD))
    return F.greatest(F.lit(1), scaled.cast("int"))


def normalise_prompt(text: Column) -> Column:
    """Fold case and whitespace; punctuation carries intent and stays."""
    return F.regexp_replace(strip(F.lower(text)), r"(?U)\s+", " ")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def sentences(text: Column) -> Column:
    parts = F.split(strip(text), "(?U)" + C.SENTENCE_BREAK)
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def is_claim(sentence: Column) -> Column:
    return ~sentence.rlike("(?iU)" + C.NON_CLAIM) & (
        F.size(words(sentence)) >= C.MIN_CLAIM_WORDS
    )


def has_marker(sentence: Column) -> Column:
    return sentence.rlike(C.MARKER)


def char_ngrams(token: Column) -> Column:
    """A short token is its own gram; a longer one is padded and windowed."""
    padded = F.concat(F.lit("^"), token, F.lit("$"))
    starts = F.sequence(F.lit(1), F.length(padded) - (C.NGRAM - 1))
    return F.when(F.length(token) <= C.NGRAM, F.array(token)).otherwise(
        F.transform(starts, lambda i: F.substring(padded, i, C.NGRAM))
    )


def embedding_features(tokens: Column) -> Column:
    """Each token followed by its grams; repeats are kept and counted later."""
    return F.concat(tokens, F.flatten(F.transform(tokens, char_ngrams)))


def truncated(text: Column, chars: int) -> Column:
    return F.left(text, F.lit(chars))


def present(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def retrieval_query(workload: Column, body: Column, context: Column) -> Column:
    """The search text of a run, by workload, with blank parts left out."""
    triage = F.concat_ws(
        " ", present(body), present(context["signature"]), present(context["service"]),
        present(context["metrics"]),
    )
    review = F.concat_ws(
        " ", present(body), present(context["service"]), present(context["change_kind"]),
        F.lit(C.CHANGE_QUERY_SUFFIX),
    )
    return F.when(workload == "incident_triage", triage).when(
        workload == "change_review", review
    ).otherwise(F.raise_error(F.concat(F.lit("unknown workload "), workload)))


def slug(name: Column) -> Column:
    return F.regexp_replace(
        F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-|-$", ""
    )


def demands_value(question: Column) -> Column:
    return question.rlike("(?iU)" + C.DEMANDS_A_VALUE)


def contains_value(body: Column) -> Column:
    return body.rlike("(?iU)" + C.CONTAINS_A_VALUE)
