"""Tokens, titles and small text clean-ups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# A token is a run of word characters; Han runs are cut out and split further.
TOKEN = r"\p{IsHan}+|[\p{L}\p{N}_&&[^\p{IsHan}]]+"
_HAN = r"\p{IsHan}"
# All Han characters lie here; a range is checked faster than a script, and so is a word without it.
_MAYBE_HAN = r"[\x{2E80}-\x{10FFFF}]"
_WORD = r"[\p{L}\p{N}_]+"


def strip_digits(text: Column) -> Column:
    """Leave out ASCII digits, so counters and dates do not look like changes."""
    return F.regexp_replace(text, "[0-9]", "")


def doc_title(text: Column) -> Column:
    """First line of the text."""
    return F.regexp_replace(F.substring_index(text, "\n", 1), r"\r\z", "")


def has_title(text: Column) -> Column:
    """False for text made of nothing but line breaks: such a document cannot be indexed."""
    return (text == "") | text.rlike(r"[^\r\n]|\r(?!\n)")


def flatten_newlines(text: Column) -> Column:
    """Turn ``\\r\\n`` into a space; a bare ``\\n`` stays."""
    return F.replace(text, F.lit("\r\n"), F.lit(" "))


def runs(text: Column) -> Column:
    """Array of lower-cased word and Han runs in text order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _bigrams(run: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, 2))
    return F.when(F.length(run) < 2, F.array(run)).otherwise(pairs)


def tokens(text: Column) -> Column:
    """Array of lower-cased tokens; the index in it is the token's position.

    Han runs give overlapping pairs of characters, all other runs one token.
    """
    plain = runs(text)
    split_han = F.flatten(
        F.transform(plain, lambda r: F.when(r.rlike(_HAN), _bigrams(r)).otherwise(F.array(r)))
    )
    words = F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))
    return F.when(text.rlike(_MAYBE_HAN), split_han).otherwise(words)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once, also where ``body`` uses it per array element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def highlight_terms(text: Column, terms: Column, open_tag: str, close_tag: str) -> Column:
    """Wrap every token of ``text`` that is in the array ``terms``; nothing is escaped.

    Pairs of Han characters overlap: in a Han run the stretch from the first matching pair
    to the end of the last one is wrapped.
    """

    def wrap(word: Column, first: Column, size: Column) -> Column:
        return F.concat(
            F.substring(word, F.lit(1), first - 1),
            F.lit(open_tag),
            F.substring(word, first, size),
            F.lit(close_tag),
            F.substring(word, first + size, F.length(word)),
        )

    def mark(word: Column, wanted: Column) -> Column:
        whole = F.array_contains(wanted, F.lower(word))
        starts = F.filter(
            F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1))),
            lambda i: F.array_contains(wanted, F.substring(word, i, F.lit(2))),
        )
        pairs = let(
            starts,
            lambda at: F.when(F.size(at) == 0, word).otherwise(
                wrap(word, F.array_min(at), F.array_max(at) - F.array_min(at) + 2)
            ),
        )
        return F.when(whole, F.concat(F.lit(open_tag), word, F.lit(close_tag))).when(
            word.rlike(_HAN), pairs
        ).otherwise(word)

    gaps = F.split(text, TOKEN)
    words = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))

    def joined(wanted: Column) -> Column:
        return F.array_join(
            F.zip_with(
                gaps, words, lambda g, w: F.when(w.isNull(), g).otherwise(F.concat(g, mark(w, wanted)))
            ),
            "",
        )

    return let(terms, joined)
