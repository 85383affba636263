"""String and token expressions for one page or one sentence."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# A word character, and what the lemma blacklist refuses.
WORD_CHAR = r"[\p{L}\p{N}_]"
BLACKLIST = ("º", "__")

# Fixed value: the tokens worth keeping are words (letters joined by -, _ or __)
# and the years 1800-2019.  Word edges are spelled out as look-arounds because
# \b changed its meaning for non-ASCII letters between Java 17 and Java 19.
EDGE_L = rf"(?<!{WORD_CHAR})"
EDGE_R = rf"(?!{WORD_CHAR})"
CLEAN_TOKEN = (
    rf"{EDGE_L}\p{{L}}+(?:(?:-|_{{1,2}})\p{{L}}+)*{EDGE_R}"
    rf"|{EDGE_L}(?:1[89][0-9]{{2}}|20[01][0-9]){EDGE_R}"
)

# A run of word characters, or a run of anything else that is not white space.
WORD_OR_MARK = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]+"

SENTENCE_END = r"""[.!?]['"’”)\]]*"""
_MARK = "\x1f"
_BLANKS = "".join(chr(c) for c in range(0x21))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind an expression once for a body that uses it several times or per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalise_lines(text: Column) -> Column:
    """Trim every line, drop empty lines, trim the page (one pass over the text).

    The look-behind lets a run of blanks be tried only at its start, so long
    blank runs cost linear time.
    """
    joined = F.regexp_replace(
        text, r"(?<![\x00-\x20])[\x00-\x20]*?\n[\x00-\x20]*+", "\n"
    )
    return F.trim(joined, F.lit(_BLANKS))


def dehyphenate(text: Column) -> Column:
    """Join a word broken at a line end; the line break moves behind the word."""
    return F.regexp_replace(text, r"(\p{L})-\n(\S+)[ \n]?", "$1$2\n")


def split_sentences(text: Column, abbreviations: Sequence[str] = ()) -> Column:
    """Sentences of a page: split after ``.``, ``!`` or ``?`` (plus closing marks).

    ``abbreviations`` (without the dot) never end a sentence.
    """
    guard = "".join(
        rf"(?<!{EDGE_L}\Q{a}\E)" for a in abbreviations
    )
    marked = F.regexp_replace(text, rf"{guard}({SENTENCE_END})\s+", f"$1{_MARK}")
    parts = F.transform(
        F.split(marked, _MARK), lambda s: F.trim(s, F.lit(_BLANKS))
    )
    return F.filter(parts, lambda s: s != "")


def flatten_sentences(sentences: Column) -> Column:
    """One line per page: breaks inside a sentence become blanks, tab between sentences."""
    return F.array_join(
        F.transform(sentences, lambda s: F.regexp_replace(s, "[\n\r\t]", " ")), "\t"
    )


def resplit_sentences(text: Column) -> Column:
    """Back from the tab-joined page to its sentences."""
    return F.split(text, "\t+")


def regexp_quote(text: Column) -> Column:
    return F.concat(
        F.lit("\\Q"), F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")
    )


def rewrite_patterns(text: Column, patterns: Sequence[tuple[str, str]]) -> Column:
    """Replace every match of each pattern by its (literal) name, in list order."""
    for name, pattern in patterns:
        literal = name.replace("\\", "\\\\").replace("$", "\\$")
        text = F.regexp_replace(text, pattern, literal)
    return text


def words_and_marks(text: Column) -> Column:
    """Word tokens and punctuation tokens, in order."""
    return F.regexp_extract_all(text, F.lit(WORD_OR_MARK), F.lit(0))


def drop_words(tokens: Column, words: Sequence[str]) -> Column:
    """Tokens outside a short literal list (an IN set, so a hash probe per token)."""
    words = sorted(set(words))
    if not words:
        return tokens
    return F.filter(tokens, lambda t: ~t.isin(words))


def drop_blacklisted(tokens: Column) -> Column:
    def clean(t: Column) -> Column:
        hit = F.lit(False)
        for mark in BLACKLIST:
            hit = hit | F.contains(t, F.lit(mark))
        return ~hit

    return F.filter(tokens, clean)


def fuse_phrases(text: Column, phrases: Column) -> Column:
    """Write each listed phrase as one word (blank -> ``__``), in list order.

    ``phrases`` is an array column or literal.  Fusing only removes blanks, so a
    phrase that is not in the original text can never appear later: the cheap
    ``contains`` test on the original text is a safe pre-filter.
    """
    def fuse(acc: Column, p: Column) -> Column:
        return F.regexp_replace(
            acc,
            F.concat(F.lit(EDGE_L), regexp_quote(p), F.lit(EDGE_R)),
            F.replace(p, F.lit(" "), F.lit("__")),
        )

    return let(
        text,
        lambda t: F.aggregate(F.filter(phrases, lambda p: F.contains(t, p)), t, fuse),
    )


def extract_tokens(text: Column) -> Column:
    """Words and years 1800-2019."""
    return F.regexp_extract_all(text, F.lit(CLEAN_TOKEN), F.lit(0))


def min_token_length(tokens: Column, longer_than: int = 2) -> Column:
    return F.filter(tokens, lambda t: F.length(t) > longer_than)


def tokenise(text: Column) -> Column:
    """Tokens of cleaned text: split on single blanks."""
    return F.split(text, " ")


def whitespace_tokens(text: Column) -> Column:
    """Tokens between runs of white space; null and empty text give no tokens."""
    return F.filter(
        F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != ""
    )


def candidate_phrases(tokens: Column, stop_words: Sequence[str]) -> Column:
    """Maximal runs of at least two alphabetic tokens that are no stop words.

    ``tokens`` holds word and punctuation tokens (``words_and_marks``); a stop
    word or a non-alphabetic token ends a run (candidate rule of Rose et al.
    2010).
    """
    stops = sorted({w.lower() for w in stop_words})

    def keep(t: Column) -> Column:
        ok = t.rlike(r"^\p{L}+$")
        if stops:
            ok = ok & ~F.lower(t).isin(stops)
        return ok

    runs = F.split(
        F.array_join(
            F.transform(tokens, lambda t: F.when(keep(t), t).otherwise(F.lit(_MARK))),
            " ",
        ),
        f" *{_MARK} *",
    )
    return F.filter(runs, lambda r: F.contains(r, F.lit(" ")))


def remove_tokens_text(text: Column, words: Sequence[str]) -> Column:
    return F.array_join(drop_words(whitespace_tokens(text), words), " ")
