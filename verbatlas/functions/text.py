"""Text functions as column expressions: normalisation, sentences, tokens.

All are built-in expressions of the JVM; Unicode NFC is a method of the ICU
library that Spark brings along, called only for texts with a code point from
U+0300 on: below that every string is its own NFC form.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Function words of the language profiles, and words of the page chrome.
GBAGYI_MODULE = (
    "wa nu yi n ɓa ge na ye wo ho ba ku lo shi zhin ntu ɓo ɓe a ma gna to ama sai har gama nya ɓi ga ta "
    "the a an and or but in on at to for of with by from is are was were be"
).split()
GBAGYI = "wa nu yi n ɓa ge na ye wo ho ba ku lo shi zhin ntu ɓo ɓe a ma gna to ama sai har gama nya ɓi ga ta kwo aza oza deye fye".split()
NUPE = "the a an and or but in on at to for of with by from is are was were be been being have has had do does did will would".split()
STOP_WORDS = {"gbagyi": GBAGYI_MODULE, "gbagyi_glossed": GBAGYI, "nupe": NUPE}

#: A character that normalisation may change: controls, markup, apostrophes, no-break space, soft hyphen, and all from U+0300 on.
#: Stated as what is looked for: Java searches a negated class of several ranges about eight times slower.
_CHANGED = r"[&<'\x00-\x09\x0B-\x1F\x7F-\xA0\xAD\x{300}-\x{10FFFF}]"


def nfc(text: Column) -> Column:
    """Unicode normal form C; null stays null."""
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))
    return F.when(text.rlike(r"[\x{300}-\x{10FFFF}]"), composed).otherwise(text)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), 0)


def squeeze(text: Column) -> Column:
    """Unicode strip. Only texts that begin or end with white space are searched."""
    edges = lambda x: F.concat(F.substring(x, 1, 1), F.substring(x, -1, 1))
    return _let(text, lambda x: F.when(edges(x).rlike(r"(?U)\s"), F.regexp_replace(x, r"(?U)^\s+|\s+\z", "")).otherwise(x))


def _cleaned(text: Column) -> Column:
    x = nfc(text)
    x = F.regexp_replace(x, r"<[^>]+>", " ")
    x = F.regexp_replace(x, r"&[a-zA-Z]+;", " ")
    x = F.regexp_replace(x, r"&#\p{Nd}+;", " ")
    x = F.translate(x, "\r\t", "  ")
    x = F.regexp_replace(x, r"[\p{C}&&[^\n]]", "")
    x = F.translate(x, "’‘'", "ʼʼʼ")
    return F.when(text.rlike(_CHANGED), x).otherwise(text)


def normalize(text: Column) -> Column:
    """NFC, markup and entities out, control and format characters deleted, quotes to U+02BC, spaces squeezed.

    Texts without a character that any of the steps before the last can change skip these steps.
    """
    return squeeze(_let(_cleaned(text), lambda x: F.when(x.contains("  "), F.regexp_replace(x, "  +", " ")).otherwise(x)))


def sentences(text: Column) -> Column:
    """Array of sentences: split at white space behind ``.``, ``!`` or ``?``; terminators stay, blanks go."""
    flat = squeeze(F.regexp_replace(text, r"(?U)[\s&&[^ ]]\s*| \s+", " "))  # single blanks stay
    return F.array_remove(F.split(flat, r" (?<=[.!?] )", -1), "")


def tokens(text: Column, remove_stopwords: bool = False, keep_punctuation: bool = True, profile: str = "gbagyi") -> Column:
    """Array of tokens of a text that is normalised first.

    Profile ``gbagyi``: lower case; tokens are runs of letters and hyphens, and single
    marks of punctuation (or none); all else parts them; lone hyphens dropped. How
    blanks are squeezed makes no difference here, so only the rest of normalisation runs.
    Profile ``nupe``: markup out, lower case, combining marks kept, punctuation dropped.
    """
    if profile == "nupe":
        x = F.regexp_replace(F.lower(nfc(text)), r"<[^>]+>", " ")
        x = F.regexp_replace(x, r"[^\p{L}\p{M}\-ʼ'’]", " ")
        found = F.filter(F.split(x, r"(?U)\s+", -1), lambda t: (t != "") & (t != "-"))
        words = NUPE
    else:
        pattern = r"[\p{L}\-]+" + (r'|[.,;:!?()\[\]{}"]' if keep_punctuation else "")
        found = F.array_remove(F.regexp_extract_all(F.lower(_cleaned(text)), F.lit(pattern), F.lit(0)), "-")
        words = STOP_WORDS[profile]
    if remove_stopwords:
        stop = list(dict.fromkeys(words))
        found = F.filter(found, lambda t: ~t.isin(stop))
    return found


def joined(words: Column) -> Column:
    return F.array_join(words, " ")


def code_point(text: Column) -> Column:
    """The number of the first character; 0 for an empty text."""
    return F.ascii(text)


def clean_verse(text: Column) -> Column:
    """Verse numbers at the start and behind a sentence, note marks and runs of white space out."""
    x = F.regexp_replace(text, r"(?U)^\s*\d+\s*", "")
    x = F.regexp_replace(x, r"(?<=[.?!])(?U:\s*\d+)(?=[A-ZƁ])", " ")
    x = F.regexp_replace(x, r"[#*]+", " ")
    return squeeze(F.regexp_replace(x, r"(?U)\s+", " "))
