"""Text functions as column expressions: names, numbers, similarity and the 13a tokens of BLEU."""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Number words that become digits.
UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
ORDINALS = "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth".split()
NUMBERS = {w: i for i, w in enumerate(UNITS)} | {w: 20 + 10 * i for i, w in enumerate(TENS)} | {w: i for i, w in enumerate(ORDINALS, 1)} | {"twentieth": 20, "thirtieth": 30}


def letters(s: Column | str) -> Column:
    """Runs of ASCII letters and apostrophes."""
    return F.regexp_extract_all(s, F.lit("([A-Za-z']+)"), F.lit(1))


def proper_nouns(s: Column | str) -> Column:
    """Distinct lower-cased words that are one capital and small letters, beyond the first word of the text."""
    later = F.filter(letters(s), lambda w, i: (i > 0) & w.rlike("^[A-Z][a-z]*$"))
    return F.array_distinct(F.transform(later, F.lower))


def lowered(s: Column | str) -> Column:
    """The first step of ``normalized_numbers``: small letters, ``$5`` as ``5 dollars``."""
    t = F.col(s) if isinstance(s, str) else s
    return F.lower(F.when(F.contains(t, F.lit("$")), F.regexp_replace(t, r"\$\s*(\d+)", "$1 dollars")).otherwise(t))


NUMBER_WORDS = {w: str(n) for w, n in NUMBERS.items()}
WORD = re.compile(r"[A-Za-z']+|\d+|[^\sA-Za-z\d']", re.ASCII)
TENS_AND_UNITS = re.compile(r" (0*[2-9]0)  (0*[1-9]) ")
ORDINAL_ENDS = re.compile(r" ([0-9]+) (?: (?:st|nd|rd|th) )+")


def numbers_as_digits(low: str) -> str:
    """The other steps of ``normalized_numbers`` on a text that is ``lowered``, for code that runs in a task."""
    words = WORD.findall(low)
    if not words:
        return ""
    spaced = f" {'  '.join([NUMBER_WORDS.get(w, w) for w in words])} "
    joined = TENS_AND_UNITS.sub(lambda m: f" {int(m[1]) + int(m[2])} ", spaced)
    return ORDINAL_ENDS.sub(r" \1 ", joined).replace("  ", " ").strip(" ")


#: Signs that part from the word before them.
MARKS = frozenset(".,;:!?)")
TEN, UNIT = re.compile(r"0*[2-9]0\Z"), re.compile(r"0*[1-9]\Z")
ENDS = frozenset(("st", "nd", "rd", "th"))


@functools.lru_cache(1 << 16)
def number_parts(word: str) -> tuple[str, ...]:
    return tuple(NUMBER_WORDS.get(w, w) for w in WORD.findall(word))


def number_tokens(word: str) -> tuple[str, ...]:
    """A word's part of the tokens of ``numbers_as_digits``, before they act on each other."""
    if word.isascii():
        if word.isalpha():
            return (NUMBER_WORDS.get(word, word),)
        if word[-1:] in MARKS and (start := word[:-1]).isalpha():  # most of the others
            return NUMBER_WORDS.get(start, start), word[-1]
    return number_parts(word)


def numbers_joined(codes: np.ndarray, tokens: list[str], sizes: list[np.ndarray]) -> tuple[np.ndarray, list[str], list[np.ndarray]]:
    """Texts as numbers of ``number_tokens``, with what ``numbers_as_digits`` does to neighbours: tens and units are joined, ordinal endings dropped."""
    if not len(codes):
        return codes, tokens, sizes
    lengths = np.concatenate(sizes)
    text = np.repeat(np.arange(len(lengths)), lengths)
    number = [t.isdigit() and t.isascii() for t in tokens]
    ten, unit = (np.array([n and bool(p.match(t)) for t, n in zip(tokens, number, strict=True)])[codes] for p in (TEN, UNIT))
    first = np.flatnonzero(ten[:-1] & unit[1:] & (text[:-1] == text[1:]))  # a token is not both, so pairs don't share any
    if len(first):
        codes, kept, place = codes.copy(), np.ones(len(codes), bool), {t: i for i, t in enumerate(tokens)}
        for i in first:
            codes[i] = place.setdefault(str(int(tokens[codes[i]]) + int(tokens[codes[i + 1]])), len(place))
        kept[first + 1] = False
        number += [True] * (len(place) - len(tokens))
        codes, text, tokens = codes[kept], text[kept], list(place)
    end, digits = np.array([t in ENDS for t in tokens])[codes], np.array(number)[codes]
    last = np.maximum.accumulate(np.where(end, 0, np.arange(len(codes))))  # the latest token that is no ending
    kept = ~(end & digits[last] & (text[last] == text))
    return codes[kept], tokens, np.split(np.bincount(text[kept], minlength=len(lengths)), [len(sizes[0])])


def normalized_numbers(s: Column | str) -> Column:
    """Number words as digits, ``$5`` as ``5 dollars``, tens and units joined, ordinal endings after digits dropped."""
    tokens = F.regexp_extract_all(lowered(s), F.lit(r"([A-Za-z']+|\d+|[^\sA-Za-z\d'])"), F.lit(1))
    number = F.create_map(*(x for w, n in NUMBERS.items() for x in (F.lit(w), F.lit(str(n)))))
    words = F.transform(tokens, lambda w: F.coalesce(F.try_element_at(number, w), w))

    def joined(digits: Column) -> Column:
        value = lambda i: F.get(digits, i).try_cast("long")
        joins = lambda i: F.coalesce(F.get(digits, i).rlike("^[0-9]+$") & (value(i) % 10 == 0) & value(i).between(20, 90) & F.get(digits, i + 1).rlike("^[0-9]+$") & value(i + 1).between(1, 9), F.lit(False))
        return F.transform(digits, lambda w, i: F.when(joins(i), (value(i) + value(i + 1)).cast("string")).when(joins(i - 1), F.lit(None)).otherwise(w))

    merged = F.transform(F.array(words), joined)[0]  # bound to a variable, so that the words are made once and not for each of them
    kept = F.filter(merged, lambda w: w.isNotNull())
    spaced = F.array_join(F.transform(kept, lambda w: F.concat(F.lit(" "), w, F.lit(" "))), "")
    return F.trim(F.replace(F.regexp_replace(spaced, " ([0-9]+) (?: (?:st|nd|rd|th) )+", " $1 "), F.lit("  "), F.lit(" ")))


def char_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length; 1 for equal texts, 0 if just one is empty."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1.0 - F.levenshtein(a, b) / longer)


def tokens_13a(s: Column | str) -> Column:
    """The mteval-13a tokens of a text."""
    t = F.col(s) if isinstance(s, str) else s
    for a, b in (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.concat(F.lit(" "), t, F.lit(" "))
    for a, b in ((r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "), (r"([^0-9])([\.,])", "$1 $2 "), (r"([\.,])([^0-9])", " $1 $2"), (r"([0-9])(-)", "$1 $2 ")):
        t = F.regexp_replace(t, a, b)
    return F.filter(F.split(t, r"\s+"), lambda w: w != "")


REPLACED = (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
SPLIT = tuple((re.compile(a), b) for a, b in ((r"([\{-\~\[-\`!-\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "), (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")))
SOLID = re.compile(r"\S+", re.ASCII)


def words_13a(text: str) -> list[str]:
    """``tokens_13a`` for code that runs in a task."""
    for a, b in REPLACED:
        text = text.replace(a, b)
    text = f" {text} "
    for a, b in SPLIT:
        text = a.sub(b, text)
    return SOLID.findall(text)


def tokens_of_word(word: str) -> tuple[str, ...]:
    """The 13a tokens of a word of a ``replaced`` text: no rule looks beyond the white space around it."""
    if word.isalnum():
        return (word,)
    if word[-1:] in MARKS and (start := word[:-1]).isalnum():  # most of the others
        return start, word[-1]
    return parts_of_word(word)


@functools.lru_cache(1 << 16)
def parts_of_word(word: str) -> tuple[str, ...]:
    word = f" {word} "
    for a, b in SPLIT:
        word = a.sub(b, word)
    return tuple(SOLID.findall(word))


def replaced(texts: pa.Array) -> pa.Array:
    """What the 13a tokens do to whole texts before white space parts them."""
    for a, b in REPLACED:
        texts = pc.replace_substring(texts, a, b)
    return texts


def path_stem(s: Column | str) -> Column:
    """The base name without its last extension."""
    return F.regexp_replace(F.regexp_extract(s, r"([^/]*)$", 1), r"\.[^.]*$", "")


def hhmmss_seconds(s: Column | str) -> Column:
    """Seconds of ``HH:MM:SS`` with a fraction."""
    p = F.split(s, ":")
    return F.get(p, 0).cast("double") * 3600 + F.get(p, 1).cast("double") * 60 + F.get(p, 2).cast("double")
