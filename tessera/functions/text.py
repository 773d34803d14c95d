"""Text analysis as Column expressions, with a driver-side twin for query words."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.stem import STEMMERS

# The stop words of the two supported languages.
STOP_WORDS = {
    "en": """the a an and or not in on at to for of with by from as is are was were be been being
        have has had do does did but if else when up down out over under again further then once""".split(),
    "ru": """и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне
        было вот от меня еще нет о из ему теперь когда даже ну вдруг ли если уже или быть был него до вас
        нибудь опять уж вам ведь там потом себя ничего ей может они тут где есть надо ней для мы тебя их чем
        была сам чтоб без будто чего раз тоже себе под будет ж тогда кто этот того потому этого какой совсем
        ним здесь этом один почти мой тем чтобы нее""".split(),
}

WORD = r"[\p{L}\p{N}]+"


def tokenize(text: Column) -> Column:
    """Maximal runs of letters and numbers, case kept; a null text has no tokens."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def lower(word: Column) -> Column:
    """Character-by-character lower case: no expansion of dotted I, no final sigma."""
    return F.lower(F.translate(word, "İΣ", "iσ"))


def trim(word: Column) -> Column:
    """The word without what is neither letter nor number at either end."""
    return F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def surface_terms(text: Column, lang: str) -> Column:
    """Distinct lower-cased tokens that aren't stop words of the language, not yet stemmed."""
    terms = F.array_distinct(F.transform(tokenize(text), lower))
    stop = STOP_WORDS.get(lang)
    return F.array_except(terms, F.array(*map(F.lit, stop))) if stop else terms


def detect_language(text: Column) -> Column:
    """`ru` if the first letter is Cyrillic, else `en`."""
    return F.when(text.rlike(r"^[^\p{L}]*\p{IsCyrillic}"), "ru").otherwise("en")


def _is_word_char(c: str) -> bool:
    return unicodedata.category(c)[0] in "LN"


def normalize_word(word: str, lang: str) -> str:
    """The term a single query word stands for; an empty string if it stands for none."""
    word = "".join(c.lower()[0] for c in word)
    keep = [i for i, c in enumerate(word) if _is_word_char(c)]
    word = word[keep[0] : keep[-1] + 1] if keep else ""
    if not word or word in STOP_WORDS.get(lang, ()):
        return ""
    return STEMMERS[lang](word) if lang in STEMMERS else word
