"""English (Porter2) and Russian suffix strippers, from the published algorithms.

Stemming can't be written as built-in functions, so it runs as an Arrow-batched UDF; callers
apply it to the distinct vocabulary and join the result back.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F

VOWELS = "aeiouy"
# Irregular words of the English algorithm, and those left alone after plural removal.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl",
    "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT_AFTER_PLURAL = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "fulli": "ful", "lessli": "less",
}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split()


def _after_vowel_consonant(word: str, start: int) -> int:
    m = re.search(f"[{VOWELS}][^{VOWELS}]", word[start:])
    return start + m.end() if m else len(word)


def _ends_short_syllable(word: str) -> bool:
    return bool(re.search(rf"[^{VOWELS}][{VOWELS}][^{VOWELS}wxY]$|^[{VOWELS}][^{VOWELS}]$", word))


def _longest(word: str, suffixes) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def stem_english(word: str) -> str:
    word = re.sub("[’‘‛]", "'", word)
    if len(word) <= 2:
        return word
    word = word.removeprefix("'")
    if word in IRREGULAR:
        return IRREGULAR[word]
    # A y that acts as a consonant is written Y meanwhile.
    word = re.sub(f"(?<=[{VOWELS}])y", "Y", re.sub("^y", "Y", word))
    special = next((p for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    r1 = len(special) if special else _after_vowel_consonant(word, 0)
    r2 = _after_vowel_consonant(word, r1)

    word = re.sub("('s'|'s|')$", "", word)
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(f"[{VOWELS}]", word[:-2]):
        word = word[:-1]
    if word in KEPT_AFTER_PLURAL:
        return word

    suffix = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if suffix in ("eed", "eedly"):
        if len(word) - len(suffix) >= r1:
            word = word[: -len(suffix)] + "ee"
    elif suffix and re.search(f"[{VOWELS}]", word[: -len(suffix)]):
        word = word[: -len(suffix)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", word):
            word = word[:-1]
        elif len(word) <= r1 and _ends_short_syllable(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"

    suffix = _longest(word, [*STEP2, "ogi", "li"])
    if suffix and len(word) - len(suffix) >= r1:
        if suffix == "ogi":
            word = word[:-1] if word.endswith("logi") else word
        elif suffix == "li":
            word = word[:-2] if word[-3:-2] and word[-3] in "cdeghkmnrt" else word
        else:
            word = word[: -len(suffix)] + STEP2[suffix]
    suffix = _longest(word, [*STEP3, "ative"])
    if suffix and len(word) - len(suffix) >= r1:
        if suffix == "ative":
            word = word[:-5] if len(word) - 5 >= r2 else word
        else:
            word = word[: -len(suffix)] + STEP3[suffix]
    suffix = _longest(word, [*STEP4, "ion"])
    if suffix and len(word) - len(suffix) >= r2 and (suffix != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(suffix)]
    if word.endswith("e"):
        if len(word) - 1 >= r2 or len(word) - 1 >= r1 and not _ends_short_syllable(word[:-1]):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


RU_VOWELS = "аеиоуыэюя"
# The suffix groups of the Russian algorithm. Group 1 of two must follow а or я.
GERUND = ("в вши вшись".split(), "ив ивши ившись ыв ывши ывшись".split())
ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею".split()
PARTICIPLE = ("ем нн вш ющ щ".split(), "ивш ывш ующ".split())
REFLEXIVE = ("ся", "сь")
VERB = (
    "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно".split(),
    "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split(),
)
NOUN = """а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я""".split()


def _strip(word: str, start: int, plain, after_a=()) -> str | None:
    """The word without the longest fitting suffix inside the region, or None."""
    region = word[start:]
    fits = [s for s in plain if region.endswith(s)]
    fits += [s for s in after_a if region.endswith(s) and region[: -len(s)][-1:] in ("а", "я")]
    return word[: -len(max(fits, key=len))] if fits else None


def stem_russian(word: str) -> str:
    word = word.replace("ё", "е")
    m = re.search(f"[{RU_VOWELS}]", word)
    if not m:
        return word
    rv, regions = m.end(), [0, 0]
    for i, start in enumerate((0, None)):
        start = regions[0] if start is None else start
        n = re.search(f"[{RU_VOWELS}][^{RU_VOWELS}]", word[start:])
        regions[i] = start + n.end() if n else len(word)
    r2 = regions[1]

    if (cut := _strip(word, rv, GERUND[1], GERUND[0])) is not None:
        word = cut
    else:
        word = _strip(word, rv, REFLEXIVE) or word
        if (cut := _strip(word, rv, ADJECTIVE)) is not None:
            word = cut
            cut = _strip(word, rv, PARTICIPLE[1], PARTICIPLE[0])
            word = word if cut is None else cut
        else:
            for groups in ((VERB[1], VERB[0]), (NOUN,)):
                if (cut := _strip(word, rv, *groups)) is not None:
                    word = cut
                    break
    if len(word) > rv and word.endswith("и"):
        word = word[:-1]
    for suffix in ("ость", "ост"):
        if word.endswith(suffix) and len(word) - len(suffix) >= r2:
            word = word[: -len(suffix)]
            break
    for suffix in ("ейше", "ейш"):
        if word[rv:].endswith(suffix):
            word = word[: -len(suffix)]
            break
    if word[rv:].endswith("нн"):
        return word[:-1]
    return word[:-1] if word[rv:].endswith("ь") else word


STEMMERS = {"en": stem_english, "ru": stem_russian}


def stemmed(word: str, lang: str) -> str:
    """The stem; a word that the stemmer can't take stays as it is."""
    try:
        return STEMMERS[lang](word)
    except (IndexError, ValueError, UnicodeError):
        return word


def stem_udf(lang: str):
    """Arrow-batched stemmer of one language."""

    @F.pandas_udf("string")
    def run(words: pd.Series) -> pd.Series:
        return words.map(lambda w: stemmed(w, lang), na_action="ignore")

    return run
