"""Word stems: English by M. F. Porter, "An algorithm for suffix stripping" (1980), Romanian by the published Snowball description."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes and what stands in their place, by step of the published algorithm.
PLURALS = [("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")]
STEP_2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(stem: str) -> str:
    """V for each vowel and C for each consonant; y is a vowel after a consonant."""
    shape = ""
    for c in stem:
        shape += "V" if c in "aeiou" or (c == "y" and shape.endswith("C")) else "C"
    return shape


def _measure(stem: str) -> int:
    return _shape(stem).count("VC")


def _ends_short(stem: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    return _shape(stem).endswith("CVC") and stem[-1] not in "wxy"


def _longest(word: str, suffixes: list[str]) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def _replaced(word: str, rules: list[tuple[str, str]], least: int) -> str:
    """The longest suffix of rules replaced, if what precedes it has a measure of least or more."""
    suffix = _longest(word, [s for s, _ in rules])
    stem = word[: len(word) - len(suffix)]
    return stem + dict(rules)[suffix] if suffix and _measure(stem) >= least else word


def _without_endings(word: str) -> str:
    """Step 1b: past and continuous forms."""
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) else word
    suffix = _longest(word, ["ed", "ing"])
    stem = word[: len(word) - len(suffix)]
    if not suffix or "V" not in _shape(stem):
        return word
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if _shape(stem).endswith("CC") and stem[-1] == stem[-2] and stem[-1] not in "lsz":
        return stem[:-1]
    return stem + "e" if _measure(stem) == 1 and _ends_short(stem) else stem


@lru_cache(1 << 16)
def porter(word: str) -> str:
    """Stem of a lower-case word; words of one or two letters, and those not all of a to z, are left as they are."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    word = _without_endings(_replaced(word, PLURALS, 0))
    if word.endswith("y") and "V" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, STEP_2, 1), STEP_3, 1)
    suffix = _longest(word, STEP_4)
    stem = word[: len(word) - len(suffix)]
    if suffix and _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
        word = stem
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _ends_short(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


# English words that are passed over, the usual list of 127.
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves
what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while
of at by for with about against between into through during before after above below to from up down in out on off over under again further then once
here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now
""".split()

# Romanian suffixes, by step of the published algorithm, and what stands in their place.
ROMANIAN_PLURALS = [
    ("ul", ""), ("ului", ""), ("aua", "a"), ("ea", "e"), ("ele", "e"), ("elor", "e"), ("ii", "i"), ("iua", "i"), ("iei", "i"), ("iile", "i"), ("iilor", "i"), ("ilor", "i"),
    ("ile", "i"), ("atei", "at"), ("aţie", "aţi"), ("aţia", "aţi"),
]
ROMANIAN_COMBINED = {
    "abil": "abilitate abilitati abilităi abilităţi", "ibil": "ibilitate", "iv": "ivitate ivitati ivităi ivităţi",
    "ic": "icitate icitati icităi icităţi icator icatori iciv iciva icive icivi icivă ical icala icale icali icală",
    "at": "ativ ativa ative ativi ativă aţiune atoare ator atori ătoare ător ători", "it": "itiv itiva itive itivi itivă iţiune itoare itor itori",
}
ROMANIAN_STANDARD = """
at ata ată ati ate ut uta ută uti ute it ita ită iti ite ic ica ice ici ică abil abila abile abili abilă ibil ibila ibile ibili ibilă oasa oasă oase os osi oşi
ant anta ante anti antă ator atori itate itati ităi ităţi iv iva ive ivi ivă
""".split()
ROMANIAN_IUNE, ROMANIAN_IST = ["iune", "iuni"], ["ism", "isme", "ist", "ista", "iste", "isti", "istă", "işti"]
ROMANIAN_VERB_AFTER = """
are ere ire âre ind ând indu ându eze ească ez ezi ează esc eşti eşte ăsc ăşti ăşte am ai au eam eai ea eaţi eau iam iai ia iaţi iau ui aşi arăm arăţi ară
uşi urăm urăţi ură işi irăm irăţi iră âi âşi ârăm ârăţi âră asem aseşi ase aserăm aserăţi aseră isem iseşi ise iserăm iserăţi iseră âsem âseşi âse âserăm âserăţi âseră
usem useşi use userăm userăţi useră
""".split()
ROMANIAN_VERB = "ăm aţi em eţi im iţi âm âţi seşi serăm serăţi seră sei se sesem seseşi sese seserăm seserăţi seseră".split()
ROMANIAN_VOWELS = "aăâeiîou"


def _after(word: str, start: int) -> int:
    """Where the region begins that follows the first consonant after a vowel, from start on."""
    for i in range(start + 1, len(word)):
        if word[i] not in ROMANIAN_VOWELS and word[i - 1] in ROMANIAN_VOWELS:
            return i + 1
    return len(word)


def _verb_region(word: str) -> int:
    if len(word) < 2:
        return len(word)
    vowel = [c in ROMANIAN_VOWELS for c in word]
    if vowel[0] != vowel[1] and not vowel[1] or not vowel[0] and not vowel[1]:
        return next((i + 1 for i in range(2, len(word)) if vowel[i]), len(word))
    if vowel[0] and vowel[1]:
        return next((i + 1 for i in range(2, len(word)) if not vowel[i]), len(word))
    return min(3, len(word))


@lru_cache(1 << 16)
def romanian(word: str) -> str:
    """Stem of a lower-case word; s and t with a comma below are read as those with a cedilla."""
    word = word.replace("ș", "ş").replace("ț", "ţ")
    # i and u between vowels are consonants, marked by capitals.
    word = "".join(c.upper() if c in "iu" and 0 < i < len(word) - 1 and word[i - 1] in ROMANIAN_VOWELS and word[i + 1] in ROMANIAN_VOWELS else c for i, c in enumerate(word))
    verb, one = _verb_region(word), _after(word, 0)
    two = _after(word, one)
    inside = lambda suffix, region: suffix and len(word) - len(suffix) >= region

    suffix = _longest(word, [s for s, _ in ROMANIAN_PLURALS])
    if inside(suffix, one) and not (suffix == "ile" and word.endswith("abile")):
        word = word[: len(word) - len(suffix)] + dict(ROMANIAN_PLURALS)[suffix]
    combined = {s: base for base, suffixes in ROMANIAN_COMBINED.items() for s in suffixes.split()}
    replaced = False
    while inside(suffix := _longest(word, list(combined)), one):
        word, replaced = word[: len(word) - len(suffix)] + combined[suffix], True
    suffix = _longest(word, ROMANIAN_STANDARD + ROMANIAN_IUNE + ROMANIAN_IST)
    if inside(suffix, two):
        stem = word[: len(word) - len(suffix)]
        if suffix in ROMANIAN_IST:
            word, replaced = stem + "ist", True
        elif suffix not in ROMANIAN_IUNE:
            word, replaced = stem, True
        elif stem.endswith("ţ"):
            word, replaced = stem[:-1] + "t", True
    if not replaced:
        suffix = _longest(word[verb:], ROMANIAN_VERB_AFTER + ROMANIAN_VERB)
        before = word[: len(word) - len(suffix)]
        if suffix in ROMANIAN_VERB or (suffix and len(before) > verb and (before[-1] == "u" or before[-1] not in ROMANIAN_VOWELS)):
            word = before
    suffix = _longest(word, ["a", "e", "i", "ie", "ă"])
    if inside(suffix, verb):
        word = word[: len(word) - len(suffix)]
    return word.lower()


STEMMERS = {"english": porter, "romanian": romanian}
#: Romanian has no usual list.
STOP_WORDS = {"english": frozenset(ENGLISH_STOP_WORDS), "romanian": frozenset()}


def may_have_stem(word: Column, stem: str, language: str) -> Column:
    """False only for words that have another stem, told without stemming: Porter's steps change the last letter of a stem at most, Romanian ones leave the first two."""
    if language == "english":
        return word.startswith(stem[:-1])
    return F.translate(word, "șț", "şţ").startswith(stem[:2]) if language == "romanian" else F.lit(True)


def stemmed(words: Column, language: str = "english") -> Column:
    """Stems of an array of words, in their order."""
    stem = STEMMERS[language]

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda ws: None if ws is None else [stem(w) for w in ws])

    return run(words)


def stem_column(word: Column, language: str) -> Column:
    """The stem of one word."""
    stem = STEMMERS[language]

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda w: None if w is None else stem(w))

    return run(word)
