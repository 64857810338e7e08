"""Porter2 stems and rule lemmas, computed once for each distinct word of a vocabulary."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import ship

V = "aeiouy"
# Fixed values of the Porter2 algorithm: suffixes and their replacements, exceptional forms.
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDINGS = "cdeghkmnrt"
STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion",
    "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous",
    "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate",
    "alli": "al", "bli": "ble",
}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}


def _regions(w: str) -> tuple[int, int]:
    def after(start: int) -> int:
        m = re.search(f"[{V}][^{V}]", w[start:])
        return start + m.end() if m else len(w)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = after(0) if r1 is None else r1
    return r1, after(r1)


def _short_end(w: str) -> bool:
    return bool(re.search(f"[^{V}][{V}][^{V}wxY]$", w) or re.fullmatch(f"[{V}][^{V}]", w))


def stem(word: str) -> str:
    """The Porter2 stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    w = word.removeprefix("'")
    w = re.sub(f"(^|[{V}])y", lambda m: m.group(1) + "Y", w)
    r1, r2 = _regions(w)
    w = re.sub(r"('s'|'s|')$", "", w)
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{V}]", w[:-2]):
        w = w[:-1]
    if w in AFTER_1A:
        return w.replace("Y", "y")
    # 1b
    m = re.search("(eedly|eed|ingly|edly|ing|ed)$", w)
    if m:
        suffix = m.group()
        if suffix.startswith("eed"):
            if m.start() >= r1:
                w = w[: m.start()] + "ee"
        elif re.search(f"[{V}]", w[: m.start()]):
            w = w[: m.start()]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(DOUBLES):
                w = w[:-1]
            elif r1 >= len(w) and _short_end(w):
                w += "e"
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in V:
        w = w[:-1] + "i"
    # 2
    for suffix in sorted((*STEP2, "ogi", "li"), key=len, reverse=True):
        if w.endswith(suffix):
            at = len(w) - len(suffix)
            if at >= r1:
                if suffix == "ogi":
                    w = w[:-1] if w[at - 1] == "l" else w
                elif suffix == "li":
                    w = w[:-2] if w[at - 1] in LI_ENDINGS else w
                else:
                    w = w[:at] + STEP2[suffix]
            break
    # 3
    for suffix in sorted((*STEP3, "ative"), key=len, reverse=True):
        if w.endswith(suffix):
            at = len(w) - len(suffix)
            if suffix == "ative":
                w = w[:at] if at >= r2 else w
            elif at >= r1:
                w = w[:at] + STEP3[suffix]
            break
    # 4
    for suffix in sorted((*STEP4, "ion"), key=len, reverse=True):
        if w.endswith(suffix):
            at = len(w) - len(suffix)
            if at >= r2 and (suffix != "ion" or w[at - 1] in "st"):
                w = w[:at]
            break
    # 5
    at = len(w) - 1
    if w.endswith("e"):
        if at >= r2 or (at >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and at >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def stems(vocabulary: DataFrame, column: str = "term") -> DataFrame:
    """(term, stem) for the distinct words of a column."""
    ship(vocabulary.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(stem=pdf.term.map(stem))

    return vocabulary.select(F.col(column).cast("string").alias("term")).filter("term is not null").distinct().mapInPandas(run, "term string, stem string")


# WordNet's noun detachment rules, in order.
NOUN_RULES = (("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"))


def lemmas(vocabulary: DataFrame, lexicon: DataFrame, column: str = "term") -> DataFrame:
    """(term, lemma): the shortest noun form that a rule gives and the lexicon (term) has; else the word itself."""
    words = vocabulary.select(F.col(column).alias("term")).distinct()
    forms = F.array(*[F.when(F.col("term").endswith(a), F.concat(F.expr(f"substring(term, 1, length(term) - {len(a)})"), F.lit(b))) for a, b in NOUN_RULES])
    tried = words.select("term", F.explode(F.array_append(F.filter(forms, lambda f: f.isNotNull()), F.col("term"))).alias("lemma"))
    known = tried.join(lexicon.select(F.col("term").alias("lemma")).distinct(), "lemma", "left_semi")
    best = known.groupBy("term").agg(F.min(F.struct(F.length("lemma").alias("n"), "lemma"))["lemma"].alias("lemma"))
    return words.join(best, "term", "left").select("term", F.coalesce("lemma", "term").alias("lemma"))
