"""Full text: tokens, stop words, stems, ranked retrieval, snippets."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parameters of BM25.
K1, B = 1.2, 0.75
TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


#: English function words; pass another list where another is wanted.
STOP_WORDS = ("a about after all also am an and any are as at be because been before being between both but by can could did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its just me more most my no nor not now of off on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with you your").split()


def clean_query(query: Column) -> Column:
    """Words of a query: what is neither a word character nor white space becomes a blank."""
    return F.filter(F.split(F.regexp_replace(query, r"[^\w\s]", " "), r"\s+"), lambda x: x != "")


def char_ngrams(text: Column, n: int) -> Column:
    """Character n-grams; a shorter text is its only one."""
    return F.when(F.length(text) < n, F.array(text)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(n))))


def snippet(text: Column, words: list[str], around: int = 50, head: int = 100) -> Column:
    """Around the first query word found (in query order), else the head of the text."""
    out = F.substring(text, 1, head)
    for w in reversed(words):
        at = F.locate(w.lower(), F.lower(text))
        start = F.greatest(at - around, F.lit(1))
        out = F.when(at > 0, F.substring(text, start, at + len(w) + around - start)).otherwise(out)
    return out


def _measure(stem: str) -> int:
    """Vowel-consonant sequences in a stem."""
    shape = ""
    for i, c in enumerate(stem):
        kind = "v" if c in "aeiou" or (c == "y" and i and shape[-1] == "c") else "c"
        if not shape or shape[-1] != kind:
            shape += kind
    return shape.count("vc")


def _has_vowel(stem: str) -> bool:
    return any(c in "aeiou" or (c == "y" and i) for i, c in enumerate(stem))


#: Suffix rules of steps 2 to 4 of the published stemming algorithm (fixed values).
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _cvc(w: str) -> bool:
    return len(w) >= 3 and w[-1] not in "aeiouwxy" and w[-2] in "aeiouy" and w[-3] not in "aeiou"


def porter_stem(w: str) -> str:
    """English suffix stripping after the published 1980 algorithm."""
    if len(w) <= 2:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = 2 if w.endswith("ed") and _has_vowel(w[:-2]) else 3 if w.endswith("ing") and _has_vowel(w[:-3]) else 0
        if cut:
            w = w[:-cut]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeioulsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules in (STEP2, STEP3):
        for end in sorted(rules, key=len, reverse=True):
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + rules[end]
                break
    for end in sorted(STEP4, key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(T.ArrayType(T.StringType()))
def stem_words(words: pd.Series) -> pd.Series:
    """Stems of an array of words, batch by batch (no column expression for it exists)."""
    return words.map(lambda ws: None if ws is None else [porter_stem(w) for w in ws])


def smart_terms(query: Column, stop_words: list[str]) -> Column:
    """Lower-case words of a query without stop words and single letters; the words themselves if none is left."""
    words = F.filter(F.split(F.lower(query), r"[\s,;.!?]+"), lambda w: w != "")
    kept = F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(stop_words))
    return F.when(F.size(kept) > 0, kept).otherwise(words)


def stem_dictionary(words: DataFrame) -> DataFrame:
    """(word, stem) of the distinct words of a column ``word``: each is stemmed once, however often it occurs."""
    return words.where(F.col("word").isNotNull()).select("word").distinct().select("word", stem_words(F.array("word"))[0].alias("stem"))


def stems_of(queries: DataFrame, key: str, words: Column, stems: DataFrame) -> DataFrame:
    """(key, stems): the words of each row by their stems, in order; words that the dictionary lacks stay. Keys name one row each."""
    each = queries.select(key, F.posexplode_outer(words).alias("_at", "word")).join(stems, "word", "left")
    out = each.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("_at").isNotNull(), F.struct("_at", F.coalesce("stem", "word").alias("w"))))).alias("_w"))
    return out.select(key, F.transform("_w", lambda x: x["w"]).alias("stems"))


def prepared_terms(query: str, stop_words: list[str] = STOP_WORDS, stemmed: bool = True, least: int = 2) -> list[str]:
    """What a raw query looks for: its lower-case words without stop words and short ones, by their stems; all its words if none is left."""
    words = [w for w in re.split(r"[\s,;.!?]+", query.lower()) if w]
    kept = [w for w in words if w not in set(stop_words) and len(w) >= least]
    return ([porter_stem(w) for w in kept] if stemmed else kept) or words
