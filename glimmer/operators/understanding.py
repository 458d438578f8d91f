"""The deterministic part of query understanding: families, time markers, keywords, clean-up, query strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that mark a family of questions, found anywhere in the query (fixed values).
FAMILIES = {
    "spatial": ["show", "see", "look", "appear", "contain", "with", "red", "blue", "green", "person", "people", "car", "building", "mountain", "scene", "background", "foreground"],
    "temporal": ["beginning", "start", "end", "middle", "after", "before", "minutes", "seconds", "time", "duration", "clip", "section"],
    "audio": ["say", "talk", "speak", "sound", "music", "dialogue", "conversation", "audio", "voice", "hear", "mention"],
    "action": ["doing", "action", "activity", "movement", "dancing", "cooking", "walking", "running", "talking", "explaining", "interacting"],
}
#: What a family is called among the subtypes (fixed values).
SUBTYPES = {"spatial": "visual", "temporal": "time", "audio": "sound", "action": "activity"}
#: Words of time that are no sounds; with "minute" and "second" they make a mixed query temporal (fixed values).
TIME_WORDS = ["beginning", "start", "end", "first", "last", "after", "before"]
AUDIO_WORDS = ["talking", "saying", "dialogue", "music", "sound"]
#: Words that are no keywords, by use (fixed values).
KEYWORD_STOPS = ["show", "find", "with", "about", "video", "scene"]
ENTITY_STOPS = ["which", "what", "have", "with", "about", "videos", "video"]
FALLBACK_STOPS = ["the", "and", "or", "but", "with", "show", "find", "get"]


def _lower(query: Column) -> Column:
    return F.lower(F.coalesce(query, F.lit("")))


def _any(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def classify(query: Column, families: dict[str, list[str]] | None = None) -> Column:
    """struct(type, confidence, subtypes): the one family whose words occur, else 'mixed'."""
    q, families = _lower(query), families or FAMILIES
    found = F.array_compact(F.array(*[F.when(_any(q, words), F.lit(name)) for name, words in families.items()]))
    named = F.create_map(*[F.lit(x) for k in families for x in (k, SUBTYPES.get(k, k))])
    return F.struct(F.when(F.size(found) == 1, found[0]).otherwise("mixed").alias("type"), F.lit(0.7).alias("confidence"), F.transform(found, lambda f: named[f]).alias("subtypes"))


def time_marker(query: Column) -> Column:
    """``0-N`` for the first N, ``N-end`` for after N; without an amount ``0-60`` for beginning or start and ``last-60`` for end; else null."""
    q = _lower(query)
    pattern = r"(\d+)\s*(minute|min|second|sec|hour|hr)s?"
    amount, unit = F.regexp_extract(q, pattern, 1), F.regexp_extract(q, pattern, 2)
    n = F.when(amount != "", amount).try_cast("long") * F.when(unit.startswith("min"), 60).when(unit.startswith("hour") | unit.startswith("hr"), 3600).otherwise(1)
    return F.when(amount != "", F.when(_any(q, ["first", "beginning"]), F.concat(F.lit("0-"), n.cast("string"))).when(F.contains(q, F.lit("after")), F.concat(n.cast("string"), F.lit("-end")))).when(_any(q, ["beginning", "start"]), "0-60").when(F.contains(q, F.lit("end")), "last-60")


def audio_elements(elements: Column) -> Column:
    """Without words of time."""
    return F.filter(elements, lambda e: ~F.lower(e).isin(TIME_WORDS))


def promoted(query: Column, kind: Column, spatial: Column, action: Column) -> Column:
    """A mixed query with words of time, without words of sound and without spatial or action elements is temporal."""
    q = _lower(query)
    bare = (F.coalesce(F.size(spatial), F.lit(0)) <= 0) & (F.coalesce(F.size(action), F.lit(0)) <= 0)
    return F.when((kind == "mixed") & _any(q, [*TIME_WORDS, "minute", "second"]) & ~_any(q, AUDIO_WORDS) & bare, "temporal").otherwise(kind)


def time_range(query: Column, kind: Column, marker: Column) -> Column:
    """struct(start, end) in seconds from a marker, for temporal (or marked mixed) queries that mention time; a null end is the video's end."""
    asks = _any(_lower(query), [*TIME_WORDS, "minute", "second", "at"]) & kind.isin("temporal", "mixed") & F.contains(marker, F.lit("-"))
    first, last = F.split_part(marker, F.lit("-"), F.lit(1)), F.split_part(marker, F.lit("-"), F.lit(2))
    start = F.when(first == "last", None).otherwise(F.coalesce(first.try_cast("int"), F.lit(0)))
    end = F.when(last == "end", None).otherwise(last.try_cast("int"))
    return F.when(asks & (start.isNotNull() | end.isNotNull()), F.struct(F.coalesce(start, F.lit(0)).alias("start"), F.nullif(end, F.lit(0)).alias("end")))


def _words(query: Column, least: int, stops: list[str]) -> Column:
    words = F.split(F.regexp_replace(_lower(query), r"[^\w\s]", " "), r"\s+")
    return F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(stops))


def keywords(query: Column) -> Column:
    """The first three words of four letters or more that are no stop words."""
    return F.slice(_words(query, 4, KEYWORD_STOPS), 1, 3)


def entities(query: Column) -> Column:
    """Words of four letters or more that are no stop words; the query itself if there are none."""
    found = _words(query, 4, ENTITY_STOPS)
    return F.when(F.size(found) > 0, found).otherwise(F.array(query))


def fallback_query(query: Column) -> Column:
    """struct(cleaned, keywords): the query without a leading command, and its first three words of three letters or more."""
    bare = F.trim(F.regexp_replace(query, r"(?i)^(search for|find|show me|get|images with|images of|videos with|videos of)\s+", ""))
    return F.struct(F.when(bare == "", query).otherwise(bare).alias("cleaned"), F.slice(_words(query, 3, FALLBACK_STOPS), 1, 3).alias("keywords"))


def clean_output(answer: Column, query: Column, longest: int = 150) -> Column:
    """A model's answer as one line without preamble, list numbers and quotes; the query if nothing is left or too much."""
    t = F.trim(answer)
    for pattern, put in ((r"(?i)^Here are (?:some )?(?:key )?(?:search )?(?:terms?|keywords?).*?:\s*", ""), (r"(?i)^(?:Keywords?|Terms?|Query).*?:\s*", ""), (r"(?m)^\d+\.\s*", ""), (r"\n", " "), (r"^[\"`']+|[\"`']+$", "")):
        t = F.regexp_replace(t, pattern, put)
    t = F.trim(t)
    return F.when(t.isNull() | (t == "") | (F.length(t) > longest), query).otherwise(t)


def upper_letters(word: Column) -> Column:
    """Upper case letter for letter: a letter whose capital is several letters (a sharp s) stays as it is."""
    return F.array_join(F.transform(F.split(word, ""), lambda c: F.when(F.length(F.upper(c)) == F.length(c), F.upper(c)).otherwise(c)), "")


def keyword_union(*lists: Column) -> Column:
    """Distinct lower-cased keywords of all lists, in order."""
    return F.array_distinct(F.transform(F.concat(*lists), lambda w: F.lower(F.trim(w))))


def query_string(cleaned: Column, step_back: Column, words: Column) -> Column:
    """``c0|s0|c1|s1|...|keywords``: both lists interleaved, then the keywords in one part."""
    both = F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(F.size(cleaned), F.size(step_back)) - 1), lambda i: F.array_compact(F.array(F.get(cleaned, i), F.get(step_back, i)))))
    return F.array_join(F.concat(F.when(F.size(cleaned) + F.size(step_back) > 0, both).otherwise(F.array().cast("array<string>")), F.when(F.size(words) > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))), "|")


def parse_query(raw: Column) -> Column:
    """struct(cleaned, step_back, fts) of ``a|b|c`` with the text itself where a part is missing or empty."""
    parts = F.split(raw, r"\|")

    def part(i: int) -> Column:
        p = F.trim(F.get(parts, F.lit(i)))
        return F.coalesce(F.when(p != "", p), F.trim(raw))

    return F.struct(part(0).alias("cleaned"), part(1).alias("step_back"), part(2).alias("fts"))
