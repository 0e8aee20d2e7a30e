"""Text analysis as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STOP_WORDS = "a be if of an in on no to or as is at it by and the are for was its not but such with will then into this that they there these their".split()

#: Suffix rules in order: (suffix, least length, characters cut, whether a doubled consonant shrinks).
STEM_RULES = (
    ("sses", 4, 2, False), ("ies", 4, 2, False), ("ied", 4, 2, False),
    ("edness", 9, 6, True), ("ingly", 8, 5, True), ("edly", 7, 4, True),
    *((s, 6, 4, False) for s in ("ness", "ment", "tion", "able", "ible")),
    ("ing", 6, 3, True), *((s, 5, 3, False) for s in ("ful", "ous", "ive")),
    ("ly", 5, 2, False), ("ed", 5, 2, True), ("er", 5, 2, True), ("ss", 4, 0, False), ("s", 4, 1, False),
)

#: Endings that are no part of a name.
FILE_ENDINGS = r"(?i)\.(?:" + "|".join("css csv doc docx html java js json log md pdf py ts txt xml yaml yml".split()) + ")$"

#: Words that make no tags.
TAG_STOP_WORDS = set(
    (
        "doc src had did old and see she the one are use all can who too tmp her for our has was his its get let not but out txt "
        "you new how now may say way data java said made make like file time come some here were more have each much with back "
        "will them from than been then when main down also into temp over your docs this that what part test just they only many "
        "very could would while there where these those being which chunk still under other after never their class tests first "
        "about index every should before because through mdchunk between another uploaded textchunk multipart "
    ).split()
)


def standard_terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits, two characters at least, without stop words; in order, with repeats."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.filter(tokens, lambda t: (F.length(t) >= 2) & ~t.isin(STOP_WORDS))


def stem(word: Column) -> Column:
    """Light suffix stripping; the first rule that fits decides."""
    result = word
    for suffix, least, cut, shrink in reversed(STEM_RULES):
        cutting = F.substring(word, F.lit(1), F.length(word) - cut)
        if shrink:
            last, before = F.substring(cutting, -1, 1), F.substring(cutting, F.length(cutting) - 1, F.lit(1))
            doubled = (F.length(cutting) >= 2) & (last == before) & ~last.isin(*"aeiou")
            cutting = F.when(doubled, F.substring(cutting, F.lit(1), F.length(cutting) - 1)).otherwise(cutting)
        result = F.when(F.endswith(word, F.lit(suffix)) & (F.length(word) >= least), cutting).otherwise(result)
    return F.when(F.length(word) <= 3, word).otherwise(result)


def stemmed_terms(text: Column) -> Column:
    return F.transform(standard_terms(text), stem)


def normalize_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def truncate(text: Column, most: int) -> Column:
    """At most `most` characters, the last three of a cut text being dots."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, F.lit(1), F.lit(max(0, most - 3))), F.lit("...")))


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("int")


def exceeds_tokens(text: Column, most: int) -> Column:
    return estimate_tokens(text) > most


def word_count(text: Column) -> Column:
    """Words by Unicode rules (the JVM's break iterator)."""
    return F.size(F.flatten(F.sentences(text, F.lit("en"), F.lit("US"))))


def _tag_words(text: Column, more_than: int) -> Column:
    parts = F.split(F.lower(text), r"[/\\._\-:\s]+")
    clean = F.transform(parts, lambda w: F.regexp_replace(w, "[^a-z0-9]", ""))
    return F.filter(clean, lambda w: (F.length(w) > more_than) & ~w.isin(sorted(TAG_STOP_WORDS)) & ~F.rlike(w, F.lit("^[0-9]+$")))


def content_tags(name: Column, text: Column, most: int = 10, most_content: int = 5) -> Column:
    """Tags from a path, then the longest words of the first 500 characters (earlier ones first among equals)."""
    bare = F.regexp_replace(F.regexp_replace(name, r"(::chunk-\d+|#chunk-\d+)$", ""), FILE_ENDINGS, "")
    path = F.array_distinct(_tag_words(bare, 2))
    words = F.array_except(_tag_words(F.substring(text, 1, 500), 4), path)
    ranked = F.array_sort(F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w"))))
    longest = F.slice(F.transform(ranked, lambda x: x["w"]), 1, most_content)
    return F.slice(F.concat(path, longest), 1, most)


def structured_text(content: Column) -> Column:
    """Text of XML, of JSON string values (not keys), or of `Name{a=b}`; anything else as it is."""
    t = F.trim(content)
    xml = F.regexp_replace(F.regexp_replace(t, r"(?s)<!\[CDATA\[(.+?)]]>", "$1"), "<[^>]+>", " ")
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        xml = F.regexp_replace(xml, f"&{name};", char)
    string = r'"([^"\\]*(?:\\.[^"\\]*)*)"'
    values = F.regexp_extract_all(t, F.lit(string + r"(\s*:)?"), F.lit(0))
    kept = F.filter(values, lambda v: ~F.rlike(v, F.lit(r":$")))
    json = F.array_join(F.transform(kept, lambda v: F.substring(v, F.lit(2), F.length(v) - 2)), " ")
    fields = F.transform(F.regexp_extract_all(t, F.lit(r"(\w+)=([^,}]+)"), F.lit(2)), F.trim)
    words = F.filter(fields, lambda v: ~F.rlike(v, F.lit(r"^-?\d+\.?\d*$")) & ~v.isin("true", "false", "null"))
    shown = (
        F.when(F.startswith(t, F.lit("<")), normalize_whitespace(xml))
        .when(F.startswith(t, F.lit("{")) | F.startswith(t, F.lit("[")), normalize_whitespace(json))
        .when(F.contains(t, F.lit("{")) & F.contains(t, F.lit("=")), normalize_whitespace(F.array_join(words, " ")))
        .otherwise(content)
    )
    return F.when(F.coalesce(F.length(content), F.lit(0)) == 0, F.lit("")).otherwise(shown)
