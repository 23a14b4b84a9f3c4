"""Text functions as Spark columns; all stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest token that an index keeps.
LONGEST_TOKEN = 40
#: Punctuation that the weak normaliser folds, and what it becomes.
FOLDED_FROM, FOLDED_TO = "‘’“”–— ", "''\"\"-- "
#: Words without content, for overlaps of names and labels.
STOP_WORDS = "a an and are as at be by for from has in is it its of on or that the this to was were which with you your".split()


def collapse(s: Column) -> Column:
    """Unicode white space to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def weak_form(s: Column) -> Column:
    """Lower case with typographic quotes, dashes and fixed blanks folded."""
    return collapse(F.translate(F.lower(s), FOLDED_FROM, FOLDED_TO))


def line_form(s: Column) -> Column:
    """A line as boilerplate statistics compare it."""
    return F.lower(F.trim(F.regexp_replace(s, r"[ \t\r\x0B\f]+", " ")))


def lines(s: Column) -> Column:
    return F.split(s, r"\r?\n", -1)


def index_tokens(s: Column, longest: int = LONGEST_TOKEN) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(s), F.lit("([a-z0-9]+)"), 1), lambda t: F.length(t) <= longest)


def first_line(s: Column) -> Column:
    return F.split(s, r"\r?\n", 2)[0]


def words(s: Column) -> Column:
    """All tokens in order; ``content_tokens`` and ``matching.word_tokens`` are some of them."""
    return F.regexp_extract_all(F.lower(s), F.lit("([a-z0-9_']+)"), 1)


def content_tokens(s: Column, shortest: int = 2) -> Column:
    found = F.regexp_extract_all(F.lower(s), F.lit("([a-z0-9_']+)"), 1)
    return F.filter(found, lambda t: (F.length(t) >= shortest) & ~t.isin(STOP_WORDS))


def stem(t: Column) -> Column:
    """A light singular: -ies to -y, -es and -s off where that leaves a word."""
    return (
        F.when((F.length(t) > 4) & t.endswith("ies"), F.regexp_replace(t, "ies$", "y"))
        .when((F.length(t) > 4) & t.rlike("(ses|xes|zes|ches|shes)$"), F.regexp_replace(t, "es$", ""))
        .when((F.length(t) > 3) & t.endswith("s") & ~t.endswith("ss"), F.regexp_replace(t, "s$", ""))
        .otherwise(t)
    )


def sentences(s: Column) -> Column:
    """Parts between line breaks, or after . ? ! ; : and white space; blank ones left out."""
    parts = F.split(s, r"(?:\r?\n)+|(?<=[.?!;:])\s+", -1)
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: F.length(x) > 0)


def heading_form(s: Column) -> Column:
    """A heading without the running number that slides append, "(2)" or "2"."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(s), r"\s*\(\d+\)\s*$", ""), r"\s+\d+\s*$", ""))


def stable_phrase(s: Column, words: int = 12, characters: int = 96) -> Column:
    """The first words, cut at a word's end."""
    phrase = F.array_join(F.slice(F.split(collapse(s), " "), 1, words), " ")
    cut = F.regexp_replace(F.substring(phrase, 1, characters + 1), r"\s+\S*$", "")
    return F.when(F.length(phrase) <= characters, phrase).otherwise(cut)


def snippet(s: Column, term: Column, width: int = 160) -> Column:
    """A literal piece of s around the first place of the term, a quarter of it before."""
    place = F.instr(F.lower(s), F.lower(term))
    start = F.greatest(F.lit(1), F.least(place - width // 4, F.length(s) - width + 1))
    return F.substring(s, F.when(place > 0, start).otherwise(F.lit(1)), F.lit(width))


def fingerprint(s: Column) -> Column:
    return F.sha1(weak_form(s))


def slug(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def camel_split(s: Column) -> Column:
    return F.regexp_replace(s, "(?<=[a-z])(?=[A-Z])", " ")


def acronym(s: Column) -> Column:
    """First letters of two to eight words; null for others."""
    words = F.filter(F.split(collapse(s), " "), lambda w: w.rlike("^[A-Za-z]"))
    letters = F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))
    return F.when(F.size(words).between(2, 8), letters)


def label_variants(s: Column) -> Column:
    """Spellings of a label: as it is, hyphens and slashes as blanks, without what is in parentheses."""
    base = collapse(s)
    forms = F.array(
        base,
        collapse(F.regexp_replace(base, "[-/]", " ")),
        collapse(F.regexp_replace(base, r"\([^)]*\)", " ")),
        F.lower(base),
    )
    return F.array_distinct(F.filter(forms, lambda x: F.length(x) > 0))


def ratio(s: Column, pattern: str) -> Column:
    """Matches of a pattern of one character for each character of s."""
    return F.length(F.regexp_replace(s, f"[^{pattern}]", "")) / F.greatest(F.length(s), F.lit(1))


def balanced(s: Column, opening: str, closing: str) -> Column:
    """Whether brackets of one kind close what they open, in order."""
    only = F.regexp_replace(s, f"[^\\{opening}\\{closing}]", "")
    depth = F.aggregate(
        F.split(only, ""),
        F.lit(0),
        lambda d, c: F.when(d < 0, d).when(c == opening, d + 1).when(c == closing, d - 1).otherwise(d),
    )
    return depth == 0


def contains_phrase(s: Column, phrase: Column) -> Column:
    """The phrase as a run of whole tokens."""
    padded = lambda x: F.concat(F.lit(" "), F.array_join(index_tokens(x), " "), F.lit(" "))
    return F.contains(padded(s), padded(phrase)) & (F.size(index_tokens(phrase)) > 0)


def token_jaccard(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(content_tokens(a)), F.array_distinct(content_tokens(b))
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))


def overlap_of_smaller(x: Column, y: Column) -> Column:
    """Shared elements for each of the smaller of two distinct arrays."""
    return F.size(F.array_intersect(x, y)) / F.greatest(F.least(F.size(x), F.size(y)), F.lit(1))
