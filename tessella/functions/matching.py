"""Matching of labels, phrases and cues as Spark columns; the strong form alone needs Python, for Unicode's tables."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Marks that the strong form folds, as code points, and what they become.
STRONG_FOLDS = {
    "'": (0x2018, 0x2019, 0x201A, 0x201B, 0x2032),
    '"': (0x201C, 0x201D, 0x201E, 0x2033),
    "-": (0x2010, 0x2011, 0x2012, 0x2013, 0x2014, 0x2015, 0x2212),
}
#: Texts that stand for true.
TRUE_WORDS = ["1", "t", "true", "y", "yes"]
#: Words that say what kind of label it is, and words that join others.
DESCRIPTORS = (
    "algorithm approach approaches condition conditions concept concepts criteria criterion definition definitions equation equations example examples "
    "formula formulas framework frameworks gloss method methods metric metrics model models overview phase phases problem problems procedure procedures "
    "process processes score scores scope step steps summary term terms type types"
).split()
GLUE = "a an and are as at by for from in into is of on or the to with".split()
#: Words that a comparison of route texts leaves out.
ROUTE_STOP = "a an and are as at be by for from in into is it its of on or the to with without that this these those".split()
#: Cue words of each shape of evidence, in any case, as whole words.
SHAPES = {
    "context_phrase": "used to|used for|helps|allows|evaluates|measures|compares|select|classify|predict|estimate|under|when|if",
    "definition_phrase": "is|are|means|refers to|defined as|called|known as|denotes|represents|measures|computed as|calculated as",
    "formula_relation": "eq\\.|equation|formula|ratio|rate|score",
    "mechanism_description": "problem|issue|case|cases|happen|never observed|zero|undefined|fails|failure",
    "process_phrase": "step|stage|phase|process|procedure|first|next|then|finally|learn|train|estimate|fit|classify|predict",
}
FORMULA_MARKS = "[$\\\\{}_^=<>≤≥∑Σ]"
#: How surfaces of several kinds begin, and what tells where one comes from.
DISCOURSE = ["as previously mentioned", "because ", "consider ", "for example", "for the following", "in figure ", "in the following", "note that", "on the other hand", "suppose ", "thus ", "these ", "this "]
EXAMPLES = ["exercise", "example", "e.g.,"]
PROCEDURES = ["add ", "apply ", "assign ", "calculate ", "choose ", "classify ", "comment on ", "compute ", "merge ", "predict ", "repeat ", "select ", "start ", "use "]
PROVENANCE = ["according to", "compared", "described in", "introduced by", "named by", "studied", "suggests that", "was named"]
DEFINITION_VERBS = ["are", "constructs", "defined as", "denotes", "describes", "is", "means", "measures", "operates", "predicts", "refers to", "uses"]
FRAGMENTS = "and|or|but|because|thus|therefore"


def strong_form(s: Column) -> Column:
    """Compatibility forms, typographic quotes and dashes folded, white space to one blank, case folded."""
    folds = {point: to for to, points in STRONG_FOLDS.items() for point in points}

    def fold(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else " ".join(unicodedata.normalize("NFKC", x).translate(folds).split()).casefold() for x in column.to_pylist()], pa.string())

    fold.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(fold, StringType())(s)


def truthy(s: Column) -> Column:
    """Whether a text stands for true; null doesn't."""
    return F.coalesce(F.lower(F.trim(s.cast("string"))).isin(TRUE_WORDS), F.lit(False))


def truthy_number(n: Column) -> Column:
    """Numbers stand for true unless they are 0; null doesn't."""
    return F.coalesce(n != 0, F.lit(False))


def word_tokens(s: Column, shortest: int) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(s), F.lit("([a-z0-9_']+)"), 1), lambda t: F.length(t) >= shortest)


def close_tokens(a: Column, b: Column) -> Column:
    """Equal, or one is the other with its last letter doubled, from six letters on."""
    doubled = lambda x, y: (F.length(x) >= 6) & (y == F.concat(x, F.right(x, F.lit(1))))
    return (a == b) | doubled(a, b) | doubled(b, a)


def close_hits(wanted: Column, tokens: Column) -> Column:
    """How many distinct wanted tokens are close to some token."""
    return F.size(F.filter(F.array_distinct(wanted), lambda w: F.exists(tokens, lambda t: close_tokens(w, t))))


def close_sequence(wanted: Column, tokens: Column) -> Column:
    """Whether the wanted tokens stand side by side somewhere, each close to its own."""
    starts = F.when(F.size(tokens) >= F.size(wanted), F.sequence(F.lit(0), F.size(tokens) - F.size(wanted))).otherwise(F.array().cast("array<int>"))
    at = lambda i: F.forall(F.transform(wanted, lambda w, j: close_tokens(w, F.get(tokens, i + j))), lambda ok: ok)
    return (F.size(wanted) > 0) & F.exists(starts, at)


def whole_words(s: Column, words: str) -> Column:
    """Whether one of ``a|b|c`` occurs as a whole word, by Unicode's letters and digits."""
    return s.rlike(rf"(^|[^\p{{L}}\p{{N}}_])({words})($|[^\p{{L}}\p{{N}}_])")


def alternation(phrases: Column) -> Column:
    """A pattern that finds any of the phrases as whole words, longest first, blanks and hyphens alike."""
    ordered = F.array_sort(F.transform(F.array_distinct(phrases), lambda p: F.struct((-F.length(p)).alias("n"), p.alias("p"))))
    quoted = F.transform(ordered, lambda x: F.regexp_replace(F.regexp_replace(x["p"], r"([\\.^$|?*+()\[\]{}])", r"\\$1"), " ", r"[-\\s]+"))
    return F.concat(F.lit(r"(^|[^\p{L}\p{N}_])("), F.array_join(quoted, "|"), F.lit(r")($|[^\p{L}\p{N}_])"))


def shapes(s: Column) -> Column:
    """The kinds of evidence that a text's cues point to, in alphabetical order."""
    low = F.lower(s)
    found = {k: whole_words(low, v) for k, v in SHAPES.items()}
    found["formula_relation"] = found["formula_relation"] | s.rlike(FORMULA_MARKS)
    names = F.array_compact(F.array(*(F.when(c, k) for k, c in sorted(found.items()))))
    return F.when(F.size(names) > 0, names).otherwise(F.array(F.lit("context_phrase")))


def label_terms(s: Column) -> Column:
    """heads and descriptors of a label; a label of descriptors alone keeps its first word as head."""
    tokens = F.filter(F.regexp_extract_all(F.lower(s), F.lit("([a-z0-9]+)"), 1), lambda t: ~t.isin(GLUE))
    heads, descriptors = F.filter(tokens, lambda t: ~t.isin(DESCRIPTORS)), F.filter(tokens, lambda t: t.isin(DESCRIPTORS))
    heads = F.when(F.size(heads) > 0, F.array_distinct(heads)).otherwise(F.slice(tokens, 1, 1))
    return F.struct(heads.alias("heads"), F.array_distinct(descriptors).alias("descriptors"))


def surface_risks(s: Column) -> Column:
    """Names of what makes a collapsed text a poor surface for a definition, in a fixed order."""
    low = F.lower(s)
    starts = lambda words: F.exists(F.array(*(F.lit(w) for w in words)), lambda w: F.startswith(low, w))
    letters, marks = F.length(F.regexp_replace(s, "[^A-Za-z]", "")), F.length(F.regexp_replace(s, r"[^=∑∏±×÷<>/\\^_{}\[\]]", ""))
    words = F.size(F.regexp_extract_all(s, F.lit("([A-Za-z0-9]+)"), 1))
    verbs = F.exists(F.array(*(F.lit(f" {v} ") for v in DEFINITION_VERBS)), lambda v: F.contains(F.concat(F.lit(" "), low, F.lit(" ")), v))
    sentence = (words >= 6) & (verbs | s.rlike(r"[.!?]$"))
    names = F.array_compact(
        F.array(
            F.when(starts(DISCOURSE), "discourse_led_surface"),
            F.when(starts(EXAMPLES), "example_or_exercise_led_surface"),
            F.when(starts(PROCEDURES), "procedure_led_surface"),
            F.when(low.rlike(r"^definition\s+[0-9]") | whole_words(low, "|".join(PROVENANCE)), "history_or_provenance_surface"),
            F.when((letters == 0) | ((marks >= 4) & (letters < 18)), "formula_led_surface"),
            F.when(low.rlike(rf"^({FRAGMENTS})($|[^\p{{L}}\p{{N}}_])") | (~sentence & (words < 8)), "fragmentary_surface"),
        )
    )
    return F.when(F.length(s) == 0, F.array(F.lit("missing_surface"))).otherwise(names)


def route_jaccard(a: Column, b: Column) -> Column:
    """Shared of all tokens of two or more letters that aren't stop words; 0 if either has none."""
    tokens = lambda x: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(x), F.lit("([a-z0-9]+)"), 1), lambda t: (F.length(t) >= 2) & ~t.isin(ROUTE_STOP)))
    x, y = tokens(a), tokens(b)
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))


def route_match(a: Column, b: Column, least: float = 0.55) -> Column:
    """One collapsed text holds the other, or their tokens are alike enough."""
    norm = lambda x: F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))
    x, y = norm(a), norm(b)
    held = (F.length(x) > 0) & (F.length(y) > 0) & (F.contains(x, y) | F.contains(y, x))
    return held | (route_jaccard(a, b) >= least)
