"""String functions as SQL expressions: each takes SQL for its arguments and gives SQL.

All are built-in expressions, so they stay in generated code and can be pushed into any
projection. White space means Unicode white space; letters and numbers are Unicode
categories. Case folding is ``lower``: it differs from full folding on a few hundred code
points (a documented deviation). Positions are code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hyphen-minus and six more dashes.
DASHES = "\\\\-\\u2010\\u2011\\u2012\\u2013\\u2014\\u2212"
_SPACE = r"'(?U)\\s+'"


def col(sql: str) -> Column:
    return F.expr(sql)


def squeeze(x: str) -> str:
    """White space runs to one blank, none at the ends."""
    return f"trim(regexp_replace({x}, {_SPACE}, ' '))"


def normalize(x: str) -> str:
    """Case-insensitive form with squeezed white space."""
    return squeeze(f"lower({x})")


def abbreviation_key(x: str) -> str:
    """Without dashes and white space; case is kept."""
    return f"regexp_replace({x}, '(?U)[{DASHES}\\\\s]+', '')"


def variant_keys(x: str) -> str:
    """The key, and the key with its final s taken away or, if it has none, added."""
    k = abbreviation_key(x)
    other = f"if(endswith({k}, 's') and char_length({k}) > 1, left({k}, char_length({k}) - 1), concat({k}, 's'))"
    return f"filter(array_distinct(array({k}, {other})), k -> k <> '')"


def threshold(x: str) -> str:
    """Similarity that a key of this length must reach."""
    n = f"char_length({abbreviation_key(x)})"
    return f"case when {n} <= 4 then 1.0D when {n} <= 7 then 0.95D else 0.9D end"


def abbreviation_like(x: str) -> str:
    """Has more than one character besides dashes and blanks, and looks like a short form."""
    n = f"char_length({abbreviation_key(x)})"
    raw = f"regexp_replace({x}, '(?U)^\\\\s+|\\\\s+$', '')"
    return f"coalesce({n} > 1 and ({raw} rlike '[\\\\p{{Lu}}\\\\p{{Nd}}+/-]' or ({n} <= 12 and not contains({raw}, ' '))), false)"


def words(x: str) -> str:
    """Distinct blank-separated words of the normalised form."""
    return f"array_distinct(filter(split({normalize(x)}, ' '), w -> w <> ''))"


def jaccard(a: str, b: str) -> str:
    """Jaccard of two word arrays; 0 if either is empty."""
    return f"if(size({a}) = 0 or size({b}) = 0, 0.0D, cast(size(array_intersect({a}, {b})) as double) / size(array_union({a}, {b})))"


def length_bound(a: str, b: str) -> str:
    """The largest matching-blocks ratio that two texts of these lengths can have."""
    return f"(2.0D * least(char_length({a}), char_length({b})) / greatest(char_length({a}) + char_length({b}), 1))"


def ratio_bound(a: str, b: str) -> str:
    """The largest matching-blocks ratio that two texts with these characters can have."""
    times = lambda x, c: f"(char_length({x}) - char_length(replace({x}, {c}, '')))"
    common = f"aggregate(array_distinct(filter(split({a}, ''), c -> c <> '')), 0, (s, c) -> s + least({times(a, 'c')}, {times(b, 'c')}))"
    return f"if(char_length({a}) + char_length({b}) = 0, 1.0D, 2.0D * {common} / (char_length({a}) + char_length({b})))"


def parenthetical(a: str, b: str) -> str:
    """Whether one side equals what stands in some parentheses of the other."""

    def inside(x: str, y: str) -> str:
        return f"exists(regexp_extract_all({x}, '\\\\(([^()]*)\\\\)', 1), p -> {normalize('p')} = {normalize(y)})"

    return f"({inside(a, b)} or {inside(b, a)})"


def tokens(x: str) -> str:
    """Runs of letters and numbers; every other visible character alone."""
    return f"regexp_extract_all({x}, '(?U)[\\\\p{{L}}\\\\p{{N}}]+|[^\\\\p{{L}}\\\\p{{N}}\\\\s]', 0)"


def singular(w: str) -> str:
    """One token without its plural ending. Most endings lose the s alone."""
    cut = lambda n: f"left({w}, char_length({w}) - {n})"
    return (
        f"case when not endswith({w}, 's') then {w} "
        f"when {w} rlike '(viruses|sses)$' then {cut(2)} "
        f"when {w} rlike '(?<![ae])ies$' then concat({cut(3)}, 'y') "
        f"when {w} rlike '[us]s$' then {w} else {cut(1)} end"
    )


def plural_normalize(x: str) -> str:
    """Tokens in singular, joined by blanks. Applying it twice can change the text again."""
    return f"array_join(transform({tokens(x)}, w -> {singular('w')}), ' ')"


# Words whose final s is not a plural.
NO_PLURAL = ("species", "series")


def relaxed(x: str) -> str:
    """Loose surface key of a text that is already compact (see ``udfs.nfkc``)."""
    t = normalize(x)
    t = f"translate({t}, '\\u2019\\u2018`\\u201c\\u201d', '\\'\\'\\'\"\"')"
    t = f"regexp_replace({t}, '[\\u2010\\u2011\\u2012\\u2013\\u2014\\u2212_-]+', ' ')"
    t = f"regexp_replace({t}, '(?U)^[\\\\s.,;:()\\\\[\\\\]{{}}]+|[\\\\s.,;:()\\\\[\\\\]{{}}]+$', '')"
    t = squeeze(f"regexp_replace({t}, '(?U)\\\\bcells\\\\b', 'cell')")
    parts = f"split({t}, ' ')"
    w = f"element_at({parts}, -1)"
    n = f"char_length({w})"
    known = ", ".join(f"'{k}'" for k in NO_PLURAL)
    last = (
        f"case when endswith({w}, 'ies') and {n} > 4 and {w} not in ({known}) then concat(left({w}, {n} - 3), 'y') "
        f"when {w} rlike '(sses|shes|ches|xes|zes)$' and {n} > 4 then left({w}, {n} - 2) "
        f"when endswith({w}, 's') and {n} > 3 and not {w} rlike '(ss|us|is)$' then left({w}, {n} - 1) else {w} end"
    )
    return f"array_join(concat(slice({parts}, 1, size({parts}) - 1), array({last})), ' ')"


def clean_identifier(x: str) -> str:
    return f"trim(replace(replace(trim({x}), '(skos:exact)', ''), '(skos:related)', ''))"


def real_id(x: str) -> str:
    """Not one of the marks for a missing id."""
    return f"lower(trim({x})) not in ('', '-', 'none')"


def split_identifiers(x: str) -> str:
    """The ids of a field, separated by commas or semicolons."""
    return f"filter(transform(split({clean_identifier(x)}, '[;,]'), p -> trim(p)), p -> {real_id('p')})"


def single_id(x: str, exact: bool) -> str:
    """Whether a field names one id (and, if ``exact``, not a related one)."""
    found = f"coalesce({x}, '') <> '' and not lower({x}) rlike 'none' and not {x} rlike '[;,]' and {real_id(clean_identifier(x))}"
    return f"({found}{f' and not contains(lower({x}), {chr(39)}(skos:related){chr(39)})' if exact else ''})"


def ontology_ids(x: str) -> str:
    """Every CL id in a text, as CL:digits. Digits or letters right before CL rule it out."""
    return f"transform(regexp_extract_all({x}, '(?i)(?<![A-Za-z0-9])CL\\\\s*[:_]\\\\s*(\\\\d+)', 1), d -> concat('CL:', d))"


def related_ids(x: str) -> str:
    """(relation, id) of every ``(skos:relation)CL:digits``; relation is empty where it is missing."""
    pattern = "'(?:\\\\(skos:([a-z]+)\\\\))?\\\\s*(CL:\\\\d+)'"
    return f"arrays_zip(regexp_extract_all({x}, {pattern}, 1), regexp_extract_all({x}, {pattern}, 2))"


def id_case(x: str) -> str:
    return f"regexp_replace(trim({x}), '(?i)^cl[_:]', 'CL:')"


def byte_offset(x: str, at: str) -> str:
    """UTF-8 bytes before a code point's place."""
    return f"octet_length(substring({x}, 1, {at}))"


def byte_offsets(x: str, step: int = 64) -> str:
    """UTF-8 bytes before each code point and at the end: sums by blocks of ``step``."""
    sizes = f"transform(filter(split({x}, ''), c -> c <> ''), c -> octet_length(c))"
    sums = f"transform(sequence(0, size(n) div {step}), q -> aggregate(slice(n, q * {step} + 1, {step}), 0, (a, v) -> a + v))"
    before = f"transform(array({sums}), o -> transform(o, (z, q) -> aggregate(slice(o, 1, q), 0, (a, v) -> a + v)))[0]"
    each = f"transform(array({before}), o -> transform(sequence(0, size(n)), i -> aggregate(slice(n, i - i % {step} + 1, i % {step}), o[i div {step}], (a, v) -> a + v)))[0]"
    return f"transform(array({sizes}), n -> {each})[0]"


def passage_key(doc_id: str, offset: str, infons: str) -> str:
    """The passage's own id, else its article's, else document and offset."""
    own = f"coalesce(nullif({infons}['passage_id'], ''), nullif({infons}['article-id_pmid'], ''))"
    return f"coalesce({own}, concat({doc_id}, ':', {offset}))"


def sourced_passage_key(prefix: str, doc_id: str, offset: str, infons: str) -> str:
    """The passage's own id, else document and offset, after the file's place in its folder."""
    own = f"coalesce(nullif({infons}['passage_id'], ''), concat(coalesce(nullif({doc_id}, ''), 'unknown_document'), ':', {offset}))"
    return f"if(coalesce({prefix}, '') = '', {own}, concat({prefix}, '::', {own}))"


def document_key(doc_id: str, article_id: str, passage_id: str) -> str:
    """The document's id, else its article's, else the passage's."""
    return f"coalesce(nullif({doc_id}, ''), nullif({article_id}, ''), nullif({passage_id}, ''))"


def annotatable(infons: str) -> str:
    """A missing mark passes, and so does every text but the empty one (which a reader may
    give as a key without a value)."""
    return f"(not map_contains_key({infons}, 'annotatable') or coalesce({infons}['annotatable'], '') <> '')"
