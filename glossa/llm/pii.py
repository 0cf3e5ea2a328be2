"""Personal data: patterns propose spans, checksums confirm them, context adjusts scores.

Built-in expressions only. ``split`` by a pattern gives the gaps between the matches that
``regexp_extract_all`` gives, so running sums of both lengths are the places, in code
points. The patterns use possessive repetition and look at what stands before, which
finds the same spans as their plain forms and keeps time linear in long runs. Running
sums and maxima go by blocks of ``STEP`` items, texts are cut by blocks of ``CUT``
characters, so that a text with very many spans does not take time by their square.

Kinds: email, ip, card (Luhn), phone always stay; iban (mod-97), ssn and local phone
numbers are kept only at a score of ``MIN_SCORE`` or more. Context is what stands in the
``context`` characters before a span, back over one earlier span of its kind at most.

Defined cases: a null text counts as empty and has no spans (and stays null when
redacted); repeated rows get equal results; spans of different kinds may overlap; ties in
start go by kind; very long texts are processed whole; an empty table gives an empty
result; the table's own columns are carried in one struct, so any names pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_SCORE = 0.5
STEP, CUT = 128, 1024
_LOCAL = "[A-Za-z0-9._%+-]"

#: kind, pattern, cheap test that the pattern needs, base score, context words, always kept
KINDS = (
    ("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(_t, '@')", 0.9, "mail|contact|kontakt|correo|courriel", True),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"_t rlike '[0-9]\\.[0-9]'", 0.6, "ip|host|server|address|adresse", True),
    ("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])", "_t rlike '[0-9][ -]?[0-9]'", 0.6, "card|visa|credit|karte|carte|tarjeta|payment", True),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "contains(_t, '+')", 0.6, "phone|call|tel|mobile|fax|anruf", True),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])", "_t rlike '[0-9]{2}'", 0.3, "iban|account|bank|konto|compte|cuenta", False),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "_t rlike '[0-9]{2}'", 0.3, "ssn|social|security|sozial", False),
    ("localphone", r"(?<![0-9+.(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])", "_t rlike '[0-9]{2}'", 0.3, "phone|call|tel|mobile|fax|anruf", False),
)
BASE = ("email", "ip", "card", "phone")
ORDER = tuple(k for k, *_ in KINDS)
_SPAN = "array<struct<start: int, end: int, kind: int, text: string, score: double>>"


def _lit(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def luhn(digits: str) -> str:
    """SQL: whether a string of digits passes the Luhn test."""
    from_right = f"cast(substring({digits}, -i, 1) as int)"
    return f"aggregate(sequence(1, char_length({digits})), 0, (a, i) -> a + if(i % 2 = 1, {from_right}, 2 * {from_right} - if({from_right} > 4, 9, 0))) % 10 = 0"


def mod97(h: str) -> str:
    """SQL: whether an account number (with spaces) has remainder 1 by 97."""
    c = f"replace({h}, ' ', '')"
    turned = f"concat(substring({c}, 5), substring({c}, 1, 4))"
    code = "ascii(x)"
    return f"char_length({c}) between 15 and 34 and aggregate(filter(split({turned}, ''), x -> x <> ''), 0, (a, x) -> if({code} < 65, (a * 10 + {code} - 48) % 97, (a * 100 + {code} - 55) % 97)) = 1"


_DIGITS = "regexp_replace(h.text, '[^0-9]', '')"
VALID = {
    "email": "true",
    "ip": "forall(split(h.text, '\\\\.'), p -> coalesce(try_cast(p as int), 256) <= 255)",
    "card": luhn(_DIGITS),
    "phone": f"char_length({_DIGITS}) between 9 and 15",
    "iban": mod97("h.text"),
    "ssn": "not (h.text rlike '^(000|666|9)|-00-|-0000$')",
    "localphone": "true",
}
#: Score that a passed checksum adds.
CHECKED = {"card": 0.3, "iban": 0.6}


def _once(value: str, within: str, name: str = "o") -> str:
    """SQL: ``within``, where ``name`` stands for ``value``. A column that is used once would
    be moved into the lambda that uses it, and be computed for each item."""
    return f"transform(array({value}), {name} -> {within})[0]"


def _before(items: str, blocks: str, fold: str, value: str) -> str:
    """SQL: ``fold`` (of a and x) of the values of all items before the lambda's index i,
    by the same for whole blocks of STEP items."""
    return f"aggregate(slice({items}, i - i % {STEP} + 1, i % {STEP}), {blocks}[i div {STEP}], (a, y) -> {fold.format(f'y{value}')})"


def _blocks(items: str, fold: str, value: str) -> str:
    """SQL: for each block of STEP items, and the end, ``fold`` of all items before it."""
    own = f"transform(sequence(0, size({items}) div {STEP}), q -> aggregate(slice({items}, q * {STEP} + 1, {STEP}), 0, (a, y) -> {fold.format(f'y{value}')}))"
    return _once(own, f"transform(o, (z, q) -> aggregate(slice(o, 1, q), 0, (a, y) -> {fold.format('y')}))")


_SUM, _MAX = "a + {}", "greatest(a, {})"


def _find(docs: DataFrame, text: str, context: int) -> DataFrame:
    """_row (the whole row), _t (its text, null as empty) and _found (its spans)."""
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t"))
    for k, (_kind, pattern, need, *_rest) in enumerate(KINDS):
        d = d.withColumn(f"_h{k}", F.expr(f"if({need}, regexp_extract_all(_t, {_lit(pattern)}, 0), cast(array() as array<string>))"))
    for k, (_kind, pattern, *_rest) in enumerate(KINDS):
        pairs = f"zip_with(slice(split(_t, {_lit(pattern)}, -1), 1, size(_h{k})), _h{k}, (g, h) -> named_struct('g', g, 'h', h, 'n', char_length(g) + char_length(h)))"
        d = d.withColumn(f"_p{k}", F.expr(f"if(size(_h{k}) = 0, cast(array() as array<struct<g: string, h: string, n: int>>), {pairs})"))
    for k, (kind, _pattern, _need, score, words, always) in enumerate(KINDS):
        near = f"right(concat(if(i = 0, '', concat(right(_p{k}[i - 1].g, {context}), _p{k}[i - 1].h)), right(x.g, {context})), {context})"
        raw = _once(_blocks(f"_p{k}", _SUM, ".n"), f"transform(_p{k}, (x, i) -> named_struct('start', {_before(f'_p{k}', 'o', _SUM, '.n')} + char_length(x.g), 'text', x.h, 'near', {near}))")
        judged = f"""transform(filter({raw}, h -> {VALID[kind]}), h -> named_struct('start', h.start, 'end', h.start + char_length(h.text), 'kind', {k}, 'text', h.text,
            'score', round(least(1.0D, {score + CHECKED.get(kind, 0.0)}D + if(lower(h.near) rlike '({words})', 0.3D, 0.0D)), 3)))"""
        d = d.withColumn(f"_s{k}", F.expr(f"if(size(_p{k}) = 0, cast(array() as {_SPAN}), {judged if always else f'filter({judged}, h -> h.score >= {MIN_SCORE})'})"))
    every = ", ".join(f"_s{k}" for k in range(len(KINDS)))
    return d.select("_row", "_t", F.expr(f"array_sort(concat({every}), (a, b) -> if(a.start <> b.start, a.start - b.start, a.kind - b.kind))").alias("_found"))


def _own(columns: list[str]) -> list:
    return [F.col("_row").getField(c).alias(c) for c in columns]


def find_spans(docs: DataFrame, text: str = "text", out: str = "spans", context: int = 40) -> DataFrame:
    """``docs`` with the column ``out``: an array of (start, end, kind, text, score),
    kind as its place in ORDER, sorted by start, then kind; end is exclusive."""
    return _find(docs, text, context).select(*_own([c for c in docs.columns if c != out]), F.col("_found").alias(out))


def digest(items: str) -> str:
    """SQL: kind:start:end of an array of spans, comma-joined."""
    names = ", ".join(f"'{k}'" for k in ORDER)
    return f"array_join(transform({items}, s -> concat(array({names})[s.kind], ':', s.start, ':', s.end)), ',')"


def redact(docs: DataFrame, text: str = "text", context: int = 40) -> DataFrame:
    """``docs`` with each span, or run of overlapping spans, replaced by its kind in
    brackets; n_chars follows. A null text stays null."""
    names = ", ".join(f"'[{k.upper()}]'" for k in ORDER)
    d = _find(docs, text, context)
    cuts = f"transform(sequence(0, char_length(_t) div {CUT}), q -> substring(_t, q * {CUT} + 1, {CUT}))"
    part = f"substring(array_join(slice(c, x.at div {CUT} + 1, x.start div {CUT} - x.at div {CUT} + 1), ''), x.at % {CUT} + 1, x.start - x.at)"
    # A span opens a run if it starts where all before it have ended.
    runs = _once(_blocks("_found", _MAX, ".end"), f"filter(transform(_found, (x, i) -> named_struct('at', {_before('_found', 'o', _MAX, '.end')}, 'start', x.start, 'kind', x.kind)), x -> x.start >= x.at)")
    parts = _once(cuts, f"transform({runs}, x -> concat({part}, array({names})[x.kind]))", "c")
    last = "aggregate(_found, 0, (a, y) -> greatest(a, y.end))"
    clean = f"concat(array_join({parts}, ''), substring(_t, {last} + 1))"
    own = {c: F.col("_row").getField(c) for c in docs.columns}
    own[text] = F.when(F.size("_found") == 0, own[text]).otherwise(F.expr(clean))
    if "n_chars" in own and text != "n_chars":
        d = d.withColumn("_clean", own[text])
        own[text] = F.col("_clean")
        kind = docs.schema["n_chars"].dataType
        own["n_chars"] = F.when(F.size("_found") == 0, own["n_chars"]).otherwise(F.char_length("_clean").cast(kind))
    return d.select(*[c.alias(name) for name, c in own.items()])
