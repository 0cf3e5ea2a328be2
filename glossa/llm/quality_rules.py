"""Quality rules: a threshold table compiled into one Spark projection.

Every metric is a built-in expression over the whole text; there are no user functions
and no shuffle. Words are runs of characters other than U+0020 and U+0009 to U+000D.

Defined cases: a null text has no words and fails the rules; an empty text likewise;
repeated rows get the same verdict each; other columns of the input are passed through
by :func:`apply_rules` only for kept rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = r"[\\x20\\x09-\\x0D]"
NO_SPACE = r"[^\\x20\\x09-\\x0D]"

# Frequent function words of four languages.
STOP_WORDS = (
    "the of and to in a is that it for was on are as with be by this at from an not have or has were which "
    "de la le les et des en un une du que dans est pour pas sur qui avec au il elle nous vous sont "
    "der die das und ist von zu den mit ein eine nicht auf im dem des sich auch als es "
    "el los las y una por con para se del no su al lo como más pero sus"
).split()


@dataclass(frozen=True)
class Rule:
    """A row passes if ``low <= metric <= high`` (a missing bound is open)."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: The threshold table. Metrics are SQL over the columns of :func:`measures`.
RULES = (
    Rule("words", "n_words", low=10),
    Rule("word_length", "word_chars / greatest(n_words, 1)", low=2, high=14),
    Rule("symbols", "n_symbols / greatest(n_words, 1)", high=0.25),
    Rule("repeated_words", "n_repeat_words / greatest(n_words, 1)", high=0.2),
    Rule("repeated_lines", "n_dup_lines / greatest(n_lines, 1)", high=0.4),
    Rule("stop_words", "n_stop_words", low=1),
    Rule("capitals", "n_capital_words / greatest(n_words, 1)", high=0.35),
)


def measures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the metrics of each row."""
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    d = d.withColumn("_trim", F.expr(r"trim(BOTH ' \t\n\u000b\f\r' FROM _t)".replace(r"\f", r"\u000c")))
    d = d.withColumn("_w", F.expr(f"if(_trim = '', cast(array() as array<string>), split(_trim, '{SPACE}+'))"))
    d = d.withColumn("_l", F.expr(f"filter(split(_t, '\\n'), x -> x rlike '{NO_SPACE}')"))
    grams = "transform(sequence(0, size(_w) - 5), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2], _w[i + 3], _w[i + 4]))"
    d = d.select(
        "doc_id",
        F.expr("cast(size(_w) as bigint)").alias("n_words"),
        F.expr("cast(char_length(array_join(_w, '')) as bigint)").alias("word_chars"),
        F.expr("cast(char_length(_t) - char_length(translate(_t, '#*$%&|<>', '')) as bigint)").alias("n_symbols"),
        F.expr("cast(size(_l) as bigint)").alias("n_lines"),
        F.expr("cast(size(_l) - size(array_distinct(_l)) as bigint)").alias("n_dup_lines"),
        F.expr(f"cast(size(array_intersect(_w, array({stop}))) as bigint)").alias("n_stop_words"),
        F.expr("cast(size(filter(_w, x -> x = upper(x) and x <> lower(x))) as bigint)").alias("n_capital_words"),
        F.expr(f"if(size(_w) < 6, cast(array() as array<bigint>), {grams})").alias("_g"),
    )
    # Windows with their places, sorted by hash: equal windows are neighbours. Only texts
    # with a repeated window take this step.
    d = d.withColumn("_s", F.expr("if(size(array_distinct(_g)) < size(_g), sort_array(transform(_g, (g, i) -> named_struct('g', g, 'i', i))), cast(array() as array<struct<g: bigint, i: int>>))"))
    d = d.withColumn("_p", F.expr("sort_array(filter(transform(_s, (e, j) -> if((j > 0 and _s[j - 1].g = e.g) or (j < size(_s) - 1 and _s[j + 1].g = e.g), e.i, -1)), p -> p >= 0))"))
    d = d.withColumn("n_repeat_words", F.expr("aggregate(zip_with(_p, if(size(_p) < 2, cast(array() as array<int>), slice(_p, 2, size(_p) - 1)), (a, b) -> least(5, coalesce(b - a, 5))), 0L, (s, x) -> s + x)"))
    return d.drop("_g", "_s", "_p")


def compile_rules(rules=RULES) -> dict:
    """One boolean expression per rule: true where the row breaks it."""
    out = {}
    for r in rules:
        bounds = [f"({r.metric}) < {r.low}"] * (r.low is not None) + [f"({r.metric}) > {r.high}"] * (r.high is not None)
        out[r.name] = F.expr(" or ".join(bounds))
    return out


def judge(docs: DataFrame, rules=RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Metrics, ``base_failed``, the names of the broken rules and ``kept``."""
    m = measures(docs, doc_id, text)
    broken = F.concat_ws(",", *[F.when(c, F.lit(n)) for n, c in compile_rules(rules).items()])
    m = m.withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")).withColumn("broken", broken)
    return m.withColumn("kept", ~F.col("base_failed") & (F.col("broken") == ""))


def apply_rules(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns."""
    names = docs.columns
    slim = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("text"))
    return judge(slim, rules, "_row", "text").where("kept").select(*[F.col("doc_id").getField(c).alias(c) for c in names])
