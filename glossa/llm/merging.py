"""Three-way merge of branches of a document table over uniform cells.

Every version of the table is a set of cells, a path and a value each. A path is (doc_id,
copy, kind, n): the row itself, its n-th column, its n-th line, the gap after its n-th line,
or a row that a branch added. A branch has cells only for what it changed; a cell that is
``gone`` marks what it dropped. The cells of all versions are united, grouped by path and
pivoted to base, left and right; each path is resolved alone, and rows are put together again
from their resolved cells.

Per path: a change of one branch, or an equal one of both, is clean; else the right branch's
state stands and the conflict is insert_insert (the base has no such cell), edit_delete (one
side dropped it) or edit_edit. A dropped row counts alone: it is clean if the other branch
drops it too or has no changed cell in it, else an edit_delete conflict.

Repeated rows meet by partial aggregation before the only shuffle of texts, so a row that is
repeated very often moves once a task. Paths and rows are grouped where they then lie; what
one task gets of a row is what was one value before. Added rows are cells of other ids and
meet by themselves, without any text.

Defined cases: null columns and texts are empty; an empty text is one empty line; a null id
is an id of its own (as text: empty), and its added row has a null id; rows that are equal
in all columns are one row, other rows of one id are rows of their own with an equal number
of edits by the same codes; of several different rows that a branch adds under one id the
greatest counts; an added row whose id the base has too is a row of its own. Further columns
are not merged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of paths and versions, as they sort.
ROW, COLUMN, LINE, GAP, ADDED = range(5)
BASE, LEFT, RIGHT = range(3)
#: The outcomes of a path.
CLEAN, EDIT_EDIT, EDIT_DELETE, INSERT_INSERT = "clean", "edit_edit", "edit_delete", "insert_insert"
#: What the example branches put behind a value or in as a new line, by code.
MARKS = ("!", "?")
CELL = "struct<kind: int, n: int, version: int, gone: boolean, value: string>"


def cell(kind: int, n, version: int, value=None) -> Column:
    """A cell of a row; without a value it is gone."""
    place = n if isinstance(n, Column) else F.lit(n)
    names = {"kind": F.lit(kind), "n": place.cast("int"), "version": F.lit(version), "gone": F.lit(value is None), "value": (F.lit(None) if value is None else value).cast("string")}
    return F.struct(*[v.alias(k) for k, v in names.items()])


def _code(branch: str, name: Column) -> Column:
    """What a branch does to a named part of a row."""
    key = F.concat(F.lit(f"{branch}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), name)
    return F.crc32(key.cast("binary")) % 7


def _edited(code: Column, value: Column) -> Column:
    """The value with the code's mark behind it; null where the code marks nothing."""
    return F.when(code == 1, F.concat(value, F.lit(MARKS[0]))).when(code == 2, F.concat(value, F.lit(MARKS[1])))


def branches(docs: DataFrame, names: tuple[str, str] = ("L", "R"), columns: tuple[str, ...] = ("lang", "source")) -> list[DataFrame]:
    """The cells of ``docs`` (doc_id, text and ``columns``) and of two branches whose edits
    follow from codes of their names: every row, column and line is kept, dropped, marked,
    or followed by something new. The first frame has the cells of the base's rows, the
    second one those of rows that a branch adds."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("text", *columns)])
    codes = {f"_{b}": _code(b, F.lit("row")) for b in names}
    cells = F.explode(F.array_compact(F.array(*[F.when(F.col(f"_{b}").isin(3, 4), cell(ADDED, 0, v, F.to_json(F.struct(F.when(F.col(f"_{b}") == 3, MARKS[0]).otherwise(MARKS[1]).alias("text"), *columns)))) for v, b in enumerate(names, LEFT)])))
    added = plain.withColumns(codes).select((-1 - F.col("doc_id")).alias("doc_id"), F.lit(0).cast("long").alias("copy"), cells.alias("x")).select("doc_id", "copy", "x.*")
    d = plain.withColumn("copy", F.xxhash64("text", *columns)).groupBy("doc_id", "copy").agg(*[F.first(c).alias(c) for c in ("text", *columns)]).withColumns(codes)
    parts = F.concat(F.array(F.lit(None).cast("string")), F.split("text", "\n"))
    d = d.select("doc_id", "copy", *codes, *columns, F.posexplode(parts).alias("_n", "_line"))
    n, line = F.col("_n") - 1, F.col("_line")
    head = [cell(ROW, 0, BASE, F.lit("")), *[cell(COLUMN, k, BASE, F.col(c)) for k, c in enumerate(columns)]]
    rest = [cell(LINE, n, BASE, line)]
    for version, b in enumerate(names, LEFT):
        row = F.col(f"_{b}")
        stays = row != 0
        head.append(F.when(~stays, cell(ROW, 0, version)))
        for k, c in enumerate(columns):
            code = _code(b, F.lit(c))
            value = F.when(code == 0, F.lit("")).otherwise(_edited(code, F.col(c)))
            head.append(F.when(stays & value.isNotNull(), cell(COLUMN, k, version, value)))
        code = _code(b, n.cast("string"))
        rest.append(F.when(stays & (code == 0), cell(LINE, n, version)).when(stays & code.isin(1, 2), cell(LINE, n, version, _edited(code, line))).when(stays & code.isin(3, 4), cell(GAP, n, version, F.when(code == 3, MARKS[0]).otherwise(MARKS[1]))))
    cells = F.explode(F.filter(F.when(F.col("_n") == 0, F.array(*head)).otherwise(F.array(*rest)), lambda x: x.isNotNull()).cast(f"array<{CELL}>"))
    return [d.select("doc_id", "copy", cells.alias("x")).select("doc_id", "copy", "x.*"), added]


def resolve(cells: DataFrame) -> DataFrame:
    """Cells of all versions to one row per path: its gone and value, the outcome (null where
    nothing changed), and the row's drops by each branch."""
    of = lambda v: F.max(F.when(F.col("version") == v, F.struct("gone", "value")))
    p = cells.groupBy("doc_id", "copy", "kind", "n").agg(of(BASE).alias("b"), of(LEFT).alias("l"), of(RIGHT).alias("r"))
    # What a branch writes over with an equal value is no change.
    p = p.withColumns({c: F.when(~F.col(c).eqNullSafe(F.col("b")), F.col(c)) for c in ("l", "r")})
    left, right = F.col("l").isNotNull(), F.col("r").isNotNull()
    conflict = F.when(F.col("b").isNull(), INSERT_INSERT).when(F.col("l.gone") | F.col("r.gone"), EDIT_DELETE).otherwise(EDIT_EDIT)
    outcome = F.when(left & right & (F.col("l") != F.col("r")), conflict).when(left | right, CLEAN)
    state = F.coalesce("r", "l", "b")
    return p.select("doc_id", "copy", "kind", "n", state["gone"].alias("gone"), state["value"].alias("value"), outcome.alias("outcome"), left.alias("by_left"), right.alias("by_right"))


def assemble(paths: DataFrame, columns: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Resolved paths to rows: doc_id, present, the columns and the text (null where the row
    is absent), and the number of its paths by outcome."""
    kind = F.col("kind")
    inside = kind.isin(COLUMN, LINE, GAP)
    here = lambda c: F.coalesce(F.max(F.when(kind == ROW, F.col(c))), F.lit(False))
    counts = {o: F.count(F.when(F.col("outcome") == o, 1)) for o in (CLEAN, EDIT_EDIT, EDIT_DELETE, INSERT_INSERT)}
    values = {f"_{k}": F.max(F.when((kind == COLUMN) & (F.col("n") == k), F.col("value"))) for k in range(len(columns))}
    lines = F.collect_list(F.when(kind.isin(LINE, GAP) & ~F.col("gone"), F.struct("n", "kind", "value")))  # of one row
    d = paths.groupBy("doc_id", "copy").agg(
        here("by_left").alias("_left"),
        here("by_right").alias("_right"),
        F.count(F.when(inside & F.col("outcome").isNotNull(), 1)).alias("_changed"),
        F.max(F.when(kind == ADDED, F.col("value"))).alias("_new"),
        lines.alias("_lines"),
        *[v.alias(k) for k, v in values.items()],
        *[v.alias(f"_n_{k}") for k, v in counts.items()],
    )
    new = F.from_json("_new", ", ".join(f"`{c}` string" for c in ("text", *columns)))
    added, dropped = F.col("_new").isNotNull(), F.col("_left") | F.col("_right")
    fight = dropped & ~(F.col("_left") & F.col("_right")) & (F.col("_changed") > 0)
    present = ~dropped | (fight & ~F.col("_right"))
    text = F.array_join(F.transform(F.sort_array("_lines"), lambda x: x["value"]), "\n")
    get = lambda c, v: F.when(added, new[c]).when(present, v).alias(c)
    own = {CLEAN: F.when(dropped, (~fight).cast("long")), EDIT_DELETE: F.when(dropped, fight.cast("long"))}
    number = lambda o: F.coalesce(own.get(o, F.when(dropped, F.lit(0))), F.col(f"_n_{o}")).cast("long").alias(f"n_{o}")
    return d.select("doc_id", present.alias("present"), *[get(c, F.col(f"_{k}")) for k, c in enumerate(columns)], get("text", text), *[number(o) for o in counts])


def merge(cells: DataFrame | list[DataFrame], columns: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """The merged rows of the cells of three versions; frames of a list share no path."""
    return reduce(DataFrame.unionByName, [assemble(resolve(c), columns) for c in (cells if isinstance(cells, list) else [cells])])
