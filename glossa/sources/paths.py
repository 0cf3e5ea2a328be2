"""Input and output paths: folders, splits, corpora, pairs. Listings go through the path's
own file system, so any store that Spark reads will do."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

# Corpora of the vocabulary report, with parts of their paths and the splits
# that count.
CORPORA = {
    "CellLink": (("celllink",), ("train", "validation", "valid", "dev")),
    "BioID": (("bioid", "bio-id"), ("train", "test")),
    "CRAFT": (("craft",), ("train", "test")),
    "AnatEM": (("anatem", "anat-em"), ("train", "test")),
    "JNLPBA": (("jnlpba", "jnlp-ba"), ("train", "test")),
}


def _open(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def keep(d: DataFrame) -> DataFrame:
    """The rows, written once to the folder that all executors share: what several steps read is
    computed once. ``drop`` deletes them."""
    spark = d.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/glossa-kept"
    path = f"{folder.rstrip('/')}/kept-{uuid.uuid4().hex}"
    d.write.parquet(path)
    out = spark.read.schema(d.schema).parquet(path)
    out._kept = path
    return out


def drop(*kept: DataFrame) -> None:
    """Delete kept rows that nothing reads any more."""
    for d in kept:
        fs, p = _open(d.sparkSession, d._kept)
        fs.delete(p, True)


def kind(spark: SparkSession, path: str) -> str | None:
    """``file``, ``folder`` or None."""
    fs, p = _open(spark, path)
    if not fs.exists(p):
        return None
    return "folder" if fs.getFileStatus(p).isDirectory() else "file"


def listing(spark: SparkSession, folder: str, recursive: bool = False) -> list[tuple[str, str]]:
    """(path, kind) of what is in a folder, sorted by path."""
    fs, p = _open(spark, folder)
    out = []
    for s in fs.listStatus(p):
        path = s.getPath().toString()
        out.append((path, "folder" if s.isDirectory() else "file"))
        if recursive and s.isDirectory():
            out += listing(spark, path, True)
    return sorted(out)


def xml_files(spark: SparkSession, path: str) -> list[str]:
    """The file itself, or the .xml files right in a folder, sorted; none is an error."""
    found = kind(spark, path)
    if found is None:
        raise FileNotFoundError(path)
    if found == "file":
        if not path.lower().endswith(".xml"):
            raise ValueError(f"not an XML file: {path}")
        return [path]
    files = [p for p, k in listing(spark, path) if k == "file" and p.lower().endswith(".xml")]
    if not files:
        raise FileNotFoundError(f"no XML files in {path}")
    return files


def split_files(spark: SparkSession, paths: list[str], split: str | None = "train.xml", otherwise_all: bool = True) -> list[str]:
    """Files as they are; of a folder its ``split`` file, else those of its child folders,
    else (``otherwise_all``) every file below it, else an error."""
    out: list[str] = []
    for path in paths:
        found = kind(spark, path)
        if found is None:
            raise FileNotFoundError(path)
        if found == "file":
            out.append(path)
            continue
        below = listing(spark, path)
        direct = [p for p, k in below if k == "file" and split and p.rsplit("/", 1)[1] == split]
        inner = [f"{p}/{split}" for p, k in below if k == "folder" and split and kind(spark, f"{p}/{split}") == "file"]
        if direct or inner:
            out += direct or inner
        elif otherwise_all:
            out += [p for p, k in listing(spark, path, True) if k == "file"]
        else:
            raise FileNotFoundError(f"no {split} under {path}")
    return out


def squashed(path: str) -> str:
    """Letters and digits of a path, folded."""
    return re.sub("[^a-z0-9]+", "", path.casefold())


def discover(spark: SparkSession, root: str, corpora: dict = CORPORA, without: dict | None = None) -> dict[str, list[str]]:
    """Each corpus's XML files: by parts of their paths below ``root``, those of its splits,
    or all where none names a split. ``without`` rules out parts of paths by corpus."""
    without = {"CellLink": ("test",)} if without is None else without
    fs, p = _open(spark, root)
    top = fs.getFileStatus(p).getPath().toString()
    files = [x for x, k in listing(spark, root, True) if k == "file" and x.endswith(".xml")]
    if not files:
        raise FileNotFoundError(f"no XML files under {root}")
    has = lambda x, parts: any(squashed(a) in squashed(x[len(top) :]) for a in parts)
    out = {}
    for name, (aliases, splits) in corpora.items():
        own = [x for x in files if has(x, aliases)]
        chosen = [x for x in own if has(x, splits) and not has(x, without.get(name, ()))]
        out[name] = chosen or own
    return out


def overrides(spark: SparkSession, given: list[str]) -> dict[str, list[str]]:
    """``NAME=first,second`` to files by name; a missing file or part is an error."""
    out = {}
    for text in given:
        name, found, rest = text.partition("=")
        files = [x.strip() for x in rest.split(",") if x.strip()]
        if not found or not name.strip() or not files:
            raise ValueError(f"not NAME=file,file: {text!r}")
        missing = [x for x in files if kind(spark, x) != "file"]
        if missing:
            raise FileNotFoundError(f"missing files for {name}: {', '.join(missing)}")
        out[" ".join(name.split())] = files
    return out


def pairs(spark: SparkSession, inputs: list[str], outputs: list[str]) -> list[tuple[str, str]]:
    """(input, output) files: folder to folder by file name, or file to file."""
    out = []
    for a, b in zip(inputs, outputs, strict=True):
        kinds = kind(spark, a), kind(spark, b)
        if kinds == ("folder", "folder"):
            out += [(x, f"{b.rstrip('/')}/{x.rsplit('/', 1)[1]}") for x, k in listing(spark, a) if k == "file"]
        elif kinds[0] == "file" and kinds[1] != "folder":
            out.append((a, b))
        else:
            raise ValueError("input and output must both be folders, or both files")
    return out
