"""Lexical search, near-duplicate vectors and the three-way merge against brute force."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.llm import merging, tiles, treaps
from tests.llm.conftest import words

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def cut(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def best(docs, items, k):
    """Every item's best documents by scoring all of them."""
    found = [(i, Counter(cut(t))) for i, t in docs]
    found = [(i, c) for i, c in found if c]
    total, length = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in found:
            m = 75 + 25 * sum(c.values()) * total // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t in cut(text) if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard,leaf,width", [(1 << 21, 64, 1 << 20), (50, 2, 64)])
def test_search_against_brute_force(spark, odd, monkeypatch, shard, leaf, width):
    """Skewed terms, equal documents, ties at the edge, small shards and ranges."""
    monkeypatch.setattr(treaps, "SHARD", shard)
    monkeypatch.setattr(treaps, "LEAF", leaf)
    monkeypatch.setattr(treaps, "WIDTH", width)
    draw = random.Random(11)
    some = [" ".join(f"W{int(draw.paretovariate(0.6)) % 50}" for _ in range(draw.randrange(1, 40))) for _ in range(150)]
    docs = [(i, t) for i, t in enumerate(some)] + [(1000 + i, some[3]) for i in range(60)] + [(7, "w1 w2"), (None, "w1 w2"), (None, some[3])]
    docs += [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    items = [(i, draw.choice(some)) for i in range(12)] + [(50, None), (51, ""), (52, "unknown"), (53, "w1 W1 w2 é 日本語"), (53, "w3"), (None, "w1")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    got = [sorted(map(tuple, treaps.ranked(d, q, 5, block).collect()), key=repr) for block in (1 << 22, 300)]
    assert got[0] == got[1] == best(docs, items, 5)


def test_treaps_are_treaps():
    """In order by document, from the root down not rising, all postings reached, not deep."""
    draw = np.random.default_rng(1)
    for impact in (draw.integers(1, 10**9, 3000), np.arange(1, 3001) * 1000, np.full(3000, 77)):
        doc = np.arange(3000)
        t = treaps.Treaps(np.repeat([0, 2], [1000, 2000]), doc, impact, 3, 3000)
        seen, deepest = [], 0
        for root in (t.root[0], t.root[2]):
            stack, node, order = [], int(root), []
            while stack or node >= 0:
                while node >= 0:
                    stack.append(node)
                    deepest = max(deepest, len(stack))
                    for child in (int(t.left[node]), int(t.right[node])):
                        assert child < 0 or t.bound[child] <= t.bound[node]
                    node = int(t.left[node])
                node = stack.pop()
                order.append(node)
                node = int(t.right[node])
            assert order == sorted(order)
            seen += order
        assert t.root[1] == -1 and seen == list(range(3000)) and deepest < 250
        assert (t.bound >= impact).all() and (t.bound <= impact * 1.07 + 1).all()


def test_search_prunes(monkeypatch):
    """Of many documents only some ranges are scored where a few stand out."""
    scored = []
    real = treaps.Treaps.scores
    monkeypatch.setattr(treaps.Treaps, "scores", lambda self, q, low, high, queries: (scored.append(int((high - low).sum())), real(self, q, low, high, queries))[1])
    draw = np.random.default_rng(2)
    impact = draw.integers(1, 1000, 40000)
    impact[draw.choice(40000, 30, replace=False)] += 10**6
    queries = treaps.Queries([[(0, 1)]], 20)
    treaps.search(treaps.Treaps(np.zeros(40000, np.int64), np.arange(40000), impact, 1, 40000), np.arange(40000), queries)
    want = sorted(((-s, i) for i, s in enumerate(impact.tolist())))[:20]
    assert list(zip((-queries.best[1]).tolist(), queries.best[2].tolist(), strict=True)) == want
    assert sum(scored) < 8000


def test_search_empty(spark, odd, none):
    items = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert treaps.ranked(none, items).count() == 0
    assert treaps.ranked(odd, items.limit(0)).count() == 0


# ---------------------------------------------------------------- vectors


def linked(rows):
    """(id, links, component, kept) of every row by all pairs in double precision."""
    good = {}
    for r, (_, v) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[r] = np.array(v, float) / np.linalg.norm(np.array(v, float))
    near = {r: {s for s in good if s != r and len(good[s]) == len(good[r]) and good[r] @ good[s] >= 0.9} for r in good}
    out = []
    for r, (i, _) in enumerate(rows):
        seen, todo = {r}, [r]
        while todo:
            for s in near.get(todo.pop(), ()):
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        ids = [rows[s][0] for s in seen if rows[s][0] is not None]
        least = min(ids) if ids else None
        out.append((i, len(near.get(r, ())), least, least == i))
    return Counter(out)


@pytest.mark.parametrize("tile", [4096, 7])
def test_vectors_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(tiles, "TILE", tile)
    draw = np.random.default_rng(3)
    base = draw.normal(size=(12, 16))
    rows = [(i, (base[i % 12] + draw.normal(size=16) * (0.05 + 0.4 * (i % 5 == 0))).tolist()) for i in range(120)]
    chain = [(math.cos(a), math.sin(a)) for a in np.arange(0, 3, 0.4)]
    rows += [(200 + i, list(c)) for i, c in enumerate(chain)] + [(300, [0.9, math.sqrt(1 - 0.81) - 1e-4]), (301, [1.0, 0.0])]
    rows += [(400 + i, rows[5][1]) for i in range(40)] + [(3, rows[7][1]), (None, rows[7][1]), (None, [9.0] * 3)]
    rows += [(500, None), (501, []), (502, [0.0] * 16), (503, [1.0, None]), (504, [float("nan")] * 16), (505, [float("inf")] * 16), (506, [-0.0] * 15 + [2.0]), (507, [0.0] * 15 + [2.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("same", F.lit("x"))
    got = Counter(tuple(r) for r in tiles.near_vectors(d).collect())
    assert got == linked(rows)
    assert tiles.near_vectors(d.limit(0)).count() == 0


def test_bounds_hold():
    """No pair at the threshold is closed, whatever the scale and width; far ones are."""
    draw = np.random.default_rng(4)
    for width in (1, 3, 64, 2100):
        x = draw.normal(size=(60, width)) ** 3
        y = np.vstack([x[:30] + draw.normal(size=(30, width)) * 0.2 * np.abs(x[:30]).mean(), draw.normal(size=(30, width))])
        x, y = tiles.unit(x), tiles.unit(y)
        cosine = x @ y.T
        for threshold in (0.9, 0.5, float(np.sort(cosine.ravel())[-20])):
            open_ = tiles.possible(tiles.quantise(x), tiles.quantise(y), threshold)
            assert open_[cosine >= threshold].all()
            assert not open_[cosine < threshold - 0.1].any() or width > 64
        big = tiles.unit(x * 1e200)
        assert np.allclose(big, x)


# ---------------------------------------------------------------- merge


def code(branch, doc, name):
    return zlib.crc32(f"{branch}:{'' if doc is None else doc}:{name}".encode()) % 7


def merged(rows):
    """The merge by plain dictionaries."""
    base = {tuple(x or "" if k else x for k, x in enumerate(r)) for r in rows}
    out, added = [], {}
    for doc, text, lang, source in base:
        lines = text.split("\n")
        sides = []
        for b in "LR":
            row = code(b, doc, "row")
            if row in (3, 4):
                key = None if doc is None else -1 - doc
                new = json.dumps({"text": "!?"[row - 3], "lang": lang, "source": source}, ensure_ascii=False, separators=(",", ":"))
                side = added.setdefault(key, {})
                side[b] = max(side.get(b, ""), new)
            cells = {}
            for name, value in (("lang", lang), ("source", source)):
                c = code(b, doc, name)
                edit = {0: "", 1: value + "!", 2: value + "?"}.get(c, value)
                if edit != value:
                    cells[name] = edit
            for n, line in enumerate(lines):
                c = code(b, doc, str(n))
                if c < 3:
                    cells["line", n] = (None, line + "!", line + "?")[c]
                elif c < 5:
                    cells["gap", n] = "!?"[c - 3]
            sides.append(None if row == 0 else cells)
        left, right = sides
        n = Counter()
        if left is None or right is None:
            fight = bool(left or right)
            n["d" if fight else "c"] = 1
            state = right if fight else None
        else:
            state = {**left, **right}
            for path in state:
                if path in left and path in right and left[path] != right[path]:
                    n["i" if path[0] == "gap" else "d" if None in (left[path], right[path]) else "e"] += 1
                else:
                    n["c"] += 1
        if state is None:
            out.append((doc, None, None, None, n["c"], n["e"], n["d"], n["i"]))
            continue
        whole = []
        for k, line in enumerate(lines):
            value = state.get(("line", k), line)
            whole += [x for x in (value, state.get(("gap", k))) if x is not None]
        out.append((doc, state.get("lang", lang), state.get("source", source), "\n".join(whole), n["c"], n["e"], n["d"], n["i"]))
    for doc, side in added.items():
        new = json.loads(side.get("R") or side["L"])
        fight = len(side) == 2 and side["L"] != side["R"]
        out.append((doc, new["lang"], new["source"], new["text"], int(not fight), 0, 0, int(fight)))
    return Counter(out)


def test_merge_against_brute_force(spark, odd):
    draw = random.Random(13)
    rows = [(i, "\n".join(draw.choice(["", "x", words(draw, 5), "é\t\"q\""]) for _ in range(draw.randrange(1, 12))), draw.choice(["en", None, ""]), draw.choice(["a", 'b"\\', None])) for i in range(-20, 300)]
    rows += [rows[5]] * 30 + [(rows[9][0], "another text", "en", "z"), (None, "a\nb", "en", "a"), (None, None, None, None)]
    rows += [(r.doc_id, r.text, r.lang, r.source) for r in odd.collect()]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"kind": F.lit(1), "copy": F.lit("x"), "value": F.lit(None).cast("string")})
    got = merging.merge(merging.branches(d.repartition(5))).drop("present")
    assert Counter(tuple(r) for r in got.select("doc_id", "lang", "source", "text", "n_clean", "n_edit_edit", "n_edit_delete", "n_insert_insert").collect()) == merged(rows)
    assert merging.merge(merging.branches(d.limit(0))).count() == 0


def test_merge_of_given_cells(spark):
    """The general interface: branches that say what they changed."""
    rows = [(1, 0, k, n, v, False, x) for k, n, v, x in [(merging.ROW, 0, 0, ""), (merging.COLUMN, 0, 0, "en"), (merging.LINE, 0, 0, "a"), (merging.LINE, 1, 0, "b"), (merging.COLUMN, 0, 1, "en"), (merging.LINE, 0, 1, "A"), (merging.LINE, 1, 1, "B"), (merging.GAP, 1, 2, "c")]]
    rows += [(1, 0, merging.LINE, 1, 2, True, None)]
    r = merging.merge(spark.createDataFrame(rows, "doc_id long, copy long, kind int, n int, version int, gone boolean, value string"), ("lang",)).head()
    assert (r.doc_id, r.lang, r.text, r.n_clean, r.n_edit_edit, r.n_edit_delete, r.n_insert_insert) == (1, "en", "A\nc", 2, 0, 1, 0)


def test_digest_of_query(spark, tmp_path):
    from glossa.llm.queries import op13_merge

    d = spark.createDataFrame([(4, "one\ntwo", "en", "a")], "doc_id long, text string, lang string, source string")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    for r in op13_merge(spark, str(tmp_path)).collect():
        want = next(x for x in merged([(4, "one\ntwo", "en", "a")]) if x[0] == r.doc_id)
        assert r.text_sha256 == (None if want[3] is None else hashlib.sha256(want[3].encode()).hexdigest())
