"""Near-duplicates, classifiers, scoring, packing: brute force and odd cases."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from glossa.llm import bagminhash, ctw, packing, rff_quality, toxicity, webp
from glossa.llm.batches import utf8
from tests.llm.conftest import words


def bag(text):
    w = (text or "").split()
    n = min(5, len(w))
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else Counter()


def brute_classes(rows):
    bags = [bag(t) for _, t in rows]
    head = list(range(len(rows)))

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for i, a in enumerate(bags):
        for j in range(i):
            both, either = sum((a & bags[j]).values()), sum((a | bags[j]).values())
            if (rows[i][1] or "") == (rows[j][1] or "") or (either and both * 10 >= 8 * either):
                head[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def test_near_duplicates(spark, odd, none):
    draw = random.Random(7)
    rows = []
    for g in range(12):
        base = words(draw, 120).split()
        for _ in range(draw.randrange(1, 7)):
            copy = list(base)
            for _ in range(draw.randrange(0, 7)):
                copy[draw.randrange(len(copy))] = f"new{draw.randrange(9999)}"
            rows.append((len(rows), " ".join(copy)))
        base = copy
    rows += [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    heads = brute_classes(rows)
    members = {}
    for h, (i, _) in zip(heads, rows, strict=True):
        members.setdefault(h, []).append(i)
    want = Counter((i, min((x for x in members[h] if x is not None), default=None), len(members[h])) for h, (i, _) in zip(heads, rows, strict=True))
    got = bagminhash.classes(d).collect()
    assert Counter((r.doc_id, r.class_id, r.class_rows) for r in got) == want
    assert sum(r.kept for r in got) == len(members)
    left = bagminhash.deduplicate(odd)
    assert left.columns == odd.columns
    assert bagminhash.classes(none).count() == 0


def test_near_duplicates_in_a_family_of_dissimilar_texts(spark, monkeypatch):
    """Hundreds of texts at 0.76 by shared boilerplate fill large buckets of several bands; the
    pairs just above 0.8 among them are to be found, also between two blocks of a bucket."""
    monkeypatch.setattr(bagminhash, "CELL", 100)
    draw = random.Random(11)
    shared, rows = [f"w{draw.randrange(400)}" for _ in range(130)], []
    for k in range(160):
        pair = [f"p{k}.{i}" for i in range(4)]
        for side in "ab":
            rows.append((len(rows), " ".join(shared + pair + [f"{side}{k}.{i}" for i in range(16)])))
    d = spark.createDataFrame(draw.sample(rows, len(rows)), "doc_id long, text string").repartition(3)
    heads = brute_classes(rows)
    want = Counter((i, min(j for j, h in enumerate(heads) if h == heads[i]), heads.count(heads[i])) for i, _ in rows)
    assert len(set(heads)) == 160
    assert Counter((r.doc_id, r.class_id, r.class_rows) for r in bagminhash.classes(d).collect()) == want


def test_signature_is_unbiased():
    a, b = "x y z " * 30 + words(random.Random(1), 200), "x y z " * 20 + words(random.Random(1), 150)
    rows, hashes = bagminhash.shingles(*utf8(pa.array([a, b, "", "one"])))
    s = bagminhash.signatures(rows, hashes, 4, 4000)
    x, y = bag(a), bag(b)
    true = sum((x & y).values()) / sum((x | y).values())
    assert abs((s[0] == s[1]).mean() - true) < 0.03
    assert np.isinf(s[2]).all() and np.isfinite(s[3]).all()


def test_overlap():
    a, b = np.array([1, 1, 2, 9], np.uint64), np.array([1, 2, 2, 9, 9], np.uint64)
    assert bagminhash.overlap(a, b) == 3 and bagminhash.overlap(a, a[:0]) == 0


def test_toxicity_learns(spark, odd, none, labels):
    draw = random.Random(3)
    bad = [i for i in range(300) if i % 3 == 0]
    docs = spark.createDataFrame([(i, words(draw, 40) + (" you vilething " if i in set(bad) else " ") + words(draw, 20)) for i in range(300)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i in set(bad))) for i in range(300)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, marks).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 300 and sum(r.predicted == (r.doc_id in set(bad)) for r in held) >= 0.95 * len(held)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    rest = toxicity.toxicity(odd, labels).collect()
    assert len(rest) == odd.count() and all(0 <= r.score <= 1 for r in rest)
    assert toxicity.toxicity(none, labels).count() == 0
    assert {r.score for r in toxicity.toxicity(odd, labels.limit(0)).collect()} == {0.5}


def test_quality_learns(spark, odd, none, labels):
    draw = random.Random(4)
    docs = spark.createDataFrame([(i, words(draw, 60) if i % 3 else "| ".join(["## X"] * draw.randrange(10, 60))) for i in range(400)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400)], "doc_id long, quality int")
    got = rff_quality.quality(docs, marks).collect()
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == (r.doc_id % 3 > 0) for r in held) >= 0.95 * len(held)
    rest = rff_quality.quality(odd, labels).collect()
    assert len(rest) == odd.count() and all(0 <= r.score <= 1 for r in rest)
    assert rff_quality.quality(none, labels).count() == 0


def test_isotonic():
    draw = np.random.default_rng(1)
    x = draw.integers(0, 30, 400).astype(float)
    y = (draw.random(400) < x / 30).astype(float)
    knots, levels = rff_quality.isotonic(x, y)
    assert (np.diff(levels) >= 0).all() and (np.diff(knots) >= 0).all()
    assert abs(np.interp(x, knots, levels).mean() - y.mean()) < 0.01


def brute_ctw(text, grams):
    """Depth-first context-tree weighting of bits, with dictionaries; returns log10."""
    counts = {}
    for key, n in grams.items():
        byte = key[-1]
        for depth in range(ctw.DEPTH + 1):
            context = key[ctw.DEPTH - depth : ctw.DEPTH]
            for i in range(8):
                node, bit = (1 << i) | byte >> (8 - i), byte >> (7 - i) & 1
                counts.setdefault((context, node), [0, 0])[bit] += n
    children = {}
    for context, node in counts:
        if context:
            children.setdefault((context[1:], node), []).append((context, node))
    kt = lambda c: math.lgamma(c[0] + 0.5) + math.lgamma(c[1] + 0.5) - math.lgamma(sum(c) + 1) - math.log(math.pi)
    mixed = {}

    def weigh(k):
        if k not in mixed:
            own = kt(counts[k])
            mixed[k] = own if len(k[0]) == ctw.DEPTH else np.logaddexp(own, sum(map(weigh, children.get(k, [])))) - math.log(2)
        return mixed[k]

    total = 0.0
    for at in range(ctw.DEPTH, len(text)):
        for i in range(8):
            byte = text[at]
            node, bit = (1 << i) | byte >> (8 - i), byte >> (7 - i) & 1
            p, left = 0.0, 1.0
            for depth in range(ctw.DEPTH + 1):
                k = (text[at - depth : at], node)
                c = counts.get(k, (0, 0))
                est = (c[bit] + 0.5) / (sum(c) + 1)
                if depth == ctw.DEPTH or k not in counts:
                    p += left * est
                    break
                stop = math.exp(kt(c) - weigh(k) - math.log(2))
                p += left * stop * est
                left *= 1 - stop
            total += math.log10(p)
    return total


def test_ctw_against_brute_force(spark, odd, none):
    texts = ["the cat sat", "The dog sat on the cat", "", "a b a b a b"]
    train = spark.createDataFrame([(t,) for t in texts], "text string")
    model = ctw.train(train)
    grams = Counter()
    seqs = [ctw.END * ctw.DEPTH + b" ".join(t.encode().lower().split()) + ctw.END for t in texts]
    for s in seqs:
        grams.update(s[i : i + ctw.DEPTH + 1] for i in range(len(s) - ctw.DEPTH))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in ctw.score(docs, model, common=2).collect()}
    for i, s in enumerate(seqs):
        assert abs(got[i].score - brute_ctw(s, grams)) < 1e-4
        assert got[i].n_bytes == len(s) - ctw.DEPTH and abs(got[i].bits_per_byte * got[i].n_bytes + got[i].score * math.log2(10)) < 1e-9
    new = "a cat satt é on"
    s = ctw.END * ctw.DEPTH + b" ".join(new.encode().split()) + ctw.END
    for few in (0, ctw.COMMON_GRAMS):
        (r,) = ctw.score(spark.createDataFrame([(9, new)], "doc_id long, text string"), model, common_grams=few).collect()
        assert abs(r.score - brute_ctw(s, grams)) < 1e-4
    several = {r.doc_id: r for r in ctw.score(docs, model, common_grams=20, common=0).collect()}
    assert all(abs(several[i].score - got[i].score) < 1e-5 and abs(several[i].base_score - got[i].base_score) < 1e-9 and several[i].n_known == got[i].n_known for i in several)
    counts = Counter(w for t in texts for w in t.lower().split()) + Counter({" ": 4})
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(texts):
        tokens = t.lower().split() + [" "]
        want = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        assert abs(got[i].base_score - want) < 1e-9 and (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(tokens), len(tokens), n)


def test_ctw_sums_to_one(spark):
    model = ctw.train(spark.createDataFrame([("some words here and more words there",)], "text string"))
    for context in (b"words", b" more", b"zzzzz", b"xxxxw"):
        k = [(int.from_bytes(context + bytes([b]), "big"),) for b in range(256)]
        got = ctw.values(model, spark.createDataFrame(k, "key long")).collect()
        assert len(got) == 256 and abs(sum(10**r.value for r in got) - 1) < 1e-5


def test_ctw_odd(odd, none):
    got = ctw.score_documents(odd).collect()
    assert len(got) == odd.count() and all(r.score < 0 for r in got)
    assert ctw.score_documents(none).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_best_fit(seed):
    draw = np.random.default_rng(seed)
    sizes = draw.integers(1, 60, 90)
    bins, offsets = packing.best_fit_decreasing(sizes, 64)
    for b in range(bins.max() + 1):
        at = np.flatnonzero(bins == b)
        order = at[np.argsort(offsets[at])]
        assert offsets[order].tolist() == [0, *np.cumsum(sizes[order])[:-1]] and sizes[at].sum() <= 64
    assert -(-int(sizes.sum()) // 64) <= packing.lower_bound(sizes, 64) <= bins.max() + 1


def test_bound_is_tight_where_the_sum_is_not():
    assert packing.lower_bound(np.array([40, 40, 40, 2]), 64) == 3
    assert packing.lower_bound(np.array([33] * 7), 64) == 7


def test_encoder_equals_tokenizers():
    e = packing.Encoder()
    draw = random.Random(8)
    bits = ["a", " ", "  ", "\n", "\t", "don't", "<|endoftext|>", "é", "😀", "12", ".", " ", "word"]
    for _ in range(300):
        t = "".join(draw.choice(bits) for _ in range(draw.randrange(0, 12)))
        assert e(t) == np.array(e.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def test_packing(spark, odd, none):
    got = packing.pack_documents(odd.select("doc_id", "text", "label"), capacity=64).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    for v in by.values():
        v.sort(key=lambda r: r.offset)
        assert [r.offset for r in v] == [0, *np.cumsum([r.length for r in v])[:-1]] and sum(r.length for r in v) <= 64
    e = packing.Encoder()
    want = Counter()
    for r in odd.select("doc_id", "text").collect():
        ids = e(r.text or "") + b"\0" * 4
        cuts = [0, *range(len(ids) // 4 % 64 or 64, len(ids) // 4 + 1, 64)]
        want.update((r.doc_id, i, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert packing.pack_documents(none.select("doc_id", "text")).count() == 0


def test_exchange_lowers_bins(spark):
    draw = random.Random(9)
    items = spark.createDataFrame([(i, 0, 0, draw.randrange(1, 64), i) for i in range(600)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    once = packing.pack(items, 64, part_rows=60, turns=1).select("sequence_id").distinct().count()
    more = packing.pack(items, 64, part_rows=60, turns=3)
    assert more.select("sequence_id").distinct().count() <= once and more.count() == 600


def test_media(odd, none):
    got = webp.media_columns(odd).collect()
    assert len(got) == odd.count() and all(r.payload_bytes % 576 == 0 and r.payload_bytes > 0 for r in got)
    assert webp.media_columns(none).count() == 0


def test_character_grams_against_brute_force():
    """Each n-gram of code points of the lower-cased text is one bucket, also at text edges."""
    texts = ["ÄbÇ日本x", "", None, "ab", "äbç日本X and more", "İstanbul ẞ"]
    data, offsets = toxicity.points(pa.array(texts))
    keep = np.arange((1 << toxicity.BITS) + 1, dtype=np.int64)
    rows, found = toxicity._hits(data, offsets, keep)
    got = {k: set(found[rows == k].tolist()) for k in range(len(texts))}

    def bucket(gram):
        h = len(gram) * 0x9E3779B1 & 0xFFFFFFFF
        for c in gram:
            h = (h * 0x01000193 & 0xFFFFFFFF) ^ ord(c)
        h ^= h >> 15
        return (h * 0x85EBCA6B & 0xFFFFFFFF) >> (32 - toxicity.BITS)

    for k, t in enumerate(texts):
        t = (t or "").lower()
        assert got[k] == {bucket(t[i : i + n]) for n in toxicity.ORDERS for i in range(len(t) - n + 1)}
    assert got[0] <= got[4]


def test_toxicity_against_brute_force(spark):
    """Log-count ratios scale the features and the weights are at the optimum."""
    draw = random.Random(6)
    rows = [(i, words(draw, 12, 40) + (" zut!" if i % 4 == 0 else "")) for i in range(160)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    m = toxicity.fit(docs, marks)
    fit = [(t, i % 4 == 0) for i, t in rows if zlib.crc32(str(i).encode()) % 5]
    data, offsets = toxicity.points(pa.array([t for t, _ in fit]))
    at, found = toxicity._hits(data, offsets, np.arange((1 << toxicity.BITS) + 1, dtype=np.int64))
    y = np.array([b for _, b in fit])
    grid = np.zeros((len(fit), 1 << toxicity.BITS), np.float32)
    grid[at, found] = 1
    pos, neg = grid[y].sum(axis=0), grid[~y].sum(axis=0)
    ratio = np.log((pos + 1) / (y.sum() + 2)) - np.log((neg + 1) / ((~y).sum() + 2))
    kept = np.flatnonzero(m["keep"][1:])
    assert set(kept) == set(np.flatnonzero(pos + neg >= 5))  # fewer than FEATURES
    x = grid[:, kept] * ratio[kept]
    w = m["weights"][m["keep"][kept + 1] - 1] / ratio[kept]
    z = x @ w + m["bias"]
    g = 1 / (1 + np.exp(-z)) - y
    assert np.abs(x.T @ g / len(y) + 1e-3 * w).max() < 0.02 and abs(g.mean()) < 0.02
    got = {r.doc_id: r.score for r in toxicity.score(docs, m).collect()}
    train = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5]
    assert np.allclose([got[i] for i in train], 1 / (1 + np.exp(-z)), atol=1e-5)


def test_quality_against_brute_force(spark):
    """Ridge by a direct solution, isotonic by its minimax formula, on held folds."""
    draw = random.Random(9)
    rows = [(i, words(draw, 30 + i % 50) if i % 3 else "| ".join(["## X"] * draw.randrange(2, 60))) for i in range(240)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 > 0 and i % 7 > 0)) for i, _ in rows], "doc_id long, quality int")
    m = rff_quality.fit(docs, marks)
    fit = [(t, float(i % 3 > 0 and i % 7 > 0)) for i, t in rows if zlib.crc32(str(i).encode()) % 5]
    x, y = np.array([rff_quality.statistics(t) for t, _ in fit]), np.array([b for _, b in fit])
    assert np.allclose(m["mean"], x.mean(axis=0))
    phi = rff_quality.features(x, m)
    penalty = np.sqrt(rff_quality.RIDGE * len(y)) * np.eye(phi.shape[1])
    penalty[-1, -1] = 0
    direct = np.linalg.lstsq(np.vstack([phi, penalty]), np.concatenate([y, np.zeros(phi.shape[1])]), rcond=None)[0]
    assert np.allclose(phi @ m["beta"], phi @ direct, atol=1e-4)
    fold, raw = rff_quality.fold_of(x), np.zeros(len(y))
    for k in (0, 1):
        o = fold != k
        raw[~o] = phi[~o] @ rff_quality.ridge(phi[o].T @ phi[o], phi[o].T @ y[o], int(o.sum()))
    order = np.argsort(raw, kind="stable")
    v = y[order]
    means = lambda a, b: v[a : b + 1].mean()
    want = [max(min(means(a, b) for b in range(k, len(v))) for a in range(k + 1)) for k in range(len(v))]
    got = np.interp(raw[order], m["knots"], m["levels"])
    assert np.abs(got - want).max() < 2e-3
    assert np.allclose(rff_quality.predict(x, m), np.clip(np.interp(phi @ m["beta"], m["knots"], m["levels"]), 0, 1))


def test_sample_is_bounded_by_rows(spark):
    """One labelled id on very many rows counts once, whatever the rows' order."""
    from glossa.llm.batches import labelled_sample

    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids] + [(ids[0], f"copy {k}") for k in range(5000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids] + [(ids[0], 0)], "doc_id long, quality int")
    got = [sorted(map(tuple, labelled_sample(d, labels, "quality", 10).collect())) for d in (docs, docs.orderBy(docs.text.desc()))]
    assert got[0] == got[1] and len(got[0]) == 10
    assert labelled_sample(docs, labels, "quality", 1000).count() == len(ids)
