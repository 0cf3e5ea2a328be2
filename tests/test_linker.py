"""The whole linker and the ratios of all pairs against brute force, over the driver's tables."""

import os
import re
from collections import defaultdict
from difflib import SequenceMatcher
from zlib import crc32

import duckdb
import numpy as np
import pytest

from glossa.plans.queries import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def part():
    return duckdb.sql(f"select p_partkey, p_name, p_brand, p_size from '{SF}/part.parquet' order by p_partkey").fetchall()


def test_ratios_of_all_pairs(spark, part):
    got = {(r.a, r.b): r.ratio for r in queries()["sequence_ratio_pairs"](spark, SF).collect()}
    names = sorted({p[1] for p in part})
    want = {(a, b) for a in names for b in names if a < b and set(a.split()) & set(b.split())}
    assert set(got) == want
    assert all(abs(got[a, b] - SequenceMatcher(None, a, b).ratio()) < 1e-9 for a, b in want)


def vector(s):
    v, t = np.zeros(128, np.float32), f"  {s} ".lower()
    for i in range(len(t) - 2):
        h = crc32(t[i : i + 3].encode())
        v[h % 128] += 1 if h >> 16 & 1 else -1
    n = np.linalg.norm(v)
    v = (v / n if n else v).astype(np.float32).astype(float)
    return v / (np.linalg.norm(v) or 1)


def singular(w):
    if not w.endswith("s"):
        return w
    if w.endswith("viruses"):
        return w[:-2]
    for end, but, cut, add in (("ies", ("eies", "aies"), 3, "y"), ("es", ("aes", "ees", "oes"), 2 if w.endswith("sses") else 1, "")):
        if w.endswith(end) and not w.endswith(but):
            return w[:-cut] + add
    return w if w.endswith(("us", "ss")) else w[:-1]


plural = lambda s: " ".join(singular(w) for w in re.findall(r"[^\W_]+|[^\w\s]|_", s))
key_of = lambda s: re.sub(r"[\s-]+", "", s)
limit = lambda s: 1.0 if len(key_of(s)) <= 4 else 0.95 if len(key_of(s)) <= 7 else 0.9
other = lambda k: k[:-1] if k.endswith("s") and len(k) > 1 else k + "s"
prefix = lambda name, sep: sep.join(w[:2].upper() for w in name.split(" "))
words = lambda s: {w for w in s.lower().split() if w}
jaccard = lambda a, b: len(words(a) & words(b)) / len(words(a) | words(b)) if words(a) and words(b) else 0.0


def test_linker_against_brute_force(spark, part):
    """Every mention of the query: lookup, nearest key, definitions, retrieval, reranking."""
    names = defaultdict(set)
    for _, name, brand, _ in part:
        names[brand].add(name)
    concepts = {b: sorted(n) for b, n in names.items()}
    terms = [(b, k, n, vector(plural(n))) for b, own in concepts.items() for k, n in enumerate(own)]
    matrix = np.array([t[3] for t in terms])
    table = defaultdict(list)
    for key, name, _, size in part:
        short = prefix(name, "-" if key % 2 == 0 else "")
        table[key_of(short)].append((-len(short), key, short, f"CL:{size}"))
    keys = sorted(table)
    key_matrix = np.array([vector(k) for k in keys])
    defined = defaultdict(dict)
    first = defaultdict(dict)
    mentions = set()
    for key, name, _, _ in part:
        doc = f"d{key % 50}"
        k = prefix(name, "") + ("s" if key % 2 == 0 else "")
        defined[doc][k] = name
        first[doc].setdefault(k, key)
        mentions |= {(doc, prefix(name, " ") + ("s" if key % 3 == 0 else "")), (doc, name)}

    def model(query):
        """The best concept of a query, with its final score; equal distances go by concept."""
        distance = np.round(1 - matrix @ vector(query), 9)
        k = min(range(len(terms)), key=lambda i: (distance[i], terms[i][0], terms[i][1]))
        brand, place = terms[k][0], terms[k][1]
        own = concepts[brand]
        score = -distance[k] + 0.35 * any(query.lower() == n.lower() for n in own) + 0.2 * max(jaccard(query, n) for n in own) + 0.15 * jaccard(query, own[0])
        score += 0.05 * max(SequenceMatcher(None, query.lower(), n.lower()).ratio() for n in own) + 0.03 * (place == 0)
        return brand, terms[k][2], score

    def deep(query):
        """The best of five concepts after reranking."""
        distance = np.round(1 - matrix @ vector(query), 9)
        order = sorted(range(len(terms)), key=lambda i: (distance[i], terms[i][0], terms[i][1]))
        best = {}
        for i in order[:50]:
            best.setdefault(terms[i][0], i)
        found = []
        for brand, i in list(best.items())[:5]:
            own = concepts[brand]
            score = -distance[i] + 0.35 * any(query.lower() == n.lower() for n in own) + 0.2 * max(jaccard(query, n) for n in own) + 0.15 * jaccard(query, own[0])
            score += 0.05 * max(SequenceMatcher(None, query.lower(), n.lower()).ratio() for n in own) + 0.03 * (terms[i][1] == 0)
            found.append((-score, distance[i], brand, terms[i][2]))
        score, _, brand, name = min(found)
        return brand, name, -score

    want = {}
    for doc, m in mentions:
        k = key_of(m)
        like = len(k) > 1 and (re.search(r"[A-Z0-9+/-]", m) or (len(k) <= 12 and " " not in m))
        row = table.get(k) if like else None
        score = 1.0
        if like and row is None and limit(m) < 1:
            close = np.round(1 - np.round(1 - key_matrix @ vector(k), 9), 9)
            at = max(range(len(keys)), key=lambda i: (close[i], [-ord(c) for c in keys[i]]))
            if close[at] >= limit(m):
                row, score, k = table[keys[at]], close[at], keys[at]
        if row and len({r[3] for r in row}) == 1:
            want[doc, m] = (min(row)[3], min(row)[2], score, "abbreviation_direct")
            continue
        long = None
        if row:
            have = defined[doc]
            long = have.get(k) or have.get(other(k))
            if long is None and limit(k) < 1:
                rated = [(-SequenceMatcher(None, k, x).ratio(), first[doc][x], x) for x in have]
                rated = [r for r in rated if -r[0] >= limit(k)]
                long = have[min(rated)[2]] if rated else None
        want[doc, m] = (*deep(plural(long)), "abbreviation_ambiguous_via_long_form") if long else (*model(plural(m)), "model_normal")
    got = {(r.doc_key, r.mention): (r.identifier, r.name, r.final_score, r.source) for r in queries()["link_mentions"](spark, SF).collect()}
    assert set(got) == set(want)
    wrong = [(k, got[k], want[k]) for k in want if got[k][3] != want[k][3] or abs(got[k][2] - want[k][2]) > 2e-6 or got[k][:2] != want[k][:2]]
    assert not wrong, (len(wrong), len(want), wrong[:5])
    assert len({x[3] for x in want.values()}) == 3
