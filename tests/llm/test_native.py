"""Quality rules, personal data, mixing, sharding: brute force and odd cases."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glossa.llm import mixing, pii, quality_rules, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text):
    w = WORD.findall(text or "")
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    inside = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(5)}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(inside)


def test_rules_against_brute_force(spark, odd):
    draw = random.Random(1)
    texts = ["\n".join(" ".join(draw.choice(["a", "b", "the", "X#", "é|", "<z>"]) for _ in range(draw.randrange(0, 9))) for _ in range(draw.randrange(1, 9))) for _ in range(150)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").union(odd.select("doc_id", "text"))
    every = Counter((r.doc_id, *measured(r.text)) for r in d.collect())
    got = quality_rules.judge(d).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert Counter(tuple(r)[:6] for r in got) == every
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_rules_keep_columns(odd, none):
    kept = quality_rules.apply_rules(odd)
    assert kept.columns == odd.columns and kept.count() < odd.count()
    assert quality_rules.judge(none).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    found = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) < 256 for p in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                found.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x for _, _, x in sorted(found)]


def test_pii_against_brute_force(spark, odd):
    draw = random.Random(2)
    bits = ["a@b.c", "x.y@z-1.co", "_", "@", ".", " ", "-", "+", "4111 1111 1111 1111", "4111111111111111", "1.2.3.4", "256.1.1.1", "0001.2.3.4", "7", "12", "+49 30 1234567", "(", ")", "😀", "é", "+1-555-123-4567-", "5500-0000-0000-0004", "\n", "a" * 50]
    texts = ["".join(draw.choice(bits) for _ in range(draw.randrange(1, 14))) for _ in range(400)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").union(odd.select("doc_id", "text"))
    base = f"filter(spans, s -> s.kind < {len(pii.BASE)})"
    for r in pii.find_spans(d).select("text", F.expr(pii.digest(base)).alias("b"), "spans").collect():
        assert r.b == ",".join(base_spans(r.text)), r.text
        assert all((r.text or "")[s.start : s.end] == s.text for s in r.spans)


def test_pii_finds_cards_with_every_digit_apart(spark):
    number = "4111111111111111"
    texts = [" ".join(number), "-".join(number), f"card {' '.join(number)}, thanks", f"é {'-'.join(number)} 😀", " ".join(number[:-1] + "2"), "4 1 1 1", "- ".join(number), f"{' '.join(number)} a@b.co"]
    draw = random.Random(12)
    texts += ["".join(c + draw.choice([" ", "-", " ", "-", ""]) for c in draw.choice([number, "5500000000000004", "378282246310005"])) for _ in range(60)]
    base = f"filter(spans, s -> s.kind < {len(pii.BASE)})"
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find_spans(d).select("text", F.expr(pii.digest(base)).alias("b")).collect():
        assert r.b == ",".join(base_spans(r.text)), r.text
    assert pii.redact(d.where("doc_id < 2")).select("text").distinct().head()[0] == "[CARD]"


def test_pii_checks_and_context(spark):
    def kinds(text):
        d = spark.createDataFrame([(text,)], "text string")
        return [pii.ORDER[s.kind] for s in pii.find_spans(d).head().spans]

    assert kinds("pay to DE89 3704 0044 0532 0130 00 now") == ["iban"]
    assert kinds("pay to DE88 3704 0044 0532 0130 00 now") == []
    assert kinds("code 123-45-6789") == [] and kinds("my SSN is 123-45-6789") == ["ssn"]
    assert kinds("555-123-4567") == [] and kinds("call 555-123-4567") == ["localphone"]


def test_redact(spark, odd, none):
    d = spark.createDataFrame([(1, "mail a@b.co or 1.2.3.4!", 9), (2, None, None), (3, "", 0)], "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in pii.redact(d).orderBy("doc_id").collect()] == [(1, "mail [EMAIL] or [IP]!", 21), (2, None, None), (3, "", 0)]
    assert pii.redact(odd).columns == odd.columns and pii.redact(odd).count() == odd.count()
    assert pii.redact(none).count() == 0


def test_redact_carries_columns_of_any_name(spark):
    d = spark.createDataFrame([("mail a@b.co", "left as it is a@b.co", "x", 4, "y")], "text string, _t string, _spans string, n_chars int, `a.b` string")
    assert tuple(pii.redact(d).head()) == ("mail [EMAIL]", "left as it is a@b.co", "x", 12, "y")
    assert pii.find_spans(d).columns == [*d.columns, "spans"]
    assert tuple(pii.find_spans(d).head())[:5] == ("mail a@b.co", "left as it is a@b.co", "x", 4, "y")


def test_redact_against_brute_force(spark):
    draw = random.Random(8)
    bits = ["a@b.c", "1.2.3.4", "4111 1111 1111 1111", "+49 30 1234567", " and ", "é😀", "+1-555-123-4567", "x" * 700]
    texts = ["".join(draw.choice(bits) for _ in range(n)) for n in [*range(1, 30), 300, 900]]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.find_spans(d).collect()}
    for r in pii.redact(d).collect():
        out, at = "", 0
        for s in spans[r.doc_id]:
            if s.start >= at:
                out += texts[r.doc_id][at : s.start] + f"[{pii.ORDER[s.kind].upper()}]"
            at = max(at, s.end)
        assert r.text == out + texts[r.doc_id][at:]


def test_pii_in_very_long_texts(spark):
    """Many spans, and runs of digits that lead nowhere, do not take time by their square."""
    texts = ["é 10.20.30.40, " * 20_000, "1.1 " + "7" * 200_000, "a" * 200_000 + "@", "7 " * 100_000, "+7" + " (" * 100_000, "a@b" + ".c" * 100_000]
    began = time.perf_counter()
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    base = F.expr(pii.digest(f"filter(spans, s -> s.kind < {len(pii.BASE)})"))
    got = {r.doc_id: r.b for r in pii.find_spans(d).select("doc_id", base.alias("b")).collect()}
    clean = {r.doc_id: r.text for r in pii.redact(d).collect()}
    took = time.perf_counter() - began
    for k, text in enumerate(texts):
        assert got[k] == ",".join(base_spans(text) if k in (0, 5) else [])
    assert clean[0] == "é [IP], " * 20_000 and clean[1] == texts[1] and clean[5] == "[EMAIL]"
    assert took < 60


def schedule(weights, blocks):
    """(source's place, block, slot), slot by slot by earliest deadline first; the last open
    source's rest at its deadlines."""
    share = list(mixing.shares(weights).values())
    total, left = sum(share), [blocks.get(s, 0) for s in weights]
    ends = sorted(-(-n * total // w) for n, w in zip(left, share, strict=True))
    at, out = [0] * len(share), []
    for slot in range(-(-ends[-2] // mixing.RANGE) * mixing.RANGE if len(ends) > 1 else 0):
        ready = [(-(-(k + 1) * total // w), i) for i, (k, w) in enumerate(zip(at, share, strict=True)) if k * total // w <= slot]
        due, i = min(ready)
        assert due > slot
        if at[i] < left[i]:
            out.append((i, at[i], slot))
        at[i] += 1
    out += sorted(((i, k, -(-(k + 1) * total // share[i]) - 1) for i, n in enumerate(left) for k in range(at[i], n)), key=lambda r: r[2])
    return tuple(map(list, zip(*out, strict=True)))


@pytest.mark.parametrize("sizes", [[70], [1, 1], [5000, 3, 900], [40] * 30, [10000, 9000, 1, 2, 50, 77, 400, 3000], [1, 2, 3] * 60])
def test_slots_of_ranges_are_those_of_the_whole_schedule(spark, sizes):
    sizes = {f"s{i:03}": n for i, n in enumerate(sizes)}
    weights = {s: n**0.5 for s, n in sizes.items()}
    which, block, slot = schedule(weights, sizes)
    d = spark.createDataFrame(list(sizes.items()), "source string, n long").select("source", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("doc_id"))
    got = mixing.mix(d, weights, block_rows=1).orderBy("position").select("source", "block", "slot").collect()
    names = list(sizes)
    assert [tuple(r) for r in got] == [(names[i], k, t) for i, k, t in zip(which, block, slot, strict=True)]


def test_weights_of_very_unequal_size(spark):
    share = mixing.shares({"a": 1e-30, "b": 1.0, "c": 3e15})
    assert share["a"] == 1 and 0 < sum(share.values()) < 10**mixing.DIGITS
    got = mixing.slots(spark, [1, 10**9, 3 * 10**20], 2).orderBy("slot").collect()
    assert [r.slot for r in got] == list(range(2 * mixing.RANGE)) and all(r.i == 2 or r.k == 0 for r in got)


@pytest.mark.parametrize("seed", range(4))
def test_schedule_keeps_to_the_exact_weights(seed):
    draw = random.Random(seed)
    rows = {f"s{i}": draw.randrange(1, 40) * 100 for i in range(19)} | {"hot": 20000}
    weights = {s: n**0.5 for s, n in rows.items()}
    which, block, slots = schedule(weights, rows)
    assert Counter(which) == {i: n for i, n in enumerate(rows.values())} and slots == sorted(slots) and len(set(slots)) == len(slots)
    names, done, total = list(rows), Counter(), sum(weights.values())
    for i, k, slot in zip(which, block, slots, strict=True):
        assert k == done[i]
        done[i] += 1
        # Each block lies in its own window, so the source is never a block off its share.
        w = weights[names[i]] / total
        assert k / w - 1 - 1e-6 < slot < (k + 1) / w + 1e-6


def test_mix_by_unequal_weights_and_many_sources(spark):
    d = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2000, "x").when(F.col("id") < 4000, "y").otherwise("z").alias("source"))
    weights = {"x": 2**0.5, "y": 3**0.5, "z": 7**0.5}
    seen, total = Counter(), sum(weights.values())
    for i, r in enumerate(mixing.mix(d, weights, block_rows=1).orderBy("position").collect()[:3600], 1):
        seen[r.source] += 1
        assert all(abs(seen[s] - i * w / total) < 1 for s, w in weights.items()), i
    turned = mixing.mix(d, dict(reversed(weights.items())), block_rows=1)
    assert turned.exceptAll(mixing.mix(d, weights, block_rows=1)).isEmpty()
    many = spark.range(2400).select(F.col("id").alias("doc_id"), F.format_string("s%d", F.col("id") % 1200).alias("source"))
    rows = mixing.mix(many, mixing.tempered_weights(many), block_rows=1).collect()
    assert sorted(r.position for r in rows) == list(range(2400))


def test_mix(spark, odd, none):
    got = mixing.mix(odd, {"a": 2, "b": 1, "c": 1, None: 1}, block_rows=2, period=20).collect()
    assert len(got) == odd.count() and sorted(r.position for r in got) == list(range(len(got)))
    assert Counter(r.source for r in got) == Counter(r.source for r in odd.select("source").collect())
    assert mixing.mix(none, {}).count() == 0 and mixing.tempered_weights(none) == {}
    d = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 300, "x").when(F.col("id") < 600, "y").otherwise("z").alias("source"))
    rows = mixing.mix(d, {"x": 5, "y": 3, "z": 2}, block_rows=3, period=100).orderBy("position").collect()
    seen = Counter()
    for i, r in enumerate(rows[:500]):
        seen[r.source] += 1
        for s, w in {"x": 0.5, "y": 0.3, "z": 0.2}.items():
            assert abs(seen[s] - (i + 1) * w) < 6  # a block, and quotas rounded to hundredths


def test_sharding(spark, odd, none):
    draw = random.Random(4)
    data = [(i, f"t{i}") for i in range(300)] + [(1000 + i, f"g{draw.randrange(20)}") for i in range(200)] + [(5000 + i, "hot") for i in range(100)]
    d = spark.createDataFrame(data, "doc_id long, text string")
    got = sharding.shard_equal_texts(d, 8).collect()
    text = dict(data)
    sizes = Counter(r.shard for r in got)
    assert len(got) == 600 and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    where = {}
    for r in got:
        where.setdefault(text[r.doc_id], Counter())[r.shard] += 1
        assert r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.size == len(text[r.doc_id]) + 1
    split = [t for t, c in where.items() if len(c) > 1 and t != "hot"]
    assert len(split) <= 4, split
    odd_rows = sharding.shard_equal_texts(odd, 3).collect()
    assert len(odd_rows) == odd.count() and [r.size for r in odd_rows if r.doc_id == 1] == [1]
    assert sharding.shard_equal_texts(none, 8).count() == 0


def test_digest_is_the_contract(spark):
    text = "a@b.co 1.2.3.4"
    r = pii.find_spans(spark.createDataFrame([(text,)], "text string")).select(F.sha2(F.expr(pii.digest("spans")), 256)).head()[0]
    assert r == hashlib.sha256(b"email:0:6,ip:7:14").hexdigest()


def test_labels_move_to_their_neighbours(spark):
    """Planted communities: far fewer rows stand outside their hub's shard than at first, no
    shard is above its capacity by much, and small groups of equal texts stay whole."""
    draw = random.Random(4)
    links = [(i, f"c{i // 50}.{k}") for i in range(400) for k in draw.sample(range(12), 3)] + [(i, f"x{draw.randrange(40)}") for i in draw.sample(range(400), 40)]
    d = spark.createDataFrame(links, "node long, hub string")
    before = spark.createDataFrame([(i, draw.randrange(4)) for i in range(400)], "node long, shard int")
    after = sharding.propagate(d, 4, 100, rounds=12).select("node", F.col("label").alias("shard"))
    cut = lambda p: sharding.cut_links(p, d).head().cut
    # By brute force: rows outside the shard where most of their hub stands.
    of, hubs = {r.node: r.shard for r in after.collect()}, {}
    for i, h in links:
        hubs.setdefault(h, Counter())[of[i]] += 1
    assert cut(after) == sum(sum(c.values()) - max(c.values()) for c in hubs.values()) < 0.75 * cut(before)
    assert max(Counter(of.values()).values()) <= 130
    texts = [f"text {k % 90}" for k in range(270)] + ["hot"] * 130
    got = sharding.shard_equal_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4).collect()
    shards = {}
    for r in got:
        shards.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert Counter(r.shard for r in got) == {k: 100 for k in range(4)}
    assert sum(len(s) > 1 for s in shards.values()) <= 4
    for k in range(4):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(100))


def test_equal_weights_do_not_drift(spark):
    """Three equal sources over many blocks: at every position each has its share but a block."""
    rows = [(i, "abc"[i % 3]) for i in range(6000)]
    d = spark.createDataFrame(rows, "doc_id long, source string")
    got = mixing.mix(d, {"a": 1.0, "b": 1.0, "c": 1.0}, block_rows=1).orderBy("position").collect()
    done = Counter()
    for t, r in enumerate(got):
        assert r.position == t
        done[r.source] += 1
        assert all(abs(done[s] - (t + 1) / 3) < 1 for s in "abc")
    many = spark.createDataFrame([(i, f"s{i % 3000}") for i in range(6000)], "doc_id long, source string")
    assert sorted(r.position for r in mixing.mix(many, mixing.tempered_weights(many)).collect()) == list(range(6000))
