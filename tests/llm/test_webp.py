import hashlib
import itertools
import zlib

import numpy as np
import pytest

from glossa.llm import webp


def picture(h, w, colours, seed):
    draw = np.random.default_rng(seed)
    base = draw.integers(0, 1 << 32, colours, dtype=np.uint32)
    return base[np.sort(draw.integers(0, colours, (h, w)), axis=1)]


@pytest.mark.parametrize("transforms", [t for n in range(3) for t in itertools.permutations(range(3), n)] + [(3,), (3, 0), (3, 2)])
@pytest.mark.parametrize("cache,references", [(0, False), (5, False), (0, True), (7, True)])
def test_round_trip(transforms, cache, references):
    for h, w, colours in ((1, 1, 1), (9, 13, 2), (7, 10, 4), (6, 17, 13), (11, 9, 60)):
        image = picture(h, w, colours, h * w)
        stored = webp.encode(image, transforms, cache, references)
        assert np.array_equal(webp.decode(stored), image), (h, w, colours)


@pytest.mark.parametrize("mode", range(14))
def test_each_predictor(mode):
    image = np.random.default_rng(mode).integers(0, 1 << 32, (8, 9), dtype=np.uint32)
    assert np.array_equal(webp.decode(webp.encode(image, (webp.PREDICTOR,), tile=3, mode=mode)), image)


def seen(monkeypatch):
    """Counts what decoding runs: transforms by kind, references, cache hits, plans."""
    from collections import Counter

    found = Counter()
    for name in ("_cross", "_restore", "_distance", "_read_green"):
        def run(*a, _f=getattr(webp, name), _n=name, **k):
            found[_n] += 1
            return _f(*a, **k)

        monkeypatch.setattr(webp, name, run)
    plan = webp.plan

    def planned(x):
        out = plan(x)
        found.update(out.get("transforms", ()))
        found["cache"] += "cache_bits" in out
        return out

    monkeypatch.setattr(webp, "plan", planned)
    return found


def test_stored_texts_use_every_part_of_the_format(monkeypatch):
    """Prose, few letters, ramps: references, palette, predictor, cross-colour and prefix codes
    of several lengths are read back by the query's own path, and a cache where it is planned."""
    found = seen(monkeypatch)
    draw = np.random.default_rng(3)
    prose = " ".join("the of and to in is was heart liver kidney".split()[k] for k in draw.integers(0, 10, 900))
    ramp = bytes((i * 3 + i // 576) % 128 for i in range(576 * 40)).decode()
    for text in (prose, "acgt" * 3 + "".join("acgt"[k] for k in draw.integers(0, 4, 5000)), ramp, "日本 " + prose):
        row = webp.media_row(text)
        raw = text.encode()
        payload = raw + b"\xff" * (-len(raw) % 576)
        assert row[:4] == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        stored = webp.store(payload)
        assert row[4:6] == (len(stored), hashlib.sha256(stored).hexdigest())
        samples = np.frombuffer(payload, np.uint8).reshape(-1, 576).astype(float)
        sums = samples.sum(axis=0).reshape(64, 9).sum(axis=1)
        bits = "".join("01"[int(sums[k] > sums[k - 1])] for k in range(64))
        assert row[6] == f"{int(bits, 2):016x}:{samples.mean():.4f}"
    assert found[webp.CROSS_COLOUR] and found[webp.COLOUR_INDEXING] and found[webp.PREDICTOR]
    assert found["_cross"] and found["_restore"] and found["_distance"] and found["_read_green"]
    monkeypatch.setattr(webp, "plan", lambda x: {"references": True, "cache_bits": webp.CACHE_BITS})
    assert webp.load(webp.store(payload)).tobytes() == payload


def test_store_and_load():
    for n in (1, 2, 40):
        raw = np.random.default_rng(n).integers(0, 256, n * webp.ROW, dtype=np.uint8)
        assert webp.load(webp.store(raw.tobytes())).tobytes() == raw.tobytes()
    raw = bytes(range(24)) * 24 * 40
    assert len(webp.store(raw)) < 0.7 * len(raw)


def test_many_files(monkeypatch):
    monkeypatch.setattr(webp, "MAX_ROWS", 3)
    raw = bytes(range(256)) * 9 * 9
    raw = raw[: len(raw) // webp.ROW * webp.ROW]
    assert webp.load(webp.store(raw)).tobytes() == raw


def test_broken_streams():
    good = webp.encode(picture(5, 5, 9, 1))
    for bad in (b"", good[:30], b"RIFX" + good[4:]):
        with pytest.raises(ValueError):
            webp.decode(bad)


def test_rows():
    assert webp.media_row(None) == webp.media_row("")
    n, payload, *_ = webp.media_row("a" * 576)
    assert (n, payload) == (576, 576)
    assert webp.media_row("é")[:2] == (2, 576)


@pytest.mark.parametrize("look", [1, 50, 1 << 17])
def test_tokens_by_chains(monkeypatch, look):
    """Tokens over the borders of steps: literals, references that overlap themselves, far ones."""
    monkeypatch.setattr(webp, "LOOK", look)
    draw = np.random.default_rng(look)
    far = draw.integers(97, 123, 2000, dtype=np.uint8)
    raw = np.concatenate([far, np.full(900, 7, np.uint8), np.tile(far[:5], 90), far, draw.geometric(0.1, 500).astype(np.uint8)])
    raw = raw[: len(raw) // webp.ROW * webp.ROW].tobytes()
    stored = webp.encode(webp._grey(np.frombuffer(raw, np.uint8).reshape(-1, webp.ROW)), (webp.CROSS_COLOUR,), references=True, tile=5, cross=webp.GREY)
    assert webp.load(stored).tobytes() == raw
    if look > 1:
        for cut in range(30, len(stored), 97):
            with pytest.raises(ValueError):
                webp.decode(stored[:cut])


def test_bits_of_a_writer():
    """Numbers of 0 to 63 bits in words of 64, after bits that stand there already."""
    draw = np.random.default_rng(8)
    sizes = np.append([0, 63, 63, 0], draw.integers(0, 64, 300))
    values = np.array([int(draw.integers(0, 1 << int(n))) if n else 0 for n in sizes], np.int64)
    w = webp.Writer()
    w.put(5, 3)
    w.add(values, sizes)
    w.put(1, 1)
    bits = "".join(f"{v:0{n}b}"[::-1] if n else "" for v, n in [(5, 3), *zip(values.tolist(), sizes.tolist(), strict=True), (1, 1)])
    assert w.bytes() == int(bits[::-1], 2).to_bytes((len(bits) + 7) // 8, "little")


def test_reading_takes_no_step_for_each_pixel(monkeypatch):
    """Twice the pixels of prose run the same lines of Python, but for one in sixteen tokens."""
    import sys

    draw = np.random.default_rng(4)
    prose = lambda n: bytes(draw.integers(97, 117, n * webp.ROW, dtype=np.uint8))
    lines = []
    for stored in (webp.store(prose(8)), webp.store(prose(16))):
        seen = 0

        def trace(frame, event, arg):
            nonlocal seen
            seen += event == "line" and frame.f_code.co_filename == webp.__file__
            return trace

        sys.settrace(trace)
        try:
            webp.load(stored)
        finally:
            sys.settrace(None)
        lines.append(seen)
    assert lines[1] - lines[0] < 8 * webp.ROW / 4


def some_texts(count, seed=6):
    draw = np.random.default_rng(seed)
    words = "the of and to in is was heart liver kidney été 日本 \n".split(" ")
    return [" ".join(words[k] for k in draw.integers(0, len(words), n)) for n in draw.integers(1, 400, count)]


@pytest.mark.parametrize("step,look", [(1, 1 << 17), (1500, 200), (1 << 17, 1 << 17)])
def test_texts_together_are_each_as_alone(monkeypatch, step, look):
    """Null, empty, equal, constant, palette, predictor and long texts beside prose, in several
    files each: the rows are those of one text at a time, wherever a step ends."""
    monkeypatch.setattr(webp, "MAX_ROWS", 5)
    ramp = bytes((i * 3 + i // 576) % 128 for i in range(576 * 12)).decode()
    texts = [*some_texts(12), None, "", "a" * 576, "acgtta" * 900, ramp, "b" * 9000, "ab" * 3, *some_texts(2), some_texts(1)[0] * 20]
    alone = [webp.media_row(t) for t in texts]
    monkeypatch.setattr(webp, "STEP", step)
    monkeypatch.setattr(webp, "LOOK", look)
    assert webp.media_rows(texts) == alone
    for text, row in zip(texts, alone, strict=True):
        raw = (text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % webp.ROW or (0 if raw else webp.ROW))
        assert row[:4] == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert webp.media_rows([]) == []


def test_array_operations_are_for_many_texts(monkeypatch):
    """48 texts are searched for references, packed to bits and read back in as many steps as one."""
    from collections import Counter

    found = Counter()
    for name in ("_copies", "_packed", "_read_step"):
        def run(*a, _f=getattr(webp, name), _n=name):
            found[_n] += 1
            return _f(*a)

        monkeypatch.setattr(webp, name, run)
    webp.media_rows(some_texts(48))
    assert found and max(found.values()) <= 3
    assert set(found) == {"_copies", "_packed", "_read_step"}


def test_stored_form_stays():
    """The digests that the encoder of one image at a time gave."""
    stored = webp.store_all([t.encode() + b"\xff" * (-len(t.encode()) % webp.ROW) for t in some_texts(40)])
    assert hashlib.sha256(b"".join(stored)).hexdigest() == "3543ce4ee92aeecbfa5328bb9b9265d42d7755bbe899173686eaeae25e7f8e89"
