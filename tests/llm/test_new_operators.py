"""Collocations, resampling and media columns against brute force, and on odd rows."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dossier.llm import collocations, media, resample

from .test_operators import LONG, SCHEMA, corpus, frame

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EMPTY = [c.split()[0] for c in SCHEMA.split(", ")]


def phrases(rows, least, longest, share, most):
    """Plain Python over (lang, text)."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = [x for x in re.split("[ \t]", piece) if x]
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        frequent = {p: a for p, a in c.items() if a >= least and len(p) > 1}
        best = []
        for p, a in frequent.items():
            if any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in frequent.items()):
                continue
            score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:most], 1)]
    return sorted(out)


def mined(spark, rows, **more):
    docs = spark.createDataFrame([(i, t, lang, "x", 7) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, n int")
    return sorted(tuple(r) for r in collocations.mine(docs, **more).collect())


ODD = [("en", None), ("en", ""), (None, "A b. a B, a b"), ("und", "a b a b a b"), ("en", "x\ty  z q;x y\x0bx y!x Y x y x y"), ("en", "a a a a a a"), ("zh", "中 文 中 文"), ("en", " \t\n.,")]


@pytest.mark.parametrize("bytes_of_set", [1 << 20, 40])
def test_collocations_equal_brute_force(spark, bytes_of_set):
    rows = [(r[2] if r[0] != 1000 else None, r[1]) for r in corpus(3, 40)] + ODD * 2
    for least, share, most in ((2, 100, 50), (3, 80, 5)):
        got = mined(spark, rows, least=least, share=share, most=most, cells=1 << 12, automata_bytes=bytes_of_set if most == 5 else 1 << 20) if bytes_of_set > 40 else mined(spark, ODD * 2, least=least, share=share, most=most, cells=1 << 12, automata_bytes=bytes_of_set)
        want = phrases(rows if bytes_of_set > 40 else ODD * 2, least, 5, share, most)
        assert got == want and want


def test_collocations_lose_nothing_to_a_crowded_sketch(spark):
    rows = [("en", t) for _, t, *_ in corpus(5, 30)]
    assert mined(spark, rows, least=4, longest=3, cells=64) == phrases(rows, 4, 3, 100, 2000)
    assert mined(spark, [("en", "p q " * 300)], least=260, cells=1 << 12) == phrases([("en", "p q " * 300)], 260, 5, 100, 2000)  # over what a byte holds


def test_collocations_of_nothing(spark):
    assert mined(spark, []) == [] and mined(spark, [("en", None), (None, "one two")]) == []


def test_collocations_have_few_candidates_in_much_text_too(spark, monkeypatch):
    """With a sketch of one size for any text, and sets of 4 MB, the readings of the texts grew with them."""
    monkeypatch.setattr(collocations, "CELLS", 1 << 8)
    monkeypatch.setattr(collocations, "CELL_BYTES", 2, raising=False)
    rng = np.random.default_rng(1)
    rows = [("en", "often seen " + " ".join(f"w{x}" for x in rng.integers(0, 10**6, 100))) for _ in range(200)]
    found, real = [], collocations.candidates
    monkeypatch.setattr(collocations, "candidates", lambda *a: found.append(real(*a)) or found[0])
    assert mined(spark, rows, least=100) == phrases(rows, 100, 5, 100, 2000) and found[0].count() < 100
    assert collocations.AUTOMATA_BYTES >= 64 << 20


def test_an_automaton_leaves_out_what_has_no_beginning():
    import pyarrow as pa

    words, own, levels = collocations.automaton(pa.array(["a", "a b", "a b a", "b c", "b c a d", "é", "é a"]))
    words = words.decode().split("\n")
    assert sorted(words) == ["a", "b", "c", "d", "é"] and {w for w, o in zip(words, own, strict=True) if o} == {"a", "é"}
    assert [len(x) for x in levels] == [3, 1, 0]


def test_steps_end_at_pieces():
    text = b"\n".join(b"w%d x%d" % (i, i) for i in range(60_000))
    parts = list(collocations.steps([text, b"", b"end"]))
    assert b"\n".join(parts) == text + b"\n\nend" and len(parts) > 2
    runs = lambda t: Counter(h for _, _, hs in collocations.Words(t, "en").runs(3) for h in hs.tolist())
    assert sum((runs(p) for p in parts), Counter()) == runs(b"\n".join(parts))


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def drawn(docs, target, longest=1, buckets=10_000, percent=10, least_words=20):
    def feats(text):
        w = [x.encode() for x in WORD.findall((text or "").translate(LOWER))]
        return len(w), [zlib.crc32(b" ".join(w[i : i + k])) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(b for _, x in docs for b in feats(x)[1]), Counter(b for x in target for b in feats(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in s}
    rows = []
    for d, x in docs:
        n, f = feats(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((-r[3], -1 if r[0] is None else r[0], *r[1:3]) for r in rows if r[4] >= least_words)
    able = able[: percent * len(able) // 100]
    place = defaultdict(list)
    for i, key in enumerate(able, 1):
        place[key].append(i)
    out = [(*r[:4], (place[k].pop(0) if r[4] >= least_words and place.get(k := (-r[3], -1 if r[0] is None else r[0], *r[1:3])) else None)) for r in rows]
    return sorted(out, key=str)


@pytest.mark.parametrize(("longest", "percent", "least_words"), [(1, 10, 20), (3, 35, 1), (1, 100, 0)])
def test_resampling_equals_brute_force(spark, longest, percent, least_words):
    rows = [(r[0], r[1]) for r in corpus(7, 70)] * 2 + [(5000, "café 中文 A1-b2_C3\x7fd4 " * 9)]
    target = [t for _, t in rows[3:20]] + [None, "", "only here"]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, rank int, weight int")
    wanted = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resample.resample(docs, wanted, percent, least_words, longest=longest)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == drawn(rows, target, longest, 10_000, percent, least_words)


def test_resampling_of_nothing(spark):
    docs, none = frame(spark, corpus(1, 5)), frame(spark, [])
    assert resample.resample(none, docs).collect() == []
    assert sorted((tuple(r) for r in resample.resample(docs, none).collect()), key=str) == drawn([(r[0], r[1]) for r in corpus(1, 5)], [])


def test_dictionary_starts_anew_when_it_is_full():
    d = resample.Dictionary(1000, most=2)
    for text in ("a b c d", "b c e f g", "a b c d"):
        bucket, of, n = resample.features([text.encode(), b"z"], d, 2)
        w = text.encode().split()
        assert sorted(bucket[of == 0].tolist()) == sorted(zlib.crc32(x) % 1000 for x in [*w, *[b" ".join(w[i : i + 2]) for i in range(len(w) - 1)]]) and n.tolist() == [len(w), 1]


def test_media_round_trip(spark):
    rows = corpus(2, 30)
    got = media.digest(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id) for r in got)) == sorted(str(r[0]) for r in rows)
    by_text = defaultdict(set)
    texts = defaultdict(set)
    for i, t, *_ in rows:
        texts[i].add((t or "").encode())
    for r in got:
        (t,) = texts[r.doc_id]
        payload = t + bytes(max(64, -(-len(t) // 64) * 64) - len(t))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.error) == (len(t), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), None)
        png = media.encode(payload)
        assert (r.media_bytes, r.media_sha256) == (len(png), hashlib.sha256(png).hexdigest()) and re.fullmatch("[0-9a-f]{16}", r.feature)
        by_text[t].add(tuple(r)[1:])
    assert all(len(v) == 1 for v in by_text.values()) and LONG.encode() in by_text
    assert media.digest(frame(spark, [])).collect() == []


@given(st.binary(max_size=900), st.sampled_from([b"", b"\0", b"abc"]))
@settings(max_examples=60, deadline=None)
def test_png_holds_any_bytes(data, fill):
    payload = (data + fill * 70)[: max(64, (len(data) + len(fill) * 70) // 64 * 64)].ljust(64, b"\0")
    assert media.decode(media.encode(payload)).tobytes() == payload


def plain_unfilter(kinds, rows, step):
    out = [[0] * len(rows[0]) for _ in rows]
    for y, row in enumerate(rows):
        for x, v in enumerate(row):
            a, b, c = out[y][x - step] if x >= step else 0, out[y - 1][x] if y else 0, out[y - 1][x - step] if y and x >= step else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out[y][x] = (v + (0, a, b, (a + b) // 2, paeth)[kinds[y]]) % 256
    return out


@pytest.mark.parametrize("step", [1, 2, 3, 4])
def test_all_row_filters_are_undone(step):
    rng = np.random.default_rng(step)
    for top in (3, 5):
        for height in (1, 2, 31):
            kinds, rows = rng.integers(0, top, height).astype(np.uint8), rng.integers(0, 256, (height, 9 * step)).astype(np.uint8)
            assert media.unfilter(kinds, rows, step).tolist() == plain_unfilter(kinds.tolist(), rows.tolist(), step)


def test_filters_are_chosen_where_they_help():
    flat = np.full((20, 64), 200, np.uint8)
    slope = np.arange(100, 228, 2, dtype=np.uint8)[None]
    assert set(media.filtered(flat)[1:, 0].tolist()) == {2} and media.filtered(slope)[0, 0] == 1 and (media.unfilter(media.filtered(slope)[:, 0], media.filtered(slope)[:, 1:], 1) == slope).all()
    text = np.frombuffer(b"Plain words are packed as they are, since matches save more." * 64, np.uint8).reshape(-1, 64)
    assert set(media.filtered(text)[:, 0].tolist()) == {0}


def test_broken_media_are_told(spark):
    good = media.encode(b"some bytes".ljust(128, b"\0"))
    flip = lambda at: good[:at] + bytes([good[at] ^ 1]) + good[at + 1 :]
    bits = good[:8] + media._chunk(b"IHDR", struct.pack(">IIBBBBB", 64, 2, 16, 0, 0, 0, 0)) + good[33:]
    rows = media._chunk(b"IHDR", struct.pack(">IIBBBBB", 64, 3, 8, 0, 0, 0, 0))
    cases = {"whole": good, "none": None, "signature": flip(1), "header": flip(17), "data": flip(len(good) - 20), "cut": good[:-3], "depth": bits, "rows": good[:8] + rows + good[33:], "stream": good[:33] + media._chunk(b"IDAT", b"no stream") + media._chunk(b"IEND", b"")}
    table = spark.createDataFrame(list(cases.items()), "name string, media binary")
    got = {r.name: r for r in media.read(table).collect()}
    assert got["whole"].error is None and got["none"].error is None and got["none"].media_bytes is None
    for name, words in {"signature": "signature", "header": "checksum of IHDR", "data": "checksum of IDAT", "cut": "cut off", "depth": "8-bit", "rows": "number of samples", "stream": "broken stream"}.items():
        assert words in got[name].error and got[name].payload_sha256 is None and got[name].media_bytes == len(cases[name])


def test_foreign_png_with_colour_and_ancillary_chunks():
    samples = np.arange(5 * 4 * 3, dtype=np.uint8).reshape(5, 12)
    raw = b"".join(b"\0" + r.tobytes() for r in samples)
    data = zlib.compress(raw)
    png = media.SIGNATURE + media._chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 5, 8, 2, 0, 0, 0)) + media._chunk(b"tEXt", b"k\0v") + media._chunk(b"IDAT", data[:7]) + media._chunk(b"IDAT", data[7:]) + media._chunk(b"IEND", b"")
    assert (media.decode(png) == samples).all()


def test_hashes_tell_near_images_from_others(spark):
    rng = np.random.default_rng(0)
    image = rng.integers(0, 256, (8, 8)).repeat(12, 0).repeat(8, 1).astype(np.uint8)
    near = np.clip(image.astype(int) + rng.integers(-6, 7, image.shape), 0, 255).astype(np.uint8)
    other = rng.integers(0, 256, (8, 8)).repeat(12, 0).repeat(8, 1).astype(np.uint8)
    a, b, c = map(media.cosine_hash, (image, near, other))
    got = spark.createDataFrame([(a, b), (a, c), (a, a)], "x binary, y binary").select(media.distance(F.col("x"), F.col("y"))).collect()
    far = [bin(int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).count("1") for x, y in ((a, b), (a, c), (a, a))]
    assert [r[0] for r in got] == far and far[0] <= 8 < 16 < far[1]
