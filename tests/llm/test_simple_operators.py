import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphloom.llm import media, mixing, sharding, topk
from glyphloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def texts(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


# ------------------------------------------------------------------ sharding


def jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_matches_the_published_loop():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 2**64, 500, dtype=np.uint64)
    for shards in (1, 2, 16, 17, 1000):
        assert sharding.jump(keys, shards).tolist() == [jump(int(k), shards) for k in keys]
    with pytest.raises(ValueError):
        sharding.jump(keys, 0)


def test_shards_slots_and_growth(spark):
    rows, docs = QUERIES["op2_jump_sharding"](spark, SF).collect(), texts(spark)
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    slots = defaultdict(list)
    for r in rows:
        body = (docs[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(body) + 1, zlib.crc32(body), "key")
        assert r.grown_shard in (r.shard, 16) and 0 <= r.shard < 16
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = {r.doc_id: r.shard for r in sharding.shard(spark.read.parquet(f"{SF}/documents.parquet"), 17).collect()}
    assert again == {r.doc_id: r.grown_shard for r in rows}


def test_sharding_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a", 1), (None, None, 1), (5, "é", 1), (5, "é", 1), (6, "z" * 300000, 1)], "doc_id long, text string, block int")
    rows = sharding.shard(docs, 4, block_rows=1).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert len(rows) == 5 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.shard for r in rows if r.doc_id == 5}) == 1 and {r.size for r in rows} == {2, 1, 3, 300001}
    assert sharding.shard(docs.limit(0)).count() == 0


# ------------------------------------------------------------------ mixing


def fill(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Reshare by weight until no source is above its limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * unit >= most * sizes[s]}
        if not full:
            return target | {s: weight[s] * unit for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_targets_are_water_filling(spark):
    rng = random.Random(2)
    for n in (1, 2, 7, 40):
        sizes = {f"s{i}é": rng.choice([0, 1, 5, 1000, 10**6]) for i in range(n)} | {None: 7}
        table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(table).collect()}
        want = fill(sizes)
        assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-6) for s in want)


def test_mix_takes_what_the_query_says(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = QUERIES["op6_source_mixing"](spark, d).collect()
    taken = Counter(r.doc_id for r in mixing.mix(docs).collect())
    assert all(r.taken == taken[r.doc_id] * r.size and r.taken <= 2 * r.size for r in rows)
    body = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.size == len(re.findall(r"[^\x20\x09-\x0D]+", body[r.doc_id])) for r in rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, QUERIES["op6_source_mixing"](spark, d).collect()))
    by = defaultdict(lambda: [0, 0])
    for r in rows:
        rate = r.target / r.source_size
        by[r.source_size, r.target][0] += r.taken
        by[r.source_size, r.target][1] += r.size**2 * (rate % 1) * (1 - rate % 1)
    assert all(abs(x - t) <= 4 * math.sqrt(v) + 1e-6 for (_, t), (x, v) in by.items())


def test_mixing_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b", None, 3), (1, "a b", None, 3), (None, "c", "x", 3), (2, None, "y", 3), (3, "", "y", 3), (4, "w " * 90000, "x", 3)], "doc_id long, text string, source string, rate int")
    rows = mixing.plan(docs).collect()
    assert len(rows) == 6 and all(r.copies in (0, 1, 2) for r in rows) and {r.target for r in rows if r.source == "y"} == {0.0}
    assert mixing.mix(docs).columns == docs.columns and mixing.plan(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


# ------------------------------------------------------------------ top-k


def brute_top(rows, k=10):
    """rows: (vec_id, list)."""
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in rows}
    out = []
    for q in whole:
        if q % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(whole[q], whole[c])), c) for c in whole if c != q)[:k]
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["random", "ties", "clusters"])
def test_threshold_algorithm_against_brute_force(spark, kind):
    rng = np.random.default_rng(1)
    if kind == "random":
        v = rng.normal(size=(400, 12))
    elif kind == "ties":
        v = rng.integers(-1, 2, (400, 3)) / 2
    else:
        v = np.repeat(rng.normal(size=(8, 12)), 50, axis=0) + 0.01 * rng.normal(size=(400, 12))
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, 10, candidates=90, block=2)
    assert sorted(map(tuple, got.collect())) == brute_top(rows)


def test_the_bound_stops_the_search():
    rng = np.random.default_rng(2)
    block = rng.integers(-50, 50, (3000, 4))
    block[:20] *= 40
    query, ids, read = np.array([[9, -7, 5, 3]]), np.arange(3000), []
    _, rows, scores = topk.threshold_top(query, np.array([-1]), block, ids, 5, read=read)
    want = np.lexsort((ids, -(block @ query[0])))[:5]
    assert rows.tolist() == want.tolist() and scores.tolist() == (block @ query[0])[want].tolist() and 0 < read[0] < 1000
    # A floor that another block gave stops a search at once.
    assert [len(x) for x in topk.threshold_top(query, np.array([-1]), block[20:], ids[20:], 5, np.array([scores.min()]), read)] == [0, 0, 0] and read[1] < 200


def test_topk_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (5, [1.0]), (6, []), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (None, [5.0, 5.0]), (100, [0.0, 0.0])]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    got = sorted(map(tuple, topk.search(table, F.col("vec_id") % 100 == 0).collect()))
    assert got == [(0, 1, 7, 5 * 2**20), (0, 2, 7, 5 * 2**20), (0, 3, 5, 2**20), (0, 4, 6, 0), (0, 5, 100, 0)] + [(100, i + 1, c, 0) for i, c in enumerate((0, 5, 6, 7, 7))]
    assert topk.search(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0


# ------------------------------------------------------------------ media


def slow_pcm(payload, tag, to=4000):
    """The stored sound, sample by sample."""
    if tag == media.IMA_ADPCM:
        samples = [x for a in range(0, len(payload), 64) for x in slow_adpcm(payload[a : a + 64])]
    else:
        samples = [slow_law(b, tag) for b in payload]
    return slow_filter(samples, 8000, to)


def slow_filter(samples, rate, to):
    """Another rate by its definition, an output sample at a time: a windowed sinc round its place, the run's ends held."""
    g = math.gcd(rate, to)
    up, down = to // g, rate // g
    half = math.ceil(8 * max(1, down / up))
    cut, phases = 0.92 * min(1, up / down), []
    for p in range(up):
        h = []
        for k in range(1 - half, half + 1):
            t = k - p / up
            h.append((math.sin(math.pi * cut * t) / (math.pi * cut * t) if t else 1.0) * math.cos(math.pi * t / (2 * half)) ** 2)
        whole = [round(x / sum(h) * 32768) for x in h]
        whole[half - 1 + (2 * p > up)] += 32768 - sum(whole)
        phases.append(whole)
    out = []
    for n in range(len(samples) * up // down):
        i, p = divmod(n * down, up)
        total = sum(samples[min(max(i + k, 0), len(samples) - 1)] * h for k, h in zip(range(1 - half, half + 1), phases[p], strict=True))
        out.append(max(-32768, min(32767, (total + 16384) >> 15)))
    return out


def slow_law(byte, tag):
    """G.711's expansion of one byte, bit by bit."""
    if tag == media.MU_LAW:
        byte = ~byte & 255
        size = ((2 * (byte & 15) + 33) * 2 ** (byte >> 4 & 7) - 33) * 4
        return -size if byte >= 128 else size
    byte ^= 0x55
    low, power = byte & 15, byte >> 4 & 7
    size = (2 * low + 1 if power == 0 else (2 * low + 33) * 2 ** (power - 1)) * 8
    return size if byte >= 128 else -size


def test_media_round_trip(spark):
    docs = texts(spark)
    kinds = Counter()
    for r in QUERIES["op9_telephony_media"](spark, SF).collect():
        body = (docs[r.doc_id].text or "").encode()
        padded = body + b"\0" * (max(64, -(-len(body) // 64) * 64) - len(body))
        tag = (media.MU_LAW, media.A_LAW, media.IMA_ADPCM)[zlib.crc32(body) % 3]
        kinds[tag] += 1
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(body), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        # The file, field by field.
        fmt = struct.pack("<HHIIHHHH", tag, 1, 8000, 8000 * 64 // 121, 64, 4, 2, 121) if tag == 17 else struct.pack("<HHIIHHH", tag, 1, 8000, 8000, 1, 8, 0)
        count = len(padded) // 64 * 121 if tag == 17 else len(padded)
        chunks = b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, count) + b"data" + struct.pack("<I", len(padded)) + padded
        file = b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks
        assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())
        sound = slow_pcm(padded, tag)
        turns = sum((a < 0) != (b < 0) for a, b in zip(sound, sound[1:]))
        crc = zlib.crc32(struct.pack(f"<{len(sound)}h", *sound))
        name = {6: "a-law", 7: "mu-law", 17: "ima-adpcm"}[tag]
        assert r.feature == f"{name};samples={len(sound)},peak={max(map(abs, sound))},energy={sum(x * x for x in sound)},turns={turns},crc32={crc:08x}"
    assert len(kinds) == 3


def test_encoders():
    rng = np.random.default_rng(4)
    for tag in (media.MU_LAW, media.A_LAW):
        table = media.TABLES[tag]
        assert table.tolist() == [slow_law(b, tag) for b in range(256)]
        assert table[media.law(table, tag)].tolist() == table.tolist()
        x = rng.integers(-32768, 32768, 2000).astype(np.int16)
        nearest = [min(abs(int(v) - int(t)) for t in table) for v in x]
        assert np.abs(table[media.law(x, tag)].astype(int) - x).tolist() == nearest
    t = np.arange(3000)
    sound = (9000 * np.sin(t / 11) + 3000 * np.sin(t / 3.1)).astype(np.int16)
    coded = media.encode(sound, media.IMA_ADPCM)
    assert len(coded) == 25 * 64 and [x for a in range(0, len(coded), 64) for x in slow_adpcm(coded[a : a + 64])] == media.decode(np.frombuffer(coded, np.uint8), media.IMA_ADPCM).tolist()
    heard = media.decode(np.frombuffer(coded, np.uint8), media.IMA_ADPCM)[: len(sound)].astype(float)
    assert ((heard - sound) ** 2).mean() < 0.002 * (sound.astype(float) ** 2).mean()
    for tag in media.CODECS:
        made = media.sounds([media.wav(media.encode(sound, tag), tag)], 8000)[0]
        assert np.frombuffer(made, "<i2")[: len(sound)].tolist() == media.decode(np.frombuffer(media.encode(sound, tag), np.uint8), tag)[: len(sound)].tolist()


def slow_adpcm(block):
    value, place = struct.unpack_from("<h", block)[0], min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(media.STEPS[place])
            change = step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                change += part if code & bit else 0
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            place = max(0, min(88, place + int(media.MOVES[code & 7])))
            out.append(value)
    return out


def test_decoders():
    rng = np.random.default_rng(0)
    blocks = rng.integers(0, 256, (30, 64), dtype=np.uint8)
    assert media.adpcm(blocks).tolist() == [slow_adpcm(b.tobytes()) for b in blocks]
    mu, a = media.TABLES[media.MU_LAW], media.TABLES[media.A_LAW]
    assert (mu[0], mu[127], mu[128], mu[255]) == (-32124, 0, 32124, 0) and (a[0x2A], a[0xAA], a[0x55], a[0xD5]) == (-32256, 32256, -8, 8)
    for rates in ((8000, 4000), (8000, 16000), (8000, 6000), (11025, 8000), (8000, 8000)):
        runs = [rng.integers(-32768, 32768, n) for n in (1, 0, 2, 77, 300, 0, 5)]
        made, cuts = media.resample(np.concatenate(runs), np.cumsum([0, *map(len, runs)]), *rates)
        assert [made[a:b].tolist() for a, b in zip(cuts, cuts[1:])] == [slow_filter(r.tolist(), *rates) if rates[0] != rates[1] else r.tolist() for r in runs]


def test_the_filter_keeps_what_both_rates_hold():
    t = np.arange(8000)
    heard = lambda hz, to: media.resample((12000 * np.sin(2 * np.pi * hz * t / 8000)).astype(np.int16), np.array([0, len(t)]), 8000, to)[0].astype(float)
    power = lambda x: (x[200:-200] ** 2).mean() / (12000**2 / 2)
    # A tone well below 2 kHz stays at half the rate, one well above goes instead of coming back as another; so do the images that a higher rate could hold.
    assert abs(power(heard(500, 4000)) - 1) < 0.01 and abs(power(heard(1200, 4000)) - 1) < 0.01
    assert power(heard(2600, 4000)) < 1e-3 and power(heard(3500, 4000)) < 1e-4
    spectrum = np.abs(np.fft.rfft(heard(1000, 16000)[1000:-1000]))
    assert spectrum[len(spectrum) // 2 :].max() < spectrum.max() / 1000 and abs(power(heard(1000, 16000)) - 1) < 0.01


def test_files_of_all_codecs():
    rng = np.random.default_rng(0)
    blocks = rng.integers(0, 256, (30, 64), dtype=np.uint8)
    for tag in (media.MU_LAW, media.A_LAW, media.IMA_ADPCM):
        assert media.unwav(media.wav(blocks.tobytes(), tag)) == (tag, 8000, blocks.tobytes())


def test_media_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "x" * 64, 1), (3, "x" * 64, 1), (None, "é" * 100000, 1)], "doc_id long, text string, media int")
    rows = {(r.doc_id, r.n_bytes): r for r in media.digest(docs).collect()}
    assert media.digest(docs).count() == 5 and rows[1, 0].payload_bytes == 64 and rows[3, 64].payload_bytes == 64 and rows[None, 200000].payload_bytes == 200000
    assert rows[1, 0].feature == rows[2, 0].feature
    sound = media.with_pcm(media.stored(docs)).collect()
    for r in sound:
        tag, _, payload = media.unwav(r.media)
        assert len(r.pcm) == (len(payload) // 64 * 121 if tag == media.IMA_ADPCM else len(payload)) // 2 * 2
    assert media.with_pcm(spark.createDataFrame([(None,), (bytearray(media.wav(b"\0" * 64)),)], "media binary")).where("pcm IS NULL").count() == 1
    assert media.digest(docs.limit(0)).count() == 0
