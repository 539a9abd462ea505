"""Periodic runs, the divergence audit and telephony audio, each against a second, plain implementation."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteloom.llm import divergence, periodic, queries, telephony

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AWKWARD = [(1, "a b " * 9), (2, "a b " * 9), (3, None), (4, ""), (5, " \t\n"), (6, "x"), (6, "x"), (None, "no id no id no id no id no id"), (7, "é " * 3000), (8, "a\xa0b\x85c a\xa0b\x85c \x1c"), (9, "a A a A a A a A b b b b b b b")]


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def plain_runs(ids):
    """Every period, every word."""
    out = {}
    for p in range(1, len(ids) // 4 + 1):
        i = 0
        while i + p < len(ids):
            a = i
            while i + p < len(ids) and ids[i] == ids[i + p]:
                i += 1
            if i + p - a >= max(6, 4 * p):
                out.setdefault((a, i + p), p)
            i += 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def test_runs_equal_trying_every_period():
    rng = random.Random(5)
    for _ in range(1500):
        n, k = rng.randint(0, 150), rng.choice([1, 2, 2, 3, 5, 30])
        x = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            if n > 8:
                a, p = rng.randrange(n), rng.randint(1, 30)
                for i in range(a + p, min(n, a + p + rng.randint(0, 90))):
                    x[i] = x[i - p]
        assert periodic.find_runs(np.array(x, np.int64)) == plain_runs(x), x


def test_runs_of_long_sequences():
    """Work stays near n log n where everything repeats, where a template has one free word, and where nothing repeats."""
    n = 300_000
    assert periodic.find_runs(np.zeros(n, np.int64)) == [(0, n, 1)]
    free = np.arange(n) % 7
    free[::7] = np.arange(len(free[::7])) + 10
    assert periodic.find_runs(free) == []
    assert periodic.find_runs(np.concatenate([np.arange(1000), np.arange(70_001) % 10_007 + 5000, np.arange(1000) + 50_000])) == [(1000, 70_001, 10_007)]


def expected_runs(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def written(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).withColumns({c: F.lit(c) for c in ("runs", "collapsed", "n_words", "media", "payload", "pcm")}).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_op11(spark, tmp_path):
    rng = random.Random(2)
    rows = AWKWARD + [(100 + i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))) for i in range(150)]
    out = queries.op11_periodic_runs(spark, written(spark, tmp_path, rows, "doc_id long, text string"))
    assert Counter(map(tuple, out.collect())) == Counter(expected_runs(*r) for r in rows)
    assert sum(r.n_runs > 0 for r in out.collect()) > 20


def test_runs_keep_callers_columns(spark):
    docs = spark.createDataFrame([(1, "a a a a a a b")], "runs int, text string")
    out = periodic.repeats(docs.withColumn("mine", F.lit("m")))
    assert out.columns == ["mine", "n_words", "runs", "collapsed"] and out.first().collapsed == "a b"
    assert periodic.repeats(docs.where("false")).count() == 0


LANGS = [("a b c Ab", "en", "x"), ("a b é", "en", "y"), ("A b zebra zebra", "en", "x"), ("é É a1b", "en", None), (None, "en", "empty"), ("", None, None), ("solo", "de", "x"), ("solo", "de", "x"), ("a b c", None, "x"), ("a b c", None, "x"), ("a_b c", None, "y"), ("日本 a", "en", "y"), ("日本", "en", "y"), ("日本 b", "en", "z")]


def plain_audit(rows, least=3, most=200):
    docs = [(Counter(re.sub(r"[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")), lang or "", s or "") for t, lang, s in rows]
    out = []
    for lang in {x[1] for x in docs}:
        mine = [x for x in docs if x[1] == lang]
        df = Counter(w for c, _, _ in mine for w in c)
        kept = [w for w in df if df[w] >= least]
        count = defaultdict(Counter)
        for c, _, s in mine:
            count[s].update({w: c[w] for w in kept if w in c})
        everyone = sum(count.values(), Counter())
        p = lambda c: {w: 1 + 1000000000 * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept}  # noqa: E731, B023
        q, of = p(everyone), {s: p(c) for s, c in count.items()}
        f = lambda a, b: (a - b) ** 2 // b
        for s in of:
            for part, found in (("pair", [(o, sum(f(of[s][w], of[o][w]) for w in kept)) for o in of if o != s]), ("term", [(w, f(of[s][w], q[w])) for w in kept if count[s][w] and of[s][w] > q[w]])):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, w, v, k) for k, (w, v) in enumerate(ranked, 1) if part == "pair" or k <= most]
    return Counter(out)


def test_divergence_small_and_awkward(spark):
    docs = spark.createDataFrame(LANGS, "text string, lang string, source string").withColumns({c: F.lit(0) for c in ("term", "c", "n", "p", "total", "terms")})
    assert Counter(map(tuple, divergence.audit(docs).collect())) == plain_audit(LANGS)
    assert divergence.audit(docs.where("false")).count() == 0


def test_divergence_with_ties_at_the_last_rank(spark):
    """Few distinct counts, so the last rank is shared by many terms; small limits make the search stop early."""
    rng = random.Random(4)
    names = ["t" + "".join(chr(97 + int(c)) for c in str(i)) for i in range(400)]
    rows = [(" ".join(rng.choices(names, weights=[1 + (i % 5 == k % 5) * 3 for i in range(400)], k=60)), "en", f"s{k % 5}") for k in range(120)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    for most in (1, 7, 200):
        assert Counter(map(tuple, divergence.audit(docs, most=most).collect())) == plain_audit(rows, most=most)


def test_counts_flush_and_add_up(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 3)
    docs = spark.createDataFrame(LANGS, "text string, lang string, source string")
    got = divergence.counted(docs).groupBy("lang", "source", "term").sum("c").collect()
    want = Counter()
    for t, lang, s in LANGS:
        want[lang or "", s or "", ""] += 0
        for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or ""):
            want[lang or "", s or "", re.sub(r"[A-Z]", lambda m: m[0].lower(), w)] += 1
    assert {(r.lang, r.source, r.term): r["sum(c)"] for r in got} == dict(want)


def plain_adpcm(block):
    """One block, one code after the other."""
    at, index, out = struct.unpack_from("<h", block)[0], min(block[2], 88), []
    out.append(at)
    for b in block[4:]:
        for code in (b & 15, b >> 4):
            step = int(telephony.STEPS[index])
            moved = step >> 3
            if code & 4:
                moved += step
            if code & 2:
                moved += step >> 1
            if code & 1:
                moved += step >> 2
            at = max(-32768, min(32767, at - moved if code & 8 else at + moved))
            index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[code & 7]))
            out.append(at)
    return out


def test_decoders_equal_plain_ones():
    rng = np.random.default_rng(1)
    blocks = rng.integers(0, 256, (50, 68)).astype(np.uint8)
    assert telephony.decode_blocks(blocks).tolist() == [plain_adpcm(bytes(b)) for b in blocks]
    for b in range(256):
        u = ~b & 255
        size = (((u & 15) * 8 + 132) << ((u >> 4) & 7)) - 132
        assert telephony.TABLES["mulaw"][b] == (-size if u & 128 else size)
        a = b ^ 0x55
        e, m = a >> 4 & 7, a & 15
        size = (m * 16 + 8) if e == 0 else (m * 16 + 264) << (e - 1)
        assert telephony.TABLES["alaw"][b] == (size if a & 128 else -size)


def test_resampling_keeps_tones():
    for up, down in ((2, 1), (441, 80), (1, 2), (3, 2)):
        tone = lambda rate, n: np.sin(np.arange(n) / rate * 2 * np.pi * 440) * 10_000
        out = telephony.resample(tone(8000, 6000).astype(np.int16), up, down)
        assert len(out) == -(-6000 * up // down)
        assert np.abs(out - tone(8000 * up / down, len(out)))[200:-200].max() < 40
    assert telephony.resample(np.zeros(0, np.int16), 2, 1).size == 0


def test_files_are_read_as_written():
    payload = bytes(range(256)) * 2
    for codec in telephony.CODECS:
        file = telephony.store_bytes(payload, codec)
        name, rate, align, data = telephony.parse(file)
        assert (name, rate) == (codec, 8000) and telephony.stored_payload(name, align, data) == payload
        assert telephony.parse(file[:-9]) is None
    assert telephony.parse(b"") is None and telephony.parse(b"RIFF....WAVEfmt ") is None


def test_op13(spark, tmp_path):
    rng = random.Random(3)
    rows = AWKWARD + [(200 + i, "".join(rng.choice("ab é🙂 ") for _ in range(rng.randint(50, 140)))) for i in range(60)] + [(300, "z" * 64), (301, "z" * 64), (302, "z" * 65)]
    got = queries.op13_telephony(spark, written(spark, tmp_path, rows, "doc_id long, text string")).collect()
    seen, codecs = {}, set()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    of = defaultdict(list)
    for i, t in rows:
        of[i].append(t)
    for r in got:
        data = (of[r.doc_id][0] or "").encode()
        payload = data + b"\0" * (64 if not data else -len(data) % 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), sha(payload), zlib.crc32(payload[-64:]))
        file = telephony.store_bytes(payload, telephony.CODECS[zlib.crc32(payload) % 3])
        assert (r.media_bytes, r.media_sha256) == (len(file), sha(file))
        codec, _, align, stored = telephony.parse(file)
        codecs.add(codec)
        pcm = sum(([int(x) for x in plain_adpcm(stored[k : k + align])] for k in range(0, len(stored), align)), []) if codec == "adpcm" else [int(telephony.TABLES[codec][b]) for b in stored]
        wide = telephony.resample(np.array(pcm, np.int16), 2, 1).astype(int)
        rms = int((sum(int(x) ** 2 for x in wide) // len(wide)) ** 0.5)
        crossings = sum((a < 0) != (b < 0) for a, b in zip(wide, wide[1:]))
        assert r.feature == f"codec={codec};samples={len(wide)};peak={max(abs(wide))};rms={rms};crossings={crossings};pcm_crc32={zlib.crc32(wide.astype('<i2').tobytes())}"
        assert seen.setdefault(payload, r[2:]) == r[2:]
    assert codecs == set(telephony.CODECS)


def test_media_columns_of_other_files(spark):
    pcm = telephony.riff("pcm", np.arange(100, dtype="<i2").tobytes(), 16000)
    rows = [(1, pcm), (2, None), (3, b"nothing"), (4, pcm[:-3])]
    got = {r.k: r for r in telephony.decoded(spark.createDataFrame(rows, "k int, media binary").withColumn("codec", F.lit("mine"))).collect()}
    assert got[1].codec == "pcm" and got[1].samples == 100 and bytes(got[1].pcm) == pcm
    assert all(got[k].codec is None and got[k].payload is None for k in (2, 3, 4))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert telephony.decoded(telephony.store(empty)).count() == 0
    with pytest.raises(KeyError):
        telephony.riff("mp3", b"")
