"""Sound in blocks: files of samples, frames over blocks, gated loudness."""

import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import loudness, noise, signal
from tidemark.sources import sound


def blocks_of(spark, recordings, cuts):
    """Rows video_id, rate, first, samples of recordings (id, rate, samples) cut at the numbers given for each."""
    rows = []
    for video, rate, y in recordings:
        at = [0, *cuts.get(video, []), len(y)]
        rows += [(video, rate, a, [float(x) for x in y[a:b]]) for a, b in zip(at[:-1], at[1:], strict=True)]
    return spark.createDataFrame(rows, "video_id long, rate int, first long, samples array<double>").repartition(3)


def chunk(name, body):
    return struct.pack("<4sI", name, len(body)) + body + b"\0" * (len(body) % 2)


def riff(tag, channels, rate, bits, data, extra=b"", form=b"RIFF", length=None, sub=None):
    fmt = struct.pack("<HHIIHH", tag, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    fmt += struct.pack("<HHI", 22, bits, 0) + struct.pack("<H", sub) + b"\0" * 14 if sub else b""
    body = extra + chunk(b"fmt ", fmt) + struct.pack("<4sI", b"data", len(data) if length is None else length) + data
    return struct.pack("<4sI4s", form, len(body) + 4, b"WAVE") + body


def test_forms_of_samples(spark, tmp_path):
    y = np.array([0.0, 0.5, -0.5, -1.0])
    ints = {16: (y * 32768).astype("<i2"), 32: (y * 2**31).astype("<i4")}
    made = {
        "1_0": riff(1, 1, 8000, 8, (y * 128 + 128).astype("u1").tobytes()),
        "2_0": riff(1, 1, 8000, 16, ints[16].tobytes(), chunk(b"LIST", b"odd")),
        "3_0": riff(1, 1, 8000, 24, b"".join(int(v * 2**23).to_bytes(3, "little", signed=True) for v in y)),
        "4_0": riff(1, 1, 8000, 32, ints[32].tobytes()),
        "5_0": riff(3, 1, 8000, 64, y.astype("<f8").tobytes(), length=0xFFFFFFFF),
        "6_0": riff(0xFFFE, 2, 8000, 32, np.stack([y, np.zeros(4)], 1).astype("<f4").tobytes(), sub=3),
        "7_0": riff(1, 1, 8000, 16, ints[16].tobytes(), chunk(b"ds64", struct.pack("<QQQI", 0, 8, 4, 0)), b"RF64", 0xFFFFFFFF),
        "8_0": riff(1, 1, 8000, 16, ints[16].tobytes()[:-1]),
        "9_0": riff(1, 1, 8000, 16, b""),
    }
    for name, data in made.items():
        (tmp_path / f"{name}.wav").write_bytes(data)
    (tmp_path / "_attempt").mkdir()
    (tmp_path / "_attempt" / "1_0.wav").write_bytes(b"half a file")
    got = {r.video_id: list(r.samples) for r in sound.read_waves(spark, str(tmp_path)).collect()}
    want = {k: y.tolist() for k in range(1, 8)} | {6: (y / 2).tolist(), 8: y[:3].tolist()}
    assert got == want
    (tmp_path / "bad_0.wav").write_bytes(b"RIFFxxxxWAVEjunk")
    with pytest.raises(Exception, match="bad_0"):
        sound.read_waves(spark, str(tmp_path)).collect()


def test_waves_by_byte_range(spark, tmp_path):
    """Blocks are whole wherever the ranges are cut, and each is read once; files are readable by others."""
    rng = np.random.default_rng(1)
    made = [(v, 16000, rng.integers(-32768, 32768, n) / 32768) for v, n in ((1, 5000), (2, 37), (3, 1))]
    cuts = {1: list(range(500, 5000, 500))}
    path = f"file:{tmp_path}/waves"
    rows = blocks_of(spark, made, cuts).union(spark.createDataFrame([(4, 1, 0, []), (None, 1, 0, [0.1])], "video_id long, rate int, first long, samples array<double>"))
    sound.write_waves(rows, path, part=1500)
    assert sorted(p.name for p in (tmp_path / "waves").iterdir() if p.suffix == ".wav") == sorted(["1_0.wav", "1_1500.wav", "1_3000.wav", "1_4500.wav", "2_0.wav", "3_0.wav"])
    assert not [p for p in (tmp_path / "waves").iterdir() if p.is_dir()]
    with wave.open(str(tmp_path / "waves" / "1_1500.wav")) as w:
        assert (w.getnframes(), w.getframerate(), w.getnchannels()) == (1500, 16000, 1)
    for block, span in ((100, 333), (256, 1 << 20), (7, 64)):
        got = sound.read_waves(spark, path, block, span).collect()
        for video, rate, y in made:
            own = sorted((r for r in got if r.video_id == video), key=lambda r: r.first)
            assert np.array_equal(np.concatenate([r.samples for r in own]), y.astype(np.float32)) and {r.rate for r in own} == {rate}
            assert [r.first for r in own] == np.cumsum([0] + [len(r.samples) for r in own])[:-1].tolist()
            assert block != 100 or all(len(r.samples) == 100 for r in own[:-1])


def test_frames_over_blocks(spark):
    """Blocks of a recording give the frames of the whole, wherever it is cut and whatever the frame's length and step."""
    rng = np.random.default_rng(2)
    made = [(v, 800, rng.normal(size=n)) for v, n in ((1, 1000), (2, 200), (3, 64), (4, 65), (5, 3), (6, 1), (7, 129))]
    cuts = {1: [64, 200, 331, 995], 2: [100], 4: [64], 7: [64, 128]}
    for frame, hop in ((64, 16), (64, 64), (33, 10), (8, 20)):
        whole = spark.createDataFrame([(v, r, y.tolist()) for v, r, y in made], "video_id long, rate int, samples array<double>")
        want = sorted(tuple(r) for r in signal.frame_features(whole, frame, hop).collect())
        got = sorted(tuple(r) for r in signal.frame_features(blocks_of(spark, made, cuts), frame, hop).collect())
        assert [r[:2] for r in got] == [r[:2] for r in want]
        assert np.allclose(got, want, rtol=1e-9, atol=1e-12)
    gap = blocks_of(spark, made[:1], cuts).where("first <> 200")
    with pytest.raises(Exception, match="do not follow"):
        signal.frame_features(gap, 64, 16).collect()
    with pytest.raises(Exception, match="shorter than a frame"):
        signal.frame_features(blocks_of(spark, made[:1], {1: [100, 120]}), 64, 16).collect()
    assert signal.frame_features(blocks_of(spark, made[:1], {}).withColumn("samples", F.lit(None).cast("array<double>")), 64, 16).count() == 0


def plain_loudness(y, rate, weights):
    """One recording, sample by sample."""
    for top, low in weights(rate):
        out, s, u = [], 0.0, 0.0
        for x in y:
            v = top[0] * x + s
            s, u = top[1] * x - low[1] * v + u, top[2] * x - low[2] * v
            out.append(v)
        y = out
    n = round((len(y) / rate - 0.4) / 0.1) + 1 if len(y) / rate >= 0.4 else 0
    power = [sum(v * v for v in y[int(0.1 * j * rate + 1e-9) : int(0.1 * (j + 4) * rate + 1e-9)]) / (0.4 * rate) for j in range(n)]
    loud = lambda z: -0.691 + 10 * np.log10(z)
    past = [z for z in power if z > 0 and loud(z) >= -70]
    past = [z for z in past if loud(z) > loud(np.mean(past)) - 10 and loud(z) > -70]
    return n, len(past), loud(np.mean(past)) if past else None


def test_published_coefficients():
    """The published filters at 48 kHz, as near as the frequencies in whole Hertz allow."""
    (top, low), (_, pass_low) = loudness.ear(48000)
    assert np.allclose(top, [1.53512485958697, -2.69169618940638, 1.19839281085285], atol=0.05)
    assert np.allclose(low, [1, -1.69065929318241, 0.73248077421585], atol=0.05)
    assert np.allclose(pass_low, [1, -1.99004745483398, 0.99007225036621], atol=1e-3)


def test_gated_loudness(spark):
    """Any cut into blocks, odd rates, silence, short recordings and tones equal the plain form."""
    rng = np.random.default_rng(3)
    tone = np.sin(np.arange(20000) * 2 * np.pi * 997 / 8000)
    made = [(1, 8000, tone), (2, 8000, rng.normal(size=9000) * np.repeat([1, 1e-3, 1e-5], 3000)), (3, 8000, np.zeros(5000)), (4, 8000, tone[:3199]), (5, 8000, tone[:3200]), (6, 11025, rng.normal(size=15001) * 0.01), (7, 7350, rng.normal(size=8000) * 1e-9), (8, 8000, tone[:3650])]
    cuts = {1: [5000, 10000, 10100, 10101, 15000], 2: [3000, 6000], 6: list(range(1000, 15000, 1000)), 8: [1]}
    got = {r.video_id: r for r in loudness.gated_loudness(blocks_of(spark, made, cuts)).collect()}
    for video, rate, y in made:
        n, gated, level = plain_loudness(y.tolist(), rate, loudness.ear)
        r = got[video]
        assert (r.blocks, r.gated) == (n, gated)
        assert r.loudness is None if level is None else abs(r.loudness - level) < 1e-8
    assert abs(got[1].loudness - -3.01) < 0.3 and got[3].loudness is None and got[4].loudness is None


def test_louder(spark):
    tone = np.sin(np.arange(8000) * 2 * np.pi * 500 / 8000)
    made = [(1, 8000, tone * 0.01), (2, 8000, tone), (3, 8000, np.zeros(4000)), (4, 8000, tone[:1000] * 0.01)]
    rows = blocks_of(spark, made, {1: [4000]}).withColumn("extra", F.lit("x"))
    gain = {r.video_id: r.gain for r in loudness.gains(rows).collect()}
    level = plain_loudness((tone * 0.01).tolist(), 8000, loudness.ear)[2]
    assert abs(gain[1] - (0.7 * 10 ** ((-18 - level) / 20) + 0.3)) < 1e-6 and gain[2] == gain[3] == 1
    assert abs(gain[4] - 0.08 / np.sqrt(np.mean((tone[:1000] * 0.01) ** 2)) * 0.8) < 1e-6
    out = loudness.louder(rows).where("video_id = 1 AND first = 4000").first()
    assert np.allclose(out.samples, tone[4000:] * 0.01 * gain[1]) and out.extra == "x"
    assert loudness.gated_loudness(rows.limit(0)).count() == 0


def plain_reduced(y, level, frames, cuts):
    """A whole recording, frame by frame; the floor is read from the frames that no cut crosses."""
    how, length, hop = noise.LEVELS[level], frames.length, frames.hop
    window = np.hanning(length + 1)[:-1]
    wide = 2 * length + frames.times * hop
    wide += -wide % hop
    z = np.pad(y, (wide, 2 * wide))
    starts = range(0, len(z) - length, hop)
    spectra = np.array([np.fft.rfft(z[a : a + length] * window) for a in starts])
    level_db = 20 * np.log10(np.maximum(np.abs(spectra), 1e-30))
    bounds = [0, *cuts, len(y)]
    inside = [k for k, a in enumerate(starts) if any(lo <= a - wide and a - wide + length <= hi for lo, hi in zip(bounds[:-1], bounds[1:], strict=True))]
    floor = []
    for band in range(length // 2 + 1):
        held = sorted(int(np.floor(v)) for v in level_db[inside, band] if v >= noise.LOWEST)
        floor.append(held[int(np.ceil(how.share * len(held))) - 1] + 1 if held else noise.LOWEST)
    mask = np.clip((level_db - floor - how.margin) / how.slope, 0, 1)
    b, t = frames.bands // 2, frames.times // 2
    mask = np.array([[np.mean([row[min(max(j, 0), len(row) - 1)] for j in range(i - b, i + b + 1)]) for i in range(len(row))] for row in mask])
    mask = np.array([mask[max(0, i - t) : i + t + 1].mean(axis=0) for i in range(len(mask))])
    out, weight = np.zeros(len(z)), np.zeros(len(z))
    for a, s, m in zip(starts, spectra, mask, strict=True):
        out[a : a + length] += np.fft.irfft(s * (1 - how.amount * (1 - m)), length) * window
        weight[a : a + length] += window**2
    return (out / np.maximum(weight, 1e-12))[wide : wide + len(y)]


def test_noise_over_blocks(spark):
    """Blocks give what the whole recording gives."""
    rng = np.random.default_rng(4)
    made = [(v, 8000, rng.normal(size=n) * 0.01 + np.sin(np.arange(n) * 0.3) * (np.arange(n) % 900 > 600)) for v, n in ((1, 4000), (2, 1500), (3, 64), (4, 300))]
    cuts = {1: [1003, 2000, 3300, 3990], 2: [640], 4: [290]}
    rows = blocks_of(spark, made, cuts).withColumn("extra", F.lit("x"))
    frames = noise.Frames(64, 16, 3, 5)
    for level in noise.LEVELS:
        got = noise.reduced(rows, level, frames).collect()
        assert len(got) == rows.count() and {r.extra for r in got} == {"x"}
        for video, _, y in made:
            own = np.concatenate([r.samples for r in sorted((r for r in got if r.video_id == video), key=lambda r: r.first)])
            assert np.allclose(own, plain_reduced(y, level, frames, cuts.get(video, [])), atol=1e-9)
    odd = spark.createDataFrame([(1, 8, 0, [0.5, 0.25]), (2, 8, 0, []), (3, 8, 0, None), (None, 8, 0, [1.0])], "video_id long, rate int, first long, samples array<double>")
    assert sorted(map(str, noise.reduced(odd).collect())) == sorted(str(r) for r in odd.select("video_id", "first", "rate", "samples").collect())
    with pytest.raises(Exception, match="shorter than"):
        noise.reduced(blocks_of(spark, made[:1], {1: [1000, 1010]}), "gentle", frames).collect()


def test_noise_falls_and_talk_stays(spark):
    rng = np.random.default_rng(5)
    n = 60000
    talk = np.sin(np.arange(n) * 2 * np.pi * 440 / 16000) * 0.3
    talk[(np.arange(n) // 10000) % 2 == 0] = 0
    y = talk + rng.normal(size=n) * 0.005
    quiet = np.concatenate([np.arange(a + 2000, a + 8000) for a in (0, 20000, 40000)])
    loud = quiet + 10000
    for level, share in (("gentle", 0.8), ("moderate", 0.95), ("strong", 0.98)):
        got = noise.reduced(blocks_of(spark, [(1, 16000, y)], {1: [20000, 40000]}), level).collect()
        out = np.concatenate([r.samples for r in sorted(got, key=lambda r: r.first)])
        assert (out[quiet] ** 2).sum() < (1 - share) * (y[quiet] ** 2).sum()
        assert 0.95 < (out[loud] ** 2).sum() / (talk[loud] ** 2).sum() < 1.01
