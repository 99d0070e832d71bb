"""Audio read and resampled, against tones that are known at any rate."""

import io
import wave

import numpy as np
import pytest

from sparkloom.functions import recordings as R


def _tone(rate: int, n: int, hertz: float) -> np.ndarray:
    return np.sin(2 * np.pi * hertz * np.arange(n) / rate)[:, None]


@pytest.mark.parametrize("to", [4000, 11025, 16000, 44100])
def test_resampled_tone(to):
    out = R.resampled(_tone(8000, 8000, 440), 8000, to)
    assert out.shape == (to, 1)
    inner = slice(to // 10, -to // 10)
    assert np.abs(out - _tone(to, to, 440))[inner].max() < 2e-3


def test_what_a_lower_rate_cannot_hold_is_cut():
    assert np.abs(R.resampled(_tone(8000, 8000, 3500), 8000, 4000)[400:-400]).max() < 0.02


def test_empty_and_equal_rate():
    assert R.resampled(np.empty((0, 1)), 8000, 16000).shape == (0, 1)
    same = _tone(8000, 10, 440)
    assert R.resampled(same, 8000, 8000) is same


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_wav_widths(width):
    top = 1 << (8 * width - 1)
    values = [-top, -1, 0, 1, top - 1, 5]
    raw = b"".join((v + 128).to_bytes(1, "little") if width == 1 else v.to_bytes(width, "little", signed=True) for v in values)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(width)
        w.setframerate(8000)
        w.writeframes(raw)
    out.seek(0)
    samples, rate, read = R._wav(out)
    assert (rate, read, samples.shape) == (8000, width, (3, 2))
    assert (samples.ravel() * top).round().astype(np.int64).tolist() == values
    out.seek(0)
    assert R._metadata(out)["subtype"] == ("PCM_U8" if width == 1 else f"PCM_{8 * width}")


def test_another_format_is_none():
    assert R._wav(io.BytesIO(b"no sound at all")) is None


@pytest.mark.parametrize("rate, to", [(8000, 16000), (8000, 11025), (44100, 8000), (48000, 44100), (3, 2), (7, 5), (16000, 8000), (8000, 8001)])
@pytest.mark.parametrize("n", [1, 9, 33, 40, 500, 20011])
def test_resampled_by_phases_as_by_places(rate, to, n):
    """Weights made once for each phase against weights made for each place."""
    x = np.random.default_rng(n).normal(size=(n, 2))
    cut = min(1.0, to / rate)
    places = np.arange(-(-n * to // rate)) * (rate / to)
    want = np.concatenate([R._spread(x, places[k : k + 4096], cut, int(np.ceil(16 / cut))) for k in range(0, len(places), 4096)])
    assert np.abs(R.resampled(x, rate, to) - want).max() < 1e-9


def test_resampled_hour_in_seconds():
    """An hour's samples at twice their rate, and never more at a time than a few times their bytes."""
    import time

    start = time.time()
    out = R.resampled(np.full((8000 * 3600, 1), 0.125), 8000, 16000)
    assert time.time() - start < 20 and out.shape == (16000 * 3600, 1) and np.abs(out - 0.125).max() < 1e-9


def test_upload_shows_whole_files_only(tmp_path):
    """Who reads a name while its bytes are written again gets all of them."""
    import threading

    from pyarrow import fs

    from sparkloom.functions.media import _put

    data, at, system = bytes(range(256)) * 65536, f"{tmp_path}/same", fs.LocalFileSystem()
    _put(system, at, data)
    writers = [threading.Thread(target=lambda: [_put(system, at, data) for _ in range(8)]) for _ in range(3)]
    for w in writers:
        w.start()
    seen = set()
    while any(w.is_alive() for w in writers):
        with system.open_input_stream(at) as got:
            seen.add(got.read() == data)
    assert seen == {True}
    assert [p.name for p in tmp_path.iterdir()] == ["same"]


def test_upload_of_many_equal_texts(spark, tmp_path):
    from pyspark.sql import functions as F

    from sparkloom import functions as X

    rows = spark.range(0, 400, 1, 8).selectExpr("id", "repeat(cast(id % 2 AS string), 3000000) AS text")
    out = rows.select("id", F.length(X.download(X.upload(F.encode("text", "utf-8"), f"file://{tmp_path}/up"))).alias("n"))
    assert out.where("n = 3000000").count() == 400
