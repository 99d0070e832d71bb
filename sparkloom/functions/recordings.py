"""Audio, video and HDF5 files.

WAV files of whole samples are read here; other audio needs ``soundfile``, video ``av`` and
HDF5 ``h5py`` on the workers.  A task holds one file at a time.
"""

from __future__ import annotations

import io
import json
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.media import IMAGE, _image, file_path, open_path

AUDIO_METADATA = "struct<sample_rate:long,channels:long,frames:double,format:string,subtype:string>"
VIDEO_METADATA = "struct<width:long,height:long,fps:double,frame_count:long,time_base:double>"
VIDEO_FRAME = f"struct<frame_index:long,frame_time:double,frame_time_base:string,frame_pts:long,frame_dts:long,frame_duration:long,is_key_frame:boolean,data:{IMAGE}>"
HDF5_OBJECT = "struct<h5path:string,kind:string,shape:array<long>,dtype:string,chunks:array<long>,compression:string>"

#: zero crossings of the resampling kernel on each side, and output samples made at a time
_CROSSINGS, _BLOCK = 16, 1 << 14
#: samples that are sent to Spark at a time, in bytes
_RESAMPLED_BYTES = 8 << 20


def _content(path: str) -> io.BytesIO:
    system, at = open_path(path)
    with system.open_input_stream(at) as got:
        return io.BytesIO(got.read())


def _of_files(f, schema: str, read: Callable) -> Column:
    """``read(content)`` for each file; null for null."""

    @F.udf(schema)
    def run(path):
        return None if path is None else read(_content(path))

    return run(file_path(f))


# Audio.


def _wav(content: io.BytesIO):
    """(samples from -1 to 1 by frame and channel, rate, bytes a sample), or None if it's another format."""
    import wave

    try:
        with wave.open(content) as w:
            width, channels, rate, raw = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(w.getnframes())
    except (wave.Error, EOFError):
        content.seek(0)
        return None
    if width == 1:  # unsigned, all wider ones are signed
        samples = np.frombuffer(raw, np.uint8).astype(np.int64) - 128
    elif width in (2, 4):
        samples = np.frombuffer(raw, f"<i{width}")
    else:
        split = np.frombuffer(raw, np.uint8).reshape(-1, width).astype(np.int64)
        samples = (split << (8 * np.arange(width))).sum(1)
        samples -= (samples >> (8 * width - 1)) << (8 * width)
    return samples.reshape(-1, channels) / float(1 << (8 * width - 1)), rate, width


def _metadata(content: io.BytesIO) -> dict:
    if (wav := _wav(content)) is not None:
        samples, rate, width = wav
        return {"sample_rate": rate, "channels": samples.shape[1], "frames": float(len(samples)), "format": "WAV", "subtype": "PCM_U8" if width == 1 else f"PCM_{8 * width}"}
    import soundfile

    with soundfile.SoundFile(content) as s:
        return {"sample_rate": s.samplerate, "channels": s.channels, "frames": float(s.frames), "format": s.format, "subtype": s.subtype}


def audio_metadata(f) -> Column:
    return _of_files(f, AUDIO_METADATA, _metadata)


def _spread(samples: np.ndarray, at: np.ndarray, cut: float, reach: int) -> np.ndarray:
    """Values at places between samples; what lies beyond the ends has no weight."""
    near = np.floor(at).astype(np.int64)[:, None] + np.arange(1 - reach, reach + 1)
    off = near - at[:, None]
    weight = np.sinc(cut * off) * np.cos(np.pi / 2 * np.clip(off / reach, -1, 1)) ** 2
    weight[(near < 0) | (near >= len(samples))] = 0
    weight /= weight.sum(1, keepdims=True)
    return np.einsum("ot,otc->oc", weight, samples[np.clip(near, 0, len(samples) - 1)])


def resampled(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Samples by frame and channel at another rate: a windowed sinc that cuts at the lower rate's
    band, with weights that sum to 1.  ceil(n * to / rate) frames.

    Away from the ends the weights recur with each ``to / gcd`` outputs, so they are made once."""
    if rate == to or not len(samples):
        return samples
    cut = min(1.0, to / rate)
    reach = int(np.ceil(_CROSSINGS / cut))
    n, g = len(samples), math.gcd(rate, to)
    up, down = to // g, rate // g
    out = np.empty((-(-n * to // rate), samples.shape[1]))
    first = min(-(-reach * up // down), len(out))  # from here on nothing lies before the start, from last on something beyond the end
    last = max(min((n - reach - 1) * up // down, len(out)), first)
    if last - first < 2 * up:
        last = first
    edges = np.r_[0:first, last : len(out)] if last > first else np.arange(len(out))
    for k in range(0, len(edges), _BLOCK):
        places = edges[k : k + _BLOCK]
        out[places] = _spread(samples, places * (rate / to), cut, reach)
    if last == first:
        return out
    columns = [np.ascontiguousarray(samples[:, c]) for c in range(samples.shape[1])]
    for start in range(first, min(first + up, last)):
        phase = start * down % up / up
        off = np.arange(1 - reach, reach + 1) - phase
        weight = np.sinc(cut * off) * np.cos(np.pi / 2 * np.clip(off / reach, -1, 1)) ** 2
        weight /= weight.sum()
        at = start * down // up + 1 - reach
        count = -(-(last - start) // up)
        for c, x in enumerate(columns):
            for k in range(0, count, _BLOCK):
                windows = np.lib.stride_tricks.as_strided(x[at + k * down :], (min(_BLOCK, count - k), 2 * reach), (down * x.strides[0], x.strides[0]), writeable=False)
                out[start + k * up : last : up, c][: len(windows)] = windows @ weight
    return out


def resample(f, sample_rate: int) -> Column:
    """A file's samples at a rate, as a tensor: by frame if there's one channel, else by frame and channel."""

    def read(content: io.BytesIO) -> tuple[np.ndarray, list[int]]:
        if (wav := _wav(content)) is not None:
            samples, rate, _ = wav
        else:
            import soundfile

            samples, rate = soundfile.read(content, always_2d=True)
        made = resampled(samples, rate, sample_rate)
        return made.ravel(), list(made.shape if made.shape[1] > 1 else made.shape[:1])

    @F.pandas_udf("struct<data:array<double>,shape:array<int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for paths in batches:
            data, shapes, size = [], [], 0
            for path in paths:
                x, shape = (None, None) if path is None else read(_content(path))
                data.append(x)
                shapes.append(shape)
                size += 0 if x is None else x.nbytes
                if size >= _RESAMPLED_BYTES:
                    yield pd.DataFrame({"data": data, "shape": shapes}, dtype=object)
                    data, shapes, size = [], [], 0
            if data:
                yield pd.DataFrame({"data": data, "shape": shapes}, dtype=object)

    return run(file_path(f))


# Video.


def video_metadata(f) -> Column:
    def read(content: io.BytesIO) -> dict:
        import av

        with av.open(content) as box:
            v = box.streams.video[0]
            fps, base = (float(x) if x else None for x in (v.average_rate or v.guessed_rate, v.time_base))
            count = v.frames or (round(box.duration / av.time_base * fps) if box.duration and fps else None)
            return {"width": v.width, "height": v.height, "fps": fps, "frame_count": count, "time_base": base}

    return _of_files(f, VIDEO_METADATA, read)


def decoded_frames(content: io.BytesIO, start_time: float = 0, end_time: float | None = None, width: int | None = None, height: int | None = None, is_key_frame: bool | None = None, sample_interval_seconds: float | None = None) -> Iterator[dict]:
    """Frames from start to end, both included.  With an interval, the first frame at or after each
    multiple of it from the start; a frame without a time is then left out."""
    import av

    if (width is None) != (height is None):
        raise ValueError("width and height go together")
    with av.open(content) as box:
        due = start_time
        for k, frame in enumerate(box.decode(video=0)):
            t = frame.time
            if t is not None and end_time is not None and t > end_time:
                return
            if (t is not None and t < start_time) or (is_key_frame is not None and bool(frame.key_frame) != is_key_frame):
                continue
            if sample_interval_seconds:
                if t is None or t < due:
                    continue
                due = start_time + (np.floor((t - start_time) / sample_interval_seconds) + 1) * sample_interval_seconds
            pixels = frame.to_ndarray(format="rgb24", **({} if width is None else {"width": width, "height": height}))
            yield {"frame_index": k, "frame_time": t, "frame_time_base": str(frame.time_base), "frame_pts": frame.pts, "frame_dts": frame.dts, "frame_duration": getattr(frame, "duration", None), "is_key_frame": bool(frame.key_frame), "data": _image(pixels)}


def video_frames(f, start_time: float = 0, end_time: float | None = None, width: int | None = None, height: int | None = None, is_key_frame: bool | None = None, sample_interval_seconds: float | None = None) -> Column:
    return _of_files(f, f"array<{VIDEO_FRAME}>", lambda c: list(decoded_frames(c, start_time, end_time, width, height, is_key_frame, sample_interval_seconds)))


def video_keyframes(f, start_time: float = 0, end_time: float | None = None) -> Column:
    return _of_files(f, f"array<{IMAGE}>", lambda c: [x["data"] for x in decoded_frames(c, start_time, end_time, is_key_frame=True)])


def get_video_frame_by_idx(f, idx: int) -> Column:
    """The frame at a place, from 0; null beyond the last."""
    return _of_files(f, IMAGE, lambda c: next((x["data"] for x in decoded_frames(c) if x["frame_index"] == idx), None))


# HDF5.


def hdf5_keys(f, group: str = "/") -> Column:
    def read(content: io.BytesIO) -> list[str]:
        import h5py

        with h5py.File(content, "r") as h:
            return list(h[group])

    return _of_files(f, "array<string>", read)


def hdf5_metadata(f, group: str = "/") -> Column:
    """All objects below a group."""

    def read(content: io.BytesIO) -> list[dict]:
        import h5py

        found = []

        def see(name: str, x) -> None:
            data = isinstance(x, h5py.Dataset)
            found.append({"h5path": f"{group.rstrip('/')}/{name}", "kind": "dataset" if data else "group", "shape": list(x.shape) if data else [], "dtype": str(x.dtype) if data else "", "chunks": list(x.chunks or ()) if data else [], "compression": (x.compression or "") if data else ""})

        with h5py.File(content, "r") as h:
            h[group].visititems(see)
        return found

    return _of_files(f, f"array<{HDF5_OBJECT}>", read)


def hdf5_attrs(f, h5path: str = "/") -> Column:
    """Attributes by name, each as JSON."""

    def read(content: io.BytesIO) -> dict[str, str]:
        import h5py

        with h5py.File(content, "r") as h:
            return {k: json.dumps(v.tolist() if hasattr(v, "tolist") else v, default=str) for k, v in h[h5path].attrs.items()}

    return _of_files(f, "map<string,string>", read)
