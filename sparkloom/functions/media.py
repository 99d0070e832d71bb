"""Files, URLs and images as columns.

A file is a struct of path, offset and length; an image is a struct of height,
width, channels, mode and data (8-bit rows).  Decoders that aren't installed
are imported when a task first needs them.
"""

from __future__ import annotations

import re
import struct
import zlib
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions._base import col

IMAGE = "struct<height:int,width:int,channels:int,mode:string,data:binary>"
_MODES = {1: "L", 2: "LA", 3: "RGB", 4: "RGBA"}
_COUNT = {v: k for k, v in _MODES.items()}


def file(url) -> Column:
    return F.struct(col(url).alias("path"), F.lit(None).cast("long").alias("offset"), F.lit(None).cast("long").alias("length"))


video_file = audio_file = image_file = hdf5_file = file


def file_path(f) -> Column:
    return col(f)["path"]


def open_path(path: str):
    """pyarrow's file system for a path; s3a:// and s3n:// are s3://."""
    from pyarrow import fs

    path = re.sub("^s3[an]://", "s3://", path)
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _info(path: str):
    system, at = open_path(path)
    return system.get_file_info(at)


def file_size(f) -> Column:
    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else _info(p).size for p in s], dtype="Int64")

    return run(file_path(f))


def file_exists(f) -> Column:
    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else _info(p).type.name != "NotFound" for p in s], dtype=object)

    return run(file_path(f))


def download(expr, max_connections: int = 32, on_error: str = "raise") -> Column:
    """The bytes behind each path or URL, fetched by a few threads in each task."""

    def one(path: str | None) -> bytes | None:
        if path is None:
            return None
        try:
            if path.startswith(("http://", "https://")):
                from urllib.request import urlopen

                with urlopen(path, timeout=60) as got:
                    return got.read()
            system, at = open_path(path)
            with system.open_input_stream(at) as got:
                return got.read()
        except Exception:
            if on_error == "raise":
                raise
            return None

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(max_connections) as pool:
            return pd.Series(list(pool.map(one, s)), dtype=object)

    return run(col(expr))


def _put(system, at: str, data: bytes) -> None:
    """Write a file whole: under its name there is never a part of it, whoever writes or reads it at the same time.
    Object stores do so by themselves."""
    from pyarrow import fs

    if isinstance(system, fs.LocalFileSystem) or system.type_name in ("hdfs", "subtree"):
        hidden = f"{at}.{uuid4().hex}.part"
        try:
            with system.open_output_stream(hidden) as to:
                to.write(data)
            try:
                system.move(hidden, at)
            except OSError:  # HDFS moves nothing onto a file; that one has the same digest
                if system.get_file_info(at).size != len(data):
                    raise
                system.delete_file(hidden)
        except Exception:
            if system.get_file_info(hidden).is_file:
                system.delete_file(hidden)
            raise
    else:
        with system.open_output_stream(at) as to:
            to.write(data)


def upload(expr, location, on_error: str = "raise") -> Column:
    """Write bytes below a folder under the name of their digest; gives the paths.  Equal bytes of several
    tasks have one name."""

    @F.pandas_udf("string")
    def run(s: pd.Series, where: pd.Series) -> pd.Series:
        import hashlib

        out, made = [], set()
        for b, folder in zip(s, where, strict=True):
            if b is None:
                out.append(None)
                continue
            b = b.encode() if isinstance(b, str) else bytes(b)
            path = f"{folder.rstrip('/')}/{hashlib.sha256(b).hexdigest()}"
            try:
                system, at = open_path(path)
                if (parent := at.rpartition("/")[0]) not in made:
                    system.create_dir(parent, recursive=True)
                    made = {parent}
                _put(system, at, b)
                out.append(path)
            except Exception:
                if on_error == "raise":
                    raise
                out.append(None)
        return pd.Series(out, dtype=object)

    return run(col(expr), location if isinstance(location, Column) else F.lit(location))


def guess_mime_type(expr) -> Column:
    """By the first bytes; null for what isn't known."""
    head = F.hex(F.substring(col(expr), 1, 16))
    known = (("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"), ("474946383761", "image/gif"), ("474946383961", "image/gif"), ("25504446", "application/pdf"), ("504B0304", "application/zip"), ("1F8B", "application/gzip"), ("494433", "audio/mpeg"), ("4F676753", "audio/ogg"), ("664C6143", "audio/flac"), ("1A45DFA3", "video/webm"), ("424D", "image/bmp"), ("49492A00", "image/tiff"), ("4D4D002A", "image/tiff"))
    out = F.when(head.like("52494646________57415645%"), "audio/wav").when(head.like("52494646________57454250%"), "image/webp").when(F.substring(head, 9, 8) == "66747970", "video/mp4")
    for magic, kind in known:
        out = out.when(head.startswith(magic), kind)
    return out


def png_bytes(height: int, width: int, channels: int, data: bytes) -> bytes:
    lines = np.zeros((height, width * channels + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(data, np.uint8).reshape(height, -1)
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, {1: 0, 2: 4, 3: 2, 4: 6}[channels], 0, 0, 0)) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


def png_pixels(b: bytes) -> np.ndarray:
    """Pixels of an 8-bit PNG without a palette or interlacing."""
    at, data, head = 8, b"", None
    if b[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    while at < len(b):
        n = struct.unpack_from(">I", b, at)[0]
        if b[at + 4 : at + 8] == b"IHDR":
            head = struct.unpack(">IIBBBBB", b[at + 8 : at + 21])
        elif b[at + 4 : at + 8] == b"IDAT":
            data += b[at + 8 : at + 8 + n]
        at += 12 + n
    w, h, depth, kind, _, _, lace = head
    if depth != 8 or kind == 3 or lace:
        raise ValueError("this kind of PNG isn't known")
    c = {0: 1, 4: 2, 2: 3, 6: 4}[kind]
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, w * c + 1).astype(np.int32)
    out = np.zeros((h + 1, w * c + c), np.int32)
    for y in range(h):
        f, line, up = lines[y, 0], lines[y, 1:], out[y]
        row = out[y + 1]
        if f == 0:
            row[c:] = line
        elif f == 2:
            row[c:] = line + up[c:] & 255
        else:
            for x in range(c, w * c + c):
                a, u, d = int(row[x - c]), int(up[x]), int(up[x - c])
                if f == 1:
                    add = a
                elif f == 3:
                    add = (a + u) // 2
                else:
                    p = a + u - d
                    add = min((abs(p - a), 0, a), (abs(p - u), 1, u), (abs(p - d), 2, d))[2]
                row[x] = line[x - c] + add & 255
    return out[1:, c:].astype(np.uint8).reshape(h, w, c)


def _pixels(v) -> np.ndarray:
    return np.frombuffer(bytes(v["data"]), np.uint8).reshape(v["height"], v["width"], v["channels"])


def _image(p: np.ndarray) -> dict:
    return {"height": p.shape[0], "width": p.shape[1], "channels": p.shape[2], "mode": _MODES[p.shape[2]], "data": p.tobytes()}


def _decoded(b: bytes) -> np.ndarray:
    try:
        return png_pixels(b)
    except ValueError:
        import io

        from PIL import Image

        image = Image.open(io.BytesIO(b))
        image = image if image.mode in _COUNT else image.convert("RGB")
        return np.asarray(image).reshape(image.height, image.width, -1)


def _image_map(f):
    """A column of images from f(image as pixels)."""

    @F.pandas_udf(IMAGE)
    def run(v: pd.DataFrame) -> pd.DataFrame:
        rows = [dict.fromkeys(("height", "width", "channels", "mode", "data")) if pd.isna(r["height"]) else _image(f(_pixels(r))) for r in v.to_dict("records")]
        return pd.DataFrame(rows, columns=["height", "width", "channels", "mode", "data"])

    return run


def decode_image(expr, on_error: str = "raise", mode: str | None = None) -> Column:
    @F.pandas_udf(IMAGE)
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for b in s:
            try:
                rows.append(dict.fromkeys(("height", "width", "channels", "mode", "data")) if b is None else _image(_converted(_decoded(bytes(b)), mode)))
            except Exception:
                if on_error == "raise":
                    raise
                rows.append(dict.fromkeys(("height", "width", "channels", "mode", "data")))
        return pd.DataFrame(rows, columns=["height", "width", "channels", "mode", "data"])

    return run(col(expr))


def encode_image(expr, image_format: str = "png") -> Column:
    @F.pandas_udf("binary")
    def run(v: pd.DataFrame) -> pd.Series:
        out = []
        for r in v.to_dict("records"):
            if pd.isna(r["height"]):
                out.append(None)
            elif image_format.lower() == "png":
                out.append(png_bytes(int(r["height"]), int(r["width"]), int(r["channels"]), bytes(r["data"])))
            else:
                import io

                from PIL import Image

                to = io.BytesIO()
                Image.fromarray(_pixels(r).squeeze()).save(to, image_format)
                out.append(to.getvalue())
        return pd.Series(out, dtype=object)

    return run(col(expr))


def _converted(p: np.ndarray, mode: str | None) -> np.ndarray:
    if mode is None or _COUNT[mode] == p.shape[2]:
        return p
    color, alpha = p[..., : 1 if p.shape[2] < 3 else 3], p[..., -1:] if p.shape[2] in (2, 4) else np.full_like(p[..., :1], 255)
    if mode in ("L", "LA") and color.shape[2] == 3:
        color = np.round(color @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)[..., None]
    if mode in ("RGB", "RGBA") and color.shape[2] == 1:
        color = np.repeat(color, 3, axis=2)
    return np.concatenate([color, alpha], axis=2) if mode in ("LA", "RGBA") else color


def convert_image(expr, mode: str) -> Column:
    return _image_map(lambda p: _converted(p, mode))(col(expr))


def crop(expr, bbox: tuple[int, int, int, int]) -> Column:
    """x, y, width, height."""
    x, y, w, h = bbox
    return _image_map(lambda p: p[y : y + h, x : x + w])(col(expr))


def resize(expr, w: int, h: int) -> Column:
    """Between neighbouring pixels by linear interpolation."""

    def run(p: np.ndarray) -> np.ndarray:
        y, x = (np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1) for n, m in ((h, p.shape[0]), (w, p.shape[1])))
        y0, x0 = y.astype(int), x.astype(int)
        y1, x1 = np.minimum(y0 + 1, p.shape[0] - 1), np.minimum(x0 + 1, p.shape[1] - 1)
        fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
        q = p.astype(np.float64)
        top, low = q[y0][:, x0] * (1 - fx) + q[y0][:, x1] * fx, q[y1][:, x0] * (1 - fx) + q[y1][:, x1] * fx
        return np.round(top * (1 - fy) + low * fy).astype(np.uint8)

    return _image_map(run)(col(expr))


def image_width(expr) -> Column:
    return col(expr)["width"]


def image_height(expr) -> Column:
    return col(expr)["height"]


def image_channel(expr) -> Column:
    return col(expr)["channels"]


def image_mode(expr) -> Column:
    return col(expr)["mode"]


def image_attribute(expr, name: str) -> Column:
    return col(expr)[{"channel": "channels"}.get(name, name)]


def image_to_tensor(expr) -> Column:
    c = col(expr)
    return F.struct(c["data"].alias("data"), F.array(c["height"], c["width"], c["channels"]).alias("shape"))


def image_hash(expr, method: str = "average", hash_size: int = 8) -> Column:
    """Perceptual hash as hex: ``average`` or ``difference``."""

    @F.pandas_udf("string")
    def run(v: pd.DataFrame) -> pd.Series:
        out = []
        for r in v.to_dict("records"):
            if pd.isna(r["height"]):
                out.append(None)
                continue
            g = _converted(_pixels(r), "L")[..., 0].astype(float)
            wide = hash_size + (method == "difference")
            ys, xs = np.linspace(0, g.shape[0], hash_size + 1).astype(int), np.linspace(0, g.shape[1], wide + 1).astype(int)
            small = np.array([[g[a : max(b, a + 1), c : max(d, c + 1)].mean() for c, d in zip(xs, xs[1:], strict=False)] for a, b in zip(ys, ys[1:], strict=False)])
            bits = small[:, 1:] > small[:, :-1] if method == "difference" else small > small.mean()
            out.append(np.packbits(bits.ravel()).tobytes().hex())
        return pd.Series(out, dtype=object)

    return run(col(expr))


def decode_image_file(f, mode: str | None = None, on_error: str = "raise") -> Column:
    return decode_image(download(file_path(f), on_error=on_error), on_error, mode)


def image_file_metadata(f) -> Column:
    image = decode_image_file(f)
    return F.struct(image["width"].alias("width"), image["height"].alias("height"), image["mode"].alias("mode"))
