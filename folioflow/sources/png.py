"""PNG bytes of pixel arrays and back, for images of 8 bits a channel; other formats need an image library."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels by colour type (3 is a palette).
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encoded(image: np.ndarray) -> bytes:
    """PNG of an array, height x width (x channels in blue, green, red order). Other types than bytes are taken as 0..1."""
    if image.dtype != np.uint8:
        image = (image * 255).astype(np.uint8)
    if image.ndim == 3 and image.shape[2] == 3:
        image = image[..., ::-1]
    if image.ndim == 3 and image.shape[2] == 1:
        image = image[..., 0]
    height, width = image.shape[:2]
    colour = 0 if image.ndim == 2 else {2: 4, 3: 2, 4: 6}[image.shape[2]]
    rows = np.ascontiguousarray(image).reshape(height, -1)
    raw = np.concatenate([np.zeros((height, 1), np.uint8), rows], axis=1).tobytes()
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(raw)) + _chunk(b"IEND", b"")


def _unfiltered(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    out = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(height):
        at = y * (stride + 1)
        kind, line = raw[at], np.frombuffer(raw, np.uint8, stride, at + 1)
        if kind == 0:
            own = line
        elif kind == 1:
            own = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            own = line + above
        elif kind in (3, 4):
            own, up = bytearray(line.tobytes()), above.tobytes()
            for i in range(stride):
                left, corner = (own[i - step], up[i - step]) if i >= step else (0, 0)
                if kind == 3:
                    guess = (left + up[i]) // 2
                else:
                    to = (abs(up[i] - corner), abs(left - corner), abs(left + up[i] - 2 * corner))
                    guess = left if to[0] <= min(to[1:]) else up[i] if to[1] <= to[2] else corner
                own[i] = (own[i] + guess) & 255
            own = np.frombuffer(bytes(own), np.uint8)
        else:
            raise ValueError(f"unknown filter {kind}")
        out[y] = above = own
    return out


def rgb(content: bytes) -> np.ndarray:
    """Height x width x 3 in red, green, blue order, whatever the picture's channels are; ValueError if it is no such PNG."""
    if content[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, data, palette, head = 8, [], None, None
    while at + 8 <= len(content):
        size, kind = struct.unpack_from(">I4s", content, at)
        body = content[at + 8 : at + 8 + size]
        if len(body) != size:
            raise ValueError("cut off")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    if head is None or head[2] != 8 or head[6] or head[3] not in CHANNELS or head[3] == 3 and palette is None:
        raise ValueError("only whole pictures of 8 bits a channel")
    width, height, n = head[0], head[1], CHANNELS[head[3]]
    try:
        raw = zlib.decompress(b"".join(data))
    except zlib.error as e:
        raise ValueError(str(e)) from e
    if len(raw) != height * (width * n + 1):
        raise ValueError("rows are missing")
    pixels = _unfiltered(raw, height, width * n, n).reshape(height, width, n)
    if head[3] == 3:
        return palette[pixels[..., 0]]
    return np.repeat(pixels[..., :1], 3, axis=2) if n < 3 else pixels[..., :3]
