"""Width, height, format and colour mode from the first bytes of PNG, JPEG, GIF, BMP and WebP."""

from __future__ import annotations

import struct

_NONE = (0, 0, "", "")
_PNG_MODES = {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}
_JPEG_MODES = {1: "L", 3: "RGB", 4: "CMYK"}
# JPEG frame markers carry the size; these three in the same range do not.
_NOT_FRAMES = {0xC4, 0xC8, 0xCC}


def image_header(b: bytes) -> tuple[int, int, str, str]:
    try:
        if b[:8] == b"\x89PNG\r\n\x1a\n":
            w, h, depth, colour = struct.unpack(">IIBB", b[16:26])
            mode = _PNG_MODES.get(colour, "")
            if colour == 0 and depth in (1, 16):
                mode = "1" if depth == 1 else "I;16"
            return w, h, "PNG", mode
        if b[:6] in (b"GIF87a", b"GIF89a"):
            return (*struct.unpack("<HH", b[6:10]), "GIF", "P")
        if b[:2] == b"BM":
            w, h, _, bits = struct.unpack("<iiHH", b[18:30])
            return w, abs(h), "BMP", {1: "1", 8: "P", 32: "RGBA"}.get(bits, "RGB")
        if b[:4] == b"RIFF" and b[8:12] == b"WEBP":
            return _webp(b)
        if b[:2] == b"\xff\xd8":
            return _jpeg(b)
    except (struct.error, IndexError):
        pass
    return _NONE


def _webp(b: bytes) -> tuple[int, int, str, str]:
    kind = b[12:16]
    if kind == b"VP8X":
        alpha = b[20] & 0x10
        w = int.from_bytes(b[24:27], "little") + 1
        return w, int.from_bytes(b[27:30], "little") + 1, "WEBP", "RGBA" if alpha else "RGB"
    if kind == b"VP8L":
        v = int.from_bytes(b[21:25], "little")
        return (v & 0x3FFF) + 1, ((v >> 14) & 0x3FFF) + 1, "WEBP", "RGBA" if (v >> 28) & 1 else "RGB"
    w, h = struct.unpack("<HH", b[26:30])
    return w & 0x3FFF, h & 0x3FFF, "WEBP", "RGB"


def _jpeg(b: bytes) -> tuple[int, int, str, str]:
    at = 2
    while at + 9 < len(b):
        if b[at] != 0xFF:
            return _NONE
        marker = b[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if 0xC0 <= marker <= 0xCF and marker not in _NOT_FRAMES:
            h, w, parts = struct.unpack(">HHB", b[at + 5:at + 10])
            return w, h, "JPEG", _JPEG_MODES.get(parts, "")
        at += 2 + struct.unpack(">H", b[at + 2:at + 4])[0]
    return _NONE
