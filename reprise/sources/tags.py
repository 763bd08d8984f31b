"""Tags of FLAC, Ogg (Vorbis and Opus), MP4 and ID3 files: reading, merging, writing. Keys are upper case.

Written from the public format descriptions. A file that is not well formed has no tags and is never written.
"""

from __future__ import annotations

import os
import re
import struct

# Names of ID3 frames and MP4 atoms for the usual keys.
ID3 = {"TIT2": "TITLE", "TPE1": "ARTIST", "TPE2": "ALBUMARTIST", "TALB": "ALBUM", "TCON": "GENRE", "TYER": "YEAR", "TDRC": "DATE", "TRCK": "TRACKNUMBER"}
MP4 = {b"\xa9nam": "TITLE", b"\xa9ART": "ARTIST", b"aART": "ALBUMARTIST", b"\xa9alb": "ALBUM", b"\xa9gen": "GENRE", b"\xa9day": "DATE", b"trkn": "TRACKNUMBER"}
MP4_BACK = {v: k for k, v in MP4.items()}


def leading_int(text: str | None) -> int | None:
    found = re.match(r"\s*(\d{1,9})", text or "")
    return int(found[1]) if found else None


def merged(old: dict[str, str], new: dict[str, object]) -> dict[str, str]:
    """New values over old ones; empty ones, 0 and None never overwrite."""
    return old | {k.upper(): str(v) for k, v in new.items() if v not in (None, "", 0)}


# --- Vorbis comments -----------------------------------------------------------------------------------------------


def parse_comments(raw: bytes) -> tuple[bytes, dict[str, str]]:
    """Vendor and tags of a Vorbis comment; of repeated keys the first counts."""
    size = struct.unpack_from("<I", raw)[0]
    vendor, at = raw[4 : 4 + size], 4 + size
    count, at = struct.unpack_from("<I", raw, at)[0], at + 4
    out: dict[str, str] = {}
    for _ in range(count):
        n = struct.unpack_from("<I", raw, at)[0]
        key, _, value = raw[at + 4 : at + 4 + n].decode("utf-8", "replace").partition("=")
        at += 4 + n
        out.setdefault(key.upper(), value)
    return vendor, out


def build_comments(vendor: bytes, tags: dict[str, str]) -> bytes:
    items = [f"{k}={v}".encode() for k, v in tags.items()]
    return struct.pack("<I", len(vendor)) + vendor + struct.pack("<I", len(items)) + b"".join(struct.pack("<I", len(i)) + i for i in items)


# --- FLAC ------------------------------------------------------------------------------------------------------------


def _flac_blocks(data: bytes) -> tuple[list[tuple[int, bytes]], int]:
    if data[:4] != b"fLaC":
        raise ValueError("not FLAC")
    blocks, at, last = [], 4, False
    while not last:
        head = data[at]
        size = int.from_bytes(data[at + 1 : at + 4], "big")
        if at + 4 + size > len(data):
            raise ValueError("cut off")
        blocks.append((head & 0x7F, data[at + 4 : at + 4 + size]))
        last, at = bool(head & 0x80), at + 4 + size
    return blocks, at


def read_flac(data: bytes) -> dict[str, str]:
    return next((parse_comments(b)[1] for kind, b in _flac_blocks(data)[0] if kind == 4), {})


def write_flac(data: bytes, tags: dict[str, str]) -> bytes:
    """The file with these tags alone; padding is dropped, the sound is untouched."""
    blocks, sound = _flac_blocks(data)
    vendor = next((parse_comments(b)[0] for kind, b in blocks if kind == 4), b"reprise")
    kept = [(k, b) for k, b in blocks if k not in (1, 4)]
    kept.insert(1, (4, build_comments(vendor, tags)))
    out = b"fLaC"
    for n, (kind, body) in enumerate(kept):
        out += bytes([kind | (0x80 if n == len(kept) - 1 else 0)]) + len(body).to_bytes(3, "big") + body
    return out + data[sound:]


# --- Ogg -------------------------------------------------------------------------------------------------------------


def _crc_table() -> list[int]:
    table = []
    for n in range(256):
        r = n << 24
        for _ in range(8):
            r = ((r << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if r & 0x80000000 else (r << 1) & 0xFFFFFFFF
        table.append(r)
    return table


_CRC = _crc_table()


def ogg_crc(page: bytes) -> int:
    r = 0
    for b in page:
        r = ((r << 8) & 0xFFFFFFFF) ^ _CRC[((r >> 24) & 0xFF) ^ b]
    return r


def _ogg_pages(data: bytes) -> list[dict]:
    pages, at = [], 0
    while at < len(data):
        if data[at : at + 4] != b"OggS":
            raise ValueError("not Ogg")
        n = data[at + 26]
        lacing = data[at + 27 : at + 27 + n]
        size = 27 + n + sum(lacing)
        pages.append({"flags": data[at + 5], "granule": data[at + 6 : at + 14], "serial": data[at + 14 : at + 18], "sequence": struct.unpack_from("<I", data, at + 18)[0], "lacing": lacing, "body": data[at + 27 + n : at + size]})
        at += size
    return pages


def _ogg_page(page: dict) -> bytes:
    head = b"OggS\0" + bytes([page["flags"]]) + page["granule"] + page["serial"] + struct.pack("<I", page["sequence"]) + b"\0\0\0\0" + bytes([len(page["lacing"])]) + bytes(page["lacing"])
    raw = head + page["body"]
    return raw[:22] + struct.pack("<I", ogg_crc(raw)) + raw[26:]


def _ogg_packets(pages: list[dict], count: int) -> tuple[list[bytes], int]:
    """The first packets, and how many pages they fill."""
    packets, part = [], b""
    for used, page in enumerate(pages, 1):
        at = 0
        for size in page["lacing"]:
            part += page["body"][at : at + size]
            at += size
            if size < 255:
                packets.append(part)
                part = b""
        if len(packets) >= count:
            return packets, used
    raise ValueError("cut off")


def _comment_packet(packet: bytes) -> tuple[bytes, bytes]:
    for magic in (b"\x03vorbis", b"OpusTags"):
        if packet.startswith(magic):
            return magic, packet[len(magic) :]
    raise ValueError("no comments")


def read_ogg(data: bytes) -> dict[str, str]:
    return parse_comments(_comment_packet(_ogg_packets(_ogg_pages(data), 2)[0][1])[1])[1]


def write_ogg(data: bytes, tags: dict[str, str]) -> bytes:
    """The file with these tags alone; the header pages are laid out anew and all later ones renumbered."""
    pages = _ogg_pages(data)
    opus = pages[0]["body"].startswith(b"OpusHead")
    packets, used = _ogg_packets(pages, 2 if opus else 3)
    magic, body = _comment_packet(packets[1])
    packets[1] = magic + build_comments(parse_comments(body)[0], tags) + (b"" if opus else b"\x01")
    out, sequence, lacing, content, fresh = [pages[0]], pages[0]["sequence"], [], b"", True

    def close(begins: bool) -> None:
        nonlocal sequence, lacing, content
        sequence += 1
        ends = any(x < 255 for x in lacing)
        out.append(pages[0] | {"flags": 0 if begins else 1, "granule": b"\0" * 8 if ends else b"\xff" * 8, "sequence": sequence, "lacing": bytes(lacing), "body": content})
        lacing, content = [], b""

    for packet in packets[1:]:
        at = 0
        while True:
            size = min(255, len(packet) - at)
            lacing.append(size)
            content += packet[at : at + size]
            at += size
            if len(lacing) == 255:
                close(fresh)
                fresh = size < 255
            if size < 255:
                break
    if lacing:
        close(fresh)
    for page in pages[used:]:
        sequence += 1
        out.append(page | {"sequence": sequence})
    return b"".join(map(_ogg_page, out))


# --- MP4 -------------------------------------------------------------------------------------------------------------


def _atoms(data: bytes, start: int, end: int) -> list[tuple[bytes, int, int, int]]:
    """(name, start, content, end) of the atoms in a range."""
    out, at = [], start
    while at + 8 <= end:
        size, name, head = struct.unpack_from(">I", data, at)[0], data[at + 4 : at + 8], 8
        if size == 1:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError("bad atom")
        out.append((name, at, at + head, at + size))
        at += size
    return out


def _find(data: bytes, path: list[bytes], start: int, end: int) -> tuple[bytes, int, int, int] | None:
    for atom in _atoms(data, start, end):
        if atom[0] == path[0]:
            return atom if len(path) == 1 else _find(data, path[1:], atom[2] + (4 if atom[0] == b"meta" else 0), atom[3])
    return None


def read_mp4(data: bytes) -> dict[str, str]:
    if data[4:8] != b"ftyp":
        raise ValueError("not MP4")
    items = _find(data, [b"moov", b"udta", b"meta", b"ilst"], 0, len(data))
    out: dict[str, str] = {}
    for name, _, start, end in _atoms(data, items[2], items[3]) if items else []:
        value = next((data[s + 8 : e] for n, _, s, e in _atoms(data, start, end) if n == b"data"), None)
        key = MP4.get(name)
        if value is not None and key:
            out[key] = str(struct.unpack_from(">H", value, 2)[0]) if name == b"trkn" and len(value) >= 4 else value.decode("utf-8", "replace")
    return out


def _atom(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", 8 + len(body)) + name + body


def write_mp4(data: bytes, tags: dict[str, str]) -> bytes:
    """The file with these tags; chunk offsets move along where the sound comes after the movie atom."""
    moov = _find(data, [b"moov"], 0, len(data))
    if not moov or data[4:8] != b"ftyp":
        raise ValueError("not MP4")
    items = b""
    for key, value in tags.items():
        if key == "TRACKNUMBER" and leading_int(value):
            items += _atom(b"trkn", _atom(b"data", struct.pack(">II", 0, 0) + struct.pack(">HHHH", 0, leading_int(value), 0, 0)))
        elif key in MP4_BACK and key != "TRACKNUMBER":
            items += _atom(MP4_BACK[key], _atom(b"data", struct.pack(">II", 1, 0) + value.encode()))
    handler = _atom(b"hdlr", b"\0" * 8 + b"mdirappl" + b"\0" * 9)
    udta = _atom(b"udta", _atom(b"meta", b"\0" * 4 + handler + _atom(b"ilst", items)))
    rest = b"".join(data[s:e] for name, s, _, e in _atoms(data, moov[2], moov[3]) if name != b"udta")
    new = bytearray(_atom(b"moov", rest + udta))
    moved = len(new) - (moov[3] - moov[1])
    _shift_chunks(new, 8, len(new), moov[1], moved)
    return data[: moov[1]] + bytes(new) + data[moov[3] :]


def _shift_chunks(data: bytearray, start: int, end: int, after: int, moved: int) -> None:
    for name, _, body, stop in _atoms(bytes(data), start, end):
        if name in (b"trak", b"mdia", b"minf", b"stbl"):
            _shift_chunks(data, body, stop, after, moved)
        elif name in (b"stco", b"co64"):
            code, width = (">I", 4) if name == b"stco" else (">Q", 8)
            for k in range(struct.unpack_from(">I", data, body + 4)[0]):
                where = body + 8 + k * width
                offset = struct.unpack_from(code, data, where)[0]
                if offset > after:
                    struct.pack_into(code, data, where, offset + moved)


# --- ID3 -------------------------------------------------------------------------------------------------------------


def _syncsafe(raw: bytes) -> int:
    return raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3]


def _id3_text(raw: bytes) -> str:
    code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(raw[0], "latin-1") if raw else "latin-1"
    return raw[1:].decode(code, "replace").split("\0")[0].strip("﻿")


def read_id3(data: bytes) -> dict[str, str]:
    if data[:3] != b"ID3":
        raise ValueError("no ID3")
    end, at, out = 10 + _syncsafe(data[6:10]), 10, {}
    while at + 10 <= min(end, len(data)) and data[at : at + 4].strip(b"\0"):
        name = data[at : at + 4].decode("latin-1")
        size = _syncsafe(data[at + 4 : at + 8]) if data[3] >= 4 else struct.unpack_from(">I", data, at + 4)[0]
        if name in ID3:
            out.setdefault(ID3[name], _id3_text(data[at + 10 : at + 10 + size]))
        at += 10 + size
    return out


def write_id3(data: bytes, tags: dict[str, str]) -> bytes:
    """The file with an ID3v2.4 tag of these tags alone, in UTF-8."""
    names = {v: k for k, v in ID3.items() if k != "TYER"}
    body = b""
    for key, value in tags.items():
        if name := names.get("DATE" if key == "YEAR" else key):
            text = b"\x03" + value.encode()
            n = len(text)
            body += name.encode() + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + b"\0\0" + text
    sound = data[10 + _syncsafe(data[6:10]) :] if data[:3] == b"ID3" else data
    n = len(body)
    return b"ID3\x04\0\0" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + body + sound


# --- Files -----------------------------------------------------------------------------------------------------------

_KINDS = {".flac": (read_flac, write_flac), ".ogg": (read_ogg, write_ogg), ".opus": (read_ogg, write_ogg), ".m4a": (read_mp4, write_mp4), ".mp4": (read_mp4, write_mp4), ".mp3": (read_id3, write_id3)}


def _riff_info(data: bytes) -> dict[str, str]:
    names = {b"INAM": "TITLE", b"IART": "ARTIST", b"IPRD": "ALBUM", b"IGNR": "GENRE", b"ICRD": "DATE", b"ITRK": "TRACKNUMBER"}
    out, at = {}, 12
    while at + 8 <= len(data):
        size = struct.unpack_from("<I", data, at + 4)[0]
        if data[at : at + 4] == b"LIST" and data[at + 8 : at + 12] == b"INFO":
            k = at + 12
            while k + 8 <= at + 8 + size:
                n = struct.unpack_from("<I", data, k + 4)[0]
                if data[k : k + 4] in names:
                    out[names[data[k : k + 4]]] = data[k + 8 : k + 8 + n].split(b"\0")[0].decode("utf-8", "replace")
                k += 8 + n + n % 2
        at += 8 + size + size % 2
    return out


def read_tags(path: str) -> dict[str, str]:
    """The tags of a file; {} for files that are unknown, malformed or unreadable."""
    kind = os.path.splitext(path)[1].lower()
    try:
        with open(path, "rb") as f:
            data = f.read()
        if data[:4] == b"RIFF":
            return _riff_info(data)
        return _KINDS[kind][0](data) if kind in _KINDS else {}
    except (OSError, ValueError, struct.error, IndexError, KeyError):
        return {}


def write_tags(path: str, fields: dict[str, object], replace: bool = False) -> dict[str, str]:
    """Merges fields into a file's tags (or replaces them all, to revert), by an atomic rename; gives what was written."""
    kind = os.path.splitext(path)[1].lower()
    with open(path, "rb") as f:
        data = f.read()
    read, write = _KINDS[kind]
    tags = {k.upper(): str(v) for k, v in fields.items()} if replace else merged(read(data) if not (kind == ".mp3" and data[:3] != b"ID3") else {}, fields)
    with open(f"{path}.part", "wb") as f:
        f.write(write(data, tags))
    os.replace(f"{path}.part", path)
    return tags


def stream_info(path: str) -> tuple[int | None, int | None, int | None, float | None]:
    """(kbit/s, Hz, bits, seconds) from the headers of WAV and FLAC files; nulls for others."""
    try:
        size = os.path.getsize(path)
        with open(path, "rb") as f:
            head = f.read(1 << 16)
        if head[:4] == b"RIFF":
            at, channels, rate, per_second, bits = 12, None, None, None, None
            while at + 8 <= len(head):
                n = struct.unpack_from("<I", head, at + 4)[0]
                if head[at : at + 4] == b"fmt ":
                    _, channels, rate, per_second, _, bits = struct.unpack_from("<HHIIHH", head, at + 8)
                if head[at : at + 4] == b"data" and per_second:
                    return round(per_second * 8 / 1000), rate, bits, min(n, size) / per_second
                at += 8 + n + n % 2
        elif head[:4] == b"fLaC":
            packed = int.from_bytes(head[18:26], "big")
            rate, bits, samples = packed >> 44, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1
            seconds = samples / rate if rate and samples else None
            return round(size * 8 / seconds / 1000) if seconds else None, rate, bits, seconds
    except (OSError, struct.error):
        pass
    return None, None, None, None
