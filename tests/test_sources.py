import math
import os
import struct

import numpy as np
import pytest
from reprise.operators.matching import attribute_lane
from reprise.operators.storage import Deltas
from reprise.sources import audio, filesystem, tags
from reprise.streaming import incremental
from reprise.streaming.incremental import IncrementalMatcher


def wav(path, hz, seconds=3, info=()):
    body = b"".join(struct.pack("<h", int(12000 * math.sin(2 * math.pi * hz * k / 11025) + 6000 * math.sin(2 * math.pi * (hz * 2.3) * k / 11025 * (1 + k / 60000)))) for k in range(11025 * seconds))
    fmt = struct.pack("<HHIIHH", 1, 1, 11025, 22050, 2, 16)
    listed = b"".join(k + struct.pack("<I", len(v)) + v + b"\0" * (len(v) % 2) for k, v in info)
    chunks = b"fmt " + struct.pack("<I", 16) + fmt + (b"LIST" + struct.pack("<I", 4 + len(listed)) + b"INFO" + listed if info else b"") + b"data" + struct.pack("<I", len(body)) + body
    path.write_bytes(b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks)


def flac():
    return b"fLaC" + bytes([0]) + (34).to_bytes(3, "big") + b"\0" * 10 + ((44100 << 44) | (1 << 41) | (15 << 36) | 44100 * 10).to_bytes(8, "big") + b"\0" * 16 + bytes([4 | 0x80]) + len(c := tags.build_comments(b"v", {"TITLE": "Old", "ARTIST": "Él"})).to_bytes(3, "big") + c + b"SOUND" * 10


def ogg(opus):
    comments = tags.build_comments(b"v", {"TITLE": "Old"})
    head, second = (b"OpusHead", b"OpusTags" + comments) if opus else (b"\x01vorbis", b"\x03vorbis" + comments + b"\x01")
    page = lambda n, flags, bodies: tags._ogg_page({"flags": flags, "granule": b"\0" * 8, "serial": b"abcd", "sequence": n, "lacing": bytes(x for b in bodies for x in [255] * (len(b) // 255) + [len(b) % 255]), "body": b"".join(bodies)})
    return page(0, 2, [head]) + page(1, 0, [second] + ([] if opus else [b"\x05vorbis" + b"s" * 300])) + page(2, 4, [b"sound" * 20])


def mp4():
    stco = tags._atom(b"stco", struct.pack(">III", 0, 1, 0))
    moov = lambda at: tags._atom(b"moov", tags._atom(b"mvhd", b"\0" * 20) + tags._atom(b"trak", tags._atom(b"mdia", tags._atom(b"minf", tags._atom(b"stbl", stco[:-4] + struct.pack(">I", at))))))
    ftyp = tags._atom(b"ftyp", b"M4A \0\0\0\0")
    at = len(ftyp) + len(moov(0)) + 8
    return ftyp + moov(at) + tags._atom(b"mdat", b"SOUND")


@pytest.mark.parametrize("name, make", [("a.flac", flac), ("a.ogg", lambda: ogg(False)), ("a.opus", lambda: ogg(True)), ("a.m4a", mp4), ("a.mp3", lambda: b"\xff\xfbSOUND" * 9)])
def test_tags_round_trip(tmp_path, name, make):
    path = tmp_path / name
    path.write_bytes(make())
    before = tags.read_tags(str(path))
    tags.write_tags(str(path), {"title": "Néw " * 200, "album": "B", "genre": "", "tracknumber": 7})
    got = tags.read_tags(str(path))
    assert got["TITLE"].startswith("Néw Néw") and len(got["TITLE"]) == 800 and got["ALBUM"] == "B" and got["TRACKNUMBER"] == "7" and "GENRE" not in got
    assert got.get("ARTIST") == before.get("ARTIST")
    data = path.read_bytes()
    assert b"SOUND" in data or b"sound" in data
    if name == "a.m4a":
        at = struct.unpack_from(">I", data, data.index(b"stco") + 12)[0]
        assert data[at : at + 5] == b"SOUND"
    if name.endswith(("ogg", "opus")):
        at = 0
        for page in tags._ogg_pages(data):
            raw = tags._ogg_page(page)
            assert data[at : at + len(raw)] == raw
            at += len(raw)
    tags.write_tags(str(path), before, replace=True)
    assert tags.read_tags(str(path)) == before


def test_malformed_files_have_no_tags(tmp_path):
    for name in ("x.flac", "x.ogg", "x.m4a", "x.mp3", "x.wav", "x.txt"):
        (tmp_path / name).write_bytes(b"fLaC\x84\xff\xff\xff")
        assert tags.read_tags(str(tmp_path / name)) == {}
    assert tags.read_tags(str(tmp_path / "none.flac")) == {}
    assert tags.merged({"A": "1"}, {"a": None, "b": 0, "c": "x"}) == {"A": "1", "C": "x"}


def test_folders_to_groups(spark, tmp_path):
    """Files on disk through listing, tags and fingerprints to matching pairs."""
    for folder, name, hz, title in (("A", "song-dup.wav", 440, b"Song Dup"), ("B", "song-dup.wav", 442, b"Song Dup"), ("A", "song-uniq.WAV", 900, b"Song Uniq"), ("skip", "x.wav", 440, b"X")):
        os.makedirs(tmp_path / folder, exist_ok=True)
        wav(tmp_path / folder / name, hz, info=[(b"INAM", title), (b"IART", b"The Artist")])
    (tmp_path / "A" / "note.txt").write_text("no sound")
    listed = filesystem.enumerate_files(spark, [str(tmp_path)], ["SKIP"])
    rows = filesystem.extract_metadata(listed).collect()
    assert len(rows) == 3 and {r["format"] for r in rows} == {"WAV"} and {r["sample_rate"] for r in rows} == {11025} and all(r["file_mtime"] > 1e12 and abs(r["duration"] - 3) < 0.01 for r in rows)
    table = spark.createDataFrame([(i, r["path"], r["title"], r["artist"], r["duration"]) for i, r in enumerate(sorted(rows, key=lambda r: r["path"]))], "id bigint, path string, title string, artist string, duration double")
    prints = {r["id"]: r for r in audio.fingerprints(table).collect()}
    assert all(p["fingerprint_method"] == "spectral" and len(p["fingerprint"]) >= 20 for p in prints.values())
    assert [(r["a"], r["b"]) for r in attribute_lane(table).collect()] == [(0, 2)]
    assert all(r["error"] for r in audio.second_fingerprints(table, "no-such-program").collect())


def test_fingerprints_of_odd_sounds(spark):
    assert audio.fingerprint(np.zeros(60_000), 11025) is None and audio.fingerprint(np.ones(10), 11025) is None
    t = np.arange(44100 * 4) / 44100
    sound = np.sin(2 * np.pi * 500 * t) + 0.5 * np.sin(2 * np.pi * 1100 * t * (1 + t / 50))
    a, b = audio.fingerprint(sound, 44100), audio.fingerprint(audio.resample(sound, 44100), 11025)
    assert a == b and len(a) == 120 and all(0 <= w < 1 << 32 for w in a)
    assert audio.mono([[1, 3], [3, 5]]).tolist() == [2, 4]
    df = spark.createDataFrame([(1, "/none", "T", 3.0), (2, "/none", None, None)], "id bigint, path string, title string, duration double")
    assert {r["id"]: r["fingerprint_method"] for r in audio.fingerprints(df).collect()} == {1: "metadata", 2: None}


def words_by_hand(sound):
    """The fingerprint one sample at a time, by the recurrence of the filter."""
    tones = [round(300 * (2000 / 300) ** (k / 32)) for k in range(33)]

    def power(frame, hz):
        twice, one, two = 2 * math.cos(2 * math.pi * hz / 11025), 0.0, 0.0
        for x in frame:
            one, two = x + twice * one - two, one
        return one * one + two * two - twice * one * two

    heard = lambda at: math.sqrt(sum(x * x for x in sound[at : at + 256]) / 256) > 0.002
    words, last = [], len(sound) - 256
    for anchor in (0.15, 0.30, 0.50, 0.65, 0.80):
        home = int(anchor * len(sound))
        start = next((i for i in range(home, last + 1, 64) if heard(i)), None)
        if start is None:
            start = next((i for i in range(home, -1, -64) if i <= last and heard(i)), None)
        if start is None:
            continue
        frames = [[power(sound[i : i + 256], hz) for hz in tones] for i in [i for i in range(start, last + 1, 64) if heard(i)][:25]]
        words += [sum(1 << b for b in range(32) if x[b] - x[b + 1] > y[b] - y[b + 1]) for x, y in zip(frames, frames[1:])]
    return words


@pytest.mark.parametrize("quiet", [[], [(0, 20_000)], [(3_000, 3_400), (9_000, 12_000)], [(14_000, 22_050)], [(6_900, 22_050)]])
def test_fingerprint_by_hand(quiet):
    """Tones that move and noise, with silent stretches: the same words as sample by sample."""
    t = np.arange(22_050) / 11025
    sound = 0.4 * np.sin(2 * np.pi * 440 * t * (1 + t / 9)) + 0.2 * np.sin(2 * np.pi * 880 * t) + 0.1 * np.random.default_rng(4).standard_normal(len(t))
    for a, b in quiet:
        sound[a:b] = 0
    assert audio.fingerprint(sound, 11025) == words_by_hand(sound.tolist())


@pytest.mark.parametrize("bits, kind", [(8, 1), (16, 1), (24, 1), (32, 1), (32, 3), (64, 3)])
def test_uncompressed_sound_is_decoded(bits, kind):
    wave = np.sin(np.arange(4000) / 9) * 0.7
    stereo = np.stack([wave, wave * 0.5], axis=1).ravel()
    if kind == 3:
        raw = {order: stereo.astype(f"{order}f{bits // 8}").tobytes() for order in "<>"}
    else:
        whole = np.round(stereo * ((1 << bits - 1) - 1)).astype(np.int64)
        raw = {"<": b"".join(int(x + (128 if bits == 8 else 0)).to_bytes(bits // 8, "little", signed=bits != 8) for x in whole), ">": b"".join(int(x).to_bytes(bits // 8, "big", signed=True) for x in whole)}
    fmt = struct.pack("<HHIIHH", kind, 2, 8000, 0, 0, bits)
    riff = b"RIFF\0\0\0\0WAVEfmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(raw["<"])) + raw["<"]
    sound, rate = audio.decode(riff)
    assert rate == 8000 and len(sound) == 4000 and np.abs(sound - wave * 0.75).max() < 2.0 ** (2 - min(bits, 20))
    assert audio.decode(riff[:30]) is None and audio.decode(b"ID3") is None
    if kind == 1:
        comm = struct.pack(">hIhHQ", 2, 4000, bits, 16383 + 12, 8000 << 51)
        form = b"FORM\0\0\0\0AIFFCOMM" + struct.pack(">I", 18) + comm + b"SSND" + struct.pack(">I", len(raw[">"]) + 8) + b"\0" * 8 + raw[">"]
        other, rate = audio.decode(form)
        assert rate == 8000 and np.abs(other - sound).max() < 2.0 ** (2 - min(bits, 20))


def test_second_fingerprint_of_a_program(spark, tmp_path):
    """A stand-in program: text and words; a file without words keeps its text, one it cannot read has an error."""
    tool = tmp_path / "tool"
    tool.write_text('#!/bin/sh\ncase "$*" in *bad*) exit 3;; *-raw*half*) exit 4;; *-raw*) echo "{\\"fingerprint\\": [1, -2], \\"duration\\": 9.5}";; *) echo "{\\"fingerprint\\": \\"AQ\\", \\"duration\\": 9.5}";; esac\n')
    tool.chmod(0o755)
    df = spark.createDataFrame([(1, "/a/x"), (2, "/a/half"), (3, "/a/bad")], "id bigint, path string")
    got = {r["id"]: tuple(r)[1:] for r in audio.second_fingerprints(df, str(tool)).collect()}
    assert got == {1: ("AQ", [1, 0xFFFFFFFE], 9.5, None), 2: ("AQ", None, 9.5, None), 3: (None, None, None, "CalledProcessError")}


def test_rename(spark):
    df = spark.createDataFrame([(1, "/a/b/old.mp3"), (2, "/a/x.mp3")], "id bigint, path string")
    names = spark.createDataFrame([(1, "New Name")], "id bigint, name string")
    assert {r["id"]: r["path"] for r in filesystem.renamed(df, names).collect()} == {1: "/a/b/New Name.mp3", 2: "/a/x.mp3"}


def test_incremental_matching(spark, tmp_path):
    schema = "id bigint, path string, title string, artist string, duration double, scan_time bigint"
    rows = [(1, "/1", "One", "A", 100.0, 1), (2, "/2", "Two", "A", 100.0, 1), (3, "/3", "One", "A", 101.0, 1), (2, "/2", "One", "A", 100.0, 2), (4, "/4", "Two", "A", 100.0, 2)]
    source = str(tmp_path / "in")
    matcher = IncrementalMatcher(str(tmp_path / "out"), attribute_lane, lambda arrived, everything: everything)
    for batch in (rows[:3], rows[3:]):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(source)
        matcher.start(spark.readStream.schema(schema).parquet(source), str(tmp_path / "ck"), availableNow=True).awaitTermination()
    got = sorted((r["a"], r["b"]) for r in matcher.pairs(spark).collect())
    want = sorted((r["a"], r["b"]) for r in attribute_lane(matcher.files(spark)).collect())
    assert got == want == [(1, 2), (1, 3), (2, 3)]
    matcher(spark.createDataFrame(rows[3:], schema), 9)
    assert sorted((r["a"], r["b"]) for r in matcher.pairs(spark).collect()) == got


def test_batches_touch_their_blocks_alone(spark, tmp_path, monkeypatch):
    """Files of other titles are not compared again; a changed file loses its pairs; compaction changes nothing."""
    monkeypatch.setattr(incremental, "COMPACT", 3)
    schema, seen = "id bigint, path string, title string, artist string, duration double, scan_time bigint", []

    def lane(files):
        seen.append(files.count())
        return attribute_lane(files)

    by_title = lambda arrived, files: files.join(arrived.select("title").distinct(), "title", "left_semi")
    matcher = IncrementalMatcher(str(tmp_path), lane, by_title)
    batches = [[(k, f"/{k}", f"Song{k % 5} Name", "A", 100.0, 1) for k in range(20)], [(20, "/20", "Song1 Name", "A", 100.0, 2)], [(1, "/1", "Song2 Name", "A", 100.0, 3)], [(6, "/6", "Song3 Name", "A", 100.0, 4), (99, "/99", "None such", "B", 1.0, 4)]]
    for n, rows in enumerate(batches):
        matcher(spark.createDataFrame(rows, schema), n)
    got = sorted((r["a"], r["b"]) for r in matcher.pairs(spark).collect())
    assert got == sorted((r["a"], r["b"]) for r in attribute_lane(matcher.files(spark)).collect())
    assert seen == [20, 5, 5, 6] and len(Deltas(spark, f"{tmp_path}/files").batches()) == 1
