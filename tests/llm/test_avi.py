import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomdoc.llm import avi, jpeg


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=3000), min_size=1, max_size=5))
def test_files_give_the_payload_back(payloads):
    payloads = [avi.padded(x) for x in payloads]
    files = list(avi.encode_payloads(payloads))
    assert [b"".join(f.tobytes() for f in x) for x, _, _ in avi.decode_files(files)] == payloads


def test_extreme_samples():
    payload = bytes([0, 255] * 288 + [255] * 576 + [0] * 576)
    assert b"".join(f.tobytes() for f in next(avi.decode_files(list(avi.encode_payloads([payload]))))[0]) == payload


def reference_decode(frame):
    """A plain bit-by-bit decoder of the lossless process, from the markers."""
    data, at, lengths, values = frame, 2, None, None
    while True:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4])
        body = data[at + 4 : at + 2 + size]
        if marker == 0xC4:
            lengths, values = body[1:17], body[17:]
        elif marker == 0xC3:
            height, width = int.from_bytes(body[1:3]), int.from_bytes(body[3:5])
        at += 2 + size
        if marker == 0xDA:
            break
    codes, code, k = {}, 0, 0
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            codes[n, code] = values[k]
            code, k = code + 1, k + 1
        code <<= 1
    bits = "".join(f"{b:08b}" for b in data[at:-2].replace(b"\xff\x00", b"\xff"))
    out, p = np.zeros((height, width), int), 0
    for y in range(height):
        for x in range(width):
            n = 1
            while (n, int(bits[p : p + n], 2)) not in codes:
                n += 1
            c = codes[n, int(bits[p : p + n], 2)]
            p += n
            v = int(bits[p : p + c], 2) if c else 0
            p += c
            diff = v if c == 0 or v >> (c - 1) else v - (1 << c) + 1
            out[y, x] = diff + (out[y, x - 1] if x else out[y - 1, 0] if y else 128)
    return out.astype(np.uint8).tobytes()


def test_frames_are_what_a_plain_decoder_reads():
    payload = random.Random(2).randbytes(576 * 3)
    frames, delay = avi.read_avi(next(avi.encode_payloads([payload])))
    assert delay == 40_000 and b"".join(map(reference_decode, frames)) == payload


def test_digest(docs, rows):
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in avi.digest(docs).collect())
    want = []
    for doc_id, text, *_ in rows:
        raw = (text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        want.append((doc_id is not None, doc_id or 0, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    assert got == sorted(want)
    by_text = {}
    for r in avi.digest(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        by_text.setdefault(r.text, set()).add((r.media_sha256, r.feature, r.media_bytes))
    assert all(len(x) == 1 for x in by_text.values())


def test_shots_at_hard_cuts(spark):
    dark, light = bytes(range(32)) * 18, bytes(range(200, 232)) * 18
    text = "".join([dark.decode("latin1")] * 6)
    file = next(avi.encode_payloads([dark * 6 + light * 5 + dark * 4]))
    rows = avi.clips(spark.createDataFrame([(1, bytearray(file)), (2, None)], "doc_id bigint, media binary")).collect()
    assert text and [(r.first_frame, r.frames, r.start_s) for r in rows] == [(0, 6, 0.0), (6, 5, 0.24), (11, 4, 0.44)]


def test_damaged_cells_have_a_status(spark):
    file = next(avi.encode_payloads([bytes(576)]))
    cells = [file, file.replace(b"\xff\xd8\xff\xc4", b"\xff\xd8\xff\xc2"), b"RIFX" + file[4:], b"", b"text", file[:100], file[:-300], file.replace(b"00dc", b"00dd", 1)]
    rows = avi.clips(spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(cells)], "doc_id bigint, media binary")).collect()
    assert [r.doc_id for r in sorted(rows)] == list(range(len(cells)))
    assert {r.doc_id: r.status == "ok" for r in rows} == {i: i == 0 for i in range(len(cells))}
    assert all((r.clip is None) == (r.status != "ok") for r in rows)


def test_every_mutation_has_a_status():
    """5000 damaged files: each gets its samples or a status, and nothing is raised."""
    draw, marks = random.Random(5), [b"\xff\xff\xff\xff", b"\0\0\0\0", b"LIST", b"rec ", b"\x80\0\0\0"]
    base = [next(avi.encode_payloads([bytes(draw.randrange(256) for _ in range(576)) * k])) for k in (1, 2, 3)]
    statuses = set()
    for _ in range(5000):
        x = bytearray(draw.choice(base))
        for _ in range(draw.randint(1, 6)):
            how, i = draw.randrange(4), draw.randrange(len(x))
            if how == 0:
                x[i] = draw.randrange(256)
            elif how == 1:
                x[i : i + 4] = draw.choice(marks)
            elif how == 2:
                del x[i : i + draw.randint(1, 40)]
            else:
                x[i:i] = x[draw.randrange(len(x)) :][: draw.randint(1, 40)]
        [(frames, _, status)] = avi.decode_files([bytes(x)])
        assert (frames is None) == (status != "ok")
        statuses.add(status)
    assert any(x.startswith("damaged") for x in statuses)


def test_lists_in_lists_without_end():
    deep = b"".join(b"LIST" + (12 * k).to_bytes(4, "little") + b"rec " for k in range(20000, 0, -1))
    assert list(avi._listed(deep, 0, len(deep), (b"00dc", b"00db"))) == []


def encode_baseline(planes, sampling, quantiser=None, tables=True, restart=0):
    """A plain encoder of the baseline process with the standard Huffman tables: planes of whole units, (across, down) of each."""
    quantiser = np.full(64, 2) if quantiser is None else quantiser
    codes = {k: {value: (code, bits) for bits, code, value in jpeg._codes(t)} for k, t in jpeg.STANDARD.items()}
    most_across, most_down = max(a for a, _ in sampling), max(d for _, d in sampling)
    height, width = planes[0].shape[0] * most_down // sampling[0][1], planes[0].shape[1] * most_across // sampling[0][0]
    out, bits = bytearray(), []
    before = [0] * len(planes)

    def put(value, n):
        bits.extend((value >> i) & 1 for i in range(n - 1, -1, -1))

    def flush():
        bits.extend([1] * (-len(bits) % 8))
        out.extend(np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00"))
        bits.clear()

    def number(value, n):
        put(value if value >= 0 else value + (1 << n) - 1, n)

    unit = 0
    for my in range(height // (8 * most_down)):
        for mx in range(width // (8 * most_across)):
            if restart and unit and unit % restart == 0:
                flush()
                out.extend([0xFF, 0xD0 + (unit // restart - 1) % 8])
                before = [0] * len(planes)
            unit += 1
            for p, (plane, (across, down)) in enumerate(zip(planes, sampling, strict=True)):
                for y in range(my * down, my * down + down):
                    for x in range(mx * across, mx * across + across):
                        block = jpeg._COSINES @ (plane[8 * y : 8 * y + 8, 8 * x : 8 * x + 8].astype(float) - 128) @ jpeg._COSINES.T
                        z = np.rint(block.reshape(64)[jpeg.ZIGZAG] / quantiser).astype(int).tolist()
                        diff, before[p] = z[0] - before[p], z[0]
                        n = abs(diff).bit_length()
                        put(*codes[0, min(p, 1)][n])
                        number(diff, n)
                        run = 0
                        for v in z[1:]:
                            if not v:
                                run += 1
                                continue
                            while run > 15:
                                put(*codes[1, min(p, 1)][0xF0])
                                run -= 16
                            n = abs(v).bit_length()
                            put(*codes[1, min(p, 1)][run << 4 | n])
                            number(v, n)
                            run = 0
                        if run:
                            put(*codes[1, min(p, 1)][0])
    flush()
    segment = lambda marker, body: bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body
    head = b"\xff\xd8" + segment(0xE0, b"AVI1") + segment(0xDB, bytes([0]) + bytes(quantiser.tolist()))
    if tables:
        head += b"".join(segment(0xC4, bytes([k << 4 | n]) + counts + values) for (k, n), (counts, values) in jpeg.STANDARD.items())
    if restart:
        head += segment(0xDD, struct.pack(">H", restart))
    head += segment(0xC0, struct.pack(">BHHB", 8, height, width, len(planes)) + b"".join(bytes([i + 1, a << 4 | d, 0]) for i, (a, d) in enumerate(sampling)))
    head += segment(0xDA, bytes([len(planes)]) + b"".join(bytes([i + 1, min(i, 1) * 0x11]) for i in range(len(planes))) + bytes([0, 63, 0]))
    return head + bytes(out) + b"\xff\xd9"


def smooth(draw, height, width):
    x, y = np.meshgrid(np.arange(width), np.arange(height))
    return np.clip(128 + 90 * np.sin(x / draw.uniform(5, 20)) * np.cos(y / draw.uniform(5, 20)) + draw.normal(0, 3, (height, width)), 0, 255).astype(np.uint8)


@pytest.mark.parametrize(("sampling", "tables", "restart"), [([(1, 1)], True, 0), ([(1, 1)], False, 3), ([(1, 1)] * 3, True, 0), ([(2, 2), (1, 1), (1, 1)], False, 2), ([(2, 1), (1, 1), (1, 1)], True, 0)])
def test_baseline_frames(sampling, tables, restart):
    draw = np.random.default_rng(len(sampling) + restart)
    most = max(a for a, _ in sampling), max(d for _, d in sampling)
    planes = [smooth(draw, 32 * d // most[1], 48 * a // most[0]) for a, d in sampling]
    got = jpeg.decode(encode_baseline(planes, sampling, tables=tables, restart=restart))
    assert got.shape == (32, 48, len(sampling))
    for i, plane in enumerate(planes):
        whole = plane.repeat(32 // plane.shape[0], axis=0).repeat(48 // plane.shape[1], axis=1)
        assert np.abs(got[:, :, i].astype(int) - whole).max() <= 6


def lossless_frame(image, predictor, restart_rows=0):
    """A plain encoder of the lossless process with a table of its own, of codes of several lengths."""
    height, width = image.shape
    counts, values = bytes([0, 1, 2, 2, 2, 1, 1] + [0] * 9), bytes([2, 1, 3, 0, 4, 5, 6, 7, 8])
    codes = {value: (code, bits) for bits, code, value in jpeg._codes((counts, values))}
    out, bits, first = bytearray(), [], 0
    for y in range(height):
        if restart_rows and y and y % restart_rows == 0:
            bits.extend([1] * (-len(bits) % 8))
            out.extend(np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00") + bytes([0xFF, 0xD0 + (y // restart_rows - 1) % 8]))
            bits, first = [], y
        for x in range(width):
            a, b, c = (int(image[y, x - 1]) if x else 0), (int(image[y - 1, x]) if y > first else 0), (int(image[y - 1, x - 1]) if x and y > first else 0)
            guess = (128 if y == first else b) if x == 0 else a if y == first else (a, b, c, a + b - c, a + ((b - c) >> 1), b + ((a - c) >> 1), (a + b) >> 1)[predictor - 1]
            diff = int(image[y, x]) - guess
            n = abs(diff).bit_length()
            for value, k in (codes[n], (diff if diff >= 0 else diff + (1 << n) - 1, n)):
                bits.extend((value >> i) & 1 for i in range(k - 1, -1, -1))
    bits.extend([1] * (-len(bits) % 8))
    out.extend(np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00"))
    segment = lambda marker, body: bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body
    head = b"\xff\xd8" + segment(0xC4, bytes([0]) + counts + values) + (segment(0xDD, struct.pack(">H", restart_rows * width)) if restart_rows else b"")
    head += segment(0xC3, struct.pack(">BHHB3B", 8, height, width, 1, 1, 0x11, 0)) + segment(0xDA, bytes([1, 1, 0, predictor, 0, 0]))
    return head + bytes(out) + b"\xff\xd9"


@pytest.mark.parametrize("predictor", range(1, 8))
@pytest.mark.parametrize("restart_rows", [0, 2])
def test_lossless_frames_of_other_geometry_and_tables(predictor, restart_rows):
    image = smooth(np.random.default_rng(predictor), 9, 13)
    assert (jpeg.decode(lossless_frame(image, predictor, restart_rows))[:, :, 0] == image).all()


def containers(frames):
    """One list of frames in files of different build: walked, with rec lists, absolute offsets, OpenDML indexes, another stream beside it."""
    chunk, listed = avi._chunk, avi._list
    main = struct.pack("<14I", 50_000, 0, 0, 0x10, len(frames), 0, 2, 0, 48, 32, 0, 0, 0, 0)
    head = lambda kind, scale, rate: struct.pack("<4s4sIHHIIIIIIII4H", kind, b"MJPG", 0, 0, 0, 0, scale, rate, 0, len(frames), 0, 0, 0, 0, 0, 48, 32)
    audio = listed(b"strl", chunk(b"strh", head(b"auds", 1, 8000)))

    def build(body, index=b"", wide=b""):
        video = listed(b"strl", chunk(b"strh", head(b"vids", 1, 20)) + (chunk(b"indx", wide) if wide else b""))
        return chunk(b"RIFF", b"AVI " + listed(b"hdrl", chunk(b"avih", main) + audio + video) + chunk(b"JUNK", b"xyz") + listed(b"movi", body) + index)

    pieces = [chunk(b"01dc", x) for x in frames]
    yield build(b"".join(chunk(b"00wb", b"abc") + x for x in pieces))
    yield build(b"".join(listed(b"rec ", chunk(b"00wb", b"a") + x) for x in pieces))
    plain = build(b"".join(pieces), chunk(b"idx1", bytes(16 * len(frames))))
    places, at = [], plain.index(b"movi") + 4
    for x in pieces:
        places.append(at)
        at += len(x)
    index = b"".join(struct.pack("<4sIII", b"01dc", 16, p, len(x)) for p, x in zip(places, frames, strict=True))
    yield build(b"".join(pieces), chunk(b"idx1", index))
    wide = lambda base: struct.pack("<HBBI4sQI", 2, 0, 1, len(frames), b"01dc", base, 0) + b"".join(struct.pack("<II", p + 8 - places[0], len(x)) for p, x in zip(places, frames, strict=True))
    shift = 8 + len(wide(0)) + (len(wide(0)) & 1)
    yield build(b"".join(pieces), wide=wide(places[0] + shift))
    top = lambda offset, size: struct.pack("<HBBI4s12x", 4, 0, 0, 1, b"01dc") + struct.pack("<QII", offset, size, len(frames))
    shift = 8 + len(top(0, 0))
    inner = chunk(b"ix01", wide(places[0] + shift))
    yield build(b"".join(pieces) + inner, wide=top(places[0] + shift + sum(map(len, pieces)), len(inner)))


def test_files_of_other_writers(spark):
    draw = np.random.default_rng(5)
    dark, light = smooth(draw, 32, 48) // 4, 255 - smooth(draw, 32, 48) // 4
    frames = [encode_baseline([x], [(1, 1)], tables=False) for x in [dark] * 5 + [light] * 6]
    lossless = [lossless_frame(x, 4) for x in (dark[:9, :13], light[:9, :13])]
    files = [*containers(frames), *containers([frames[0], b"", *lossless])]
    rows = avi.clips(spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(files)], "doc_id bigint, media binary")).collect()
    found = {}
    for r in rows:
        assert r.status == "ok"
        found.setdefault(r.doc_id, []).append((r.first_frame, r.frames, r.start_s))
    assert [sorted(found[i]) for i in range(5)] == [[(0, 5, 0.0), (5, 6, 0.25)]] * 5
    assert [sum(x[1] for x in found[5 + i]) for i in range(5)] == [4] * 5


def plain_feature(payload):
    """The feature of a payload, frame by frame."""
    frames = [payload[i : i + 576] for i in range(0, len(payload), 576)]
    changes = []
    for a, b in zip(frames, frames[1:], strict=False):
        changes.append(sum(abs(sum(x >> 4 == k for x in a) - sum(x >> 4 == k for x in b)) for k in range(16)) / 2 / 576)
    starts = [0]
    for i, change in enumerate(changes):
        near = changes[max(i - 4, 0) : i + 5]
        mean = sum(near) / len(near)
        spread = (sum(x * x for x in near) / len(near) - mean**2) ** 0.5 if len(near) > 1 else 0
        if change > max(mean + 1.5 * spread, 0.15) + 1e-9:
            starts.append(i + 1)
    return f"frames={len(frames)};shots={len(starts)};mean={sum(payload) / len(payload):.3f};starts_ms=" + ",".join(str(40 * s) for s in starts)


def test_features_and_files_equal_brute_force(docs, rows):
    for r in avi.digest(docs.where("doc_id is not null")).collect():
        text = next(x[1] for x in rows if x[0] == r.doc_id)
        if text is None or len(text) < 20_000:
            payload = avi.padded((text or "").encode())
            file = next(avi.encode_payloads([payload]))
            assert r.feature == plain_feature(payload) and (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())


def test_columns_are_kept(docs):
    clashing = docs.selectExpr("*", "1 as Media", "2 as other_0")
    assert avi.with_media(clashing).columns == [*clashing.columns, "media_"]


def test_empty_table(empty):
    assert avi.digest(empty).count() == 0
