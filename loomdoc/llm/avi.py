"""Media columns: AVI motion-JPEG clips in a binary column.

Reading: the RIFF file's headers tell the video stream and its rate; its frames are found through the OpenDML index (`indx`),
else through `idx1` (offsets from the `movi` list or from the file's start), else by walking the `movi` lists with
their `rec ` lists.  Frames are decoded as `jpeg` reads them: baseline and lossless, of any geometry, with
their own tables or the standard ones.  An empty frame repeats the one before it.

Writing: a payload of 8-bit samples becomes grey frames of SIDE x SIDE samples, each a
JPEG of its own.  JPEG's usual transform would change samples, so frames use
JPEG's lossless process (start of frame 3, predictor 1).  Their Huffman table
gives difference category c a code of 9 - c bits; with the c extra bits each
sample takes nine bits, so numpy codes and decodes all frames of a batch at once.
The file has the stream header, a `movi` list of `00dc` chunks and an `idx1` index.

A shot ends where the histogram difference of neighbouring frames (of the first component) exceeds an
adaptive threshold: the mean of the differences in a window around it plus
DEVIATIONS standard deviations, and at least LEAST_DIFFERENCE of the samples.

Defined results: a null text is an empty payload, padded like the others; equal
texts give equal files and features; an empty table gives no rows; `clips` gives a null media cell no row, and a cell that is no AVI
file, is damaged or has no frames one row without a clip, whose status says why; columns of docs are kept by `with_media`
whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jpeg, shared

SIDE = 24
FRAME = SIDE * SIDE
FRAMES_PER_SECOND = 25
FILL = 255
BINS = 16
NEIGHBOURS = 4
DEVIATIONS = 1.5
LEAST_DIFFERENCE = 0.15
#: Frames that are coded at a time.
BLOCK_FRAMES = 2048

# The parts of a lossless JPEG frame. Codes of category 8 have one bit, of category 0 nine.
_CATEGORIES = bytes([8, 7, 6, 5, 4, 3, 2, 1, 0])
_HUFFMAN = b"\xff\xc4" + struct.pack(">HB", 2 + 1 + 16 + 9, 0) + bytes([1] * 9 + [0] * 7) + _CATEGORIES
_FRAME = b"\xff\xc3" + struct.pack(">HBHHB3B", 11, 8, SIDE, SIDE, 1, 1, 0x11, 0)
_SCAN = b"\xff\xda" + struct.pack(">HB2B3B", 8, 1, 1, 0, 1, 0, 0)
JPEG_HEAD = b"\xff\xd8" + _HUFFMAN + _FRAME + _SCAN
JPEG_END = b"\xff\xd9"


def padded(payload: bytes) -> bytes:
    """payload with bytes 255 up to a positive multiple of the frame size."""
    return payload + bytes([FILL]) * (max(1, -(-len(payload) // FRAME)) * FRAME - len(payload))


def _code_table() -> np.ndarray:
    """Nine-bit code of each difference -255..255 (at +255)."""
    diff = np.arange(-255, 256)
    category = np.ceil(np.log2(np.abs(diff) + 1)).astype(int)
    # Canonical codes: category 8 is 0, 7 is 10, 6 is 110 and so on; the code of nine ones stays free.
    prefix = ((1 << (9 - category)) - 2) << category
    return (prefix + np.where(diff >= 0, diff, diff + (1 << category) - 1)).astype(np.uint16)


def encode_frames(samples: np.ndarray) -> np.ndarray:
    """Entropy-coded bytes (before stuffing) of frames, given as (n, FRAME) samples."""
    code = _code_table()
    image = samples.reshape(-1, SIDE, SIDE).astype(np.int16)
    diff = np.empty_like(image)
    diff[:, :, 1:] = image[:, :, 1:] - image[:, :, :-1]
    diff[:, 1:, 0] = image[:, 1:, 0] - image[:, :-1, 0]
    diff[:, 0, 0] = image[:, 0, 0] - 128
    c = code[diff.reshape(-1, FRAME // 8, 8) + 255]
    out = np.empty((*c.shape[:2], 9), dtype=np.uint8)
    for k in range(9):  # byte k holds the last k bits of code k-1 and the first 8-k of code k
        low = c[:, :, k - 1] << (8 - k) if k else 0
        out[:, :, k] = ((low | (c[:, :, k] >> (k + 1))) if k < 8 else c[:, :, 7]) & 255
    return out.reshape(len(samples), -1)


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def _list(kind: bytes, data: bytes) -> bytes:
    return _chunk(b"LIST", kind + data)


def write_avi(frames: list[bytes]) -> bytes:
    """An AVI file of JPEG frames with a stream header and an index."""
    n, largest = len(frames), max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // FRAMES_PER_SECOND, largest * FRAMES_PER_SECOND, 0, 0x10, n, 0, 1, largest, SIDE, SIDE, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FRAMES_PER_SECOND, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    form = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    header = _list(b"hdrl", _chunk(b"avih", main) + _list(b"strl", _chunk(b"strh", stream) + _chunk(b"strf", form)))
    body, index, at = [], [], 4
    for x in frames:
        body.append(chunk := _chunk(b"00dc", x))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(x)))
        at += len(chunk)
    return _chunk(b"RIFF", b"AVI " + header + _list(b"movi", b"".join(body)) + _chunk(b"idx1", b"".join(index)))


def _walk(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start of the body, size) of the chunks in a range; the last may be cut off."""
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        yield name, at + 8, min(size, end - at - 8)
        at += 8 + size + (size & 1)


def read_avi(data: bytes) -> tuple[list[bytes], float]:
    """Frames of an AVI file's first video stream, found through its index, and the microseconds per frame."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    delay, stream, streams, wide, movies, index = 1_000_000 / FRAMES_PER_SECOND, None, 0, b"", [], None
    try:
        for name, start, size in _walk(data, 0, len(data)):
            if name != b"RIFF":
                continue
            for inner, at, n in _walk(data, start + 4, start + size):
                if inner == b"LIST" and data[at : at + 4] == b"movi":
                    movies.append((at, at + n))
                elif inner == b"idx1" and index is None:
                    index = data[at : at + n]
                elif inner == b"LIST" and data[at : at + 4] == b"hdrl":
                    for part, where, m in _walk(data, at + 4, at + n):
                        if part == b"avih":
                            delay = struct.unpack_from("<I", data, where)[0] or delay
                        elif part == b"LIST" and data[where : where + 4] == b"strl":
                            own = {x: (y, z) for x, y, z in _walk(data, where + 4, where + m)}
                            if stream is None and b"strh" in own and data[own[b"strh"][0] : own[b"strh"][0] + 4] == b"vids":
                                stream = streams
                                scale, rate = struct.unpack_from("<II", data, own[b"strh"][0] + 20)
                                delay = 1_000_000 * scale / rate if scale and rate else delay
                                y, z = own.get(b"indx", (0, 0))
                                wide = data[y : y + z]
                            streams += 1
        if stream is None or not movies:
            raise ValueError("no video stream" if stream is None else "no movi list")
        tags = (b"%02ddc" % stream, b"%02ddb" % stream)
        if wide:
            frames = _by_wide_index(data, wide)
        elif index:
            frames = _by_index(data, index, movies[0][0], tags)
        else:
            frames = [data[at : at + n] for low, high in movies for at, n in _listed(data, low + 4, high, tags)]
    except struct.error as error:
        raise ValueError("the file is cut off") from error
    for i, frame in enumerate(frames):
        if not frame and i:
            frames[i] = frames[i - 1]
    return [x for x in frames if x], delay


def _listed(data: bytes, low: int, high: int, tags: tuple[bytes, bytes]) -> Iterator[tuple[int, int]]:
    """Places of the stream's chunks in a list and the `rec ` lists in it, however deep these are."""
    open_lists = [_walk(data, low, high)]
    while open_lists:
        found = next(open_lists[-1], None)
        if found is None:
            open_lists.pop()
            continue
        name, at, n = found
        if name == b"LIST" and data[at : at + 4] == b"rec ":
            open_lists.append(_walk(data, at + 4, at + n))
        elif name in tags:
            yield at, n


def _by_index(data: bytes, index: bytes, movi: int, tags: tuple[bytes, bytes]) -> list[bytes]:
    """Frames that idx1 lists; its offsets count from the movi list's name, or from the file's start if the first chunk is there."""
    entries = [x for x in struct.iter_unpack("<4sIII", index[: len(index) // 16 * 16]) if x[0] in tags]
    if not entries:
        raise ValueError("the index lists no frame")
    tag, _, offset, _ = entries[0]
    base = movi if data[movi + offset : movi + offset + 4] == tag else 0
    frames = []
    for tag, _, offset, size in entries:
        at = base + offset
        if data[at : at + 4] != tag or struct.unpack_from("<I", data, at + 4)[0] != size or at + 8 + size > len(data):
            raise ValueError("the index does not match its chunk")
        frames.append(data[at + 8 : at + 8 + size])
    return frames


def _by_wide_index(data: bytes, index: bytes, depth: int = 0) -> list[bytes]:
    """Frames that an OpenDML index lists: an index of chunks, or one of such indexes."""
    words, _, kind, n = struct.unpack_from("<HBBI", index)
    if kind == 0 and words == 4 and depth == 0:
        frames = []
        for offset, size, _ in struct.iter_unpack("<QII", index[24 : 24 + 16 * n]):
            frames += _by_wide_index(data, data[offset + 8 : offset + size], 1)
        return frames
    if kind != 1 or words != 2:
        raise ValueError("an unknown kind of index")
    (base,) = struct.unpack_from("<Q", index, 12)
    frames = []
    for offset, size in struct.iter_unpack("<II", index[24 : 24 + 8 * n]):
        at, size = base + offset, size & 0x7FFFFFFF
        if at + size > len(data) or struct.unpack_from("<I", data, at - 4)[0] != size:
            raise ValueError("the index does not match its chunk")
        frames.append(data[at : at + size])
    return frames


def encode_payloads(payloads: list[bytes]) -> Iterator[bytes]:
    """The AVI file of each payload (a positive multiple of the frame size)."""
    for group in _groups([len(x) // FRAME for x in payloads]):
        coded = encode_frames(np.frombuffer(b"".join(payloads[i] for i in group), dtype=np.uint8).reshape(-1, FRAME))
        at = 0
        for i in group:
            n = len(payloads[i]) // FRAME
            yield write_avi([JPEG_HEAD + coded[k].tobytes().replace(b"\xff", b"\xff\x00") + JPEG_END for k in range(at, at + n)])
            at += n


class Headers:
    """Headers of frames by their bytes: frames of one file, and mostly of one table, share them."""

    def __init__(self, most: int = 16):
        self.known: dict[bytes, jpeg.Header] = {}
        self.most = most

    def __call__(self, frame: bytes) -> tuple[jpeg.Header, bytes | None]:
        """The frame's header, and its scan without stuffing if numpy can decode it."""
        for head, header in self.known.items():
            if frame.startswith(head):
                if frame[-2:] != JPEG_END:
                    raise ValueError("the frame has no end")
                return header, frame[len(head) : -2].replace(b"\xff\x00", b"\xff")
        header = jpeg.parse(frame)
        scan = header.scans[0]
        if not header.constant or scan.end != len(frame) - 2:
            return header, None
        if len(self.known) >= self.most:
            del self.known[next(iter(self.known))]
        self.known[frame[: scan.begin]] = header
        return header, frame[scan.begin : scan.end].replace(b"\xff\x00", b"\xff")


def decode_frames(frames: list[bytes], headers: Headers) -> list[np.ndarray]:
    """Samples (height, width) of the first component of each frame; neighbours with one header are decoded together."""
    out: list[np.ndarray] = []
    held: list[bytes] = []
    last = None

    def done() -> None:
        if held:
            out.extend(jpeg.decode_many(last, held))
            held.clear()

    for frame in frames:
        header, coded = headers(frame)
        if header is not last or coded is None:
            done()
        last = header
        if coded is None:
            out.append(jpeg.decode(frame, header)[:, :, 0])
        else:
            held.append(coded)
    done()
    return out


#: What reading a damaged file can raise: numbers that make no sense, tables that are not there, data that ends early.
DAMAGED = (ValueError, ArithmeticError, LookupError, TypeError, struct.error, MemoryError)


def _said(error: Exception) -> str:
    return str(error) if isinstance(error, ValueError) else f"damaged: {type(error).__name__}"


def decode_files(files: list[bytes]) -> Iterator[tuple[list[np.ndarray] | None, float, str]]:
    """For each AVI file its frames' samples, its microseconds per frame and `ok`; or None, 0 and what is wrong with it."""
    headers, read = Headers(), []
    for x in files:
        try:
            read.append((*read_avi(x), "ok"))
        except DAMAGED as error:
            read.append(([], 0.0, _said(error)))
    for group in _groups([len(x) for x, _, _ in read]):
        try:
            # The usual case: all frames of the group at once.
            samples = decode_frames([f for i in group for f in read[i][0]], headers)
            at = 0
            for i in group:
                frames, delay, status = read[i]
                yield (samples[at : at + len(frames)], delay, "ok") if frames else (None, 0.0, status if status != "ok" else "no frames")
                at += len(frames)
        except DAMAGED:
            for i in group:
                frames, delay, status = read[i]
                try:
                    yield (decode_frames(frames, headers), delay, "ok") if frames else (None, 0.0, status if status != "ok" else "no frames")
                except DAMAGED as error:
                    yield None, 0.0, _said(error)


def _groups(sizes: list[int]) -> Iterator[list[int]]:
    """Neighbours whose sizes add up to about BLOCK_FRAMES."""
    group, total = [], 0
    for i, n in enumerate(sizes):
        group.append(i)
        total += n
        if total >= BLOCK_FRAMES:
            yield group
            group, total = [], 0
    if group:
        yield group


def shot_starts(frames: list[np.ndarray]) -> list[int]:
    """First frames of the shots; frames may differ in size."""
    n = len(frames)
    if n < 2:
        return [0]
    sizes = np.array([x.size for x in frames])
    flat = np.concatenate([x.reshape(-1) for x in frames])
    of = np.repeat(np.arange(n) * BINS, sizes)
    histogram = np.bincount((flat >> 4) + of, minlength=n * BINS).reshape(n, BINS) / sizes[:, None]
    change = np.abs(np.diff(histogram, axis=0)).sum(axis=1) / 2
    sums, squares = (np.concatenate([[0.0], np.cumsum(x)]) for x in (change, change**2))
    low = np.maximum(np.arange(n - 1) - NEIGHBOURS, 0)
    high = np.minimum(np.arange(n - 1) + NEIGHBOURS + 1, n - 1)
    count = high - low
    mean = (sums[high] - sums[low]) / count
    spread = np.sqrt(np.maximum((squares[high] - squares[low]) / count - mean**2, 0))
    return [0, *(np.flatnonzero(change > np.maximum(mean + DEVIATIONS * spread, LEAST_DIFFERENCE)) + 1).tolist()]


MAKE_FILES = 64


def _with_media(docs: DataFrame) -> DataFrame:
    """docs (text and others) with a column media."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, MAKE_FILES):
                batch = whole.slice(at, MAKE_FILES)
                payloads = [padded((x.as_py() or "").encode()) for x in batch.column("text")]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(encode_payloads(payloads)), type=pa.binary())], [*names, "media"])

    return docs.mapInArrow(run, ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in docs.schema) + ", media binary")


def with_media(docs: DataFrame) -> DataFrame:
    """docs with a binary column media (with underscores after it where docs has one) that holds the text's AVI file."""
    docs, back = shared.plain(docs, "text")
    return back(_with_media(docs), "media")


def clips(table: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """One row per shot: key, clip number, first frame, frames, start and end in seconds, and the status `ok`; of a file that cannot be read one row with what is wrong."""
    kind = table.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, MAKE_FILES):
                batch, rows = whole.slice(at, MAKE_FILES), []
                for key_of, (samples, delay, status) in zip(batch.column(0).to_pylist(), decode_files(batch.column(1).to_pylist()), strict=True):
                    if samples is None:
                        rows.append((key_of, None, None, None, None, None, status))
                        continue
                    starts = [*shot_starts(samples), len(samples)]
                    rows += [(key_of, i, a, b - a, a * delay / 1e6, b * delay / 1e6, status) for i, (a, b) in enumerate(zip(starts, starts[1:], strict=False))]
                columns = list(zip(*rows, strict=True)) or [[]] * 7
                types = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(columns, types, strict=True)], [key, "clip", "first_frame", "frames", "start_s", "end_s", "status"])

    return table.select(key, media).where(F.col(media).isNotNull()).mapInArrow(run, f"`{key}` {kind}, clip bigint, first_frame bigint, frames bigint, start_s double, end_s double, status string")


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: the payload as read back from the stored file, the file, and a feature of its shots."""
    stored = _with_media(docs.select("doc_id", "text").withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))).drop("text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, MAKE_FILES):
                batch, rows = whole.slice(at, MAKE_FILES), []
                files = batch.column("media").to_pylist()
                for file, (samples, delay, status) in zip(files, decode_files(files), strict=True):
                    if samples is None:
                        raise ValueError(f"a stored file cannot be read back: {status}")
                    payload, starts = b"".join(x.tobytes() for x in samples), shot_starts(samples)
                    mean = int(np.frombuffer(payload, np.uint8).sum(dtype=np.int64)) / len(payload)
                    feature = f"frames={len(samples)};shots={len(starts)};mean={mean:.3f};starts_ms=" + ",".join(str(int(s * delay // 1000)) for s in starts)
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(file), hashlib.sha256(file).hexdigest(), feature))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array([r[i] for r in rows], type=t) for i, t in enumerate(types))], names)

    return stored.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
