"""TIFF media columns: write and read bytes as pages of 8-bit samples.

The reader walks a file's image directories (either byte order), decodes PackBits, LZW or deflate strips and
tiles, undoes the horizontal predictor and gives one row per page. The writer makes such files of any payload, so
that a column can be stored as media and read back without loss.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbraframe.llm.common import ready, table, whole_text
from umbraframe.llm.pretok import text_parts

# Fixed values of the TIFF 6.0 format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 273, 277, 278, 279
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 317, 322, 323, 324, 325
NO_COMPRESSION, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
TYPE_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
NAMES = {NO_COMPRESSION: "none", LZW: "lzw", DEFLATE: "deflate", PACKBITS: "packbits", OLD_DEFLATE: "deflate"}

#: Samples across a page of stored text, most rows of a page, rows of a strip, and rows and columns of a tile.
COLUMNS, PAGE_ROWS, STRIP_ROWS, TILE = 64, 1024, 64, 32


class BadTiff(ValueError):
    """A file that is not a TIFF of 8-bit samples, or is torn."""


# ---- strips and tiles


def packbits_encode(data: bytes) -> bytes:
    """Runs of three or more equal bytes as runs, the rest as literals, in packets of 128 at most."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return b""
    starts = np.concatenate([[0], np.nonzero(np.diff(a))[0] + 1])
    lengths = np.diff(np.concatenate([starts, [len(a)]]))
    out, literal = bytearray(), 0

    def literals(end: int) -> None:
        for i in range(literal, end, 128):
            part = data[i : min(i + 128, end)]
            out.append(len(part) - 1)
            out.extend(part)

    for k in np.nonzero(lengths >= 3)[0].tolist():
        start, n = int(starts[k]), int(lengths[k])
        literals(start)
        literal = start + n
        while n:
            m = min(n, 128)
            if m == 1:
                out += bytes((0, data[start]))
            else:
                out += bytes((257 - m, data[start]))
            n -= m
    literals(len(data))
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i, have = [], 0, 0
    while have < size and i < len(data):
        n = data[i]
        i += 1
        if n < 128:
            part = data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            part = data[i : i + 1] * (257 - n)
            i += 1
        else:
            continue
        out.append(part)
        have += len(part)
    return b"".join(out)[:size]


def _lzw_widths(n: int) -> np.ndarray:
    """Bits of the first n codes after a clear code: both sides' tables grow by one with each code but the first."""
    size = 257 + np.maximum(np.arange(n), 1)
    return 9 + (size + 1 >= 512).astype(np.int64) + (size + 1 >= 1024) + (size + 1 >= 2048)


#: Codes between two clear codes, at most; their bits and where they begin.
LZW_RUN = 4094 - 258 + 2
_LZW_WIDTHS = _lzw_widths(LZW_RUN)
_LZW_STARTS = np.concatenate([[0], np.cumsum(_LZW_WIDTHS)])


def _packed(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes one after another, from the high bit down: each lies in three bytes at most, and no two share a bit."""
    starts = np.cumsum(widths) - widths
    total = int(starts[-1] + widths[-1])
    at, window = starts >> 3, codes << (24 - widths - (starts & 7))
    out = sum(np.bincount(at + k, window >> (16 - 8 * k) & 255, (total + 7 >> 3) + 2) for k in range(3))
    return out.astype(np.uint8)[: total + 7 >> 3].tobytes()


def lzw_encode(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits from the high bit down, one code earlier than the table's size.

    Words are numbered by (word before, byte), so each byte costs one look-up of a number.
    """
    codes, widths, run, table, following, word = [256], [np.array([9])], [], {}, 258, -1
    for byte in data:
        if word < 0:
            word = byte
            continue
        longer = table.get(word << 8 | byte)
        if longer is not None:
            word = longer
            continue
        run.append(word)
        table[word << 8 | byte] = following
        following += 1
        word = byte
        if following == 4095:
            codes += [*run, 256]
            widths.append(_LZW_WIDTHS[: len(run) + 1])
            run, table, following = [], {}, 258
    run += [word] * (word >= 0) + [257]
    widths.append(_LZW_WIDTHS[: len(run)])
    return _packed(np.array(codes + run, np.int64), np.concatenate(widths))


def lzw_decode(data: bytes, size: int) -> bytes:
    """The codes of a run are read at once, as their bits follow from their places alone; the words one by one."""
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)]).astype(np.int64)
    three = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
    out, have, bit, plain = [], 0, 0, [bytes((i,)) for i in range(256)] + [b"", b""]
    while have < size:
        starts = _LZW_STARTS[:LZW_RUN] + bit
        starts = starts[: np.searchsorted(starts + _LZW_WIDTHS, 8 * len(data), "right")]
        codes = three[starts >> 3] >> (24 - _LZW_WIDTHS[: len(starts)] - (starts & 7)) & (1 << _LZW_WIDTHS[: len(starts)]) - 1
        stops = np.nonzero((codes == 256) | (codes == 257))[0]
        n = int(stops[0]) if len(stops) else len(codes)
        words, last = list(plain), b""
        for code in codes[:n].tolist():
            if code < len(words):
                word = words[code]
            elif code == len(words) and last:
                word = last + last[:1]
            else:
                raise BadTiff("an LZW code out of order")
            if last:
                words.append(last + word[:1])
            out.append(word)
            have += len(word)
            last = word
            if have >= size:
                break
        if not len(stops) or codes[n] == 257:
            break
        bit += int(_LZW_STARTS[n + 1])
    return b"".join(out)[:size]


def compressed(data: bytes, how: int) -> bytes:
    return {NO_COMPRESSION: lambda: data, LZW: lambda: lzw_encode(data), DEFLATE: lambda: zlib.compress(data, 1), PACKBITS: lambda: packbits_encode(data)}[how]()


def expanded(data: bytes, how: int, size: int) -> bytes:
    if how == NO_COMPRESSION:
        out = data[:size]
    elif how == LZW:
        out = lzw_decode(data, size)
    elif how in (DEFLATE, OLD_DEFLATE):
        try:
            out = zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise BadTiff(str(e)) from e
    elif how == PACKBITS:
        out = packbits_decode(data, size)
    else:
        raise BadTiff(f"compression {how}")
    if len(out) < size:
        raise BadTiff("a strip or tile is too short")
    return out


# ---- files


def write_tiff(pages: list[np.ndarray], how: int = DEFLATE, predictor: int = 1, tiled: bool = False) -> bytes:
    """A little-endian TIFF of greyscale pages (rows x columns of 8-bit samples)."""
    out = bytearray(struct.pack("<2sHI", b"II", 42, 0))
    link = 4  # where the place of the next directory goes
    for page in pages:
        rows, columns = page.shape
        if tiled:
            down, across = -(-rows // TILE), -(-columns // TILE)
            full = np.zeros((down * TILE, across * TILE), np.uint8)
            full[:rows, :columns] = page
            parts = [full[i * TILE : (i + 1) * TILE, j * TILE : (j + 1) * TILE] for i in range(down) for j in range(across)]
        else:
            parts = [page[i : i + STRIP_ROWS] for i in range(0, rows, STRIP_ROWS)]
        if predictor == 2:
            parts = [np.diff(p, axis=1, prepend=np.zeros((len(p), 1), np.uint8)) for p in parts]
        places, sizes = [], []
        for p in parts:
            places.append(len(out))
            out += (data := compressed(np.ascontiguousarray(p).tobytes(), how))
            sizes.append(len(data))
        tags = {WIDTH: [columns], HEIGHT: [rows], BITS: [8], COMPRESSION: [how], PHOTOMETRIC: [1], SAMPLES: [1], PREDICTOR: [predictor]}
        tags |= {TILE_WIDTH: [TILE], TILE_HEIGHT: [TILE], TILE_OFFSETS: places, TILE_BYTES: sizes} if tiled else {STRIP_OFFSETS: places, ROWS_PER_STRIP: [STRIP_ROWS], STRIP_BYTES: sizes}
        out += b"\0" * (len(out) % 2)
        values = {}
        for tag, x in tags.items():
            if len(x) > 1:
                values[tag] = len(out)
                out += struct.pack(f"<{len(x)}I", *x)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags))
        for tag in sorted(tags):
            out += struct.pack("<HHII", tag, 4, len(tags[tag]), values.get(tag, tags[tag][0]))
        link = len(out)
        out += struct.pack("<I", 0)
    return bytes(out)


def directories(data: bytes) -> Iterator[dict[int, tuple]]:
    """tag -> values of each image directory; a directory that comes again ends the walk."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    try:
        if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
            raise BadTiff("not a TIFF")
        (at,), seen = struct.unpack_from(order + "I", data, 4), set()
        while at and at not in seen:
            seen.add(at)
            (n,) = struct.unpack_from(order + "H", data, at)
            tags = {}
            for i in range(n):
                tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
                if kind in TYPE_CODES:
                    where = at + 10 + 12 * i
                    if TYPE_SIZES[kind] * count > 4:
                        (where,) = struct.unpack_from(order + "I", data, where)
                    tags[tag] = struct.unpack_from(f"{order}{count}{TYPE_CODES[kind]}", data, where)
            yield tags
            (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
    except struct.error as e:
        raise BadTiff(str(e)) from e


def page_of(data: bytes, tags: dict[int, tuple]) -> np.ndarray:
    """The samples of a page: rows x (columns * samples a pixel)."""
    try:
        rows, columns, samples = tags[HEIGHT][0], tags[WIDTH][0], tags.get(SAMPLES, (1,))[0]
        how, predictor = tags.get(COMPRESSION, (1,))[0], tags.get(PREDICTOR, (1,))[0]
        if set(tags.get(BITS, (1,))) != {8} or predictor not in (1, 2):
            raise BadTiff("samples that are not of 8 bits, or an unknown predictor")
        tiled = TILE_OFFSETS in tags
        places, sizes = (tags[TILE_OFFSETS], tags[TILE_BYTES]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_BYTES])
        high, wide = (tags[TILE_HEIGHT][0], tags[TILE_WIDTH][0]) if tiled else (min(tags.get(ROWS_PER_STRIP, (rows,))[0], rows), columns)
    except KeyError as e:
        raise BadTiff(f"tag {e} is missing") from e
    down, across = -(-rows // high), -(-columns // wide)
    if len(places) < down * across or len(sizes) < down * across:
        raise BadTiff("strips or tiles are missing")
    out = np.zeros((down * high, across * wide, samples), np.uint8)
    for k in range(down * across):
        i, j = divmod(k, across)
        tall = high if tiled else min(high, rows - i * high)
        part = np.frombuffer(expanded(data[places[k] : places[k] + sizes[k]], how, tall * wide * samples), np.uint8).reshape(tall, wide, samples)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=np.uint8)
        out[i * high : i * high + tall, j * wide : (j + 1) * wide] = part
    return out[:rows, :columns].reshape(rows, columns * samples)


def pages_of(data: bytes) -> Iterator[tuple[dict[int, tuple], np.ndarray]]:
    for tags in directories(data):
        yield tags, page_of(data, tags)


# ---- payloads


def padded(content: bytes, multiple: int = 64) -> bytes:
    """With bytes 0 appended up to a positive multiple."""
    return content + b"\0" * (max(multiple, -(-len(content) // multiple) * multiple) - len(content))


def layout(payload: bytes) -> tuple[int, int, bool]:
    """(compression, predictor, tiled) by the payload's CRC alone, so that all of them occur at every size and equal payloads agree."""
    pick = zlib.crc32(payload)
    how = (PACKBITS, DEFLATE, DEFLATE, LZW)[pick % 4]
    return how, 2 if how != PACKBITS and pick >> 2 & 1 else 1, bool(pick >> 3 & 1)


def payload_to_tiff(payload: bytes) -> bytes:
    samples = np.frombuffer(payload, np.uint8).reshape(-1, COLUMNS)
    return write_tiff([samples[i : i + PAGE_ROWS] for i in range(0, len(samples), PAGE_ROWS)], *layout(payload))


#: Bytes of samples after which rows are handed on.
BATCH_BYTES = 4_000_000


def write_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as TIFF media: doc_id, n_bytes (of the text), media.

    Defined cases: a null text is empty; an empty text is a payload of 64 bytes 0; null ids pass through;
    repeated rows each get a row, equal texts equal media; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_parts(batch.column(1), 2_000_000):
                contents = [t.encode() for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], pa.array(map(len, contents), pa.int64()), pa.array([payload_to_tiff(padded(c)) for c in contents], pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text")).transform(ready).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def read_pages(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per page: doc_id, page (from 0), pages, width, height, compression, predictor, tiled, samples, error, and the columns named in ``keep``.

    The pages of a medium follow each other, in their order. Defined cases: null or empty media give no rows; media that are
    no TIFF of 8-bit samples, or are torn, give one row with an error where the walk ends (``pages`` is the number of rows);
    repeated rows give their pages each; null ids pass through; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0

            def flush():
                nonlocal rows, size
                columns = zip(*rows, strict=True)
                at = pa.array(next(columns), pa.int64())
                carried = [batch.column(0).take(at), *(c.take(at) for c in batch.columns[2:])]
                rows, size = [], 0
                return pa.RecordBatch.from_arrays([carried[0], *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True)), *carried[1:]], names)

            for i, cell in enumerate(batch.column(1)):
                first, data = len(rows), cell.as_py()
                try:
                    for n, (tags, page) in enumerate(pages_of(data) if data else ()):
                        rows.append([i, n, 0, page.shape[1], page.shape[0], NAMES[tags.get(COMPRESSION, (1,))[0]], tags.get(PREDICTOR, (1,))[0], TILE_OFFSETS in tags, page.tobytes(), None])
                        size += page.size
                except BadTiff as e:
                    rows.append([i, len(rows) - first, 0, *[None] * 6, str(e)])
                for row in rows[first:]:
                    row[2] = len(rows) - first
                if size > BATCH_BYTES:
                    yield flush()
            if rows:
                yield flush()

    names = ["doc_id", "page", "pages", "width", "height", "compression", "predictor", "tiled", "samples", "error", *keep]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.binary(), pa.string()]
    slim = media.select(F.col(id_col).alias("doc_id"), F.col(media_col).cast("binary").alias("media"), *keep)
    fields = [f"{c} {slim.schema[c].dataType.simpleString()}" for c in ("doc_id", *keep)]
    return slim.transform(ready).mapInArrow(run, ", ".join([fields[0], "page int, pages int, width int, height int, compression string, predictor int, tiled boolean, samples binary, error string", *fields[1:]]))


def feature_of(pages: list[dict]) -> str:
    """Pages, rows, compression, predictor, layout, mean sample and mean step along a row, from rows of :func:`read_pages`."""
    rows, first = sum(p["height"] for p in pages), pages[0]
    samples = [np.frombuffer(p["samples"], np.uint8).reshape(p["height"], p["width"]) for p in pages]
    total = sum(int(p.sum(dtype=np.int64)) for p in samples)
    steps = sum(int(np.abs(np.diff(p.astype(np.int16), axis=1)).sum(dtype=np.int64)) for p in samples)
    return f"pages={len(pages)};rows={rows};codec={first['compression']};predictor={first['predictor']};{'tiles' if first['tiled'] else 'strips'};mean={total / (rows * COLUMNS):.4f};step={steps / (rows * (COLUMNS - 1)):.4f}"


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as TIFF media, read back page by page: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    :func:`write_media` and :func:`read_pages` do the work; the pages of a medium are then folded where they lie, as they follow
    each other. The same cases are defined as for :func:`write_media`.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["error"]:
                    raise BadTiff(row["error"])
                held.append(row)
                if len(held) == row["pages"]:
                    back = b"".join(p["samples"] for p in held)
                    out.append((row["doc_id"], row["n_bytes"], len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), row["media_bytes"], row["media_sha256"], feature_of(held)))
                    held = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (batch.schema.field(0).type, *kinds), strict=True)], names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    media = write_media(docs, id_col, text_col)
    media = media.withColumn("media_bytes", F.octet_length("media").cast("long")).withColumn("media_sha256", F.sha2("media", 256))
    pages = read_pages(media, keep=("n_bytes", "media_bytes", "media_sha256"))
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return pages.transform(ready).mapInArrow(fold, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_texts(table(spark, sf_dir, "documents"))
