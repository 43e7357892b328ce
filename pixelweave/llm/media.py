"""Texts as grey images in archives, written and read by a data source of byte ranges.

`media_archive` writes rows (name, media) into archives of bounded size below one folder and lists the committed ones in a
manifest; an index of member offsets lies beside each archive. Reading plans one partition for each byte range of each
archive, streams members through Arrow, and reads a member that fails again by its own offset.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..session import staging_dir
from .common import map_rows, table, texts

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEAD = struct.Struct("<4sIQI")  # mark, length of name, length of media, CRC-32 of both
MARK = b"MEMB"
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES, TRIES = 64 << 20, 8 << 20, 8 << 20, 3


def payload_of(text: str) -> tuple[int, bytes]:
    """(bytes of the text, UTF-8 filled up with 0 to a positive multiple of 64)."""
    raw = text.encode()
    return len(raw), raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def encode_image(payload: bytes) -> bytes:
    """An 8-bit grey PNG, 64 samples wide, one sample for each byte."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    parts = ((b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(rows.tobytes(), 6)), (b"IEND", b""))
    return SIGNATURE + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in parts)


def decode_image(media: bytes) -> bytes:
    """The samples of an image of `encode_image`; checks signature, checksums and size."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG image")
    at, size, data = 8, None, []
    while at < len(media):
        n = struct.unpack_from(">I", media, at)[0]
        kind, body = media[at + 4:at + 8], media[at + 8:at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError(f"damaged {kind!r} chunk")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, WIDTH + 1)
    if size != (WIDTH, len(rows), 8, 0, 0, 0, 0) or rows[:, 0].any():
        raise ValueError("another kind of image")
    return rows[:, 1:].tobytes()


def features(payload: bytes) -> str:
    """Mean and spread of the samples, and one bit for each column brighter than the mean."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    columns = image.mean(0)
    bits = np.packbits(columns > columns.mean()).tobytes().hex()
    return f"{image.mean():.3f}:{image.std():.3f}:{bits}"


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class MediaArchive(DataSource):
    """Options: `path`, and `range_bytes` for reading."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "name string, media binary"

    def writer(self, schema, overwrite):
        return ArchiveWriter(self.options["path"])

    def reader(self, schema):
        return ArchiveReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))


class Committed(WriterCommitMessage):
    def __init__(self, archives: list[tuple[str, int]]) -> None:
        self.archives = archives


class ArchiveWriter(DataSourceArrowWriter):
    """Each task attempt writes files of its own; only those of committed attempts enter the manifest."""

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Committed:
        files, root = _filesystem(self.path)
        files.create_dir(root, recursive=True)
        done: list[tuple[str, int]] = []
        out, offsets, size, name = None, [], 0, ""

        def close() -> None:
            out.close()
            with files.open_output_stream(f"{root}/{name}.idx") as f:
                f.write(np.array(offsets, "<u8").tobytes())
            done.append((name, size))

        for batch in iterator:
            for key, media in zip(batch.column("name").to_pylist(), batch.column("media"), strict=True):
                if out is not None and size >= ARCHIVE_BYTES:
                    close()
                    out = None
                if out is None:
                    name, offsets, size = f"media-{uuid.uuid4().hex}", [], 0
                    out = files.open_output_stream(f"{root}/{name}.bin")
                raw, body = (key or "").encode(), memoryview(media.as_buffer())
                offsets.append(size)
                out.write(HEAD.pack(MARK, len(raw), len(body), zlib.crc32(body, zlib.crc32(raw))) + raw)
                out.write(body)
                size += HEAD.size + len(raw) + len(body)
        if out is not None:
            close()
        return Committed(done)

    def commit(self, messages) -> None:
        files, root = _filesystem(self.path)
        files.create_dir(root, recursive=True)
        with files.open_output_stream(f"{root}/manifest-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([a for m in messages if m for a in m.archives]).encode())

    def abort(self, messages) -> None:
        """Files of failed attempts stay out of every manifest and are never read."""


class ByteRange(InputPartition):
    def __init__(self, archive: str, low: int, high: int) -> None:
        self.archive, self.low, self.high = archive, low, high


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int) -> None:
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[ByteRange]:
        """Byte ranges of all committed archives; a member belongs to the range its first byte lies in."""
        from pyarrow import fs

        files, root = _filesystem(self.path)
        out = []
        for info in files.get_file_info(fs.FileSelector(root)):
            if info.base_name.startswith("manifest-"):
                with files.open_input_stream(info.path) as f:
                    for name, size in json.loads(f.read()):
                        out += [ByteRange(name, low, min(low + self.range_bytes, size)) for low in range(0, size, self.range_bytes)]
        return out or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        files, root = _filesystem(self.path)
        with files.open_input_stream(f"{root}/{partition.archive}.idx") as f:
            offsets = np.frombuffer(f.read(), "<u8")
        schema = pa.schema([("name", pa.string()), ("media", pa.binary())])
        names, medias, size, member = [], [], 0, None
        for at in offsets[(offsets >= partition.low) & (offsets < partition.high)].tolist():
            for attempt in range(TRIES):
                try:
                    member = member or files.open_input_file(f"{root}/{partition.archive}.bin")
                    name, media = read_member(member, at)
                    break
                except (OSError, ValueError):
                    if member is not None:
                        member.close()
                    member = None  # the next try opens the archive again, at this member's offset
                    if attempt == TRIES - 1:
                        raise
                    time.sleep(0.2 * 4 ** attempt)
            names.append(name)
            medias.append(media)
            size += len(media)
            if size >= BATCH_BYTES:
                yield pa.record_batch([names, medias], schema=schema)
                names, medias, size = [], [], 0
        if member is not None:
            member.close()
        if names:
            yield pa.record_batch([names, medias], schema=schema)


def read_member(archive, at: int) -> tuple[str, bytes]:
    """(name, media) of the member at an offset; ValueError if it is damaged."""
    archive.seek(at)
    head = archive.read(HEAD.size)
    if len(head) < HEAD.size or head[:4] != MARK:
        raise ValueError(f"no member at {at}")
    _, n, m, crc = HEAD.unpack(head)
    raw, body = archive.read(n), archive.read(m)
    if len(body) < m or zlib.crc32(body, zlib.crc32(raw)) != crc:
        raise ValueError(f"damaged member at {at}")
    return raw.decode(), body


def write_media(docs: DataFrame, path: str) -> None:
    """Store every text as an image in archives below `path`; names are `doc_id:bytes`, with an empty id for null."""

    def run(batches):
        for b in batches:
            for ids, ts in _portions(b):
                made = [payload_of(t) for t in ts]
                yield {"name": [f"{'' if i is None else i}:{n}" for i, (n, _) in zip(ids, made, strict=True)], "media": [encode_image(p) for _, p in made]}

    docs.sparkSession.dataSource.register(MediaArchive)
    map_rows(texts(docs), run, "name string, media binary").write.format("media_archive").mode("append").save(path)


def _portions(b: pa.RecordBatch, most: int = BATCH_BYTES):
    """Rows of a batch in runs of about `most` characters."""
    ids, ts, size = [], [], 0
    for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
        ids.append(i)
        ts.append(t)
        size += len(t)
        if size >= most:
            yield ids, ts
            ids, ts, size = [], [], 0
    if ids:
        yield ids, ts


def read_media(spark, path: str) -> DataFrame:
    """(name, media) of all members below `path`."""
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").load(path)


def media_columns(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row of digests and features for each document, computed from the stored bytes.

    Null and empty texts are 64 zero bytes; a null doc_id is stored like any other; equal texts give equal values, repeated
    rows repeated rows; other columns are ignored. `path` must be a folder all executors share.
    """
    spark = docs.sparkSession
    path = path or f"{staging_dir(spark)}/media-{uuid.uuid4().hex}"
    write_media(docs, path)

    def run(batches):
        for b in batches:
            ids, sizes, out = [], [], []
            for name, media in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                i, n = name.split(":")
                payload = decode_image(media)
                ids.append(int(i) if i else None)
                sizes.append(int(n))
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), features(payload)))
            names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
            yield {"doc_id": ids, "n_bytes": sizes, **{c: [x[k] for x in out] for k, c in enumerate(names)}}

    return map_rows(read_media(spark, path), run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op8(spark, sf_dir):
    return media_columns(table(spark, sf_dir, "documents"))
