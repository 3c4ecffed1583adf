"""Media columns: payloads stored by content in tar shards; rows carry digest, shard, offset and length.

A text's bytes become the 8-bit samples of a grey PNG image of 192 columns. Each task writes the images
of its rows, each different one once per task, to tar shards of bounded size in the shared folder; no payload is
shuffled. The index keeps one place per digest, and all rows with that digest refer to it. A shard's name
holds the attempt that wrote it and only the index of a finished attempt names it, so a lost executor
leaves at worst a file that nothing refers to.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import _text
from skein.llm._work import filesystem, new_dir, store

#: Samples in a row of an image; payloads are padded with spaces to a multiple of it.
COLUMNS = 192
PAD_BYTE = b"\x20"
#: A shard is closed after this many bytes.
SHARD_BYTES = 64 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes that hold the signature and the whole header chunk.
HEADER_BYTES = 33


def payload_of(text: bytes) -> bytes:
    """The bytes and spaces up to a positive multiple of COLUMNS."""
    return text + PAD_BYTE * (-len(text) % COLUMNS if text else COLUMNS)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, level: int = 6) -> bytes:
    """A grey 8-bit image whose samples are the payload."""
    rows = len(payload) // COLUMNS
    lines = np.zeros((rows, COLUMNS + 1), np.uint8)  # each line begins with its filter, none
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, COLUMNS)
    header = struct.pack(">IIBBBBB", COLUMNS, rows, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def header_of(start: bytes) -> tuple[int, int, int, int]:
    """Width, height, bit depth and colour type from an image's first HEADER_BYTES bytes."""
    if start[:8] != SIGNATURE or start[12:16] != b"IHDR":
        raise ValueError("not an image of this store")
    return struct.unpack(">IIBB", start[16:26])


def from_png(image: bytes) -> bytes:
    """The samples of an image that to_png wrote."""
    width, height, _, _ = header_of(image)
    at, data = 8, []
    while at < len(image):
        (size,) = struct.unpack(">I", image[at : at + 4])
        if image[at + 4 : at + 8] == b"IDAT":
            data.append(image[at + 8 : at + 8 + size])
        at += size + 12
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    return lines[:, 1:].tobytes()


def feature_of(samples: bytes) -> str:
    """Rows, mean and deviation of the samples, the commonest sample, and a 4-bin histogram."""
    values = np.frombuffer(samples, np.uint8)
    count = np.bincount(values, minlength=256)
    bins = count.reshape(4, 64).sum(axis=1)
    return f"rows={len(values) // COLUMNS};mean={values.mean():.4f};std={values.std():.4f};mode={int(count.argmax())};bins={'/'.join(map(str, bins))}"


def digest(text_col: str = "text") -> "F.Column":
    """The payload's SHA-256 in lowercase hexadecimal, without leaving the JVM."""
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    n = F.octet_length(raw)
    pad = F.when(n == 0, COLUMNS).otherwise(F.pmod(-n, F.lit(COLUMNS))).cast("int")
    return F.sha2(F.concat(raw, F.repeat(F.lit(" "), pad).cast("binary")), 256)


def write_shards(docs: DataFrame, path: str, text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Store the payloads of all texts below `path`; one row (digest, shard, offset, length) per different payload.

    Null and empty texts are the payload of spaces alone. The rows are kept as a table, so that no
    later step writes shards again.
    """

    def write(batches):
        import tarfile
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        files, root = filesystem(path)
        files.create_dir(root, recursive=True)
        attempt, number, out, sent = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", 0, None, set()
        for batch in batches:
            rows = []
            pieces = _text.sliced(batch, "text")
            for name, text in chain.from_iterable(zip(piece.column("digest").to_pylist(), texts) for piece, texts in pieces):
                if name in sent:
                    continue
                sent.add(name)
                media = to_png(payload_of(text))
                if out is not None and at >= shard_bytes:
                    out.write(bytes(1024))
                    out.close()
                    out, number = None, number + 1
                if out is None:
                    shard, at = f"shard-{attempt}-{number:04d}.tar", 0
                    out = files.open_output_stream(f"{root}/{shard}")
                entry = tarfile.TarInfo(f"{name}.png")
                entry.size = len(media)
                head = entry.tobuf(tarfile.USTAR_FORMAT)
                out.write(head + media + bytes(-len(media) % 512))
                rows.append((name, shard, at + len(head), len(media)))
                at += len(head) + len(media) + -len(media) % 512
            if len(sent) > 200_000:
                sent.clear()
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(("digest", "shard", "offset", "length"), zip(*rows))))
        if out is not None:
            out.write(bytes(1024))
            out.close()

    texts = docs.select(digest(text_col).alias("digest"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    written = store(texts.mapInArrow(write, "digest string, shard string, offset long, length long"), "media-index")
    place = F.min(F.struct("shard", "offset", "length")).alias("place")
    return written.groupBy("digest").agg(place).select("digest", "place.*")


META = "width int, height int, bit_depth int, colour_type int"
READ = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _read(rows: DataFrame, path: str, added: str, length, values) -> DataFrame:
    """`rows` with what `values` gives for the first `length` bytes of each row's entry; a shard is opened once for the rows that follow each other in it."""
    import pyarrow as pa

    fields = [f.strip().split(" ") for f in added.split(",")]
    kinds = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[f[1]] for f in fields]
    names = [f[0] for f in fields]

    def run(batches):
        files, root = filesystem(path)
        source, name = None, None
        for batch in batches:
            found = []
            for row in batch.select(["shard", "offset", "length"]).to_pylist():
                if row["shard"] != name:
                    if source is not None:
                        source.close()
                    name = row["shard"]
                    source = files.open_input_file(f"{root}/{name}")
                source.seek(row["offset"])
                found.append(values(source.read(length(row))))
            if found:
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, t) for c, t in zip(zip(*found), kinds)]], [*batch.schema.names, *names])
        if source is not None:
            source.close()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, {added}")


def read_headers(index: DataFrame, path: str) -> DataFrame:
    """The index with the images' metadata, by range reads of HEADER_BYTES bytes."""
    ordered = index.repartition("shard").sortWithinPartitions("shard", "offset")
    return _read(ordered, path, META, lambda row: HEADER_BYTES, header_of)


def read_payloads(index: DataFrame, path: str) -> DataFrame:
    """The index with what the whole stored payloads give; rows are read in the order they have."""

    def values(image: bytes) -> tuple:
        samples = from_png(image)
        return len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(image), hashlib.sha256(image).hexdigest(), feature_of(samples)

    return _read(index, path, READ, lambda row: row["length"], values)


def with_media(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """`docs` without the text and with digest, shard, offset, length, metadata and what reading back gives.

    The metadata columns (width, height, bit depth, colour type) come from reads of HEADER_BYTES bytes, the others
    from whole stored payloads. Columns of `docs` that clash with the new ones are replaced. Null and empty texts are
    the payload of spaces alone. Repeated rows refer to one stored payload. An empty table gives an empty result and no shards.
    """
    path = path or new_dir(docs.sparkSession, "media")
    # Written, so that the join has plain exchanges on both sides and the rows of a payload with very many copies can be split.
    media = store(read_payloads(read_headers(write_shards(docs, path, text_col), path), path), "media-columns")
    rows = docs.withColumns({"digest": digest(text_col), "n_bytes": F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")})
    own = [c for c in docs.columns if c not in (text_col, *media.columns, "n_bytes")]
    return rows.select(*own, "n_bytes", "digest").join(media, "digest")


def report(docs: DataFrame) -> DataFrame:
    """Per document what the stored payload gives when it is read back."""
    return with_media(docs.select("doc_id", "text")).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height"
    )
