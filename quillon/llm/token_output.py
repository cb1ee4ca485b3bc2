"""Token ids to binary files and back.

Ids are replaced by their rank in the corpus (most frequent first) and written byte-aligned:
one, two, three or four data bytes an id, with the lengths in separate control bytes of four
two-bit codes. A decoder takes each control byte to four lengths through a 256-row numpy table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .shared import fresh_path, settle, spread

MAGIC = b"QTOK1\n"
FILE_BYTES = 8 << 20
#: Ids that are packed together, at least: whole documents.
BLOCK_IDS = 1 << 16
#: For each control byte, the four lengths in bytes.
LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)


def pack_ranks(ranks: np.ndarray) -> bytes:
    """Control bytes, then data bytes; the number of ids is kept elsewhere."""
    n = len(ranks)
    padded = np.zeros(-(-n // 4) * 4, "<u4")
    padded[:n] = ranks
    size = 1 + (padded > 0xFF).astype(np.uint8) + (padded > 0xFFFF) + (padded > 0xFFFFFF)
    size[n:] = 1
    codes = (size - 1).reshape(-1, 4)
    control = (codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6).astype(np.uint8)
    cells = padded.view(np.uint8).reshape(-1, 4)[:n]
    return control.tobytes() + cells[np.arange(4, dtype=np.uint8) < size[:n, None]].tobytes()


def unpack_ranks(block: bytes, n: int) -> np.ndarray:
    groups = -(-n // 4)
    size = LENGTHS[np.frombuffer(block, np.uint8, groups)].reshape(-1)[:n]
    cells = np.zeros((n, 4), np.uint8)
    cells[np.arange(4, dtype=np.uint8) < size[:, None]] = np.frombuffer(block, np.uint8, offset=groups)
    return cells.view("<u4").reshape(-1)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("/") else f"file://{uri}")


@dataclass(frozen=True)
class TokenFiles:
    """What ``write_token_files`` left: the folder, a row for each task that wrote, and the ids by rank."""

    path: str
    parts: DataFrame
    id_of_rank: np.ndarray


def write_token_files(docs: DataFrame, tokenizer_json: str, end_id: int, path: str | None = None, text: str = "text", key: str = "doc_id") -> TokenFiles:
    """Encode ``docs`` and write the ids into files in ascending order of ``key``.

    Null texts count as empty and give the end id alone. Null keys come first; rows of one key
    lie in the order of their ids. Other columns are not read. An empty table gives no file.
    Each try of a task has a tag of its own in its files' names and only the tags in ``parts``
    count, so lost tasks leave no double rows. Keys are whole numbers.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "token-files")
    shipped = spark.sparkContext.broadcast(tokenizer_json)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shipped.value)
        counts: np.ndarray = np.zeros(0, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = enc.encode([x or "" for x in part.column(1).to_pylist()])
                end = np.array([end_id], enc.dtype).tobytes()
                ids = [x + end for x in ids]
                seen = np.bincount(np.frombuffer(b"".join(ids), enc.dtype))
                if len(seen) > len(counts):
                    counts = np.pad(counts, (0, len(seen) - len(counts)))
                counts[: len(seen)] += seen
                none = pa.nulls(len(ids), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), none, none], names=["key", "ids", "id", "n"])
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(used), key_arrow), pa.nulls(len(used), pa.binary()), pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())], names=["key", "ids", "id", "n"])

    keyed = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = keyed.schema["key"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    key_arrow = to_arrow_type(keyed.schema["key"].dataType)
    encoded = settle(keyed.mapInArrow(encode, f"key {kind}, ids binary, id long, n long"), "encoded")
    # at most one row for each id of the vocabulary
    ranked = encoded.filter("id is not null").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").select("id").toPandas()["id"].to_numpy(np.int64)
    rank_of_id = np.zeros(int(ranked.max()) + 1 if len(ranked) else 1, "<u4")
    rank_of_id[ranked] = np.arange(len(ranked))
    ranks = spark.sparkContext.broadcast(rank_of_id)
    wide = "<u2" if end_id < 65536 and _small_vocabulary(tokenizer_json) else "<u4"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _filesystem(path)
        tag, part = uuid.uuid4().hex, TaskContext.get().partitionId()
        made, ids_before, size = 0, 0, 0
        rows: list[tuple] = []  # a document: no key, key, ids
        blocks: list[tuple] = []  # a block: documents, ids, bytes
        body: list[bytes] = []
        open_ids: list[np.ndarray] = []

        def close_block() -> None:
            nonlocal open_ids, size
            if open_ids:
                ids = np.concatenate(open_ids)
                body.append(pack_ranks(ranks.value[ids]))
                blocks.append((len(open_ids), len(ids), len(body[-1])))
                size, open_ids = size + len(body[-1]), []

        def flush() -> None:
            nonlocal made, ids_before, size, rows, blocks, body
            files.create_dir(base, recursive=True)
            with files.open_output_stream(f"{base}/part-{part:06d}-{tag}-{made:05d}.qtok") as f:
                f.write(MAGIC)
                f.write(np.array([len(rows), len(blocks), ids_before], "<i8").tobytes())
                f.write(np.array(rows, "<i8").tobytes())
                f.write(np.array(blocks, "<i8").tobytes())
                for x in body:
                    f.write(x)
            made, ids_before = made + 1, ids_before + sum(r[2] for r in rows)
            rows, blocks, body, size = [], [], [], 0

        waiting = 0
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.frombuffer(x.as_buffer(), wide)
                rows.append((k is None, k or 0, len(ids)))
                open_ids.append(ids)
                waiting += len(ids)
                if waiting >= BLOCK_IDS:
                    close_block()
                    waiting = 0
                    if size >= FILE_BYTES:
                        flush()
        close_block()
        if rows:
            flush()
        if made:
            yield pa.RecordBatch.from_pylist([{"part": part, "tag": tag, "files": made, "ids": ids_before}], _PARTS)

    rows = encoded.filter("ids is not null").select(F.col("key").cast("long").alias("key"), "ids")
    n = spread(rows)
    dealt = rows.repartitionByRange(n, F.col("key").asc_nulls_first()).sortWithinPartitions(F.col("key").asc_nulls_first(), "ids")
    parts = settle(dealt.mapInArrow(write, "part int, tag string, files int, ids long"), "token-file-parts")
    return TokenFiles(path, parts, ranked)


_PARTS = pa.schema([("part", pa.int32()), ("tag", pa.string()), ("files", pa.int32()), ("ids", pa.int64())])
_ROWS = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])


def _small_vocabulary(tokenizer_json: str) -> bool:
    return encoder(tokenizer_json).dtype == np.dtype("<u2")


def read_token_files(written: TokenFiles) -> DataFrame:
    """Every document in the files: ``key, start, ids`` (little-endian unsigned 32-bit words).

    ``start`` counts the ids of all documents before it, over all files.
    """
    spark = written.parts.sparkSession
    # as many rows as the writing job had tasks
    parts = written.parts.orderBy("part").toPandas()
    schema = "key long, start long, ids binary"
    if not len(parts):
        return spark.createDataFrame([], schema)
    before = spark.sparkContext.broadcast(dict(zip(parts["tag"], (parts["ids"].cumsum() - parts["ids"]).tolist(), strict=True)))
    table = spark.sparkContext.broadcast(written.id_of_rank.astype("<u4"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                tag = name.rsplit("-", 2)[1]
                if tag not in before.value:  # left by a try of a task that was lost
                    continue
                view = memoryview(content.as_buffer())
                if bytes(view[: len(MAGIC)]) != MAGIC:
                    raise ValueError(f"{name} is not a file of token ids")
                n, n_blocks, start = np.frombuffer(view, "<i8", 3, len(MAGIC)).tolist()
                at = len(MAGIC) + 24
                rows = np.frombuffer(view, "<i8", 3 * n, at).reshape(n, 3)
                blocks = np.frombuffer(view, "<i8", 3 * n_blocks, at + 24 * n).reshape(n_blocks, 3)
                at, start, row = at + 24 * (n + n_blocks), start + before.value[tag], 0
                for docs, ids, size in blocks.tolist():
                    own = rows[row : row + docs]
                    cells = table.value[unpack_ranks(view[at : at + size], ids)].tobytes()
                    ends = np.cumsum(own[:, 2])
                    first = ends - own[:, 2]
                    keys = pa.array(own[:, 1], mask=own[:, 0] == 1)
                    cut = pa.array([cells[4 * a : 4 * z] for a, z in zip(first.tolist(), ends.tolist(), strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays([keys, pa.array(first + start), cut], schema=_ROWS)
                    at, start, row = at + size, start + ids, row + docs

    return spark.read.format("binaryFile").load(written.path).select("path", "content").mapInArrow(read, schema)
