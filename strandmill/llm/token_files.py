"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Documents are dealt into ranges of doc_id and written in ascending order; a file holds about 8 million ids and stands
alone. Layout, little-endian: magic, block, number in the block, documents, ids, ranks; the rank table (the file's own
ids, most frequent first); doc_ids, their null flags, ids of each document; control bytes (four 2-bit lengths each);
data bytes. An id's rank takes one to four bytes, its length less one is the 2-bit code. Decoding looks up the lengths of
a control byte in a 256 x 4 table and gathers with numpy. Files reach their name by a rename, so a task that is run
again after a lost executor leaves the same files.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import deal, in_key_order, materialize, new_folder, table, tidy
from .wordcoder import coder_of, parts_of, tokenizer_json

MAGIC = b"RVB1"
HEAD = struct.Struct("<4sIIIQI")
FILE_IDS = 8_000_000
PART_BYTES = 10_000_000  # of text are encoded at once
END = 1
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


def pack(ids: np.ndarray, doc_ids: list, lengths: np.ndarray, block: int = 0, number: int = 0) -> bytes:
    counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    seen = np.nonzero(counts)[0]
    order = seen[np.lexsort((seen, -counts[seen]))]
    rank_of = np.zeros(len(counts), dtype="<u4")
    rank_of[order] = np.arange(len(order), dtype="<u4")
    widest = 2 if len(order) <= 65_536 else 4
    size_of = (1 + (rank_of > 0xFF).astype(np.uint8) + (rank_of > 0xFFFF) + (rank_of > 0xFFFFFF)).astype(np.uint8)
    size = size_of[ids]
    codes = np.zeros(-(-len(ids) // 4) * 4, dtype=np.uint8)
    codes[: len(ids)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    wide = rank_of.astype(f"<u{widest}")[ids].view(np.uint8).reshape(-1, widest)
    data = wide[np.arange(widest, dtype=np.uint8) < size[:, None]]
    keys = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    nulls = np.array([d is None for d in doc_ids], dtype=np.uint8)
    head = HEAD.pack(MAGIC, block, number, len(doc_ids), len(ids), len(order))
    return b"".join([head, order.astype("<u4").tobytes(), keys.tobytes(), nulls.tobytes(), lengths.astype("<u4").tobytes(), control.tobytes(), data.tobytes()])


def unpack(raw: bytes) -> tuple[int, int, list, np.ndarray, np.ndarray]:
    """block, number, doc_ids, lengths, ids."""
    magic, block, number, docs, n, ranks = HEAD.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = HEAD.size

    def take(kind, count):
        nonlocal at
        out = np.frombuffer(raw, dtype=kind, count=count, offset=at)
        at += out.nbytes
        return out

    order, keys, nulls, lengths = take("<u4", ranks), take("<i8", docs), take(np.uint8, docs), take("<u4", docs)
    control = take(np.uint8, -(-n // 4))
    size = LENGTHS[control].ravel()[:n]
    ends = np.cumsum(size, dtype=np.int64)
    data = take(np.uint8, int(ends[-1]) if n else 0)
    first = ends - size
    r = data[first].astype(np.uint32) if n else np.zeros(0, np.uint32)
    for k in range(1, int(size.max()) if n else 0):
        long = size > k
        r[long] |= data[first[long] + k].astype(np.uint32) << np.uint32(8 * k)
    return block, number, [None if x else int(k) for k, x in zip(keys, nulls)], lengths, order[r] if n else r


def _save(uri: str, name: str, raw: bytes) -> None:
    import uuid

    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path, recursive=True)
    spare = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(spare) as f:
        f.write(raw)
    store.move(spare, f"{path}/{name}")


def qualified(spark, path: str) -> str:
    """With the scheme of the default file system where the path has none."""
    if ":/" in path:
        return path
    base = spark._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    return f"{base.rstrip('/')}{path}" if "://" in base and base.rstrip("/") != "file:" else f"file://{path}"


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END, file_ids: int = FILE_IDS) -> DataFrame:
    """Encodes and writes all documents; returns the index of files (block, number, docs, ids).

    Null and empty texts get the end id alone; null doc_ids come first; equal doc_ids are ordered by a hash of the text; an empty
    table makes no file."""
    json = docs.sparkSession.sparkContext.broadcast(tokenizer_json(tokenizer))  # a file of fixed size
    dealt, blocks = in_key_order(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", F.xxhash64("text"))
    dealt = dealt.select("doc_id", "text", "_block", "_tie")

    def run(batches):
        import pyarrow as pa

        coder = coder_of(json.value)
        block, number, keys, lengths, parts, held = None, 0, [], [], [], 0

        def flush():
            nonlocal number, keys, lengths, parts, held
            if not keys:
                return None
            docs, ids = np.concatenate(lengths), np.concatenate(parts)
            _save(folder, f"{block:08d}-{number:06d}.rvb", pack(ids, keys, docs, block, number))
            row = pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "number": pa.array([number], pa.int32()), "docs": pa.array([len(keys)], pa.int64()), "ids": pa.array([len(ids)], pa.int64())})
            number, keys, lengths, parts, held = number + 1, [], [], [], 0
            return row

        for batch in batches:
            blocks = batch.column(2).to_numpy(zero_copy_only=False)
            for i, j in parts_of(batch.column(1), PART_BYTES):
                cuts = [i, *(np.nonzero(np.diff(blocks[i:j]))[0] + i + 1).tolist(), j]
                for a, b in zip(cuts, cuts[1:]):
                    if blocks[a] != block or held >= file_ids:
                        if row := flush():
                            yield row
                        if blocks[a] != block:
                            block, number = int(blocks[a]), 0
                    ids, n = coder.column(batch.column(1).slice(a, b - a))
                    parts.append(np.insert(ids, np.cumsum(n), end_id))
                    lengths.append(n + 1)
                    keys += batch.column(0).slice(a, b - a).to_pylist()
                    held += len(parts[-1])
        if row := flush():
            yield row

    return materialize(deal(dealt, blocks, ["doc_id", "_tie", "text"]).mapInArrow(tidy(run), "block int, number int, docs long, ids long"), "token-index")


def read(spark, folder: str, index: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files; start counts all ids of lower documents. A file of
    the index that isn't in the folder any more is an error."""
    whole = Window.orderBy("block", "number").rowsBetween(Window.unboundedPreceding, -1)
    bases = index.select(F.col("block").alias("_b"), F.col("number").alias("_n"), F.coalesce(F.sum("ids").over(whole), F.lit(0)).alias("_base"))  # a row for each file

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for raw in batch.column(0).to_pylist():
                block, number, keys, lengths, ids = unpack(raw)
                ends = np.cumsum(lengths, dtype=np.int64)
                flat, starts = ids.astype("<u4"), ends - lengths
                crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
                k = len(keys)
                yield pa.RecordBatch.from_pydict({"block": pa.array([block] * k, pa.int32()), "number": pa.array([number] * k, pa.int32()), "doc_id": pa.array(keys, pa.int64()), "_at": pa.array(starts, pa.int64()), "n_tokens": pa.array(lengths.astype(np.int64), pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    if index.limit(1).count() == 0:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.rvb").load(folder)
    there = files.select(F.regexp_extract("path", r"([^/]+)\.rvb$", 1).alias("_name"))
    lost = index.select(F.format_string("%08d-%06d", "block", "number").alias("_name")).join(there, "_name", "left_anti").limit(5).collect()
    if lost:
        raise FileNotFoundError(f"token files {', '.join(sorted(r[0] for r in lost))} are missing in {folder}")
    rows = files.select("content").mapInArrow(run, "block int, number int, doc_id long, _at long, n_tokens long, ids_crc32 long")
    placed = rows.join(bases, (F.col("block") == F.col("_b")) & (F.col("number") == F.col("_n")))
    return placed.select("doc_id", (F.col("_base") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32")


def op7_token_files(spark, sf_dir: str) -> DataFrame:
    folder = qualified(spark, new_folder(spark, "token-files"))
    index = write(table(spark, sf_dir, "documents"), "word_bpe_49k.json", folder)
    return read(spark, folder, index)
