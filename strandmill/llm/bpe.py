"""BPE encoding and decoding through a distinct-word table.

Documents are taken in blocks of about 4 MB. A block's body is the numbers of its words, by position; its distinct words
go to buckets by hash. A bucket is a slice of the distinct-word table and encodes each of its words once, however many
blocks ask for it. The ids of a block's words come back to the block and are joined to the body by word number; ids are
joined to pieces (a table whose size the tokenizer's file fixes) for decoding. A frequent word is asked for once by each
block, so no bucket is hot; nothing is broadcast but the tokenizer. Words, numbers and ids travel as compressed packets,
one for each block and bucket, which Spark itself doesn't look into.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions, small_batches, table, tidy
from .wordcoder import coder_of, parts_of, pieces_of, ragged, tokenizer_json, words_of

BLOCK_BYTES = 4_000_000


def _packed(batch) -> bytes:
    import pyarrow as pa
    import zstandard

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return zstandard.ZstdCompressor(level=1).compress(sink.getvalue())


def _unpacked(x: bytes):
    import pyarrow as pa
    import zstandard

    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(x)).read_next_batch()


def _squeezed(x: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _released(x: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _words(words) -> bytes:
    """An Arrow column of words: lengths, then bytes, compressed each."""
    import zstandard

    lengths = _squeezed(np.diff(np.frombuffer(words.buffers()[1], np.int32)[: len(words) + 1]))
    return len(lengths).to_bytes(4, "little") + lengths + zstandard.ZstdCompressor(level=1).compress(words.buffers()[2])


def _listed(x: bytes) -> list[str]:
    import pyarrow as pa
    import zstandard

    at = 4 + int.from_bytes(x[:4], "little")
    ends = np.concatenate([[0], np.cumsum(_released(x[4:at]))]).astype(np.int32)
    return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.tobytes()), pa.py_buffer(zstandard.ZstdDecompressor().decompress(x[at:]))).to_pylist()


def _blocks(batches, block_bytes: int):
    """(name, columns besides the text, texts) of each block. A name is the place in the scan (the column before the others) and a hash of the texts."""
    import pyarrow as pa

    number = 0
    for batch in batches:
        place = batch.column(0)[0].as_py() if batch.num_rows else 0
        whole = batch.columns[-1].cast(pa.large_string())
        offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1] if len(whole) else None
        for a, b in parts_of(batch.columns[-1], block_bytes):
            h = hashlib.blake2b(np.diff(offsets[a : b + 1]).tobytes(), digest_size=16)
            if offsets[b] > offsets[a]:
                h.update(whole.buffers()[2][int(offsets[a]) : int(offsets[b])])
            number += 1
            part = batch.slice(a, b - a)
            yield f"{place}-{number}-{h.hexdigest()}", part.select(list(range(1, part.num_columns - 1))), part.columns[-1]


def _buckets(words: list[str], n: int) -> np.ndarray:
    import pandas as pd

    return (pd.util.hash_array(np.array(words, dtype=object), categorize=False) % np.uint64(n)).astype(np.int64) if words else np.zeros(0, np.int64)


def encode(docs: DataFrame, tokenizer: str, keep: list[str], digest: bool = False, block_bytes: int = BLOCK_BYTES, back: bool = False, stable: bool = True) -> DataFrame:
    """One row per input row: the columns `keep`, n_tokens and ids (array<int>), with back also the decoded text; with
    digest instead of these the SHA-256 of the ids (little-endian 32-bit) and of the decoded text.

    Null and empty texts have no ids. Repeated rows, repeated and null keys stay as they are: rows travel inside their
    block and are never joined by key. An empty table gives no rows. docs is scanned twice and must give its rows in the
    same order both times, as tables read from files do (else the job fails, it never gives other ids); with
    stable=False it is written to the shared folder first.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    small_batches(spark)
    json = spark.sparkContext.broadcast(tokenizer_json(tokenizer))  # a file of fixed size
    names = [f"_k{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(f"`{k}`").alias(a) for k, a in zip(keep, names)], F.col("text").alias("_text"))
    if not stable:
        rows = materialize(rows, "bpe-input")
    rows = rows.select(F.spark_partition_id().alias("_place"), *names, "_text")

    def ask(batches):
        import pyarrow as pa

        for name, _, texts in _blocks(batches, block_bytes):
            words = words_of(texts)[0].dictionary_encode().dictionary
            to = _buckets(words.to_pylist(), n)
            order = np.argsort(to, kind="stable")
            own, first = np.unique(to[order], return_index=True)
            lists = [words.take(pa.array(x)) for x in np.split(order, first[1:])] if len(own) else []
            out = [_words(x) for x in lists]
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(own, pa.int32()), "block": pa.array([name] * len(out), pa.string()), "packet": pa.array(out, pa.binary())})

    def answer(batches):
        import pyarrow as pa

        coder = coder_of(json.value)
        coder.forget()  # no word of another bucket comes again
        for batch in batches:
            for bucket, block, packet in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                flat, lengths = coder.table(_listed(packet))
                out = _squeezed(np.concatenate([[len(lengths)], lengths, flat]))
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.string()), "bucket": pa.array([bucket], pa.int32()), "packet": pa.array([out], pa.binary()), "keys": pa.array([None], pa.binary())})

    def bodies(batches):
        import pyarrow as pa

        for name, keys, texts in _blocks(batches, block_bytes):
            words, begins = words_of(texts)
            words = words.dictionary_encode()
            to = _buckets(words.dictionary.to_pylist(), n)
            body = _squeezed(np.concatenate([[len(texts), len(to)], np.diff(begins), to, words.indices.to_numpy(zero_copy_only=False)]))
            yield pa.RecordBatch.from_pydict({"block": pa.array([name], pa.string()), "bucket": pa.array([n], pa.int32()), "packet": pa.array([body], pa.binary()), "keys": pa.array([_packed(keys) if keep else None], pa.binary())})

    def joined(batches):
        import pyarrow as pa

        pieces = np.array(pieces_of(json.value), dtype=object) if digest or back else None
        block, answers = None, {}
        for batch in batches:
            for name, bucket, packet, keys in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if name != block:
                    block, answers = name, {}
                if bucket < n:
                    answers[bucket] = packet
                    continue
                ids, lengths = _joined(_released(packet), [_released(answers[b]) for b in sorted(answers)])
                ends = np.cumsum(lengths, dtype=np.int64)
                texts = None if pieces is None else _texts(ids, ends, pieces)
                made = [c.cast(f.type) for c, f in zip(_unpacked(keys).columns, arrow_keep)] if keep else []
                made.append(pa.array(lengths, pa.int64()))
                if digest:
                    made.append(pa.array([hashlib.sha256(ids[a:b].tobytes()).hexdigest() for a, b in zip([0, *ends.tolist()], ends.tolist())], pa.string()))
                    made.append(pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()))
                else:
                    made.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32))))
                    if back:
                        made.append(pa.array(texts, pa.string()))
                yield pa.RecordBatch.from_arrays(made, columns)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow_keep = list(to_arrow_schema(rows.select(*names).schema))
    made_here = {"ids_sha256": "string", "decoded_sha256": "string"} if digest else {"ids": "array<int>"} | ({"decoded": "string"} if back else {})
    columns = [*names, "n_tokens", *made_here]
    kinds = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*names).schema), "n_tokens long", *(f"{k} {v}" for k, v in made_here.items())])
    packets = "block string, bucket int, packet binary, keys binary"
    asked = rows.mapInArrow(tidy(ask), "bucket int, block string, packet binary").repartitionById(n, "bucket")
    both = asked.mapInArrow(tidy(answer), packets).unionByName(rows.mapInArrow(tidy(bodies), packets))
    out = both.repartition(n, "block").sortWithinPartitions("block", "bucket").mapInArrow(tidy(joined), kinds)
    return out.select(*[F.col(a).alias(k) for k, a in zip(keep, names)], "n_tokens", *made_here)


def _joined(body: np.ndarray, answers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a block's documents one after another, and how many each has, from the answers in order of bucket."""
    docs, words = int(body[0]), int(body[1])
    many, to, at = np.split(body[2:], [docs, docs + words])
    lengths = np.concatenate([np.zeros(0, np.uint32), *[a[1 : 1 + int(a[0])] for a in answers]]).astype(np.int64)
    flat = np.concatenate([np.zeros(0, np.uint32), *[a[1 + int(a[0]) :] for a in answers]])
    if len(lengths) != words:
        raise RuntimeError("the table gave other rows when it was read again: encode it with stable=False")
    order = np.argsort(to, kind="stable")
    starts, own = np.empty(words, np.int64), np.empty(words, np.int64)
    starts[order], own[order] = np.cumsum(lengths) - lengths, lengths
    n = own[at]
    ends, last = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(many, dtype=np.int64)])
    return ragged(flat, starts[at], n).astype("<u4"), np.diff(ends[last])


def _texts(ids: np.ndarray, ends: np.ndarray, pieces: np.ndarray) -> list[str]:
    """The id-to-piece join of documents: pieces by position, with spaces between (the tokenizer has no decoder)."""
    shown = pieces[ids].tolist()
    return [" ".join(shown[a:b]) for a, b in zip([0, *ends.tolist()], ends.tolist())]


def decode(encoded: DataFrame, tokenizer: str, keep: list[str]) -> DataFrame:
    """Adds `decoded` to rows with an `ids` array (null: null; empty: empty) and drops the ids."""
    spark = encoded.sparkSession
    json = spark.sparkContext.broadcast(tokenizer_json(tokenizer))

    @F.pandas_udf("string")
    def run(ids):
        import pandas as pd

        pieces = np.array(pieces_of(json.value), dtype=object)
        return pd.Series([None if x is None else " ".join(pieces[np.asarray(x, dtype=np.int64)].tolist()) for x in ids], dtype=object)

    return encoded.select(*[F.col(f"`{k}`") for k in keep], run("ids").alias("decoded"))


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), "word_bpe_49k.json", ["doc_id"], digest=True)
