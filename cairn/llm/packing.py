"""Token ids as fixed-width bit-packed blocks.

Every id takes the fewest bits that hold the vocabulary. Documents are put in ascending id order over shards (ranges of doc_id), and each
shard is cut into blocks of whole documents. A file row is one block: shard, block, number of ids, bits per id, doc_ids, the offset of
each document in the block, and the packed payload. ``unpack`` is a vectorised numpy read of a block; ``read_document`` reads one.
The blocks are Parquet rows, so the commit protocol of Spark covers lost executors and any store that Spark can write.
"""

from __future__ import annotations

import functools
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.bpe import ChunkEncoder, WordBpe, byte_letters
from cairn.llm.common import shared_dir

#: Ids of a block before it is closed; a longer document is a block of its own.
BLOCK_IDS = 1 << 16
#: Bytes of a worker's memo, about: packing runs alone in its workers.
MEMO_BYTES = 160 << 20
#: Blocks whose positions a join broadcasts (24 bytes each); more are joined by shuffling.
BROADCAST_BLOCKS = 1_000_000
BLOCKS = "shard int, block int, first_id long, last_id long, n_ids long, bits int, doc_ids array<long>, starts array<long>, payload binary"


def vocabulary_of(tokenizer: str) -> int:
    """One more than the largest id of a tokenizer file."""
    spec = json.load(open(tokenizer, encoding="utf-8"))
    return 1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])


def bits_for(vocabulary: int) -> int:
    """The fewest bits for ids 0 .. vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Most significant bit first, without padding between ids; the last byte is filled with zeros."""
    ids = np.asarray(ids, dtype=np.uint64)
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError("an id does not fit")
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    shifts = np.arange(bits - 1, -1, -1, dtype=np.uint64)
    return np.packbits(((ids[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel()).tobytes()


def unpack(payload: bytes, bits: int, start: int, n: int) -> np.ndarray:
    """Ids start .. start + n - 1 of a payload, touching only the bytes that hold them."""
    if not n:
        return np.zeros(0, np.uint32)
    if bits in (8, 16, 32):
        return np.frombuffer(payload, dtype=f">u{bits // 8}", count=n, offset=start * bits // 8).astype(np.uint32)
    first, last = start * bits // 8, -(-(start + n) * bits // 8)
    raw = np.unpackbits(np.frombuffer(payload, dtype=np.uint8, count=last - first, offset=first))
    at = start * bits - first * 8
    weights = (1 << np.arange(bits - 1, -1, -1, dtype=np.uint64)).astype(np.uint64)
    return (raw[at : at + n * bits].reshape(n, bits).astype(np.uint64) @ weights).astype(np.uint32)


class LibraryBpe(WordBpe):
    """The tokenizers library's own model on words that are new to a worker."""

    known_words = 600_000

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__(path)
        self.model = Tokenizer.from_file(path).model
        self.letters = str.maketrans(dict(enumerate(byte_letters())))

    def encode_new(self, words: set[str]) -> dict[str, list[int]]:
        tokenize, letters = self.model.tokenize, self.letters
        return {w: [t.id for t in tokenize(w.encode().decode("latin-1").translate(letters))] for w in words}


@functools.lru_cache(2)
def library_encoder(path: str) -> ChunkEncoder:
    """One per worker process and vocabulary."""
    return ChunkEncoder(LibraryBpe(path).encode_chunks, memo_bytes=MEMO_BYTES)


def _blocks(batches: Iterator[pa.RecordBatch], path: str, end_id: int | None, bits: int) -> Iterator[pa.RecordBatch]:
    shard, block = TaskContext.get().partitionId(), 0
    names = [f.split()[0] for f in BLOCKS.split(", ")]
    docs: list[int | None] = []
    parts: list[np.ndarray] = []
    held = 0

    def close() -> pa.RecordBatch:
        lens = np.array([len(p) for p in parts], np.int64)
        columns = [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array(docs[:1], pa.int64()), pa.array(docs[-1:], pa.int64()), pa.array([held], pa.int64()), pa.array([bits], pa.int32()), pa.array([docs], pa.list_(pa.int64())), pa.array([(np.cumsum(lens) - lens).tolist()], pa.list_(pa.int64())), pa.array([pack(np.concatenate(parts), bits)], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names)

    enc = library_encoder(path)
    for batch in batches:
        for doc_id, (ids, _) in zip(batch.column(0).to_pylist(), enc.texts(batch.column(1)), strict=True):
            if held and held + len(ids) > BLOCK_IDS:
                yield close()
                docs, parts, held, block = [], [], 0, block + 1
            docs.append(doc_id)
            parts.append(ids if end_id is None else np.append(ids, np.int32(end_id)))
            held += len(parts[-1])
    if docs:
        yield close()


def write_packed(docs: DataFrame, out: str, tokenizer: str, vocabulary: int, end_id: int | None = 1, shards: int = 64) -> None:
    """Encodes ``docs(doc_id, text)`` and writes packed blocks to ``out``.

    Null and empty texts have the end id only; rows without a doc_id come first; rows of one doc_id keep together in one shard; an
    empty table writes no block. Other columns are not read.
    """
    bits = bits_for(vocabulary)
    ordered = docs.select("doc_id", "text").repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", F.crc32(F.col("text").cast("binary")))
    ordered.mapInArrow(lambda batches: _blocks(batches, tokenizer, end_id, bits), BLOCKS).write.option("compression", "zstd").parquet(out)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``block_start``: the number of ids in all blocks before. Only block headers (a row per 65,536 ids) are ordered."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    by_shard = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    heads = blocks.select("shard", "block", (F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_ids")).alias("in_shard")).join(by_shard, "shard")
    heads = heads.select("shard", "block", (F.col("shard_start") + F.col("in_shard")).alias("block_start"))
    # payloads are not shuffled while the positions fit a broadcast
    small = blocks.select("shard").limit(BROADCAST_BLOCKS + 1).count() <= BROADCAST_BLOCKS
    return blocks.join(F.broadcast(heads) if small else heads, ["shard", "block"])


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """Ids of each row of one document, unpacked from its block alone; the ids at the ends of a block tell which row groups are read."""
    wanted = F.lit(doc_id).cast("long")
    # a block that begins with rows without an id has no first id
    reach = (F.col("first_id").isNull() | (F.col("first_id") <= wanted)) & (F.col("last_id") >= wanted)
    rows = spark.read.schema(BLOCKS).parquet(path).where(reach & F.array_contains("doc_ids", wanted)).orderBy("shard", "block").collect()
    out = []
    for r in rows:
        ends = [*r.starts[1:], r.n_ids]
        out += [unpack(r.payload, r.bits, a, b - a).tolist() for d, a, b in zip(r.doc_ids, r.starts, ends, strict=True) if d == doc_id]
    return out


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 per document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = unpack(r["payload"], r["bits"], 0, r["n_ids"]).astype("<u4")
                starts = np.array(r["starts"], np.int64)
                lens = np.diff(np.append(starts, r["n_ids"]))
                crcs = [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(starts, lens, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(starts + r["block_start"]), pa.array(lens), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_blocks(spark, path).select("doc_ids", "starts", "n_ids", "bits", "block_start", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def pack_documents(docs: DataFrame, tokenizer: str, vocabulary: int | None = None) -> DataFrame:
    """Writes the files to the shared folder and returns the digest read back from them."""
    spark = docs.sparkSession
    out = f"{shared_dir(spark)}/cairn-packed-{uuid.uuid4().hex}"
    write_packed(docs, out, tokenizer, vocabulary or vocabulary_of(tokenizer), shards=max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return token_digest(spark, out)
