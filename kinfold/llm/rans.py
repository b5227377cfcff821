"""Binary token output: blocks of ids coded by a static range asymmetric numeral system (rANS).

File layout. A file set is a folder with three Parquet tables (any store Spark can write, and the
writer's commit makes a lost executor's half-written blocks vanish):

``freq``    id, freq: one frequency table for all blocks, summing to 2**16.
``index``   part, base: the ids before each part, parts in ascending document order.
``blocks``  part, block, local (ids before the block in its part), n_tokens, payload, crc32 (of the
            ids), and the documents in it: doc_ids, doc_sizes.

Payload, little-endian: u32 lanes, u32 steps, u32 n, u32 checkpoints; per checkpoint u32 word
position and ``lanes`` u32 states; u32 words; the u16 words. Id ``k`` is coded by lane
``k % lanes`` at step ``k // lanes``; a checkpoint every ``STRIDE`` steps lets a reader start there,
so the stretches between checkpoints are decoded side by side, and :func:`read_range` decodes only
those it needs. The states are 32 bits wide, renormalised by 16, and the code is exact: every id
that occurs has a frequency of 1 at least (so 65,536 different ids are the most a set can hold).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.llm import bpe
from kinfold.llm.common import col, new_path, save, small_batches

BITS = 16
#: Ids a block holds before it is closed: the document that fills it is its last, however long.
BLOCK_IDS = 1 << 18
#: Lanes of a block at most, and steps between two checkpoints.
LANES, STRIDE = 1024, 64
#: Bytes of ids a part of the set is meant to hold.
PART_BYTES = 128 << 20


def normalise(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to sum to 2**16, each id that occurs keeping 1 at least."""
    used = np.flatnonzero(counts)
    if len(used) > 1 << BITS:
        raise ValueError("more distinct ids than a 16-bit frequency table holds")
    freq = np.zeros(len(counts), np.int64)
    if not len(used):
        return freq
    freq[used] = np.maximum(1, counts[used].astype(object) * (1 << BITS) // int(counts.sum())).astype(np.int64)
    order = used[np.argsort(-freq[used], kind="stable")]
    short = (1 << BITS) - int(freq.sum())
    if short > 0:
        freq[order[0]] += short
    while short < 0:  # take back from the largest, in proportion to what they can spare
        spare = freq[order] - 1
        take = np.minimum(spare, np.maximum(spare * -short // max(1, int(spare.sum())), 0))
        if not take.any():
            take[: min(-short, int((spare > 0).sum()))] = 1
        freq[order] -= take
        short += int(take.sum())
    return freq


class Coder:
    """Encodes and decodes blocks under one frequency table."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint32)
        self.start = (np.cumsum(freq) - freq).astype(np.uint32)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    @staticmethod
    def lanes(n: int) -> int:
        return int(min(LANES, max(1, 1 << max(0, (n // 32).bit_length() - 1))))

    def encode(self, ids: np.ndarray) -> bytes:
        n = len(ids)
        lanes = self.lanes(n)
        steps = -(-n // lanes)
        state = np.full(lanes, 1 << 16, np.uint32)
        words: list = []
        marks: list = []
        total = 0
        for t in range(steps - 1, -1, -1):
            sym = ids[t * lanes : (t + 1) * lanes]
            x = state[: len(sym)]
            f = self.freq[sym]
            full = (x >> np.uint32(16)) >= f  # x >= freq << 16, without leaving 32 bits
            if full.any():
                out = (x[full] & np.uint32(0xFFFF)).astype("<u2")
                words.append(out)
                total += len(out)
                x = np.where(full, x >> np.uint32(16), x)
            q = x // f
            state[: len(sym)] = (q << np.uint32(BITS)) + (x - q * f) + self.start[sym]
            if t % STRIDE == 0:
                marks.append((total, state.astype("<u4").tobytes()))
        stream = np.concatenate(words[::-1]) if words else np.empty(0, "<u2")
        head = np.array([lanes, steps, n, len(marks)], "<u4").tobytes()
        body = b"".join(np.array([total - at], "<u4").tobytes() + s for at, s in reversed(marks))
        return head + body + np.array([total], "<u4").tobytes() + stream.tobytes()

    def decode(self, payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids of checkpoints ``first`` up to ``last`` (excluded; all by default), all at a time."""
        lanes, steps, n, marks = (int(v) for v in np.frombuffer(payload, "<u4", 4))
        last = marks if last is None else min(last, marks)
        if not n or first >= last:
            return np.empty(0, np.uint32)
        at = 16 + (4 + 4 * lanes) * marks
        stream = np.frombuffer(payload, "<u2", int(np.frombuffer(payload, "<u4", 1, at)[0]), at + 4)
        table = np.frombuffer(payload, "<u4", marks * (1 + lanes), 16).reshape(marks, 1 + lanes)[first:last]
        pos, state = table[:, 0].astype(np.int64), table[:, 1:].astype(np.uint32)
        begin = np.arange(first, last) * STRIDE
        deep = min(STRIDE, steps - first * STRIDE)
        out = np.empty((last - first, deep, lanes), np.uint32)
        lane = np.arange(lanes)
        for k in range(deep):
            slot = state & np.uint32(0xFFFF)
            sym = self.symbol[slot]
            out[:, k] = sym
            state = self.freq[sym] * (state >> np.uint32(BITS)) + slot - self.start[sym]
            low = state < np.uint32(1 << 16)
            if (begin[-1] + k + 1) * lanes > n:  # the last stretch ends before the others, within its lanes
                low[-1] &= lane < n - (begin[-1] + k) * lanes
            need = np.count_nonzero(low, axis=1)
            place = np.repeat(pos - (np.cumsum(need) - need), need) + np.arange(int(need.sum()))
            state[low] = (state[low] << np.uint32(16)) | stream[place]
            pos += need
        whole = out[:-1].reshape(-1)
        return np.concatenate([whole, out[-1].reshape(-1)[: n - int(begin[-1]) * lanes]])


def encoded(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n, ids, tally`` for every row, in the shared folder; ids of the width the vocabulary
    needs. Each task adds a row with ``n`` of -1 whose ``tally`` says how often it met each id (u64)."""
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        enc = bpe.encoder(bpe.default_path(tokenizer))
        closing = np.array([end_id], enc.dtype).tobytes()
        tally, key_type = np.zeros(max(enc.size, end_id + 1), np.int64), None
        names = ["doc_id", "n", "ids", "tally"]
        for batch in batches:
            key_type = batch.schema.field(0).type
            ids = [x + closing for x in enc.encode_all([t or "" for t in batch.column(1).to_pylist()])]
            tally += np.bincount(np.frombuffer(b"".join(ids), enc.dtype), minlength=len(tally))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // enc.dtype.itemsize for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.binary())], names=names)
        if key_type:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, key_type), pa.array([-1], pa.int64()), pa.nulls(1, pa.binary()), pa.array([tally.astype("<u8").tobytes()], pa.binary())], names=names)

    narrow = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    return save(narrow.mapInArrow(run, f"doc_id {id_type}, n long, ids binary, tally binary"), "encoded")


def coded_blocks(made: DataFrame, freq: np.ndarray) -> DataFrame:
    """Documents in ascending id order as coded blocks. Only ids are moved, in as many parts as they
    need; rows of equal or no id are ordered, and dealt out, by a hash of their ids."""
    spark = made.sparkSession
    id_type = made.schema["doc_id"].dataType.simpleString()
    size = made.agg(F.coalesce(F.sum(F.octet_length("ids")), F.lit(0))).first()[0]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    tie = made.where("n >= 0").select("doc_id", "n", "ids", F.xxhash64("ids").alias("tie"))
    ordered = tie.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    shared = spark.sparkContext.broadcast(freq)

    def run(batches):
        coder = Coder(shared.value)
        part, block, local, held = TaskContext.get().partitionId(), 0, 0, 0
        ids: list = []
        keys: list = []
        sizes: list = []
        key_type = None

        def flush():
            nonlocal block, local, held, ids, keys, sizes
            plain = np.concatenate(ids)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int64()), pa.array([block], pa.int64()), pa.array([local], pa.int64()), pa.array([held], pa.int64()),
                    pa.array([coder.encode(plain)], pa.binary()), pa.array([zlib.crc32(plain.astype("<u4").tobytes())], pa.int64()),
                    pa.array([keys], pa.list_(key_type)), pa.array([sizes], pa.list_(pa.int64())),
                ],
                names=["part", "block", "local", "n_tokens", "payload", "crc32", "doc_ids", "doc_sizes"],
            )
            block, local, held, ids, keys, sizes = block + 1, local + held, 0, [], [], []
            return out

        for batch in batches:
            key_type = batch.schema.field(0).type
            for key, m, raw in zip(*(batch.column(c).to_pylist() for c in range(3))):
                ids.append(np.frombuffer(raw, f"<u{len(raw) // m}"))
                keys.append(key)
                sizes.append(m)
                held += m
                if held >= BLOCK_IDS:
                    yield flush()
        if ids:
            yield flush()

    schema = f"part long, block long, local long, n_tokens long, payload binary, crc32 long, doc_ids array<{id_type}>, doc_sizes array<long>"
    return ordered.select("doc_id", "n", "ids").mapInArrow(run, schema)


def frequencies(made: DataFrame) -> np.ndarray:
    """How often each id occurs; one row per id of the vocabulary reaches the driver, never more."""

    def run(batches):
        counts = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                got = np.frombuffer(raw, "<u8").astype(np.int64)
                counts = got if not len(counts) else counts + got
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array(counts[used])], names=["id", "n"])

    rows = made.where("n = -1").select("tally").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    used = np.asarray(rows["id"], np.int64)
    counts = np.zeros(int(used.max()) + 1 if len(used) else 1, np.int64)
    counts[used] = np.asarray(rows["n"], np.int64)
    return counts


def write(docs: DataFrame, path: str | None = None, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode ``docs`` in ascending id order as a file set under ``path``; returns the folder.

    Null text is empty, so such a document is its end id alone. Repeated ids stay separate
    documents. An empty table gives a set without blocks.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "rans")
    made = encoded(docs, tokenizer, end_id, id_col, text_col)
    freq = normalise(frequencies(made))
    used = np.flatnonzero(freq)
    table = pa.table({"id": pa.array(used, pa.int64()), "freq": pa.array(freq[used], pa.int64())})
    spark.createDataFrame(table).coalesce(1).write.parquet(f"{path}/freq")
    blocks = coded_blocks(made, freq)
    blocks.write.parquet(f"{path}/blocks")
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = spark.read.schema(blocks.schema).parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    totals.select("part", before.alias("base")).write.parquet(f"{path}/index")
    return path


def _opened(spark: SparkSession, path: str) -> tuple:
    """The broadcast frequencies, and the blocks with ``at``, the ids before each in the whole set."""
    small_batches(spark)
    table = spark.read.parquet(f"{path}/freq").toArrow()
    used = np.asarray(table["id"], np.int64)
    freq = np.zeros(int(used.max()) + 1 if len(used) else 1, np.int64)
    freq[used] = np.asarray(table["freq"], np.int64)
    blocks = spark.read.parquet(f"{path}/blocks").join(F.broadcast(spark.read.parquet(f"{path}/index")), "part")
    return spark.sparkContext.broadcast(freq), blocks.withColumn("at", F.col("base") + F.col("local"))


def read_range(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """``start, ids``: the ids ``first`` to ``last`` (excluded) of the whole set, a row per block.

    Of the blocks that overlap the range only the stretches between checkpoints that do are decoded;
    the checksum is one of whole blocks and is not looked at here.
    """
    shared, blocks = _opened(spark, path)
    wanted = blocks.where((F.col("at") < last) & (F.col("at") + F.col("n_tokens") > first)).select("payload", "at", "n_tokens")

    def run(batches):
        coder = Coder(shared.value)
        for batch in batches:
            for payload, at, n in zip(*(batch.column(c).to_pylist() for c in range(3))):
                a, b = max(0, first - at), min(n, last - at)
                step = int(np.frombuffer(payload, "<u4", 1)[0]) * STRIDE
                ids = coder.decode(payload, a // step, -(-b // step))[a % step : a % step + b - a]
                yield pa.RecordBatch.from_arrays([pa.array([at + a], pa.int64()), pa.array([ids.astype("<u4").tobytes()], pa.binary())], names=["start", "ids"])

    return wanted.mapInArrow(run, "start long, ids binary")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Decode a file set: one row per document, ``doc_id, start, n_tokens, ids_crc32, ids``.

    Blocks decode independently; a block whose checksum does not match raises. The broadcast
    tables are bounded: the frequencies by the vocabulary, the index by the number of parts.
    """
    shared, blocks = _opened(spark, path)
    id_type = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches):
        coder = Coder(shared.value)
        for batch in batches:
            for k in range(batch.num_rows):
                payload, crc, at, keys, sizes = (batch.column(c)[k] for c in range(5))
                ids = coder.decode(payload.as_py()).astype("<u4").tobytes()
                if zlib.crc32(ids) != crc.as_py():
                    raise ValueError("a block's checksum does not match")
                n = np.asarray(sizes.values, np.int64)
                ends = np.cumsum(n)
                own = [ids[4 * a : 4 * b] for a, b in zip((ends - n).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [keys.values, pa.array(at.as_py() + ends - n), pa.array(n), pa.array([zlib.crc32(x) for x in own], pa.int64()), pa.array(own, pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    narrow = blocks.select("payload", "crc32", "at", "doc_ids", "doc_sizes")
    return narrow.mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long, ids binary")
