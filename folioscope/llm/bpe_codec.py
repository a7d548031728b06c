"""BPE encoding and decoding through a table of distinct words.

1. Tasks split texts in words and number the distinct words of each chunk of
   documents; a document becomes its sequence of word numbers.
2. The chunks' words meet in buckets by hash; each distinct word of a bucket is
   encoded once, and its ids go back to the chunks under the words' numbers.
3. Documents meet the ids of their chunk, and every position takes its word's ids.
4. Decoding joins the distinct ids of each chunk with the id-to-piece table in
   Spark; documents meet their chunk's pieces, and every position takes its id's piece.

Words and ids travel packed and compressed, a few large rows for each chunk, as
a row for each word occurrence would be many times the text.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm import tokenizing
from folioscope.llm.common import forget_others, give_back, id_text, materialize, slices, table_path

#: Bytes of text in a chunk: its word table and numbers fit one task.
CHUNK_BYTES = 24 << 20
#: Bytes of text for each bucket of words, as far as ``MANY`` buckets; beyond, buckets grow as distinct words do, by a power of the text.
BUCKET_BYTES, MANY, POWER = 16 << 20, 64, 0.6
#: Begins the key of a text that is encoded whole; no other key begins with two spaces.
WHOLE = "  "


def bucket_count(total: int) -> int:
    """Buckets for so many bytes of text. A chunk sends at most a row to each, so rows grow with chunks times this."""
    n = -(-total // BUCKET_BYTES) or 1
    return n if n <= MANY else math.ceil(MANY * (n / MANY) ** POWER)


def pack(data: bytes) -> bytes:
    return pa.compress(data, codec="zstd", asbytes=True)


def unpack(data: bytes, size: int) -> bytes:
    return pa.decompress(data, size, codec="zstd", asbytes=True) if size else b""


def pack_bytes(parts: list[bytes]) -> bytes:
    """Lengths, then the parts, compressed."""
    data = np.array([len(x) for x in parts], "<u4").tobytes() + b"".join(parts)
    return len(data).to_bytes(8, "little") + pack(data)


def unpack_bytes(blob: bytes, n: int) -> list[bytes]:
    data = unpack(blob[8:], int.from_bytes(blob[:8], "little"))
    ends = (4 * n + np.cumsum(np.frombuffer(data, "<u4", n), dtype=np.int64)).tolist()
    return [data[a:b] for a, b in zip([4 * n, *ends], ends)]


def pack_numbers(numbers: np.ndarray) -> bytes:
    """Low and high halves apart, since high ones mostly repeat."""
    n = numbers.astype("<u4")
    data = (n & 0xFF).astype("u1").tobytes() + ((n >> 8) & 0xFF).astype("u1").tobytes() + (n >> 16).astype("<u2").tobytes()
    return pack(data)


def unpack_numbers(blob: bytes, n: int) -> np.ndarray:
    data = unpack(blob, 4 * n)
    low, middle = np.frombuffer(data, "u1", n), np.frombuffer(data, "u1", n, n)
    return low.astype("u4") | middle.astype("u4") << 8 | np.frombuffer(data, "<u2", n, 2 * n).astype("u4") << 16


SPLIT_SCHEMA = "chunk long, bucket int, id {kind}, n long, size long, payload binary"


def split_documents(docs: DataFrame, buckets: int, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows of two kinds. Documents (bucket null): ``n`` positions, ``payload`` their word numbers.
    Words: ``n`` words of a chunk that fall in ``bucket``, the numbers of which count on through the
    chunk's buckets. A text that can't be split is one word, ``WHOLE`` and itself."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        forget_others("tokens")
        chunk = TaskContext.get().partitionId() << 32
        table: dict[str, int] = {}
        held = 0

        def words() -> Iterator[tuple]:
            keys = list(table)  # in the order of their numbers
            of = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in keys), np.int64, len(keys))
            order = np.argsort(of, kind="stable")
            for numbers in np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if keys else ():
                packed = pack_numbers(numbers)
                yield chunk, int(of[numbers[0]]), None, len(numbers), 0, packed + pack_bytes([keys[i].encode() for i in numbers.tolist()]), len(packed)

        for batch in batches:
            for x in slices(batch):
                rows = []
                for key, text in zip(x.column(0).to_pylist(), x.column(1).to_pylist()):
                    keys = tokenizing.split_words(text)
                    held += len(text)
                    if keys is None or any(k == "" or k[0].isspace() for k in keys[1:]):
                        keys = [WHOLE + text]
                    numbers = [table.setdefault(k, len(table)) for k in keys]
                    rows.append((chunk, None, key, len(numbers), 0, pack_numbers(np.array(numbers))))
                yield to_batch(rows)
                if held >= chunk_bytes:
                    for w in words():
                        yield to_batch([(*w[:4], w[6], w[5])])
                    chunk, held = chunk + 1, 0
                    table.clear()
        for w in words():
            yield to_batch([(*w[:4], w[6], w[5])])
        table.clear()
        give_back()

    kind = docs.schema["id"].dataType
    arrow = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("id", to_arrow(kind)), ("n", pa.int64()), ("size", pa.int64()), ("payload", pa.binary())])

    def to_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return docs.mapInArrow(split, SPLIT_SCHEMA.format(kind=kind.simpleString()))


def to_arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


CODED_SCHEMA = "chunk long, n long, size long, numbers binary, lengths binary, ids binary, used array<int>"
CODED_ARROW = pa.schema([("chunk", pa.int64()), ("n", pa.int64()), ("size", pa.int64()), ("numbers", pa.binary()), ("lengths", pa.binary()), ("ids", pa.binary()), ("used", pa.list_(pa.int32()))])


def encode_words(words: DataFrame, tokenizer: str) -> DataFrame:
    """Encode each distinct word of a bucket once: a row with the bucket's distinct ids, ``used``,
    then for each chunk that holds some of the words one with their ids."""

    def encode(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in ("chunk", "n", "size", "payload"))))
        forget_others("tokens")
        coder = tokenizing.encoder(tokenizer)
        out = []
        dtype = tokenizing.id_type(tokenizer)
        width, used = np.dtype(dtype).itemsize, np.zeros(len(tokenizing.pieces(tokenizer)), bool)
        for chunk, n, size, payload in rows:
            keys = [w.decode() for w in unpack_bytes(payload[size:], n)]
            whole = {k: tokenizing.encode_whole(tokenizer, k[len(WHOLE) :]).tobytes() for k in keys if k.startswith(WHOLE)}
            ids = iter(coder.look_up([[k for k in keys if k not in whole]])[0])
            ids = [whole[k] if k in whole else next(ids) for k in keys]
            flat = b"".join(ids)
            lengths = np.array([len(x) // width for x in ids], "<u4")
            used[np.frombuffer(flat, dtype)] = True
            out.append((chunk, n, len(flat), payload[:size], pack_numbers(lengths), pack(flat), None))
        coder.forget()  # no other bucket has these words
        if used.any():
            out.insert(0, (None, 0, 0, None, None, None, np.flatnonzero(used)))
        result = pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), CODED_ARROW)], schema=CODED_ARROW)
        rows = keys = whole = ids = flat = payload = out = None
        give_back()
        return result

    return words.select("bucket", "chunk", "n", "size", "payload").groupBy("bucket").applyInArrow(encode, CODED_SCHEMA)


PIECES_SCHEMA = "chunk long, n long, size long, numbers binary, lengths binary, ids binary, tokens binary, pieces binary"
PIECES_ARROW = pa.schema([*list(CODED_ARROW)[:-1], ("tokens", pa.binary()), ("pieces", pa.binary())])
DIGESTS = [("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
#: Pieces that a task packs at a time.
PACKED_PIECES = 1_000_000


def piece_table(spark: SparkSession, tokenizer: str) -> DataFrame:
    """``(token, piece)``: the bytes of each id; as many rows as the tokenizer has ids."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = tokenizing.pieces(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int32()), pa.array([listed[i] for i in b.column(0).to_pylist()], pa.binary())], ["token", "piece"])

    return spark.range(0, len(tokenizing.pieces(tokenizer)), 1, 1).mapInArrow(rows, "token int, piece binary")


def with_pieces(coded: DataFrame, tokenizer: str) -> DataFrame:
    """Coded words as they are, and the pieces of their distinct ids, packed to ``tokens`` and ``pieces``
    for each chunk of a task. Each bucket's distinct ids are joined with the id-to-piece table; the
    vocabulary bounds that broadcast side, and what a task holds of it."""
    of_ids = coded.select(*CODED_ARROW.names[:-1], F.explode_outer("used").alias("token"))
    joined = of_ids.join(F.broadcast(piece_table(coded.sparkSession, tokenizer)), "token", "left").select(*CODED_ARROW.names[:-1], "token", "piece")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = tokenizing.id_type(tokenizer)
        piece: dict[int, bytes] = {}
        used: dict[int, np.ndarray] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for chunk, ids in used.items():
                row = (chunk, len(ids), 0, None, None, None, pack_numbers(ids), pack_bytes([piece[i] for i in ids.tolist()]))
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, PIECES_ARROW)], schema=PIECES_ARROW)
            used.clear()
            give_back()

        for b in batches:
            ids = b.filter(b.column("token").is_valid())  # a bucket's pieces come before its words
            piece.update((i, x or b"") for i, x in zip(ids.column("token").to_pylist(), ids.column("piece").to_pylist()))
            words = b.filter(b.column("token").is_null())
            if not words.num_rows:
                continue
            yield pa.RecordBatch.from_arrays([*words.columns[:-2], *[pa.nulls(words.num_rows, pa.binary())] * 2], schema=PIECES_ARROW)
            for chunk, size, flat in zip(*(words.column(c).to_pylist() for c in ("chunk", "size", "ids"))):
                found = np.unique(np.frombuffer(unpack(flat, size), dtype))
                before = used.get(chunk, found[:0])
                used[chunk] = np.union1d(before, found)
                held += len(used[chunk]) - len(before)
            if held >= PACKED_PIECES:
                yield from flush()
                held = 0
        yield from flush()

    return joined.mapInArrow(packed, PIECES_SCHEMA)


def encode_chunks(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, chunk_bytes: int, digest_only: bool) -> DataFrame:
    """What ``encode`` gives."""
    spark = docs.sparkSession
    source = id_text(docs, id_col, text_col)
    kind = source.schema["id"].dataType
    total = source.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    # a table's buckets have a limit in Spark
    buckets = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), source.rdd.getNumPartitions()), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    # bucketed by chunk, so that documents meet their chunk's ids without another shuffle;
    # only a table can be bucketed, so its name goes once it is resolved, and the files stay in the shared folder
    name = f"bpe_words_{uuid.uuid4().hex}"
    split = split_documents(source, bucket_count(total), chunk_bytes)
    split.write.bucketBy(buckets, "chunk").option("compression", "uncompressed").option("path", table_path(spark, "bpe-words")).format("parquet").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"drop table {name}")
    coded = encode_words(table.where("bucket is not null"), tokenizer)
    coded = with_pieces(coded, tokenizer) if digest_only else coded.where("used is null")
    documents = table.where("bucket is null").select("chunk", "id", "n", "payload")
    result = pa.schema([("doc_id", to_arrow(kind)), ("n_tokens", pa.int64()), *(DIGESTS if digest_only else [("ids", pa.list_(pa.int32()))])])
    ddl = f"doc_id {kind.simpleString()}, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest_only else "ids array<int>")

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        forget_others("")
        dtype = tokenizing.id_type(tokenizer)
        width = np.dtype(dtype).itemsize
        words: dict[int, bytes] = {}
        piece: dict[int, bytes] = {}
        for n, size, numbers, lengths, ids in zip(*(right.column(c) for c in ("n", "size", "numbers", "lengths", "ids"))):
            if not ids.is_valid:
                continue
            n, flat = n.as_py(), unpack(ids.as_py(), size.as_py())
            ends = (width * np.cumsum(unpack_numbers(lengths.as_py(), n), dtype=np.int64)).tolist()
            words.update(zip(unpack_numbers(numbers.as_py(), n).tolist(), [flat[a:b] for a, b in zip([0, *ends], ends)]))
        for n, tokens, pieces in zip(*(right.column(c).to_pylist() for c in ("n", "tokens", "pieces"))) if digest_only else ():
            if tokens is not None:
                piece.update(zip(unpack_numbers(tokens, n).tolist(), unpack_bytes(pieces, n)))
        look = [words.pop(i) for i in range(len(words))].__getitem__
        decimal = {i: b"%d" % i for i in piece}
        out = []
        for key, n, payload in zip(*(left.column(c).to_pylist() for c in ("id", "n", "payload"))):
            ids = np.frombuffer(b"".join(map(look, unpack_numbers(payload, n).tolist())), dtype)
            out.append((key, len(ids), *(digests(ids.tolist(), decimal, piece) if digest_only else [ids.astype("i4")])))
        table = pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), result)] if out else [[]] * len(result), schema=result)
        look = decimal = piece = payload = ids = flat = out = None
        give_back()
        return table

    return documents.groupBy("chunk").cogroup(coded.groupBy("chunk")).applyInArrow(assemble, ddl)


def digests(ids: list[int], decimal: dict[int, bytes], piece: dict[int, bytes]) -> tuple[str, str]:
    """Hashes of the decimal ids and of the decoded text."""
    return hashlib.sha256(b",".join(map(decimal.__getitem__, ids))).hexdigest(), hashlib.sha256(decoded(ids, piece).encode()).hexdigest()


def token_schema(kind: T.DataType) -> tuple[str, pa.Schema]:
    """Chunks of ids to decode, rows of two kinds. Documents (``used`` null): ``n`` ids, packed in ``payload``.
    Distinct ids of the chunk: ``used``."""
    arrow = [("chunk", pa.int64()), ("id", to_arrow(kind)), ("n", pa.int64()), ("payload", pa.binary()), ("used", pa.list_(pa.int32()))]
    return f"chunk long, id {kind.simpleString()}, n long, payload binary, used array<int>", pa.schema(arrow)


def token_rows(schema: pa.Schema, chunk: int, coded: list[tuple], used: np.ndarray | None) -> pa.Table:
    """The rows of documents ``(id, ids)`` of a chunk, and one of its distinct ids where ``used`` is given."""
    rows = [(chunk, key, len(ids), pack_numbers(ids), None) for key, ids in coded]
    if used is not None:
        rows.append((chunk, None, 0, None, used))
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [[]] * len(schema), schema=schema)


def pack_tokens(tokens: DataFrame, chunk_bytes: int) -> DataFrame:
    """Chunks of rows ``(id, ids)``; null elements are left out."""
    ddl, schema = token_schema(tokens.schema["id"].dataType)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, held, used = TaskContext.get().partitionId() << 32, 0, []
        distinct = lambda: np.unique(np.concatenate(used))
        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = ids.values.to_numpy() if ids.is_valid else np.zeros(0, np.int32)
                used.append(np.unique(ids))
                held += 4 * len(ids)
                full = held >= chunk_bytes
                yield from token_rows(schema, chunk, [(key, ids)], distinct() if full else None).to_batches()
                if full:
                    chunk, held, used = chunk + 1, 0, []
        if held:
            yield from token_rows(schema, chunk, [], distinct()).to_batches()

    return tokens.select("id", F.array_compact(F.col("ids").cast("array<int>")).alias("ids")).mapInArrow(chunks, ddl)


def decode_chunks(chunks: DataFrame, tokenizer: str) -> DataFrame:
    """``(doc_id, text)`` of chunks of ids in a written table."""
    kind = chunks.schema["id"].dataType
    used = chunks.where("used is not null").select(F.col("chunk").alias("of"), F.explode("used").alias("token"))
    # the vocabulary bounds the broadcast side
    pieces = used.join(F.broadcast(piece_table(chunks.sparkSession, tokenizer)), "token").select("of", "token", "piece")
    documents = chunks.where("used is null").select("chunk", "id", "n", "payload")

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        piece = dict(zip(right.column("token").to_pylist(), right.column("piece").to_pylist()))
        texts = [decoded(unpack_numbers(payload, n).tolist() if n else [], piece) for n, payload in zip(left.column("n").to_pylist(), left.column("payload").to_pylist())]
        return pa.table({"doc_id": left.column("id"), "text": pa.array(texts, pa.string())})

    return documents.groupBy("chunk").cogroup(pieces.groupBy("of")).applyInArrow(assemble, f"doc_id {kind.simpleString()}, text string")


def decoded(ids: list[int], piece: dict[int, bytes]) -> str:
    """The text of some ids; unknown ids give nothing, bytes that aren't UTF-8 the replacement character."""
    return b"".join([piece.get(i, b"") for i in ids]).decode("utf-8", "replace")


def encode(
    docs: DataFrame,
    tokenizer: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest_only: bool = False,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """``(doc_id, n_tokens, ids)`` for every row of ``docs``; with ``digest_only``
    ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``, where the text comes from decoding the ids.

    Null and empty texts give no ids; null ids and repeated rows are kept row by
    row; an empty table gives no rows; a very long text makes a chunk of its own
    size at most; other columns are ignored. The words and word numbers stay as files in the
    shared folder. The number of word buckets follows the bytes of text, so a
    bucket's size stays as it is when input grows.
    """
    return encode_chunks(docs, tokenizer or tokenizing.tokenizer_path(), id_col, text_col, chunk_bytes, digest_only)


def decode(tokens: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", ids_col: str = "ids", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``(doc_id, text)`` of rows with ids, joined with the id-to-piece table.

    Null ids and empty lists give an empty text, null or unknown elements nothing; null
    document ids and repeated rows are kept row by row; an empty table gives no rows.
    """
    tokenizer = tokenizer or tokenizing.tokenizer_path()
    picked = tokens.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{ids_col}`").alias("ids"))
    return decode_chunks(materialize(pack_tokens(picked, chunk_bytes), "tokens"), tokenizer)
