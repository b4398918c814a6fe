"""Packing: first-fit decreasing with a tournament tree, in randomised groups.

Every document is tokenised whole and ends with one end token.  It is cut into
pieces of ``capacity`` tokens and a rest; pieces are dealt to groups by a hash of
their identity and each group is packed by itself, so a group never grows with the
corpus and any lost task can be repeated with the same result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.workspace import Workspace

CAPACITY, END_ID, GROUP_PIECES = 2048, 1, 4096

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = f"{PIECES}, sequence_id long, offset long"


@lru_cache(maxsize=2)
def encoder(path: str):
    """Text to ids (numpy uint32) by the vocabulary at ``path``, a tokenizers JSON file.

    Where the same vocabulary lies beside it as ranks, those are used: equal ids at four
    times the speed.  Texts that hold an added token (such as <|endoftext|>, which is one id
    here), and those that the faster library gives up on, take the slower one.
    """
    import base64
    import os

    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    added = [t.content for t in slow.get_added_tokens_decoder().values()]

    def by_file(text: str) -> np.ndarray:
        return np.array(slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    ranks = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks):
        return by_file
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def by_ranks(text: str) -> np.ndarray:
        if any(t in text for t in added):
            return by_file(text)
        try:
            return np.array(fast.encode_ordinary(text), dtype=np.uint32)
        except BaseException as e:  # noqa: BLE001  its regex engine panics on some very long runs
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return by_file(text)

    return by_ranks


class Bins:
    """Bins in order of opening; each inner node of the tree has the larger room below it."""

    def __init__(self, most: int, capacity: int):
        self.leaves = 1 << max(0, most - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, length: int) -> tuple[int, int]:
        """The first bin with room for ``length``, and the room that it had."""
        room, i = self.room, 1
        while i < self.leaves:
            i *= 2
            if room[i] < length:
                i += 1
        had, at = room[i], i - self.leaves
        room[i] = had - length
        while i > 1:
            i //= 2
            a, b = room[2 * i], room[2 * i + 1]
            room[i] = a if a > b else b
        return at, had


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every length; the lengths come in decreasing order."""
    bins, at, offset = Bins(len(lengths), capacity), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k, n in enumerate(lengths.tolist()):
        at[k], had = bins.place(n)
        offset[k] = capacity - had
    return at, offset


def cut_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: ``PIECES``, the number of its row in its task (turn), and their ids if asked for."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, turn = encoder(tokenizer), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out: list[list] = [[] for _ in range(7)]
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(ids), capacity):
                        piece = ids[start : start + capacity]
                        for column, x in zip(out, (doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), turn, piece if with_ids else None), strict=True):
                            column.append(x)
                    turn += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.list_(pa.int32()) if k == 6 else pa.int64()) for k, c in enumerate(out) if k < 6 or with_ids], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "turn", "ids"][: 6 + with_ids])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES + ", turn long" + ", ids array<int>" * with_ids)


def pack_pieces(pieces: DataFrame, groups: int, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (stored ones) with ``sequence_id`` and ``offset`` for ``turn``; first-fit decreasing in each group.

    Ties go by doc_id (null first), start and content.  The turn spreads equal rows over the groups.
    """
    def pack(table: pa.Table) -> pa.Table:
        group = table.column("pack_group")[0].as_py()
        table = table.drop_columns(["pack_group", "turn"]).sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        at, offset = pack_lengths(table.column("length").to_numpy(), capacity)
        return table.append_column("sequence_id", pa.array(at + (np.int64(group) << 24))).append_column("offset", pa.array(offset))

    key = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "turn"), F.lit(groups))
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.drop("turn").schema)
    return pieces.withColumn("pack_group", key).groupBy("pack_group").applyInArrow(pack, f"{out}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, group_pieces: int = GROUP_PIECES, with_ids: bool = False) -> DataFrame:
    """Packs all ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens.

    Returns one row per piece: ``PACKED`` (and ``ids`` if asked for).  A sequence is
    the pieces with one sequence_id; offsets in it are gapless from 0.  Only piece
    records are shuffled, not texts.

    Defined results: a null or empty text is the end token alone; a null doc_id stays
    null; repeated rows are packed once per row; very long texts become many full
    pieces; an empty table gives no rows; other columns are ignored, whatever
    their names.
    """
    seen = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0)).alias("bytes")).first()
    pieces = seen["n"] + seen["bytes"] // (2 * capacity)  # a token has two bytes at least, nearly always
    groups = max(1, -(-pieces // group_pieces))
    # stored, so that a task that is run again deals its pieces to the same groups
    stored = Workspace(docs.sparkSession, "packing").save(cut_documents(docs, tokenizer, capacity, end_id, with_ids), "pieces")
    return pack_pieces(stored, groups, capacity)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op2_packing": op2_packing}
ORACLE_SQL: dict[str, str] = {}
