"""Substring dedup: prefix-partitioned suffix trees over the words of all documents.

1. A first pass counts suffixes (one begins at every word) by their first one, two, ...
   words.  A suffix is filed under its shortest prefix that few enough suffixes share, so
   prefixes have variable lengths and their groups fit in memory; neighbouring groups
   are joined into parts of about ``PART_SUFFIXES``.
2. A suffix whose first ``min_words`` words occur once hangs above every deep node.  Hashes
   of those words are counted, in fragments of the hash range, and such suffixes go.
3. Each part builds the top of its suffix tree, level by level: a node splits by the next
   word, nodes with a single document are dropped.  Words have short codes there; the
   last level splits by a 64-bit hash of all words before it, which tells apart what the
   codes do not.  Nodes that are left at depth ``min_words`` are the deep internal nodes:
   below each lie all suffixes that begin with one repeated sequence, and its smallest
   document keeps it.
4. Documents learn which of their windows lie below a node with a smaller document.

Documents are dealt to chunks by a hash of their id.  A chunk stands for all its documents:
it sends each distinct sequence once, with its smallest document, so that a passage in
any share of all documents reaches a part only once a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import columns, words
from lodestone.llm.workspace import Workspace

MIN_WORDS = 13
CHUNK_BYTES, MOST_CHUNK_BYTES = 4 << 20, 128 << 20
PART_SUFFIXES, FRAGMENT_WINDOWS = 2 << 20, 4 << 20
#: Lengths of prefixes, in words, that suffixes are filed under; the last resort is the whole window.
PREFIXES = (1, 2, 3, 4)
NO_DOC = np.iinfo(np.int64).max


@dataclass
class Plan:
    """How suffixes are split; its size depends on ``slots``, not on the corpus."""

    min_words: int
    chunks: int
    fragments: int
    parts: int
    #: part of each prefix of each length, by slot of its hash; -1: too many suffixes share it
    part_of: np.ndarray | None = None

    @property
    def slots(self) -> int:
        return max(1024, min(1 << 18, 8 * self.parts))


def _slots(hashes: np.ndarray, slots: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)


def _fragments(hashes: np.ndarray, fragments: int) -> np.ndarray:
    return _slots(hashes, fragments)


def _prefix_hashes(w: words.Words, at: np.ndarray, length: int) -> np.ndarray:
    out = np.zeros(len(at), np.uint64)
    for j in range(length):
        out = out * np.uint64(words._ROOT) + w.hashes[at + j]
    return words.mix(out)


def sizes(docs: DataFrame, min_words: int) -> Plan:
    """Chunks, fragments and parts for this corpus."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    chunk = min(MOST_CHUNK_BYTES, max(CHUNK_BYTES, int((total * 100) ** 0.5)))
    windows = total // 6 + 1  # a word and its separator have more bytes than that, by and large
    return Plan(min_words, max(1, -(-total // chunk)), max(1, -(-windows // FRAGMENT_WINDOWS)), max(1, -(-windows // PART_SUFFIXES)))


def file_prefixes(docs: DataFrame, plan: Plan) -> Plan:
    """Counts all suffixes by prefix and chooses the part of every prefix."""
    slots = plan.slots

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((len(PREFIXES), slots), np.int64)
        for batch in batches:
            for _, w in words.blocks(batch.column(0)):
                at = words.window_starts(w.first, plan.min_words)
                for k, length in enumerate(PREFIXES):
                    seen[k] += np.bincount(_slots(_prefix_hashes(w, at, length), slots), minlength=slots)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen.ravel()[at])], ["slot", "n"])

    rows = docs.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(len(PREFIXES) * slots, np.int64)
    for r in rows:
        counts[r["slot"]] = r["n"]
    few = counts <= max(PART_SUFFIXES, int(counts.sum()) // len(PREFIXES) // max(1, plan.parts))
    # a length only files what all shorter ones have left
    left, weight = 1.0, np.zeros(len(counts))
    for k in range(len(PREFIXES)):
        of = slice(k * slots, (k + 1) * slots)
        weight[of] = np.where(few[of], counts[of] * left, 0)
        left *= counts[of][~few[of]].sum() / max(1, counts[of].sum())
    upto = np.cumsum(weight)
    plan.part_of = np.where(few, np.minimum(upto * plan.parts // max(1.0, upto[-1]), plan.parts - 1), -1).reshape(len(PREFIXES), slots).astype(np.int32)
    return plan


class Chunk:
    """The documents of one chunk and their windows, each distinct sequence once."""

    def __init__(self, table: pa.Table, plan: Plan):
        self.ids, self.plan = table.column("doc_id").to_numpy(zero_copy_only=False), plan
        ids = table.column("doc_id")
        self.ids = ids.fill_null(NO_DOC).to_numpy().astype(np.int64)
        self.blocks, hashes, doc = [], [], []
        for first, w in words.blocks(table.column("text")):
            h, at = words.windows(w, plan.min_words)
            of = first + np.searchsorted(w.first, at, side="right") - 1
            self.blocks.append((first, w, h, at, of))
            hashes.append(h)
            doc.append(self.ids[of])
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.doc = np.concatenate(doc) if doc else np.zeros(0, np.int64)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct window hashes, the first place of each, its smallest and largest document."""
        known, first, inverse = np.unique(self.hashes, return_index=True, return_inverse=True)
        low, high = np.full(len(known), NO_DOC), np.full(len(known), np.iinfo(np.int64).min)
        np.minimum.at(low, inverse, self.doc)
        np.maximum.at(high, inverse, self.doc)
        return known, first, low, high

    def suffixes(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Part and first ``min_words`` words (16 bits each) of the windows at ``places``, which rise."""
        k = self.plan.min_words
        part, codes, at0, out = np.zeros(len(places), np.int64), np.zeros((k, len(places)), np.uint16), 0, 0
        for _, w, h, at, _ in self.blocks:
            to = int(np.searchsorted(places, at0 + len(h)))
            here = at[places[out:to] - at0]
            for j in range(k):
                codes[j, out:to] = w.hashes[here + j].astype(np.uint16)
            chosen = np.full(len(here), -1, np.int64)
            for n, length in enumerate(PREFIXES):
                chosen = np.where(chosen < 0, self.plan.part_of[n][_slots(_prefix_hashes(w, here, min(length, k)), self.plan.slots)], chosen)
            whole = _slots(h[places[out:to] - at0], self.plan.parts)
            part[out:to] = np.where(chosen < 0, whole, chosen)
            at0, out = at0 + len(h), to
        return part, codes


def repeated_windows(docs: DataFrame, plan: Plan, ws: Workspace) -> DataFrame:
    """Which windows of each chunk other chunks have too: bits in hash order, by fragment."""

    def send(table: pa.Table) -> pa.Table:
        known = np.unique(Chunk(table, plan).hashes)
        cuts = np.searchsorted(_fragments(known, plan.fragments), np.arange(plan.fragments + 1))
        out = [(f, table.column("chunk")[0].as_py(), int(b - a), columns.pack(known[a:b].astype(np.uint32))) for f, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.binary()))], ["fragment", "chunk", "n", "blob"])

    def meet(table: pa.Table) -> pa.Table:
        (low,), row = columns.gather(table, np.uint32)
        order = np.argsort(low, kind="stable")
        same = low[order][1:] == low[order][:-1]
        again = np.zeros(len(low), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        cuts = np.searchsorted(row, np.arange(table.num_rows + 1))
        bits = [np.packbits(again[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table([table.column("chunk"), table.column("fragment"), table.column("n"), pa.array(bits, pa.binary())], ["chunk", "fragment", "n", "blob"])

    sent = docs.groupBy("chunk").applyInArrow(send, "fragment int, chunk int, n long, blob binary")
    return ws.save(sent.groupBy("fragment").applyInArrow(meet, "chunk int, fragment int, n long, blob binary"), "again")


def split_nodes(node: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of the nodes by the next word: the child of each suffix, and the suffixes by child."""
    order = np.lexsort((word, node))
    new = np.ones(len(node), bool)
    new[1:] = (node[order][1:] != node[order][:-1]) | (word[order][1:] != word[order][:-1])
    child = np.empty(len(node), np.int64)
    child[order] = np.cumsum(new) - 1
    return child, order


def grow_tree(codes: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Builds the tree, breadth first, a level for each of ``codes`` (the next code of every suffix).

    Returns the suffixes that lie below deep internal nodes, their node, and each node's
    smallest document.  A node lives on while it has suffixes of two documents.
    """
    alive, node = np.arange(len(low)), np.zeros(len(low), np.int64)
    least = np.zeros(0, np.int64)
    for level in codes:
        if not len(alive):
            break
        node, order = split_nodes(node, level[alive])
        starts = np.flatnonzero(np.r_[True, np.diff(node[order]) > 0])
        least = np.minimum.reduceat(low[alive][order], starts)
        most = np.maximum.reduceat(high[alive][order], starts)
        internal = least != most
        keep = internal[node]
        number = np.cumsum(internal) - 1
        alive, node, least = alive[keep], number[node[keep]], least[internal]
    return alive, node, least


def deep_nodes(docs: DataFrame, again: DataFrame, plan: Plan, ws: Workspace) -> DataFrame:
    """For each chunk: hashes of its windows that repeat, with the smallest document of each."""
    k = plan.min_words

    def send(docs_table: pa.Table, again_table: pa.Table) -> pa.Table:
        schema = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("n", pa.int64()), ("blob", pa.binary())])
        if not docs_table.num_rows:
            return schema.empty_table()
        chunk = Chunk(docs_table, plan)
        known, first, low, high = chunk.distinct()
        again_table = again_table.sort_by("fragment")
        flags = [np.unpackbits(np.frombuffer(b.as_py(), np.uint8), count=n.as_py()) for b, n in zip(again_table.column("blob"), again_table.column("n"), strict=True)]
        wanted = (np.concatenate(flags).astype(bool) if flags else np.zeros(len(known), bool)) | (low != high)
        known, first, low, high = known[wanted], first[wanted], low[wanted], high[wanted]
        order = np.argsort(first)
        part, codes = chunk.suffixes(first[order])
        by_part = np.lexsort((codes[0], part))
        order, codes, part = order[by_part], codes[:, by_part], part[by_part]
        cuts, out = np.searchsorted(part, np.arange(plan.parts + 1)), []
        for p in np.unique(part):
            a, b = cuts[p], cuts[p + 1]
            o = order[a:b]
            out.append((int(p), docs_table.column("chunk")[0].as_py(), int(b - a), columns.pack(*codes[:, a:b], low[o], high[o] - low[o], known[o])))
        return pa.table([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    def meet(table: pa.Table) -> pa.Table:
        got, row = columns.gather(table, *[np.uint16] * k, np.int64, np.int64, np.uint64)
        low, high, known = got[k], got[k] + got[k + 1], got[k + 2]
        alive, node, least = grow_tree([*got[:k], known], low, high)
        tell = high[alive] > least[node]  # a chunk in which only the smallest document has it loses nothing
        alive, least_of = alive[tell], least[node[tell]]
        order = np.argsort(row[alive], kind="stable")
        alive, least_of = alive[order], least_of[order]
        cuts = np.searchsorted(row[alive], np.arange(table.num_rows + 1))
        out = [(c.as_py(), int(b - a), columns.pack(known[alive[a:b]], least_of[a:b])) for c, a, b in zip(table.column("chunk"), cuts[:-1], cuts[1:], strict=True) if b > a]
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], ["chunk", "n", "blob"])

    sent = docs.groupBy("chunk").cogroup(again.groupBy("chunk")).applyInArrow(send, "part int, chunk int, n long, blob binary")
    return ws.save(sent.groupBy("part").applyInArrow(meet, "chunk int, n long, blob binary"), "deep")


def remove_below(docs: DataFrame, deep: DataFrame, plan: Plan) -> DataFrame:
    """Documents without the words that the deep nodes give to a smaller document."""
    k = plan.min_words
    span = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())]))

    def cut(docs_table: pa.Table, deep_table: pa.Table) -> pa.Table:
        (known, least), _ = columns.gather(deep_table, np.uint64, np.int64)
        order = np.argsort(known)
        known, least = known[order], least[order]
        chunk = Chunk(docs_table, plan) if docs_table.num_rows else None
        n_words, n_removed, kept, spans = [], [], [], []
        for first, w, h, at, of in chunk.blocks if chunk else ():
            gone = np.zeros(len(w.hashes) + 1, np.int64)
            if len(known) and len(h):
                place = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = (known[place] == h) & (least[place] < chunk.ids[of]) & (chunk.ids[of] != NO_DOC)
                np.add.at(gone, at[hit], 1)
                np.subtract.at(gone, at[hit] + k, 1)
            gone = np.cumsum(gone[:-1]) > 0
            lost = np.r_[0, np.cumsum(gone)]
            for t in range(w.texts):
                a, b = int(w.first[t]), int(w.first[t + 1])
                text = docs_table.column("text")[first + t].as_py()
                found = text.encode().split() if text else []  # the same words: ASCII blanks only
                n = int(lost[b] - lost[a])
                if n:
                    edges = np.flatnonzero(np.diff(np.r_[0, gone[a:b].view(np.int8), 0]))
                    spans.append([{"start": int(x), "words": int(y - x)} for x, y in zip(edges[::2], edges[1::2], strict=True)])
                    found = [x for x, g in zip(found, gone[a:b].tolist(), strict=True) if not g]
                else:
                    spans.append([])
                n_words.append(b - a)
                n_removed.append(n)
                kept.append(b" ".join(found).decode())
        return pa.table([docs_table.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, span)], ["doc_id", "n_words", "n_removed", "kept_text", "removed"])

    joined = docs.groupBy("chunk").cogroup(deep.groupBy("chunk"))
    return joined.applyInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<start:long,words:long>>")


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Removes every word that lies in a run of ``min_words`` words which a smaller document has too.

    Takes doc_id and text, returns one row per document: doc_id, n_words, n_removed,
    kept_text (words joined by one blank) and removed (spans of words).

    Defined results: a null or empty text has no words; a document with a null doc_id
    loses nothing and takes nothing from others; rows with one doc_id never take from
    each other; texts shorter than ``min_words`` are kept; an empty table gives no rows;
    columns other than doc_id and text are ignored.
    """
    ws = Workspace(docs.sparkSession, "repeats")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    plan = file_prefixes(docs, sizes(docs, min_words))
    docs = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text"))), F.lit(plan.chunks)).cast("int"))
    again = repeated_windows(docs, plan, ws)
    deep = deep_nodes(docs, again, plan, ws)
    return remove_below(docs, deep, plan)


def op1_repeats(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op1_repeats": op1_repeats}
ORACLE_SQL: dict[str, str] = {}
