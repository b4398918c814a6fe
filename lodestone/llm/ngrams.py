"""N-gram Jaccard join with vertical partitioning.

1. Shingles are counted in fragments of the hash range: the number of documents (equal
   sets count once a chunk) gives the global order, rare shingles first.
2. Two sets with a Jaccard index of t share a shingle among the first n - ceil(t n) + 1 of
   each.  Shingles that only one document has come first in that order and can meet
   nothing, so a document keeps the rest of its prefix only, and most keep none.
3. Candidates are verified by vertical partitioning: the global order is cut into
   ``FRAGMENTS``, the overlap of a pair is counted in each fragment separately, and the
   partial counts are summed per pair.
4. Only components are asked for, and pairs inside one component can join nothing more.
   So first, in rounds, every shingle picks one of its sets, and every set is verified
   against the picked one with which it shares most of its prefix: a group of copies of any
   size costs a pair a round for each member.  When few pairs across components are
   left, all of those are verified, shingle by shingle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import columns, words
from lodestone.llm.components import connected_components
from lodestone.llm.workspace import Workspace, fresh

SHINGLE, NUMERATOR, DENOMINATOR = 5, 75, 100
CHUNK_BYTES, MOST_CHUNK_BYTES, COUNT_SHINGLES = 4 << 20, 128 << 20, 4 << 20
FRAGMENTS, PLACES = 4, 1 << 12
#: Pairs across components are all verified once there are at most so many for each open prefix shingle of a set.
EXACT_PAIRS, MOST_ROUNDS, SPREAD = 2, 8, 0.03
#: ... or once a round finds less than this part of what the best round found.
FADED = 20
BITS = 256


class Sets:
    """The shingle sets of the documents of one chunk."""

    def __init__(self, table: pa.Table, k: int):
        hashes, of, n = [], [], np.zeros(table.num_rows, np.int64)
        for first, w in words.blocks(table.column("text"), fold=True):
            h, at = words.windows(w, k)
            text = np.searchsorted(w.first, at, side="right") - 1
            counts = w.counts()
            short = np.flatnonzero((counts > 0) & (counts < k))
            whole = np.array([_sequence(w.hashes[w.first[t] : w.first[t + 1]]) for t in short], np.uint64)
            h, text = np.concatenate([h, whole]), np.concatenate([text, short])
            order = np.lexsort((h, text))
            h, text = h[order], text[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
            hashes.append(h[new])
            of.append(first + text[new])
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.of = np.concatenate(of) if of else np.zeros(0, np.int64)
        self.n = np.bincount(self.of, minlength=len(n)).astype(np.int64)
        self.first = np.r_[0, np.cumsum(self.n)]
        self.print = np.zeros(len(n), np.uint64)
        some = np.flatnonzero(self.n)
        if len(some):
            self.print[some] = words.mix(np.add.reduceat(words.mix(self.hashes ^ np.uint64(0x5851F42D4C957F2D)), self.first[some]) + self.n[some].astype(np.uint64))
        #: documents whose set no earlier document of the chunk has; those without an id come last
        self.own = np.zeros(len(n), bool)
        nameless = ~table.column("doc_id").is_valid().to_numpy()
        some = some[np.argsort(nameless[some], kind="stable")]
        self.own[some[np.unique(self.print[some], return_index=True)[1]]] = True


def _sequence(hashes: np.ndarray) -> np.uint64:
    n = len(hashes)
    return words.mix(np.sum(hashes * words.powers(words._ROOT, n), keepdims=True) + np.uint64(n))[0]


def _cuts(known: np.ndarray, fragments: int) -> np.ndarray:
    return np.searchsorted((known >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32), np.arange(fragments + 1))


def frequencies(docs: DataFrame, fragments: int, k: int, ws: Workspace) -> DataFrame:
    """Per chunk and count fragment: a code of each distinct shingle's frequency, in hash order; 0: one set has it."""

    def send(table: pa.Table) -> pa.Table:
        sets = Sets(table, k)
        known, n = np.unique(sets.hashes[sets.own[sets.of]], return_counts=True)
        cuts = _cuts(known, fragments)
        out = [(f, table.column("chunk")[0].as_py(), int(b - a), columns.pack(known[a:b].astype(np.uint32), n[a:b].astype(np.uint32))) for f, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.binary()))], ["fragment", "chunk", "n", "blob"])

    def meet(table: pa.Table) -> pa.Table:
        (low, n), row = columns.gather(table, np.uint32, np.uint32)
        order = np.argsort(low, kind="stable")
        starts = np.flatnonzero(np.r_[True, low[order][1:] != low[order][:-1]])
        total = np.add.reduceat(n[order].astype(np.int64), starts)
        code = np.where(total > 1, np.minimum(255, 4 * np.log2(np.maximum(total, 1))), 0).astype(np.uint8)
        out = np.empty(len(low), np.uint8)
        out[order] = np.repeat(code, np.diff(np.r_[starts, len(low)]))
        cuts = np.searchsorted(row, np.arange(table.num_rows + 1))
        return pa.table([table.column("chunk"), table.column("fragment"), table.column("n"), pa.array([columns.pack(out[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["chunk", "fragment", "n", "blob"])

    sent = docs.groupBy("chunk").applyInArrow(send, "fragment int, chunk int, n long, blob binary")
    return ws.save(sent.groupBy("fragment").applyInArrow(meet, "chunk int, fragment int, n long, blob binary"), "frequencies")


def bitmaps(tokens: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BITS`` bits of hashed shingles for each of n documents, and how many of its shingles share a bit with others."""
    bits = np.zeros((n, BITS // 64), np.uint64)
    np.bitwise_or.at(bits, (of, (tokens % np.uint64(BITS // 64)).astype(np.int64)), np.uint64(1) << (tokens >> np.uint64(8) & np.uint64(63)))
    return bits, np.bincount(of, minlength=n) - np.bitwise_count(bits).sum(axis=1).astype(np.int64)


def needed(n: np.ndarray) -> np.ndarray:
    """The least overlap that a set of n shingles has with any set that it links to."""
    return -(-NUMERATOR * n // DENOMINATOR)


def shared_sets(docs: DataFrame, codes: DataFrame, fragments: int, k: int, ws: Workspace) -> DataFrame:
    """Per document: doc_id, n_shingles, node (a hash of its set).

    Documents that can have partners also carry, once a chunk and set: shared, how many of
    their shingles other sets have too; tokens, those shingles in the global order (by
    frequency, then hash); places, the leading bits of that order; prefix, how many of them
    are in the prefix; and bits and slack, the bitmap of those.
    """
    longs = pa.list_(pa.int64())
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("shared", pa.int64()), ("prefix", pa.int32()), ("bits", longs), ("slack", pa.int32()), ("tokens", longs), ("places", pa.list_(pa.int16()))])

    def send(table: pa.Table, code_table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        sets = Sets(table, k)
        code_table = code_table.sort_by("fragment")
        (code,), _ = columns.gather(code_table, np.uint8)
        known = np.unique(sets.hashes[sets.own[sets.of]])
        rank = code[np.searchsorted(known, sets.hashes)] if len(known) else np.zeros(0, np.uint8)
        common = rank > 0
        shared = np.bincount(sets.of[common], minlength=table.num_rows)
        alive = sets.own & (shared >= np.maximum(1, needed(sets.n)))
        alive &= np.array([x.as_py() is not None for x in table.column("doc_id")], bool)
        keep = common & alive[sets.of]
        h, r, of = sets.hashes[keep], rank[keep], sets.of[keep]
        order = np.lexsort((h, r, of))
        h, r = h[order].view(np.int64), (r[order].astype(np.int16) << 4) | (h[order] >> np.uint64(60)).astype(np.int16)
        size = np.where(alive, shared, 0)
        offsets = np.r_[0, np.cumsum(size)].astype(np.int32)
        gone = ~alive
        prefix = sets.n - needed(sets.n) + 1 - (sets.n - shared)
        first = np.arange(len(of)) - np.repeat(offsets[:-1], size)
        early = first < np.maximum(prefix, 0)[np.repeat(np.arange(len(size)), size)]
        bits, slack = bitmaps(h.view(np.uint64)[early], np.repeat(np.arange(len(size)), size)[early], len(size))
        lists = [pa.ListArray.from_arrays(pa.array(offsets, mask=np.r_[gone, False]), pa.array(x)) for x in (h, r)]
        empty = sets.n == 0
        return pa.table([table.column("doc_id"), pa.array(sets.n), pa.array(sets.print.view(np.int64), mask=empty), pa.array(shared.astype(np.int64), mask=gone), pa.array(prefix.astype(np.int32), mask=gone), pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * (BITS // 64)), pa.array(bits.view(np.int64).ravel())), pa.array(slack.astype(np.int32)), *lists], schema=schema)

    out = "doc_id long, n_shingles long, node long, shared long, prefix int, bits array<long>, slack int, tokens array<long>, places array<smallint>"
    return ws.save(docs.groupBy("chunk").cogroup(codes.groupBy("chunk")).applyInArrow(send, out), "sets")


def least_overlap() -> Column:
    """The overlap that a link between sets a and b needs."""
    total = F.col("n_a") + F.col("n_b")
    return F.ceil(total * F.lit(NUMERATOR) / F.lit(NUMERATOR + DENOMINATOR) - F.lit(1e-9))


def may_link() -> Column:
    """Sizes and shared shingles allow the overlap that a link needs."""
    return (F.least("n_a", "n_b") >= least_overlap()) & (F.least("c_a", "c_b") >= least_overlap())


def promising(meetings: DataFrame) -> DataFrame:
    """Pairs a < b with the prefix shingles that they share, if those are enough.

    ``meetings``: a row for each shared prefix shingle, with n, c and r of both.  What two
    sets share besides lies behind the prefix of the one that ends first.
    """
    told = meetings.groupBy("a", "b", "n_a", "n_b", "r_a", "r_b").agg(F.count(F.lit(1)).alias("v"))
    return told.where(F.col("v") + F.greatest("r_a", "r_b") >= least_overlap()).select("a", "b", "v")


def _meeting(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Meetings of sets of two sides, of different components x and y, each pair with a < b."""
    both = left.join(right, on).where("x <> y")
    first = F.col("node_x") < F.col("node_y")
    ordered = [F.when(first, F.col(f"{k}_{p}")).otherwise(F.col(f"{k}_{q}")).alias(name) for k in ("node", "n", "c", "r") for p, q, name in (("x", "y", f"{k}_a"), ("y", "x", f"{k}_b"))]
    return both.select("token", *ordered).withColumnsRenamed({"node_a": "a", "node_b": "b"}).where(may_link())


def _side(rows: DataFrame, p: str, *more: str) -> DataFrame:
    return rows.select("token", *more, *[F.col(k).alias(f"{k}_{p}") for k in ("node", "n", "c", "r")])


def pivots(nodes: DataFrame, fragments: int) -> list[dict]:
    """Ranges of places that cut the global order into fragments with equally many shingles.

    There are at most ``PLACES`` places, whatever the size of the corpus.
    """
    rows = nodes.select(F.explode("places").alias("place")).groupBy("place").agg(F.count(F.lit(1)).alias("n")).orderBy("place").collect()
    total, seen, out = sum(r["n"] for r in rows), 0, []
    for r in rows:
        f = min(fragments - 1, seen * fragments // max(1, total))
        if out and out[-1]["fragment"] == f:
            out[-1]["upto"] = r["place"]
        else:
            out.append({"fragment": f, "since": r["place"], "upto": r["place"]})
        seen += r["n"]
    return out


def verified(ws: Workspace, pairs: DataFrame, nodes: DataFrame, cuts: list[dict], name: str) -> DataFrame:
    """Those of ``pairs`` (a, b) that link, by partial overlaps in fragments of the global order."""
    table = F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in cut.items()]) for cut in cuts or [{"fragment": 0, "since": 0, "upto": PLACES}]])).alias("cut")
    used = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    inside = lambda x, i: F.element_at("places", i + 1).between(F.col("cut.since"), F.col("cut.upto"))
    part = nodes.join(used, "node", "left_semi").select("node", "n", "tokens", "places", table)
    part = part.select("node", "n", "cut.fragment", F.filter("tokens", inside).alias("part")).where(F.size("part") > 0)
    part = ws.save(part, f"{name}_parts")
    left = part.select(F.col("node").alias("a"), F.col("n").alias("n_a"), "fragment", F.col("part").alias("part_a"))
    right = part.select(F.col("node").alias("b"), F.col("n").alias("n_b"), "fragment", F.col("part").alias("part_b"))
    with_a = ws.save(pairs.join(left, "a"), f"{name}_left")
    both = with_a.join(right, ["b", "fragment"])
    partial = both.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("part_a", "part_b")).alias("overlap"))
    summed = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("overlap").alias("overlap"))
    union = F.col("n_a") + F.col("n_b") - F.col("overlap")
    out = ws.save(summed.where(F.col("overlap") * DENOMINATOR >= union * NUMERATOR).select("a", "b"), f"{name}_links")
    ws.drop(f"{name}_parts", f"{name}_left")
    return out


def across(mixed: DataFrame, cells: DataFrame, tokens: DataFrame) -> DataFrame:
    """All pairs a < b of sets in different components that may link.

    Of two components of a shingle one is not its largest, so only sets outside the
    largest look for partners.  Two sets that need an overlap of o share a shingle among the
    first n - o + 1 of each, and what their prefixes share is bounded by their bitmaps.
    """
    largest = cells.join(tokens.select("token"), "token").groupBy("token").agg(F.max_by("component", F.struct("m", "component")).alias("largest"))
    keep = ["node", "n", "c", "r", "at", "component", "slack", *[f"bits{k}" for k in range(BITS // 64)]]
    rows = mixed.join(largest, "token")
    x = rows.where("component <> largest").select("token", *[F.col(k).alias(f"{k}_a") for k in keep])
    y = rows.select("token", (F.col("component") == F.col("largest")).alias("main"), *[F.col(k).alias(f"{k}_b") for k in keep])
    both = sum((F.bit_count(F.col(f"bits{k}_a").bitwiseAND(F.col(f"bits{k}_b"))) for k in range(BITS // 64)), F.lit(0))
    shared = both + F.least("slack_a", "slack_b")
    early = (F.col("at_a") <= F.col("n_a") - least_overlap()) & (F.col("at_b") <= F.col("n_b") - least_overlap())
    enough = shared + F.greatest("r_a", "r_b") >= least_overlap()
    once = F.col("main") | (F.col("node_a") < F.col("node_b"))
    found = x.join(y, (x["token"] == y["token"]) & (F.col("component_a") != F.col("component_b")) & once & may_link() & early & enough)
    return found.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def linked_sets(ws: Workspace, sets: DataFrame, fragments: int = FRAGMENTS) -> DataFrame:
    """node, component of every set that links to another."""
    nodes = sets.where("tokens is not null").select("node", F.col("n_shingles").alias("n"), F.col("shared").alias("c"), "prefix", "bits", "slack", "tokens", "places")
    nodes = ws.save(nodes.dropDuplicates(["node"]), "nodes")
    cuts = pivots(nodes, fragments)
    own = F.slice("tokens", 1, F.col("prefix"))
    prefix = nodes.select("node", "n", "c", (F.col("c") - F.col("prefix")).alias("r"), *[F.col("bits")[k].alias(f"bits{k}") for k in range(BITS // 64)], "slack", F.posexplode(own).alias("at", "token"))
    open_ = ws.save(prefix.withColumn("at", F.col("at") + F.col("n") - F.col("c")).withColumn("component", F.col("node")), "open")
    links, gained, most = None, 0, 0
    for k in range(MOST_ROUNDS + 1):
        # shingles whose sets lie in different components; how many pairs across components they hold
        cells = ws.save(open_.groupBy("token", "component").agg(F.count(F.lit(1)).alias("m")), f"cells{k}")
        tokens = cells.groupBy("token").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("inside"), F.count(F.lit(1)).alias("components")).where("components > 1")
        tokens = ws.save(tokens, f"tokens{k}")
        seen = tokens.agg(F.sum("m").alias("rows"), (F.sum(F.col("m") * F.col("m") - F.col("inside")) / 2).alias("pairs")).first()
        if not seen["rows"]:
            break
        mixed = ws.save(open_.join(tokens.select("token"), "token"), f"mixed{k}")
        last = seen["pairs"] <= EXACT_PAIRS * seen["rows"] or (k > 0 and gained * FADED <= most) or k == MOST_ROUNDS
        if last:
            pairs = across(mixed, cells, tokens)
        else:
            # a star for each shingle: its sets meet one that has little of its own, another one in each round
            turn = (F.col("n") - F.col("c")) / F.col("n") + F.pmod(F.xxhash64("node", F.lit(k)), F.lit(1000)) * (SPREAD * k / 1000)
            centre = mixed.groupBy("token").agg(F.min(F.struct(turn.alias("turn"), "node", "n", "c", "r", "component")).alias("s")).select("token", "s.node", "s.n", "s.c", "s.r", "s.component")
            centre = ws.save(centre, f"centre{k}")
            met = _meeting(_side(mixed.withColumnRenamed("component", "x"), "x", "x"), _side(centre.withColumnRenamed("component", "y"), "y", "y"), ["token"])
            told = promising(met)
            ends = told.select("*", F.explode(F.array(F.col("a"), F.col("b"))).alias("node"))
            # of the two ends of a pair the one that is no centre decides: it has few pairs
            best = ends.groupBy("node").agg(F.max(F.struct("v", "a", "b")).alias("p"))
            pairs = best.select("p.a", "p.b").distinct()
        pairs = pairs.select("a", "b")
        if links is not None:
            pairs = pairs.join(links.select("a", "b"), ["a", "b"], "left_anti")
        new = verified(ws, ws.save(pairs, f"pairs{k}"), nodes, cuts, f"round{k}")
        links = new if links is None else ws.save(links.unionByName(new), f"links{k}")
        if last:
            break
        gained = new.count()
        most = max(most, gained)
        # as good as final: what has one label here is connected
        known = ws.save(connected_components(ws, links, f"early{k}", rounds=2), f"known{k}")
        open_ = ws.save(mixed.drop("component").join(known, "node", "left").withColumn("component", F.coalesce("component", "node")), f"open{k}")
        ws.drop(f"cells{k}", f"tokens{k}", f"mixed{k}", f"centre{k}", f"pairs{k}", f"known{k}", "open" if k == 0 else f"open{k - 1}")
    if links is None:
        links = nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    return ws.save(connected_components(ws, links, "all"), "components")


def jaccard_components(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """Links documents whose word shingle sets have a Jaccard index of 0.75 at least.

    Takes doc_id and text; returns doc_id, n_shingles, component_id (the smallest doc_id
    reachable by links, itself included), one row per document.

    Defined results: a text without words, or null, has no shingles and links with nothing;
    one with fewer than ``k`` words has its whole sequence as its one shingle; a null
    doc_id links with nothing and has a null component; rows with one doc_id but
    different texts are linked each by its text; an empty table gives no rows; other
    columns are ignored.
    """
    ws = Workspace(docs.sparkSession, "ngrams")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    chunk = min(MOST_CHUNK_BYTES, max(CHUNK_BYTES, int((total * 100) ** 0.5)))
    fragments = max(1, -(-(total // 6) // COUNT_SHINGLES))
    docs = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, -(-total // chunk)))).cast("int"))
    codes = frequencies(docs, fragments, k, ws)
    sets = shared_sets(docs, codes, fragments, k, ws)
    components = linked_sets(ws, sets)
    rows = sets.where("node is not null and doc_id is not null").select("doc_id", "node")
    named = rows.join(components, "node", "left").select("doc_id", "node", F.coalesce("component", "node").alias("component"))
    named = ws.save(named, "named")
    least = ws.save(named.groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    linked = ws.save(named.select("node", "component").distinct().join(least, "component").select("node", "component_id"), "by_node")
    out = sets.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")).join(linked, "node", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The document with the smallest id of each component, with its columns; rows without an id stay, and so do all rows of an id that is kept."""
    found = jaccard_components(docs).where("doc_id = component_id").select(F.col("doc_id").alias(fresh(docs, "kept_id"))).distinct()
    name = found.columns[0]
    kept = docs.join(found, F.col("doc_id") == F.col(name), "left").where(F.col(name).isNotNull() | F.col("doc_id").isNull())
    return kept.select(*[docs[c] for c in docs.columns])


def op9_ngrams(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op9_ngrams": op9_ngrams}
ORACLE_SQL: dict[str, str] = {}
