"""Operators on documents against plain versions, and on awkward rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import chat, lines, mixing, ngrams, packing, quality, repeats, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, component_id long, kept_text string, shard int, slot long, bucket int"


def rows(*pairs, source="s"):
    """Documents with more columns than needed, called like what operators add."""
    return [(i, t, "en", source, None if t is None else len(t), -1, -1.0, -1, "x", -1, -1, -1) for i, t in pairs]


LONG = " ".join(f"word{i}" for i in range(30_000))
SHARED = " ".join(f"shared{i}" for i in range(40))
AWKWARD = rows(
    (1, SHARED), (2, f"before {SHARED} after"), (3, None), (4, ""), (5, "   \t\n "), (6, "one"), (7, LONG), (8, LONG), (None, SHARED), (None, None),
    (9, "tie a b c d e f"), (9, "tie a b c d e f"), (10, "tie a b c d e f"), (11, "ÀÉ ünïcode ÀÉ ünïcode"),
)


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def key(x):
    return (x is None, x)


def plain_repeats(table, k=13):
    first = {}
    for i, t in table:
        w = WORD.findall(t or "")
        for p in range(len(w) - k + 1) if i is not None else ():
            g = tuple(w[p : p + k])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, t in table:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for p in range(len(w) - k + 1) if i is not None else ():
            if first[tuple(w[p : p + k])] < i:
                gone[p : p + k] = [True] * k
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=lambda r: (key(r[0]), r[1:]))


def test_repeats(awkward, docs):
    for frame in (awkward, docs):
        got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in repeats.remove_repeats(frame).collect()), key=lambda r: (key(r[0]), r[1:]))
        assert got == plain_repeats([(r.doc_id, r.text) for r in frame.collect()])


def test_repeats_spans_cover_removed_words(docs):
    for r in repeats.remove_repeats(docs).collect():
        assert sum(s["words"] for s in r.removed) == r.n_removed


def test_suffix_tree_keeps_nodes_of_two_documents():
    codes = [np.array([1, 1, 1, 2, 2]), np.array([5, 5, 6, 7, 7])]
    low = np.array([10, 3, 4, 8, 8])
    alive, node, least = repeats.grow_tree(codes, low, low)
    assert sorted(alive.tolist()) == [0, 1] and least.tolist() == [3]


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def plain_jaccard(table):
    sets = []
    for _, t in table:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    links = [(a, b) for a in range(len(sets)) for b in range(a) if table[a][0] is not None and table[b][0] is not None and sets[a] and sets[b] and (len(sets[a] & sets[b]) * 100 >= 75 * len(sets[a] | sets[b]))]
    group = components(len(sets), links)
    least = {}
    for g, (i, _) in zip(group, table):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return sorted(((i, len(s), None if i is None else least[g]) for (i, _), s, g in zip(table, sets, group)), key=lambda r: (key(r[0]), r[1]))


def test_jaccard_components(spark, awkward, docs):
    base = [f"w{i}" for i in range(60)]
    near = [(100 + k, " ".join(base[:k] + [f"x{k}"] + base[k + 1 :])) for k in range(0, 60, 3)]
    chain = [(200 + k, " ".join(f"c{i}" for i in range(k, k + 50))) for k in range(0, 40, 4)]
    for frame in (awkward, docs.limit(150), spark.createDataFrame(rows(*near, *chain), SCHEMA)):
        frame = spark.createDataFrame(frame.collect(), frame.schema)
        got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngrams.jaccard_components(frame).collect()), key=lambda r: (key(r[0]), r[1]))
        assert got == plain_jaccard([(r.doc_id, r.text) for r in frame.collect()])


@pytest.mark.parametrize("order", [1, -1])
def test_jaccard_rows_without_an_id_hide_nothing(spark, order):
    """A copy without an id, before or after the copy with one, takes no link from it."""
    words = [f"w{i}" for i in range(60)]
    table = [(None, " ".join(words)), (1, " ".join(words)), (2, " ".join([*words[:59], "other"])), (None, "alone in the world with nobody")]
    frame = spark.createDataFrame(table[::order], "doc_id long, text string").coalesce(1)
    got = Counter((r.doc_id, r.component_id) for r in ngrams.jaccard_components(frame).collect())
    assert got == Counter([(None, None), (1, 1), (2, 1), (None, None)])


def test_jaccard_many_near_copies(spark):
    """More copies than one round of stars joins, and outsiders that share the words but no link."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(150)]
    table = []
    for k in range(120):
        w = list(base)
        for at in rng.choice(150, 3 if k % 3 else 12, replace=False):
            w[at] = f"own{k}x{at}"
        table.append((k, " ".join(w)))
    frame = spark.createDataFrame(rows(*table), SCHEMA)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngrams.jaccard_components(frame).collect())
    assert got == plain_jaccard(table)


def test_packing_round_trip(awkward, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(path)
    for frame in (awkward, docs):
        out = packing.pack_documents(frame, path, with_ids=True).collect()
        sequences, by_doc = defaultdict(list), defaultdict(list)
        for r in out:
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids)
            sequences[r.sequence_id].append((r.offset, r.length))
            by_doc[r.doc_id].append(r)
        for pieces in sequences.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= 2048
        want = Counter()
        for r in frame.collect():
            ids = [*reference.encode(r.text or "", add_special_tokens=False).ids, 1]
            for start in range(0, len(ids), 2048):
                want[r.doc_id, start, len(ids), tuple(ids[start : start + 2048])] += 1
        assert want == Counter((r.doc_id, r.start, r.doc_tokens, tuple(r.ids)) for r in out)


def test_packing_wastes_little(docs):
    used = Counter()
    for r in packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).collect():
        used[r.sequence_id] += r.length
    padding = sum(2048 - n for n in used.values() if n & (n - 1))
    assert padding <= 0.02 * 2048 * len(used)


def test_first_fit_decreasing_takes_the_first_bin():
    lengths = np.sort(np.random.default_rng(0).integers(1, 100, 300))[::-1]
    at, offset = packing.pack_lengths(lengths, 100)
    room = []
    for n, a, o in zip(lengths, at, offset):
        first = next((k for k, r in enumerate(room) if r >= n), len(room))
        if first == len(room):
            room.append(100)
        assert a == first and o == 100 - room[first]
        room[first] -= n


def test_sharding(awkward, docs, spark):
    hot = spark.createDataFrame(rows(*[(i, "hot text") for i in range(400)], *[(1000 + i, f"text {i} " * (i % 9 + 1)) for i in range(800)], *[(3000 + i, f"pair {i // 2}") for i in range(60)]), SCHEMA)
    for frame in (awkward, docs, hot):
        out, texts = sharding.shard_documents(frame).collect(), frame.collect()
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in texts)
        slots = defaultdict(list)
        for r in out:
            slots[r.shard].append(r.slot)
            assert r.law == "bytes" and r.grown_shard is None
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    load, pairs = Counter(), defaultdict(set)
    for r in out:
        load[r.shard] += r["size"]
        if r.doc_id >= 3000:
            pairs[r.text_crc32].add(r.shard)
    assert max(load.values()) - min(load.values()) <= 60
    assert sum(len(s) == 1 for s in pairs.values()) >= 0.9 * len(pairs)


def test_mixing(awkward, spark, docs):
    mixed = spark.createDataFrame(rows(*[(i, "w " * (i % 7)) for i in range(300)], source="a") + rows(*[(i, "w " * 3) for i in range(300, 310)], source="b") + rows((400, "x y z"), source=None), SCHEMA)
    for frame in (awkward, docs, mixed):
        out = mixing.mix(frame).collect()
        assert len(out) == frame.count()
        assert Counter((r.doc_id, r["size"]) for r in out) == Counter((i, len(WORD.findall(t or ""))) for i, t in ((r.doc_id, r.text) for r in frame.collect()))
        taken, target, size = Counter(), {}, {}
        for r in out:
            assert 0 <= r.taken <= 3 * r["size"]
            taken[r.target] += r.taken
            target[r.target], size[r.target] = r.target, r.source_size
        assert all(abs(taken[t] - round(t)) <= 1 for t in target) or len(target) < len({r.source for r in frame.collect()})
        assert [r.asDict() for r in sorted(out, key=str)] == [r.asDict() for r in sorted(mixing.mix(frame).collect(), key=str)]


def test_targets_are_levelled(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 10), ("c", 10), ("d", 1000), (None, 5)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    weights, full = {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}, {"a": 300, "b": 30, "c": 30, "d": 3000, None: 15}
    target, total = {}, 1125.0
    while True:  # the excess is shared again until none is above
        open_ = [k for k in weights if target.get(k) != full[k]]
        share = (total - sum(full[k] for k in weights if k not in open_)) / sum(weights[k] for k in open_)
        target = {k: share * weights[k] if k in open_ else full[k] for k in weights}
        over = [k for k in open_ if target[k] > full[k]]
        if not over:
            break
        target |= {k: full[k] for k in over}
    assert got == pytest.approx(target)


def test_mixed_documents_repeat_whole_documents(docs):
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    n, taken = Counter(r.doc_id for r in out.collect()), {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert all(abs(n[i] * r["size"] - r.taken) <= r["size"] / 2 for i, r in taken.items())


def test_quality_learns_and_ignores_held_out_labels(spark):
    rng = np.random.default_rng(1)
    good = [" ".join(rng.choice(["the", "river", "runs", "along", "green", "hills"], 60)) + "." for _ in range(150)]
    bad = ["!!! ".join(rng.choice(["BUY", "NOW", "CLICK", "FREE", "$$$"], 40)) for _ in range(150)]
    table = list(enumerate(good + bad))
    frame = spark.createDataFrame(rows(*table, (900, None), (901, ""), (None, "the river")), SCHEMA)
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i, _ in table] + [(5, 1, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    flipped = spark.createDataFrame([(i, int(i < 150) if zlib.crc32(str(i).encode()) % 3 != 1 else int(i >= 150), 0) for i, _ in table] + [(7, None, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality.classify(frame, labels).collect()}
    assert all(r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for i, r in out.items())
    held = [i for i, _ in table if out[i].held_out]
    assert np.mean([out[i].predicted == int(i < 150) for i in held]) > 0.95
    assert {i: r.score for i, r in out.items()} == {r.doc_id: r.score for r in quality.classify(frame, flipped).collect()}
    kept = quality.keep_good(frame, labels)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if r.predicted}


def test_quality_without_labels(awkward, spark, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.classify(awkward, none).collect()} == {0.5}
    assert quality.classify(empty, none).count() == 0


def test_quality_on_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = quality.op7_quality(spark, sf).where("held_out").join(labels, "doc_id").select("predicted", "quality").collect()
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95


def test_quality_learns_each_id_once_and_no_disputed_one(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)] + [(2, "other text")] * 5 + [(3, "x" * 40_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(4, 1), (6, None)], "doc_id long, quality int")
    seen = {}
    quality_fit = quality.fit
    try:
        quality.fit = lambda good, bad: seen.update(good=good, bad=bad) or quality_fit(good, bad)
        quality.train(docs, labels)
        free = {i for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1}
        assert sorted(seen["good"]) == sorted(f"text {i}".encode() for i in free if i % 2)
        bad = [f"text {i}".encode() for i in free if i % 2 == 0 and i not in (2, 4, 6)]
        assert len([t for t in seen["bad"] if t in (b"text 2", b"other text")]) == (2 in free) and sorted(t for t in seen["bad"] if t not in (b"text 2", b"other text")) == sorted(bad)
        first = list(seen["good"])
        quality.train(docs, labels, per_class=3)
        assert seen["good"] == first[:3] and len(seen["bad"]) == 3
    finally:
        quality.fit = quality_fit


def test_packing_ids_are_those_of_the_tokenizer_with_its_special_tokens(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "<|endoftext", "no such token", "long " * 5000 + "<|endoftext|> end", None]
    frame = spark.createDataFrame(list(enumerate(texts)) + [(9, "same row")] * 300, "doc_id long, text string")
    pieces = {}
    for r in packing.pack_documents(frame, path, with_ids=True, group_pieces=64).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        want = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        here = sorted(pieces[i], key=lambda r: r.start)
        assert [x for r in here for x in r.ids] == want and {r.doc_tokens for r in here} == {len(want)}
    # equal rows are dealt to many groups
    assert len(pieces[9]) == 300 and len({r.sequence_id >> 24 for r in pieces[9]}) > 2


def test_lines_exact_and_fuzzy(spark):
    line = "the quick brown fox jumps over the lazy dog while seven wizards watch from the northern tower of the castle"
    changed = line.replace("seven", "sever")
    frame = spark.createDataFrame(rows((1, f"unique first\n{line}"), (2, f"{changed}\nkept words here"), (3, f"THE quick, brown fox!\n{line.upper()}"), (4, None), (5, ""), (None, line), (6, "...\n...\n!!"), (7, "a line\na line"), (7, "a line\na line")), SCHEMA)
    out = lines.dedup_lines(frame)
    assert out.columns[: len(frame.columns)] == frame.columns
    got = {(r.doc_id, r.text): r[len(frame.columns) :] for r in out.collect()}
    assert got[1, f"unique first\n{line}"] == ([], f"unique first\n{line}")
    assert got[2, f"{changed}\nkept words here"] == ([0], "kept words here")
    assert got[3, f"THE quick, brown fox!\n{line.upper()}"] == ([1], "THE quick, brown fox!")
    assert got[4, None] == ([], None) and got[5, ""] == ([], "") and got[None, line] == ([0], "")
    assert got[6, "...\n...\n!!"] == ([], "...\n...\n!!")
    assert sorted(r[len(frame.columns) :] for r in out.collect() if r.doc_id == 7) == [([0, 1], ""), ([1], "a line")]
    left = lines.without_repeated_lines(frame)
    assert left.columns == frame.columns and Counter(r.doc_id for r in left.collect()) == Counter([1, 2, 3, 4, 5, 6, 7])


def test_near_lines_meet_whatever_else_is_in_their_block(spark):
    """Lines of the same words in other orders have the same SimHash, but are not alike: they must not hide those that are."""
    rng, table = np.random.default_rng(5), []
    for base in range(3):
        line = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(40)]
        changed = next(c for k in range(40) if len(_blocks(" ".join(line)) & _blocks(c := " ".join([*line[:k], "q" + line[k][1:], *line[k + 1 :]]))) > 0)
        others = [" ".join(rng.permutation(line)) for _ in range(60 if base else 12)]
        table += [(1000 * base + i, t) for i, t in enumerate([" ".join(line), *others, changed])]
    out = lines.dedup_lines(spark.createDataFrame(table, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in out if r.removed_lines) == [13, 1061, 2061]


def test_short_near_lines_are_all_found(spark):
    """Every variant with as many edits as are alike, at any places, goes with its line."""
    rng, table = np.random.default_rng(6), []
    for base in range(400):
        line = " ".join("".join(rng.choice(list("abcdé"), rng.integers(1, 9))) for _ in range(60))[: 9 + base * (lines.SHORT - 9) // 400].strip()
        changed = list(line)
        for _ in range(int(len(line) / 10)):
            k = int(rng.integers(len(changed)))
            changed[k : k + 1] = [["x"], [], ["x", changed[k]]][rng.integers(3)]
        table += [(base, line), (1000 + base, " ".join("".join(changed).split()))]
    out = {r.doc_id: r.removed_lines for r in lines.dedup_lines(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert [i for i, t in table if not out[i] and any(lines.alike(t, u, 0.9) for k, u in table if k < i)] == []
    assert sum(map(bool, out.values())) > 300


def test_documents_in_other_scripts_keep_their_other_lines(spark):
    texts = ["общая строка\nпервый текст", "общая строка\nвторой текст", "общая строка\n一二三", "общая строка\n\u2014 \u2026 ..."]
    left = lines.without_repeated_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in left} == {0: texts[0], 1: "второй текст", 2: "一二三"}


def _blocks(text):
    bits = "".join(f"{int(v):064b}" for v in lines.signatures(pa.array([text]))[0][0])
    width = lines.BITS // lines.BLOCKS
    return {(k, bits[k * width : (k + 1) * width]) for k in range(lines.BLOCKS)}


@pytest.mark.parametrize("n_words", [6, 12, 20, 40, 80])
def test_near_lines_are_found_at_every_length(spark, n_words):
    """Against all pairs: of groups of four copies with one, two or four edits each, nine in ten of what should go do, and nothing else."""
    rng, table = np.random.default_rng(n_words), []
    letters = np.array(list("etaoinshrdlucmfwypbgk"))
    for group in range(150):
        line = " ".join("".join(rng.choice(letters, rng.integers(2, 9))) for _ in range(n_words))
        for _ in range(4):
            changed = list(line)
            for _ in range((1, 2, 4)[group % 3]):
                k = int(rng.integers(len(changed)))
                changed[k : k + 1] = [["x"], [], ["x", changed[k]]][rng.integers(3)]
            table.append((len(table), " ".join("".join(changed).split())))
    gone = {r.doc_id for r in lines.dedup_lines(spark.createDataFrame(table, "doc_id long, text string")).collect() if r.removed_lines}
    for kind in range(3):
        want = set()
        for at in range(4 * kind, len(table), 12):
            label = list(range(4))
            for i in range(4):
                for j in range(i):
                    if lines.alike(table[at + i][1], table[at + j][1], 0.9):
                        label = [label[j] if x == label[i] else x for x in label] if label[i] != label[j] else label
            want |= {at + i for i in range(4) if label.index(label[i]) != i}
        here = {i for i in gone if i // 4 % 3 == kind}
        assert here <= want
        assert len(here) >= 0.9 * len(want)


def test_equal_rows_keep_one_occurrence(spark):
    table = [(1, "same line here\nother line there")] * 3 + [(None, "same line here")] * 2 + [(None, None)] * 2 + [(2, "a\n" * 3000 + "b")]
    out = lines.dedup_lines(spark.createDataFrame(table, "doc_id long, text string")).collect()
    assert sorted(len(r.removed_lines) for r in out if r.doc_id == 1) == [0, 2, 2]
    assert [list(r.removed_lines) for r in out if r.doc_id is None and r.text] == [[0], [0]]
    assert [(r.removed_lines, r.kept_text) for r in out if r.text is None] == [([], None)] * 2
    assert [(len(r.removed_lines), r.kept_text) for r in out if r.doc_id == 2] == [(2999, "a\nb")]


def test_lines_without_blanks_and_very_long_ones(spark):
    rng = np.random.default_rng(3)
    long = "".join(map(chr, rng.integers(0x4E00, 0x9FA5, 3000)))
    near = "".join("x" if k % 40 == 7 else c for k, c in enumerate(long))
    many = " ".join(f"w{rng.integers(1 << 20)}" for _ in range(20_000))
    table = [(1, long), (2, near), (3, many), (4, many.replace("w1", "v1", 40)), (5, long[::-1])]
    out = lines.dedup_lines(spark.createDataFrame(table, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in out if r.removed_lines) == [2, 4]


def test_lines_remove_all_exact_repeats_and_no_unlike_ones(docs):
    """No exact repeat stays; every line that goes is alike a line that stays, or one that went."""
    table = sorted((r.doc_id, r.text) for r in docs.collect())
    out = {r.doc_id: set(r.removed_lines) for r in lines.dedup_lines(docs).collect()}
    kept, gone = [], []
    for i, t in table:
        for k, x in enumerate(lines.normalise(t).split(b"\n")):
            x = b" ".join(x.split()).decode()
            if x:
                (gone if k in out[i] else kept).append(x)
    assert len(kept) == len(set(kept))
    every = set(kept) | set(gone)
    for x in [x for x in gone if x not in set(kept)][:40]:
        assert any(y != x and abs(len(x) - len(y)) <= 0.12 * len(x) and lines.alike(x, y, 0.9) for y in every)


def test_chat_links_quotations(spark):
    table = [
        (1, 0, "user", "Hello there friend\nHow are you?", 1), (1, 1, "assistant", "> How are you?\nFine.\n\nAnd you?", 1),
        (1, 2, "user", "On Monday bob wrote:\n> Fine.\n>\n> > How are you?\nGood", 1), (1, 5, "user", "> hello   THERE friend\nlate", 1), (1, 5, "user", "> hello   THERE friend\nlate", 1),
        (1, 6, "user", "> nobody said this\nanswer", 1), (2, 0, "user", None, 1), (None, 1, "user", "x", 1), (3, None, "user", "y", 1), (4, 3, None, "> z", 1),
    ]
    frame = spark.createDataFrame(table, "conv_id long, turn long, role string, text string, depth int")
    got = {(r.conv_id, r.turn): (r.text, r.parent_turn, r.root_turn, r.depth, r.linked) for r in chat.link_quotations(frame).collect()}
    assert got[1, 0] == ("Hello there friend\nHow are you?", None, 0, 0, 0)
    assert got[1, 1] == ("Fine.\n\nAnd you?", 0, 0, 1, 1)
    assert got[1, 2] == ("Good", 1, 0, 2, 2)
    assert got[1, 5] == ("late", 0, 0, 1, 1)
    assert got[1, 6] == ("answer", 5, 0, 2, 0)
    assert got[2, 0] == ("", None, 0, 0, 0) and got[None, 1] == ("x", None, None, 0, 0) and got[3, None] == ("y", None, None, 0, 0)
    assert got[4, 3] == ("", None, 3, 0, 0)
    assert chat.link_quotations(frame).count() == 9


def test_chat_parents_against_all_pairs(spark):
    """Generated threads with nested quotes and much repeated passages: parents, roots and depths as a plain search finds them."""
    rng, table = np.random.default_rng(12), []
    for conv in range(6):
        said = []
        for turn in range(0, 700, int(rng.integers(3, 9))):
            own = [" ".join(rng.choice(["ok", "thanks", "yes", "no", f"w{rng.integers(40)}"], 2)) for _ in range(int(rng.integers(1, 4)))]
            quotes = [f"> {line}" for k in rng.integers(0, len(said), int(rng.integers(0, 3))) for line in said[k]] if said else []
            quotes += [f"> {q}" for q in quotes[:1]]
            said.append(own)
            table.append((conv, turn, "user", "\n".join(quotes + own)))
    frame = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    known = chat.passages(chat.parse(frame.withColumn("mid", F.concat_ws("/", "conv_id", "turn")))).collect()
    own = {}
    for r in known:
        if r.level == 0:
            own.setdefault((r.conv_id, r.hash), set()).add(r.turn)
    votes, linked = {}, Counter()
    for r in known:
        earlier = [t for t in own.get((r.conv_id, r.hash), ()) if t < r.turn] if r.level else []
        if earlier:
            linked[r.conv_id, r.turn] += 1
            if r.level == 1:
                votes.setdefault((r.conv_id, r.turn), Counter())[max(earlier)] += r.chars
    parent = {}
    for conv, turn, *_ in table:
        before = [t for c, t, *_ in table if c == conv and t < turn]
        best = max(((n, t) for t, n in votes.get((conv, turn), {}).items()), default=(0, max(before, default=None)))
        parent[conv, turn] = best[1]
    for r in chat.link_quotations(frame).collect():
        depth, root = 0, r.turn
        while parent[r.conv_id, root] is not None:
            depth, root = depth + 1, parent[r.conv_id, root]
        assert (r.parent_turn, r.root_turn, r.depth, r.linked) == (parent[r.conv_id, r.turn], root, depth, linked[r.conv_id, r.turn])
    assert sum(linked.values()) > 200


def test_chat_keeps_unquoted_tables(spark, data):
    table = spark.read.parquet(f"{data}/conversations.parquet")
    out = chat.op6_chat(spark, data).orderBy("conv_id", "root_turn", "turn").collect()
    assert sorted((r.conv_id, r.turn, r.role, r.text) for r in out) == sorted((r.conv_id, r.turn, r.role, r.text.strip()) for r in table.distinct().collect())
    seen = set()
    for r in out:
        assert r.parent_turn is None or (r.conv_id, r.parent_turn) in seen
        seen.add((r.conv_id, r.turn))


def test_empty_tables(empty, spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert repeats.remove_repeats(empty).count() == 0
    assert ngrams.jaccard_components(empty).count() == 0
    assert packing.pack_documents(empty, path).count() == 0
    assert sharding.shard_documents(empty).count() == 0
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    assert lines.dedup_lines(empty).count() == 0
    assert chat.link_quotations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_sha_of_kept_words(spark, data):
    r = repeats.op1_repeats(spark, data).where("doc_id = 0").first()
    text = spark.read.parquet(f"{data}/documents.parquet").where("doc_id = 0").first().text
    assert r.kept_sha256 == hashlib.sha256(" ".join(WORD.findall(text)).encode()).hexdigest()


def test_edits():
    import random

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _next(row, i, x, b)
        return row[-1]

    def _next(row, i, x, b):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
        return out

    draw = random.Random(5)
    pairs = [tuple("".join(draw.choice("abé ") for _ in range(draw.randrange(14))) for _ in range(2)) for _ in range(400)]
    for n in (63, 64, 65, 128, 200, 1100):  # over the ends of words
        x = "".join(draw.choice("abcdef") for _ in range(n))
        pairs += [(x, x[:k] + draw.choice("xyz") + x[k + draw.randrange(3) :] + "q" * draw.randrange(5)) for k in range(0, n, 9 if n < 1000 else 200)]
    want = [plain(a, b) for a, b in pairs]
    assert [lines.edits(a, b, 500) for a, b in pairs] == want
    assert [lines.edits(a, b, 3) <= 3 for a, b in pairs] == [d <= 3 for d in want]


def test_lines_made_distinct_in_parts_are_the_same(spark, monkeypatch):
    rows = [(k, "\n".join(f"line {x} of a common text that is said here and there by {'abcdefgh'[(x * k) % 8]}" for x in range(k % 5, k % 5 + 4))) for k in range(40)] + [(None, "line"), (50, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(str, lines.dedup_lines(df).collect()))
    monkeypatch.setattr(lines, "SMALL", 0)
    assert sorted(map(str, lines.dedup_lines(df).collect())) == want


def test_lines_that_share_only_common_grams_still_meet(spark):
    """Every two of 3,000 lines of one gram that fit are candidates, whatever other keys they have."""
    rows = [((1 << 32) + 5, k, 1, 200 + (k % 3) * 100, k, True) for k in range(3000)]
    met = spark.createDataFrame(rows, "run long, name long, mark long, size long, side long, common boolean")
    got = lines.candidates_across(met, 0.9)
    assert got.count() == 3 * (1000 * 999 // 2) and got.where("a >= b or pmod(a, 3) <> pmod(b, 3)").count() == 0


def test_unlike_lines_of_a_common_passage_are_ruled_out_by_their_texts(spark):
    """Of 300 lines of a passage, other words before it, only the alike ones stay candidates; all of these do."""
    rng = np.random.default_rng(8)
    letters = np.array(list("etaoinshrdlucmfwypbgk"))
    said = lambda n: " ".join("".join(rng.choice(letters, rng.integers(2, 9))) for _ in range(n))
    passage = said(20)
    texts = [f"{said(40)} {passage}" for _ in range(300)]
    texts += [t[:90] + "x" + t[91:200] + "yz" + t[200:] for t in texts[:40]]
    rows = [((1 << 32) + 5, k, 1, len(t), k, True, t) for k, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "run long, name long, mark long, size long, side long, common boolean, text string")
    got = {(r.a, r.b) for r in lines.candidates_across(frame.drop("text"), 0.9, frame).collect()}
    assert got == {(k, 300 + k) for k in range(40)}


def test_lines_of_a_common_key_give_links_and_not_pairs():
    """All of 300 near copies meet in one key: fewer links than lines come out, and they connect the copies as all pairs would."""
    rng = np.random.default_rng(9)
    letters = np.array(list("etaoinshrdlucmfwypbgk"))
    first = [" ".join("".join(rng.choice(letters, rng.integers(2, 9))) for _ in range(40)) for _ in range(2)]
    texts = [first[k % 2][: k % 150] + "x" + first[k % 2][k % 150 + 1 :] for k in range(300)]
    sides = lines._Sides(np.arange(300))
    i, j = np.triu_indices(300, 1)
    links = lines._links(i, j, texts, sides, 0.9)
    assert len(links) == 298 and len(np.unique(sides.of)) == 2
    assert all(i[k] % 2 == j[k] % 2 for k in links)


def test_no_step_of_near_copies_has_all_their_pairs(spark, monkeypatch):
    """A group of 600 copies, most of them unlike, gives few rows of pairs, and the same result as if all pairs became rows."""
    rng = np.random.default_rng(12)
    letters = np.array(list("etaoinshrdlucmfwypbgk"))
    word = lambda: "".join(rng.choice(letters, rng.integers(2, 9)))
    line = [word() for _ in range(100)]
    copies = [" ".join(word() if rng.random() < 0.12 else w for w in line) for _ in range(600)]
    seen, of = [], lines.alike_of
    monkeypatch.setattr(lines, "alike_of", lambda ws, texts, pairs, similarity, name: seen.append(pairs.count()) or of(ws, texts, pairs, similarity, name))
    frame = spark.createDataFrame(list(enumerate(copies)), "doc_id long, text string")
    got = sorted((r.doc_id, r.removed_lines) for r in lines.dedup_lines(frame).collect())
    assert sum(seen) < 16 * 600
    # the same without common keys: all pairs become rows
    monkeypatch.setattr(lines, "COMMON", 1 << 30)
    assert got == sorted((r.doc_id, r.removed_lines) for r in lines.dedup_lines(frame).collect())
    assert sum(bool(gone) for _, gone in got) > 40


def test_pairs_compared_together_are_those_compared_one_by_one(monkeypatch):
    monkeypatch.setattr(lines, "FEW_TOGETHER", 1)
    rng = np.random.default_rng(10)
    for n in (0, 1, 9, 63, 200, 640, 1300):
        a, b = [], []
        for k in range(80):
            some = list("abcdé " if k % 5 else "ab漢字😀")
            a.append("".join(rng.choice(some, n + k % 4)))
            c = list(a[-1])
            for _ in range(int(rng.integers(0, 2 + n // 7))):
                at = int(rng.integers(len(c) + 1))
                c[at : at + 1] = [["x"], [], ["x", *c[at : at + 1]]][rng.integers(3)]
            b.append("".join([*c[n // 20 :], *rng.choice(some, n // 20)]) if k % 7 == 0 else "".join(c))
        a[::2], b[::2] = b[::2], a[::2]
        assert lines.alike_pairs(a, b, 0.9).tolist() == [lines.alike(x, y, 0.9) for x, y in zip(a, b, strict=True)]


def test_a_gram_that_a_line_repeats_counts_once(spark):
    """A line of one word over and over meets others once a key, so that its text is not sent many times."""
    texts = [(f"{k} " + "la " * 3000).strip() for k in range(3)]
    sims, chars = lines.signatures(pa.array(texts))
    sims = sims.view(np.int64)
    frame = spark.createDataFrame([(k, int(sims[k, 0]), int(sims[k, 1]), int(chars[k]), t) for k, t in enumerate(texts)], "name long, high long, low long, chars long, text string")
    met = lines.meetings(frame, 3, (0, 1), 0.9)
    assert met.groupBy("run", "name").count().where("count > 1").count() == 0


def test_unlike_long_lines_are_ruled_out_by_their_runs():
    rng = np.random.default_rng(7)
    parts = "the and is of to in that it as was for th er on an re he in ed nd ha at en es or nt ea ti st ing tion ble ly thou hash".split()
    prose = [" ".join("".join(rng.choice(parts, size=rng.integers(1, 4))) for _ in range(300)) for _ in range(24)]
    copies = []
    for t in prose:
        letters = list(t)
        for k in rng.choice(len(letters), size=len(letters) // 12, replace=False):
            letters[k] = "q"
        copies.append("".join(letters))
    short = ["abc", "abcd", "abxd", "an other short line", "an other short lime"]
    texts = prose + copies + short
    i, j = np.triu_indices(len(texts), 1)
    can = lines.TripleCounts(texts).can_be_alike(i, j, 0.9)
    alike = {(a, b) for a, b in zip(i.tolist(), j.tolist()) if lines.alike(texts[a], texts[b], 0.9)}
    assert alike == {(k, k + 24) for k in range(24)} | {(51, 52)}
    assert alike <= {(int(i[k]), int(j[k])) for k in can} and len(can) <= 2 * len(alike)


def test_lines_of_a_common_key_are_sent_only_to_lines_whose_lengths_can_fit(spark, monkeypatch):
    """2,000 lines of one key, of all lengths: each is sent to few blocks, and all pairs that fit are candidates still."""
    monkeypatch.setattr(lines, "BLOCK_LINES", 32)
    sizes = [100 + 3 * k for k in range(2000)]
    rows = [((1 << 32) + 5, k, 1, n, k, True) for k, n in enumerate(sizes)] + [((2 << 32) + 5, k, 1, 200, 7, True) for k in range(40)]
    met = spark.createDataFrame(rows, "run long, name long, mark long, size long, side long, common boolean")
    dealt = lines._dealt(met, 0.9, None, None)
    assert dealt.count() < 2000 * len(sizes) // 32 // 2 and dealt.where("run <> 4294967301").count() == 0
    n = np.array(sizes)
    i, j = np.triu_indices(len(n), 1)
    fit = np.abs(n[i] - n[j]) <= (np.maximum(n[i], n[j]) * (1 - 0.9) + 1e-9).astype(np.int64)
    got = lines.candidates_across(met, 0.9).collect()
    assert {(r.a, r.b) for r in got} == set(zip(i[fit].tolist(), j[fit].tolist())) and len(got) == fit.sum()
