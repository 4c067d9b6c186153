"""SimHash near-duplicates searched with Burkhard-Keller trees.

A tree's node has its children keyed by their Hamming distance to it; a search within radius r of a
query at distance d from a node follows only the edges d-r .. d+r, because of the triangle inequality.

Shards: two fingerprints that differ in at most r bits agree on one of r+1 disjoint blocks of bits. Each fingerprint
goes to r+1 shards, one a block and value, and each shard's tree answers the queries of that shard. A shard over
``shard_nodes`` fingerprints is split again by blocks of its remaining bits; this ends, for f free bits leave
at most 2**f different fingerprints. Sending all trees to all executors instead would mean gathering the
fingerprints of the whole corpus and searching every tree with every document; the blocks give the same links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import BROADCAST_IDS, discard, materialize, small_batches, with_row_key, without_rows
from quarry.llm.components import connected_components

BITS = 64


def fingerprint(text: str | None, shingle_words: int = 3, seed: int = 42, chunk: int = 1 << 16) -> int:
    """The SimHash of a whole text: words split at ASCII white space, A-Z lower-cased, shingles with repeats.

    A bit is 1 if set in over half of the shingles' hashes. Fewer words than a shingle make one shingle of
    all; null, empty and blank texts have fingerprint 0.
    """
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h64 = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle_words + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, chunk):  # memory is bounded by the chunk, not by the text
        part = words[at : min(n, at + chunk) + shingle_words - 1]
        lanes = [part[k:] for k in range(shingle_words)] if len(words) >= shingle_words else None
        grams = zip(*lanes, strict=False) if lanes else [tuple(words)]
        hashes = np.array([h64(b" ".join(g), seed) for g in grams], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    value = 0
    for bit in (2 * ones > n).tolist():
        value = value << 1 | bit
    return value


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def fingerprint_frames(shingle_words: int):
    """For mapInArrow over (id, text): (id, fp) with fp as a signed 64-bit integer."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [_signed(fingerprint(t.as_py(), shingle_words)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    return run


class BKTree:
    """A tree over unsigned integers by Hamming distance; add() puts in, within() finds."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        me, values, children = len(self.values), self.values, self.children
        if me:
            at = 0
            while True:
                d = (values[at] ^ value).bit_count()
                below = children[at].get(d)
                if below is None:
                    children[at][d] = me
                    break
                at = below
        values.append(value)
        children.append({})
        return me

    def within(self, value: int, radius: int) -> list[int]:
        """Indices of the nodes within the radius; only edges that can lead there are followed."""
        found, stack, values, children = [], [0] if self.values else [], self.values, self.children
        while stack:
            at = stack.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            for edge, below in children[at].items():
                if d - radius <= edge <= d + radius:
                    stack.append(below)
        return found


def spanning_links(values: list[int], radius: int, confirm=None) -> list[tuple[int, int]]:
    """Index pairs within the radius that span the classes of the values: every value is searched against the tree
    of those before it, and a pair that only closes a circle is left out. Given confirm(i, j), only pairs it holds for link."""
    tree, root, out = BKTree(), list(range(len(values))), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, v in enumerate(values):
        for j in tree.within(v, radius):
            a, b = find(i), find(j)
            if a != b and (confirm is None or confirm(j, i)):
                root[max(a, b)] = min(a, b)
                out.append((j, i))
        tree.add(v)
    return out


def shard_frames(radius: int):
    """For mapInArrow over (key, fp, rep) sorted by key: links (a, b) between reps, tree by tree."""
    import pyarrow as pa

    def links(keys, fps, reps):
        edges = np.flatnonzero(np.diff(keys)) + 1
        starts, ends = np.r_[0, edges], np.r_[edges, len(keys)]
        for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
            vals = fps[s:e].tolist()
            for i, j in spanning_links(vals, radius):
                yield int(reps[s + i]), int(reps[s + j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            cur = [b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy()]
            if rest is not None:
                cur = [np.concatenate(x) for x in zip(rest, cur, strict=True)]
            if not len(cur[0]):
                continue
            cut = int(np.searchsorted(cur[0], cur[0][-1]))  # the last shard may go on in the next batch
            rest = [x[cut:] for x in cur]
            if got := list(links(*[x[:cut] for x in cur])):
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64())], ["a", "b"])
        if rest is not None and len(rest[0]) and (got := list(links(*rest))):
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64())], ["a", "b"])

    return run


def _blocks(bits: list[int], parts: int) -> list[list[int]]:
    return [x.tolist() for x in np.array_split(np.array(bits), parts) if len(x)]


def _masked(fp, bits: list[int]):
    mask = 0
    for b in bits:
        mask |= 1 << b
    return fp.bitwiseAND(F.lit(_signed(mask)))


def route(nodes: DataFrame, radius: int, shard_nodes: int) -> DataFrame:
    """(key, fp, rep): every fingerprint under each of its shards; see the module's head for why none is missed.

    At a level, the bits fixed so far are part of the plan's path, so the key hashes path and masked value.
    """
    done, frontier = [], [((), list(range(BITS)), nodes)]
    for level in range(BITS):
        parts = [
            (path + (k,), [b for b in free if b not in block], F.struct(F.lit(",".join(map(str, path + (k,)))).alias("path"), F.xxhash64(F.lit(str(path + (k,))), *(["key"] if "key" in df.columns else []), _masked(F.col("fp"), block)).alias("key")), df)
            for path, free, df in frontier
            for k, block in enumerate(_blocks(free, radius + 1))
        ]
        by_source: dict[int, tuple] = {}
        for path, free, key, df in parts:
            by_source.setdefault(id(df), (df, []))[1].append((path, free, key))
        rows = None
        for df, keys in by_source.values():
            each = df.select(F.explode(F.array(*[k for _, _, k in keys])).alias("k"), "fp", "rep").select("k.path", "k.key", "fp", "rep")
            rows = each if rows is None else rows.unionByName(each)
        if 2 ** max(len(free) for _, free, _, _ in parts) <= shard_nodes or not any(free for _, free, _, _ in parts):  # no shard can be larger
            done.append(rows.select("key", "fp", "rep"))
            break
        rows = materialize(rows, f"shards{level}") if level else rows
        large = materialize(rows.groupBy("path", "key").count().where(F.col("count") > shard_nodes).select("path", "key"), "large")
        paths = [r[0] for r in large.select("path").distinct().collect()]  # at most (radius+1)**level of them
        if not paths:
            done.append(rows.select("key", "fp", "rep"))
            break
        done.append(rows.join(large, ["path", "key"], "left_anti").select("key", "fp", "rep"))
        hot = materialize(rows.join(large, ["path", "key"], "left_semi"), "hot")
        frees = {",".join(map(str, path)): (path, free) for path, free, _, _ in parts}
        frontier = [(*frees[p], hot.where(F.col("path") == p).select("key", "fp", "rep")) for p in paths]
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, radius: int = 2, shard_nodes: int = 4096) -> DataFrame:
    """One row per input row: (id, fp as signed integer, component).

    Rows are linked when their fingerprints differ in at most ``radius`` bits; component is the smallest id
    reachable over links, the row's own included. Texts without words all have fingerprint 0 and link like
    any others. Equal fingerprints meet before the search, so copies cost nothing. A null id gives a row
    with its own fingerprint and component null unless its class has an id. Empty tables give empty results; other columns
    are not read.
    """
    small_batches(df.sparkSession)
    rows = df.select(df[id_col].cast("long").alias("id"), df[text_col].cast("string").alias("text"))
    prints = materialize(rows.mapInArrow(fingerprint_frames(shingle_words), "id long, fp long"), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("id").alias("rep")).where("rep is not null"), "nodes")
    shards = route(nodes, radius, shard_nodes)
    links = shards.repartition("key").sortWithinPartitions("key").mapInArrow(shard_frames(radius), "a long, b long")
    groups = connected_components(links)
    # rows meet their fingerprint's class; the class table has one row a fingerprint, hot fingerprints are split by AQE
    classes = materialize(nodes.join(groups, nodes.rep == groups.node, "left").select(F.col("fp").alias("of"), F.coalesce("component", "rep").alias("component")), "classes")
    discard(nodes)
    return prints.join(classes, prints.fp.eqNullSafe(classes["of"]), "left").select(F.col("id").alias(id_col), "fp", "component")


# ------------------------------------------------------------------ near copies by similarity: a radius too wide for blocks

WIDE = 512
#: Two texts of similarity s agree on a band of MinHash values with probability s**ROWS, and at 0.8 on one of the bands with 0.999.
ROWS, BANDS = 6, 23
#: Shingles that one shard's rows may have in all: 8 bytes each in a Python worker.
SHARD_SHINGLES = 1 << 22


def radius_of(similarity: float, bits: int = WIDE, slack: float = 7) -> int:
    """The Hamming distance of texts of that Jaccard similarity of shingles: the angle of their sets as a share of all
    bits, plus ``slack`` standard deviations of the estimate. The widest need is sets of 4 and 5: a share of 0.1875."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * share + slack * math.sqrt(bits * share * (1 - share)))


def shingle_set(text: str | None, shingle_words: int = 5) -> np.ndarray:
    """The hashes of the different shingles in ascending order; fewer words than a shingle make one shingle of all."""
    import xxhash

    words = (text or "").encode().lower().split()
    h64, n = xxhash.xxh64_intdigest, max(1, len(words) - shingle_words + 1)
    grams = zip(*[words[k : k + n] for k in range(shingle_words)], strict=True) if len(words) >= shingle_words else [tuple(words)] if words else []
    return np.unique(np.fromiter((h64(b" ".join(g), 42) for g in grams), np.uint64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sets in ascending order; 1 if both are empty."""
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common / (len(both) - common) if len(both) else 1.0


def _majority(base: np.ndarray, bits: int, chunk: int = 1 << 14) -> bytes:
    """The SimHash of hashes: each is drawn out to ``bits`` bits by a mixing function; a bit is 1 if set in over half."""
    ones = np.zeros(bits, np.int64)
    for at in range(0, len(base), chunk):
        lanes = []
        for k in range(bits // 64):
            x = base[at : at + chunk] + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & 0xFFFFFFFFFFFFFFFF)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            lanes.append(x ^ (x >> np.uint64(31)))
        rows = np.stack(lanes, axis=1).view(np.uint8)
        ones += np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(base)).tobytes()


def band_keys(shingles: np.ndarray, chunk: int = 1024) -> list[int]:
    """A signed key a band of the set's MinHash values; none for the empty set."""
    import xxhash

    if not len(shingles):
        return []
    rng = np.random.default_rng(3)
    times, plus = (rng.integers(0, 1 << 32, size=(ROWS * BANDS, 1), dtype=np.uint32) for _ in range(2))
    times |= np.uint32(1)
    least, x = np.full(ROWS * BANDS, 0xFFFFFFFF, np.uint32), (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    for at in range(0, len(x), chunk):
        np.minimum(least, (x[at : at + chunk] * times + plus).min(axis=1), out=least)
    return [_signed(xxhash.xxh64_intdigest(band.tobytes(), k)) for k, band in enumerate(least.reshape(BANDS, ROWS))]


def _node(shingles: np.ndarray) -> int:
    import xxhash

    return _signed(xxhash.xxh3_64_intdigest(shingles.tobytes(), 5))


def band_frames(shingle_words: int):
    """For mapInArrow over (id, row, text): (id, row, node, size, bands); node stands for the set of shingles."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, sizes, bands = [], [], []
            for t in b.column(2):
                got = shingle_set(t.as_py(), shingle_words)
                nodes.append(_node(got))
                sizes.append(len(got))
                bands.append(band_keys(got))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["id", "row", "node", "size", "bands"])

    return run


def content_frames(shingle_words: int):
    """For mapInArrow over (text): (node, fp, shingles), fp the SimHash of the set."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), shingle_words) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([_node(x) for x in sets], pa.int64()), pa.array([_majority(x, WIDE) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "fp", "shingles"])

    return run


def members_of_bands(nodes: DataFrame) -> DataFrame:
    """(key, node, n, weight): the nodes under each band key that several have, with the key's nodes and shingles in all. Of keys
    with the same nodes one is enough."""
    banded = nodes.select("node", "size", F.explode("bands").alias("key"))
    keys = banded.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("weight"), F.min("node").alias("lo"), F.max("node").alias("hi"), *[F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"x{k}") for k in (1, 2)])
    one = keys.where("n > 1").groupBy("n", "weight", "lo", "hi", "x1", "x2").agg(F.min("key").alias("key"))
    return banded.join(one.select("key", "n", "weight"), "key").select("key", "node", "n", "weight")


def confirmed_frames(radius: int, similarity: float):
    """For mapInArrow over (key, node, fp, shingles) sorted by key: links (a, b), one tree a key. The tree finds candidates; a link is
    what has the similarity in truth."""
    import pyarrow as pa

    def links(nodes: list[int], fps: list[bytes], sets: list[np.ndarray]):
        def confirm(i: int, j: int) -> bool:
            a, b = sets[i], sets[j]
            return min(len(a), len(b)) >= similarity * max(len(a), len(b)) - 1e-6 and jaccard(a, b) >= similarity

        got = [(nodes[i], nodes[j]) for i, j in spanning_links([int.from_bytes(f, "big") for f in fps], radius, confirm)]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, fps, sets = None, [], [], []
        for b in batches:
            for k, node, fp, shingles in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != key:
                    if len(fps) > 1:
                        yield links(nodes, fps, sets)
                    key, nodes, fps, sets = k, [], [], []
                nodes.append(node)
                fps.append(fp)
                sets.append(np.frombuffer(shingles, np.uint64))
        if len(fps) > 1:
            yield links(nodes, fps, sets)

    return run


def tiles(large: DataFrame, groups: DataFrame) -> DataFrame:
    """(key, node): shards in which every two nodes of a large key meet that are not in one class yet.

    large is (key, node, n, weight, parts). The nodes outside of the key's largest class are dealt to blocks, and each block
    meets each block of all of the key's nodes. A key whose nodes are all in one class needs none.
    """
    told = large.join(groups, "node", "left").select("key", "node", "parts", F.coalesce("component", "node").alias("label"))
    told = materialize(told, "labelled")
    sizes = told.groupBy("key", "label").count()
    most = sizes.groupBy("key").agg(F.max(F.struct("count", "label")).alias("top"), F.sum("count").alias("n")).where("top.count < n")
    blocks = F.ceil(2 * F.col("parts") * (F.col("n") - F.col("top.count")) / F.col("n")).cast("int")
    todo = told.join(most.select("key", F.col("top.label").alias("main"), "n", "top"), "key").withColumn("alls", (2 * F.col("parts")).cast("int")).withColumn("rests", blocks)
    block = lambda k: F.pmod(F.xxhash64("node", F.lit(11)), F.col(k)).cast("int")
    every = todo.select("key", "node", F.explode(F.sequence(F.lit(0), F.col("rests") - 1)).alias("i"), block("alls").alias("j"))
    rest = todo.where("label != main").select("key", "node", block("rests").alias("i"), F.explode(F.sequence(F.lit(0), F.col("alls") - 1)).alias("j"))
    return every.unionByName(rest).distinct().select(F.xxhash64("key", "i", "j").alias("key"), "node")


def similar_links(members: DataFrame, contents: DataFrame, similarity: float, shard_nodes: int, shard_shingles: int) -> DataFrame:
    """(a, b): links that span the classes of nodes which share a key and have the similarity.

    A key over ``shard_nodes`` nodes is first searched in random blocks, other blocks for other keys. Whatever two of its
    nodes are then in different classes still meet (tiles), so that no pair goes without comparison, and many copies of
    one text are joined by few.
    """
    parts = F.ceil(F.greatest(F.col("n") / shard_nodes, F.col("weight") / shard_shingles))
    members = members.withColumn("parts", parts)

    def search(shards: DataFrame, name: str) -> DataFrame:
        full = shards.join(contents, "node").select("key", "node", "fp", "shingles")
        return materialize(full.repartition("key").sortWithinPartitions("key").mapInArrow(confirmed_frames(radius_of(similarity), similarity), "a long, b long"), name)

    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("node", "key"), F.col("parts"))).otherwise(F.lit(0).cast("long"))
    links = search(members.select(F.xxhash64("key", part).alias("key"), "node"), "near-links")
    large = members.where("parts > 1")
    if large.isEmpty():
        return links
    return links.unionByName(search(tiles(large, connected_components(links)), "tile-links"))


def _near_classes(df: DataFrame, key: str, id_col: str, text_col: str, shingle_words: int, similarity: float, shard_nodes: int, shard_shingles: int) -> DataFrame:
    """(id, row, best) of every row; best is the (no_id, id, row) of the row of its class that stays."""
    small_batches(df.sparkSession)
    rows = df.select(df[id_col].cast("long").alias("id"), df[key].alias("row"), df[text_col].cast("string").alias("text"))
    prints = rows.mapInArrow(band_frames(shingle_words), "id long, row struct<file:long,at:long>, node long, size long, bands array<long>")
    prints = materialize(prints, "fingerprints")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("rep")
    nodes = materialize(prints.groupBy("node").agg(first, F.first("size").alias("size"), F.first("bands").alias("bands")), "nodes")
    members = materialize(members_of_bands(nodes), "members")
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select(F.col("rep.row.file").alias("_file"), F.col("rep.row.at").alias("_at"))
    wanted = materialize(wanted, "wanted")  # one row a set of shingles that shares a band
    few = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    texts = rows.join(F.broadcast(wanted) if few else wanted, (rows["row.file"] == wanted["_file"]) & (rows["row.at"] == wanted["_at"]), "left_semi").select("text")
    contents = materialize(texts.mapInArrow(content_frames(shingle_words), "node long, fp binary, shingles binary"), "contents")
    groups = connected_components(similar_links(members, contents, similarity, shard_nodes, shard_shingles))
    discard(members, contents, wanted)
    labels = materialize(nodes.join(groups, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("label")), "labels")
    least = labels.groupBy("label").agg(F.min("rep").alias("best"))
    classes = materialize(labels.join(least, "label").select(F.col("node").alias("of"), "best"), "classes")
    discard(nodes, labels)
    return prints.join(classes, prints.node == classes["of"]).select("id", "row", "best")


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: float = 0.8, shard_nodes: int = 1024, shard_shingles: int = SHARD_SHINGLES) -> DataFrame:
    """One row per input row: (id, component): classes of texts linked by a Jaccard similarity of their sets of shingles of at least
    ``similarity``; component is the smallest id of the class, null where none of its rows has an id.

    Candidates share a band of MinHash values of the shingles (0.999 of the pairs at 0.8, more of closer ones, however the words
    were edited) and are near in the tree of their 512-bit SimHashes; each link is confirmed by the sets themselves.
    Texts without words are one class; equal sets are equal before any search. Empty tables give empty results, other
    columns are not read. shard_nodes and shard_shingles bound what a task holds and change no result.
    """
    keyed, key = with_row_key(df)
    out = _near_classes(keyed, key, id_col, text_col, shingle_words, similarity, shard_nodes, shard_shingles)
    return out.select(F.col("id").alias(id_col), F.col("best.id").alias("component"))


def drop_near(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: float = 0.8, shard_nodes: int = 1024, shard_shingles: int = SHARD_SHINGLES) -> DataFrame:
    """The one row of each class (similar_groups) that stays, all its columns as they were: the one with the smallest id (none
    sorts last), and of rows that repeat that id the first of the table."""
    keyed, key = with_row_key(df)
    out = _near_classes(keyed, key, id_col, text_col, shingle_words, similarity, shard_nodes, shard_shingles)
    return without_rows(keyed, out.where(F.col("row") != F.col("best.row")).select("row"), key)
