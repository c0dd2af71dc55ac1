"""Exact Jaccard self-join of word n-gram sets through a forest of signature trees.

1. Each text becomes a set of hashed shingles; texts with equal sets become one entity.
2. The root of the forest holds the whole corpus, its token map spread over ranges of tokens. It
   tells which tokens occur in at least two entities. An entity with fewer of those than the
   threshold needs can overlap no other entity enough, so it leaves here.
3. What is left is routed down: of entities that are similar enough, the rarest tokens (as many as
   an overlap must touch) share one token. All entities that share a token go to the subtree of the
   smallest of them; a large subtree is cut into blocks, and each two blocks are a task.
4. Each task builds a signature tree: nodes hold the OR of their entities' token bitmaps and the
   range of their sizes. Two trees (or one with itself) are traversed together; a pair of nodes is
   pruned when the sizes rule a link out, when the greatest possible overlap - common bits, plus the
   tokens that share bits - is too small, or when all its entities are linked already. Pairs of
   entities that remain are compared exactly.
5. Links become classes by connected components.

Tokens that are very frequent in a bounded sample of documents are kept out of the ranges and count
as occurring everywhere. That only balances the work: the result is the same without it.

Defined cases: a null text, and one without words, has an empty set and is linked with nothing;
fewer than n words are one shingle; a null doc_id never names a class (component_id is null if no
other text of the class has an id); rows that repeat a doc_id are rows of their own; an empty table
gives an empty result; other columns are not read. Sets are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lowered, mix64, need, slices, span_hashes, stash, text_buffer, words_of
from .components import connected_components

#: Tokens that a range holds on average, and that a map task gathers before it sends them on.
RANGE_TOKENS, FLUSH_TOKENS = 1_500_000, 1_000_000
#: Ranges at most: with 100 TB of text each then holds about 16 million tokens.
RANGES_MOST = 1 << 20
#: Documents sampled to find very frequent tokens, the share of them that makes a token so, and how many at most.
HOT_SAMPLE, HOT_SHARE, HOT_MOST = 4000, 0.004, 16_384
#: Entities in a task beyond which its subtree is cut into blocks of half that size.
SUBTREE = 512
BITS, FAN = 2048, 8
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D, 0x27D4EB2F165667C5)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles, sorted by both."""
    starts, ends, rows = words_of(data, offsets)
    words = span_hashes(lowered(data), starts, ends)
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    first = np.cumsum(counts) - counts
    place = np.arange(len(words)) - first[rows]
    found_rows, found = [], []
    weights = [_ODD[i % len(_ODD)] * np.uint64(2 * (i // len(_ODD)) + 1) for i in range(n)]
    for m in range(1, n + 1):
        # Rows of exactly m < n words give one shingle of them all; longer rows one at each place.
        at = np.flatnonzero((place == 0) & (counts[rows] == m)) if m < n else np.flatnonzero(place + n <= counts[rows])
        if len(at):
            total = np.full(len(at), np.uint64(m))
            for i in range(m):
                total += words[at + i] * weights[i]
            found_rows.append(rows[at])
            found.append(mix64(total))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    rows, found = np.concatenate(found_rows), np.concatenate(found)
    order = np.lexsort((found, rows))
    rows, found = rows[order], found[order]
    new = np.concatenate([[True], (rows[1:] != rows[:-1]) | (found[1:] != found[:-1])])
    return rows[new], found[new]


def entities(rows: np.ndarray, hashes: np.ndarray, many: int, clashing: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set size, digest of the set, second digest) of each row; the second one stands for digests in ``clashing``."""
    sizes = np.bincount(rows, minlength=many)
    digests = np.zeros((2, many), np.uint64)
    filled = np.flatnonzero(sizes)
    if len(filled):
        first = (np.cumsum(sizes) - sizes)[filled]
        for k, odd in enumerate((_ODD[0:3], _ODD[3:6])):
            sums, xors = np.add.reduceat(mix64(hashes + odd[0]), first), np.bitwise_xor.reduceat(mix64(hashes ^ odd[1]), first)
            digests[k, filled] = mix64(sums + mix64(xors) * odd[2] + sizes[filled].astype(np.uint64))
    digest, second = digests.view(np.int64)
    return sizes, np.where(np.isin(digest, clashing), second, digest) if len(clashing) else digest, second


def planes(x: np.ndarray) -> bytes:
    """The bytes of sorted integers by significance: what is alike lies together for the codec."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def from_planes(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel() if raw else np.zeros(0, kind)


def range_numbers(tokens: np.ndarray, ranges: int) -> np.ndarray:
    return ((tokens >> np.uint64(40)) * np.uint64(ranges) >> np.uint64(24)).astype(np.int64)


def frequent_tokens(texts: DataFrame, n: int, rows: int) -> np.ndarray:
    """Tokens in many documents of a sample of about HOT_SAMPLE; at most HOT_MOST."""
    # By row, so that null or repeated ids leave it a sample; of a lost task another sample does as well.
    chance = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id(), F.lit("hot")), F.lit(1 << 30))
    sample = texts.where(chance < int((1 << 30) * min(1.0, HOT_SAMPLE / max(1, rows))))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                _, hashes = shingle_sets(*text_buffer(part.column("text")), n)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], ["token"])

    least = max(8, int(HOT_SHARE * min(rows, HOT_SAMPLE)))
    found = sample.select("text").mapInArrow(run, "token long").groupBy("token").count().where(F.col("count") >= least)
    rows = found.orderBy(F.desc("count"), "token").limit(HOT_MOST).collect()
    return np.sort(np.array([r.token for r in rows], np.int64).view(np.uint64))


def sets_of(texts: DataFrame, n: int, hot: np.ndarray) -> DataFrame:
    """doc_id, n_shingles, entity (null: empty set), its second digest and the very frequent tokens of each row."""
    none = np.zeros(0, np.int64)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                rows, hashes = shingle_sets(*text_buffer(part.column("text")), n)
                sizes, digest, second = entities(rows, hashes, part.num_rows, none)
                held = np.isin(hashes, hot)
                lists = np.concatenate([[0], np.cumsum(np.bincount(rows[held], minlength=part.num_rows))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes.astype(np.int64)), pa.array(digest, mask=sizes == 0), pa.array(second), pa.ListArray.from_arrays(pa.array(lists), pa.array(hashes[held].view(np.int64)))],
                    ["doc_id", "n_shingles", "entity", "second", "hot"],
                )

    return texts.mapInArrow(run, "doc_id long, n_shingles long, entity long, second long, hot array<long>")


def spread_tokens(texts: DataFrame, n: int, hot: np.ndarray, clashing: np.ndarray, ranges: int) -> DataFrame:
    """Tokens with their entities, packed by task and range; an entity comes once from each task."""
    names = ["range", "tokens", "places", "entities"]

    def packed(tokens: list[np.ndarray], owners: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        token, owner = np.concatenate(tokens), np.concatenate(owners)
        order = np.argsort(token)
        token, owner = token[order], owner[order]
        numbers = range_numbers(token, ranges)
        edges = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1], [True]])) if len(token) else np.zeros(1, int)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            own, place = np.unique(owner[a:b], return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array([int(numbers[a])], pa.int32()), pa.array([planes(token[a:b])], pa.binary()), pa.array([planes(place.astype(np.uint32))], pa.binary()), pa.array([own.tobytes()], pa.binary())], names)

    def run(batches):
        seen: set[int] = set()
        tokens, owners, many = [], [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                rows, hashes = shingle_sets(*text_buffer(part.column("text")), n)
                sizes, digest, _ = entities(rows, hashes, part.num_rows, clashing)
                fresh = np.zeros(part.num_rows, bool)
                for i, e in enumerate(digest.tolist()):
                    if sizes[i] and e not in seen:
                        seen.add(e)
                        fresh[i] = True
                kept = fresh[rows] & ~np.isin(hashes, hot)
                tokens.append(hashes[kept])
                owners.append(digest[rows[kept]])
                many += len(tokens[-1])
                if many >= FLUSH_TOKENS:
                    yield from packed(tokens, owners)
                    tokens, owners, many = [], [], 0
        if many:
            yield from packed(tokens, owners)

    return texts.select("text").mapInArrow(run, "range int, tokens binary, places binary, entities binary")


def shared_tokens(spread: DataFrame, buckets: int) -> DataFrame:
    """Tokens that at least two entities have, packed by bucket of the entity."""

    def run(table: pa.Table) -> pa.Table:
        parts = list(zip(table.column("tokens").to_pylist(), table.column("places").to_pylist(), table.column("entities").to_pylist()))
        token = np.concatenate([from_planes(t, np.uint64) for t, _, _ in parts])
        owner = np.concatenate([np.frombuffer(e, np.int64)[from_planes(p, np.uint32)] for _, p, e in parts])
        order = np.lexsort((owner, token))
        token, owner = token[order], owner[order]
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])])
        token, owner = token[new], owner[new]
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        count = np.diff(np.append(first, len(token)))
        times = np.repeat(count, count)
        token, owner, times = token[times > 1], owner[times > 1], times[times > 1].astype(np.uint32)
        bucket = owner % buckets
        order = np.lexsort((token, bucket))
        token, owner, times, bucket = token[order], owner[order], times[order], bucket[order]
        edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(token) else np.zeros(1, int)
        spans = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
        return pa.table(
            {
                "bucket": pa.array([int(bucket[a]) for a, _ in spans], pa.int32()),
                "tokens": pa.array([planes(token[a:b]) for a, b in spans], pa.binary()),
                "owners": pa.array([owner[a:b].tobytes() for a, b in spans], pa.binary()),
                "times": pa.array([planes(times[a:b]) for a, b in spans], pa.binary()),
            }
        )

    return spread.groupBy("range").applyInArrow(run, "bucket int, tokens binary, owners binary, times binary")


def survivors(shared: DataFrame, classes: DataFrame, buckets: int) -> DataFrame:
    """Entities with enough shared tokens: entity, size, tokens (rarest first), probes, index.

    ``probes`` and ``index``: so many of the tokens must be tried as the larger and as the smaller of a pair.
    """
    right = classes.select(F.pmod("entity", F.lit(buckets)).cast("int").alias("bucket"), "entity", "n_shingles", "hot")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        token = [from_planes(t, np.uint64) for t in left.column("tokens").to_pylist()]
        owner = [np.frombuffer(o, np.int64) for o in left.column("owners").to_pylist()]
        times = [from_planes(t, np.uint32) for t in left.column("times").to_pylist()]
        entity, size = right.column("entity").to_numpy(), right.column("n_shingles").to_numpy()
        lists = right.column("hot").combine_chunks() if right.num_rows else None
        if lists is not None and len(lists):
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            counts = np.diff(np.asarray(lists.offsets))
            hot = np.asarray(lists.flatten()).astype(np.int64).view(np.uint64)
            token.append(hot)
            owner.append(np.repeat(entity, counts))
            times.append(np.full(len(hot), 0xFFFFFFFF, np.uint32))
        token, owner, times = (np.concatenate(x) if x else np.zeros(0, k) for x, k in ((token, np.uint64), (owner, np.int64), (times, np.uint32)))
        by = np.argsort(entity)
        entity, size = entity[by], size[by]
        at = np.searchsorted(entity, owner)
        have = np.bincount(at, minlength=len(entity))
        least = (4 * size + 4) // 5
        good = have >= least
        order = np.lexsort((token, times, at))
        order = order[good[at[order]]]
        entity, size, have, least = entity[good], size[good], have[good], least[good]
        alone = size - have
        offsets = np.concatenate([[0], np.cumsum(have)]).astype(np.int32)
        return pa.table(
            {
                "entity": pa.array(entity, pa.int64()),
                "size": pa.array(size.astype(np.int32)),
                "tokens": pa.ListArray.from_arrays(pa.array(offsets), pa.array(token[order].view(np.int64))),
                "probes": pa.array((size - least + 1 - alone).astype(np.int32)),
                "index": pa.array(np.maximum(0, size - (8 * size + 8) // 9 + 1 - alone).astype(np.int32)),
            }
        )

    return shared.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInArrow(run, "entity long, size int, tokens array<long>, probes int, index int")


class SignatureTree:
    """Levels from single entities up to one root; each node has the OR of its bitmaps and a size range."""

    def __init__(self, sizes: np.ndarray, bitmaps: np.ndarray, slack: np.ndarray):
        self.order = np.lexsort((bitmaps[:, 0], sizes))
        self.levels = [(bitmaps[self.order], sizes[self.order], sizes[self.order], slack[self.order])]
        while len(self.levels[-1][1]) > 1:
            bits, low, high, loose = self.levels[-1]
            first = np.arange(0, len(low), FAN)
            self.levels.append((np.bitwise_or.reduceat(bits, first), np.minimum.reduceat(low, first), np.maximum.reduceat(high, first), np.maximum.reduceat(loose, first)))


def bitmaps_of(tokens: np.ndarray, owner: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """(bitmaps, tokens beyond the first of their bit) of each entity."""
    bit = (tokens.view(np.uint64) >> np.uint64(20)) % np.uint64(BITS)
    keys = np.unique(owner.astype(np.int64) * BITS + bit.astype(np.int64))
    maps = np.zeros((many, BITS // 64), np.uint64)
    np.bitwise_or.at(maps, (keys // BITS, keys % BITS // 64), np.uint64(1) << (keys % 64).astype(np.uint64))
    return maps, np.bincount(owner, minlength=many) - np.bincount(keys // BITS, minlength=many)


def dual_traversal(a: SignatureTree, b: SignatureTree, same: bool, alike) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of entities (numbers in the trees' orders) that can't be ruled out, part by part.

    ``alike(level a, level b, i, j)``: whether all entities of both nodes are linked already.
    """
    stack = [(len(a.levels) - 1, len(b.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        la, lb, i, j = stack.pop()
        bits_a, low_a, high_a, slack_a = a.levels[la]
        bits_b, low_b, high_b, slack_b = b.levels[lb]
        # A link needs sizes within a factor of 0.8, and an overlap of 4/9 of the summed sizes.
        kept = (5 * high_a[i] >= 4 * low_b[j]) & (5 * high_b[j] >= 4 * low_a[i])
        i, j = i[kept], j[kept]
        common = np.bitwise_count(bits_a[i] & bits_b[j]).sum(1, dtype=np.int64) + np.minimum(slack_a[i], slack_b[j])
        kept = 9 * common >= 4 * (low_a[i] + low_b[j])
        kept[kept] &= ~alike(la, lb, i[kept], j[kept])
        i, j = i[kept], j[kept]
        if not len(i):
            continue
        if la == 0 and lb == 0:
            if same:
                i, j = i[i < j], j[i < j]
            yield i, j
            continue
        for k in range(0, len(i), 4096):
            x, y, na, nb = i[k : k + 4096], j[k : k + 4096], la, lb
            if la >= lb:
                x, y, na = np.repeat(x, FAN) * FAN + np.tile(np.arange(FAN), len(x)), np.repeat(y, FAN), la - 1
            if lb >= la:
                y, x, nb = np.repeat(y, FAN) * FAN + np.tile(np.arange(FAN), len(y)), np.repeat(x, FAN), lb - 1
            inside = (x < len(a.levels[na][1])) & (y < len(b.levels[nb][1]))
            if same:
                inside &= x <= y
            stack.append((na, nb, x[inside], y[inside]))


def linked(sizes: np.ndarray, tokens: np.ndarray, offsets: np.ndarray, side: np.ndarray | None) -> np.ndarray:
    """The smallest number in each entity's class, from exact comparisons of what the trees leave.

    ``side``: 0 or 1, then only pairs across are looked for; None: all pairs.
    """
    many = len(sizes)
    label = np.arange(many)
    _, local = np.unique(tokens, return_inverse=True)
    owner = np.repeat(np.arange(many), np.diff(offsets))
    maps, slack = bitmaps_of(tokens, owner, many)
    own = [np.flatnonzero(side == s) for s in (0, 1)] if side is not None else [np.arange(many)] * 2
    if not len(own[0]) or not len(own[1]):
        return label
    trees = [SignatureTree(sizes[o], maps[o], slack[o]) for o in (own if side is not None else own[:1])]
    trees = trees * (2 // len(trees))
    order = [o[t.order] for o, t in zip(own, trees)]
    mark = np.zeros(int(local.max()) + 1 if len(local) else 1, np.int64)

    def compare(x: int, ys: np.ndarray) -> None:
        nonlocal label
        ys = ys[label[ys] != label[x]]
        if not len(ys):
            return
        mine = local[offsets[x] : offsets[x + 1]]
        mark[mine] = 1
        counts = offsets[ys + 1] - offsets[ys]
        ends = np.cumsum(counts)
        flat = np.arange(ends[-1]) + np.repeat(offsets[ys] - (ends - counts), counts)
        overlap = np.add.reduceat(mark[local[flat]], ends - counts)
        mark[mine] = 0
        hit = ys[9 * overlap >= 4 * (sizes[x] + sizes[ys])]
        if len(hit):
            joined = np.unique(np.append(label[hit], label[x]))
            label = np.where(np.isin(label, joined), joined[0], label)

    # The first entity against all others: in a group of near copies that links nearly all.
    first = order[0][len(order[0]) // 2]
    compare(int(first), order[1])

    def alike(la: int, lb: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        spans = []
        for level, nodes, o in ((la, i, order[0]), (lb, j, order[1])):
            width = FAN**level
            edges = np.arange(0, len(o), width)
            names = label[o]
            spans.append((np.minimum.reduceat(names, edges)[nodes], np.maximum.reduceat(names, edges)[nodes]))
        (a, b), (c, d) = spans
        return (a == b) & (c == d) & (a == c)

    for i, j in dual_traversal(trees[0], trees[1], side is None, alike):
        by = np.argsort(i, kind="stable")
        i, j = i[by], j[by]
        for part in np.split(np.arange(len(i)), np.flatnonzero(np.diff(i)) + 1):
            if len(part):
                compare(int(order[0][i[part[0]]]), order[1][j[part]])
    return label


def subtree_links(cells: DataFrame) -> DataFrame:
    """a, b: each entity of a class that a task finds, linked with the class's first."""

    def run(table: pa.Table) -> pa.Table:
        entity, size = table.column("entity").to_numpy(), table.column("size").to_numpy().astype(np.int64)
        lists = pa.concat_arrays(table.column("tokens").chunks) if table.num_rows else None
        offsets = np.asarray(lists.offsets, np.int64) - lists.offsets[0].as_py()
        side = None
        if table.column("i")[0].as_py() != table.column("j")[0].as_py():
            side = (table.column("block").to_numpy() == table.column("j")[0].as_py()).astype(int)
        label = linked(size, np.asarray(lists.flatten(), np.int64), offsets, side)
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": pa.array(entity[moved], pa.int64()), "b": pa.array(entity[label[moved]], pa.int64())})

    return cells.groupBy("hub", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, n: int = 5) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row; similarity 0.8 or more."""
    need(docs, "doc_id", "text")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hot = frequent_tokens(texts, n, texts.count())
    sets = stash(sets_of(texts, n, hot), "sets")
    filled = sets.where("entity IS NOT NULL")
    # Two digests and the size tell sets apart. Few digests of 64 bits clash even in 10^11 sets; those sets go by their second one.
    clashing = filled.groupBy("entity").agg(*(f(c).alias(f"{f.__name__}_{c}") for c in ("second", "n_shingles") for f in (F.min, F.max))).where("min_second <> max_second OR min_n_shingles <> max_n_shingles")
    clashing = np.array([r.entity for r in clashing.select("entity").collect()], np.int64)
    if len(clashing):
        filled = filled.withColumn("entity", F.when(F.col("entity").isin(clashing.tolist()), F.col("second")).otherwise(F.col("entity")))
    classes = stash(filled.groupBy("entity").agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n_shingles"), F.first("hot").alias("hot")), "classes")
    total = classes.agg(F.sum("n_shingles")).first()[0] or 0
    ranges = int(min(RANGES_MOST, max(16, total // RANGE_TOKENS)))
    shared = shared_tokens(spread_tokens(texts, n, hot, clashing, ranges), ranges)
    left = stash(survivors(shared, classes, ranges), "survivors")
    postings = left.select("entity", "index", F.posexplode(F.slice("tokens", F.lit(1), F.col("probes"))).alias("place", "token"))
    groups = postings.groupBy("token").agg(F.min("entity").alias("hub"), F.count("*").alias("members"), F.max(F.col("place") < F.col("index")).alias("indexed")).where("members > 1 AND indexed")
    members = stash(postings.join(groups, "token").select("hub", "entity").distinct(), "members")
    sizes = members.groupBy("hub").agg(F.count("*").alias("members")).where("members > 1")
    blocks = F.when(F.col("members") <= SUBTREE, 1).otherwise(F.ceil(F.col("members") / (SUBTREE // 2))).cast("int")
    cells = (
        members.join(sizes, "hub")
        .withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("entity"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("hub", "entity", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    )
    links = stash(subtree_links(cells.join(left.select("entity", "size", "tokens"), "entity")), "subtree-links")
    named = classes.select("entity", "first_id")
    # Classes are of entities, not of ids: ids may be null or stand at several texts.
    roots = connected_components(links).join(named, F.col("id") == F.col("entity")).select("entity", "root", "first_id")
    least = roots.groupBy("root").agg(F.min("first_id").alias("least_id"))
    joined = roots.join(least, "root").select("entity", "least_id")
    # Written out, the join with the documents is of two plain shuffles, so a hot entity's side is split at run time.
    of_class = stash(named.join(joined, "entity", "left").select("entity", F.coalesce("least_id", "first_id").alias("component_id")), "of-class")
    empty = sets.where("entity IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return filled.join(of_class, "entity").select("doc_id", "n_shingles", "component_id").unionByName(empty)
