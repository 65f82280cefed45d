"""Exact Jaccard join of word n-gram sets by signature trees.

1. One pass makes each document's set of 5-word shingles (64-bit hashes), a key of the set, and counts of
   shingles in a fixed number of slots. Documents of equal sets are one class from here on.
2. Prefix filter: with shingles in one global order (rare slots first), two sets of Jaccard >= t share one of
   the first n - ceil(t n) + 1 shingles of each, and that lies among the first n - ceil(2t / (1 + t) n) + 1 of the
   shorter one. These postings are shuffled in packed form; shingles of one class alone go, so do classes without a
   partner of fitting size, and what meets no early posting. Groups with the same members become one.
3. In ROUNDS rounds every class is compared with one class of each of its posting groups, drawn anew, and the
   links found are contracted into components, so a group of thousands of near copies costs a few comparisons a
   member. Before sets are sent anywhere a pair must share enough prefix shingles: two sets that link share at
   least `shared_least` of them (most pairs that merely hold one passage in common do not).
4. What is left, groups that still hold several components, goes through signature trees: nodes hold
   OR-combined token bitmaps and size ranges, two trees are walked together, and a pair of nodes is pruned if
   the largest overlap that bitmaps and sizes allow is too small, or all below is linked already. A first walk
   over prefix shingles joins the members that are possible partners into families, over all groups. Only whole
   sets of families are sent to a second walk, once for each class however many groups it stands in; leaves
   that meet there are compared exactly and only links leave the task. Of groups with the same members one is
   walked. Groups and families beyond BLOCK members are split into blocks, and every pair of blocks is a task of
   its own.
5. Links of both kinds make the components.

Nothing is capped: a shingle, group or component may hold any share of the rows.
Edge cases: null or empty texts, and texts without words, have empty sets, link with nothing, and are
components of their own; a text of fewer than five words is one shingle; repeated rows and equal texts are
linked; a null doc_id is left out of links; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnworks.llm.bytetext import mix, shingle_sets, slices, texts_of
from cairnworks.llm.common import digest_key, free_names, materialise, pieces, read
from cairnworks.llm.components import components

WIDTH = 5
PERCENT = 75
SLOT_BITS, CHUNK = 18, 4096
#: Postings of a slot beyond this many are spread over several buckets.
HEAVY, SALT_BITS = 1_000_000, 16
#: A task sends its postings whenever it holds so many.
HOLD = 500_000
BLOCK = 2048
ROUNDS = 2
#: Bits of a token bitmap for each shingle, at least.
BITMAP_BITS = 16
FANOUT = 8
#: Partners of one class that are compared with it in one place.
PLACE = 2000
#: At most so many rows, and places that they go to, are broadcast (40 bytes each at most); more are joined by shuffle.
BROADCAST_ROWS = 250_000
#: Shingles of the whole sets of a block, about: 8 bytes each in a task.
BLOCK_SHINGLES = 4_000_000


def _key(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _slot(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def document_sets(documents: DataFrame) -> DataFrame:
    """A row for each document (doc_id, n, key), and rows (chunk, counts) with slot counts of distinct sets."""

    digests = digest_key(documents.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "key", "chunk", "counts"]
        counts, seen = np.zeros(1 << SLOT_BITS, np.int64), set()
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(*texts_of(part.column("text")), WIDTH, digests)
                keys = [_key(s) for s in sets]
                new = []
                for key, s in zip(keys, sets, strict=True):
                    if key not in seen:
                        seen.add(key)
                        new.append(_slot(s))
                counts += np.bincount(np.concatenate(new), minlength=len(counts)) if new else 0
                n = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), n, pa.array(keys, pa.int64()), pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())], names)
        blobs = [counts[i : i + CHUNK].astype("<u4").tobytes() for i in range(0, len(counts), CHUNK)]
        none = pa.nulls(len(blobs), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.array(range(len(blobs)), pa.int32()), pa.array(blobs, pa.binary())], names)

    return documents.select("doc_id", "text").mapInArrow(work, "doc_id long, n long, key long, chunk int, counts binary")


def slot_counts(rows: DataFrame) -> np.ndarray:
    """All slot counts: 2^SLOT_BITS numbers, whatever the input's size."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), "<u4").astype("<i8") for x in table.column("counts"))
        return pa.table({"chunk": table.column("chunk")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    chunks = rows.filter("chunk is not null").select("chunk", "counts").groupBy("chunk").applyInArrow(add, "chunk int, counts binary").collect()
    out = np.zeros(1 << SLOT_BITS, np.int64)
    for chunk in chunks:
        out[chunk["chunk"] * CHUNK : (chunk["chunk"] + 1) * CHUNK] = np.frombuffer(chunk["counts"], "<i8")
    return out


def _size_class(n: int) -> int:
    """Sizes that can link lie in the same or neighbouring classes."""
    return min(_EARLY - 1, int(np.log(n) / np.log(100 / PERCENT) + 1e-9))


_POSTING = np.dtype([("shingle", "<u4"), ("key", "<i8"), ("size", "u1")])
#: Top bit of a posting's size class: the shingle lies in the part of the prefix that the shorter set of a pair needs.
_EARLY = 128


def early_length(n: int) -> int:
    """Of two sets that link, the shorter one (or either, if they are of one size) has a common shingle among its first so many."""
    return n + 1 - -(-2 * PERCENT * n // (100 + PERCENT))


def candidate_groups(documents: DataFrame, counts: np.ndarray) -> DataFrame:
    """(shingle, whole, members, meeting): the classes that share a prefix shingle with one of a fitting size, and
    those of them that meet there a class early in its or their own prefix. A group that is not whole has more rows."""
    spark = documents.sparkSession
    n_buckets = 8 * pieces(spark)
    held = spark.sparkContext.broadcast(counts.astype(np.uint32))  # a fixed 1 MB
    heavy = max(HEAVY, 8 * int(counts.mean()))

    digests = digest_key(documents.sparkSession)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        rows: list[np.ndarray] = []
        where: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            bucket, posting = np.concatenate(where), np.concatenate(rows)
            order = np.argsort(bucket, kind="stable")
            bucket, posting = bucket[order], posting[order]
            begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            blobs = [posting[a:b].tobytes() for a, b in zip(begin, [*begin[1:], len(bucket)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[begin] >> SALT_BITS, pa.int64()), pa.array(bucket[begin] & (1 << SALT_BITS) - 1, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "salt", "postings"])

        for batch in batches:
            for part in slices(batch):
                for s in shingle_sets(*texts_of(part.column("text")), WIDTH, digests):
                    n = len(s)
                    key = _key(s)
                    if not n or key in seen:
                        continue
                    seen.add(key)
                    length = prefix_length(n)
                    heat = held.value[_slot(s)]
                    first = np.lexsort((s, heat))[:length]
                    posting = np.empty(length, _POSTING)
                    posting["shingle"], posting["key"], posting["size"] = s[first].astype(np.uint32), key, _size_class(n)
                    posting["size"][: early_length(n)] |= _EARLY
                    salt = key % (heat[first].astype(np.int64) // heavy + 1)
                    rows.append(posting)
                    base = ((s[first] >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int64)
                    # Bit 0 tells spread shingles, whose other postings lie in buckets of other salts.
                    where.append((base * 2 + (heat[first] >= heavy)) << SALT_BITS | salt)
                    size += length
                if size > HOLD:
                    yield flush()
                    rows, where, size = [], [], 0
        if size:
            yield flush()

    def gather(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        whole = bucket % 2 == 0
        rows = np.concatenate([np.frombuffer(x.as_buffer(), _POSTING) for x in table.column("postings")])
        early, rows = rows["size"] >= _EARLY, rows.copy()
        rows["size"] &= _EARLY - 1
        order = np.lexsort((rows["key"], rows["size"], rows["shingle"]))
        rows, early = rows[order], early[order]
        first = np.concatenate([[True], (rows["shingle"][1:] != rows["shingle"][:-1]) | (rows["key"][1:] != rows["key"][:-1])])
        rows, early = rows[first], early[first]
        meets = np.ones(len(rows), bool)
        if whole:
            near = (rows["shingle"][1:] == rows["shingle"][:-1]) & (rows["size"][1:].astype(int) - rows["size"][:-1] <= 1)
            keep = np.concatenate([near, [False]]) | np.concatenate([[False], near])
            rows, early = rows[keep], early[keep]
            meets = early | _beside(rows["shingle"].astype(np.int64) << 8 | rows["size"], early)
        begin = np.flatnonzero(np.concatenate([[True], rows["shingle"][1:] != rows["shingle"][:-1]])) if len(rows) else np.zeros(0, np.int64)
        shingle = np.int64(bucket // 2) << np.int64(32) | rows["shingle"][begin].astype(np.int64)
        edges = np.append(begin, len(rows))
        meeting = np.concatenate([[0], np.cumsum(meets)])[edges]
        keys = rows["key"].astype(np.int64)
        lists = [pa.ListArray.from_arrays(pa.array(e, pa.int32()), pa.array(k, pa.int64())) for e, k in ((edges, keys), (meeting, keys[meets]))]
        return pa.table({"shingle": pa.array(shingle, pa.int64()), "whole": pa.array(np.full(len(begin), whole)), "members": lists[0], "meeting": lists[1]})

    packed = documents.select("text").mapInArrow(emit, "bucket long, salt long, postings binary")
    return packed.groupBy("bucket", "salt").applyInArrow(gather, "shingle long, whole boolean, members array<long>, meeting array<long>")


def _beside(place: np.ndarray, early: np.ndarray) -> np.ndarray:
    """Which of the ascending places (shingle, size class) have an early one in their own or the next or last class."""
    marked = np.unique(place[early])
    out = np.zeros(len(place), bool)
    for step in (-1, 0, 1):
        at = np.minimum(np.searchsorted(marked, place + step), max(len(marked) - 1, 0))
        out |= (marked[at] == place + step) if len(marked) else False
    return out


def memberships(groups: DataFrame) -> DataFrame:
    """(shingle, key) of the classes that meet in a group; of groups with the same ones there is one, under a hash of them.

    A passage that documents share makes as many like groups as it has shingles, so this is much less than `groups`.
    """
    like = groups.filter("whole and size(meeting) > 1").groupBy("meeting").agg(F.count("*").alias("times")).select(F.xxhash64("meeting").alias("shingle"), F.explode("meeting").alias("key"))
    return like.union(groups.filter("not whole").select("shingle", F.explode("meeting").alias("key")))


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def _texts_of(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """The documents whose doc_id is in wanted(least, key, routes), with wanted's columns; several rows may share a doc_id."""
    wanted = materialise(wanted, "wanted")
    size = wanted.agg(F.count("*") + F.coalesce(F.sum(F.size("routes")), F.lit(0))).first()[0]
    if size <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    return documents.select("doc_id", "text").join(wanted, F.col("doc_id") == F.col("least"))


def prefix_length(n):
    return n + 1 - -(-PERCENT * n // 100)


def shared_least(na: int, nb: int) -> int:
    """The fewest prefix shingles that two sets of these sizes share if they link: what their overlap cannot leave to the rest of the shorter-reaching prefix."""
    overlap = -(-PERCENT * (na + nb) // (100 + PERCENT))
    return min(prefix_length(na) - na, prefix_length(nb) - nb) + overlap


def prefixes_of(groups: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, n, shared, lost): 16 bits of each prefix shingle, for they travel often. Two sets may seem to share more
    shingles than they do; `lost` are those of a set that have the bits of another one, which may be shared unseen."""
    low = (F.col("shingle").bitwiseAND(F.lit(0xFFFF)) - F.lit(1 << 15)).cast("smallint")
    held = groups.select("shingle", F.explode("members").alias("key")).groupBy("key").agg(F.collect_set(low).alias("shared"), F.count("*").alias("_all"))
    return held.join(classes, "key").select("key", "n", "shared", (F.col("_all") - F.size("shared")).cast("int").alias("lost"))


def plausible(pairs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The (a, b) of pairs whose sizes fit and that share enough prefix shingles; prefixes as `prefixes_of` makes them."""
    side = lambda x: prefixes.select(F.col("key").alias(x), F.col("n").alias(f"n{x}"), F.col("shared").alias(f"p{x}"), F.col("lost").alias(f"l{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb"))
    up = lambda x, of: F.expr(f"({x} + {of - 1}) div {of}")
    least = F.least(1 - up(f"{PERCENT} * na", 100), 1 - up(f"{PERCENT} * nb", 100)) + up(f"{PERCENT} * (na + nb)", 100 + PERCENT)
    return both.filter(F.size(F.array_intersect("pa", "pb")) + F.least("la", "lb") >= least).select("a", "b")


def verified(pairs: DataFrame, classes: DataFrame, documents: DataFrame) -> DataFrame:
    """The (a, b) of pairs whose sets link; classes(key, least, n) tells where the sets come from.

    The set of b travels to a's place, a's own set first in line there; the places of an a with many partners
    are salted, and a's set goes to each.
    """
    pairs = materialise(pairs, "pairs")
    places = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(PLACE)).cast("int").alias("places"))
    member = pairs.join(places, "a").select(F.col("b").alias("key"), "a", F.pmod(F.xxhash64("b"), "places").cast("int").alias("salt"), F.lit(True).alias("member"))
    centre = places.select(F.col("a").alias("key"), "a", F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("salt"), F.lit(False).alias("member"))
    routes = member.union(centre).groupBy("key").agg(F.collect_list(F.struct("a", "salt", "member")).alias("routes"))

    digests = digest_key(documents.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(*texts_of(part.column("text")), WIDTH, digests)
                rows = [(r["a"], r["salt"], r["member"], k, packed_set(s)) for s, k, routed in zip(sets, part.column("key").to_pylist(), part.column("routes").to_pylist(), strict=True) if _key(s) == k for r in routed]
                for i in range(0, len(rows), 200):
                    a, salt, is_member, key, held = zip(*rows[i : i + 200], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(salt, pa.int32()), pa.array(is_member), pa.array(key, pa.int64()), pa.array(held, pa.binary())], ["a", "salt", "member", "b", "held"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = None
        for batch in batches:
            found = []
            for a, is_member, b, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if not is_member:
                    centre = unpacked_set(held.as_buffer())
                elif _linked(centre, unpacked_set(held.as_buffer())):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    wanted = routes.join(classes, "key").select("least", "key", "routes")
    sent = _texts_of(documents, wanted).select("text", "key", "routes").mapInArrow(send, "a long, salt int, member boolean, b long, held binary")
    placed = sent.repartition(pieces(documents.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", "member")
    return placed.select("a", "member", "b", "held").mapInArrow(compare, "a long, b long")


def packed_set(s: np.ndarray) -> bytes:
    """The upper 48 bits of each hash: two sets of 20,000 shingles then have a false common one once in 700,000 pairs."""
    return s.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked_set(held) -> np.ndarray:
    six = np.frombuffer(held, np.uint8).reshape(-1, 6)
    eight = np.zeros((len(six), 8), np.uint8)
    eight[:, 2:] = six
    return eight.view(">u8").reshape(-1).astype(np.uint64)


def bitmap(s: np.ndarray) -> int:
    """A token bitmap of at least BITMAP_BITS bits a token, a power of two wide, as an integer with a leading 1 above it."""
    width = max(64, 1 << (BITMAP_BITS * len(s) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(s & np.uint64(width - 1)).astype(np.int64)] = 1
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little") | 1 << width


def fold(bits: int, width: int) -> int:
    """A bitmap at a smaller width: its halves OR-combined until it fits."""
    now = bits.bit_length() - 1
    bits ^= 1 << now
    while now > width:
        now >>= 1
        bits = bits & ((1 << now) - 1) | bits >> now
    return bits


class Node:
    """A node of a signature tree: the OR of the bitmaps below, their range of sizes, and their component if it is one."""

    def __init__(self, below: list[Node] | None = None, bits: int = 0, n: int = 0, item: int = -1, label: int = 0, tokens: int | None = None):
        self.below = below
        if below is None:
            self.width = bits.bit_length() - 1
            self.bits = bits ^ 1 << self.width
            self.least = self.most = n
            # Tokens that share a bit with another one: the overlap may exceed the common bits by so many.
            self.tokens = n if tokens is None else tokens
            self.most_hidden = self.tokens - self.bits.bit_count()
            self.item, self.label = item, label
        else:
            self.width = min(x.width for x in below)
            self.bits = 0
            for x in below:
                self.bits |= fold(x.bits | 1 << x.width, self.width)
            self.least, self.most = min(x.least for x in below), max(x.most for x in below)
            # At this width a token is hidden unless it is among its set's bits here; leaves keep their own count.
            self.most_hidden = max(x.hidden_at(self.width) for x in below)
            self.label = below[0].label if all(x.label == below[0].label for x in below) else None
            self.item, self.tokens = -1, max(x.tokens for x in below)

    def hidden_at(self, width: int) -> int:
        """The most tokens that a set below can have beyond its bits at this width."""
        if width == self.width:
            return self.most_hidden
        if self.below is None:
            return self.tokens - fold(self.bits | 1 << self.width, width).bit_count()
        return max(x.hidden_at(width) for x in self.below)


def build_tree(leaves: list[Node]) -> Node:
    while len(leaves) > 1:
        leaves = [Node(leaves[i : i + FANOUT]) for i in range(0, len(leaves), FANOUT)]
    return leaves[0]


def most_common(a: Node, b: Node) -> int:
    """The largest number of common tokens that the bitmaps allow."""
    width = min(a.width, b.width)
    common = (fold(a.bits | 1 << a.width, width) & fold(b.bits | 1 << b.width, width)).bit_count()
    return min(common + min(a.hidden_at(width), b.hidden_at(width)), a.tokens, b.tokens)


def sizes_fit(a: Node, b: Node) -> bool:
    return 100 * a.most >= PERCENT * b.least and 100 * b.most >= PERCENT * a.least


def may_link(a: Node, b: Node) -> bool:
    """Whether the largest overlap that sizes and bitmaps of whole sets allow can reach the threshold."""
    return sizes_fit(a, b) and most_common(a, b) * (100 + PERCENT) >= PERCENT * (a.least + b.least)


def may_share(a: Node, b: Node) -> bool:
    """Whether sizes and bitmaps of prefixes allow as many common prefix shingles as linked sets have (rounded down)."""
    if not sizes_fit(a, b):
        return False
    overlap = PERCENT * (a.least + b.least) / (100 + PERCENT)
    return most_common(a, b) >= overlap - PERCENT / 100 * max(a.most, b.most)


def dual_traversal(root: Node, may, linked, find) -> Iterator[tuple[int, int]]:
    """Pairs of items of different components below root that pass may(node, node) all the way down, and linked(i, j).

    find(label) gives a label's present component; the caller may join components before it asks for the next pair.
    """
    stack = [(root, root)]
    while stack:
        a, b = stack.pop()
        if a.label is not None and b.label is not None and find(a.label) == find(b.label):
            continue
        if a is not b and not may(a, b):
            continue
        if a.below is None and b.below is None:
            if a is not b and linked(a.item, b.item):
                yield a.item, b.item
        elif a is b:
            stack += [(x, y) for i, x in enumerate(a.below) for y in a.below[i:]]
        elif b.below is None or a.below is not None and a.most - a.least >= b.most - b.least:
            stack += [(x, b) for x in a.below]
        else:
            stack += [(a, y) for y in b.below]


def walk_group(keys: list[int], labels: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join the components of a group as far as its members link, through a signature tree."""
    order = sorted(range(len(keys)), key=lambda i: (len(sets[i]), labels[i], keys[i]))
    leaves = [Node(bits=bitmap(sets[i]), n=len(sets[i]), item=i, label=labels[i]) for i in order]
    above = {label: label for label in labels}

    def find(label: int) -> int:
        while above[label] != label:
            above[label] = label = above[above[label]]
        return label

    found = []
    for i, j in dual_traversal(build_tree(leaves), may_link, lambda i, j: _linked(sets[i], sets[j]), find):
        found.append((min(keys[i], keys[j]), max(keys[i], keys[j])))
        above[find(labels[i])] = find(labels[j])
    return found


def in_blocks(rows: DataFrame, group: str) -> DataFrame:
    """rows(group, key, label, members[, shingles]) as often as their group has pairs (i, j) of blocks that hold them."""
    blocks = F.ceil(F.col("members") / F.lit(BLOCK)).cast("int")
    if "shingles" in rows.columns:  # of whole sets, which may be long
        blocks = F.greatest(blocks, F.least(F.col("members").cast("int"), F.ceil(F.col("shingles") / F.lit(BLOCK_SHINGLES)).cast("int")))
    own = F.pmod(F.xxhash64("key"), blocks).cast("int")
    rows = rows.select(group, "key", "label", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    return rows.select(group, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "key", "label")


def possible_families(groups: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(family, key, label, members, shingles) of the classes of groups(shingle, key, label, members) that share enough prefix
    shingles with one of another component; such pairs, wherever they meet, lie in one family."""

    def mark(table: pa.Table) -> pa.Table:
        n, labels, keys, lost = (table.column(c).to_pylist() for c in ("n", "label", "key", "lost"))
        shared = [mix(np.asarray(x.values).astype(np.uint64)) for x in table.column("shared")]
        order = sorted(range(len(n)), key=lambda i: (n[i], labels[i]))
        root = build_tree([Node(bits=bitmap(shared[i]), n=n[i], item=i, label=labels[i], tokens=len(shared[i]) + lost[i]) for i in order])
        above = list(range(len(n)))

        def find(i: int) -> int:
            while above[i] != i:
                above[i] = i = above[above[i]]
            return i

        def enough(i: int, j: int) -> bool:
            return find(i) != find(j) and len(np.intersect1d(shared[i], shared[j], assume_unique=True)) + min(lost[i], lost[j]) >= shared_least(n[i], n[j])

        for i, j in dual_traversal(root, may_share, enough, lambda label: label):
            above[find(i)] = find(j)
        tops = [find(i) for i in range(len(n))]
        size = np.bincount(tops, minlength=len(n))
        kept = [i for i in range(len(n)) if size[tops[i]] > 1]
        columns = [[keys[i] for i in kept], [labels[i] for i in kept], [keys[tops[i]] for i in kept]]
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("key", "label", "top"), columns, strict=True)})

    found = in_blocks(groups, "shingle").join(prefixes, "key").groupBy("shingle", "i", "j").applyInArrow(mark, "key long, label long, top long")
    found = materialise(found.distinct(), "possible")
    families = components(found.select(F.col("key").alias("a"), F.col("top").alias("b")))
    members = found.select("key", "label").distinct().join(families, F.col("key") == F.col("node")).select(F.col("component").alias("family"), "key", "label")
    sized = members.join(prefixes.select("key", "n"), "key").groupBy("family").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    return members.join(sized, "family")


def tree_links(rows: DataFrame, classes: DataFrame, documents: DataFrame) -> DataFrame:
    """(a, b) links between different components of the families of rows(family, i, j, key, label)."""
    places = rows.groupBy("key").agg(F.collect_list(F.struct("family", "i", "j", "label")).alias("routes"))

    digests = digest_key(documents.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"family": pa.int64(), "i": pa.int32(), "j": pa.int32(), "key": pa.int64(), "label": pa.int64(), "held": pa.binary()}
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(*texts_of(part.column("text")), WIDTH, digests)
                for s, key, routes in zip(sets, part.column("key").to_pylist(), part.column("routes").to_pylist(), strict=True):
                    if _key(s) != key:
                        continue
                    held = packed_set(s)
                    for a in range(0, len(routes), 100):
                        some = routes[a : a + 100]
                        columns = [[r["family"] for r in some], [r["i"] for r in some], [r["j"] for r in some], [key] * len(some), [r["label"] for r in some], [held] * len(some)]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))

    def walk(table: pa.Table) -> pa.Table:
        sets = [unpacked_set(x.as_buffer()) for x in table.column("held")]
        found = walk_group(table.column("key").to_pylist(), table.column("label").to_pylist(), sets)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    wanted = places.join(classes, "key").select("least", "key", "routes")
    sent = _texts_of(documents, wanted).select("text", "key", "routes").mapInArrow(send, "family long, i int, j int, key long, label long, held binary")
    return sent.groupBy("family", "i", "j").applyInArrow(walk, "a long, b long")


def classed_rows(documents: DataFrame) -> DataFrame:
    """documents(doc_id, text) -> doc_id, n, key (of the set), root (of its links; null for an empty set), component_id."""
    made = materialise(document_sets(documents), "sets")
    docs = made.filter("chunk is null").select("doc_id", "n", "key")
    classes = docs.filter("n > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("least"), F.min("n").alias("n"))
    found = materialise(candidate_groups(documents, slot_counts(made)), "groups")
    prefixes = materialise(prefixes_of(found, classes), "prefixes")
    postings = materialise(memberships(found), "memberships")

    links = tested = None
    labelled = postings.withColumn("label", F.col("key"))
    for number in range(ROUNDS):
        labelled = labelled if number == 0 else _labelled(postings, links)
        groups = labelled.groupBy("shingle").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min_by(F.struct("key", "label"), F.xxhash64("key", F.lit(number))).alias("drawn"))
        stars = labelled.join(groups.filter("lo <> hi").select("shingle", "drawn"), "shingle").filter(F.col("label") != F.col("drawn.label"))
        stars = stars.select(F.col("drawn.key").alias("a"), F.col("key").alias("b")).distinct()
        stars = materialise(plausible(stars if tested is None else stars.join(tested, ["a", "b"], "left_anti"), prefixes), "stars")
        found = materialise(verified(stars, classes, documents), "links")
        links, tested = (found, stars) if links is None else (links.union(found), tested.union(stars))

    labelled = materialise(_labelled(postings, links), "labelled")
    order_free = [F.count("*").alias("members"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("of"), F.min("label").alias("lo"), F.max("label").alias("hi")]
    mixed = labelled.groupBy("shingle").agg(*order_free).filter("members > 2 and lo <> hi")
    mixed = mixed.groupBy("members", "of").agg(F.min("shingle").alias("shingle")).select("shingle", "members")
    families = materialise(possible_families(labelled.join(mixed, "shingle"), prefixes), "families")
    links = links.union(tree_links(in_blocks(families, "family"), classes, documents))

    classed = components(links)
    names = classes.join(classed, classes["key"] == classed["node"], "left").withColumn("root", F.coalesce("component", "key"))
    smallest = names.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = names.select("key", "root").join(smallest, "root").select(F.col("key").alias("_key"), "root", "component_id")
    rows = docs.join(of_class, (docs["key"] == of_class["_key"]) & docs["doc_id"].isNotNull(), "left")
    return rows.select("doc_id", "n", "key", "root", F.coalesce("component_id", "doc_id").alias("component_id"))


def jaccard_components(documents: DataFrame) -> DataFrame:
    """documents(doc_id, text) -> doc_id, n_shingles, component_id: components under Jaccard >= PERCENT / 100."""
    return classed_rows(documents).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _labelled(postings: DataFrame, links: DataFrame) -> DataFrame:
    """postings with the component, by the links so far, of each key; a key without links is its own."""
    labels = components(links)
    return postings.join(labels, postings["key"] == labels["node"], "left").select("shingle", "key", F.coalesce("component", "key").alias("label"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))


def keep_one(documents: DataFrame) -> DataFrame:
    """The rows of documents that are the least of their component, with all their columns.

    Where rows share a doc_id, each component that they belong to keeps one of them (of least set key, then of least
    hash of the row), and rows with an empty set all stay, as do rows without a doc_id.
    """
    id_, key, root, own, place = free_names(documents, "_id", "_key", "_root", "_own", "_place")
    kept = classed_rows(documents).filter("doc_id = component_id or doc_id is null")
    kept = materialise(kept.select(F.col("doc_id").alias(id_), F.col("key").alias(key), F.col("root").alias(root)), "kept")
    shared = kept.filter(F.col(id_).isNotNull()).groupBy(id_).agg(F.count("*").alias(place)).filter(F.col(place) > 1).select(id_)
    rows = documents.join(kept.select(id_), documents["doc_id"].eqNullSafe(F.col(id_)), "left_semi")
    if shared.isEmpty():
        return rows
    shared = materialise(shared, "shared")
    alone = rows.join(shared, F.col("doc_id") == F.col(id_), "left_anti")
    columns, schema = documents.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields)
    digests = digest_key(documents.sparkSession)

    def with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                keys = [_key(s) for s in shingle_sets(*texts_of(part.column("text")), WIDTH, digests)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys, pa.int64())], [*part.schema.names, own])

    several = rows.join(shared, F.col("doc_id") == F.col(id_), "left_semi").mapInArrow(with_key, f"{schema}, `{own}` long")
    several = several.join(kept.distinct(), (F.col("doc_id") == F.col(id_)) & (F.col(own) == F.col(key)))
    first = Window.partitionBy("doc_id", root).orderBy(own, F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in columns]))
    several = several.withColumn(place, F.when(F.col(root).isNull(), 1).otherwise(F.row_number().over(first)))
    return alone.unionByName(several.filter(F.col(place) == 1).select(*[F.col(f"`{c}`") for c in columns]))
