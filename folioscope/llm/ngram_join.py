"""Exact Jaccard join of documents by their word n-grams.

Two sets with ``|r| <= |s|`` that link differ in at most
``h = floor(|r| * (den - num) / num)`` elements. So when hashed elements fall into
more than ``h`` segments, at least one segment holds the same subset in both. Size
bands fix the number of segments; a set is indexed under the subsets of its own
band and of each lower band that it may reach. A segment indexed with its
one-deletion neighbourhood counts twice, as it finds pairs that differ there by one.
Each band gets the cheapest split in plain and deleting segments, with a few spare
ones that pay for leaving out empty subsets, which many sets would share: an empty
segment counts for nothing, a deleting one with a single element once. The rare set
that loses more than the spare ones takes keys of single elements besides. Elements that
very many sets hold stay out of the segments. Of the sets that share a key, sketches
part those that can't link, as chance keys would else chain more and more sets the more
there are; what is left is compared exactly, on the words.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import as_row, forget_others, give_back, id_text, materialize, slices
from folioscope.llm.components import components

#: Production parameters: words in a shingle and the least Jaccard similarity as a fraction.
WORDS, NUM, DEN = 3, 90, 100
#: Ratios of a size band's ends to choose from, the least mean size of a segment, and the cost of a key of one element.
BAND_RATIOS, LEAST_SUBSET, PREFIX_COST = (1.12, 1.25, 1.5), 3.0, 50.0
#: Documents in the sample that finds frequent elements, how many of them hold one at least, and most frequent elements.
SAMPLE, LEAST_HOLDERS, FREQUENT = 4_000, 8, 100_000
#: Bounds of what one comparing task holds: sets, and elements of them.
BLOCK_SETS, BLOCK_ELEMENTS = 1_000, 1_000_000
#: Rows of a table of large groups that is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 100_000
#: A key that more sets of a task part share, and more than a hundredth of them, stands once for all; a star of more sets is taken whole.
CROWD_SETS, STAR_SETS = 32, 5_000
#: Index keys that a task combines before it passes them on, and rows that it passes on at once.
COMBINE, PASSED_ROWS = 1_000_000, 1 << 16
#: The index is several times as large as the texts, so it is shuffled to as many times the usual partitions.
INDEX_SPREAD = 3


@dataclass(frozen=True)
class Band:
    """Sizes ``low`` to ``high`` - 1 fall in ``segments`` segments.

    The first ``deleting`` ones are indexed with their one-deletion neighbourhoods and
    count twice. ``spare`` is what all count beyond the largest difference of two links.
    """

    number: int
    low: int
    high: int
    segments: int
    deleting: int
    spare: int

    def keys(self, n: int) -> float:
        """Expected keys of a set of ``n`` elements, and what those of a set with too many lost segments cost."""
        out = 1 - 1 / self.segments
        lost = (self.segments + self.deleting) * out**n + self.deleting * n / self.segments * out ** (n - 1)
        return self.segments + self.deleting * n / self.segments + poisson_tail(lost, self.spare + 1) * PREFIX_COST * n


def poisson_tail(mean: float, k: int) -> float:
    """P(X >= k)."""
    term, total = math.exp(-mean), 0.0
    for i in range(k):
        total += term
        term *= mean / (i + 1)
    return max(0.0, 1.0 - total)


@functools.lru_cache(maxsize=8)
def bands(num: int, den: int) -> tuple[Band, ...]:
    """Size bands of the ratio, and in each the allocation, that cost the fewest keys.

    Segments hold ``LEAST_SUBSET`` elements or more on average, as smaller subsets are
    equal too often; where that makes them too few, some get deletions.
    """

    def build(ratio: float) -> tuple[Band, ...]:
        out: list[Band] = []
        low = -(-num // (den - num)) if den > num else 1 << 40
        while low < 1 << 40:
            high = max(low + 1, int(low * ratio))
            differ = (high - 1) * (den - num) // num
            best = None
            for spare in range(3 + differ):
                need = differ + 1 + spare
                m = min(need, max(1, int(low / LEAST_SUBSET)))
                if need > 2 * m:
                    m = -(-need // 2)
                band = Band(len(out), low, high, m, need - m, spare)
                cost = band.keys(low) + band.keys(high)
                if best is None or cost < best[0]:
                    best = (cost, band)
                elif spare > best[1].spare + 20:
                    break
            out.append(best[1])
            low = high
        return tuple(out)

    def cost(found: tuple[Band, ...]) -> float:
        return sum(sum(b.keys(n) for b in reached(found, n, num, den)) / n for n in range(100, 5000, 137))

    return min(map(build, BAND_RATIOS), key=cost)


def reached(found: tuple[Band, ...], n: int, num: int, den: int) -> list[Band]:
    """The band of a set of ``n`` elements and the lower ones that hold sets it may link with."""
    return [b for b in found if b.low <= n and (b.high - 1) * den >= num * n]


MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal inputs give equal, others unrelated numbers."""
    x = x + MIX[0]
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def text_words(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; bytes split and fold exactly so."""
    return text.encode().lower().split()


class Hasher:
    """Sorted distinct 64-bit hashes of a text's shingles. Words are hashed each time, which costs less than to look their hashes up."""

    def __init__(self, words: int):
        self.words = words

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        size = min(self.words, len(words))
        n = len(words) - size + 1
        out = mixed(h[:n] + np.uint64(size))
        for i in range(1, size):
            out = mixed(out * MIX[1] + h[i : i + n])
        return np.unique(out)


@functools.lru_cache(maxsize=4)
def hasher(words: int) -> Hasher:
    return Hasher(words)


def digest(shingles: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def sketch(shingles: np.ndarray) -> bytes:
    """For each place of a bitmap, whether an odd number of the set's hashes falls there.

    It has a power of two of places, 64 and as many as the set has elements at least. Halves
    fold upon one another, so sets of any sizes compare.
    """
    width = max(64, 1 << max(0, len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


@dataclass(frozen=True)
class Sketched:
    """A set by its size and sketch."""

    node: int
    n: int
    width: int
    bits: int

    @classmethod
    def of(cls, node: int, n: int, sketch: bytes) -> Sketched:
        return cls(node, n, 8 * len(sketch), int.from_bytes(sketch, "little"))

    def folded(self, width: int) -> int:
        bits, at = self.bits, self.width
        while at > width:
            at //= 2
            bits = (bits >> at) ^ (bits & ((1 << at) - 1))
        return bits

    def may_link(self, other: Sketched, num: int, den: int) -> bool:
        """False only if the two don't link: places that differ are no more than elements that just one set has, and of these
        links have no more than the share ``(den - num) / (den + num)`` of both sizes."""
        if den * min(self.n, other.n) < num * max(self.n, other.n):
            return False
        width = min(self.width, other.width)
        return (self.folded(width) ^ other.folded(width)).bit_count() * (den + num) <= (self.n + other.n) * (den - num)


def parted(star: list[Sketched], num: int, den: int) -> list[tuple[int, int]]:
    """``(a, b)`` from the smallest set to the others, in each part of a star that pairs which may link connect."""
    out, rest = [], star
    while rest:
        part, rest, at = rest[:1], rest[1:], 0
        while at < len(part) and rest:
            near, far = [], []
            for x in rest:
                (near if part[at].may_link(x, num, den) else far).append(x)
            part, rest, at = part + near, far, at + 1
        least = min(x.node for x in part)
        out += [(least, x.node) for x in part if x.node != least]
    return out


def index_keys(shingles: np.ndarray, num: int, den: int, frequent: np.ndarray) -> np.ndarray:
    """All index keys of a set of sorted hashes. Sorted ``frequent`` elements fall in no segment:
    without them two sets differ by no more than with them."""
    n, out = len(shingles), []
    if not n:
        return shingles
    at = np.minimum(np.searchsorted(frequent, shingles), max(0, len(frequent) - 1))
    often = frequent[at] == shingles if len(frequent) else np.zeros(n, bool)
    rare = shingles[~often]
    element = mixed(rare)
    for band in reached(bands(num, den), n, num, den):
        segment = ((rare >> np.uint64(32)) * np.uint64(band.segments)) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate([[len(rare) > 0], segment[1:] != segment[:-1]]))
        own = segment[starts]
        deleting = int(np.searchsorted(own, band.deleting))
        lost = band.segments - len(own) + band.deleting - deleting
        if len(starts):
            sums = np.add.reduceat(element, starts)
            place = mixed(own * np.uint64(1024) + np.uint64(band.number))
            out.append(mixed(place ^ sums))
            if deleting:
                counts = np.diff(np.append(starts, len(rare)))[:deleting]
                of = np.repeat(np.arange(deleting), counts)
                some = counts[of] > 1  # what is left of a single element is empty, as many segments are
                lost += int((counts == 1).sum())
                out.append(mixed(place[of][some] ^ (sums[of] - element[: len(of)])[some]))
        if lost > band.spare:
            # so many empty or single that the rest may all differ: two such sets share one of their first
            # elements, frequent ones last, as they share more elements than come after those
            first = n - -(-num * n // den) + 1
            listed = np.concatenate([element, mixed(shingles[often])])[:first]
            out.append(mixed(mixed(listed) + np.uint64(band.number)))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def frequent_elements(docs: DataFrame, words: int, rows: int) -> np.ndarray:
    """Sorted hashes of shingles that many of a sample hold, at most ``FREQUENT`` of them.

    The sample is ``SAMPLE`` documents by hash of the text. Which elements it finds
    changes the number of candidates, never a result.
    """
    share = min(1_000_000, SAMPLE * 1_000_000 // max(rows, 1))
    chosen = docs.where(F.pmod(F.xxhash64("text", F.lit(7)), F.lit(1_000_000)) < share)

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = hasher(words)
        for batch in batches:
            for x in slices(batch, 0):
                for text in x.column(0).to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array(own(text_words(text)).view(np.int64))], ["element"])

    least = max(LEAST_HOLDERS, SAMPLE // 500)
    counts = chosen.select("text").distinct().mapInArrow(elements, "element long").groupBy("element").count().where(F.col("count") >= least)
    found = [r.element for r in counts.orderBy(F.desc("count"), "element").limit(FREQUENT).select("element").collect()]
    return np.sort(np.array(found, np.int64).view(np.uint64))


def text_hash(text: Column) -> Column:
    """Tells texts apart that share an id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def document_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``(id, h, n, d1, d2, sketch)``: a hash of each document's text, size, 128-bit digest and sketch of its shingle set."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others("ngram")
        own = hasher(words)
        for batch in batches:
            for x in slices(batch):
                rows = []
                for text in x.column(1).to_pylist():
                    s = own(text_words(text))
                    rows.append((len(s), *digest(s), sketch(s)))
                columns = (pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 3 + [pa.binary()]))
                yield pa.RecordBatch.from_arrays([x.column(0), x.column(2), *columns], ["id", "h", "n", "d1", "d2", "sketch"])

    return docs.select("id", "text", text_hash(F.col("text")).alias("h")).mapInArrow(sets, f"id {docs.schema['id'].dataType.simpleString()}, h long, n long, d1 long, d2 long, sketch binary")


def index_rows(docs: DataFrame, words: int, num: int, den: int, frequent: np.ndarray) -> DataFrame:
    """``(key, node, hub)``: the sets' index keys, combined within tasks.

    A key stands with each of its sets (``hub`` null). Where a crowd of a task part's sets
    shares it, it stands once, with the smallest of them (``hub`` that set itself); the others
    follow as links to that one under keys of their own, so a key that very many sets
    share gets no more rows than ``CROWD_SETS`` or a hundredth of them from each part.
    """

    crowd_sets = CROWD_SETS

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = hasher(words), set()
        held: list[tuple[np.ndarray, int]] = []
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            key, crowd = np.concatenate([k for k, _ in held]).view(np.int64), max(crowd_sets, len(held) // 100)
            node = np.repeat(np.array([d for _, d in held], np.int64), [len(k) for k, _ in held])
            held.clear()
            order = np.lexsort((node, key))
            key, node = key[order], node[order]
            first = np.concatenate([[True], key[1:] != key[:-1]])
            of = np.cumsum(first) - 1
            hub, crowded = node[first][of], (np.bincount(of) > crowd)[of]
            extra, stays = crowded & (hub != node), first | ~crowded
            links = np.unique(np.stack([hub[extra], node[extra]], 1), axis=0)
            rows = pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([key[stays], links[:, 1]])), pa.array(np.concatenate([node[stays], links[:, 1]])), pa.array(np.concatenate([hub[stays], links[:, 0]]), mask=np.concatenate([~crowded[stays], np.zeros(len(links), bool)]))],
                ["key", "node", "hub"],
            )
            del order, key, node, first, of, hub, crowded, extra, stays, links
            for begin in range(0, rows.num_rows, PASSED_ROWS):
                yield rows.slice(begin, PASSED_ROWS)

        for batch in batches:
            for x in slices(batch):
                for text in x.column(1).to_pylist():
                    s = own(text_words(text))
                    d1, _ = digest(s)
                    if d1 in seen:
                        continue  # an exact copy adds no key
                    if len(seen) >= 500_000:
                        seen.clear()
                    seen.add(d1)
                    k = index_keys(s, num, den, frequent)
                    if len(k):
                        held.append((k, d1))
                        count += len(k)
                if count >= COMBINE:
                    yield from flush()
                    count = 0
        if held:
            yield from flush()
        seen.clear()
        give_back()

    return docs.select("id", "text").mapInArrow(keys, "key long, node long, hub long")


def candidate_links(index: DataFrame, sketches: DataFrame | None = None, num: int = NUM, den: int = DEN) -> DataFrame:
    """``(a, b)`` from each set to the smallest one with the same key: whatever shares a key is connected.

    With ``sketches`` (node, n, sketch) of the sets a star of such links falls into the parts within
    which sets may link: all links stay connected, but not sets that share a key by chance. Links of crowded keys stay.
    """
    own = "hub is null or hub = node"
    least, crowd = F.expr(f"min(if({own}, node, null)) over (partition by key)"), F.expr("bool_or(hub = node) over (partition by key)")
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = index.repartition(INDEX_SPREAD * parts, "key").select(F.when(F.expr(own), least).otherwise(F.col("hub")).alias("a"), F.col("node").alias("b"), (F.col("hub").isNotNull() | F.coalesce(crowd, F.lit(False))).alias("whole"))
    stars = keyed.where("a <> b").distinct()
    if sketches is None:
        return stars.select("a", "b").distinct()
    stars = materialize(stars, "stars")
    loose = stars.where("not whole")
    members = loose.select("a", F.col("b").alias("node")).unionByName(loose.select("a", F.col("a").alias("node")).distinct())
    sketched = members.join(sketches, "node").select("a", "node", "n", "sketch").repartition(parts, "a").sortWithinPartitions("a")
    most = STAR_SETS

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        star, held, whole = None, [], False
        for batch in batches:
            found = []
            for a, node, n, bits in zip(*(c.to_pylist() for c in batch.columns)):
                if a != star:
                    found += parted(held, num, den)
                    star, held, whole = a, [], False
                if not whole:
                    held.append(Sketched.of(node, n, bits))
                    whole = len(held) > most
                    if whole:
                        found += [(a, x.node) for x in held]
                        held = []
                else:
                    found.append((a, node))
            yield links_batch(found)
        yield links_batch(parted(held, num, den))

    return sketched.mapInArrow(part, "a long, b long").where("a <> b").unionByName(stars.where("whole").select("a", "b"))


def links_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])


def shingle_numbers(texts: list[np.ndarray], size: int, base: int) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted numbers; just equal shingles get equal numbers.

    A text is its words' numbers, from 1 to ``base`` - 1. With fewer than ``size`` words
    it is one shingle, filled up with 0.
    """
    filled = [t if len(t) >= size else np.concatenate([t, np.zeros(size - len(t), t.dtype)]) for t in texts]
    counts = [len(t) - size + 1 for t in filled]
    code = np.concatenate([t[:n] for t, n in zip(filled, counts)]).astype(np.int64)
    for i in range(1, size):
        code *= base
        code += np.concatenate([t[i : i + n] for t, n in zip(filled, counts)])
        code = np.unique(code, return_inverse=True)[1].reshape(-1)
    return [np.unique(x) for x in np.split(code.astype(np.int32), np.cumsum(counts)[:-1])]


def linked(a: int, b: int, common: int, num: int, den: int) -> bool:
    return den * common >= num * (a + b - common)


class Forest:
    """Union-find over places."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def compare(sets: list[np.ndarray], sides: list[int], cross: bool, num: int, den: int) -> list[tuple[int, int]]:
    """Exact links among sets of sorted numbers (``cross``: just between the two sides), less those within what is connected already."""
    n, forest, out = len(sets), Forest(len(sets)), []
    if n <= 40:
        for i in range(n):
            for j in range(i + 1, n):
                a, b = len(sets[i]), len(sets[j])
                if (cross and sides[i] == sides[j]) or den * min(a, b) < num * max(a, b) or forest.root(i) == forest.root(j):
                    continue
                if linked(a, b, len(np.intersect1d(sets[i], sets[j], assume_unique=True)), num, den) and forest.join(i, j):
                    out.append((i, j))
        return out
    element = np.concatenate(sets)
    order = np.argsort(element, kind="stable")
    holder = np.repeat(np.arange(n, dtype=np.int32), [len(s) for s in sets])[order]
    held = np.bincount(element)
    ends = np.cumsum(held)
    del element, order
    common = np.zeros((n, n))  # whole numbers stay exact up to 2**53
    for size in range(2, 9):  # pairs of an element's holders, where they are few
        of = holder[(ends[held == size] - size)[:, None] + np.arange(size)].astype(np.int64)
        for i in range(size):
            for j in range(i + 1, size):
                code, count = np.unique(of[:, i] * n + of[:, j], return_counts=True)
                common.reshape(-1)[code] += count
    wide = np.flatnonzero(held > 8)
    for begin in range(0, len(wide), 2048):  # else as a product of matrices
        part = wide[begin : begin + 2048]
        x = np.zeros((n, len(part)), np.float32)
        for k, (end, count) in enumerate(zip(ends[part].tolist(), held[part].tolist())):
            x[holder[end - count : end], k] = 1
        common += x @ x.T  # at most 2,048 elements at a time, exact in 32 bits too
    sizes = np.array([len(s) for s in sets], np.int64)
    for i in range(n):
        o = np.rint(common[i, i + 1 :]).astype(np.int64)
        hit = den * o >= num * (sizes[i] + sizes[i + 1 :] - o)
        for j in (np.flatnonzero(hit) + i + 1).tolist():
            if not (cross and sides[i] == sides[j]) and forest.join(i, j):
                out.append((i, j))
    return out


def exact_links(groups: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """``(a, b)``: verified links that connect what links within each group of (group, part_a, part_b)."""

    def verify(table: pa.Table) -> pa.Table:
        own, chosen, numbers = hasher(words), {}, {}
        for node, side, text in zip(table.column("node").to_pylist(), table.column("side").to_pylist(), table.column("text")):
            split = text_words(text.as_py())
            if node not in chosen and digest(own(split))[0] == node:
                chosen[node] = (side, np.fromiter((numbers.setdefault(w, len(numbers) + 1) for w in split), np.int32, len(split)))
        nodes = sorted(chosen)
        cross = table.column("part_a")[0].as_py() != table.column("part_b")[0].as_py()
        sets = shingle_numbers([chosen[x][1] for x in nodes], words, len(numbers) + 1) if nodes else []
        found = compare(sets, [chosen[x][0] for x in nodes], cross, num, den)
        return pa.table([pa.array([nodes[i] for i, _ in found], pa.int64()), pa.array([nodes[j] for _, j in found], pa.int64())], names=["a", "b"])

    return groups.select("group", "part_a", "part_b", "node", "side", "text").groupBy("group", "part_a", "part_b").applyInArrow(verify, "a long, b long")


def by_bitmap(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``docs`` with a column ``__near``: false only where the id isn't among the ids ``wanted``.

    A bitmap of 2**23 hashed ids (256 rows of 4 KB, however many ids) goes to all
    tasks, so that most rows that nobody wants can stay where they are.
    """
    place = lambda c: F.pmod(F.xxhash64(F.col(f"`{c}`").cast("string")), F.lit(1 << 23))
    bits = wanted.select(place("id").alias("p")).distinct()
    bits = bits.groupBy(F.shiftright("p", 15).alias("__page")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(0x7FFF)).alias("__bits"))
    placed = docs.withColumn("__p", place("id")).withColumn("__page", F.shiftright("__p", 15))
    byte = F.conv(F.hex(F.substring(F.col("__bits"), F.shiftright(F.col("__p").bitwiseAND(0x7FFF), 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.getbit(byte, F.col("__p").bitwiseAND(7).cast("int")) == 1
    return placed.join(F.broadcast(bits), "__page", "left").withColumn("__near", F.coalesce(bit, F.lit(False))).drop("__p", "__page", "__bits")


def wanted_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``docs`` joined with ``wanted`` on ``id``, null ids too."""
    near = by_bitmap(docs, wanted).where("__near").select("id", "text")
    return near.join(wanted.withColumnRenamed("id", "__id"), F.col("id").eqNullSafe(F.col("__id"))).drop("__id")


def class_bounds(num: int, den: int, largest: int = 1 << 40) -> list[int]:
    """First size of each size class: sets of one class link with none beyond the next class."""
    bounds = [1, 2]
    while bounds[-1] < largest:
        bounds.append(den * (bounds[-1] - 1) // num + 1)
        if bounds[-1] == bounds[-2]:
            bounds[-1] += 1
        if num == den and len(bounds) > 2:
            return []
    return bounds


def size_class(n: Column, num: int, den: int) -> Column:
    """The class of a size, by whole numbers; with equal sizes alone linking, the size itself."""
    bounds = class_bounds(num, den)
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x <= n)) if bounds else n.cast("int")


def checked_broadcast(small: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``small``, a written table, to be broadcast if it has few rows; else it is joined by a shuffle."""
    return F.broadcast(small) if small.limit(most + 1).count() <= most else small


def join_classes(docs: DataFrame, sets: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """``(node, label)`` of all sets that link with another one."""
    classes = sets.where("n > 0").groupBy(F.col("d1").alias("node")).agg(F.min("id").alias("id"), F.first("n").alias("n"))
    frequent = frequent_elements(docs, words, sets.count())
    sketches = sets.where("n > 0").groupBy(F.col("d1").alias("node")).agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    near = components(candidate_links(index_rows(docs, words, num, den, frequent), sketches, num, den))
    members = materialize(classes.join(near, "node").withColumnRenamed("label", "group"), "candidates")
    # sets of a larger group meet those of the same or the next size class, part by part
    many = members.groupBy("group").agg(F.count("*").alias("sets"), F.sum("n").alias("elements")).where((F.col("sets") > BLOCK_SETS) | (F.col("elements") > BLOCK_ELEMENTS))
    many = materialize(many.select("group", F.lit(True).alias("large")), "large-groups")
    placed = members.join(checked_broadcast(many), "group", "left").withColumn("size_class", F.when(F.col("large"), size_class(F.col("n"), num, den)).otherwise(0)).drop("large")
    of_large = placed.join(checked_broadcast(many), "group", "left_semi").groupBy("group", "size_class")
    of_large = materialize(of_large.agg(F.greatest(F.ceil(F.count("*") / F.lit(BLOCK_SETS)), F.ceil(F.sum("n") / F.lit(BLOCK_ELEMENTS))).cast("int").alias("parts")), "size-classes")
    upper = of_large.select("group", (F.col("size_class") - 1).alias("size_class"), F.col("parts").alias("upper_parts"))
    lower = of_large.select("group", (F.col("size_class") + 1).alias("size_class"), F.col("parts").alias("lower_parts"))
    neighbours = materialize(of_large.join(upper, ["group", "size_class"], "left").join(lower, ["group", "size_class"], "left"), "size-classes")
    placed = placed.join(checked_broadcast(neighbours), ["group", "size_class"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    texts = wanted_texts(docs, placed.select("id", "node", "group", "size_class", part.alias("part"), "parts", "upper_parts", "lower_parts"))
    own, at = F.struct("size_class", "part"), F.col("size_class")

    def others(size_class, count):
        return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(size_class.cast("int").alias("size_class"), i.alias("part")))

    none = F.array().cast("array<struct<size_class:int,part:int>>")
    partners = F.concat(others(at, F.col("parts")), F.coalesce(others(at + 1, F.col("upper_parts")), none), F.coalesce(others(at - 1, F.col("lower_parts")), none))
    pairs = texts.select("group", "node", "text", own.alias("side"), F.explode(partners).alias("other"))
    pairs = pairs.select("group", F.least("side", "other").alias("part_a"), F.greatest("side", "other").alias("part_b"), "node", F.when(F.col("side") < F.col("other"), 0).otherwise(1).alias("side"), "text")
    return components(exact_links(pairs, words, num, den))


def classified(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """``(id, h, n, component_id, keeper)`` for every row of ``(id, text)``; ``keeper`` is the least
    (no id, id, h) of the component, both are null for texts without words."""
    sets = materialize(document_sets(docs, words), "sets")
    labels = join_classes(docs, sets, words, num, den)
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("least")
    classes = sets.where("n > 0").groupBy(F.col("d1").alias("node"), "d2").agg(F.min("id").alias("least_id"), least)
    named = classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    of = named.groupBy("label").agg(F.min("least_id").alias("component_id"), F.min("least").alias("keeper"))
    named = materialize(named.join(of, "label").select("node", "d2", "component_id", "keeper"), "components")
    with_class = sets.where("n > 0").join(named, (F.col("d1") == F.col("node")) & (sets["d2"] == named["d2"])).select("id", "h", "n", "component_id", "keeper")
    return with_class.unionByName(sets.where("n = 0").select("id", "h", "n"), allowMissingColumns=True)


def near_duplicates(docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs``.

    Sets of ``words``-word shingles (fewer words: the whole sequence as one) link at a
    Jaccard similarity of ``num / den`` or more; a component is what links connect, and
    its id the smallest document id in it. Texts without words (null, empty, white
    space) link with nothing and are their own component. Repeated rows and equal
    texts fall in one class; a null id is kept, and is a component's id only where it
    has no other; an empty table gives no rows. Classes go by 128-bit digests of
    hashed shingles and candidates by 64 bits of them; links are compared on words.
    """
    rows = classified(id_text(docs, id_col, text_col), words, num, den)
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return rows.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame, words: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when each component keeps one; rows without words all stay.

    The row with the smallest id stays, null ids last; among rows that share it the one with
    the least hash of the text, and of rows that agree in id and text the first as JSON.
    Different texts that share an id are documents of their own. An empty table gives no rows.
    Only rows that may have to go are moved.
    """
    rows = materialize(classified(id_text(docs, id_col, text_col), words, num, den), "near-duplicates").where("n > 0")
    own = F.col("id").eqNullSafe(F.col("keeper.id")) & (F.col("h") == F.col("keeper.h"))
    gone = rows.where(~own).select("id", "h").distinct().withColumn("gone", F.lit(True))
    again = rows.where(own).groupBy("id", "h").count().where("count > 1").select("id", "h", F.lit(False).alias("gone"))
    marks = materialize(gone.unionByName(again), "marks")
    marked = by_bitmap(as_row(docs).withColumn("id", F.col(f"row.`{id_col}`")).withColumn("h", text_hash(F.col(f"row.`{text_col}`"))), marks)
    named = marks.select(F.col("id").alias("__id"), F.col("h").alias("__h"), "gone")
    near = marked.where("__near").join(named, F.col("id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h")), "left")
    once = near.where("gone = false").groupBy("id", "h").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return marked.where("not __near").select("row.*").unionByName(near.where("gone is null").select("row.*")).unionByName(once.select("row.*"))
