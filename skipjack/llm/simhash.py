"""SimHash near-duplicate groups with a Gray-order hierarchical index.

Fingerprints (64 bits, each bit the majority of the shingles' XXH64) link if at most three bits differ. Equal
fingerprints are folded first, so copies cost one entry. The distinct ones are routed: of four 16-bit blocks one is
equal in both ends of a link, and of the four 12-bit blocks of the rest again one, so each fingerprint goes to 16
buckets of 28 equal bits and every link meets in at least one of them; a bucket with more than ``BUCKET_ROWS``
fingerprints is dealt on by the same rule over its free bits. In a bucket the fingerprints are
sorted by Gray rank; groups of neighbours form nodes that hold the bits all members share (mask and value), nodes form
upper nodes. Pairs of nodes are followed down from the top: the shared bits in which two nodes differ are a lower bound
that only grows on the way, so whole groups are pruned; node pairs already joined are not followed again. A bucket gives a spanning
set of links (at most one per entry), never its pairs.

Three bits hold only the closest copies: shingle sets of a Jaccard similarity of 0.8 differ in about nine of the 64
bits, too many for any routing. With ``similarity`` such copies are linked as well: a document's shingles are sampled
by least hashes (``SAMPLES`` times ``DRAWN`` of them), documents with an equal sample are compared with the
sample's first document, and linked if the exact Jaccard similarity of their shingle sets is at least that. Nothing
is linked unseen. The samples only spare work: what they and the fingerprints leave apart goes through an exact join. In one
order of all shingles two sets of n and m members at a similarity of t share one of their first n - ceil(t n) + 1 and
m - ceil(t m) + 1, so every such pair of two groups meets in a shingle's bucket. It counts only if sizes, places and the
parities of the hashed sets allow the similarity (all three are bounds, none loses a pair). A bucket never gives its pairs: sizes
and places tell the entries that have a partner, these get their parities, and the bucket gives a least spanning forest of the pairs
left, which are compared by their texts. If all links of a forest hold, its bucket is settled: every pair is inside a
group. A bucket with a link that fails is gone through again without the failed pairs, in the last of ``ROUNDS`` rounds by
all pairs left. The order puts shingles that are frequent in a sample of the rows last, which changes the buckets' sizes and no result;
buckets of more than ``DEALT`` sets are dealt into pairs of parts over several tasks.

Defined cases: null and blank texts have no shingles and fingerprint zero, linked like any other; fewer words than a shingle has are
one shingle; repeated rows fall in one group; rows that repeat an id with another text are each grouped by their own; null ids get a
fingerprint and the group's least id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skipjack.llm.common import BROADCAST_ROWS, as_bytes, forget, join_unique, release, slices, stored
from skipjack.llm.components import connected_components
from skipjack.llm.windows import Words, mixed

SHINGLE, DISTANCE, SEED = 3, 3, 42
FAN = 8
#: Pairs of nodes, or of fingerprints, compared at once; fingerprints of a bucket.
CHUNK, BUCKET_ROWS = 1 << 19, 1 << 16
#: Samples of a document's shingles, and shingles in a sample; documents compared with one text at a time.
SAMPLES, DRAWN, COMPARED = 10, 3, 2000
#: Rows whose shingles are counted for the order, and frequent shingles of it; sets of a bucket in one task.
COUNTED, FREQUENT, DEALT = 5000, 50_000, 20_000
#: Rounds of the exact join; bytes of parities that a task holds of whole buckets, and compares at once.
ROUNDS, HELD_BYTES, PARITY_BYTES = 3, 32_000_000, 16_000_000


def _shingles(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(XXH64 of every shingle as 8 bytes, number of shingles of each text)."""
    import xxhash

    words = Words([t.lower() for t in texts])
    line = b" ".join(words.whole.split())
    sizes = words.ends - words.starts
    begin = np.cumsum(sizes + 1) - sizes - 1
    end = begin + sizes
    count = np.diff(words.bounds)
    n = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    owner = np.repeat(np.arange(len(texts)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + words.bounds[:-1][owner]
    last = at + np.minimum(count[owner], size) - 1
    digest = xxhash.xxh64_digest
    keys = b"".join([digest(line[s:e], SEED) for s, e in zip(begin[at].tolist(), end[last].tolist(), strict=True)])
    return np.frombuffer(keys, np.uint8).reshape(-1, 8), n


def _majorities(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.zeros(len(n), np.uint64)
    first = np.cumsum(n) - n
    for k in np.flatnonzero(n):
        # One text's bits at a time: a long text takes 64 bytes a shingle.
        ones = np.unpackbits(keys[first[k] : first[k] + n[k]], axis=1).sum(axis=0, dtype=np.int32)
        out[k] = np.packbits(2 * ones > n[k]).view(">u8")[0]
    return out


def _samples(keys: np.ndarray, n: np.ndarray, samples: int = SAMPLES, drawn: int = DRAWN) -> np.ndarray:
    """(texts with shingles, samples): a key per sample of least hashes under seeded orders."""
    full = np.flatnonzero(n)
    h = keys.view(">u8").ravel().astype(np.uint64)
    first = (np.cumsum(n) - n)[full]
    odd = np.random.default_rng(SEED).integers(0, 2**63, (samples, drawn + 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros((len(full), samples), np.uint64)
    for s in range(samples):
        for d in range(drawn):
            out[:, s] += np.minimum.reduceat(mixed(h * odd[s, d]), first) * odd[s, (d + 1)]
    return mixed(out)


def _sets(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle hash) of the distinct shingles of each text, in order of text and hash."""
    h, owner = keys.view(">u8").ravel().astype(np.uint64), np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])))[: len(h)]
    return owner[new], h[new]


def needed(size: np.ndarray, other: np.ndarray, similarity: float) -> np.ndarray:
    """Least number of members two sets of these sizes share at that similarity."""
    return np.ceil(similarity / (1 + similarity) * (size + other) - 1e-6).astype(np.int64)


def prefixes(owner: np.ndarray, h: np.ndarray, sizes: np.ndarray, similarity: float, often: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(first shingles of each set in the common order, their number): rare ones first. often: (sorted hashes, counts)."""
    known, counts = often
    count = np.zeros(len(h), np.int64)
    if len(known) and len(h):
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        count = np.where(known[at] == h, counts[at], 0)
    order = np.lexsort((h, count, owner))
    most = np.where(sizes > 0, sizes - np.ceil(similarity * sizes - 1e-6).astype(np.int64) + 1, 0)
    place = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return h[order][place < np.repeat(most, sizes)], most


def parities(owner: np.ndarray, h: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Per set the parities of its members' numbers in 2 ** k cells by hash; cells grow with the set."""
    cells = 1 << np.ceil(np.log2(np.clip(3 * sizes, 64, 1 << 17))).astype(np.int64)
    first = np.cumsum(cells) - cells
    at = first[owner] + (h & (cells[owner] - 1).astype(np.uint64)).astype(np.int64)
    whole = np.packbits(np.bincount(at, minlength=int(cells.sum())).astype(np.uint8) & 1, bitorder="little").tobytes()
    return [whole[a : a + c] for a, c in zip((first >> 3).tolist(), (cells >> 3).tolist(), strict=True)]


def frequent(docs: DataFrame, text_col: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, counts) of the shingles of several rows in a sample; they only order the shingles."""
    rows = docs.count()
    some = docs.select(F.col(text_col).cast("string").alias("text"))
    some = some.sample(COUNTED / rows, SEED) if rows > COUNTED else some

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([pa.array(_sets(*_shingles(as_bytes(part.column("text")), size))[1].view(np.int64))], names=["h"])

    found = some.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(FREQUENT).collect()
    known = np.array([r["h"] for r in found], np.int64).view(np.uint64)
    order = np.argsort(known)
    return known[order], np.array([r["n"] for r in found], np.int64)[order]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, row_col: str | None = None, similarity: float | None = None) -> DataFrame:
    """(doc_id, row, fp long) per row; with a similarity also samples, and of the shingle set a hash, its size, prefix and parities."""
    often = frequent(docs, text_col, size) if similarity is not None else None

    def lists(values: np.ndarray, per: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(per))), pa.int32()), pa.array(values.view(np.int64).ravel()))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                keys, n = _shingles(as_bytes(part.column("text")), size)
                out = {"doc_id": part.column("doc_id"), "row": part.column("row"), "fp": pa.array(_majorities(keys, n).view(np.int64))}
                if often is not None:
                    drawn = _samples(keys, n) if n.any() else np.zeros((0, SAMPLES), np.uint64)
                    owner, h = _sets(keys, n)
                    sizes = np.bincount(owner, minlength=len(n))
                    whole = np.zeros(len(n), np.uint64)
                    np.add.at(whole, owner, mixed(h))
                    prefix, most = prefixes(owner, h, sizes, similarity, often)
                    out |= {"samples": lists(drawn, np.where(n > 0, SAMPLES, 0)), "whole": pa.array(whole.view(np.int64)), "size": pa.array(sizes), "prefix": lists(prefix, most), "bits": pa.array(parities(owner, h, sizes), pa.binary())}
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    more = ", samples array<long>, whole long, size long, prefix array<long>, bits binary" if often is not None else ""
    return _texts(docs, id_col, text_col, row_col).mapInArrow(run, f"doc_id long, row long, fp long{more}")


def _texts(docs: DataFrame, id_col: str, text_col: str, row_col: str | None) -> DataFrame:
    row = F.col(row_col).cast("long") if row_col else F.monotonically_increasing_id()
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), row.alias("row"))


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Place of a code word in the reflected Gray sequence."""
    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Hierarchy over fingerprints sorted by (bucket, Gray rank); nodes never span buckets."""

    def __init__(self, bucket: np.ndarray, fp: np.ndarray, fan: int = FAN):
        order = np.lexsort((gray_rank(fp), bucket))
        self.fp, self.fan = fp[order], fan
        n = len(fp)
        self.owner = [bucket[order]]
        self.mask, self.value = [np.full(n, ~np.uint64(0))], [self.fp]
        self.first, self.last = [], []
        while True:
            owner = self.owner[-1]
            edge = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            if len(edge) == len(owner):
                break  # one node a bucket
            inside = np.arange(len(owner)) - np.repeat(edge, np.diff(np.concatenate((edge, [len(owner)]))))
            first = np.flatnonzero(inside % fan == 0)
            both = np.bitwise_and.reduceat(self.value[-1], first)
            either = np.bitwise_or.reduceat(self.value[-1], first)
            self.mask.append(np.bitwise_and.reduceat(self.mask[-1], first) & ~(both ^ either))
            self.value.append(both)
            self.first.append(first)
            self.last.append(np.concatenate((first[1:], [len(owner)])))
            self.owner.append(owner[first])

    def links(self, distance: int = DISTANCE) -> np.ndarray:
        """The least member (by place) each member reaches over links of at most `distance` bits in its bucket."""
        label = np.arange(len(self.fp))
        top = len(self.mask) - 1
        roots = np.arange(len(self.mask[top]))
        stack = [(top, roots, roots)] if top else []
        spans = self._labels(label)
        while stack:
            level, a, b = stack.pop()
            # A pair of nodes has up to fan * fan pairs of children.
            if len(a) > (max(1, CHUNK // self.fan**2) if level else CHUNK):
                half = len(a) // 2
                stack += [(level, a[:half], b[:half]), (level, a[half:], b[half:])]
                continue
            if level:
                low, high = spans[level]
                done = (low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b])
                a, b = a[~done], b[~done]
                a, b = self._children(level, a, b)
                level -= 1
            far = np.bitwise_count((self.value[level][a] ^ self.value[level][b]) & self.mask[level][a] & self.mask[level][b])
            near = far <= distance
            a, b = a[near], b[near]
            if not len(a):
                continue
            if level:
                stack.append((level, a, b))
            else:
                apart = label[a] != label[b]
                if apart.any():
                    label = united(label, a[apart], b[apart])
                    spans = self._labels(label)
        return label

    def _children(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, last = self.first[level - 1], self.last[level - 1]
        na, nb = last[a] - first[a], last[b] - first[b]
        each = na * nb
        pair = np.repeat(np.arange(len(a)), each)
        k = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        x, y = first[a][pair] + k // nb[pair], first[b][pair] + k % nb[pair]
        keep = (x < y) | ((x == y) if level > 1 else False)
        keep |= (a != b)[pair]
        return x[keep], y[keep]

    def _labels(self, label: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out = [(label, label)]
        for first in self.first:
            low, high = out[-1]
            out.append((np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)))
        return out


def united(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the sets of a and b; labels are least members. Only the sets met are worked on, then renamed in one pass."""
    roots, place = np.unique(np.concatenate((label[a], label[b])), return_inverse=True)
    x, y, own = place[: len(a)], place[len(a) :], np.arange(len(roots))
    while True:
        low, high = np.minimum(own[x], own[y]), np.maximum(own[x], own[y])
        if (low == high).all():
            break
        np.minimum.at(own, high, low)
        while (own[own] != own).any():
            own = own[own]
    new = np.arange(len(label))
    new[roots] = roots[own]
    return new[label]


def submasks(mask: int, groups: int) -> list[int]:
    """The mask's free bits dealt into groups of neighbours, low bits first; each group joined to the mask."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(free) * k // groups for k in range(groups + 1)]
    return [mask | sum(1 << b for b in free[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _routes(masks: list[int], number: Column | None = None, groups: int = 1) -> Column:
    """(m, key) of a fingerprint for every mask, or for the `groups` masks that follow from mask `number`."""
    key = lambda i: F.struct(F.lit(i).alias("m"), F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(masks[i])))).alias("key"))
    if number is None:
        return F.array(*[key(i) for i in range(len(masks))])
    of = F.array(*[F.lit(_signed(x)) for x in masks])
    child = lambda k: (number * groups + k).cast("int")
    return F.array(*[F.struct(child(k).alias("m"), F.xxhash64(child(k), F.col("fp").bitwiseAND(F.element_at(of, child(k) + 1))).alias("key")) for k in range(groups)])


def bucketed(distinct: DataFrame, distance: int = DISTANCE, most: int = BUCKET_ROWS) -> DataFrame:
    """distinct(fp) -> (fp, key): every link meets in a bucket, and no bucket holds more than `most` fingerprints.

    A bucket above `most` is dealt on: its fingerprints differ in at most `distance` of the bits that are still free, so
    of distance + 1 groups of these one is equal. Free bits run out at some depth, and so does the room for a hot bucket.
    """
    groups = distance + 1
    most = max(most, 1 << groups)  # from here on no group of free bits is empty
    masks = [m for top in submasks(0, groups) for m in submasks(top, groups)]
    routed = distinct.select("fp", F.explode(_routes(masks)).alias("r")).select("fp", "r.m", "r.key")
    if distinct.count() <= most:
        return routed.select("fp", "key")
    done = None
    while True:
        hot = stored(routed.groupBy("m", "key").agg(F.count("*").alias("n")).where(F.col("n") > most).select("m", "key"), "hot-buckets")
        # At most rows / most keys.
        few = hot.count()
        sent = F.broadcast(hot) if few <= BROADCAST_ROWS else hot
        cool = (routed.join(sent, ["m", "key"], "left_anti") if few else routed).select("fp", "key")
        done = cool if done is None else done.unionByName(cool)
        if not few:
            return done
        masks = [m for top in masks for m in submasks(top, groups)]
        routed = routed.join(sent, ["m", "key"], "left_semi").select("fp", F.explode(_routes(masks, F.col("m"), groups)).alias("r")).select("fp", "r.m", "r.key")


def bucket_links(distinct: DataFrame, distance: int = DISTANCE, most: int = BUCKET_ROWS) -> DataFrame:
    """distinct(fp) -> (u, v): links that span every bucket's linked sets."""
    n = max(1, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    routed = bucketed(distinct, distance, most).repartition(n, "key").sortWithinPartitions("key")

    def solve(key: np.ndarray, fp: np.ndarray):
        lone = np.concatenate(([True], key[1:] != key[:-1])) & np.concatenate((key[1:] != key[:-1], [True]))
        key, fp = key[~lone], fp[~lone]
        if not len(key):
            return None
        index = GrayIndex(key, fp.view(np.uint64))
        label = index.links(distance)
        joined = label != np.arange(len(label))
        u, v = index.fp[joined].view(np.int64), index.fp[label[joined]].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    def run(batches):
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            key = np.concatenate((key, batch.column("key").to_numpy()))
            fp = np.concatenate((fp, batch.column("fp").to_numpy()))
            if len(key) >= 1 << 18:  # whole buckets only; the last may go on
                cut = int(np.searchsorted(key, key[-1]))
                if cut and (out := solve(key[:cut], fp[:cut])) is not None:
                    yield out
                key, fp = key[cut:], fp[cut:]
        if len(key) and (out := solve(key, fp)) is not None:
            yield out

    return routed.select("fp", "key").mapInArrow(run, "u long, v long")


def alike(one: list[bytes], other: list[bytes], size: int) -> np.ndarray:
    """Jaccard similarity of the shingle sets of each pair of texts; two empty sets: 1."""
    keys, n = _shingles([*one, *other], size)
    pair = np.repeat(np.arange(len(n)) % len(one), n)
    side = np.repeat(np.arange(len(n)) >= len(one), n)
    h = keys.view(">u8").ravel().astype(np.uint64)
    order = np.lexsort((side, h, pair))
    pair, side, h = pair[order], side[order], h[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (pair[1:] != pair[:-1])))[: len(h)]
    both = np.concatenate(([False], (h[1:] == h[:-1]) & (pair[1:] == pair[:-1]) & (side[1:] != side[:-1])))[: len(h)]
    total, shared = np.bincount(pair[new], minlength=len(one)), np.bincount(pair[both], minlength=len(one))
    return np.where(total > 0, shared / np.maximum(total, 1), 1.0)


def sample_links(texts: DataFrame, own: DataFrame, firsts: DataFrame, similarity: float, size: int) -> DataFrame:
    """Links (u, v) between fingerprints that a common sample shows: firsts(fp, row, samples), one row per fingerprint."""
    drawn = firsts.select("fp", "row", F.posexplode("samples").alias("s", "key"))
    groups = stored(drawn.groupBy("s", "key").agg(F.min("row").alias("to"), F.count("*").alias("n")).where("n > 1"), "sample-groups")
    pairs = stored(join_unique(drawn, groups, ["s", "key"]).where(F.col("row") != F.col("to")).select("row", "to").distinct(), "sample-pairs")
    links = compared(texts, own, pairs, similarity, size)
    forget(groups, pairs)
    return links.select("u", "v")


def compared(texts: DataFrame, own: DataFrame, pairs: DataFrame, similarity: float, size: int) -> DataFrame:
    """Links (u, v, row, to) between the fingerprints of those pairs(row, to) whose texts are alike: texts(doc_id, text, row), own(doc_id, row, fp)."""
    met = stored(pairs.select("row").unionByName(pairs.select(F.col("to").alias("row"))).distinct(), "met-rows")
    # All columns of the first reading, so that the rows are numbered alike.
    held = stored(own.select("fp", "row", F.col("doc_id").alias("id")).join(met, "row").join(texts, "row"), "met-texts")
    if held.where(F.col("id").eqNullSafe(F.col("doc_id"))).count() != met.count():
        raise RuntimeError("the source gave other partitions on its second reading; store it first")
    forget(met)
    # A text that many are compared with is sent once per COMPARED of them, each time to another task.
    per = stored(pairs.groupBy("to").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / COMPARED)), "met-firsts")
    first = per.select(F.col("to").alias("row"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(held, "row")
    first = first.select(F.col("row").alias("to"), F.col("part").cast("long").alias("part"), F.col("fp").alias("v"), F.col("text").alias("other"))
    dealt = join_unique(pairs, per, ["to"]).select("row", "to", F.pmod(F.xxhash64("row"), F.col("parts")).cast("long").alias("part"))
    both = dealt.join(held.select("fp", "row", "text"), "row").join(first, ["to", "part"]).select(F.col("fp").alias("u"), "v", "row", "to", "text", "other")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "other", 2_000_000):
                for piece in slices(part, "text", 2_000_000):
                    near = alike(as_bytes(piece.column("text")), as_bytes(piece.column("other")), size) >= similarity
                    yield piece.select(["u", "v", "row", "to"]).filter(pa.array(near))

    links = stored(both.mapInArrow(run, "u long, v long, row long, to long"), "text-links")
    forget(held, per)
    return links


def meetings(key: np.ndarray, row: np.ndarray, root: np.ndarray, size: np.ndarray, place: np.ndarray, similarity: float):
    """Pairs of rows (less, greater) of different roots in one bucket (key) that sizes and places allow; arrays at a time.

    place: how many shingles stand before the bucket's in the set's order. A bucket goes through its pairs of different roots, or
    through its pairs of fitting sizes if these are fewer.
    """
    order = np.lexsort((size, root, key))
    key, row, root, size, place = key[order], row[order], root[order], size[order], place[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))[: len(key)]
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(key))
    mixed_roots = np.repeat(root[start] != root[end - 1], end - start)
    key, row, root, size, place, new = (x[mixed_roots] for x in (key, row, root, size, place, new))
    if not len(key):
        return
    start = np.flatnonzero(new)
    of = np.cumsum(new) - 1
    end = np.append(start[1:], len(key))
    turn = np.flatnonzero(np.concatenate(([True], new[1:] | (root[1:] != root[:-1]))))
    run_end = np.repeat(np.append(turn[1:], len(key)), np.diff(np.append(turn, len(key))))
    by_size = np.lexsort((size, of))
    ranked = (of << 40) + size[by_size]  # buckets keep their places
    upto = np.searchsorted(ranked, (of << 40) + np.floor(size[by_size] / similarity + 1e-6).astype(np.int64), "right")
    inside = np.arange(len(key))
    plans = [(inside, run_end, end[of] - run_end), (by_size, inside + 1, upto - inside - 1)]
    fewer = (np.add.reduceat(plans[1][2], start) < np.add.reduceat(plans[0][2], start))[of]
    for k, (names, first, count) in enumerate(plans):
        count = np.where(fewer == bool(k), count, 0)
        total = np.cumsum(count)
        at = 0
        while at < len(count):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + CHUNK, "right")))
            n = count[at:to]
            if n.any():
                x = names[np.repeat(np.arange(at, to), n)]
                y = names[np.repeat(first[at:to], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                low, high = np.minimum(size[x], size[y]), np.maximum(size[x], size[y])
                most = np.minimum(place[x], place[y]) + 1 + np.minimum(size[x] - place[x], size[y] - place[y]) - 1
                keep = (root[x] != root[y]) & (low >= similarity * high - 1e-6) & (most >= needed(low, high, similarity))
                if keep.any():
                    a, b = row[x[keep]], row[y[keep]]
                    yield np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0)
            at = to


def apart(one: list[bytes], other: list[bytes]) -> np.ndarray:
    """Least number of members in one of two sets only, by their parities; the finer is folded to the coarser's cells."""
    out = np.zeros(len(one), np.int64)
    a, b = np.array([len(x) for x in one]), np.array([len(x) for x in other])
    for m, n in {*zip(a.tolist(), b.tolist(), strict=True)}:
        at = np.flatnonzero((a == m) & (b == n))
        k = min(m, n)
        x, y = (np.bitwise_xor.reduce(np.frombuffer(b"".join(side[i] for i in at), np.uint8).reshape(len(at), -1, k), axis=1) for side in (one, other))
        out[at] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return out


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of the links of a spanning forest; of the links (a, b) those that stand first are preferred."""
    names, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b, label = place[: len(a)], place[len(a) :], np.arange(len(names))
    left, chosen = np.arange(len(a)), np.zeros(len(a), bool)
    while True:
        left = left[label[a[left]] != label[b[left]]]
        if not len(left):
            return np.flatnonzero(chosen)
        best = np.full(len(names), len(a))
        np.minimum.at(best, label[a[left]], left)
        np.minimum.at(best, label[b[left]], left)
        pick = np.unique(best[best < len(a)])
        chosen[pick] = True
        label = united(label, a[pick], b[pick])


def partners(key: np.ndarray, root: np.ndarray, size: np.ndarray, place: np.ndarray, similarity: float) -> np.ndarray:
    """Which entries of the buckets have a partner of another root that sizes and places allow."""
    out = np.zeros(len(key), bool)
    for found in meetings(key, np.arange(len(key)), root, size, place, similarity):
        out[found.ravel()] = True
    return out


def spanned(key: np.ndarray, row: np.ndarray, root: np.ndarray, size: np.ndarray, place: np.ndarray, bits: list[bytes], failed: list, similarity: float, whole: bool = False):
    """(key, row, to) arrays at a time: in each bucket a forest between the roots over the pairs that sizes, places and parities allow, or (whole) all these.

    The nearest by their parities come first. failed: of each entry the rows greater than its own that it is known not to be like.
    """
    order = np.lexsort((root, key))
    node = np.empty(len(key), np.int64)  # a root in a bucket
    node[order] = np.cumsum(np.concatenate(([True], (key[order][1:] != key[order][:-1]) | (root[order][1:] != root[order][:-1])))[: len(key)])
    width = np.array([len(x) for x in bits], np.int64)
    lists = {int(r): f for r, f in zip(row, failed, strict=True) if f is not None and len(f)}
    names = np.unique(np.concatenate([row, *lists.values()]))
    number = lambda r: np.searchsorted(names, r)
    wrong = np.concatenate([np.zeros(0, np.int64), *(number(r) * len(names) + number(np.asarray(f)) for r, f in lists.items())])
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]

    def least():
        x, y, far = held
        order = np.lexsort((np.maximum(row[x], row[y]), np.minimum(row[x], row[y]), far))
        order = order[forest(node[x[order]], node[y[order]])]
        return [a[order] for a in held]

    def rows(x, y):
        return key[x], np.minimum(row[x], row[y]), np.maximum(row[x], row[y])

    for found in meetings(key, np.arange(len(key)), root, size, place, similarity):
        used = np.cumsum(width[found].sum(axis=1))
        for piece in np.split(found, np.flatnonzero(np.diff(used // PARITY_BYTES)) + 1):
            x, y = piece.T
            far = apart([bits[i] for i in x], [bits[i] for i in y])
            keep = far <= size[x] + size[y] - 2 * needed(size[x], size[y], similarity)
            if len(wrong) and keep.any():
                keep &= ~np.isin(number(np.minimum(row[x], row[y])) * len(names) + number(np.maximum(row[x], row[y])), wrong)
            if not keep.any():
                continue
            x, y, far = x[keep], y[keep], far[keep]
            if whole:
                yield rows(x, y)
                continue
            held = [np.concatenate((a, b)) for a, b in zip(held, (x, y, far / (size[x] + size[y])), strict=True)]
            if len(held[0]) > CHUNK:
                held = least()
    if len(held[0]):
        yield rows(*least()[:2])


def joined_roots(texts: DataFrame, own: DataFrame, roots: DataFrame, similarity: float, size: int) -> DataFrame:
    """roots(u, root), joined further by all links that the similarity gives: own as of fingerprints."""
    spark = own.sparkSession
    # Equal sets with an equal fingerprint count once.
    sets = stored(own.where("size > 0").groupBy("fp", "whole").agg(F.min("row").alias("row")).select("fp", "row"), "sets")

    def rooted() -> DataFrame:
        return stored(sets.join(roots.withColumnRenamed("u", "fp"), "fp", "left").select("row", F.coalesce("root", "fp").alias("root")), "set-roots")

    of = rooted()
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    entries = own.select("row", "size", "prefix").join(of, "row").select("row", "root", "size", F.posexplode("prefix").alias("place", "key"))
    # A sample of the sets tells the buckets that are dealt; a bucket that it misses is only slower.
    part = max(1, min(64, DEALT // 100))
    if sets.count() > DEALT:
        seen = entries.where(F.pmod(F.xxhash64("row"), F.lit(part)) == 0).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > DEALT // part // 2)
        hot = stored(seen.select("key", F.ceil(F.col("n") * part / DEALT + 1).alias("parts")), "hot-prefixes")
        if not hot.isEmpty():
            own_part = F.pmod(F.xxhash64("row"), F.col("parts"))
            dealt = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda o: F.xxhash64("key", F.least(own_part, o), F.greatest(own_part, o)))
            entries = entries.join(F.broadcast(hot), "key", "left").select("row", "root", "size", "place", F.explode(F.when(F.col("parts").isNull(), F.array("key")).otherwise(dealt)).alias("key"))
    names = ["key", "row", "root", "size", "place"]
    by_key = lambda df, *more: df.select(*[F.col(c).cast("long") for c in names], *more).repartition(n, "key").sortWithinPartitions("key")

    def buckets(batches, limit: int):
        """Record batches cut to whole buckets (the last may go on) of about `limit` bytes together."""
        now = None
        for batch in batches:
            now = pa.Table.from_batches([batch] if now is None else [*now.to_batches(), batch])
            if now.nbytes >= limit:
                key = now.column("key").to_numpy()
                cut = int(np.searchsorted(key, key[-1]))
                if cut:
                    yield now.slice(0, cut)
                now = now.slice(cut).combine_chunks()
        if now is not None and now.num_rows:
            yield now

    def meeting(batches):
        for found in buckets(batches, 40 << 18):
            key, row, root, many, place = (found.column(c).to_numpy() for c in names)
            keep = partners(key, root, many, place, similarity)
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, row, place)], names=["key", "row", "place"])

    held = stored(by_key(entries).mapInArrow(meeting, "key long, row long, place long"), "met-entries")
    known = stored(own.select("row", "size", "bits").join(held.select("row").distinct(), "row"), "met-sets")
    release(spark)
    failed = None
    for turn in range(ROUNDS):
        whole = turn == ROUNDS - 1

        def spanning(batches, whole=whole):
            for found in buckets(batches, HELD_BYTES):
                parts = [found.column(c).to_numpy() for c in names]
                for out in spanned(*parts, found.column("bits").to_pylist(), found.column("failed").to_pylist(), similarity, whole):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["key", "row", "to"])

        side = known.join(of, "row")
        if failed is None:
            side = side.withColumn("failed", F.lit(None).cast("array<long>"))
        else:
            side = side.join(failed.groupBy("row").agg(F.collect_list("to").alias("failed")), "row", "left")
        edges = stored(by_key(held.join(side, "row"), "bits", "failed").mapInArrow(spanning, "key long, row long, to long"), "met-links")
        pairs = stored(edges.select("row", "to").distinct(), "met-pairs")
        if pairs.isEmpty():
            break
        links = compared(texts, own, pairs, similarity, size)
        before, roots = roots, connected_components(roots.select("u", F.col("root").alias("v")).unionByName(links.select("u", "v")))
        wrong = stored(pairs.join(links.select("row", "to"), ["row", "to"], "left_anti"), "failed-pairs")
        forget(before, links, pairs, of)
        release(spark)
        if whole or wrong.isEmpty():
            break
        # Only buckets with a link that failed are open.
        again = stored(held.join(edges.join(wrong, ["row", "to"], "left_semi").select("key").distinct(), "key", "left_semi"), "met-entries")
        forget(held, edges)
        held, of = again, rooted()
        failed = wrong if failed is None else failed.unionByName(wrong)
    forget(sets, held, known)
    return roots


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, distance: int = DISTANCE, similarity: float | None = None, row_col: str | None = None) -> DataFrame:
    """doc_id, row, fp long, fingerprint (16 hex digits), component_id (least doc_id of the group) per row.

    `row` is row_col (distinct numbers) or else numbers the rows of docs over its partitions.
    """
    spark = docs.sparkSession
    own = stored(fingerprints(docs, id_col, text_col, size, row_col, similarity), "fingerprints")
    first = [F.min("row").alias("row"), F.min_by("samples", "row").alias("samples")] if similarity is not None else []
    per_fp = stored(own.groupBy("fp").agg(F.min("doc_id").alias("least"), *first), "distinct-fingerprints")
    found = bucket_links(per_fp.select("fp"), distance)
    if similarity is not None:
        texts = _texts(docs, id_col, text_col, row_col)
        found = found.unionByName(sample_links(texts, own, per_fp, similarity, size))
    links = stored(found.distinct(), "links")
    release(spark)
    roots = connected_components(links)
    forget(links)
    if similarity is not None:
        roots = joined_roots(texts, own, roots, similarity, size)
    rooted = stored(per_fp.select("fp", "least").join(roots.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    of_root = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "components")
    groups = stored(join_unique(rooted, of_root, ["root"]).select("fp", "component_id"), "groups")
    forget(rooted, of_root, roots)
    # A fingerprint may belong to a third of all rows.
    counted = stored(own.groupBy("fp").agg(F.count("*").alias("n")).join(groups, "fp"), "groups")
    forget(groups, per_fp)
    release(spark)
    out = join_unique(own.select("doc_id", "row", "fp"), counted, ["fp"])
    return out.select("doc_id", "row", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
