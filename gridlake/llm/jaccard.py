"""N-gram Jaccard join: which texts share at least 75 % of their word shingles, and the groups that such links make.

Exact, without comparing all pairs of anything that grows:

1. Texts with equal sets are one class, named by a 64-bit hash of the set (its lowest bit is clear).
2. Of each class, the shingles with the lowest 35 % of hashes (and more for small sets) are counted over the corpus. A
   set of n can lack at most n - ceil(3n/4) of its shingles in a partner; with more than that missing from all others
   it has no link and goes no further. For the rest, shingles are ordered from rare to common, and two linked sets share
   one of their first n - ceil(3n/4) + 1. Shingles that are very common already within one batch of texts never meet in
   one task: they are marked as common, and their texts are spread.
3. Where a rare first shingle meets several sets, hashed bitmaps (one to two bits a shingle, their widths in bands of
   size; a wider one folds to a narrower) bound each overlap from above. Sets that can be linked are joined in a
   forest, so a task writes fewer edges than it has sets. Common shingles give one edge to a node of their own.
   Components of these edges are families: every link lies within one.
4. A family is cut into tiles of bounded size by bands of set size, a factor of 4/3 each, and within a band by hash. In a
   tile, sets by ascending size are compared where sizes and bitmaps allow it and they are not connected yet, by
   intersecting sorted arrays. In families of several tiles the leaders of the tiles' groups are compared next; then the
   sets outside the family's largest group are taken in blocks against the tiles of their own and the two neighbouring
   bands (others are of sizes that cannot link), so that no pair of unconnected sets goes unseen.

What a task gets and what is shuffled for a set depends on the set, not on the number of tasks. Tables of a step are
removed once the next one is written.

Defined results: a null or empty text, or one without words, has no shingles and links with nothing; fewer than n words
are one shingle; rows that share a text are linked, rows that share an id only where their texts link; a null id is as
any other, its component is the least id that is not null, if there is one; further columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import texts
from .components import components
from .shared import apart, spent, table, width

N = 5
NUM, DEN = 3, 4  # the least similarity
PART = np.uint64(int(0.35 * 2**64))  # hashes below are counted over the corpus
COMMON_HERE = 64  # texts of a batch
COMMON = 2048  # sets of the corpus
TILE_SETS, TILE_BYTES = 1024, 16_000_000
BLOCK_SETS = 512
ENTRIES_A_TASK = 1_500_000
DEALT_AT_ONCE = 300_000  # entries that a task gathers before it deals them out
SLICE_BYTES = 4_000_000  # of texts whose shingles are in memory at once
FILTER_BITS = 1 << 26
_EVEN = np.uint64((1 << 64) - 2)
_ODD = np.uint64(1)
_SALT = np.uint64(0xA0761D6478BD642F)


def least_overlap(n):
    return -(-NUM * n // DEN)


def linked(overlap, a, b):
    """Whether an overlap is enough for sets of a and b."""
    return (DEN + NUM) * overlap >= NUM * (a + b)


class Sets:
    """Distinct shingles of a batch of texts: sorted hashes of each text, sizes and set hashes."""

    def __init__(self, values: pa.Array):
        h, _, first = texts.windows(texts.words(values, lower=True), N)
        owner = np.repeat(np.arange(len(values)), np.diff(first))
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        self.hashes, self.owner = h[new], owner[new]
        self.size = np.bincount(self.owner, minlength=len(values))
        self.first = np.concatenate(([0], np.cumsum(self.size)))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(texts.mix(self.hashes ^ _SALT), dtype=np.uint64)))
        self.name = texts.mix(total[self.first[1:]] - total[self.first[:-1]] ^ self.size.astype(np.uint64)) & _EVEN
        low = self.hashes < PART
        self.counted = np.bincount(self.owner[low], minlength=len(values))


def _blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def set_table(docs: DataFrame) -> DataFrame:
    """doc_id, set (its hash), n, m (shingles that are counted): a row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, values in texts.text_slices(batch, "text", SLICE_BYTES):
                s = Sets(values)
                yield pa.record_batch([part.column(0), pa.array(s.name.view(np.int64)), pa.array(s.size), pa.array(s.counted)], names=["doc_id", "set", "n", "m"])

    return docs.mapInArrow(run, "doc_id long, set long, n long, m long")


def _entries(docs: DataFrame, parts: int) -> DataFrame:
    """Counted shingles by task: bucket, and for each its set, itself, and whether it is common here; common ones apart."""

    def deal(tokens: list[np.ndarray], names: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        token, name = np.concatenate(tokens), np.concatenate(names)
        distinct, inverse, count = np.unique(token, return_inverse=True, return_counts=True)
        common = count[inverse] >= COMMON_HERE
        bucket = (np.where(common, texts.mix(name), texts.mix(token)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        token, name, common, bucket = token[order], name[order], common[order], bucket[order]
        edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        out = [(int(bucket[a]), _blob(name[a:b]), _blob(common[a:b]), _blob(token[a:b]), b"") for a, b in zip(edge, [*edge[1:], len(bucket)], strict=True)]
        marks = distinct[count >= COMMON_HERE]
        mark_bucket = (texts.mix(marks) % np.uint64(parts)).astype(np.int64)
        out += [(int(k), b"", b"", b"", _blob(marks[mark_bucket == k])) for k in np.unique(mark_bucket)]
        columns = list(zip(*out, strict=True))
        yield pa.record_batch([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["bucket", "sets", "common", "tokens", "marks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        tokens: list[np.ndarray] = []
        names: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for _, values in texts.text_slices(batch, "text", SLICE_BYTES):
                s = Sets(values)
                _, one = np.unique(s.name, return_index=True)
                fresh = np.zeros(len(s.name), bool)
                fresh[[k for k in one.tolist() if int(s.name[k]) not in seen]] = True
                if len(seen) < 200_000:  # a set that comes again beyond these is sent again, and counted once
                    seen.update(s.name[fresh].tolist())
                n = s.size
                missing = np.maximum(n - least_overlap(n) + 1 - s.counted, 0)
                rank = np.arange(len(s.hashes)) - s.first[s.owner]
                use = fresh[s.owner] & (rank < (s.counted + missing)[s.owner])
                tokens.append(s.hashes[use])
                names.append(s.name[s.owner[use]])
                held += len(tokens[-1])
                if held >= DEALT_AT_ONCE:
                    yield from deal(tokens, names)
                    tokens, names, held = [], [], 0
        if held:
            yield from deal(tokens, names)

    return docs.select("text").mapInArrow(run, "bucket int, sets binary, common binary, tokens binary, marks binary")


def _join(column: pa.Array, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _edges_of(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1]))) if len(sorted_keys) else np.zeros(0, int)


def _shared(entries: DataFrame, parts: int) -> DataFrame:
    """Of each set the shingles that others have too, with how many sets have them (COMMON + 1: very many)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        name, common, token, marks = (_join(t.column(k), d) for k, d in (("sets", np.uint64), ("common", bool), ("tokens", np.uint64), ("marks", np.uint64)))
        del got, t
        order = np.lexsort((name, token))
        name, token, common = name[order], token[order], common[order]
        keep = np.ones(len(token), bool)
        keep[1:] = (token[1:] != token[:-1]) | (name[1:] != name[:-1])  # a set from several tasks counts once
        name, token, common = name[keep], token[keep], common[keep]
        n = np.diff([*_edges_of(token), len(token)])
        df = np.repeat(n, n)
        df[common | np.isin(token, marks)] = COMMON + 1
        df = np.minimum(df, COMMON + 1).astype(np.uint32)
        use = df > 1
        for k in range(0, len(use), 200_000):
            part = slice(k, k + 200_000)
            own = use[part]
            yield pa.record_batch([pa.array(x[part][own]) for x in (name.view(np.int64), token.view(np.int64), df.astype(np.int32))], names=["set", "token", "df"])

    return entries.repartition(parts, "bucket").mapInArrow(run, "set long, token long, df int")


CANDIDATE = "set long, rep long, n long, rare array<long>, common array<long>"


def _candidates(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """Sets that can have a link: set, rep, n, their first rare shingles and first common ones."""
    found = shared.groupBy("set").agg(F.collect_list(F.struct("token", "df")).alias("shared")).join(classes, "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            held = b.column("shared")
            at = held.offsets.to_numpy()
            tokens, dfs = (held.values.field(k).to_numpy() for k in (0, 1))
            for k, (name, rep, n, m) in enumerate(zip(*(b.column(c).to_pylist() for c in ("set", "rep", "n", "m")), strict=True)):
                token, df = tokens[at[k] : at[k + 1]], dfs[at[k] : at[k + 1]]
                prefix = n - least_overlap(n) + 1
                take = prefix - (m - len(token)) if m >= prefix else len(token)
                if take < 1:
                    continue
                first = np.lexsort((token, df))[:take]
                common = df[first] > COMMON
                out.append((name, rep, n, token[first[~common]], token[first[common]]))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["set", "rep", "n", "rare", "common"])

    return found.mapInArrow(run, CANDIDATE)


def bitmap_bits(n: int) -> int:
    """A band's bitmap width: the power of two from n on, 64 to 2^17."""
    return min(1 << 17, max(64, 1 << (n - 1).bit_length()))


def _bitmap(hashes: np.ndarray) -> bytes:
    bits = np.zeros(bitmap_bits(len(hashes)), np.uint8)
    bits[(hashes % np.uint64(len(bits))).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _sifted(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key may be among ids' keys, before a join drops the rest.

    A Bloom filter of FILTER_BITS bits, however many ids, two bits for each, keeps most other rows out of the join's
    shuffle; when it is full, more of them pass it.
    """
    at = lambda k: F.pmod(F.xxhash64(F.lit(k), F.col(key)), F.lit(FILTER_BITS))
    bits = ids.select(F.explode(F.array(at(1), at(2))).alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    words = np.zeros(FILTER_BITS // 64, np.int64)
    got = bits.toArrow()  # at most FILTER_BITS / 64 rows
    words[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    sent = rows.sparkSession.sparkContext.broadcast(words)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            for column in b.columns[-2:]:
                at = column.to_numpy()
                keep &= (bits[at >> 6].view(np.uint64) >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            yield b.select(range(b.num_columns - 2)).filter(pa.array(keep))

    return rows.select("*", at(1).alias("_at1"), at(2).alias("_at2")).mapInArrow(sift, rows.schema)


ARRAY = "set long, n long, rare array<long>, common array<long>, bitmap binary, items binary"


def _arrays(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates with their bitmap and sorted array. Texts join them by id, after a filter; those of classes that no row
    with an id is in join them by their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part, values in texts.text_slices(batch, "text", SLICE_BYTES):
                s = Sets(values)
                each = [s.hashes[a:b] for a, b in zip(s.first[:-1], s.first[1:], strict=True)]
                # Rows that share an id may have other texts, or the same one again.
                want = []
                for name, said in zip(s.name.view(np.int64).tolist(), part.column("set").to_pylist(), strict=True):
                    want.append(name == said and name not in seen)
                    if want[-1]:
                        seen.add(name)
                out = pa.record_batch([*(part.column(k) for k in ("set", "n", "rare", "common")), pa.array([_bitmap(x) for x in each], pa.binary()), pa.array([_blob(x) for x in each], pa.binary())], names=["set", "n", "rare", "common", "bitmap", "items"])
                yield out.filter(pa.array(want))

    known = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("rep"), "text")
    made = _sifted(known, candidates.filter(F.col("rep").isNotNull()), "rep").join(candidates, "rep").mapInArrow(run, ARRAY)
    nameless = candidates.filter(F.col("rep").isNull())
    if nameless.limit(1).count() == 0:
        return made
    lone = docs.filter(F.col("doc_id").isNull()).select("text")
    by_set = with_set(lone, "set").groupBy("set").agg(F.min("text").alias("text")).join(nameless, "set")
    return made.unionByName(by_set.mapInArrow(run, ARRAY))


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

    def roots(self, of) -> np.ndarray:
        return np.fromiter((self.root(x) for x in of), np.int64, len(of))


class Bitmaps:
    """Bitmaps of some sets by ascending size; bounds overlaps from above."""

    def __init__(self, n: np.ndarray, maps: list[bytes]):
        self.n = n
        self.maps = [np.frombuffer(x, np.uint64) for x in maps]
        self.words = np.array([len(x) for x in self.maps])
        self.folded: dict[int, tuple[int, np.ndarray]] = {}

    def at(self, words: int) -> tuple[int, np.ndarray]:
        """All maps of at least that width folded to it, and the first set they belong to."""
        if words not in self.folded:
            low = int(np.searchsorted(self.words, words))
            self.folded[words] = low, np.stack([np.bitwise_or.reduce(x.reshape(-1, words), axis=0) for x in self.maps[low:]])
        return self.folded[words]

    def may_link(self, k: int, others: np.ndarray) -> np.ndarray:
        """Which of others (all at or after k) can be linked with k."""
        low, rows = self.at(int(self.words[k]))
        own, theirs = rows[k - low], rows[others - low]
        a = self.n[k] - np.bitwise_count(own & ~theirs).sum(axis=1, dtype=np.int64)
        b = self.n[others] - np.bitwise_count(theirs & ~own).sum(axis=1, dtype=np.int64)
        return others[linked(np.minimum(a, b), self.n[k], self.n[others])]


def _edges(arrays: DataFrame, parts: int) -> DataFrame:
    """Edges (a, b) whose components hold all links: between sets whose bitmaps allow a link, and to common shingles."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        t = t.take(pa.array(np.lexsort((t.column("set").to_numpy(), t.column("n").to_numpy(), t.column("token").to_numpy()))))
        token, name, n = (t.column(k).to_numpy() for k in ("token", "set", "n"))
        _, row = np.unique(name, return_inverse=True)
        bitmaps = t.column("bitmap").to_pylist()
        forest = Forest(int(row.max()) + 1)
        out: list[tuple[int, int]] = []
        edge = _edges_of(token).tolist()
        for a, b in zip(edge, [*edge[1:], len(token)], strict=True):
            if b - a < 2:
                continue
            rows = row[a:b].tolist()
            roots = forest.roots(rows)
            if (roots == roots[0]).all():
                continue
            group = Bitmaps(n[a:b], bitmaps[a:b])
            for i in range(len(rows) - 1):
                later = np.arange(i + 1, len(rows))
                later = later[(roots[i + 1 :] != roots[i]) & (NUM * group.n[i + 1 :] <= DEN * group.n[i])]
                if len(later) and len(later := group.may_link(i, later)):
                    for j in later.tolist():
                        if forest.join(rows[i], rows[j]):
                            out.append((int(name[a + i]), int(name[a + j])))
                    roots = forest.roots(rows)
        yield pa.record_batch([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    met = arrays.select("set", "n", "bitmap", F.explode("rare").alias("token")).repartition(parts, "token").mapInArrow(meet, "a long, b long")
    return met.unionByName(arrays.select(F.col("set").alias("a"), F.explode("common").alias("b")).withColumn("b", F.col("b").bitwiseOR(F.lit(1))))


def _groups(keys: list[str]) -> Iterator:
    """A function from batches, sorted by the keys, to (key, table of its rows), one after another."""

    def iterate(batches: Iterator[pa.RecordBatch]):
        held: list[pa.Table] = []
        last = None
        for b in batches:
            columns = [b.column(k).to_pylist() for k in keys]
            key = list(zip(*columns, strict=True))
            start = 0
            for k in range(1, len(key) + 1):
                if k == len(key) or key[k] != key[start]:
                    if held and key[start] != last:
                        yield last, pa.concat_tables(held)
                        held = []
                    held.append(pa.Table.from_batches([b.slice(start, k - start)]))
                    last = key[start]
                    start = k
        if held:
            yield last, pa.concat_tables(held)

    return iterate


def _compare(t: pa.Table, active: np.ndarray, forest: Forest, start: np.ndarray) -> list[tuple[int, int]]:
    """Link sets of a tile (rows by ascending n) where at least one is active; start: the groups so far."""
    n = t.column("n").to_numpy()
    maps = Bitmaps(n, t.column("bitmap").to_pylist())
    items = [np.frombuffer(x, np.uint64) for x in t.column("items").to_pylist()]
    out = []
    for i in range(len(n) - 1):
        if not active[i] and not active[i + 1 :].any():
            continue
        high = int(np.searchsorted(NUM * n, DEN * n[i], "right"))
        later = np.arange(i + 1, high)
        if not active[i]:
            later = later[active[later]]
        own = forest.root(int(start[i]))
        roots = forest.roots(start[later].tolist())
        later = later[roots != own]
        if not len(later):
            continue
        for j in maps.may_link(i, later).tolist():
            if forest.root(int(start[i])) == forest.root(int(start[j])):
                continue
            at = np.searchsorted(items[j], items[i])
            overlap = np.count_nonzero(items[j][np.minimum(at, len(items[j]) - 1)] == items[i])
            if linked(overlap, len(items[i]), len(items[j])):
                forest.join(int(start[i]), int(start[j]))
                out.append((i, j))
    return out


def _by_size(t: pa.Table) -> pa.Table:
    return t.take(pa.array(np.lexsort((t.column("set").to_numpy(), t.column("n").to_numpy()))))


def _tiles(rows: DataFrame) -> DataFrame:
    """rows (family, set, n) with their tile: band, part, and whether the family is wide (has several tiles).

    A family that fits has one tile, of all sizes. Others have bands of size, and each band parts by hash.
    """
    many = lambda: F.greatest(F.ceil(F.count("*") / TILE_SETS), F.ceil(F.sum("n") * 8 / TILE_BYTES)).cast("int")
    sizes = rows.groupBy("family").agg(many().alias("tiles"), F.count("*").alias("members")).filter("members > 1").select("family", (F.col("tiles") > 1).alias("wide"))
    banded = rows.join(apart(sizes), "family").withColumn("band", F.when(F.col("wide"), F.floor(F.ln("n") / np.log(DEN / NUM)).cast("int")).otherwise(F.lit(-1)))
    parts = banded.filter("wide").groupBy("family", "band").agg(many().alias("parts"))
    part = F.pmod(F.xxhash64(F.lit(3), "set"), F.coalesce("parts", F.lit(1))).cast("int")
    return banded.join(apart(parts), ["family", "band"], "left").select("family", "set", "n", "band", part.alias("part"), "wide")


TILE = ["family", "band", "part"]
LOCAL = "family long, set long, local long, n long, wide boolean, bitmap binary, items binary"


def _link_tiles(rows: DataFrame) -> DataFrame:
    """Links inside each tile: every set with the least set of its group there. In wide families those leaders keep their
    bitmap and array, as they are compared again."""
    iterate = _groups(TILE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (family, *_), t in iterate(batches):
            t = _by_size(t)
            name = t.column("set").to_numpy()
            forest = Forest(len(name))
            _compare(t, np.ones(len(name), bool), forest, np.arange(len(name)))
            root = forest.roots(range(len(name)))
            least = np.full(len(name), np.iinfo(np.int64).max)
            np.minimum.at(least, root, name)
            local = least[root]
            again = (name == local) & t.column("wide").to_numpy(zero_copy_only=False)
            kept = [pa.array([x if a else None for x, a in zip(t.column(k).to_pylist(), again, strict=True)], pa.binary()) for k in ("bitmap", "items")]
            yield pa.record_batch([pa.array(np.full(len(name), family)), pa.array(name), pa.array(local), t.column("n").combine_chunks(), t.column("wide").combine_chunks(), *kept], names=["family", "set", "local", "n", "wide", "bitmap", "items"])

    return rows.repartition(width(rows.sparkSession), *TILE).sortWithinPartitions(*TILE).mapInArrow(run, LOCAL)


def _links(members: DataFrame, arrays: DataFrame) -> DataFrame:
    """Edges (a, b), as a table, whose components are the groups of linked sets. members: family, set, n; arrays: set, n,
    bitmap, items. Arrays are joined by set, which no two share, after tiles are known."""
    as_edges = lambda t: t.filter(F.col("set") != F.col("local")).select(F.col("set").alias("a"), F.col("local").alias("b"))
    tiled = table(_tiles(members), "tiles")
    local = table(_link_tiles(tiled.drop("n").join(arrays, "set")), "local-groups")
    if local.filter("wide").limit(1).count() == 0:
        edges = table(as_edges(local), "links")
        spent(tiled, local)
        return edges
    # Leaders of the tiles' groups against each other, in tiles of their own.
    leaders = local.filter(F.col("wide") & (F.col("set") == F.col("local"))).select("family", "set", "n", "bitmap", "items")
    placed = _tiles(leaders.select("family", "set", "n"))
    led = table(_link_tiles(placed.join(leaders.select("set", "bitmap", "items"), "set")), "leader-groups")
    leader = led.select(F.col("set").alias("local"), F.col("local").alias("led"))
    grouped = local.filter("wide").select("family", "set", "local").join(leader, "local", "left")
    groups = table(grouped.select("family", "set", F.coalesce("led", "local").alias("group")), "family-groups")
    # All that is outside the largest group, in blocks, against all of the family whose sizes allow a link.
    size = groups.groupBy("family", "group").agg(F.count("*").alias("size"))
    largest = apart(size.groupBy("family").agg(F.max_by("group", F.struct("size", "group")).alias("largest")))
    at = tiled.filter("wide").select("family", "set", "band", "part").join(groups.drop("family"), "set").join(largest, "family")
    marked = table(at.withColumn("outside", F.col("group") != F.col("largest")).drop("largest"), "marked")
    crossed = _cross(marked, arrays)
    edges = table(as_edges(local).unionByName(as_edges(led)).unionByName(crossed) if crossed is not None else as_edges(local).unionByName(as_edges(led)), "links")
    spent(tiled, local, led, groups, marked)
    return edges


def _cross(marked: DataFrame, arrays: DataFrame) -> DataFrame | None:
    """Edges between groups of wide families: sets outside the largest group, in blocks of a band, meet each tile of their
    own band and of the two beside it. None if there are no such sets."""
    outside = marked.filter("outside")
    if outside.limit(1).count() == 0:
        return None
    blocks = outside.groupBy("family", "band").agg(F.ceil(F.count("*") / BLOCK_SETS).cast("int").alias("blocks"))
    parts = marked.groupBy("family", "band").agg((F.max("part") + 1).alias("parts"))
    # (asking band, its blocks, told band, its tiles), for bands at most one apart
    beside = blocks.withColumn("told", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)))
    meetings = table(beside.join(parts.select("family", F.col("band").alias("told"), "parts"), ["family", "told"]).withColumnRenamed("band", "asked"), "meetings")
    block = F.pmod(F.xxhash64(F.lit(7), "set"), F.col("blocks")).cast("int").alias("block")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["family", "asked", "told", "part", "block"]
    asked = outside.withColumnRenamed("band", "asked").drop("part").join(apart(meetings), ["family", "asked"]).select("family", "asked", "told", each("parts").alias("part"), block, "set", "group", F.lit(True).alias("outside"))
    told = marked.withColumnRenamed("band", "told").join(apart(meetings), ["family", "told"]).select("family", "asked", "told", "part", each("blocks").alias("block"), "set", "group", F.lit(False).alias("outside"))
    needed = marked.join(apart(meetings.select("family", F.col("told").alias("band")).distinct()), ["family", "band"], "left_semi")
    both = asked.unionByName(told).join(_sifted(arrays, needed.select("set"), "set"), "set")
    iterate = _groups(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in iterate(batches):
            t = _by_size(t)
            group = t.column("group").to_numpy()
            distinct, start = np.unique(group, return_inverse=True)
            found = _compare(t, t.column("outside").to_numpy(zero_copy_only=False), Forest(len(distinct)), start)
            yield pa.record_batch([pa.array([int(group[x[k]]) for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return both.repartition(width(marked.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def _labels(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table of sets, and each linked set's group: set, component (the least set of the group)."""
    spark = docs.sparkSession
    sets = table(set_table(docs), "sets")
    classes = sets.filter("n > 0").groupBy("set").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("m").alias("m"))
    total = sets.agg(F.sum("n")).first()[0] or 0
    parts = max(width(spark), -(-int(0.35 * total) // ENTRIES_A_TASK))
    candidates = table(_candidates(_shared(_entries(docs, parts), parts), classes), "candidates")
    arrays = table(_arrays(docs, candidates), "arrays")
    spent(candidates)
    family = components(_edges(arrays, parts))
    members = table(arrays.select("set", "n").join(family.select(F.col("node").alias("set"), F.col("component").alias("family")), "set").distinct(), "members")
    edges = _links(members, arrays.select("set", "n", "bitmap", "items"))
    spent(arrays, members)
    joined = components(edges)
    spent(edges)
    return sets, joined.select(F.col("node").alias("set"), "component")


def with_set(rows: DataFrame, name: str) -> DataFrame:
    """rows with one column more: the set hash of their text; null where it has no shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, values in texts.text_slices(batch, "text", SLICE_BYTES):
                s = Sets(values)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s.name.view(np.int64), mask=s.size == 0)], names=[*part.schema.names, name])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(name, LongType())]))


def groups(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (least document it reaches by links)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets, joined = _labels(docs)
    known = sets.filter("n > 0").groupBy("set").agg(F.min("doc_id").alias("rep"))
    labelled = known.join(joined, "set", "left").withColumn("component", F.coalesce("component", "set"))
    least = labelled.groupBy("component").agg(F.min("rep").alias("component_id"))
    label = apart(labelled.join(apart(least), "component").select("set", "component_id"))
    out = sets.join(label, "set", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, as they are, without all but one of each group: the one with the least id (null is above all
    others), of rows with that id the one with the least set hash, and of those the first text. Rows without shingles
    stay, each of them."""
    spare = lambda name: name if name not in docs.columns else spare(f"_{name}")
    name, key, place = spare("_set"), spare("_key"), spare("_place")
    sets, joined = _labels(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    known = sets.filter("n > 0").select("set", "doc_id").distinct().join(joined, "set", "left")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "set")
    first = known.groupBy(F.coalesce("component", "set").alias("component")).agg(F.min_by(F.struct("doc_id", "set"), order).alias("first"))
    keys = first.select(F.xxhash64("first.doc_id", "first.set").alias(key))
    marked = with_set(docs, name).withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), F.col(name)))
    one = marked.filter(F.col(name).isNotNull()).join(keys, key, "left_semi").withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy("text"))).filter(F.col(place) == 1)
    return one.drop(place).unionByName(marked.filter(F.col(name).isNull())).select(*(F.col(f"`{c}`") for c in docs.columns))
