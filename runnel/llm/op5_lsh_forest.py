"""Near-duplicates by an LSH forest over MinHash signatures.

Texts with equal shingle sets are one class; each class's signature enters several trees. A tree is
an order of the signature's coordinates, and its rows are sorted by them over the whole cluster
(range partitions, so a hot prefix is spread over as many tasks as it needs). Rows that share the
first DEPTH coordinates form a region. In regions of up to FEW rows all pairs are candidates; in
larger ones those next to each other in the order, whose common prefix is the longest there is, so
the depth at which two texts meet adapts to how dense their region is. Candidates are linear in the
rows, and links are confirmed on the full sets.

A second pass makes that exact: where a larger region's members are not yet in one component, the
ones outside its main component are compared with all of its members, first by signature and then on
the full sets, in cells of bounded size that are tasks of their own. Only links that unite
components leave a cell, so its output is linear in its members too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runnel.llm.common import WordSequence, discard_table, documents, fresh_worker, mix, written
from runnel.llm.components import components

#: Trees; the coordinates that rows of a region share.
TREES, DEPTH = 20, 4
#: Coordinates of a signature; the first TREES * DEPTH make the trees' keys.
K = 256
#: Further coordinates (a byte each) by which a tree's rows are sorted.
REST = 60
#: Regions of no more rows have all their pairs as candidates; in larger ones a row meets so many next ones.
FEW, NEXT = 8, 2
#: Rows of a region that meet in one task of the second pass.
CELL = 2048

_RNG = np.random.default_rng(5)
_XOR = _RNG.integers(0, 2**63, K, dtype=np.uint64)
_MUL = _RNG.integers(0, 2**62, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: By tree, the coordinates that follow its own DEPTH ones.
_ORDER = np.array([_RNG.permutation([c for c in range(K) if c // DEPTH != t])[:REST] for t in range(TREES)])


def least_agreement(percent: int, n: int) -> int:
    """In how many of n coordinates two sets of this similarity agree at least, but for 4 standard deviations."""
    p = percent / 100
    return math.floor(n * p - 4 * math.sqrt(n * p * (1 - p)))


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a text of fewer words has its whole sequence as one."""
    found = text.lower().split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    return np.unique(WordSequence(found).runs(min(words, len(found))))


def _lists(flat: np.ndarray, width: int, n: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, width * n + 1, width), pa.int32()), pa.array(flat))


def signed(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (two hashes of the set), sketch (a byte of each coordinate), keys (by tree)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                sets = [shingles(t, words) for t in part.column(1).to_pylist()]
                sizes = np.array([len(s) for s in sets])
                flat = np.concatenate(sets)
                least = np.full((K, len(sets)), 2**64 - 1, np.uint64)
                sums = np.zeros((len(sets), 2), np.uint64)
                if full := np.flatnonzero(sizes).tolist():
                    starts = (np.cumsum(sizes) - sizes)[full]
                    turned = np.empty_like(flat)
                    for k in range(K):
                        np.bitwise_xor(flat, _XOR[k], out=turned)
                        np.multiply(turned, _MUL[k], out=turned)
                        least[k, full] = np.minimum.reduceat(turned, starts)
                    sums[full, 0] = np.add.reduceat(flat, starts)
                    sums[full, 1] = np.bitwise_xor.reduceat(mix(flat), starts)
                sums[:, 1] += sizes.astype(np.uint64)
                least = mix(least).T
                keys = np.tile(np.arange(1, TREES + 1, dtype=np.uint64), (len(sets), 1))
                for d in range(DEPTH):
                    keys = mix(keys * np.uint64(31) + least[:, d : TREES * DEPTH : DEPTH])
                sketch = (least & np.uint64(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(sizes, pa.int64()), pa.array(sums[:, 0].view(np.int64)), pa.array(sums[:, 1].view(np.int64)),
                    pa.array([r.tobytes() for r in sketch], pa.binary()), _lists(keys.view(np.int64).ravel(), TREES, len(sets)),
                ], ["doc_id", "n_shingles", "set_a", "set_b", "sketch", "keys"])

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return kept.mapInArrow(sign, "doc_id long, n_shingles long, set_a long, set_b long, sketch binary, keys array<long>")


def _bytes_of(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def forest_rows(classes: DataFrame) -> DataFrame:
    """doc_id, tree, bucket, rest: every class in every tree, with what its order goes on by."""

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                n, sketch = part.num_rows, _bytes_of(part.column(1), K)
                rest = sketch[:, _ORDER].reshape(n * TREES, REST)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(part.column(0).to_numpy(), TREES)), pa.array(np.tile(np.arange(TREES, dtype=np.int32), n)),
                    part.column(2).flatten(), pa.array([r.tobytes() for r in rest], pa.binary()),
                ], ["doc_id", "tree", "bucket", "rest"])

    return classes.select("doc_id", "sketch", "keys").mapInArrow(plant, "doc_id long, tree int, bucket long, rest binary")


def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that hold all rows of their keys (column key), of rows sorted by it."""
    rest: pa.Table | None = None
    for batch in batches:  # a key's rows may go on in the next batch
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        keys = table["key"].to_numpy()
        cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        if cut:
            yield table.slice(0, cut).combine_chunks()
        rest = table.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def candidates(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b, held): candidates with a < b, and a row with null ends for each region of more than FEW
    rows, or that may go on in another task."""
    least = least_agreement(percent, REST)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        last = None
        for first, table in enumerate(by_key(batches)):
            keys, ids = table["key"].to_numpy(), table["doc_id"].to_numpy()
            rest = _bytes_of(table["rest"], REST)
            borders = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
            sizes = np.diff(borders)
            held = set(keys[borders[:-1]][sizes > FEW].tolist())
            if not first:
                held.add(int(keys[0]))
            last, size, found = int(keys[-1]), np.repeat(sizes, sizes), []
            for gap in range(1, FEW):
                if len(keys) > gap:
                    i = np.flatnonzero((keys[gap:] == keys[:-gap]) & ((size[gap:] <= FEW) | (gap <= NEXT)))
                    i = i[((rest[i] == rest[i + gap]).sum(1) >= least) & (ids[i] != ids[i + gap])]
                    found.append((ids[i], ids[i + gap]))
            a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found)) if found else np.zeros((2, 0), np.int64)
            pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b))), axis=1)
            yield rows_of(pairs, sorted(held))
        if last is not None:
            yield rows_of(np.zeros((2, 0), np.int64), [last])

    def rows_of(pairs: np.ndarray, held: list[int]) -> pa.RecordBatch:
        n, none = pairs.shape[1], pa.nulls(len(held), pa.int64())
        return pa.RecordBatch.from_arrays([*(pa.concat_arrays([pa.array(p, pa.int64()), none]) for p in pairs), pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(held, pa.int64())])], ["a", "b", "held"])

    sorted_ = rows.select(F.col("bucket").alias("key"), "rest", "doc_id").repartitionByRange("key", "rest", "doc_id").sortWithinPartitions("key", "rest", "doc_id")
    return sorted_.mapInArrow(search, "a long, b long, held long")


def agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many coordinates each row of x agrees with each row of y."""
    x, y = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
    same = np.zeros((x.shape[1], y.shape[1]), np.int16)
    for lo in range(0, len(x), 200):  # a byte counts so many
        part = np.zeros(same.shape, np.uint8)
        for k in range(lo, min(lo + 200, len(x))):
            part += (x[k][:, None] == y[k]).view(np.uint8)
        same += part
    return same


class Cell:
    """Members of a region in one task: finds links that unite their components."""

    def __init__(self, table: pa.Table, percent: int):
        self.ids, self.group, self.probe, self.tree = (table[c].to_numpy() for c in ("doc_id", "component", "probe", "tree"))
        self.sketch, self.keys = _bytes_of(table["sketch"], K), table["keys"].combine_chunks().flatten().to_numpy().reshape(-1, TREES)
        self.items, self.percent, self.least = table["items"].combine_chunks(), percent, least_agreement(percent, K)
        self.owner: dict[int, int] = {}

    def root(self, g: int) -> int:
        while (up := self.owner.get(g, g)) != g:
            g = up
        return g

    def linked(self, x: int, y: int) -> bool:
        a, b = (self.items[k].values.to_numpy().view(np.uint64) for k in (x, y))  # as which they are sorted
        if 100 * min(len(a), len(b)) < self.percent * max(len(a), len(b)):
            return False
        p = np.searchsorted(b, a)
        p[p == len(b)] = 0
        both = int((b[p] == a).sum())
        return 100 * both >= self.percent * (len(a) + len(b) - both)

    def links(self) -> list[tuple[int, int]]:
        """Pairs are left to the first tree in which they share a region."""
        out, left, right = [], np.flatnonzero(self.probe == 1), np.flatnonzero(self.probe == 0)
        for p in range(0, len(left), 128):
            for q in range(0, len(right), 1024):
                x, y = left[p : p + 128], right[q : q + 1024]
                other = self.group[x][:, None] != self.group[y]
                i, j = np.nonzero(other & (agreement(self.sketch[x], self.sketch[y]) >= self.least)) if other.any() else ((), ())
                if not len(i):
                    continue
                i, j = x[i], y[j]
                mine = (self.keys[i] == self.keys[j]).argmax(1) == self.tree[i]
                for a, b in zip(i[mine].tolist(), j[mine].tolist()):
                    s, t = self.root(int(self.group[a])), self.root(int(self.group[b]))
                    if s != t and self.linked(a, b):
                        self.owner[s] = t
                        out.append((int(min(self.ids[a], self.ids[b])), int(max(self.ids[a], self.ids[b]))))
        return out


def across(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between members of a region that are in different components, as many as unite them.

    rows: doc_id, tree, bucket, component, n, kinds, main (of the bucket: its size, its number of components and
    the size and id of the largest one), sketch, keys, items. Of two ends in different components
    one at least is outside the main one: such probes meet all members of the bucket, in cells of
    about CELL against CELL rows.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for table in by_key(batches):
            keys = table["key"].to_numpy()
            borders = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True]))).tolist()
            found = [x for lo, hi in zip(borders, borders[1:]) for x in Cell(table.slice(lo, hi - lo), percent).links()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    blocks, stripes = F.ceil(F.col("n") / CELL).cast("int"), F.ceil((F.col("n") - F.col("main.n")) / CELL).cast("int")
    own = lambda count, salt: F.pmod(F.xxhash64("doc_id", "bucket", F.lit(salt)), count).cast("int")
    member = F.transform(F.sequence(F.lit(0), stripes - 1), lambda s: F.struct(F.lit(0).alias("probe"), own(blocks, 0).alias("block"), s.alias("stripe")))
    probes = F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: F.struct(F.lit(1).alias("probe"), b.alias("block"), own(stripes, 1).alias("stripe")))
    cells = F.when(F.col("component") == F.col("main.component"), member).otherwise(F.concat(member, probes))
    dealt = rows.select("doc_id", "tree", "component", "bucket", "sketch", "keys", "items", F.explode(cells).alias("c"))
    dealt = dealt.select(F.xxhash64("bucket", "c.block", "c.stripe").alias("key"), "c.probe", "doc_id", "tree", "component", "sketch", "keys", "items")
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(search, "a long, b long").distinct()


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                found = [shingles(t, words).view(np.int64) for t in part.column(1).to_pylist()]
                ends = np.concatenate(([0], np.cumsum([len(x) for x in found])))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found)))], ["id", "items"])

    return docs.mapInArrow(sets, "id long, items array<long>")


def sets_of(ids: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """The full sets of these documents (id, distinct)."""
    # never broadcast: there are the more ids the more documents there are
    return written(full_sets(texts.join(ids.hint("merge"), "id", "left_semi"), words), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the similarity."""
    left, right = sets.withColumnRenamed("items", "x"), sets.withColumnRenamed("items", "y")
    met = pairs.join(left, pairs.a == left.id).drop("id").join(right, F.col("b") == right.id)
    both = F.size(F.array_intersect("x", "y"))
    return met.where(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b")


def open_regions(classes: DataFrame, held: DataFrame, groups: DataFrame) -> DataFrame:
    """doc_id, tree, bucket, component, n, kinds, main: the members of held regions that are in more than one component."""
    rows = classes.select("doc_id", F.posexplode("keys").alias("tree", "bucket")).join(held.hint("merge"), "bucket", "left_semi")
    rows = written(rows.join(groups, F.col("doc_id") == F.col("id"), "left").select("doc_id", "tree", "bucket", F.coalesce("component", "doc_id").alias("component")), "regions")
    kinds = rows.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    sizes = kinds.groupBy("bucket").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("main"), F.count("*").alias("kinds")).where("kinds > 1")
    return written(rows.join(written(sizes, "sizes"), "bucket"), "open")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Documents are linked when ``percent`` of the union of their shingle sets is common. Null and
    empty texts, and texts without a word, have no shingles and no links. A row with a null
    doc_id links with nothing: its component is null and it is kept. Rows that share a doc_id are
    one document in the links and are each returned. Other columns are ignored. TREES and DEPTH suit
    80 percent and more: a link of 80 percent shares no region with probability
    (1 - 0.8 ** DEPTH) ** TREES = 0.00003, one of 60 percent with 0.06.
    """
    table = written(signed(docs, words), "signed")
    usable = table.where("n_shingles > 0 and doc_id is not null")
    same = ["set_a", "set_b", "n_shingles"]
    # of a class the least id stands for all; most texts are alone in theirs. Written, so that the join below deals its hot keys out
    heads = written(usable.groupBy(*same).agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("last")).where("head < last").drop("last"), "heads")
    large = f"n_shingles >= {percent / (100 - percent) if percent < 100 else 2**31}"  # smaller sets link only to equal ones
    # repeats of a row go before the join, whose result can then be dealt out where a class is hot
    headed = usable.where(large).dropDuplicates(["doc_id", *same]).join(heads, same, "left")
    classes = written(headed.where("head is null or head = doc_id").select("doc_id", "sketch", "keys"), "classes")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))
    first = written(candidates(forest_rows(classes), percent), "candidates")
    pairs = written(first.where("a is not null").select("a", "b").distinct(), "pairs")
    sets = sets_of(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), texts, words)
    groups = components(written(confirmed(pairs, sets, percent), "links"))
    held = first.where("held is not null").select(F.col("held").alias("bucket")).distinct()
    rest = open_regions(classes, held, groups)
    if not rest.isEmpty():
        members = rest.select(F.col("doc_id").alias("id")).distinct()
        more = sets_of(members.join(sets.select("id").hint("merge"), "id", "left_anti"), texts, words)
        whole = classes.join(members.hint("merge").withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").join(sets.union(more), F.col("doc_id") == F.col("id")).drop("id")
        # an id with several texts has several sets
        links = written(across(rest.join(written(whole, "members"), "doc_id"), percent), "links")
        if not links.isEmpty():
            groups = components(links.union(groups.where("id <> component").select(F.col("component").alias("a"), F.col("id").alias("b"))))
    for done in (first, pairs, sets, rest):
        discard_table(done)
    member = table.join(heads, same, "left").join(groups, F.coalesce("head", "doc_id") == F.col("id"), "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce(F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "head")), F.col("doc_id"))).otherwise(F.col("doc_id"))
    return member.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op5_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, sets of 4-word shingles, links at 80 percent."""
    return near_duplicates(documents(spark, sf_dir), words=4)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + least(4, len(ws)) - 1], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0) q),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
 e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 r AS (SELECT doc_id AS node, doc_id AS other FROM w UNION SELECT r.node, e.b FROM r JOIN e ON r.other = e.a),
 m AS (SELECT node, min(other) AS k FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.k AS component_id, w.doc_id = m.k AS kept FROM w JOIN m ON m.node = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""
