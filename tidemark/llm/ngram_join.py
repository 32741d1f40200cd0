"""N-gram Jaccard join of whole texts by vertical partitioning.

A document's set holds its distinct five-word shingles; documents with the same set are one node, named by
the set's digest. No join below is by doc_id, so rows without an id, or different texts with one id, are rows like any other.

All shingles stand in one global order, by the number of nodes that hold them. The numbers are counted over all texts:
every task sends 32 bits of a shingle to the bucket that the other bits name, with its node; a bucket
gives back the shingles that two nodes or more hold. Shingles so frequent that they would overfill a bucket are
found first, by lossy counts within tasks, and stand last. A node of which fewer than four fifths
of the shingles are shared with any other can't be linked and is done with. The others post their first
shingles in the order (the prefix); linked sets share one of these, which yields candidates. Shingles that
exactly the same nodes post are one posting list.

The first shingles that a pair of candidates shares tell how much it may share at most; where that isn't enough, the pair is
done with. For the other candidates the order of hashes is cut into fragments; the overlap is counted in each fragment separately
and summed per pair.

A large group of near copies isn't compared pair by pair. First every posting list has two leaders, and each node
is held against at most two of those of its lists. Then, in rounds, what is outside the largest component of a list is held
against some leaders inside it, as long as much is left. Last, list by list, all that isn't in the list's largest component is
compared with everything of another component: a link inside a component can't change it, so none that matters is lost.

Defined results: null and empty texts have an empty set and are linked with nothing; fewer than five words
form one shingle; repeated rows share their set; columns other than doc_id and text are ignored; a null
doc_id takes part in its component, whose id is the smallest that isn't null. Words are known by 64-bit
hashes and sets by 128 bits of a digest; two that differ are taken for equal with that chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, materialize, whole_text
from tidemark.llm.components import components
from tidemark.llm.shingles import set_digest, shingle_sets, text_bytes

FRAGMENTS = 6
#: Links need 5 * intersection >= 4 * union.
P, Q = 4, 5
#: A task looks at so many shingles at a time; those that ``SEEN`` of its nodes hold are reported.
PORTION, SEEN = 1_000_000, 4
#: Shingles reported so often or more go last in the order without being counted, ``FREQUENT`` of them at most.
OFTEN, FREQUENT = 1_000, 100_000
#: Shingles in one bucket of the count, and the least number of buckets.
BUCKET, BUCKETS = 2_000_000, 48
#: Rows of two numbers that may be broadcast, 16 MB; beyond it Spark joins by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Bits of the filter that says which texts are read again; one that lets more through costs time only.
FILTER_BITS = 1 << 26
#: Rounds with leaders at most, and rows per posting that the last comparison may take before another round is made.
ROUNDS, REST = 4, 2
#: Leaders of a posting list in the second to fourth round.
LEADERS = (8, 32, 64)


def prefix_length(n: int) -> int:
    """How many first shingles of a set of n must hold one of any set that is linked with it."""
    return n - -(-P * n // Q) + 1


def cut_at(hashes: np.ndarray) -> np.ndarray:
    """Where a set in ascending order is cut into fragments."""
    return np.searchsorted(hashes, (np.arange(1, FRAGMENTS) * ((1 << 64) // FRAGMENTS)).astype(np.uint64))


def survey(docs: DataFrame) -> DataFrame:
    """A row (doc_id, text_hash, n, node, more) per document, and rows (shingle, count) of shingles met ``SEEN`` times or more."""
    kind = docs.select("doc_id").schema
    schema = f"doc_id {kind['doc_id'].dataType.simpleString()}, text_hash long, n int, node long, more long, shingle long, count long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, met = 0, set()

        def often(id_type: pa.DataType) -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            values, counts = values[counts >= SEEN].view(np.int64), counts[counts >= SEEN]
            none = [pa.nulls(len(values), t) for t in (id_type, pa.int64(), pa.int32(), pa.int64(), pa.int64())]
            return pa.RecordBatch.from_arrays([*none, pa.array(values), pa.array(counts)], names)

        names = ["doc_id", "text_hash", "n", "node", "more", "shingle", "count"]
        id_type = pa.int64()
        for batch in batches:
            ids, rows = batch.column("doc_id"), len(batch)
            id_type = ids.type
            n, node, more = [], [], []
            for own in shingle_sets(*text_bytes(batch.column("text"))):
                name = set_digest(own) if len(own) else (None, None)
                n.append(len(own))
                node.append(name[0])
                more.append(name[1])
                if len(own) and name not in met:
                    met.add(name)
                    held.append(own)
                    size += len(own)
                if size > PORTION:
                    yield often(id_type)
                    held, size, met = [], 0, set()
            found = [pa.array(n, pa.int32()), pa.array(node, pa.int64()), pa.array(more, pa.int64())]
            yield pa.RecordBatch.from_arrays([ids, batch.column("text_hash"), *found, pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int64())], names)
        if held:
            yield often(id_type)

    return docs.select("doc_id", F.xxhash64(whole_text()).alias("text_hash"), "text").mapInArrow(run, schema)


class Frequent:
    """The shingles that stand last, by their counts."""

    def __init__(self, shingles: np.ndarray, counts: np.ndarray):
        self.known = np.sort(shingles)
        rank = np.empty(len(shingles), np.int64)
        rank[np.lexsort((shingles, counts))] = np.arange(len(shingles))
        self.rank = rank[np.argsort(shingles)]

    def split(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shingles of a set that aren't frequent, and the ranks of the others in ascending order."""
        if not len(self.known):
            return own, self.known
        signed = own.view(np.int64)
        at = np.minimum(np.searchsorted(self.known, signed), len(self.known) - 1)
        hit = self.known[at] == signed
        return own[~hit], np.sort(self.rank[at[hit]])


def shared_shingles(docs: DataFrame, frequent, collided: frozenset, buckets: int) -> DataFrame:
    """(node, class, holders, copies): what each node shares with others, class being 32 bits of a shingle and its bucket.

    ``copies`` shingles of the node are in the class. Frequent shingles aren't told apart: class is null and copies is their number.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, sizes, nodes, often, size = [], [], {}, [], 0

        def portion() -> pa.RecordBatch:
            names = np.fromiter(nodes, np.int64, len(nodes))
            whole = np.concatenate(values)
            owner = np.repeat(np.arange(len(names), dtype=np.uint32), sizes)
            bucket = ((whole >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
            low, owner = whole[order].astype(np.uint32), owner[order]
            counts = np.bincount(bucket.astype(np.int64), minlength=buckets) if buckets < 1 << 20 else None
            present = np.flatnonzero(counts) if counts is not None else np.unique(bucket).astype(np.int64)
            stops = np.cumsum(counts[present]) if counts is not None else np.searchsorted(bucket[order], present.astype(np.uint64), "right")
            out, start = [], 0
            for b, stop in zip(present.tolist(), stops.tolist(), strict=True):
                edges = np.flatnonzero(np.diff(owner[start:stop], prepend=np.uint32(0xFFFFFFFF)))
                runs = np.diff(edges, append=stop - start).astype(np.uint32)
                out.append((b, names[owner[start:stop][edges]].tobytes(), runs.tobytes(), low[start:stop].tobytes()))
                start = stop
            heavy = np.array(often, np.uint32)
            place = names % buckets
            for b in np.unique(place[heavy > 0]).tolist():
                here = (place == b) & (heavy > 0)
                out.append((b, names[here].tobytes(), heavy[here].tobytes(), None))
            bucket_ids, name_bytes, run_bytes, low_bytes = zip(*out, strict=True)
            columns = [pa.array(bucket_ids, pa.int64()), *(pa.array(c, pa.binary()) for c in (name_bytes, run_bytes, low_bytes))]
            return pa.RecordBatch.from_arrays(columns, ["bucket", "nodes", "runs", "low"])

        for batch in batches:
            for own in shingle_sets(*text_bytes(batch.column("text"))):
                if not len(own):
                    continue
                node, more = set_digest(own)
                if (name := more if node in collided else node) in nodes:
                    continue
                nodes[name] = None
                rare, last = frequent.value.split(own)
                values.append(rare)
                sizes.append(len(rare))
                often.append(len(last))
                size += len(own)
                if size > PORTION:
                    yield portion()
                    values, sizes, nodes, often, size = [], [], {}, [], 0
        if nodes:
            yield portion()

    def count(key: tuple, table: pa.Table) -> pa.Table:
        def whole(column: str, kind: str, rows: pa.Table) -> np.ndarray:
            return np.frombuffer(b"".join(rows[column].to_pylist()), kind)

        plain = table.filter(pc.is_valid(table["low"]))
        nodes, runs, low = whole("nodes", "<i8", plain), whole("runs", "<u4", plain), whole("low", "<u4", plain)
        fresh = np.zeros(len(nodes), bool)
        fresh[np.unique(nodes, return_index=True)[1]] = True  # a set met in several tasks counts once
        low, owner = low[np.repeat(fresh, runs)], np.repeat(np.arange(fresh.sum(), dtype=np.int64), runs[fresh])
        nodes = nodes[fresh]
        order = np.argsort(low, kind="stable")
        low, owner = low[order], owner[order]
        new_class = np.diff(low.astype(np.int64), prepend=-1) != 0
        new_node = new_class | (np.diff(owner, prepend=-1) != 0)
        first = np.flatnonzero(new_node)
        copies = np.diff(first, append=len(low))
        which = np.cumsum(new_class)[first] - 1
        holders = np.bincount(which, minlength=1)[which] if len(which) else which
        kept = holders > 1
        first, copies, holders = first[kept], copies[kept], holders[kept]
        heavy = table.filter(pc.is_null(table["low"]))
        names, at = np.unique(whole("nodes", "<i8", heavy), return_index=True)
        number = whole("runs", "<u4", heavy)[at].astype(np.int32)
        bucket = key[0].as_py()
        return pa.table(
            {
                "node": np.concatenate([nodes[owner[first]], names]),
                "class": pa.chunked_array([pa.array(low[first].astype(np.int64) + (bucket << 32)), pa.nulls(len(names), pa.int64())]),
                "holders": np.concatenate([holders, np.zeros(len(names), np.int64)]).astype(np.int32),
                "copies": np.concatenate([copies.astype(np.int32), number]),
            }
        )

    dealt = docs.select("text").mapInArrow(deal, "bucket long, nodes binary, runs binary, low binary")
    return dealt.groupBy("bucket").applyInArrow(count, "node long, class long, holders int, copies int")


def whole_sets(docs: DataFrame, frequent, collided: frozenset, wanted: np.ndarray) -> DataFrame:
    """(node, n, last, parts) of the texts that the filter lets through: ranks of frequent shingles in the prefix, and the set in fragments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in batches:
            place = batch.column("text_hash").to_numpy(zero_copy_only=False) % FILTER_BITS
            chosen = batch.filter(pa.array((bits[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) > 0))
            rows: list[tuple] = []
            size = 0
            for own in shingle_sets(*text_bytes(chosen.column("text"))):
                if not len(own):
                    continue
                node, more = set_digest(own)
                rare, last = frequent.value.split(own)
                last = last[: max(0, prefix_length(len(own)) - len(rare))]
                rows.append((more if node in collided else node, len(own), last, [p.view(np.int64) for p in np.split(own, cut_at(own))]))
                size += len(own)
                if size > PORTION // 8:
                    yield frame(rows)
                    rows, size = [], 0
            if rows:
                yield frame(rows)

    def frame(rows: list[tuple]) -> pa.RecordBatch:
        node, n, last, parts = zip(*rows, strict=True)
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((node, n, last, parts), kinds, strict=True)], ["node", "n", "last", "parts"])

    texts = docs.select(F.xxhash64(whole_text()).alias("text_hash"), "text")
    return texts.mapInArrow(run, "node long, n int, last array<long>, parts array<array<long>>")


def text_filter(df: DataFrame) -> np.ndarray:
    """``FILTER_BITS`` bits, those set that belong to a text_hash of ``df``; the driver gets at most one row for each 64."""
    place = F.pmod(F.col("text_hash"), F.lit(FILTER_BITS))
    words = df.groupBy((place / 64).cast("long").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(text_hash, {FILTER_BITS}) % 64 AS int))")).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def near_enough(overlap: Column, n: Column, m: Column) -> Column:
    return overlap * (P + Q) >= (n + m) * P


def may_link(a: str, b: str) -> Column:
    """Sizes fit, and from this posting on enough is left of both sets: true at the first one that a linked pair shares."""
    n, m = F.col(f"{a}.n").cast("long"), F.col(f"{b}.n").cast("long")
    left = F.least(n - F.col(f"{a}.place"), m - F.col(f"{b}.place"))
    return (F.least(n, m) * Q >= F.greatest(n, m) * P) & near_enough(left, n, m)


def fitting(rows: DataFrame, counted: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` joined with ``columns`` of ``counted`` by node; broadcast only below ``BROADCAST_ROWS``."""
    small = counted.select("node", *columns)
    return rows.join(F.broadcast(small) if counted.count() <= BROADCAST_ROWS else small, "node")


def posting_lists(shared: DataFrame, may: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(list, node, n, place): the first shingles of every node that may be linked; shingles with the same nodes are one list.

    And (node, keys, rest): those of a node's first shingles that another node posts too, and how many shingles at most it may
    share beside them with a node whose first shingles reach as far in the order.
    """
    own = fitting(shared.where(F.col("class").isNotNull()), may, ["n", "k", "h"])
    before = F.coalesce(F.sum("copies").over(Window.partitionBy("node").orderBy("holders", "class").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = own.withColumn("place", F.col("n") - F.col("h") - F.col("k") + before)
    placed = placed.where(F.expr(f"place < n - ({P} * n + {Q - 1}) div {Q} + 1")).select(F.col("class").alias("key"), "node", "n", F.col("place").cast("int"), "copies")
    ranks = fitting(sets.select("node", F.posexplode("last").alias("at", "rank")), may, ["n", "h"])
    frequent = ranks.select((-1 - F.col("rank")).alias("key"), "node", "n", (F.col("n") - F.col("h") + F.col("at")).cast("int").alias("place"), F.lit(1).alias("copies"))
    posted = materialize(placed.unionByName(frequent), "ngram-posted")
    names = posted.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    named = materialize(posted.join(names.select("key", F.when(F.col("m") > 1, F.xxhash64("m", "x", "y")).alias("list")), "key"), "ngram-named")
    out = materialize(named.where("list IS NOT NULL").groupBy("list", "node", "n").agg(F.min("place").alias("place")), "ngram-lists")
    # a class may hold several shingles of a node, of which the keys show one
    rest = (F.first("n") - F.max(F.col("place") + F.col("copies")) + F.sum(F.col("copies") - 1)).alias("rest")
    first = materialize(named.groupBy("node").agg(F.collect_list(F.when(F.col("list").isNotNull(), F.col("key"))).alias("keys"), rest), "ngram-first")
    discard(posted, named)
    return out, first


def promising(pairs: DataFrame, first: DataFrame) -> DataFrame:
    """Those of ``pairs`` that may be linked by what they share of their first shingles.

    What two sets share stands either before the end of the first shingles of both, and is then posted by both, or behind the
    nearer of the two ends.
    """
    low, high = (first.select(F.col("node").alias(s), F.col("keys").alias(f"keys_{s}"), F.col("rest").alias(f"rest_{s}")) for s in ("low", "high"))
    most = F.size(F.array_intersect("keys_low", "keys_high")) + F.greatest("rest_low", "rest_high")
    return pairs.join(low, "low").join(high, "high").where(near_enough(most, F.col("n_low"), F.col("n_high"))).select(pairs.columns)


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b), the components' names, of those ``pairs`` that are near enough: overlaps by fragment, summed per pair."""
    parts = sets.select("node", F.posexplode("parts").alias("fragment", "part")).where(F.size("part") > 0)
    left = parts.select(F.col("node").alias("low"), "fragment", F.col("part").alias("part_low"))
    right = parts.select(F.col("node").alias("high"), "fragment", F.col("part").alias("part_high"))
    own = ["low", "high", "n_low", "n_high", "a", "b"]
    partial = pairs.join(left, "low").join(right, ["high", "fragment"]).select(*own, F.size(F.array_intersect("part_low", "part_high")).alias("shared"))
    overlap = partial.groupBy(*own).agg(F.sum("shared").alias("shared"))
    return overlap.where(near_enough(F.col("shared"), F.col("n_low"), F.col("n_high"))).select("a", "b").distinct()


def _pairs(met: DataFrame) -> DataFrame:
    """Rows of x and y, joined, as distinct pairs: low, high (nodes, low below high), their sizes and components a and b."""
    x, y = (F.struct(*(F.col(f"{s}.{c}").alias(c) for c in ("node", "n", "root"))) for s in "xy")
    ends = met.select(F.least(x, y).alias("l"), F.greatest(x, y).alias("h"))
    columns = [F.col(f"{s}.{c}").alias(name) for s, c, name in (("l", "node", "low"), ("h", "node", "high"), ("l", "n", "n_low"), ("h", "n", "n_high"), ("l", "root", "a"), ("h", "root", "b"))]
    return ends.select(*columns).distinct()


def first_pairs(lists: DataFrame) -> DataFrame:
    """Each node with at most two of the two leaders that each of its lists has."""
    whole = F.struct("node", "n", "place", "root")
    leaders = lists.groupBy("list").agg(*(F.min_by(whole, F.xxhash64("node", F.lit(k))).alias(f"l{k}") for k in (0, 1)))
    leaders = leaders.select("list", F.explode(F.array_distinct(F.array("l0", "l1"))).alias("x")).select("list", "x.*").alias("x")
    met = leaders.join(lists.alias("y"), "list").where((F.col("x.node") != F.col("y.node")) & may_link("x", "y"))
    x, y = (F.struct(*(F.col(f"{s}.{c}").alias(c) for c in ("node", "n", "root"))) for s in "xy")
    met = met.groupBy(x.alias("x"), y.alias("y")).agg(F.count(F.lit(1)).alias("times"))
    best = met.groupBy("y").agg(F.max_by("x", F.struct("times", "x")).alias("usual"), F.min_by("x", F.xxhash64("x.node", F.lit(0))).alias("other"))
    return _pairs(best.select("y", F.explode(F.array_distinct(F.array("usual", "other"))).alias("x")))


def led_pairs(lists: DataFrame, largest: DataFrame, turn: int) -> DataFrame:
    """What is outside a list's largest component with this turn's leaders from inside."""
    rows = lists.join(largest, "list")
    by_hash = Window.partitionBy("list").orderBy(F.xxhash64("node", F.lit(turn)), "node")
    leaders = rows.where("root = largest").withColumn("at", F.row_number().over(by_hash)).where(F.col("at") <= LEADERS[min(turn, len(LEADERS)) - 1])
    return _pairs(leaders.alias("x").join(rows.where("root <> largest").alias("y"), "list").where(may_link("x", "y")))


def other_pairs(open_lists: DataFrame, largest: DataFrame) -> DataFrame:
    """All pairs of different components that share a list and may be linked; in each one node is outside the list's largest component."""
    # the smaller set of a linked pair has eight ninths of itself left
    small = F.expr(f"(n - place) * {P + Q} >= {2 * P} * n")
    rows = open_lists.join(largest, "list").withColumn("outside", F.col("root") != F.col("largest")).drop("largest")
    differ = (F.col("x.root") != F.col("y.root")) & (F.col("x.n") <= F.col("y.n")) & may_link("x", "y")
    one = rows.where(small & F.col("outside")).alias("x").join(rows.alias("y"), "list").where(differ)
    two = rows.where(small & ~F.col("outside")).alias("x").join(rows.where("outside").alias("y"), "list").where(differ)
    both = [d.select(F.struct("x.node", "x.n", "x.root").alias("x"), F.struct("y.node", "y.n", "y.root").alias("y")) for d in (one, two)]
    return _pairs(both[0].unionByName(both[1]))


def find_roots(lists: DataFrame, first: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, root) of every node in a list; what has no link is its own root."""
    small = F.expr(f"IF((n - place) * {P + Q} >= {2 * P} * n, 1, 0)")
    postings = lists.count()
    roots = materialize(lists.select("node", F.col("node").alias("root")).distinct(), "ngram-roots")
    last, turn = False, 0
    while not last:
        placed = lists.join(roots, "node")
        by_root = placed.groupBy("list", "root").agg(F.count(F.lit(1)).alias("m"), F.sum(small).alias("small"))
        most = F.max_by("root", F.struct("m", "root")).alias("largest")
        split = by_root.groupBy("list").agg(most, F.sum("m").alias("m"), F.sum("small").alias("small"), F.max("m").alias("most"), F.count(F.lit(1)).alias("roots"))
        split = materialize(split.where("roots > 1 AND small > 0"), "ngram-split")
        rest = split.agg(F.sum((F.col("m") - F.col("most")).cast("double") * F.col("small"))).first()[0]
        if not rest:
            discard(split)
            break
        last = turn == ROUNDS or rest <= REST * postings
        largest = split.select("list", "largest")
        open_lists = placed.join(split.select("list"), "list")
        met = other_pairs(open_lists, largest) if last else led_pairs(open_lists, largest, turn) if turn else first_pairs(open_lists)
        pairs = materialize(promising(met, first), "ngram-pairs")
        fresh = materialize(linked(pairs, sets), "ngram-links")
        moved = components(fresh).select(F.col("node").alias("root"), F.col("root").alias("to"))
        before, roots = roots, materialize(roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "ngram-roots")
        discard(split, pairs, fresh, before)
        turn += 1
    return roots


def named_rows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, n, node) of every document, node being null for an empty set; and (node, root) of the sets that may be linked."""
    spark = docs.sparkSession
    seen = materialize(survey(docs), "ngram-survey")
    often = seen.where(F.col("shingle").isNotNull()).groupBy("shingle").agg(F.sum("count").alias("count")).where(F.col("count") >= OFTEN)
    often = often.orderBy(F.desc("count"), "shingle").limit(FREQUENT).toArrow()  # 16 bytes each
    frequent = spark.sparkContext.broadcast(Frequent(often["shingle"].to_numpy(), often["count"].to_numpy()))
    rows = seen.where(F.col("shingle").isNull())
    named = rows.where("n > 0").groupBy("node", "more", "n").agg(F.min("text_hash").alias("text_hash"))
    # two sets with the same 64 bits: their nodes are named by the other 64 bits
    collided = frozenset(r["node"] for r in named.groupBy("node").count().where("count > 1").select("node").collect())
    name = F.when(F.col("node").isin(list(collided)), F.col("more")).otherwise(F.col("node")) if collided else F.col("node")
    rows = rows.select("doc_id", "text_hash", "n", name.alias("node"))
    nodes = materialize(named.select(name.alias("node"), "n", "text_hash"), "ngram-nodes")

    total = nodes.agg(F.sum("n")).first()[0] or 0
    shared = materialize(shared_shingles(docs, frequent, collided, max(BUCKETS, total // BUCKET)), "ngram-shared")
    rare, last = (F.coalesce(F.sum(F.when(c, F.col("copies"))), F.lit(0)).cast("int") for c in (F.col("class").isNotNull(), F.col("class").isNull()))
    sums = shared.groupBy("node").agg(rare.alias("k"), last.alias("h")).where("k + h > 0")
    may = materialize(nodes.join(sums, "node").where(f"(k + h) * {Q} >= {P} * n"), "ngram-may")
    wanted = spark.sparkContext.broadcast(text_filter(may))
    sets = whole_sets(docs, frequent, collided, wanted).join(may.select("node"), "node", "left_semi").dropDuplicates(["node"])
    sets = materialize(sets, "ngram-sets")
    for shipped in (frequent, wanted):  # nothing reads them again; the driver would hold them until it happens to collect its garbage
        shipped.destroy()
    lists, first = posting_lists(shared, may, sets)
    discard(shared, nodes)
    roots = find_roots(lists, first, sets)
    discard(lists, first, sets, may)
    return rows, roots


def in_components(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n, node, root) of every document; root is null for an empty set."""
    rows, roots = named_rows(docs)
    return rows.join(roots, "node", "left").select("doc_id", "text_hash", "n", "node", F.coalesce("root", "node").alias("root"))


def link_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    placed = materialize(in_components(docs), "ngram-placed")
    # only components of several rows differ from their own id
    least = placed.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    found = placed.join(least, "root", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """Of each component the row with the smallest doc_id stays, of rows with the same id the one with the smallest hash of
    its text, one of rows that repeat it; without any id in the component, one row. Rows without words all stay."""
    placed = materialize(in_components(docs).where("root IS NOT NULL").select("doc_id", "text_hash", "root"), "ngram-placed")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    groups = placed.groupBy("root").agg(F.min_by(F.struct("doc_id", "text_hash"), order).alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1")
    rows = placed.join(groups.select("root", "first"), "root")
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    marked = materialize(rows.groupBy("doc_id", "text_hash").agg(F.max(is_first).alias("stays"), F.count(F.lit(1)).alias("times")), "ngram-marked")
    gone, again = marked.where("NOT stays"), marked.where("stays AND times > 1")

    def matching(left: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = keys.select(F.col("doc_id").alias("key_id"), F.col("text_hash").alias("key_hash"))
        keys = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
        return left.join(keys, left["doc_id"].eqNullSafe(keys["key_id"]) & (F.xxhash64(F.coalesce(left["text"], F.lit(""))) == keys["key_hash"]), how)

    kept = matching(docs, gone, "left_anti")
    if again.isEmpty():
        return kept
    once = matching(kept, again, "left_semi")
    return matching(kept, again, "left_anti").unionByName(once.dropDuplicates(["doc_id", "text"]))
