"""N-gram Jaccard join by prefix lists and count vectors, with an R-tree over them for what the lists leave.

Tokens (word shingles) are hashed into GROUPS groups and a document becomes the point of its group counts. For any
two sets the overlap is at most the sum over groups of the smaller count, and for a tree node at most the sum of
the smaller of the query's count and the node's upper corner; nodes and points below the overlap that the threshold
needs are skipped, and what survives is verified on the whole sets.

Distribution. Equal sets are collapsed first (a hash aggregate). A point meets only points with which it shares a
token of its prefix: the n - ceil(t n) + 1 tokens that come first in one global order (rare first, by a count sketch
of fixed size; any order is lossless, since a pair at the threshold has to share a prefix token). So the
prefix lists find the candidates and no pair is lost. A list is never gathered: an aggregate with a map-side step gives
each token's centre, the document of the highest rank, and a join pairs the others with it, under the flat bound over
GROUPS groups. A document has one rank in all lists, so the lists of a group of near copies choose few centres and the
group costs pairs in proportion to its size. Afterwards a tree over the finer points serves the remainder only: the
members of a centre's stars are compared where they are in different components, in blocks of bounded size, so that no
link that would join two components is missed. Where stars connect a group, no tree is built. The links found so are a
spanning subset; the exact mode searches each token list by a tree, in blocks, and verifies all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import in_arrow, materialize, mix, release, row_shingles, slices, small_batches
from .filters import bits_for, key_filter, may_hold

#: Groups of the points that go with every document, and of the finer points that the trees hold.
GROUPS, FINE = 16, 1024
#: A node of the tree holds so many points or nodes.
LEAF = 16
#: Counters of the token sketch, and the pieces in which it is merged. Its size does not depend on the data.
SKETCH, PIECES = 1 << 20, 64
#: Members of a token list or a centre that one task compares with about as many others.
BLOCK = 1024
#: Bytes of text whose tokens, points or copies a task holds at once.
PART = 4 << 20


class CountTree:
    """A packed R-tree over count vectors, ordered by set size; answers 'which points can reach the overlap'.

    levels: from the root down to the leaves, of each node the upper corner and the least and greatest set size.
    """

    def __init__(self, size: np.ndarray, vectors: np.ndarray):
        self.order = np.lexsort((*vectors.T[:2], size))
        self.size, self.points = size[self.order], vectors[self.order]
        high, least, most = self.points, self.size, self.size
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while True:
            at = np.arange(0, len(least), LEAF)
            high, least, most = np.maximum.reduceat(high, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)
            self.levels.insert(0, (high, least, most))
            if len(at) <= LEAF:
                return

    def query(self, n: int, vector: np.ndarray, per_cent: int) -> np.ndarray:
        """Positions whose summed coordinate minima do not rule out the threshold."""
        at = np.arange(len(self.levels[0][1]))
        for k, (high, least, most) in enumerate(self.levels):
            fits = (100 * most[at] >= per_cent * n) & (100 * n >= per_cent * least[at])
            at = at[fits]
            bound = np.minimum(high[at], vector).sum(1, dtype=np.int64)
            at = at[(100 + per_cent) * bound >= per_cent * (n + least[at])]
            below = len(self.size) if k + 1 == len(self.levels) else len(self.levels[k + 1][1])
            at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
            at = at[at < below]
        return self.order[at[may_reach(n, vector, self.size[at], self.points[at], per_cent)]]


def may_reach(n, vector, sizes, points, per_cent: int) -> np.ndarray:
    """Whether sizes and summed minima allow 100 * overlap >= per_cent * union."""
    bound = np.minimum(vector, points).sum(-1, dtype=np.int64)
    fits = (100 * np.minimum(n, sizes) >= per_cent * np.maximum(n, sizes))
    return fits & ((100 + per_cent) * bound >= per_cent * (n + sizes))


def _scale(n, groups: int):
    """Counts are stored in a byte each, in steps that fit the set's size, rounded up so that bounds stay bounds."""
    return np.asarray(n) // (groups * 32) + 1


def _vector(tokens: np.ndarray, groups: int) -> np.ndarray:
    counts = np.bincount((tokens >> np.uint64(40)).astype(np.int64) % groups, minlength=groups)
    return np.minimum(-(-counts // _scale(len(tokens), groups)), 255).astype(np.uint8)


def _counts(n: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Upper bounds of the group counts of points stored in bytes."""
    out = np.minimum(packed.astype(np.int64) * _scale(n, packed.shape[1])[:, None], 65535).astype(np.uint16)
    out[packed == 255] = 65535  # a full byte bounds nothing
    return out


def _unpack(n: np.ndarray, v1: np.ndarray, v2: np.ndarray) -> np.ndarray:
    return _counts(n, np.column_stack([v1, v2]).astype(np.int64).view(np.uint8).reshape(len(n), GROUPS))


def _print(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    if not len(tokens):
        return 0, 0
    other = mix(tokens ^ np.uint64(0x5851F42D4C957F2D))
    return int(tokens.sum(dtype=np.uint64).view(np.int64)), int(other.sum(dtype=np.uint64).view(np.int64))


_SETS = "doc_id long, n long, fp1 long, fp2 long, v1 long, v2 long, piece int, counts binary"


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """Each document's size, set fingerprint and point; at the end the task's token counts, in pieces."""
    counts = np.zeros(SKETCH, np.uint32)
    names = ["doc_id", "n", "fp1", "fp2", "v1", "v2", "piece", "counts"]
    for batch in batches:
        rows, seen = [], set()
        for tokens in row_shingles(batch.column("text"), shingle):
            a, b = _print(tokens)
            rows.append((len(tokens), a, b, *_vector(tokens, GROUPS).view(np.int64).tolist()))
            if len(tokens) and (a, b) not in seen:  # copies side by side count once; the sketch only orders tokens
                seen.add((a, b))
                np.add.at(counts, (tokens % np.uint64(SKETCH)).astype(np.int64), np.uint32(1))
        own = np.array(rows, np.int64).reshape(-1, 5)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *map(pa.array, own.T.copy()), pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.binary())], names=names)
    width = SKETCH // PIECES
    pieces = [k for k in range(PIECES) if counts[k * width : (k + 1) * width].any()]
    packed = [np.minimum(counts[k * width : (k + 1) * width], 65535).astype(np.uint16).tobytes() for k in pieces]
    yield pa.RecordBatch.from_arrays([*(pa.nulls(len(pieces), pa.int64()) for _ in range(6)), pa.array(pieces, pa.int32()), pa.array(packed, pa.binary())], names=names)


def _add_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, counts in zip(batch.column("piece").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            more = np.frombuffer(counts, np.uint16).astype(np.uint32)
            total[piece] = total[piece] + more if piece in total else more
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["piece", "counts"])


_ROUTES = "token long, doc long, rank long"


def _routes(batches: Iterator[pa.RecordBatch], shingle: int, per_cent: int, sketch, held, shared=None) -> Iterator[pa.RecordBatch]:
    """A row for each prefix token of each set, the rarest tokens first; only of the documents that stand for their set,
    and only of tokens in the filter shared, if it is given. rank: the mean count of the prefix tokens, then a hash of the
    document: first come sets with few tokens of their own."""
    counts = sketch.value
    for batch in _needed(batches, held):
        token, doc, rank = [], [], []
        ids = batch.column("doc_id").to_pylist()
        for k, tokens in enumerate(row_shingles(batch.column("text"), shingle)):
            size = len(tokens)
            if not size or ids[k] is None:
                continue
            keep = size - -(-per_cent * size // 100) + 1
            often = counts[(tokens % np.uint64(SKETCH)).astype(np.int64)]
            first = np.argsort(often, kind="stable")[:keep]
            own = tokens[first]
            mean = min(int(often[first].mean() * 16), (1 << 31) - 1)
            tie = int(mix(np.array([ids[k]], np.int64).view(np.uint64))[0]) & 0xFFFFFFFF
            if shared is not None:
                own = own[may_hold(shared.value, own)]
            token.append(own.view(np.int64))
            doc.append(np.full(len(own), ids[k]))
            rank.append(np.full(len(own), mean << 32 | tie))
        if token:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (token, doc, rank)], names=["token", "doc", "rank"])


def _first_of_pairs(*columns: np.ndarray) -> np.ndarray:
    """Positions of the first row of each value of the first two columns, in order of the others."""
    order = np.lexsort(columns[::-1])
    x, y = columns[0][order], columns[1][order]
    new = np.ones(len(order), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    return order[new]


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """The rows of each value of keys, from batches in their order: one group is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None

    def whole() -> dict[str, np.ndarray]:
        table = pa.Table.from_batches(held)
        held.clear()
        return {x: table.column(x).to_numpy() for x in table.column_names}

    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(k).to_numpy() for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for v in values:
            new[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(v[a] for v in values)
            if held and now != last:
                yield whole()
            last = now
            held.append(batch.slice(a, b - a))
    if held:
        yield whole()


def _bounded(batches: Iterator[pa.RecordBatch], per_cent: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, many) with whether sizes and points allow a link; those of lists of two only if they do."""
    for batch in batches:
        na, nb = (batch.column(x).to_numpy() for x in ("na", "nb"))
        one, two = (_unpack(n, batch.column(f"v1{x}").to_numpy(), batch.column(f"v2{x}").to_numpy()) for n, x in ((na, "a"), (nb, "b")))
        may = may_reach(na, one, nb, two, per_cent)
        keep = pa.array(may | batch.column("many").to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("many"), pa.array(may)], names=["a", "b", "many", "may"]).filter(keep)


def _all_pairs(batches: Iterator[pa.RecordBatch], per_cent: int) -> Iterator[pa.RecordBatch]:
    """Every pair of two blocks x <= y of a token list that a tree over the count vectors does not rule out."""
    for got in _groups(batches, ["token", "x", "y"]):
        n, doc, same = got["n"], got["doc"], got["x"][0] == got["y"][0]
        rows = np.flatnonzero(got["block"] == got["x"][0])
        other = rows if same else np.flatnonzero(got["block"] == got["y"][0])
        if not len(rows) or not len(other):
            continue
        points = _unpack(n, got["v1"], got["v2"])
        tree = CountTree(n[other], points[other])
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for u in rows:
            near = doc[other[tree.query(n[u], points[u], per_cent)]]
            near = near[near > doc[u]] if same else near[near != doc[u]]
            a.append(np.full(len(near), doc[u]))
            b.append(near)
        one, two = np.concatenate(a), np.concatenate(b)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], names=["a", "b"])


def _in_blocks(members: DataFrame, per_cent: int) -> DataFrame:
    """(a, b) of all pairs of token lists (token, size, doc, n, v1, v2) that the bounds allow. A list of many members is
    dealt to blocks of about BLOCK, and each two of its blocks meet by a key of their own."""
    dealt = members.withColumn("blocks", F.ceil(F.col("size") / BLOCK)).withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "doc"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("token", "doc", "n", "v1", "v2", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    keys = ["token", "x", "y"]
    return in_arrow(dealt.repartition(*keys).sortWithinPartitions(*keys), lambda b: _all_pairs(b, per_cent), "a long, b long")


def _leftovers(batches: Iterator[pa.RecordBatch], per_cent: int) -> Iterator[pa.RecordBatch]:
    """Pairs between components among a block of a centre's members and a block of those outside its largest component,
    where neither the bounds of a tree over their count vectors nor their distances to the centre rule a link out."""
    limit = 1 - per_cent / 100 + 1e-9
    for got in _groups(batches, ["centre", "x", "y"]):
        asks = np.flatnonzero(got["asks"].astype(bool))
        own = np.flatnonzero(~got["asks"].astype(bool))
        if not len(asks) or not len(own):
            continue
        n, far, part, doc = got["n"], got["far"], got["part"], got["doc"]
        points = _counts(n, np.frombuffer(b"".join(got["vector"]), np.uint8).reshape(len(n), FINE))
        tree = CountTree(n[own], points[own])
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for u in asks:
            near = own[tree.query(n[u], points[u], per_cent)]
            near = near[(part[near] != part[u]) & ~(np.abs(far[near] - far[u]) > limit)]
            a.append(np.full(len(near), doc[u]))
            b.append(doc[near])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], names=["a", "b"])


def _outside(rows: DataFrame) -> DataFrame:
    """rows (centre, doc, part, ...) of the centres whose members are in several components, dealt to blocks: as a member
    (asks false) and, outside the centre's largest component, as a query (asks true). Members of the largest component are
    never compared with each other; every other pair of components meets in some block."""
    sizes = rows.groupBy("centre", "part").agg(F.count("*").alias("k")).groupBy("centre").agg(F.sum("k").alias("size"), F.max("k").alias("most"), F.max_by("part", F.struct("k", "part")).alias("large"))
    mixed = rows.join(sizes.where("size > most"), "centre")
    ceil = lambda x: F.ceil(x / BLOCK).cast("long")
    mixed = mixed.withColumns({"ys": ceil(F.col("size")), "xs": ceil(F.col("size") - F.col("most"))})
    spread = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    own = lambda n: F.pmod(F.xxhash64(F.lit(n), "doc"), F.col(n))
    members = mixed.withColumns({"asks": F.lit(False), "y": own("ys"), "x": F.explode(spread("xs"))})
    asking = mixed.where("part <> large").withColumns({"asks": F.lit(True), "x": own("xs"), "y": F.explode(spread("ys"))})
    return members.unionByName(asking).drop("size", "most", "large", "xs", "ys")


def _points(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """The finer point of each document."""
    for batch in batches:
        n, vectors = [], []
        for tokens in row_shingles(batch.column("text"), shingle):
            n.append(len(tokens))
            vectors.append(_vector(tokens, FINE).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(vectors, pa.binary())], names=["doc", "n", "vector"])


def _verify(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """The exact overlap and sizes of each pair, from both whole texts."""
    last, one = None, None
    for batch in batches:
        over, na, nb = [], [], []
        ids, left = batch.column("a").to_pylist(), batch.column("text_a")
        for k, two in enumerate(row_shingles(batch.column("text_b"), shingle)):
            if ids[k] != last:
                last, one = ids[k], next(row_shingles(left.slice(k, 1), shingle))
            over.append(len(np.intersect1d(one, two, assume_unique=True)))
            na.append(len(one))
            nb.append(len(two))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *(pa.array(x, pa.int64()) for x in (over, na, nb))], names=["a", "b", "overlap", "na", "nb"])


def _needed(batches: Iterator[pa.RecordBatch], bloom) -> Iterator[pa.RecordBatch]:
    """Only rows whose id may occur in a pair, so that the others' texts are not shuffled; about PART bytes of text at once."""
    bits = bloom.value
    for batch in batches:
        keep = pa.array(may_hold(bits, batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint64)), pa.bool_())
        ends = np.append(0, np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64))
        for a, b in slices(ends, PART):
            yield batch.slice(a, b - a).filter(keep.slice(a, b - a))


def id_filter(ids: DataFrame):
    """A broadcast filter over the column id, as large as their number asks for, up to a fixed size."""
    ids = ids.select("id")
    return ids.sparkSession.sparkContext.broadcast(key_filter(ids, bits_for(ids.count(), 8)))


def verified(docs: DataFrame, pairs: DataFrame, shingle: int, per_cent: int) -> DataFrame:
    """pairs (a, b) with overlap, na, nb from the whole texts of docs. One filter of fixed size decides which texts move."""
    held = id_filter(pairs.select(F.explode(F.array("a", "b")).alias("id")))
    texts = in_arrow(docs.select("doc_id", "text"), lambda b: _needed(b, held), "doc_id long, text string")
    both = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return in_arrow(both.select("a", "b", "text_a", "text_b"), lambda b: _verify(b, shingle), "a long, b long, overlap long, na long, nb long").distinct()


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(id, component) of the ids in edges (a, b): the smallest id that links reach; after a given number of rounds at
    most, an id that links reach, so that ids of one component may still have several.

    Large and small stars by turns until nothing changes; each step is two aggregates and joins on its keys and is
    written to the shared folder. No step needs the edges of a node in one task.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        past, now = now, materialize(small, "edges")
        release(past)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        rounds = None if rounds is None else rounds - 1
        if state == before or rounds == 0:
            least = now if state == before else now.groupBy("u").agg(F.min("v").alias("v"))
            return least.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = state


def jaccard_links(docs: DataFrame, *, shingle: int = 5, per_cent: int = 75, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, links): documents (doc_id, n_shingles, class_id) with the smallest id of equal sets, and verified
    links (a, b, overlap, na, nb) between classes. Unless exact, they are a spanning subset: enough of them that no
    component is split. With exact they are all links, k (k - 1) / 2 of them in a group of k texts that are all alike.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first = materialize(in_arrow(docs, lambda b: _sets(b, shingle), _SETS), "sets")
    counts = np.zeros(SKETCH, np.uint32)
    pieces = first.where("piece is not null").select("piece", "counts").repartition(PIECES, "piece")
    with small_batches(spark):
        merged = in_arrow(pieces, _add_pieces, "piece int, counts binary").collect()  # 4 MB, whatever the data
    for row in merged:
        counts[row["piece"] * (SKETCH // PIECES) : (row["piece"] + 1) * (SKETCH // PIECES)] = np.frombuffer(row["counts"], np.uint32)
    sketch = spark.sparkContext.broadcast(counts)
    sets = first.where("piece is null").drop("piece", "counts")
    named = sets.where("n > 0").groupBy("fp1", "fp2", "n").agg(F.min("doc_id").alias("class_id"))
    point = ["doc_id", "n", "class_id", "v1", "v2"]
    known = sets.where("n > 0").join(named, ["fp1", "fp2", "n"]).select(*point)
    known = materialize(known.unionAll(sets.where("n = 0").withColumn("class_id", F.col("doc_id")).select(*point)), "classes")
    release(first)
    stands = id_filter(known.where("n > 0").select(F.col("class_id").alias("id")).where("id is not null").distinct())
    ids = known.where("doc_id is not null and n > 0").distinct()

    def side(x: str) -> DataFrame:
        return ids.select(F.col("doc_id").alias(x), F.col("class_id").alias(f"c{x}"), F.col("n").alias(f"n{x}"), F.col("v1").alias(f"v1{x}"), F.col("v2").alias(f"v2{x}"))

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()

    lists = in_arrow(docs, lambda b: _routes(b, shingle, per_cent, sketch, stands), _ROUTES)
    lists = lists.groupBy("token").agg(F.count("*").alias("size"), F.max_by("doc", "rank").alias("centre")).where("size > 1")
    lists = materialize(lists, "lists")
    shared = id_filter(lists.select(F.col("token").alias("id")))
    members = in_arrow(docs, lambda b: _routes(b, shingle, per_cent, sketch, stands, shared), _ROUTES).drop("rank").join(lists, "token")
    union = F.expr(f"100 * overlap >= {per_cent} * (na + nb - overlap)")
    result = known.select("doc_id", F.col("n").alias("n_shingles"), "class_id")
    if exact:
        own = ids.select(F.col("doc_id").alias("doc"), "class_id", "n", "v1", "v2")
        pairs = _in_blocks(members.join(own, "doc").select("token", "size", F.col("class_id").alias("doc"), "n", "v1", "v2").distinct(), per_cent)
        tested = materialize(verified(docs, materialize(ordered(pairs), "pairs"), shingle, per_cent), "tested")
        return result, tested.where(union)
    stars = members.where("doc <> centre").groupBy(F.col("centre").alias("a"), F.col("doc").alias("b")).agg((F.max("size") > 2).alias("many"))
    stars = stars.join(side("a"), "a").join(side("b"), "b").where("ca <> cb").drop("a", "b").withColumnsRenamed({"ca": "a", "cb": "b"})
    stars = materialize(in_arrow(stars, lambda b: _bounded(b, per_cent), "a long, b long, many boolean, may boolean"), "stars")
    release(lists)
    tested = materialize(verified(docs, materialize(ordered(stars.where("may")), "pairs"), shingle, per_cent), "tested")
    links = tested.where(union)
    # Members of a list that the star left in different components may still be linked with each other.
    parts = components(links.select("a", "b"), rounds=2)
    rows = stars.where("many").select(F.col("a").alias("centre"), F.col("b").alias("doc")).distinct()
    rows = rows.join(parts.withColumnsRenamed({"id": "doc", "component": "part"}), "doc", "left").withColumn("part", F.coalesce("part", "doc"))
    far = tested.select("a", "b", (1 - F.col("overlap") / (F.col("na") + F.col("nb") - F.col("overlap"))).alias("far"))
    far = far.unionAll(far.select("b", "a", "far")).withColumnsRenamed({"a": "centre", "b": "doc"})
    rows = rows.join(far, ["centre", "doc"], "left").select("centre", "doc", "part", F.coalesce("far", F.lit(float("nan"))).alias("far"))
    rows = materialize(_outside(rows), "mixed")
    release(stars)
    held = id_filter(rows.select(F.col("doc").alias("id")))
    points = in_arrow(docs.select("doc_id", "text"), lambda b: _points(_needed(b, held), shingle), "doc long, n long, vector binary").dropDuplicates(["doc"])
    keys = ["centre", "x", "y"]
    rows = rows.join(points, "doc").repartition(*keys).sortWithinPartitions(*keys)
    more = ordered(in_arrow(rows, lambda b: _leftovers(b, per_cent), "a long, b long"))
    more = materialize(more.join(tested.select("a", "b"), ["a", "b"], "left_anti"), "more")
    if more.isEmpty():
        return result, links
    again = materialize(verified(docs, more, shingle, per_cent), "again")
    return result, links.unionAll(again.where(union))


def jaccard_components(docs: DataFrame, *, shingle: int = 5, per_cent: int = 75, exact: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text; other columns are ignored); with exact
    also n_links, the number of all verified links of the row's class.

    Null or wordless texts have an empty set, link with nothing and are their own component; texts of under
    ``shingle`` words are one shingle; equal sets are one class; a null doc_id links nothing and has a null component
    unless its set has a document with an id. A spanning subset of the links gives the components, so that n_links is
    given only where all of them are sought.
    """
    known, links = jaccard_links(docs, shingle=shingle, per_cent=per_cent, exact=exact)
    links = materialize(links.select("a", "b"), "links")
    by = components(links).withColumnRenamed("id", "class_id")
    columns = ["doc_id", "n_shingles", F.coalesce("component", "class_id").alias("component_id")]
    if exact:
        degree = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
        by = degree.join(by, "class_id", "left")
        columns.append(F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return known.join(by, "class_id", "left").select(*columns)


def near_duplicates_dropped(docs: DataFrame, *, shingle: int = 5, per_cent: int = 75) -> DataFrame:
    """docs without the members of each component but the smallest doc_id. Every column stays; rows without an id stay."""
    gone = jaccard_components(docs, shingle=shingle, per_cent=per_cent).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
