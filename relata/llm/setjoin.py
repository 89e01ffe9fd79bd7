"""All pairs of records whose sets of values are similar, by sorted sketch forests (problem 2).

Equal sets are one class and are compared once, through their first record. Every tree of the forest gives each class
a signature of several minhashes and sorts all classes by it, over as many tasks as the data needs. A neighbourhood is
a run of classes with a common prefix. It begins at a base depth and deepens, class by class: a class compares itself
with the prefix whose size is cheapest for the chance it gives to meet a partner at the threshold. A class that went
deeper has won less from a tree, so it goes on to further trees, until the chance to have met every partner reaches the
target recall; classes that have reached it leave the forest. Every pair that met is verified exactly.

Nothing is capped: a run that no depth makes smaller is compared whole, in blocks. A run that goes over the border of a
task is put together again by its prefixes' counts, so a prefix shared by a third of all classes is no single task.

Values are identified by digests of 64 bits, sets by two of them. A pair is wrong only if two different values out of its
two sets share a digest, which has a chance of about 1e-17 for sets of ten values.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relata.functions.titles import canonical_category, canonical_title, present
from relata.session import reliable, table

#: Chance to meet a partner exactly at the threshold; for more similar pairs it is higher.
TARGET_RECALL = 0.99999
#: The base depth is the greatest at which about so many trees reach the target recall.
TREES = 36
#: Share of trees that the first round has beyond those needed, so that classes may deepen without another round.
SPARE = 0.05
#: Levels below the base depth that a neighbourhood may deepen by.
DEEPER = 4
#: What one more tree costs a class, in comparisons: what is shuffled for a tree against what is for a pair to verify.
TREE_COST = 2.0
#: A set with more values than this is held in several rows; its similarities are counted value by value.
GIANT = 100_000
#: Classes of a neighbourhood that one task compares with all others of it at a time.
BLOCK = 512
#: Pairs that are held in memory at a time.
CHUNK = 1 << 19
#: At most so many ids of giant sets are broadcast; more are found by a shuffled join.
BROADCAST_IDS = 100_000

@dataclass(frozen=True)
class Forest:
    """What depths a neighbourhood may have, and what each is worth: the gain of a depth is -ln of the chance to miss."""

    threshold: float
    recall: float = TARGET_RECALL
    tree_cost: float = TREE_COST
    chunk: int = CHUNK

    @property
    def need(self) -> float:
        return -math.log(1 - self.recall)

    def gain(self, depth: int) -> float:
        return -math.log(max(1e-12, 1 - self.threshold**depth))

    @property
    def base(self) -> int:
        depth = 1
        while depth < 12 and self.need / self.gain(depth + 1) <= TREES:
            depth += 1
        return depth

    @property
    def levels(self) -> int:
        return self.base + DEEPER

    @property
    def width(self) -> int:
        """Bytes of a minhash within a signature. What collides is only compared in vain, and the base depth takes four at least."""
        return 2 if self.base > 1 else 4

    @property
    def depths(self) -> range:
        return range(self.base, self.levels + 1)

    @property
    def first_trees(self) -> int:
        return math.ceil(self.need / self.gain(self.base) * (1 + SPARE))


def _mixed(values: np.ndarray, seed: int) -> np.ndarray:
    """A permutation of 64-bit values that depends on the seed (a finaliser of multiplications and shifts)."""
    with np.errstate(over="ignore"):
        x = values ^ np.uint64(seed)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def minhashes(values: np.ndarray, starts: np.ndarray, trees: range, levels: int) -> np.ndarray:
    """(sets, trees, levels): the least hash of each set (values from one start to the next) for each tree and level."""
    out = np.empty((len(starts), len(trees), levels), dtype=np.int64)
    for i, t in enumerate(trees):
        seeds = np.random.default_rng([20240601, t]).integers(1, 2**63, size=levels, dtype=np.int64).astype(np.uint64)
        for d in range(levels):
            out[:, i, d] = np.minimum.reduceat(_mixed(values, int(seeds[d])).view(np.int64), starts)
    return out


def signatures(least: np.ndarray, trees: range, width: int) -> np.ndarray:
    """(sets, trees) of bytes that sort by tree and then by one level after the other."""
    sets, n, levels = least.shape
    out = np.empty((sets, n, 2 + width * levels), dtype=np.uint8)
    out[:, :, 0] = np.asarray(trees) >> 8
    out[:, :, 1] = np.asarray(trees) & 255
    mixed = _mixed(least.view(np.uint64), 0)
    for b in range(width):
        out[:, :, 2 + b :: width] = (mixed >> np.uint64(8 * b)).astype(np.uint8)
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    """An Arrow column of byte strings from a matrix of bytes."""
    n, width = rows.shape
    offsets = np.arange(0, (n + 1) * width, width, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _bytes(column: pa.Array) -> np.ndarray:
    """The matrix of bytes of an Arrow column of byte strings that all have the same length."""
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data.reshape(n, -1)


def _sketched(batches: Iterator[pa.RecordBatch], trees: range, forest: Forest) -> Iterator[pa.RecordBatch]:
    """(key, cls, nm) for each class (cls, nm, hs) and tree."""
    for whole in batches:
        for begin in range(0, whole.num_rows, 2_000):
            batch = whole.slice(begin, 2_000)
            hs = batch.column("hs")
            offsets = hs.offsets.to_numpy().astype(np.int64)
            flat = hs.values.to_numpy(zero_copy_only=False).view(np.uint64)[offsets[0] : offsets[-1]]
            keys = signatures(minhashes(flat, offsets[:-1] - offsets[0], trees, forest.levels), trees, forest.width)
            yield _forest_rows(keys, batch.column("cls").to_numpy(), batch.column("nm").to_numpy())


def _forest_rows(keys: np.ndarray, cls: np.ndarray, nm: np.ndarray) -> pa.RecordBatch:
    trees = keys.shape[1]
    return pa.RecordBatch.from_arrays(
        [_binary(keys.reshape(-1, keys.shape[2])), pa.array(np.repeat(cls, trees)), pa.array(np.repeat(nm, trees))], names=["key", "cls", "nm"]
    )


# --- neighbourhoods ---------------------------------------------------------------------------------------------------
PAIR, OPEN, LOSS = 0, 1, 2
_OUT = "kind tinyint, a bigint, b bigint, key binary, nm int, loss double"


def _common(keys: np.ndarray, width: int) -> np.ndarray:
    """For each row the number of levels it has in common with the row before, -1 for another tree and for row 0."""
    if len(keys) < 2:
        return np.full(len(keys), -1)
    same = keys[1:] == keys[:-1]
    levels = same[:, 2:].reshape(len(same), -1, width).all(2)
    out = np.where(same[:, :2].all(1), np.logical_and.accumulate(levels, axis=1).sum(1), -1)
    return np.concatenate([[-1], out])


def _close(nm_a: np.ndarray, nm_b: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs whose sizes allow the threshold and whose sides are to be compared."""
    na, nb = nm_a >> 2, nm_b >> 2
    ma, mb = nm_a & 3, nm_b & 3
    return (np.minimum(na, nb) >= np.maximum(na, nb) * threshold - 1e-9) & ((ma & (mb << 1) & 2) | (mb & (ma << 1) & 2)).astype(bool)


def compared(keys: np.ndarray, cls: np.ndarray, nm: np.ndarray, forest: Forest) -> Iterator[tuple]:
    """Pairs (a, b) of whole neighbourhoods in order of their keys, then once (None, cls, loss) of classes that deepened."""
    common, m = _common(keys, forest.width), len(keys)
    best, chosen, starts, sizes = np.full(m, np.inf), np.zeros(m, np.int64), {}, {}
    for d in forest.depths:
        group = np.cumsum(common < d) - 1
        starts[d] = np.flatnonzero(common < d)
        count = np.bincount(group)
        sizes[d] = count
        cost = (count[group] - 1 + forest.tree_cost) / forest.gain(d)
        better = cost < best * (1 - 1e-9)
        best[better], chosen[better] = cost[better], d
        starts[d] = starts[d][group]
        sizes[d] = count[group]
    at = np.arange(m)
    for d in forest.depths:
        asking = np.flatnonzero((chosen == d) & (sizes[d] > 1))
        many = np.cumsum(sizes[d][asking])
        begin = 0
        while begin < len(asking):
            end = max(begin + 1, int(np.searchsorted(many, (many[begin - 1] if begin else 0) + forest.chunk, side="right")))
            who = asking[begin:end]
            n = sizes[d][who]
            i = np.repeat(who, n)
            j = np.repeat(starts[d][who], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            # Of two that both ask, the one with the smaller depth asks, then the one that comes first.
            ok = ((chosen[j] > d) | ((chosen[j] == d) & (at[i] < at[j]))) & _close(nm[i], nm[j], forest.threshold)
            i, j = i[ok], j[ok]
            if len(i):
                yield np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j])
            begin = end
    deep = np.flatnonzero(chosen > forest.base)
    gains = np.asarray([forest.gain(d) if d else 0.0 for d in range(forest.levels + 1)])
    yield None, cls[deep], gains[forest.base] - gains[chosen[deep]]


def _rows(kind: int, n: int, **columns) -> pa.RecordBatch:
    kinds = {"a": pa.int64(), "b": pa.int64(), "key": pa.binary(), "nm": pa.int32(), "loss": pa.float64()}
    arrays = [pa.array(np.full(n, kind, np.int8))]
    for name, t in kinds.items():
        c = columns.get(name)
        arrays.append(pa.nulls(n, t) if c is None else c if isinstance(c, pa.Array) else pa.array(c, t))
    return pa.RecordBatch.from_arrays(arrays, names=["kind", *kinds])


def _walk(batches: Iterator[pa.RecordBatch], forest: Forest) -> Iterator[pa.RecordBatch]:
    """Compare the neighbourhoods of one task's sorted rows; the first and the last may go on elsewhere and stay open."""

    def opened(keys, cls, nm):
        return _rows(OPEN, len(cls), a=cls, key=_binary(keys), nm=nm) if len(cls) else None

    def closed(keys, cls, nm):
        for a, b, *loss in compared(keys, cls, nm, forest):
            if a is not None:
                yield _rows(PAIR, len(a), a=a, b=b)
            elif len(b):
                yield _rows(LOSS, len(b), a=b, loss=loss[0])

    held, first = None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        new = _bytes(batch.column("key")), batch.column("cls").to_numpy(), batch.column("nm").to_numpy()
        held = new if held is None else tuple(np.concatenate(x) for x in zip(held, new))
        begins = np.flatnonzero(_common(held[0], forest.width) < forest.base)
        if first and len(begins) > 1:
            yield opened(*(x[: begins[1]] for x in held))
            held, begins, first = tuple(x[begins[1] :] for x in held), begins[1:] - begins[1], False
        if not first and len(begins) > 1 and begins[-1] >= 50_000:
            yield from closed(*(x[: begins[-1]] for x in held))
            held = tuple(x[begins[-1] :] for x in held)
    if held is None:
        return
    last = np.flatnonzero(_common(held[0], forest.width) < forest.base)[-1]
    if last:
        yield from closed(*(x[:last] for x in held))
    rest = opened(*(x[last:] for x in held))
    if rest is not None:
        yield rest


def _open_neighbourhoods(rows: DataFrame, forest: Forest) -> tuple[DataFrame, DataFrame]:
    """(pairs (a, b), losses (a, loss)) of runs that go over the border of a task; rows: (key, cls, nm).

    Sizes come from counts of prefixes, combined within tasks. The comparison is a join in blocks.
    """
    prefix = lambda d: F.substring("key", F.lit(1), F.lit(2) + F.lit(forest.width) * d)
    deep = F.explode(F.array(*[F.lit(d) for d in forest.depths])).alias("d")
    at = rows.select("key", "cls", "nm", deep).withColumn("prefix", prefix(F.col("d")))
    counts = at.groupBy("prefix").agg(F.count(F.lit(1)).alias("m"))
    gain = F.element_at(F.array(*[F.lit(forest.gain(d)) for d in forest.depths]), F.col("d") - forest.base + 1)
    cost = F.round((F.col("m") - 1 + F.lit(forest.tree_cost)) / gain, 6)
    choice = at.join(counts, "prefix").groupBy("key", "cls", "nm").agg(F.min(F.struct(cost.alias("cost"), "d", "m")).alias("c"))
    chosen = reliable(choice.select("key", "cls", "nm", F.col("c.d").alias("depth"), F.ceil(F.col("c.m") / BLOCK).cast("int").alias("blocks")))
    # A prefix belongs to one depth, as its length says.
    members = chosen.select("key", F.col("cls").alias("y"), F.col("nm").alias("ny"), F.col("depth").alias("dy"), deep).withColumn("prefix", prefix(F.col("d")))
    asking = chosen.select(F.col("cls").alias("x"), F.col("nm").alias("nx"), F.col("depth").alias("dx"), "blocks", prefix(F.col("depth")).alias("prefix"))
    blocks = asking.select("prefix", "blocks").distinct()
    left = asking.withColumn("block", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int")).drop("blocks")
    right = members.join(blocks, "prefix").select("prefix", "y", "ny", "dy", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    size = lambda c: F.shiftright(c, 2)
    side = lambda c: F.col(c).bitwiseAND(3)
    close = F.least(size("nx"), size("ny")) >= F.greatest(size("nx"), size("ny")) * F.lit(forest.threshold) - F.lit(1e-9)
    across = (side("nx").bitwiseAND(1).cast("boolean") & side("ny").bitwiseAND(2).cast("boolean")) | (
        side("nx").bitwiseAND(2).cast("boolean") & side("ny").bitwiseAND(1).cast("boolean")
    )
    once = (F.col("dx") < F.col("dy")) | ((F.col("dx") == F.col("dy")) & (F.col("x") < F.col("y")))
    pairs = left.join(right, ["prefix", "block"]).where(once & close & across)
    lost = chosen.where(F.col("depth") > forest.base).select(
        F.col("cls").alias("a"), (F.lit(forest.gain(forest.base)) - F.element_at(F.array(*[F.lit(forest.gain(d)) for d in forest.depths]), F.col("depth") - forest.base + 1)).alias("loss")
    )
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), lost


def _giant_rows(parts: DataFrame, trees: range, forest: Forest) -> DataFrame:
    """(key, cls, nm) for each class of ``parts`` (cls, nm, hs), whose sets are spread over several rows."""
    levels, width = forest.levels, forest.width

    def partial(batches):
        for batch in batches:
            hs = batch.column("hs")
            offsets = hs.offsets.to_numpy().astype(np.int64)
            if not batch.num_rows:
                continue
            flat = hs.values.to_numpy(zero_copy_only=False).view(np.uint64)[offsets[0] : offsets[-1]]
            least = minhashes(flat, offsets[:-1] - offsets[0], trees, levels).reshape(batch.num_rows, -1)
            ends = pa.array(np.arange(0, least.size + 1, least.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("cls"), batch.column("nm"), pa.ListArray.from_arrays(ends, pa.array(least.reshape(-1)))], names=["cls", "nm", "least"])

    def assembled(batches):
        for batch in batches:
            if batch.num_rows:
                least = np.asarray(batch.column("least").to_pylist(), dtype=np.int64).reshape(batch.num_rows, len(trees), levels)
                yield _forest_rows(signatures(least, trees, width), batch.column("cls").to_numpy(), batch.column("nm").to_numpy())

    each = parts.select("cls", "nm", "hs").mapInArrow(partial, "cls bigint, nm int, least array<bigint>")
    least = each.select("cls", "nm", F.posexplode("least").alias("at", "h")).groupBy("cls", "nm", "at").agg(F.min("h").alias("h"))
    whole = least.groupBy("cls", "nm").agg(F.array_sort(F.collect_list(F.struct("at", "h"))).alias("l"))  # trees * levels numbers
    return whole.select("cls", "nm", F.col("l.h").alias("least")).mapInArrow(assembled, "key binary, cls bigint, nm int")


def candidates(classes: DataFrame, forest: Forest, giants: DataFrame | None = None) -> DataFrame:
    """(a, b), a < b: classes (cls, nm, hs) that met in some tree; nm is 4 * size + sides. giants: (cls, nm, hs) in parts."""
    first, trees = 0, forest.first_trees
    active, big, found, needs = classes, giants, [], None
    while True:
        dealt = range(first, first + trees)
        rows = active.select("cls", "nm", "hs").mapInArrow(lambda b, r=dealt: _sketched(b, r, forest), "key binary, cls bigint, nm int")
        if big is not None:
            rows = rows.unionByName(_giant_rows(big, dealt, forest))
        ordered = rows.repartitionByRange("key").sortWithinPartitions("key")
        out = reliable(ordered.mapInArrow(lambda b: _walk(b, forest), _OUT))
        pairs, lost = _open_neighbourhoods(out.where(F.col("kind") == OPEN).select("key", F.col("a").alias("cls"), "nm"), forest)
        found.append(out.where(F.col("kind") == PAIR).select("a", "b").unionByName(pairs))
        won = F.lit(trees * forest.gain(forest.base))
        losses = out.where(F.col("kind") == LOSS).select("a", "loss").unionByName(lost).groupBy(F.col("a").alias("cls")).agg(F.sum("loss").alias("loss"))
        if needs is None:
            left = losses.select("cls", (F.lit(forest.need) - won + F.col("loss")).alias("need"))
        else:
            left = needs.join(losses, "cls", "left").select("cls", (F.col("need") - won + F.coalesce("loss", F.lit(0.0))).alias("need"))
        most = left.where("need > 1e-9").agg(F.max("need")).first()[0]
        if most is None:
            break
        needs = reliable(left.where("need > 1e-9"))
        active = active.join(needs.select("cls"), "cls", "left_semi")
        big = None if big is None else big.join(needs.select("cls"), "cls", "left_semi")
        first, trees = first + trees, math.ceil(most / forest.gain(forest.base) * (1 + SPARE))
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole.distinct()


# --- records ----------------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class SimilarSets:
    """members (id, cls, sides): every record with its class, the least id with an equal set; links (a, b, similarity),
    a < b: pairs of classes. sides is 1 for records of the left table, 2 for those of the right one, 3 in a join of a
    table with itself."""

    members: DataFrame
    links: DataFrame

    def pairs(self) -> DataFrame:
        """(id_a, id_b): all pairs of records; only here are pairs of classes and copies spread over their members."""
        left = self.members.where(F.col("sides").bitwiseAND(1) > 0).select(F.col("cls").alias("a"), F.col("id").alias("x"))
        right = self.members.where(F.col("sides").bitwiseAND(2) > 0).select(F.col("cls").alias("b"), F.col("id").alias("y"))
        both = self.links.select("a", "b").unionByName(self.links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        across = both.join(left, "a").join(right, "b").select("x", "y")
        copies = left.join(right, F.col("a") == F.col("b")).select("x", "y")
        return across.unionByName(copies).where("x < y").select(F.col("x").alias("id_a"), F.col("y").alias("id_b"))

    def counts(self) -> DataFrame:
        """(id, cls, copies, links): for each record its class, how many have the same set, and how many other records
        are similar to it, copies included."""
        size = self.members.groupBy("cls").agg(F.count(F.lit(1)).alias("copies"))
        both = self.links.select("a", "b").unionByName(self.links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.join(size.select(F.col("cls").alias("b"), "copies"), "b").groupBy(F.col("a").alias("cls")).agg(F.sum("copies").alias("near"))
        each = size.join(near, "cls", "left").select("cls", "copies", (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("links"))
        return self.members.join(each, "cls").select("id", "cls", "copies", "links")


def _giant_ids(rows: DataFrame, giant: int) -> tuple[DataFrame, int]:
    """(id, spread) of the ids that may have more than ``giant`` values, with the rows they are spread over; their number."""
    counts = rows.groupBy("id").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > giant)
    ids = counts.select("id", F.ceil(F.col("m") / giant).cast("int").alias("spread"))
    n = ids.count()
    return (reliable(ids) if n else ids), n


def similar_sets(
    rows: DataFrame, threshold: float, least_size: int = 1, giant: int = GIANT, recall: float = TARGET_RECALL, ids: DataFrame | None = None
) -> SimilarSets:
    """Similar sets of values, from rows (id, v[, sides]) with repeats; ids are whole numbers.

    ids (id), if given, holds each id at least as often as ``rows`` and is cheaper to count.

    Rows without id or value are left out, and so are ids with less than ``least_size`` different values. Sets of up to
    ``giant`` values are one row; larger ones are spread over several and go through the same forest, each as a class of
    its own.
    """
    forest = Forest(threshold, recall, TREE_COST, CHUNK)
    sides = F.col("sides") if "sides" in rows.columns else F.lit(3)
    values = rows.where("id is not null and v is not null").select(F.col("id").cast("bigint").alias("id"), F.xxhash64("v").alias("h"), sides.cast("int").alias("sides"))
    giants, n_giants = _giant_ids((rows if ids is None else ids).select(F.col("id").cast("bigint").alias("id")), giant)
    if n_giants:
        few = F.broadcast(giants) if n_giants <= BROADCAST_IDS else giants
        values = values.join(few, "id", "left").withColumn("chunk", F.when(F.col("spread").isNull(), -1).otherwise(F.pmod("h", F.col("spread")).cast("int"))).drop("spread")
    else:
        values = values.withColumn("chunk", F.lit(-1))
    sets = values.groupBy("id", "chunk").agg(F.sort_array(F.collect_set("h")).alias("hs"), F.max("sides").alias("sides")).withColumn("n", F.size("hs"))
    small = sets.where((F.col("chunk") < 0) & (F.col("n") >= least_size)).withColumns({"p": F.xxhash64("hs"), "q": F.xxhash64(F.lit(17), "hs")})
    small = reliable(small.select("id", "sides", "n", "hs", "p", "q"))
    # Copies are combined within tasks before the shuffle, so a class of a third of all records is a row a task.
    first = small.groupBy("p", "q").agg(F.min(F.struct("id", "n", "hs")).alias("s"), F.bit_or("sides").alias("sides"), F.count(F.lit(1)).alias("copies"))
    classes = reliable(first.select(F.col("s.id").alias("cls"), (F.col("s.n") * 4 + F.col("sides")).alias("nm"), F.col("s.hs").alias("hs"), "p", "q", "copies"))
    copied = small.select("id", "sides", "p", "q").join(classes.where("copies > 1").select("p", "q", "cls"), ["p", "q"], "left")
    members = copied.select("id", F.coalesce("cls", "id").alias("cls"), "sides")
    if not n_giants:
        met = candidates(classes, forest)
        return SimilarSets(members, _verified(met, classes, threshold))
    parts = sets.where("chunk >= 0")
    total = parts.groupBy("id").agg(F.sum("n").alias("total"), F.max("sides").alias("sides")).where(F.col("total") >= least_size)
    big = reliable(parts.select("id", "hs").join(total, "id").select(F.col("id").alias("cls"), (F.col("total") * 4 + F.col("sides")).cast("int").alias("nm"), "hs"))
    met = reliable(candidates(classes, forest, big))
    ends = big.select("cls").distinct()
    whole = met.join(ends.select(F.col("cls").alias("a")), "a", "left_anti").join(ends.select(F.col("cls").alias("b")), "b", "left_anti").select("a", "b")
    counted = met.exceptAll(whole)
    links = _verified(whole, classes, threshold).unionByName(_counted(counted, classes.select("cls", "nm", "hs").unionByName(big), threshold))
    return SimilarSets(members.unionByName(total.select("id", F.col("id").alias("cls"), "sides")), links)


def _verified(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs that reach the threshold, by intersecting their sets."""
    both = pairs.join(classes.select(F.col("cls").alias("a"), F.col("hs").alias("ha")), "a").join(classes.select(F.col("cls").alias("b"), F.col("hs").alias("hb")), "b")
    shared = F.size(F.array_intersect("ha", "hb"))
    rated = both.select("a", "b", shared.alias("shared"), (F.size("ha") + F.size("hb") - shared).alias("total"))
    return rated.where(F.col("shared") >= F.col("total") * F.lit(threshold) - F.lit(1e-9)).select("a", "b", (F.col("shared") / F.col("total")).alias("similarity"))


def _counted(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The same by counting shared values, without a whole set in any row; sets: (cls, nm, hs), several rows a class."""
    values = sets.select("cls", F.shiftright("nm", 2).alias("n"), F.explode("hs").alias("h"))
    a = values.select(F.col("cls").alias("a"), F.col("n").alias("na"), "h")
    b = values.select(F.col("cls").alias("b"), F.col("n").alias("nb"), "h")
    shared = pairs.join(a, "a").join(b, ["b", "h"]).groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("shared"))
    total = F.col("na") + F.col("nb") - F.col("shared")
    return shared.where(F.col("shared") >= total * F.lit(threshold) - F.lit(1e-9)).select("a", "b", (F.col("shared") / total).alias("similarity"))


def similar_records(rows: DataFrame, threshold: float, least_size: int = 1, giant: int = GIANT) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of ids of rows (id, v) whose sets of values are similar, copies included."""
    return similar_sets(rows, threshold, least_size, giant).pairs()


def similar_between(left: DataFrame, right: DataFrame, threshold: float, least_size: int = 1, giant: int = GIANT) -> DataFrame:
    """(id_left, id_right): pairs of a record of one table (id, v) and one of the other whose sets are similar.

    Both tables go through one forest; neighbours of the same table aren't compared. Equal ids of the two tables are
    different records.
    """
    both = None
    for side, rows in ((1, left), (2, right)):
        marked = rows.select((F.col("id").cast("bigint") * 2 + (side - 1)).alias("id"), "v", F.lit(side).alias("sides"))
        both = marked if both is None else both.unionByName(marked)
    # Members of one side only meet those of the other, whichever of the two has the smaller number.
    found = similar_sets(both, threshold, least_size, giant)
    links = found.links.select("a", "b").unionByName(found.links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ones = found.members.where("sides = 1").select(F.col("cls").alias("a"), F.shiftright("id", 1).alias("id_left"))
    twos = found.members.where("sides = 2").select(F.col("cls").alias("b"), F.shiftright("id", 1).alias("id_right"))
    across = links.join(ones, "a").join(twos, "b").select("id_left", "id_right")
    return across.unionByName(ones.join(twos, F.col("a") == F.col("b")).select("id_left", "id_right"))


# --- queries ----------------------------------------------------------------------------------------------------------
def link_values(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "links").select(F.col("src_id").alias("id"), canonical_title(F.col("target_title")).alias("v"))
    return rows.where(present(F.col("v")) & ~F.lower("v").startswith("image:"))


def category_values(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "page_cat").select(F.col("page_id").alias("id"), canonical_category(F.col("cat")).alias("v"))
    return rows.where(present(F.col("v")))


THRESHOLD, LEAST_SIZE = 0.6, 4


def _both_fields(spark, sf_dir: str) -> SimilarSets:
    """Link and category sets in one forest: ids carry the field in their last bit, and so do the values, so that sets of
    different fields have nothing in common and never meet."""
    rows = ids = None
    for bit, (name, column, values) in enumerate((("links", "src_id", link_values(spark, sf_dir)), ("page_cat", "page_id", category_values(spark, sf_dir)))):
        tagged = lambda c: (F.col(c).cast("bigint") * 2 + bit).alias("id")  # noqa: E731, B023
        part, raw = values.select(tagged("id"), F.struct(F.lit(bit).alias("fld"), "v").alias("v")), table(spark, sf_dir, name).select(tagged(column))
        rows, ids = (part, raw) if rows is None else (rows.unionByName(part), ids.unionByName(raw))
    return similar_sets(rows, THRESHOLD, LEAST_SIZE, ids=ids)


def _field(column: str):
    return F.when(F.col(column).bitwiseAND(F.lit(1)) == 0, "links").otherwise("cats").alias("fld")


def _plain(column: str):
    return F.shiftright(column, 1).cast("int").alias(column)


def p2_found(spark, sf_dir: str) -> DataFrame:
    return _both_fields(spark, sf_dir).pairs().select(_field("id_a"), _plain("id_a"), _plain("id_b"))


def p2_classes(spark, sf_dir: str) -> DataFrame:
    """(fld, id, cls, copies, links): every record with its class of equal sets and the number of records similar to it."""
    return _both_fields(spark, sf_dir).counts().select(_field("id"), _plain("id"), _plain("cls"), "copies", "links")


def _sql(fld: str, sets: str) -> str:
    return f"""select '{fld}' as fld, a.id as id_a, b.id as id_b from
  (select x.id as a, y.id as b, count(*) as shared from {sets} x join {sets} y on x.v = y.v and x.id < y.id group by all) p
  join n_{sets} a on a.id = p.a join n_{sets} b on b.id = p.b
where p.shared * 10 >= 6 * (a.n + b.n - p.shared)"""


_SETS = """
with l as (select distinct src_id as id, trim(regexp_replace(split_part(target_title, '#', 1), '[\\s_\\x{a0}]+', ' ', 'g')) as v from links),
c as (select distinct page_id as id, trim(regexp_replace(lower(trim(regexp_replace(cat, '[\\s_\\x{a0}]+', ' ', 'g'))), '^category ?: ?', '')) as v from page_cat),
l2 as (select * from l where v <> '' and not lower(v) like 'image:%'), c2 as (select * from c where v <> ''),
n_ls as (select id, count(*) as n from l2 group by id having count(*) >= 4), n_cs as (select id, count(*) as n from c2 group by id having count(*) >= 4),
ls as (select l2.* from l2 semi join n_ls using (id)), cs as (select c2.* from c2 semi join n_cs using (id))"""


def _classes_sql(fld: str, sets: str) -> str:
    return f"""select '{fld}' as fld, id, cls, copies, coalesce(near, 0) as links from
  (select id, min(id) over w as cls, count(*) over w as copies from (select id, list(v order by v) as s from {sets} group by 1) window w as (partition by s))
  left join (select x as id, count(*) as near from (select id_a as x from pairs where fld = '{fld}' union all select id_b from pairs where fld = '{fld}') group by 1) using (id)"""


SQL = {
    "p2_found": f"{_SETS} {_sql('links', 'ls')} union all {_sql('cats', 'cs')}",
    "p2_classes": f"{_SETS}, pairs as ({_sql('links', 'ls')} union all {_sql('cats', 'cs')}) {_classes_sql('links', 'ls')} union all {_classes_sql('cats', 'cs')}",
}
