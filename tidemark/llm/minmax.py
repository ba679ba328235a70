"""Near-duplicates by min-max hashing.

Each of PERMUTATIONS hash functions gives two signature values of a document's
shingle set: the least and the greatest. Bands of ROWS values are the buckets of
candidate search: two sets of similarity 0.85 share none of the 25 bands with
probability (1 - 0.85**5)**25 < 5e-7. Every candidate is confirmed on full sets.

Documents with equal sets are one class from the start. A class meets others
through the least class of each bucket, its hub: the group of a hub is all classes
that share a bucket with it where it is the least, so any two candidates of a bucket
are in one group. First every member is confirmed against the hub, which is linear in
the members: near copies of one text are done then. What a hub doesn't link is compared
with the rest of its group: members above UNIT_SHINGLES or UNIT_MEMBERS are cut in parts,
and every pair of parts, one of them of such others, is a unit of work of bounded size.
In a unit only pairs not yet linked by others are confirmed, and a spanning forest of
links leaves it, never all pairs. No group is capped.

Words are runs of characters other than ASCII white space, A-Z lower-cased;
shingles are five words, or all of fewer words. Null text and text without words
have the empty set and link with nothing, each a component of its own. Rows with a
null doc_id are not linked; their component is null and they are kept. Repeated rows
have a row each: of rows with one doc_id all are kept or none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, graph

SHINGLE = 5
PERMUTATIONS = 64
ROWS = 5
BANDS = 2 * PERMUTATIONS // ROWS
#: 100 * intersection >= LEAST * union links two sets.
LEAST = 85
#: A part of a group has about so many shingles and members at most.
UNIT_SHINGLES = 1 << 20
UNIT_MEMBERS = 2_000
#: Text bytes whose shingles a worker makes at once: their arrays take many times as much.
SLICE_BYTES = 1 << 18

_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEED = np.arange(1, PERMUTATIONS + 1, dtype=np.uint64)
_FACTOR = common.mix(_SEED) | np.uint64(1)
_SHIFT = common.mix(_SEED + np.uint64(1 << 32))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
    starts, ends = common.word_spans(data, _WORD)
    hashes = common.span_hashes(data, starts, ends)
    n = len(hashes)
    mixed = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        factor = np.uint64(pow(0x9E3779B97F4A7C15, i, 1 << 64))
        mixed[: max(0, n - i)] += hashes[i:] * factor
    first = np.searchsorted(starts, offsets).tolist()
    out = []
    for a, b in zip(first, first[1:]):
        if b - a >= SHINGLE:
            out.append(np.unique(common.mix(mixed[a : b - SHINGLE + 1])))
        elif b > a:  # all the words; their number keeps them apart from whole shingles
            whole = hashlib.blake2b(hashes[a:b].tobytes(), digest_size=8).digest()
            out.append(np.frombuffer(whole, np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """Least and greatest value of a non-empty set under each permutation, alternately."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(shingles), 2048):
        values = shingles[None, at : at + 2048] * _FACTOR[:, None]
        values += _SHIFT[:, None]
        values ^= values >> np.uint64(32)
        np.minimum(low, values.min(1), out=low)
        np.maximum(high, values.max(1), out=high)
    return np.stack([low, high], 1).ravel()


def bands(sig: np.ndarray) -> np.ndarray:
    """One key for each band of a signature."""
    rows = sig[: BANDS * ROWS].reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = common.mix(key ^ rows[:, i])
    return key.view(np.int64)


def _numbered(docs: DataFrame) -> DataFrame:
    return common.pick(docs, doc_id="long", text="string")


def sketches(rows: DataFrame) -> DataFrame:
    """(doc_id, size, digest, bands) of each row; digest and bands are null for the empty set."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(common.utf8(batch, "text"))
        sizes = pa.array([len(s) for s in sets], pa.int64())
        digests = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary())
        keys = pa.array([bands(signature(s)) if len(s) else None for s in sets], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column(0), sizes, digests, keys], ["doc_id", "size", "digest", "bands"])

    return common.over_text(rows, run, "doc_id long, size long, digest binary, bands array<long>", limit=SLICE_BYTES)


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            higher = self.up[self.up]
            if (higher == self.up).all():
                return self.up
            self.up = higher

    def join(self, a: int, others: np.ndarray) -> None:
        roots = self.roots()
        met = np.unique(roots[np.append(others, a)])
        self.up[np.isin(roots, met)] = met[0]


def confirm(nodes: np.ndarray, sets: list[np.ndarray], side: np.ndarray) -> list[tuple[int, int]]:
    """Links (node, node) that span the components of the full-set similarity graph within a unit.

    side: 0 and 1 for the two parts of a pair of parts, between which alone is
    compared; all 2 for a part with itself.
    """
    n = len(nodes)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    owner = np.repeat(np.arange(n), sizes)
    flat = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    listed, owners = flat[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], listed[1:] != listed[:-1]]))
    ends = np.append(starts[1:], len(listed))
    rank = np.empty(len(flat), np.int64)  # of each shingle's list
    rank[order] = np.repeat(np.arange(len(starts)), ends - starts)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    forest, links = Forest(n), []
    both = bool((side < 2).any())
    for i in range(n):
        roots = forest.roots()
        wanted = (roots != roots[i]) & (side != side[i] if both else True)
        # sets whose sizes alone rule the similarity out
        wanted &= (100 * np.minimum(sizes, sizes[i]) >= LEAST * np.maximum(sizes, sizes[i]))
        if not wanted.any():
            continue
        mine = rank[begin[i] : begin[i + 1]]
        lengths = ends[mine] - starts[mine]
        many = lengths > 1
        mine, lengths = mine[many], lengths[many]
        if not len(mine):
            continue
        steps = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        common_count = np.bincount(owners[np.repeat(starts[mine], lengths) + steps], minlength=n)
        union = sizes + sizes[i] - common_count
        found = np.flatnonzero(wanted & (100 * common_count >= LEAST * union))
        if len(found):
            _, one = np.unique(roots[found], return_index=True)  # one link to each component is enough
            links += [(int(nodes[i]), int(nodes[j])) for j in found[one]]
            forest.join(i, found)
    return links


def _with_hub(groups: DataFrame, members: DataFrame) -> DataFrame:
    """(hub, part, node, shingles): the members of every group, dealt out in parts of UNIT_MEMBERS, and the hub in each part."""
    sizes = groups.groupBy("hub").agg(F.count("*").alias("times"))
    parts = common.stage(sizes.withColumn("parts", F.ceil(F.col("times") / UNIT_MEMBERS).cast("int")), "group-sizes")
    own = F.array(F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    part = F.explode(F.when(F.col("node") == F.col("hub"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(own))
    dealt = common.join_counted(groups, parts, "hub").withColumn("part", part)
    return dealt.select("hub", "part", "node").join(members.select("node", "shingles"), "node").select("hub", "part", "node", "shingles")


def _beside_hub(rows: DataFrame) -> DataFrame:
    """(hub, node, linked) of every member of every group, held against the group's hub; of rows as _with_hub() makes them.

    They arrive sorted, the hub, which is the least, first: a task holds one hub's sets
    at a time, and rows are as many as members and parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, hubs = None, []
        for batch in batches:
            out: list[tuple[int, int, bool]] = []
            for k, (hub, part, node) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(3)))):
                shingles = np.frombuffer(batch.column(3)[k].as_py(), np.uint64)
                if (hub, part) != key:
                    key, hubs = (hub, part), []
                if node == hub:
                    hubs.append(shingles)
                else:
                    out.append((hub, node, any(similar(shingles, h) for h in hubs)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.bool_()))], ["hub", "node", "linked"])
        common.release()

    found = rows.repartition("hub", "part").sortWithinPartitions("hub", "part", "node").mapInArrow(run, "hub long, node long, linked boolean")
    return found.groupBy("hub", "node").agg(F.max("linked").alias("linked"))  # a doc_id may have several sets


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets are linked."""
    if 100 * min(len(a), len(b)) < LEAST * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) < len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= LEAST * (len(a) + len(b) - both)


def _units(beside: DataFrame, members: DataFrame) -> DataFrame:
    """(hub, unit, side, node, shingles): what the hub leaves open in its group.

    Members that it links are connected already; only the others are compared, among
    themselves and with the linked ones, part by part. A group whose members all link
    with the hub has no units, however large it is. unit: number of a part of others,
    number of the other part, and whether that one is of linked members.
    """
    sizes = members.groupBy("node").agg(F.sum("size").alias("size"))
    sized = beside.join(sizes, "node")
    open_ = ~F.col("linked")
    count = lambda c: F.greatest(F.ceil(F.sum(F.when(c, F.col("size"))) / UNIT_SHINGLES), F.ceil(F.count(F.when(c, 1)) / UNIT_MEMBERS), F.lit(0)).cast("int")
    parts = sized.groupBy("hub").agg(count(open_).alias("others"), count(F.col("linked")).alias("ones"), F.count("*").alias("times"))
    dealt = common.join_counted(beside, common.stage(parts.where("others > 0 and times > 1"), "open-groups"), "hub")
    own = F.pmod(F.xxhash64("node"), F.when(open_, F.col("others")).otherwise(F.col("ones"))).cast("int")
    dealt = dealt.withColumn("part", own)
    span = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    unit = lambda i, j, linked: F.struct(i.alias("i"), j.alias("j"), F.lit(linked).alias("linked"))
    among = F.transform(span(F.col("others")), lambda x: unit(F.least(x, "part"), F.greatest(x, "part"), False))
    across = F.transform(span(F.col("ones")), lambda x: unit(F.col("part"), x, True))
    split = dealt.withColumn("unit", F.explode(F.when(open_, F.concat(among, across)).otherwise(F.transform(span(F.col("others")), lambda x: unit(x, F.col("part"), True)))))
    side = F.when(F.col("unit.linked"), F.when(open_, 0).otherwise(1)).when(F.col("unit.i") == F.col("unit.j"), 2).when(F.col("part") == F.col("unit.i"), 0).otherwise(1)
    return split.select("hub", "unit", side.cast("int").alias("side"), "node").join(members.select("node", "shingles"), "node")


def _links(units: DataFrame) -> DataFrame:
    """Confirmed links of each unit. Units are streamed: rows arrive sorted by unit and are held one unit at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sets, sides = None, [], [], []
        out: list[tuple[int, int]] = []

        def flush() -> None:
            if len(nodes) > 1:
                order = np.argsort(nodes, kind="stable")
                out.extend(confirm(np.array(nodes)[order], [sets[i] for i in order], np.array(sides)[order]))

        def batch_of() -> pa.RecordBatch:
            a, b = zip(*out)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for k, at in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)))):
                if at != key:
                    flush()
                    key, nodes, sets, sides = at, [], [], []
                nodes.append(batch.column(5)[k].as_py())
                sets.append(np.frombuffer(batch.column(6)[k].as_py(), np.uint64))
                sides.append(batch.column(4)[k].as_py())
            if len(out) > 10_000:
                yield batch_of()
        flush()
        if out:
            yield batch_of()

    key = ("hub", "i", "j", "linked")
    flat = units.select("hub", "unit.*", "side", "node", "shingles").select(*key, "side", "node", "shingles")
    return flat.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long")


def near_links(rows: DataFrame, sketched: DataFrame) -> DataFrame:
    """Confirmed links (a, b) between classes, each named by its least doc_id.

    sketched: sketches() of the rows, staged.
    """
    classes = sketched.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull()).groupBy("digest")
    nodes = common.stage(classes.agg(F.min("doc_id").alias("node"), F.max("bands").alias("bands")), "classes")
    keys = common.stage(nodes.select("node", F.explode("bands").alias("key")), "bands")
    hubs = keys.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("times")).where("times > 1")
    groups = common.stage(common.join_counted(keys, common.stage(hubs, "hubs"), "key").select("hub", "node").distinct(), "groups")
    wanted = groups.select("node").distinct().join(nodes.select("node", "digest"), "node")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(common.utf8(batch, "text"))
        keep = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() == d for s, d in zip(sets, batch.column(1).to_pylist())]
        sets = [s for s, k in zip(sets, keep) if k]
        nodes, digests = (batch.column(i).filter(pa.array(keep, pa.bool_())) for i in range(2))
        return pa.RecordBatch.from_arrays([nodes, digests, pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "digest", "size", "shingles"])

    texts = rows.withColumnRenamed("doc_id", "node").join(wanted, "node").select("node", "digest", "text")
    # a doc_id with several texts has a set for each
    members = common.over_text(texts, run, "node long, digest binary, size long, shingles binary", limit=SLICE_BYTES).dropDuplicates(["node", "digest"])
    members = common.stage(members, "sets")
    beside = common.stage(_beside_hub(_with_hub(groups, members)), "beside-hub")
    direct = beside.where("linked").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    return direct.unionByName(_links(_units(beside, members)))


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of docs."""
    rows = _numbered(docs)
    sketched = common.stage(sketches(rows), "sketches")
    return _components(rows, sketched)


def _components(rows: DataFrame, sketched: DataFrame) -> DataFrame:
    # copies link to the least id of their class, and an id with several texts links its classes
    real = sketched.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    named = real.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count("*").alias("times")).where("times > 1")
    # a text that a third of all documents copy is a hot key
    copies = common.join_counted(real.select("doc_id", "digest"), common.stage(named, "named"), "digest").where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    found = graph.components(near_links(rows, sketched).unionByName(copies))
    labelled = sketched.select("doc_id", "size").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return labelled.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that stand for their component. Without a column doc_id all do."""
    gone = components(docs).where(~F.col("kept")).select("doc_id").distinct()
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    at = common.column_at(docs.columns, "doc_id")
    if at is None:
        return docs
    return plain.join(gone, plain[f"c{at}"].cast("long") == gone["doc_id"], "left_anti").toDF(*docs.columns)
