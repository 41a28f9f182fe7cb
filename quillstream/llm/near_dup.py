"""Near-duplicate documents by BagMinHash (operator 7).

A document is the bag of its five-word shingles. Its signature is that of weighted minwise hashing: every
shingle owns independent Poisson processes on the dyadic intervals [0, 1), [1, 2), [2, 4), ... of the weight
axis. A point carries a time, a signature register and a place on the weight axis, and counts for a document
if the place lies below the shingle's weight there; a register keeps the earliest time. Points are generated
in the order of time and only up to a bound that suffices to fill all registers, so the work per shingle does
not grow with its weight, and two registers agree with a probability equal to the weighted Jaccard similarity.

Equal bags are one class from the start. Classes that agree in a band
of registers are candidates. Members of a bucket of at most ``SMALL`` are all compared. In a larger bucket they are
first held against one pivot only, the member whose bands are the most common, which is the middle of a family
of near copies. Buckets with common members make a family; those of its members that the pivots did not bring
into its largest class are then searched for links to all others, in blocks of ``BLOCK`` of them that each meet
the family as a stream: a task holds one block, and what leaves it is a forest of links. A candidate is a link if
the exact bags overlap by 0.8 or more. The class of a document is the smallest doc_id of its connected component.

Defined cases: words are runs of ASCII letters, digits and non-ASCII characters in lower case; a text of fewer
than five words is one shingle; texts without a word (null, empty) form one class; rows are told apart by doc_id and
text, so rows of one doc_id get the class of their own text; rows with a null doc_id take part, come after all others
and give a null class where they are alone in it; texts of any length are read whole; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, release, table
from .graph import components
from .wordhash import U64, Words, bitmap_of, mix, pieces, seeded, signed

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 25, 4
REGISTERS = BANDS * ROWS
SMALL, BLOCK = 32, 256
#: Registers that must agree before bags of a large family are compared: five standard deviations below 0.8.
LEAST_AGREE = 60
MEMBERS_PER_SALT = 256
_LOW = U64((1 << 44) - 1)


def bags(words: Words, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, shingle (44 bits of its hash) and count, in the order of text and shingle."""
    hashes, at = words.shingles(SHINGLE)
    doc = words.doc[at]
    counts = np.diff(words.first)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        own = np.array([int(np.bitwise_xor.reduce(seeded(words.hashes[words.first[d] : words.first[d + 1]] * U64(2) + np.arange(counts[d], dtype=U64), 11))) for d in short], dtype=U64)
        doc, hashes = np.concatenate([doc, short]), np.concatenate([hashes, own])
    keys = np.sort((doc.astype(U64) << U64(44)) | (hashes >> U64(20)))
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return (keys[new] >> U64(44)).astype(np.int64), keys[new] & _LOW, np.diff(np.append(new, len(keys)))


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int) -> np.ndarray:
    """``texts`` rows of ``REGISTERS`` earliest times; inf for texts without a shingle."""
    total = np.bincount(doc, weight, texts)
    times = np.full((texts, REGISTERS), np.inf)
    with np.errstate(divide="ignore"):
        bound = (np.log(REGISTERS) + 4) / total
    todo = np.flatnonzero(total > 0)
    while len(todo):
        wanted = np.zeros(texts, bool)
        wanted[todo] = True
        mine = wanted[doc]
        d, s, w = doc[mine], shingle[mine], weight[mine]
        octave = 0
        while len(d):
            low, width = (0, 1) if octave == 0 else (1 << (octave - 1), 1 << (octave - 1))
            _points(times, bound, d, s, w, octave, low, width)
            more = w > low + width
            d, s, w, octave = d[more], s[more], w[more], octave + 1
        todo = todo[np.isinf(times[todo]).any(axis=1)]
        bound[todo] *= 3
    return times


def _points(times: np.ndarray, bound: np.ndarray, d: np.ndarray, s: np.ndarray, w: np.ndarray, octave: int, low: int, width: int) -> None:
    """Enter the points of one dyadic interval of the weight axis into the registers."""
    clock, step, flat = np.zeros(len(d)), 0, times.reshape(-1)
    seed = seeded(s, 1000 + octave)
    while len(d):
        step += 1
        r = seeded(seed, step)
        clock = clock - np.log(((r >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (REGISTERS * width)
        alive = clock <= bound[d]
        d, w, seed, clock, r = d[alive], w[alive], seed[alive], clock[alive], r[alive]
        q = mix(r + U64(step))
        register = ((q >> U64(32)) * U64(REGISTERS) >> U64(32)).astype(np.int64)
        place = low + (((q & U64(0xFFFFFFFF)) * U64(width)) >> U64(32)).astype(np.int64)
        ok = place < w
        np.minimum.at(flat, d[ok] * REGISTERS + register[ok], clock[ok])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in pieces(batch):
            n = part.num_rows
            doc, shingle, weight = bags(Words(data, offsets), n)
            one, two = (np.zeros(n, U64) for _ in range(2))
            np.add.at(one, doc, seeded(shingle, 1) * weight.astype(U64))
            np.add.at(two, doc, seeded(shingle, 2) * weight.astype(U64))
            times = signatures(doc, shingle, weight, n)
            bits = np.ascontiguousarray(times).view(U64).reshape(n, BANDS, ROWS)
            keys = np.zeros((n, BANDS), U64)
            for k in range(ROWS):
                keys = mix(keys * U64(31) + bits[:, :, k])
            keys = seeded(keys, 5) ^ seeded(np.arange(BANDS, dtype=U64), 6)
            size = np.bincount(doc, weight, n).astype(np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32)), pa.array(signed(keys).reshape(-1)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(signed(one)), pa.array(signed(two)), pa.array(size), bands], names=["node", "bag1", "bag2", "n", "bands"])


def _bag_rows(wanted) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy()
            batch = batch.filter(pa.array(wanted.value.has(mix(ids.view(U64)))))
            for part, data, offsets in pieces(batch):
                doc, shingle, weight = bags(Words(data, offsets), part.num_rows)
                packed = np.stack([shingle, weight.astype(U64)], axis=1)
                ends = np.searchsorted(doc, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([packed[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())], names=["node", "bag"])

    return run


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two packed bags."""
    common, i, j = np.intersect1d(a[:, 0], b[:, 0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[i, 1], b[j, 1]).sum())
    either = int(a[:, 1].sum() + b[:, 1].sum()) - both
    return both / either if either else 1.0


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come with each pivot's bag before those of its members; only one pivot is held."""
    pivot, bag = None, None
    unpack = lambda x: np.frombuffer(x, U64).reshape(-1, 2)
    for batch in batches:
        a, b, found = [], [], []
        for p, member, own in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("bag")):
            own = unpack(own.as_buffer())
            if member is None:
                pivot, bag = p, own.copy()
            elif pivot == p:
                a.append(p)
                b.append(member)
                n, m = int(bag[:, 1].sum()), int(own[:, 1].sum())
                found.append(min(n, m) >= THRESHOLD * max(n, m) and overlap(bag, own) >= THRESHOLD)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(found, pa.bool_())], names=["a", "b", "same"])


def packed_bags(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """``node, bag`` of the documents listed in ``ids`` and of few others. ``docs``: node and lower-case text."""
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap_of(ids.mapInArrow(_mixed, "h long"), "h"))
    return durable(docs.mapInArrow(_bag_rows(wanted), "node long, bag binary").dropDuplicates(["node"]), "bags")


def verified(pairs: DataFrame, packed: DataFrame) -> DataFrame:
    """``a, b, same`` for distinct ``pairs`` (pivot a, member b)."""
    salts = pairs.groupBy("a").agg(F.count("*").alias("members")).select("a", (F.floor(F.col("members") / MEMBERS_PER_SALT) + 1).alias("salts"))
    pivots = packed.join(salts, packed.node == salts.a).select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "bag")
    members = pairs.join(salts, "a").join(packed, pairs.b == packed.node).select("a", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"), "b", "bag")
    return pivots.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()).mapInArrow(_verify, "a long, b long, same boolean")


def _sketch(bag_list: list[np.ndarray]) -> np.ndarray:
    doc = np.repeat(np.arange(len(bag_list)), [len(b) for b in bag_list])
    both = np.concatenate(bag_list) if bag_list else np.zeros((0, 2), U64)
    return signatures(doc, both[:, 0], both[:, 1].astype(np.int64), len(bag_list))


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by family and block, the block's own members first; emits links that join labels not yet joined here."""
    place, own, sketch, parent = None, [], None, {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    for batch in batches:
        found: list[tuple[int, int]] = []
        columns = [batch.column(c).to_pylist() for c in ("family", "block", "asks", "rep", "label")]
        bags_here = [np.frombuffer(x.as_buffer(), U64).reshape(-1, 2) for x in batch.column("bag")]
        meets = _sketch(bags_here) if bags_here else None
        for i, (family, block, asks, rep, label) in enumerate(zip(*columns)):
            if place != (family, block):
                place, own, sketch, parent = (family, block), [], None, {}
            if asks:
                own.append((rep, label, bags_here[i].copy(), meets[i].copy()))
                continue
            if sketch is None:
                sketch = np.array([o[3] for o in own]).reshape(-1, REGISTERS)
            for j in np.flatnonzero((sketch == meets[i]).sum(axis=1) >= LEAST_AGREE):
                other, its, bag, _ = own[j]
                if root(its) != root(label) and overlap(bag, bags_here[i]) >= THRESHOLD:
                    parent[root(its)] = root(label)
                    found.append((other, rep))
        a, b = zip(*found) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _leftovers(stars: DataFrame, linked: DataFrame, packed: DataFrame) -> DataFrame:
    """Links (a, b) between members of a family whom pivots left apart."""
    family = components(stars).select(F.col("node").alias("rep"), F.col("label").alias("family"))
    named = durable(family.join(linked, family.rep == linked.node, "left").select("family", "rep", F.coalesce("label", "rep").alias("label")), "families")
    size = named.groupBy("family", "label").count()
    main = size.groupBy("family").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.sum("count").alias("all"), F.max("count").alias("most")).where("all > most")
    split = main.select("family", "main", F.ceil((F.col("all") - F.col("most")) / BLOCK).alias("blocks"))
    met = named.join(split, "family").join(packed, named.rep == packed.node).select("family", "rep", "label", "bag", "main", "blocks")
    ask = met.where("label <> main").select("family", F.pmod(F.xxhash64("rep"), F.col("blocks")).alias("block"), F.lit(True).alias("asks"), "rep", "label", "bag")
    hear = met.select("family", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("asks"), "rep", "label", "bag")
    return ask.unionByName(hear).repartition("family", "block").sortWithinPartitions("family", "block", F.desc("asks")).mapInArrow(_search, "a long, b long")


def _mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(signed(mix(batch.column(0).to_numpy().view(U64))))], names=["h"])


def _named(docs: DataFrame, text: str, doc_id: str) -> tuple[DataFrame, bool]:
    """``node, doc_id, text_hash, text`` of all rows; a node is the doc_id, or a hash of it and the text where doc_ids are null or repeated."""
    own = F.col(doc_id).cast("long")
    alone = docs.groupBy(own.alias("i")).count().where("count > 1 or i is null").isEmpty()
    text_hash = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    node = own if alone else F.xxhash64(own, text_hash)
    return docs.select(node.alias("node"), own.alias("doc_id"), text_hash.alias("text_hash"), F.lower(F.col(text)).alias("text")), alone


def _classes(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """``node, doc_id, text_hash, label``: rows of one class have one label, the smallest node of theirs."""
    named, alone = _named(docs, text, doc_id)
    slim = named.select("node", "text")
    signed_docs = durable(slim.mapInArrow(_sign, "node long, bag1 long, bag2 long, n long, bands array<long>"), "bag-signatures")
    reps = durable(signed_docs.groupBy("bag1", "bag2", "n").agg(F.min("node").alias("rep"), F.first("bands").alias("bands")), "bag-classes")
    banded = reps.where("n > 0").select("rep", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    buckets = durable(banded.join(shared, "band").select("band", "rep", "size"), "buckets")  # few beside the bands of all documents
    small, large = buckets.where(F.col("size") <= SMALL), buckets.where(F.col("size") > SMALL)
    alike = small.alias("x").join(small.alias("y"), (F.col("x.band") == F.col("y.band")) & (F.col("x.rep") < F.col("y.rep"))).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    common = large.groupBy("rep").agg(F.sum("size").alias("common"))
    middle = large.join(common, "rep").groupBy("band").agg(F.max_by("rep", F.struct("common", -F.col("rep"))).alias("a"))
    stars = durable(large.join(middle, "band").where("rep <> a").select("a", F.col("rep").alias("b")).distinct(), "stars")
    pairs = durable(alike.unionByName(stars).distinct(), "pairs")
    packed = packed_bags(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), slim)
    links = durable(verified(pairs, packed).where("same").select("a", "b"), "links")
    linked = components(links)
    if not stars.isEmpty():
        linked = components(linked.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(_leftovers(stars, linked, packed)))
    release(buckets, pairs, links)
    joined = linked.withColumnRenamed("node", "rep")
    labels = reps.join(joined, "rep", "left").select("bag1", "bag2", "n", F.coalesce("label", "rep").alias("label"))
    found = signed_docs.select("node", "bag1", "bag2", "n").join(labels, ["bag1", "bag2", "n"]).select("node", "label")
    if alone:
        return found.select("node", F.col("node").alias("doc_id"), F.lit(0).cast("long").alias("text_hash"), "label")
    names = named.select("node", "doc_id", "text_hash").distinct()
    return durable(found.distinct(), "row-classes").join(names, "node")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, class_id`` for every row of ``docs``."""
    named, alone = _named(docs, text, doc_id)
    classes = _classes(docs, text, doc_id)
    if alone:
        return classes.select("doc_id", F.col("label").alias("class_id"))
    least = classes.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    return named.select("node", "doc_id").join(classes.select("node", "label"), "node").join(least, "label").select("doc_id", "class_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """The first row of each class of near copies, by doc_id and then text; all columns kept."""
    classes = _classes(docs, "text", "doc_id")
    name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    firsts = classes.groupBy("label").agg(F.min(name).alias("f")).select(F.col("f.doc_id").alias("_d"), F.col("f.text_hash").alias("_h"))
    own = F.xxhash64(F.coalesce("text", F.lit("")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_d")) & ((F.col("_h") == 0) | (F.col("_h") == own))
    kept = docs.join(firsts, same, "left_semi")
    _, alone = _named(docs, "text", "doc_id")
    if not alone:  # rows that are equal in doc_id and text
        turn = F.row_number().over(Window.partitionBy("doc_id", own).orderBy(F.lit(0)))
        kept = kept.withColumn("_turn", turn).where("_turn = 1")
    return kept.select(*docs.columns)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
