"""Near-duplicate documents by the Jaccard similarity of their sets of word shingles, for the pipeline's near-dedup stage.

The first candidates are the SimHash links of ``simhash``, found by its variants that leave out a bit, which bind copies of similarity near 1.
64 bits cannot tell a similarity of 0.8 (about 10 differing bits) from chance by equal segments, so further candidates are texts that
agree in one of ``BANDS`` groups of ``ROWS`` minimum hashes. A pair at 0.8 is none with a chance of (1 - 0.8^7)^50 = 8e-6.

Candidates meet inside one task per bucket, where sketches (a byte of each minimum hash) estimate their similarity, and only pairs that
may reach the bound count, each in the first bucket that both share. The estimate's deviation is 0.021 at 0.8, so with a
margin of ``MARGIN`` a pair is pruned wrongly with a chance of 1e-5. Links are verified on the sets themselves. No bucket writes its
pairs: in each round a text asks for the ``PARTNERS`` likeliest of other components, so that a group of copies comes together over few
links; then all pairs still left between components are verified inside their buckets, which the sets are sent to, and a bucket gives
a forest of its links. Buckets larger than ``HOT`` are cut into parts that all hold the same few members, and at last into pairs of parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from xxhash import xxh64_intdigest as digest

from routelore.llm.shared import salted_join
from routelore.llm.simhash import fingerprint, links as near_fingerprints, shingle_hashes, stars
from routelore.sources.staging import stage_table

BANDS, ROWS = 50, 7
SKETCH, MARGIN = BANDS * ROWS, 0.09
#: Bytes that travel with a class: its sketch, and four of the key of each band.
SENT = SKETCH + 4 * BANDS
HOT = 1024
#: Members that every part of a large bucket holds.
SHARED = 4
#: Rounds of some partners for each text, at most.
ROUNDS, PARTNERS = 3, 2


def shingle_set(text: str | None, words: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, words), dtype=np.uint64))


def set_number(own: np.ndarray) -> int:
    """A signed 64-bit number of the set; equal sets are one class."""
    return int(np.uint64(digest(own.tobytes(), 1)).astype(np.int64))


def minimum_hashes(own: np.ndarray) -> np.ndarray:
    rng = np.random.default_rng(5)
    factor, shift = (rng.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) for _ in range(2))
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for lo in range(0, len(own), 256):  # in pieces that stay in the cache
        least = np.minimum(least, (own[lo : lo + 256, None] * (factor | np.uint64(1)) + shift).min(axis=0))
    return least


def signature(text: str | None, words: int) -> tuple[int, list[int], bytes]:
    """Number of the shingle set, a signed key for each band, and what is sent of it; no keys for an empty set."""
    own = shingle_set(text, words)
    if not len(own):
        return set_number(own), [], bytes(SENT)
    least = minimum_hashes(own)
    keys = np.array([digest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, ROWS))], np.uint64)
    sent = (least >> np.uint64(40)).astype(np.uint8).tobytes() + keys.astype("<u4").tobytes()
    return set_number(own), keys.astype(np.int64).tolist(), sent


def place_hash() -> Column:
    return F.xxhash64("doc_id", F.xxhash64("text"))


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text_hash, at (a hash of both), class, keys, sketch and SimHash fingerprint of every row."""
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("text_hash", T.LongType()), T.StructField("at", T.LongType()), T.StructField("class", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType()), T.StructField("fp", T.LongType())]

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [signature(t.as_py(), words) for t in b.column("text")]
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int64(), pa.list_(pa.int64()), pa.binary()))]
            columns.append(pa.array([fingerprint(t.as_py()) for t in b.column("text")], pa.int64()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "text_hash", "at")), *columns], names=[f.name for f in fields])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), place_hash().alias("at"), "text").mapInArrow(signed, T.StructType(fields))


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """class and own (the sorted set as bytes) of every row."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), words) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(map(set_number, sets), pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["class", "own"])

    return texts.select("text").mapInArrow(listed, "class long, own binary")


def simhash_pairs(own: DataFrame) -> DataFrame:
    """Pairs (u, v) of classes, each both ways, that join all whose fingerprints are linked; equal ones join the first class of theirs."""
    held = stage_table(own.groupBy("fp", "class").agg(F.count("*").alias("n")).select("fp", "class"), "class_fingerprints")
    first = stage_table(held.groupBy("fp").agg(F.min("class").alias("first")), "first_classes")
    equal = salted_join(held, first, ["fp"], ["class"], salts=4, how="inner").select(F.col("class").alias("u"), F.col("first").alias("v"))
    named = [first.select(F.col("fp").alias(f"{c}_fp"), F.col("first").alias(c)) for c in ("u", "v")]
    far = near_fingerprints(first.select("fp")).select(F.col("u").alias("u_fp"), F.col("v").alias("v_fp")).distinct()
    pairs = far.join(named[0], "u_fp").join(named[1], "v_fp").select("u", "v").unionAll(equal).where("u <> v")
    return pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))


def near_places(sketches: np.ndarray, asks: np.ndarray, roots: np.ndarray, band: int, least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each asking member of a band's bucket the places of those of other components whose estimated similarity reaches ``least`` and
    that it shares no earlier band with, and how many hashes agree."""
    sketches, names = sketches[:, :SKETCH], np.ascontiguousarray(sketches[:, SKETCH:]).view("<u4")
    bound = int(np.ceil((least * 255 / 256 + 1 / 256) * SKETCH))
    for lo in range(0, len(asks), 32):
        own = asks[lo : lo + 32]
        other = roots[own][:, None] != roots[None]
        agree = (sketches[own][:, None] == sketches[None]).sum(axis=2, dtype=np.int32)
        for i, row, near in zip(own, agree, other & (agree >= bound)):
            near = np.flatnonzero(near)
            if len(near):
                near = near[(names[near] == names[i]).argmax(axis=1) == band]
                yield i, near, row[near]


def by_buckets(batches: Iterator[pa.RecordBatch], found: Callable[[pa.Table], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is found in tables that hold whole buckets, from batches sorted by key."""
    held: list[pa.RecordBatch] = []
    for b in batches:  # sorted by key, so only the last key may go on in the next batch
        held.append(b)
        keys = b.column("key").to_numpy()
        if len(keys) and (keys[0] != keys[-1] or held[0].column("key")[0].as_py() != keys[0]):
            t = pa.Table.from_batches(held).combine_chunks()
            cut = int(np.searchsorted(t.column("key").to_numpy(), keys[-1]))
            yield found(t.slice(0, cut))
            held = t.slice(cut).combine_chunks().to_batches()
    if held:
        yield found(pa.Table.from_batches(held))


def near_members(t: pa.Table, least: float) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each member of the buckets that asks: start of its bucket, its place, the places of those held that may be similar to it and
    how many hashes agree; places count from the start."""
    key, root, band = (t.column(c).to_numpy() for c in ("key", "root", "band"))
    asks, has = (t.column(c).to_numpy(zero_copy_only=False) for c in ("asks", "held"))
    sketches = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(t), SENT)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    for lo, n in zip(starts, np.diff(np.r_[starts, len(key)])):
        own = slice(lo, lo + n)
        if n < 2 or (root[own] == root[lo]).all():
            continue
        for i, near, agree in near_places(sketches[own], np.flatnonzero(asks[own]), root[own], band[lo], least):
            yield lo, i, near[has[own][near]], agree[has[own][near]]


def asked_pairs(members: DataFrame, least: float, best: bool) -> DataFrame:
    """Pairs (u, v) of classes that may be similar and the number of hashes that agree, from members (key, band, class, root, sketch, asks,
    held). With ``best`` a class asks for the likeliest of a bucket only."""

    def pairs(t: pa.Table) -> pa.RecordBatch:
        cls = t.column("class").to_numpy()
        us, vs, agreed = [], [], []
        for lo, i, near, agree in near_members(t, least):
            if best and len(near):
                first = np.lexsort((cls[lo + near], -agree))[:1]
                near, agree = near[first], agree[first]
            us.extend([cls[lo + i]] * len(near))
            vs.extend(cls[lo + near])
            agreed.extend(agree)
        return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64()), pa.array(agreed, pa.int32())], names=["u", "v", "agree"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from by_buckets(batches, pairs)

    rows = members.select("key", "band", "class", "root", "sketch", "asks", "held").repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(met, "u long, v long, agree int")


def reaching(own: np.ndarray, others: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of the other sets have the similarity to one's own; none is empty."""
    sizes = np.array([len(x) for x in others])
    every = np.concatenate(others)
    equal = own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every
    both = np.add.reduceat(equal, np.r_[0, sizes.cumsum()[:-1]], dtype=np.int64)
    return both >= similarity * (len(own) + sizes - both)


def bucket_links(members: DataFrame, sets: DataFrame, least: float, similarity: float) -> DataFrame:
    """Links (u, v) of classes, verified on their sets, that join all components which links within a bucket join: for a bucket fewer than
    its components, however many of its pairs may be similar. Only members that may be similar to one of another component are
    sent their sets (class, own)."""
    columns = ["key", "band", "class", "root", "sketch", "asks", "held"]

    def concerned(t: pa.Table) -> pa.RecordBatch:
        some = np.zeros(len(t), bool)
        for lo, i, near, _ in near_members(t, least):
            some[lo + near] = True
            some[lo + i] |= len(near) > 0
        return t.filter(pa.array(some)).select(columns).combine_chunks()

    def linked(t: pa.Table) -> pa.RecordBatch:
        cls, own = t.column("class").to_numpy(), [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("own")]
        label = np.unique(t.column("root").to_numpy(), return_inverse=True)[1]
        at, us, vs = -1, [], []
        for lo, i, near, _ in near_members(t, least):
            if lo != at:
                at, joined = lo, label.copy()
            near = lo + near
            near = near[joined[near] != joined[lo + i]]
            if len(near):
                for j in near[reaching(own[lo + i], [own[j] for j in near], similarity)]:
                    if joined[j] != joined[lo + i]:
                        us.append(cls[lo + i])
                        vs.append(cls[j])
                        joined[joined == joined[j]] = joined[lo + i]
        return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    def may_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in by_buckets(batches, concerned):
            yield from found.to_batches()

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from by_buckets(batches, linked)

    dealt = lambda rows: rows.repartition("key").sortWithinPartitions("key")
    some = dealt(members.select(*columns)).mapInArrow(may_link, members.select(*columns).schema)
    return dealt(some.join(sets.select("class", "own"), "class")).mapInArrow(forest, "u long, v long")


def in_parts(rows: DataFrame) -> DataFrame:
    """Members (key, band, many, class, root, sketch) of buckets, those of buckets above ``HOT`` dealt over parts that all hold the same few."""
    rows = rows.withColumns({"asks": F.lit(True), "held": F.lit(True)})
    parts = F.ceil(F.col("many") / (HOT // 2)).cast("int")
    columns = ["band", "class", "root", "sketch", "asks", "held"]
    part = F.when(F.col("many") > HOT, F.pmod(F.xxhash64("class"), parts)).otherwise(0).cast("int")
    dealt = rows.select("key", part.alias("part"), *columns)
    of_large = rows.where(F.col("many") > HOT).withColumn("parts", parts)
    few = of_large.groupBy("key", F.pmod(F.xxhash64("class", F.lit(1)), F.lit(SHARED)).alias("__pick")).agg(F.min_by(F.struct(*columns, "parts"), F.xxhash64("class", F.lit(2))).alias("one"))
    few = few.select("key", F.explode(F.sequence(F.lit(0), F.col("one.parts") - 1)).alias("part"), *[F.col(f"one.{c}").alias(c) for c in columns])
    cut = dealt.unionAll(few)
    return cut.select(F.when(F.col("part") == 0, F.col("key")).otherwise(F.xxhash64("key", "part")).alias("key"), *columns)


def in_pairs_of_parts(rows: DataFrame) -> DataFrame:
    """Members of buckets so that every two of different components meet: those outside a large bucket's commonest component
    ask, part by part, all of its parts."""
    rows = rows.withColumns({"asks": F.lit(True), "held": F.lit(True)})
    large = rows.where(F.col("many") > HOT)
    if not large.take(1):
        return rows
    shares = large.groupBy("key", "root").agg(F.count("*").alias("n"))
    common = shares.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("common"), F.sum("n").alias("all"), F.max("n").alias("most"))
    part = lambda n: F.ceil(n / (HOT // 2)).cast("int")
    common = stage_table(common.select("key", "common", part(F.col("all")).alias("parts"), part(F.col("all") - F.col("most")).alias("outer")), "large_buckets")
    columns = ["key", "band", "class", "root", "sketch", "asks", "held"]
    wide = salted_join(large, common.where("outer > 0"), ["key"], ["class"], salts=8, how="inner")
    own, every = (lambda c, seed: F.pmod(F.xxhash64("class", F.lit(seed)), F.col(c)).cast("int")), (lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1)))
    asking = wide.where("root <> common").withColumns({"a": own("outer", 3), "held": F.lit(False)}).withColumn("b", every("parts"))
    asked = wide.withColumns({"b": own("parts", 4), "asks": F.lit(False)}).withColumn("a", every("outer"))
    met = asking.unionByName(asked).withColumn("key", F.xxhash64("key", "a", "b"))
    return rows.where(F.col("many") <= HOT).select(*columns).unionAll(met.select(*columns))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) of classes whose sets have the similarity. A class that very many pairs name is a skewed key of an inner
    join, which adaptive execution splits; its one set is then read once per split."""

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b.column("a"), b.column("b")):
                x, y = (np.frombuffer(z.as_py(), np.uint64) for z in (x, y))
                fits = min(len(x), len(y)) >= similarity * max(len(x), len(y))
                both = len(np.intersect1d(x, y, assume_unique=True)) if fits else 0
                good.append(both >= similarity * (len(x) + len(y) - both))
            yield b.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    first = pairs.join(sets.select(F.col("class").alias("u"), F.col("own").alias("a")), "u")
    return first.join(sets.select(F.col("class").alias("v"), F.col("own").alias("b")), "v").select("u", "v", "a", "b").mapInArrow(alike, "u long, v long")


def partial_roots(edges: DataFrame) -> DataFrame:
    """class and root for the classes of some links: the least neighbour, and from there twice on. Enough to keep most of a group from
    asking again; components need ``stars``."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    found = stage_table(both.groupBy(F.col("u").alias("class")).agg(F.least(F.min("v"), F.min("u")).alias("root")), "least_neighbours")
    for _ in range(2):
        found = found.join(found.select(F.col("class").alias("root"), F.col("root").alias("next")), "root").select("class", F.col("next").alias("root"))
    return found


def apart(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The members (class, key, band, root, many) of buckets that hold several components."""
    if roots is None:
        placed = rows.withColumn("root", F.col("class"))
    else:
        placed = rows.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    sizes = placed.groupBy("key").agg(F.count("*").alias("many"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    return salted_join(placed.select("class", "key", "band", "root"), sizes.select("key", "many"), ["key"], ["class"], salts=4, how="inner")


def roots_of_classes(docs: DataFrame, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, text_hash, class), and (class, root) of the classes that are not their component's smallest."""
    own = stage_table(signatures(docs, words), "signatures")
    classes = stage_table(own.groupBy("class").agg(F.min("at").alias("at"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")), "classes")
    alike = stage_table(simhash_pairs(own), "simhash_pairs")
    own = own.select("doc_id", "text_hash", "class")
    rows = classes.select("class", F.posexplode("keys").alias("band", "key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("many")).where("many > 1")
    rows = stage_table(salted_join(rows, shared, ["key"], ["class"], salts=4, how="inner").select("class", "key", "band", "many"), "shared_keys")
    least = similarity - MARGIN

    def picked(members: DataFrame) -> DataFrame:
        """Each asking class with its likeliest partners, one of a bucket."""
        likeliest = F.slice(F.sort_array(F.collect_list(F.struct("agree", "v")), asc=False), 1, PARTNERS)  # one row per band at most
        return asked_pairs(members, least, True).groupBy("u").agg(likeliest.alias("p")).select("u", F.explode("p.v").alias("v"))

    def either_way(pairs: DataFrame) -> DataFrame:
        return stage_table(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "chosen_pairs")

    # The SimHash links are verified first, with those of the first round. They tell which classes may be similar to any other, as all of
    # these ask; later rounds concern them only, and all classes of large buckets, whose parts have not met yet.
    members = rows.join(classes.select("class", "sketch"), "class").withColumn("root", F.col("class"))
    pairs = stage_table(picked(in_parts(members)).unionAll(alike), "pairs")
    none = rows.select("class", F.col("class").alias("root")).where("false")
    near = pairs.select(F.col("u").alias("class")).unionAll(rows.where(F.col("many") > HOT).select("class")).distinct()
    if not near.take(1):
        return own, none
    near = stage_table(classes.join(near, "class", "left_semi").select("class", "at", "sketch"), "near_classes")
    # One text of each class: equal texts differ in their ids, and rows equal in both are spread by their number.
    texts = docs.select("text", place_hash().alias("__at"), F.monotonically_increasing_id().alias("__n"))
    sets = shingle_sets(salted_join(texts, near.select(F.col("at").alias("__at")).distinct(), ["__at"], ["__n"], salts=4, how="left_semi"), words)
    sets = stage_table(sets.groupBy("class").agg(F.first("own").alias("own")), "shingle_sets")
    rows = stage_table(rows.join(near.select("class"), "class", "left_semi").select("class", "key", "band"), "near_keys")
    sketched = lambda members: members.join(near.select("class", "sketch"), "class")

    chosen = either_way(pairs)
    tested, links = chosen, stage_table(verified(chosen, sets, similarity), "similar")
    for _ in range(1, ROUNDS):
        chosen = either_way(picked(in_parts(sketched(apart(rows, partial_roots(links))))).join(tested.unionAll(tested.select(F.col("v").alias("u"), F.col("u").alias("v"))), ["u", "v"], "left_anti"))
        new = stage_table(verified(chosen, sets, similarity), "similar")
        if not new.take(1):
            break
        tested, links = tested.unionAll(chosen), links.unionAll(new)
    # What is still apart is held against all that it may be similar to, in the buckets themselves.
    roots = stage_table(stars(links).withColumnRenamed("node", "class"), "roots")
    left = stage_table(sketched(apart(rows, roots)), "apart")
    new = stage_table(bucket_links(in_pairs_of_parts(left), sets, least, similarity), "similar")
    if not new.take(1):
        return own, roots
    # Links between former roots; the former classes follow theirs.
    at = lambda c: F.coalesce(F.col(f"{c}_root"), F.col(c)).alias(c)
    named = [roots.select(F.col("class").alias(c), F.col("root").alias(f"{c}_root")) for c in ("u", "v")]
    step = stage_table(stars(new.join(named[0], "u", "left").join(named[1], "v", "left").select(at("u"), at("v"))).withColumnRenamed("root", "next"), "root_steps")
    followed = roots.join(step, roots["root"] == step["node"], "left").select("class", F.coalesce("next", "root").alias("root"))
    return own, followed.unionAll(step.select(F.col("node").alias("class"), F.col("next").alias("root")))


def components(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per document: doc_id, text_hash, component, a number of its component.

    Texts link whose sets of word shingles have at least this Jaccard similarity (1 for equal sets, two empty ones as well: null, empty
    and white texts are one component). Rows that repeat an id are documents of their own, and so are those without one.
    """
    own, roots = roots_of_classes(docs, words, similarity)
    found = salted_join(own, roots, ["class"], ["doc_id", "text_hash"])
    return found.select("doc_id", "text_hash", F.coalesce("root", "class").alias("component"))


def deduplicated(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents with one of each component left, that with the smallest doc_id; a null one only where there is no other, ties
    go to a hash of the text, and of rows that agree in both one stays.

    Documents are told apart by id and text, so no text is lost for sharing its id or having none. All columns are kept, whatever
    their names. An empty table gives an empty table.
    """
    found = components(docs, words, similarity)
    per = found.groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("copies"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "copies")
    best = per.groupBy("component").agg(F.min(order).alias("one"))
    kept = best.select(F.xxhash64("one.doc_id", "one.text_hash").alias("__at"), F.col("one.text_hash").alias("__hash"), F.col("one.copies").alias("__copies"))
    kept = stage_table(kept, "kept_documents")

    def rows(which: str) -> DataFrame:
        own = docs.withColumns({"__at": place_hash(), "__hash": F.xxhash64("text"), "__n": F.monotonically_increasing_id()})
        found = salted_join(own, kept.where(which).drop("__copies"), ["__at", "__hash"], ["__n"], salts=4, how="left_semi")
        return found.select(*[F.col(f"`{c}`") for c in docs.columns], *["__at", "__hash"])

    single = rows("__copies = 1").drop("__at", "__hash")
    if not kept.where("__copies > 1").take(1):
        return single
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    one = rows("__copies > 1").groupBy("__at", "__hash").agg(F.first(whole).alias("__row"))
    return single.unionAll(one.select(*[F.col(f"__row.c{i}").alias(c) for i, c in enumerate(docs.columns)]))
