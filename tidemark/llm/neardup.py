"""N-gram Jaccard join by parity sketches, and the connected components of its links.

A document is its set of distinct shingles. Shingles are XOR-hashed into bit sketches: each toggles one bit, so what
two sets share cancels out and the Hamming distance of their sketches is at most the size of their symmetric
difference. At a Jaccard similarity of 0.8 or more that difference D is at most a ninth of the summed sizes.

* Sets whose sizes can be similar meet in a size band. In a band with difference D at most, the sketch is cut into
  D + slack blocks (each of 2^20 bits, kept as a 64-bit fingerprint that is linear in the bits): by the pigeonhole
  principle at least ``slack`` blocks agree. Blocks are the keys of the join.
* A key shared by more than CROWD sets, or of a block without any bit, says little. A set with fewer such keys than
  its slack doesn't need them, as any partner agrees with it in a better block too; only the other sets keep them.
* In each key's bucket all sets are paired with the first. Pairs pass a size filter and the Hamming filter on 1024-bit
  sketches; what is left is verified on the shingles of the whole texts. Where a bucket still holds several
  components, the sets outside its main one are paired with all sets of other components, so that no link between
  components is lost, while a large group of near copies never makes all its pairs.

Equal sets are one node (the least id), so exact copies cost nothing beyond the first pass. Rows with one id are one
document with several texts, linked if any of them is. A null or blank text has no shingles and is its own component;
a null id is linked with nothing. Ids are whole numbers, or of any type that has an order. Repeated rows have equal
results; an empty table has an empty one. A text of any length is one set, taken whole. Only the columns named are read (all
of ``one_of_each``'s input is handed on), so others may have any name. Results don't depend on order or partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tidemark.llm.common import documents, flat_bytes, persisted, scratch, text_chunks
from tidemark.llm.grams import ODD, U, mixed, windows, word_hashes

#: Words of a shingle; the similarity of a link, in hundredths.
WORDS, SIMILAR = 5, 80

#: Keys shared by more sets are not informative.
CROWD = 16

#: 64-bit words of the sketch for the Hamming filter.
SKETCH = 16

#: Partners of one set that are verified in one group.
GROUP = 64

#: Broadcast tables of ids have at most so many rows (16 bytes each, some 50 MB as a hash table).
BROADCAST_IDS = 1_000_000


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text in turn, and the text of each hash."""
    data, offsets = flat_bytes(texts)
    words, at = word_hashes(data, offsets)
    found, owner = windows(words, at, WORDS)
    sizes = np.diff(at)
    short = np.flatnonzero((sizes > 0) & (sizes < WORDS))
    if len(short):  # the whole sequence is the one shingle
        whole = np.zeros(len(short), U)
        for i in range(WORDS - 1):
            has = sizes[short] > i
            whole[has] = mixed(whole[has] + words[at[short[has]] + i])
        found, owner = np.concatenate([found, whole + sizes[short].astype(U)]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        found, owner = found[order], owner[order]
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    for a, b in zip(cuts, cuts[1:], strict=False):
        found[a:b].sort()
    keep = np.append(True, (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])) if len(found) else np.zeros(0, bool)
    return found[keep], owner[keep]


def band_edges(most: int = 1 << 40) -> np.ndarray:
    """Band k has the sizes from edge k to edge k + 1; a set's larger partner is in its band or the next."""
    edges = [1]
    while edges[-1] < most:
        edges.append(max(edges[-1] + 1, 100 * (edges[-1] - 1) // SIMILAR + 1))
    return np.array(edges, dtype=np.int64)


EDGES = band_edges()


def bands(sizes: np.ndarray, role: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Band, number of blocks and slack of each set, as the smaller of a pair (role 0) or the larger (role 1)."""
    band = np.searchsorted(EDGES, sizes, side="right") - 1 - role
    small = EDGES[np.maximum(band, 0) + 1] - 1  # the largest size of the smaller set
    most = small * (100 - SIMILAR) // SIMILAR  # the largest symmetric difference, at J = 0.8
    slack = 2 + most // 12
    blocks = np.where((most > 0) & (band >= 0), most + slack, 0)  # without a difference only equal sets are similar
    return band, blocks, slack


def describe(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, size and 128-bit fingerprint of its set, slacks of both roles, and the sketch for the Hamming filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            n = chunk.num_rows
            found, owner = shingles(chunk.column("text"))
            sizes = np.bincount(owner, minlength=n)
            prints = [np.zeros(n, U) for _ in range(2)]
            for i, p in enumerate(prints):
                np.add.at(p, owner, mixed(found + U((i + 1) * int(ODD) & (1 << 64) - 1)))
            bits = np.zeros((n, SKETCH), U)
            spot = mixed(found ^ U(0x5851F42D4C957F2D))
            np.bitwise_xor.at(bits, (owner, (spot >> U(58)).astype(np.int64) % SKETCH), U(1) << (spot & U(63)))
            offsets = pa.array(np.arange(n + 1) * SKETCH, pa.int32())
            slack = [bands(sizes, role)[2] for role in (0, 1)]
            columns = [chunk.column("id"), *(pa.array(x.astype(np.int64)) for x in (sizes, *(p.view(np.int64) for p in prints), *slack))]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, pa.array(bits.view(np.int64).ravel()))], names=["id", "n", "f1", "f2", "slack0", "slack1", "sketch"])

    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, "id long, n long, f1 long, f2 long, slack0 long, slack1 long, sketch array<long>")


def block_keys(rows: DataFrame) -> DataFrame:
    """(key, node) of every block of every (id, text): node is 2 * id + role; the key's lowest bit marks an empty block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            ids = np.asarray(chunk.column("id"))
            found, owner = shingles(chunk.column("text"))
            sizes = np.bincount(owner, minlength=len(ids))
            for role in (0, 1):
                band, blocks, _ = bands(sizes, role)
                first = np.cumsum(blocks) - blocks
                used = blocks[owner] > 0
                one, who = found[used], owner[used]
                spot = mixed(one ^ mixed(band[who].astype(U) * ODD))
                block = ((spot >> U(32)) * blocks[who].astype(U) >> U(32)).astype(np.int64)
                held = np.zeros(int(blocks.sum()), U)
                np.bitwise_xor.at(held, first[who] + block, mixed((spot & U(0xFFFFF)) + U(77)))
                whose = np.repeat(np.arange(len(ids)), blocks)
                number = np.arange(len(held)) - first[whose]
                key = mixed(held + mixed((band[whose].astype(U) << U(40)) + number.astype(U)))
                key = (key & ~U(1)) | (held == 0).astype(U)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(2 * ids[whose] + role)], names=["key", "node"])

    return rows.mapInArrow(run, "key long, node long")


def shared_keys(keys: DataFrame) -> DataFrame:
    """The (key, node) rows whose key has several nodes, and whether the key is ``poor``: crowded or of an empty block.

    Keys are sorted within partitions and read as a stream; of a run at most CROWD rows are held back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail_key, tail_node = np.zeros(0, np.int64), np.zeros(0, np.int64)
        crowded: int | None = None  # the key of the run at the end, where it is already known to be crowded
        last: tuple[int, int] | None = None

        def out(key: np.ndarray, node: np.ndarray, poor: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), pa.array(poor)], names=["key", "node", "poor"])

        for batch in batches:
            key, node = np.asarray(batch.column("key")), np.asarray(batch.column("node"))
            if not len(key):
                continue
            new = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))
            new[0] = last != (int(key[0]), int(node[0]))
            last = (int(key[-1]), int(node[-1]))
            key, node = key[new], node[new]
            if crowded is not None and len(key):
                n = int(np.argmax(key != crowded)) if (key != crowded).any() else len(key)
                if n:
                    yield out(key[:n], node[:n], np.ones(n, bool))
                    key, node = key[n:], node[n:]
                if len(key):
                    crowded = None
            key, node = np.concatenate([tail_key, key]), np.concatenate([tail_node, node])
            if not len(key):
                continue
            begins = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            sizes = np.diff(np.append(begins, len(key)))
            if sizes[-1] > CROWD:
                crowded = int(key[-1])
                tail_key = tail_node = np.zeros(0, np.int64)
            else:
                tail_key, tail_node = key[begins[-1] :], node[begins[-1] :]
                key, node, sizes = key[: begins[-1]], node[: begins[-1]], sizes[:-1]
            many = np.repeat(sizes > 1, sizes)
            poor = np.repeat(sizes > CROWD, sizes) | (key & 1 == 1)
            if many.any():
                yield out(key[many], node[many], poor[many])
        if len(tail_key) > 1:
            yield out(tail_key, tail_node, tail_key & 1 == 1)

    return keys.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "key long, node long, poor boolean")


def semi(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """``rows`` joined with a table of ids, which is broadcast while its size allows."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", how)


def near(na: Column, sa: Column, nb: Column, sb: Column) -> Column:
    """The size filter and the Hamming filter on two sets' sizes and sketches."""
    apart = sum((F.bit_count(sa[i].bitwiseXOR(sb[i])) for i in range(1, SKETCH)), F.bit_count(sa[0].bitwiseXOR(sb[0])))
    return (100 * F.least(na, nb) >= SIMILAR * F.greatest(na, nb)) & ((100 + SIMILAR) * apart <= (100 - SIMILAR) * (na + nb))


def likely(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) pairs that pass the size filter and the Hamming filter."""
    a = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    b = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    return pairs.join(a, "a").join(b, "b").filter(near(F.col("na"), F.col("sa"), F.col("nb"), F.col("sb"))).select("a", "b")


def verified(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs whose texts' sets are similar. Partners of one set go in groups of about GROUP, each with that set's text."""
    pairs = persisted(pairs, "pairs")
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).alias("groups"))
    spread = pairs.join(many, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("groups")))
    partners = spread.select(F.col("b").alias("id"), "a", "part", F.lit(1).alias("role"))
    firsts = many.select(F.col("a").alias("id"), "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("part"), F.lit(0).alias("role"))
    wanted = persisted(partners.unionByName(firsts), "wanted")
    texts = semi(rows, wanted.select("id").distinct(), "left_semi")
    # the id table above keeps all other texts out of the shuffle here
    sent = texts.join(wanted, "id").select("a", "part", "role", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple[int, int] | None = None
        firsts: list[np.ndarray] = []
        for chunk in text_chunks(batches):
            found, owner = shingles(chunk.column("text"))
            cuts = np.searchsorted(owner, np.arange(chunk.num_rows + 1))
            a, part, role, ids = (np.asarray(chunk.column(c)) for c in ("a", "part", "role", "id"))
            left, right = [], []
            for i in range(chunk.num_rows):
                if now != (a[i], part[i]):
                    now, firsts = (a[i], part[i]), []
                mine = found[cuts[i] : cuts[i + 1]]
                if role[i] == 0:
                    firsts.append(mine)
                    continue
                for other in firsts:
                    same = len(np.intersect1d(mine, other, assume_unique=True))
                    if 100 * same >= SIMILAR * (len(mine) + len(other) - same):
                        left.append(a[i])
                        right.append(ids[i])
                        break
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return sent.repartition("a", "part").sortWithinPartitions("a", "part", "role").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, c): the least node reachable from each node of the (a, b) edges, by label propagation with pointer jumps."""
    both = persisted(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = persisted(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("c")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "c"), "b").groupBy(F.col("a").alias("v")).agg(F.min("c").alias("m"))
        step = labels.join(near, "v").select("v", F.col("c").alias("was"), F.least("c", "m").alias("c"))
        jump = labels.select(F.col("v").alias("c"), F.col("c").alias("j"))
        after = persisted(step.join(jump, "c").select("v", "was", F.least("c", "j").alias("c")), "labels")
        moved = after.filter("c < was").limit(1).count()
        labels = after.select("v", "c")
        if not moved:
            return labels


def numbered_components(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``components_of`` for ids that are whole numbers; its tables must outlive the result."""
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    described = persisted(describe(docs, id_col, text_col), "sets")
    reps = described.filter("n > 0 and id is not null").groupBy("n", "f1", "f2").agg(F.min("id").alias("rep"))
    members = persisted(described.join(reps, ["n", "f1", "f2"], "left").select("id", "n", "rep", "slack0", "slack1", "sketch"), "members")
    sets = members.filter("id = rep").dropDuplicates(["id", "n", "sketch"])

    # an id with several texts stays in the index if one of them stands for its set, and ties their sets together
    own = members.filter("id = rep").select("id").distinct()
    others = members.filter("rep is null or id <> rep").select("id").filter("id is not null").distinct().join(own, "id", "left_anti")
    several = members.filter("rep is not null").groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a < b").select("id", "a")
    ties = members.filter("rep is not null").join(several, "id").filter("rep > a").select("a", F.col("rep").alias("b")).distinct()
    ties = persisted(ties, "ties")
    nodes = semi(rows.filter("id is not null"), others, "left_anti")
    shared = persisted(shared_keys(block_keys(nodes)), "shared-keys").withColumn("id", F.expr("node div 2"))
    poor = shared.filter("poor")
    slacks = sets.selectExpr("2 * id as node", "slack0 as slack").union(sets.selectExpr("2 * id + 1 as node", "slack1 as slack"))
    bound = poor.groupBy("node").agg(F.count("*").alias("many")).join(slacks.groupBy("node").agg(F.min("slack").alias("slack")), "node")
    bound = bound.filter("many >= slack").select("node")
    buckets = persisted(shared.filter("not poor").select("key", "node", "id").union(poor.join(bound, "node", "left_semi").select("key", "node", "id")), "buckets")

    firsts = buckets.groupBy("key").agg(F.min("node").alias("least"), F.min(F.pmod("node", F.lit(2))).alias("role")).filter("role = 0")
    stars = buckets.join(firsts, "key").selectExpr("least div 2 as x", "id as y").filter("x <> y")
    stars = persisted(stars.selectExpr("least(x, y) as a", "greatest(x, y) as b").distinct(), "stars")
    links = persisted(verified(likely(stars, sets), rows).union(ties), "links")
    labels = components(links)

    labelled = buckets.select("key", "node", "id").join(labels.withColumnRenamed("v", "id"), "id", "left").withColumn("c", F.coalesce("c", "id"))
    several = persisted(labelled.join(labelled.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min(F.pmod("node", F.lit(2))).alias("role")).filter("lo < hi and role = 0"), "key", "left_semi").select("key", "id", "c"), "several")
    main = several.groupBy("key", "c").agg(F.count("*").alias("many")).groupBy("key").agg(F.max_by("c", F.struct("many", "c")).alias("main"))
    placed = several.join(main, "key").withColumn("outside", F.col("c") != F.col("main")).select("key", "id", "c", "outside")
    placed = persisted(placed.join(sets.select("id", "n", "sketch"), "id"), "placed")
    # both filters stand in the join's condition: what doesn't pass is never a row, and a hot bucket can be split
    one = placed.filter("outside").select("key", *[F.col(c).alias(f"x_{c}") for c in ("id", "c", "n", "sketch")])
    two = placed.select(F.col("key").alias("y_key"), *[F.col(c).alias(f"y_{c}") for c in ("id", "c", "n", "sketch", "outside")])
    apart = (F.col("x_c") != F.col("y_c")) & (~F.col("y_outside") | (F.col("x_id") < F.col("y_id")))
    across = one.join(two, (F.col("key") == F.col("y_key")) & apart & near(F.col("x_n"), F.col("x_sketch"), F.col("y_n"), F.col("y_sketch")))
    across = across.selectExpr("least(x_id, y_id) as a", "greatest(x_id, y_id) as b").distinct().join(stars, ["a", "b"], "left_anti")
    more = persisted(verified(across, rows), "links")
    if more.limit(1).count():
        labels = components(links.union(more))
    named = members.select("id", "n", "rep").join(labels.withColumnRenamed("v", "rep"), "rep", "left")
    return named.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("c", "rep", "id")).alias("component_id"))


def components_of(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n_shingles`` and ``component_id`` of every row of ``docs``, as a table; those made on the way are removed.

    Ids that aren't whole numbers are numbered in their order first, and named again at the end.
    """
    with scratch(docs.sparkSession) as staying:
        if isinstance(docs.schema[id_col].dataType, IntegralType):
            return staying(numbered_components(docs, id_col, text_col), "components")
        names = docs.select(docs[id_col].alias("name")).filter("name is not null").distinct().orderBy("name")
        names = persisted(names.select("name", F.monotonically_increasing_id().alias("number")), "names")
        rows = docs.select(docs[id_col].alias("name"), docs[text_col].alias("text")).join(names, "name", "left").select("number", "text")
        found = numbered_components(rows, "number", "text")
        named = found.join(names.select(F.col("number").alias("id"), F.col("name").alias("own")), "id", "left").join(names.select(F.col("number").alias("component_id"), F.col("name").alias("component")), "component_id", "left")
        return staying(named.select(F.col("own").alias("id"), "n_shingles", F.col("component").alias("component_id")), "components")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the least of its component, with their columns; repeated rows stay as often as they are."""
    kept = components_of(docs, id_col=id_col, text_col=text_col).filter("id = component_id or id is null").select("id").distinct()
    kept = kept.withColumnRenamed("id", "neardup_id")
    kept = F.broadcast(kept) if kept.count() <= BROADCAST_IDS else kept
    return docs.join(kept, docs[id_col].eqNullSafe(kept["neardup_id"]), "left_semi")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of shingles and near-duplicate component of every document."""
    return components_of(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
