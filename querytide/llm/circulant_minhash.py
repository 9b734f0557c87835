"""Near-duplicate documents by circulant MinHash, banding and exact verification.

Two permutations give all coordinates of a signature: the first spreads a shingle over 2**20 slots, the second is a table
whose circular shift by k is the permutation of coordinate k. A shingle's values in all coordinates therefore lie side by
side in the table, and a signature is the minimum of such rows.

Documents with the same shingle set are one node. Nodes that agree on a band meet in a bucket, whose hub is the node that
meets most others in all its buckets: of a group of changed copies, one of those changed least, to which the others are
nearer than to each other. First every node is compared with the best hub of its buckets: in a large group that is nearly
always the same one, so one pair a node joins almost all of it. Nodes and hubs that are still apart are compared next.
Then, in buckets whose nodes are still in several components, the nodes outside the main one are compared with
all nodes of other components, each pair in the first bucket it shares, unless the shingles that both can have are too
few: changes of a copy make shingles that no other node has, or few have. So every pair of a bucket is compared, already
joined or known to be no link, and no group is expanded into all its pairs. Pairs are dropped early if their sizes or 384 signature bits rule out the similarity (a miss needs a
deviation of six standard errors); the others are compared by their full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querytide.llm.common import Powers, WordHashes, as_bytes, fresh, lists, mixed, signed
from querytide.llm.components import components
from querytide.session import no_rows, stored

#: Words of a shingle; similarity in percent that links two documents.
SHINGLE, PERCENT = 5, 75
#: Bands and coordinates of a band: two documents of similarity 0.75 miss all bands with probability 5e-6.
BANDS, ROWS = 32, 4
#: Coordinates of the signature, one bit of each kept for the early test, and the most bits that may differ.
COORDINATES, MAX_DIFFERENT = 384, 87
#: Slots of the circulant table (a power of two) and the seed of its permutation.
SLOTS, SEED = 1 << 20, 20_260_101
#: Nodes up to which a shingle is rare, and 64-bit words that mark a node's rare shingles.
RARE, MARKS = 8, 4
#: Nodes up to which the hashes of their texts are broadcast (some 50 bytes each); all texts are shuffled beyond that.
MAX_SENT = 2_000_000
_ROUND = 2048
_MARKS = [f"mark_{k}" for k in range(MARKS)]


class Signer:
    """Shingle sets and signatures of texts."""

    def __init__(self) -> None:
        table = np.random.Generator(np.random.PCG64(SEED)).permutation(SLOTS).astype(np.uint32)
        ring = np.concatenate([table, table[:COORDINATES]])
        self.rows = np.lib.stride_tricks.sliding_window_view(ring, COORDINATES)
        self.hashes, self.powers = WordHashes(), Powers()
        self.weights = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)

    def shingles(self, text: bytes) -> np.ndarray:
        """The distinct shingles' hashes, ascending; a text of fewer words is one shingle, without words it has none."""
        words = self.hashes(text.lower().split())
        if not len(words):
            return words
        prefix = self.powers.prefix(words)
        size = min(len(words), SHINGLE)
        found = self.powers.grams(prefix, size)
        return np.unique(found if size == SHINGLE else mixed(found + np.uint64(size)))

    def sign(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Band keys and signature bits."""
        slots = (mixed(shingles ^ np.uint64(SEED)) >> np.uint64(44)).astype(np.int64)
        least = np.full(COORDINATES, np.iinfo(np.uint32).max, np.uint32)
        for i in range(0, len(slots), _ROUND):
            np.minimum(least, self.rows[slots[i : i + _ROUND]].min(axis=0), out=least)
        part = mixed(least[: BANDS * ROWS].astype(np.uint64) * self.weights).reshape(BANDS, ROWS)
        bands = mixed(part.sum(axis=1, dtype=np.uint64))
        odd = (mixed(least.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)
        return bands, np.packbits(odd).view(np.uint64)


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, node (hash of the set; null without shingles), bands, bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer()
        for batch in batches:
            sizes, nodes, bands, bits = [], [], [], []
            for text in as_bytes(batch.column(2)):
                found = signer.shingles(text)
                sizes.append(len(found))
                nodes.append(None)
                if len(found):
                    nodes[-1] = int(signed(mixed(mixed(found).sum(dtype=np.uint64, keepdims=True)))[0])
                    keys, odd = signer.sign(found)
                    bands.append(keys)
                    bits.append(odd)
            some = np.array(sizes) > 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(sizes, pa.int64()),
                    pa.array(nodes, pa.int64()),
                    lists(signed(_flat(bands)), some * BANDS, pa.int64()),
                    lists(signed(_flat(bits)), some * (COORDINATES // 64), pa.int64()),
                ],
                names=["doc_id", "text_hash", "n_shingles", "node", "bands", "bits"],
            )

    schema = "doc_id long, text_hash long, n_shingles long, node long, bands array<long>, bits array<long>"
    return docs.select("doc_id", "text_hash", "text").mapInArrow(run, schema)


def _flat(rows: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *rows])


def _sets(docs: DataFrame) -> DataFrame:
    """node and set of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer()
        for batch in batches:
            found = [signer.shingles(text) for text in as_bytes(batch.column(1))]
            sizes = np.array([len(f) for f in found], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), lists(signed(_flat(found)), sizes, pa.int64())], names=["node", "shingles"]
            )

    return docs.mapInArrow(run, "node long, shingles array<long>")


def _may_link(a: str, b: str) -> Column:
    """Whether sizes and signature bits allow a link; a and b are structs of n and bits."""
    sizes = 100 * F.least(f"{a}.n", f"{b}.n") >= PERCENT * F.greatest(f"{a}.n", f"{b}.n")
    words = [F.bit_count(F.col(f"{a}.bits")[i].bitwiseXOR(F.col(f"{b}.bits")[i])) for i in range(COORDINATES // 64)]
    return sizes & (sum(words[1:], words[0]) <= MAX_DIFFERENT)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    similar = 100 * both >= PERCENT * (F.size("x") + F.size("y") - both)
    return pairs.join(left, "a").join(right, "b").filter(similar).select("a", "b")


def _plausible(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """The pairs (a, b) that may link by size and signature bits."""
    pairs = pairs.join(signatures.withColumnsRenamed({"node": "a", "s": "sa"}), "a")
    pairs = pairs.join(signatures.withColumnsRenamed({"node": "b", "s": "sb"}), "b")
    return pairs.filter(_may_link("sa", "sb")).select("a", "b")


def _buckets(banded: DataFrame) -> DataFrame:
    """key, node, hub and met (how many others the hub meets) of the keys that several nodes have."""
    shared = banded.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("top"))
    shared = stored(shared.filter("low < top").select("key", "n"), "shared-keys")
    members = stored(banded.join(shared, "key"), "members")
    met = stored(members.groupBy("node").agg(F.sum("n").alias("met")), "met-counts")
    hubs = members.join(met, "node").groupBy("key").agg(F.max(F.struct("met", "node")).alias("hub"))
    hubs = stored(hubs.select("key", F.col("hub.node").alias("hub"), "hub.met"), "hubs")
    return stored(members.select("key", "node").join(hubs, "key"), "buckets")


def _with_hubs(members: DataFrame, roots: DataFrame, choose: str) -> DataFrame:
    """Nodes with hubs of their buckets that are still in another component: the hub that meets most others ("best"), or
    all."""
    of_node, of_hub = (roots.toDF(c, f"{c}_root") for c in ("node", "hub"))
    now = members.select("node", "hub", "met").join(of_node, "node", "left").join(of_hub, "hub", "left")
    apart = now.filter(F.coalesce("node_root", "node") != F.coalesce("hub_root", "hub"))
    if choose == "all":
        return apart.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    best = F.max(F.struct("met", "hub"))["hub"].alias("a")
    return apart.groupBy("node").agg(best).select("a", F.col("node").alias("b"))


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    return roots if links.isEmpty() else components(roots.union(links))


def _with_rare(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """`nodes` with n, the number of a node's shingles, shared and common, the numbers of those that some other node and
    more than RARE nodes have, and mark_0 and so on, the bits at which shared ones are hashed that are not common."""
    of_nodes = sets.join(nodes.select("node"), "node", "left_semi")
    grams = of_nodes.select("node", F.explode("shingles").alias("shingle"))
    counts = grams.groupBy("shingle").agg(F.count("*").alias("n")).filter(F.col("n") <= RARE)
    found = grams.join(stored(counts, "rare-shingles"), "shingle")
    place, nothing = F.pmod(F.xxhash64("shingle"), F.lit(64 * MARKS)), F.lit(0).cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    marks = [F.bit_or(F.when((F.col("n") > 1) & (F.floor(place / 64) == k), bit).otherwise(nothing)) for k in range(MARKS)]
    marks = [m.alias(name) for m, name in zip(marks, _MARKS, strict=True)]
    found = stored(found.groupBy("node").agg(F.count_if(F.col("n") == 1).alias("alone"), F.count("*").alias("few"), *marks), "rare-counts")
    sizes = of_nodes.select("node", F.size("shingles").cast("long").alias("n"))
    some = nodes.join(sizes, "node").join(found, "node", "left").fillna(0, ["alone", "few", *_MARKS])
    return some.withColumn("shared", F.col("n") - F.col("alone")).withColumn("common", F.col("n") - F.col("few"))


def _may_share(a: str, b: str) -> Column:
    """Whether the shingles that two nodes can share are enough: those that some other node has, or, if the marks show
    that the nodes have no rare shingle in common, those that more than RARE nodes have."""

    def enough(kind: str) -> Column:
        most = F.least(f"{kind}_{a}", f"{kind}_{b}")
        return (100 + PERCENT) * most >= PERCENT * (F.col(f"n_{a}") + F.col(f"n_{b}"))

    meet = [F.col(f"{m}_{a}").bitwiseAND(F.col(f"{m}_{b}")) for m in _MARKS]
    return enough("shared") & (enough("common") | (reduce(Column.bitwiseOR, meet) != 0))


def _across(members: DataFrame, roots: DataFrame, signatures: DataFrame, sets: DataFrame) -> DataFrame:
    """In buckets of several components: the nodes outside the main one, paired with all of other components. A pair is
    made in the first bucket that both are in; that has several components as well. Left out are nodes and pairs that
    cannot be similar enough, as too many of their shingles are in no other node of these buckets, or in few."""
    label = F.coalesce("b", "node").alias("label")
    now = members.join(roots.withColumnRenamed("a", "node"), "node", "left").select("key", "node", label)
    counts = now.groupBy("key", "label").count()
    mixed_keys = counts.groupBy("key").agg(F.max_by("label", "count").alias("main"), F.count("*").alias("labels"))
    mixed_keys = stored(mixed_keys.filter("labels > 1").drop("labels"), "open-keys")
    now = stored(now.join(mixed_keys, "key"), "open-members")
    nodes = stored(now.groupBy("node").agg(F.collect_set("key").alias("keys")), "open-nodes")
    nodes = _with_rare(nodes, sets).join(signatures, "node")
    nodes = nodes.filter(100 * F.col("shared") >= PERCENT * F.col("n"))
    now = stored(now.join(nodes, "node"), "open-buckets")
    columns = ("node", "label", "s", "n", "shared", "common", *_MARKS, "keys")
    left = now.filter("label <> main").select("key", *[F.col(c).alias(f"{c}_a") for c in columns])
    right = now.select("key", "main", *[F.col(c).alias(f"{c}_b") for c in columns])
    once = (F.col("label_b") == F.col("main")) | (F.col("node_a") < F.col("node_b"))
    may_link = (F.col("label_a") != F.col("label_b")) & once & _may_share("a", "b") & _may_link("s_a", "s_b")
    first = F.array_min(F.array_intersect("keys_a", "keys_b")) == F.col("key")
    pairs = left.join(right, "key").filter(may_link & first)
    return pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Link documents of similar shingle sets and name each component by its smallest id.

    Returns doc_id, n_shingles, component_id and kept (doc_id = component_id), one row per row of `docs`. A text that is
    null or has no words is linked with nothing and its component is itself. Rows with equal sets are linked even if
    they share an id; all rows with the component's smallest id are kept. Rows without an id link others, but never name
    a component; they are kept where their component has no id. Shingles and sets are told apart by 64-bit hashes. Other
    columns are left out, so their names cannot clash. An empty table gives none."""
    text = F.col(text_col).alias("text")
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), text)
    return _named(chosen).drop("text_hash")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that near_duplicates() keeps, with all columns of `docs`, in order."""
    text = F.col(text_col).alias("text")
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), text)
    dropped = _named(chosen).filter(~F.col("kept")).select("doc_id", "text_hash").distinct()
    id_, hash_ = fresh(docs.columns, "id_"), fresh(docs.columns, "hash_")
    dropped = stored(dropped, "dropped").toDF(id_, hash_)
    same = F.col(id_col).cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(text_col) == F.col(hash_))
    return docs.join(dropped, same, "left_anti")


def _named(chosen: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept."""
    spark = chosen.sparkSession
    rows = stored(_signed(chosen), "signed")
    worded = rows.filter("n_shingles > 0")

    # One row per node, so that copies meet nobody; copies are combined before the shuffle.
    signature = F.struct(F.col("n_shingles").alias("n"), "bits")
    row = F.struct("doc_id", "text_hash")
    nodes = worded.groupBy("node")
    nodes = nodes.agg(F.first("bands").alias("bands"), F.first(signature).alias("s"), F.min(row).alias("row"))
    nodes = stored(nodes, "nodes")
    banded = nodes.select("node", F.explode("bands").alias("key"))
    members = _buckets(banded)
    met = members.select("node").distinct()
    one = stored(nodes.join(met, "node", "left_semi").select("node", "row.*", "s"), "met")
    signatures = one.select("node", "s")
    wanted = one.select("node", F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    if one.count() <= MAX_SENT:  # then texts that are not wanted need not be shuffled
        hashes = F.broadcast(wanted.select("hash").distinct())
        chosen = chosen.join(hashes, F.col("text_hash") == F.col("hash"), "left_semi")
    found = chosen.join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")))
    sets = stored(_sets(found.select("node", "text").dropDuplicates(["node"])), "sets")

    roots = no_rows(spark, sets.select(F.col("node").alias("a"), F.col("node").alias("b")).schema)
    for choose in ("best", "all"):
        pairs = _plausible(_with_hubs(members, roots, choose), signatures)
        roots = _joined(roots, stored(_verified(pairs, sets), "hub-links"))
    roots = _joined(roots, stored(_verified(_across(members, roots, signatures, sets), sets), "cross-links"))
    roots = roots.select(F.col("a").alias("node"), F.col("b").alias("root"))

    least = worded.groupBy("node").agg(F.min("doc_id").alias("least")).join(roots, "node", "left")
    least = least.withColumn("root", F.coalesce("root", "node"))
    names = least.groupBy("root").agg(F.min("least").alias("component_id"))
    named = least.join(stored(names, "component-names"), "root").select("node", "component_id")
    out = worded.join(named, "node").select("doc_id", "text_hash", "n_shingles", "component_id")
    none = rows.filter("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    out = out.union(none.select(out.columns))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
