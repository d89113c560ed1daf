"""Near-duplicate documents by SuperMinHash (operator 1).

Every distinct shingle of a text draws a random order of the signature's
places and a random rank in each; the rank grows by one from place to place,
so signatures vary less than with independent hashes, and drawing stops once
every place holds a smaller rank. Bands of the signature make candidate
buckets, links are confirmed on the full shingle sets, and linked documents
are grouped by union-find.

Texts with equal shingle sets are one node from the start. In a bucket, every
node is first compared with the bucket's most connected node only, which
settles groups of copies in linear work. Buckets that still hold several
groups are then compared in blocks, group against group: first on sizes and
short signatures, which leaves few nodes, then these on the full sets, so no
candidate pair of the bands is lost, no bucket is one task, and pairs that are
not linked are never written.

Defined cases: a text without words (or null) has no shingles, is linked with
nothing and is its own component; fewer words than a shingle make one shingle
of the whole sequence; rows repeated under one id share a node; a row with a
null id has a null component, is linked with nothing and is kept; extra
columns are not read. Texts are read whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowdetect.llm.common import GOLD, LOWER, RangeHash, Words, as_long, lean, mix, ngram_hashes, stored, stream, text_slices
from flowdetect.llm.components import components
from flowdetect.session import remove_path, scratch_path

#: Signature places; bands of ROWS places each. A pair at 0.8 shares no band with probability below 4e-6.
BANDS, ROWS = 24, 4
PLACES = BANDS * ROWS
PERCENT = 80
#: Pairs whose signatures agree on fewer places than this share cannot reach 0.8 (five deviations away).
LEAST_AGREEMENT = 0.6
#: Nodes of one bucket in a block, and shared shingles in one step of the comparison.
BLOCK = 256
COLUMNS = 4096
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, roll: RangeHash, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle) of the distinct shingles of some texts, sorted; words are lower-cased (A-Z)."""
    words = Words(LOWER[data], offsets, roll)
    keys, at = ngram_hashes(words.hash, words.doc, size)
    docs = words.doc[at]
    for n in range(1, size):  # short texts: the whole sequence
        short = np.flatnonzero(words.count == n)
        if len(short):
            first = words.first[short]
            whole = np.full(len(short), np.uint64(n))
            for k in range(n):
                whole = mix(whole ^ words.hash[first + k])
            keys, docs = np.concatenate([keys, whole]), np.concatenate([docs, short])
    order = np.lexsort((keys, docs))
    keys, docs = keys[order], docs[order]
    new = np.ones(len(keys), dtype=bool)
    if len(keys) > 1:
        new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
    return docs[new], keys[new]


def superminhash(docs: np.ndarray, keys: np.ndarray, n_docs: int, places: int = PLACES) -> np.ndarray:
    """Signatures (n_docs x places) of sets given as (document, element) rows sorted by document.

    Step j gives each element's j-th place the value j + random. A document is
    done once all places are filled: later values cannot be smaller.
    """
    out = np.full(n_docs * places, FULL)
    steps = np.arange(1, places + 1, dtype=np.uint64) * GOLD
    order = None  # each element's places, shuffled one step at a time
    for j in range(places):
        draw = mix(keys + steps[j])
        pick = j + (((draw & np.uint64(0xFFFFFFFF)) * np.uint64(places - j)) >> np.uint64(32)).astype(np.int64)
        if order is None:
            place = pick
        else:
            rows = np.arange(len(keys))
            place = order[rows, pick].astype(np.int64)
            order[rows, pick] = order[:, j]
        value = (np.uint64(j) << np.uint64(32)) | (draw >> np.uint64(32))
        np.minimum.at(out, docs * places + place, value)
        open_docs = (out.reshape(n_docs, places) == FULL).any(axis=1)
        active = open_docs[docs]
        if not active.any():
            break
        if order is None:
            docs, keys, first = docs[active], keys[active], pick[active]
            order = np.tile(np.arange(places, dtype=np.uint8), (len(keys), 1))
            rows = np.arange(len(keys))
            order[rows, first] = 0
        elif not active.all():
            docs, keys, order = docs[active], keys[active], order[active]
    return out.reshape(n_docs, places)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One key per band (the band's number is part of it)."""
    key = np.tile(stream(7, BANDS), (len(signatures), 1))
    for k in range(ROWS):
        key = mix(key ^ signatures[:, k::ROWS])
    return key


SIGNED = "doc_id long, n_shingles long, digest binary, bands array<long>, signature binary"


def signatures(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Set size, digest of the set, band keys and a signature of 8 bits a place for every row."""

    def run(batches):
        roll = RangeHash()
        for batch in batches:
            names = batch.column(0)
            for lo, data, offsets in text_slices(batch.column(1)):
                n = len(offsets) - 1
                doc, keys = shingle_sets(data, offsets, roll, size)
                count = np.bincount(doc, minlength=n)
                ends = np.concatenate([[0], np.cumsum(count)])
                signed = superminhash(doc, keys, n)
                digest = [hashlib.blake2b(keys[a:b].tobytes(), digest_size=16).digest() for a, b in zip(ends[:-1], ends[1:])]
                bands = pa.ListArray.from_arrays(
                    pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(as_long(band_keys(signed).ravel()))
                )
                small = np.ascontiguousarray((mix(signed) & np.uint64(0xFF)).astype(np.uint8))
                yield pa.RecordBatch.from_arrays(
                    [names.slice(lo, n), pa.array(count.astype(np.int64)), pa.array(digest, type=pa.binary()), bands,
                     pa.array([row.tobytes() for row in small], type=pa.binary())],
                    ["doc_id", "n_shingles", "digest", "bands", "signature"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), SIGNED)


def _enough(na, nb) -> F.Column:
    """Set sizes that allow the similarity: the smaller is the largest possible intersection."""
    return 100 * F.least(na, nb) >= PERCENT * F.greatest(na, nb)


def agreeing(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (u, v) whose set sizes and signatures allow the similarity."""
    named = lambda c: nodes.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("signature").alias(f"s{c}"))

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint8).reshape(-1, PLACES) for k in (2, 3))
            good = pa.array((a == b).mean(axis=1) >= LEAST_AGREEMENT) if len(a) else pa.array([], pa.bool_())
            yield batch.select([0, 1]).filter(good)

    both = pairs.join(named("u").hint("merge"), "u").join(named("v").hint("merge"), "v").where(_enough(F.col("nu"), F.col("nv")))
    return both.select("u", "v", "su", "sv").mapInArrow(lean(run), "u long, v long")


def confirmed(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Pairs whose full shingle sets reach the similarity. ``texts``: (node, text)."""

    def run(batches):
        roll = RangeHash()
        for batch in batches:
            done = 0
            while done < batch.num_rows:  # bounded runs of rows
                part = batch.slice(done, 64)
                done += part.num_rows
                sets: dict[tuple, np.ndarray] = {}
                for k in (0, 1):
                    for lo, data, offsets in text_slices(part.column(2 + k)):
                        doc, keys = shingle_sets(data, offsets, roll, size)
                        ends = np.searchsorted(doc, np.arange(len(offsets)))
                        for d in range(len(offsets) - 1):
                            sets[k, lo + d] = keys[ends[d] : ends[d + 1]]
                good = []
                for row in range(part.num_rows):
                    a, b = sets[0, row], sets[1, row]
                    shared = len(np.intersect1d(a, b, assume_unique=True))
                    good.append(shared > 0 and 100 * shared >= PERCENT * (len(a) + len(b) - shared))
                yield part.select([0, 1]).filter(pa.array(good, type=pa.bool_()))

    named = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"t{c}"))
    both = pairs.join(named("u").hint("merge"), "u").join(named("v").hint("merge"), "v").select("u", "v", "tu", "tv")
    return both.mapInArrow(lean(run), "u long, v long")


def shingle_lists(texts: DataFrame, size: int) -> DataFrame:
    """(node, shingles): the sorted shingle hashes of each text, as bytes."""

    def run(batches):
        roll = RangeHash()
        for batch in batches:
            for lo, data, offsets in text_slices(batch.column(1)):
                doc, keys = shingle_sets(data, offsets, roll, size)
                ends = np.searchsorted(doc, np.arange(len(offsets)))
                body = [keys[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(body)), pa.array(body, pa.binary())], ["node", "shingles"])

    return texts.mapInArrow(lean(run), "node long, shingles binary")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all pairs of some sets: products of 0/1 matrices over the shared elements."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.cumsum(shared) - 1
    keep = shared[code]
    owner, code = owner[keep], column[code[keep]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for first in range(0, int(shared.sum()), COLUMNS):
        part = slice(*np.searchsorted(code, [first, first + COLUMNS]))
        matrix = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        matrix[owner[part], code[part] - first] = 1
        out += matrix @ matrix.T
    return out.astype(np.int64)


def in_blocks(open_buckets: DataFrame, lists: DataFrame, payload: list[str], compare, schema: str) -> DataFrame:
    """``compare`` of every cell's nodes that are not in one component; ``lists``: node and its ``payload``.

    A bucket of up to two blocks is one cell. Of a larger one, the largest
    component is compared with the others, and the others among themselves.
    """
    parts = stored(open_buckets.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n")), "bucket-parts")
    heads = stored(
        parts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("all")).select(
            "key", F.col("top.component").alias("top"), (F.col("all") <= 2 * BLOCK).alias("small"),
            F.ceil(F.col("top.n") / BLOCK).cast("int").alias("top_blocks"),
            F.ceil((F.col("all") - F.col("top.n")) / BLOCK).cast("int").alias("rest_blocks"),
        ),
        "bucket-heads",
    )
    rows = open_buckets.join(heads.hint("merge"), "key").withColumn("is_top", F.col("component") == F.col("top"))
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("is_top"), F.col("top_blocks")).otherwise(F.col("rest_blocks")).cast("long")).cast("int")
    rows = rows.withColumn("mine", mine)
    cell = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))
    with_rest = F.sequence(F.lit(0), F.col("rest_blocks") - 1)
    with_top = F.sequence(F.lit(0), F.col("top_blocks") - 1)
    meets = (
        F.when(F.col("small"), F.array(cell(2, F.lit(0), F.lit(0))))
        .when(F.col("is_top"), F.transform(with_rest, lambda r: cell(0, F.col("mine"), r)))
        .otherwise(F.concat(
            F.transform(with_top, lambda t: cell(0, t, F.col("mine"))),
            F.transform(with_rest, lambda r: cell(1, F.least("mine", r), F.greatest("mine", r))),
        ))
    )
    placed = rows.select("key", "node", "component", F.explode(meets).alias("m"))
    full = placed.join(lists.hint("merge"), "node").select(F.xxhash64("key", "m").alias("cell"), "key", "m.kind", "m.a", "m.b", "node", "component", *payload)

    def run(batches):
        held: list[pa.RecordBatch] = []
        cell = None
        for batch in batches:
            ids = batch.column(0).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(ids)) + 1, [len(ids)]]).tolist()
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if hi == lo:
                    continue
                if held and ids[lo] != cell:
                    yield met(held)
                    held = []
                cell = ids[lo]
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield met(held)

    def met(parts):
        table = pa.Table.from_batches(parts)
        where = np.stack([table.column(c).to_numpy() for c in ("key", "kind", "a", "b")])
        component = table.column("component").to_numpy()
        apart = component[:, None] != component[None, :]
        apart &= (where[:, :, None] == where[:, None, :]).all(axis=0)  # cells may share a hash
        return compare(table, apart)

    return full.repartition("cell").sortWithinPartitions("cell").mapInArrow(lean(run), schema).distinct()


def promising(open_buckets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, node) of the nodes that have, in another component of the bucket, a partner whose size and signature allow the similarity."""

    def compare(table, apart):
        size = table.column("n_shingles").to_numpy()
        good = apart & (100 * np.minimum(size[:, None], size[None, :]) >= PERCENT * np.maximum(size[:, None], size[None, :]))
        if good.any():
            signed = np.frombuffer(b"".join(table.column("signature").to_pylist()), dtype=np.uint8).reshape(-1, PLACES)
            agree = np.zeros(good.shape, dtype=np.uint8)
            for place in signed.T:
                agree += place[:, None] == place[None, :]
            good &= agree >= LEAST_AGREEMENT * PLACES
        keep = pa.array(good.any(axis=1))
        return pa.RecordBatch.from_arrays([table.column(c).combine_chunks().filter(keep) for c in ("key", "node")], ["key", "node"])

    return in_blocks(open_buckets, nodes.select("node", "n_shingles", "signature"), ["n_shingles", "signature"], compare, "key long, node long")


def links_in_blocks(open_buckets: DataFrame, lists: DataFrame) -> DataFrame:
    """Links between nodes of one bucket that are not yet in one component, found block by block on full sets.

    A node gets one link to each other component that it is linked with, which is
    all that grouping needs.
    """

    def compare(table, apart):
        node, component = table.column("node").to_numpy(), table.column("component").to_numpy()
        sets = [np.frombuffer(body, dtype=np.uint64) for body in table.column("shingles").to_pylist()]
        size = np.array([len(s) for s in sets])
        both = overlaps(sets)
        linked = apart & (100 * both >= PERCENT * (size[:, None] + size[None, :] - both))
        u, v = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for i in np.flatnonzero(linked.any(axis=1)).tolist():
            at = np.flatnonzero(linked[i])
            at = at[np.unique(component[at], return_index=True)[1]]
            u.append(np.minimum(node[i], node[at]))
            v.append(np.maximum(node[i], node[at]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])

    return in_blocks(open_buckets, lists, ["shingles"], compare, "u long, v long")


def near_duplicates(docs: DataFrame, size: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; ``size``: words in a shingle.

    Every table joined here grows with the rows: none is broadcast at any size.
    """
    path = scratch_path(docs.sparkSession, "signed")
    signatures(docs, size, id_col, text_col).write.option("compression", "zstd").parquet(path)
    written = docs.sparkSession.read.schema(SIGNED).parquet(path)
    some = "n_shingles > 0 and doc_id is not null"
    nodes = stored(
        written.where(some).groupBy("digest").agg(
            F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"),
            F.first("bands").alias("bands"), F.first("signature").alias("signature"),
        ),
        "nodes",
        release=True,
    )
    signed = stored(written.select("doc_id", "n_shingles", "digest"), "sets")
    remove_path(docs.sparkSession, path)  # signatures and bands live on in nodes
    in_band = nodes.select("node", F.explode("bands").alias("key"))
    shared = stored(in_band.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared-buckets")
    buckets = stored(in_band.join(shared.hint("merge"), "key"), "buckets", release=True)
    weight = stored(buckets.groupBy("node").agg(F.sum("n").alias("weight")), "weights")
    hub = stored(
        buckets.join(weight.hint("merge"), "node").groupBy("key").agg(F.max(F.struct("weight", (-F.col("node")).alias("minus"))).alias("top"))
        .select("key", (-F.col("top.minus")).alias("v")),
        "hubs",
    )
    to_hub = buckets.join(hub.hint("merge"), "key").where("node <> v").select(F.col("node").alias("u"), "v").distinct()
    # a node may have several texts only where ids repeat; each text counts
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text"))
    first = stored(confirmed(stored(agreeing(to_hub, nodes), "hub-pairs"), texts, size), "hub-links", release=True)
    groups = stored(components(first), "hub-groups")
    located = buckets.select("key", "node").join(groups.hint("merge"), "node", "left")
    located = stored(located.select("key", "node", F.coalesce("component", "node").alias("component")), "located")
    members = [F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"), F.count(F.lit(1)).alias("n")]
    mixed = located.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), *members).where("lo <> hi")
    # close copies share many bands: of buckets with the same nodes, one is enough
    mixed = stored(mixed.groupBy("x", "y", "n").agg(F.min("key").alias("key")).select("key"), "mixed")
    left = stored(located.join(mixed.hint("merge"), "key"), "open-buckets")
    left = stored(left.join(promising(left, nodes).hint("merge"), ["key", "node"]), "left-buckets", release=True)
    lists = stored(shingle_lists(texts.join(left.select("node").distinct().hint("merge"), "node", "left_semi"), size), "shingles", release=True)
    links = links_in_blocks(left, lists)
    stars = groups.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))
    groups = stored(components(stars.union(links)), "groups")
    node_of = nodes.select("digest", F.col("node"))
    placed = signed.where(some).join(node_of.hint("merge"), "digest").select("doc_id", "n_shingles", "node")
    placed = placed.join(groups.hint("merge"), "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    alone = signed.where(f"not ({some})").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return placed.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one_of_each(docs: DataFrame, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose document is kept, with their columns."""
    dropped = near_duplicates(docs, size, id_col, text_col).where("not kept").select(F.col("doc_id").alias("_dropped")).distinct()
    return docs.join(stored(dropped, "near-copies").hint("merge"), F.col(f"`{id_col}`").cast("long") == F.col("_dropped"), "left_anti")
