"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard.

A text's set are its distinct shingles of some words, three unless told otherwise (A-Z lower-cased), as 64-bit
hashes. Two permutations of a 32-bit universe give the whole signature: the first
is applied once, the second again and again, each time shifted by one place.
Signatures are cut into bands; documents that agree in a band share a bucket.

Documents with equal sets are one node. Within a bucket, only links to one leader
are tried at first; links are confirmed on the full sets. A leader's text goes to as
many tasks as its bucket needs. Buckets whose nodes then hang together are done. In
the others, pairs across components are compared by signature, in blocks, and without
their texts; each block proposes as few pairs as would join its components, and these
are confirmed in the same way. Nodes that may still be similar to one of another
component after that are compared on their full sets, block by block; theirs are the
only texts that go to several blocks. So no pair that shares a bucket goes unexamined.

A bucket of n nodes that do not hang together makes n * n / (2 * BLOCK_ROWS) narrow
rows (a signature each) and n * n / 2 comparisons of signatures.

The bands are the widest at which a pair at the limit shares no bucket with a
probability below 1e-6 (30 of 6 coordinates for 0.85); the comparison by signature
passes over a pair at the limit with probability below 1e-6, too.

Defined results: a text with fewer words than a shingle but at least one has one
shingle, the whole sequence; null and wordless texts have none, and link with
nothing; the component of a document is its smallest non-null id; rows that agree
in id and text are one document; further columns are not read; an empty table gives
an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Scratch
from ._common import fresh, heavy_keys, looked_up, map_batches, read
from .components import components

SHINGLE_WORDS = 3
COORDINATES = 180
BLOCK_ROWS = 1024
#: Members of a bucket that meet one copy of their leader's text.
LEADER_ROWS = 256
#: Links join sets of which 100 * intersection >= LIMIT * union.
LIMIT = 85

# --------------------------------------------------------------------------
# sets and signatures


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct shingle hashes of texts; keeps hashes of words it has seen."""

    KEPT = 200_000

    def __init__(self, words: int = SHINGLE_WORDS):
        self.words = words
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        # bytes.lower() lowers A-Z and bytes.split() cuts at the six white bytes only.
        words = (text or "").encode().lower().split()
        if not words:
            return np.empty(0, dtype=np.uint64)
        known = self.known
        if len(known) > self.KEPT:
            known.clear()
        for w in [w for w in set(words) if w not in known]:
            known[w] = xxhash.xxh64_intdigest(w, seed=1)
        h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        size = min(self.words, len(words))
        x = np.full(len(words) - size + 1, size, dtype=np.uint64)
        for k in range(size):
            x = _mix64(x * np.uint64(0x9E3779B97F4A7C15) ^ h[k : len(h) - size + 1 + k])
        return np.unique(x)


_SHIFTS = np.arange(COORDINATES, dtype=np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Least value of each shifted permutation over a set that is not empty."""
    first = (shingles >> np.uint64(32)).astype(np.uint32)  # the hash's mixing is the first permutation
    out = np.full(len(_SHIFTS), 0xFFFFFFFF, dtype=np.uint32)
    for k in range(0, len(first), 512):
        x = first[k : k + 512, None] + _SHIFTS
        x *= np.uint32(0x7FEB352D)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x846CA68B)
        np.minimum(out, x.min(axis=0), out=out)
    return out


def rows_in_band(limit: int) -> int:
    """The most coordinates in a band at which a pair at the limit is missed with a
    probability below 1e-6."""
    return max(r for r in range(1, 13) if r == 1 or (1 - (limit / 100) ** r) ** (COORDINATES // r) < 1e-6)


def least_agreement(limit: int) -> int:
    """The most coordinates that a pair at the limit agrees in with a probability of
    at least 1 - 1e-6."""
    p, below, k = limit / 100, 0.0, 0
    while (below := below + math.comb(COORDINATES, k) * p**k * (1 - p) ** (COORDINATES - k)) < 1e-6:
        k += 1
    return k


_BAND_SALT = _mix64(np.arange(1, COORDINATES + 1, dtype=np.uint64))


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    bands = len(sig) // rows
    x = _BAND_SALT[:bands].copy()
    for column in sig[: bands * rows].reshape(bands, rows).T.astype(np.uint64):
        x = _mix64(x * np.uint64(0x9E3779B97F4A7C15) ^ column)
    return x.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, limit: int) -> bool:
    if min(len(a), len(b)) * 100 < limit * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= limit * (len(a) + len(b) - both)


def _signed(df: DataFrame, limit: int, words: int, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``row`` (hash of id and text), ``n``, ``node`` (hash of the set), ``bands``, ``bits``."""
    inner = df.select(F.col(id_col).alias("id"), F.xxhash64(F.lit(9), F.col(id_col), F.col(text_col)).alias("row"), F.col(text_col).alias("text"))
    schema = T.StructType(
        [
            inner.schema["id"],
            T.StructField("row", T.LongType()),
            T.StructField("n", T.LongType()),
            T.StructField("node", T.LongType()),
            T.StructField("bands", T.ArrayType(T.LongType())),
            T.StructField("bits", T.BinaryType()),
        ]
    )

    rows = rows_in_band(limit)

    def make():
        shingle = Shingler(words)

        def work(cols):
            out = {"id": cols["id"], "row": cols["row"], "n": [], "node": [], "bands": [], "bits": []}
            for text in cols["text"]:
                s = shingle(text)
                sig = signature(s) if len(s) else None
                out["n"].append(len(s))
                out["node"].append(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None)
                out["bands"].append(band_keys(sig, rows) if len(s) else None)
                out["bits"].append(sig.astype(np.uint8).tobytes() if len(s) else None)
            return out

        return work

    return map_batches(inner, schema, make)


# --------------------------------------------------------------------------
# links


def _confirm(pairs: DataFrame, texts: DataFrame, limit: int, words: int) -> DataFrame:
    """Links ``a``, ``b``: those of the pairs ``member``, ``leader`` whose full sets are
    similar enough. ``size`` says how many pairs of a leader may come together."""
    copies = F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.ceil(F.log2(F.col("size") / LEADER_ROWS)).cast("double"))).cast("int")
    dealt = pairs.select("member", "leader", copies.alias("copies")).withColumn("copy", F.pmod(F.xxhash64("member"), F.col("copies")).cast("int"))
    side = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"{c}_text"))
    leaders = dealt.select("leader", "copies").distinct().join(side("leader"), "leader").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    full = dealt.join(side("member"), "member").join(leaders, ["leader", "copies", "copy"])

    def run(batches):
        shingle = Shingler(words)
        for batch in batches:
            links, sets = [], {}
            leader, member, leader_text, member_text = batch.columns
            for i, (x, y) in enumerate(zip(leader.to_pylist(), member.to_pylist())):
                if x not in sets:  # they come in order
                    sets = {x: shingle(leader_text[i].as_py())}
                if similar(sets[x], shingle(member_text[i].as_py()), limit):
                    links.append((min(x, y), max(x, y)))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return full.select("leader", "member", "leader_text", "member_text").mapInArrow(run, "a long, b long")


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _in_blocks(members: DataFrame) -> DataFrame:
    """Each row of a bucket once for every block pair ``i``, ``j`` that its block is in."""
    blocks = F.ceil(F.col("size") / BLOCK_ROWS).cast("int")
    return (
        members.withColumn("blocks", blocks)
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "size", "band", "node", "component", "bits")
    )


class _Block:
    """One pair of blocks of a bucket."""

    def __init__(self, group: pd.DataFrame, limit: int):
        self.group, self.least, self.per_band = group, least_agreement(limit), rows_in_band(limit)
        self.band = group["band"].iat[0]
        self.nodes, own = group["node"].to_numpy(), group["own"].to_numpy()
        self.bits = np.frombuffer(b"".join(group["bits"]), dtype=np.uint8).reshape(len(group), -1)
        self.component = group["component"].to_numpy()
        self.same = group["i"].iat[0] == group["j"].iat[0]
        self.left, self.right = np.flatnonzero(own == group["i"].iat[0]), np.flatnonzero(own == group["j"].iat[0])
        self.joined = {c: c for c in self.component.tolist()}

    def root(self, c: int) -> int:
        while self.joined[c] != c:
            self.joined[c] = c = self.joined[self.joined[c]]
        return c

    def candidates(self):
        """(row, rows that may be similar to it, best first), across components. A pair
        that shares several buckets is looked at in the first, as far as the signatures'
        low bytes tell bands apart (a band agrees in them by chance once in 2 ** 48)."""
        banded = COORDINATES // self.per_band * self.per_band
        for place, k in enumerate(self.left.tolist()):
            others = self.left[place + 1 :] if self.same else self.right
            others = others[self.component[others] != self.component[k]]
            if len(others):
                agree = np.count_nonzero(self.bits[others] == self.bits[k], axis=1)
                hits = np.flatnonzero(agree >= self.least)
                equal = (self.bits[others[hits], :banded] == self.bits[k, :banded]).reshape(len(hits), banded // self.per_band, self.per_band)
                hits = hits[equal.all(axis=2).argmax(axis=1) == self.band]
                if len(hits):
                    yield k, others[hits[np.argsort(-agree[hits], kind="stable")]].tolist()

    def joining(self, test) -> list[tuple[int, int]]:
        """(x, k) of row pairs that pass the test, as few as join what they can join."""
        out = []
        for k, hits in self.candidates():
            for x in hits:
                mine, its = self.root(self.component[k]), self.root(self.component[x])
                if mine != its and test(k, x):
                    self.joined[mine] = its
                    out.append((x, k))
        return out


def _proposed(block: _Block, words: int, limit: int) -> pd.DataFrame:
    """Pairs that would join the block's components if they were similar."""
    found = [(block.nodes[x], block.nodes[k]) for x, k in block.joining(lambda k, x: True)]
    size = int(block.group["size"].iat[0])
    return pd.DataFrame([(x, k, size) for x, k in found], columns=["member", "leader", "size"]).astype("int64")


def _unsettled(block: _Block, words: int, limit: int) -> pd.DataFrame:
    """The rows that may still be similar to one of another component."""
    open_ = {r for k, hits in block.candidates() for r in (k, *hits)}
    return block.group.iloc[sorted(open_)][["key", "i", "j", "own", "size", "band", "node", "component", "bits"]]


def _settled(block: _Block, words: int, limit: int) -> pd.DataFrame:
    """Links that join components, confirmed on the full sets."""
    shingle, texts, sets = Shingler(words), block.group["text"], {}

    def set_of(k):
        if k not in sets:
            sets[k] = shingle(texts.iat[k])
        return sets[k]

    found = block.joining(lambda k, x: similar(set_of(k), set_of(x), limit))
    return pd.DataFrame([sorted((block.nodes[x], block.nodes[k])) for x, k in found], columns=["a", "b"]).astype("int64")


_PROPOSED = "member long, leader long, size long"
_UNSETTLED = "key long, i int, j int, own int, size long, band int, node long, component long, bits binary"
_LINKS = "a long, b long"


def _by_block(rows: DataFrame, work, schema: str, limit: int, words: int) -> DataFrame:
    # As many tasks as the session has partitions: the work is in comparing, not in bytes.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches):
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            where = pdf[["key", "i", "j"]]
            cut = (where != where.shift()).any(axis=1).to_numpy().nonzero()[0]
            for lo, hi in zip(cut, cut[1:]):
                yield work(_Block(pdf.iloc[lo:hi], limit), words, limit)
            rest = pdf.iloc[cut[-1] :] if len(cut) else None
        if rest is not None and len(rest):
            yield work(_Block(rest, limit), words, limit)

    return dealt.mapInPandas(run, schema)


def _open(members: DataFrame, labels: DataFrame, nodes: DataFrame, large: list[int]) -> DataFrame:
    """Rows of the buckets that do not hang together; of two nodes, all pairs have been tried."""
    labelled = _labelled(members.filter("size > 2").select("key", "band", "node", "size"), labels)
    keys = labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x != y").select("key")
    return looked_up(labelled, "key", keys, large).join(nodes.select("node", "bits"), "node")


def link(df: DataFrame, scratch: Scratch, limit: int = LIMIT, words: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents: ``id``, ``row``, ``n``, ``node``; nodes: ``node``, ``component``, ``low``, ``rep``).

    ``low`` is the component's smallest id, ``rep`` the (id, row) that stands for it.
    Both are tables of ``scratch``.
    """
    signed = scratch.keep(_signed(df, limit, words, id_col, text_col))
    nodes = scratch.keep(
        signed.filter("n > 0")
        .groupBy("node")
        .agg(F.min("id").alias("low"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("rep"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    )
    docs = scratch.keep(signed.select("id", "row", "n", "node"))
    scratch.drop(signed)
    # Buckets. A leader is the node that comes first in one of four orders.
    turn = F.element_at(F.array(*(F.lit(int(x)) for x in _BAND_SALT.view(np.int64)[:4])), (F.pmod("key", F.lit(4)) + 1).cast("int"))
    filed = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    buckets = scratch.keep(
        filed.groupBy("key").agg(F.count("*").alias("size"), F.min(F.col("node").bitwiseXOR(turn)).alias("least")).filter("size > 1").select("key", "size", F.col("least").bitwiseXOR(turn).alias("leader"))
    )
    large = heavy_keys(buckets.withColumn("n", F.col("size")), "key", nodes.count() * (COORDINATES // rows_in_band(limit)))
    members = scratch.keep(looked_up(filed, "key", buckets, large).select("key", "band", "node", "size", "leader"))
    scratch.drop(buckets)
    wanted = members.select("node").distinct().join(nodes.select("node", F.col("rep.row").alias("row")), "node")
    rows = df.select(F.xxhash64(F.lit(9), F.col(id_col), F.col(text_col)).alias("row"), F.col(text_col).alias("text"))
    texts = scratch.keep(wanted.join(rows, "row").groupBy("node").agg(F.first("text").alias("text")))

    ordered = F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")
    first = members.filter("node != leader").groupBy(*ordered).agg(F.max(F.struct("size", "leader")).alias("of"))
    pairs = scratch.keep(first.select(F.when(F.col("of.leader") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("member"), "of.leader", "of.size"))
    links = scratch.keep(_confirm(pairs, texts, limit, words))
    scratch.drop(pairs)
    labels = components(links, scratch)

    blocks = scratch.keep(_in_blocks(_open(members, labels, nodes, large)))
    proposed = scratch.keep(_by_block(blocks, _proposed, _PROPOSED, limit, words).groupBy("member", "leader").agg(F.max("size").alias("size")))
    scratch.drop(blocks)
    if not proposed.isEmpty():
        more = scratch.keep(_confirm(proposed, texts, limit, words))
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = components(links, scratch)
        left = _in_blocks(_open(members, labels, nodes, large))
        unsettled = scratch.keep(_by_block(left, _unsettled, _UNSETTLED, limit, words))
        if not unsettled.isEmpty():
            more = scratch.keep(_by_block(unsettled.join(texts, "node"), _settled, _LINKS, limit, words))
            if not more.isEmpty():
                labels = components(links.unionByName(more), scratch)

    named = scratch.keep(_labelled(nodes.select("node", "low", "rep"), labels))
    ends = scratch.keep(named.groupBy("component").agg(F.min("low").alias("low"), F.min("rep").alias("rep"), F.count("*").alias("n")))
    common = heavy_keys(ends, "component", named.count())
    return docs, scratch.keep(looked_up(named.select("node", "component"), "component", ends.drop("n"), common))


def near_duplicates(df: DataFrame, limit: int = LIMIT, words: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``n_shingles``, ``component_id`` and ``kept`` of every row."""
    with Scratch(df.sparkSession) as scratch:
        docs, placed = link(df, scratch, limit, words, id_col, text_col)
        filled = docs.filter("n > 0")
        copied = heavy_keys(filled.groupBy("node").agg(F.count("*").alias("n")), "node", docs.count())
        scratch.returned(docs, placed)
    named = looked_up(filled, "node", placed.select("node", F.col("low").alias("component_id")), copied).select("id", "n", "component_id")
    out = named.unionByName(docs.filter("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(df: DataFrame, limit: int = LIMIT, words: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, the one with the smallest id, and every row without
    words, with the columns they came with. Of rows that repeat an id and a text with
    words one stays, the one with the least hash of the row."""
    with Scratch(df.sparkSession) as scratch:
        _, placed = link(df, scratch, limit, words, id_col, text_col)
        scratch.returned(placed)
    row, one = fresh(df, "row", "one")
    stay = placed.select(F.col("rep.row").alias(row)).distinct()
    has_words = F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    whole = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    order = F.xxhash64(*(F.col(f"`{f.name}`") for f in df.schema.fields if "map" not in f.dataType.simpleString()))
    # Repeats are put together before and after the shuffle, so their number does not matter.
    single = df.filter(has_words).groupBy(F.xxhash64(F.lit(9), F.col(id_col), F.col(text_col)).alias(row)).agg(F.min_by(whole, order).alias(one))
    return single.join(stay, row, "left_semi").select(f"{one}.*").unionByName(df.filter(~has_words))


def op6_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Component of every document."""
    return near_duplicates(read(spark, sf_dir, "documents"))
