"""Near-duplicate classes: join of documents on the Jaccard similarity of their word n-gram sets.

1. Every text becomes the set of its distinct n-gram hashes. Rows with equal sets are one *node*: exact copies, however
   many, go no further than a sum per node.
2. MinHash values of a node are cut into bands; rows and bands are chosen for the wanted recall at the threshold. Nodes
   are shuffled on band hashes and linked in a star to the smallest node of the bucket: rows grow with the nodes.
3. Components of those stars hold all candidate pairs. A component is compared as a whole when that costs less than its
   buckets one by one; a long chain of small buckets is compared bucket by bucket, each pair in its first common bucket.
4. A group of any size is cut into blocks of bounded rows and bytes; each pair of blocks is one task's group, in which
   every pair is verified on the full n-gram sets. Only a link count and a spanning forest leave it, never the pairs.

Defined cases: a text without words (null, empty, only punctuation) links with nothing and is its own class; a text of
fewer than ``size`` words has one n-gram, all its words. Rows may repeat, ids may be null or tied: copies are counted
row by row, and a class is named by its smallest id that is not null (null if there is none; a wordless row keeps its
own id). Extra columns are ignored. Texts are taken whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidegauge.llm import words as W
from tidegauge.llm.common import scratch, stored, text_passes
from tidegauge.llm.components import components

SIZE, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.99999, 128
#: Nodes and bytes of text in one block; a group of rows in a task holds two blocks.
BLOCK_NODES, BLOCK_BYTES = 512, 4 << 20
_U = np.uint64


def banding(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """``(bands, rows)``: the most rows whose bands reach the recall at the threshold with at most ``most`` hashes."""
    for rows in range(12, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if bands * rows <= most:
            return bands, rows
    return most, 1


def minhashes(grams: np.ndarray, n: int) -> np.ndarray:
    """The least value of each of ``n`` hash functions over a set of 64-bit hashes."""
    rng = np.random.default_rng(7)
    salt = rng.integers(0, 2**63, n).astype(_U)[:, None]
    odd = rng.integers(0, 2**62, n).astype(_U)[:, None] * _U(2) + _U(1)
    least = np.full(n, np.iinfo(_U).max, _U)
    for k in range(0, len(grams), 4096):
        np.minimum(least, ((grams[None, k : k + 4096] ^ salt) * odd).min(axis=1), out=least)
    return least


def set_key(grams: np.ndarray) -> bytes:
    """16 bytes that name a set of hashes."""
    one, two = W.mix(grams), W.mix(grams ^ _U(0x5851F42D4C957F2D))
    return np.array([one.sum(dtype=_U), two.sum(dtype=_U) ^ _U(len(grams))], _U).tobytes()


def signatures(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, text_hash, n_bytes, node, bands``; node is null for a text without words."""
    text = F.col("text").cast("string")
    source = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, data, offsets in text_passes(batch.column(2)):
                nodes, found = [], []
                for grams in W.row_shingles(data, offsets, size):
                    if len(grams):
                        least = minhashes(grams, bands * rows).reshape(bands, rows)
                        folded = W.mix(least[:, 0])
                        for k in range(1, rows):
                            folded = W.mix(folded ^ least[:, k])
                        nodes.append(set_key(grams))
                        found.append(folded.view(np.int64))
                    else:
                        nodes.append(None)
                        found.append(None)
                own = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays(
                    [
                        own.column(0), own.column(1), pa.array(np.diff(offsets), pa.int64()),
                        pa.array(nodes, pa.binary()), pa.array(found, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "text_hash", "n_bytes", "node", "bands"],
                )

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(
        run, f"doc_id {kind}, text_hash LONG, n_bytes LONG, node BINARY, bands ARRAY<LONG>"
    )


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections; n-grams that only one set has are left out first."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (low, low + width))
        part = np.zeros((len(sets), width), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        total += part @ part.T
    return np.rint(total).astype(np.int64)


def _verify(frame: pd.DataFrame, size: int, threshold: float) -> pd.DataFrame:
    """Links of two blocks: per node the copies behind its partners, and a node it shares a tree with."""
    frame = frame.drop_duplicates("node").reset_index(drop=True)
    raw = [t.encode() for t in frame["text"]]
    data = np.frombuffer(b"".join(raw), np.uint8)
    sets = W.row_shingles(data, np.concatenate(([0], np.cumsum([len(t) for t in raw]))).astype(np.int64), size)
    # A node is what its text says: of rows that only share an id and a hash, the wrong one goes.
    right = [k for k, s in enumerate(sets) if len(s) and set_key(s) == frame["node"][k]]
    frame, sets = frame.iloc[right].reset_index(drop=True), [sets[k] for k in right]
    if len(sets) < 2:
        return pd.DataFrame({"node": [], "links": [], "root": []})
    inter, n = _overlaps(sets), np.array([len(s) for s in sets])
    linked = inter >= threshold * (n[:, None] + n[None, :] - inter) - 1e-9
    np.fill_diagonal(linked, False)
    block = frame["block"].to_numpy()
    if frame["left"][0] != frame["right"][0]:
        linked &= block[:, None] != block[None, :]
    band = frame["band"][0]
    if band >= 0:
        own = np.array(frame["bands"].tolist())
        for k in range(band):
            linked &= own[:, None, k] != own[None, :, k]
    weight = frame["weight"].to_numpy()
    links, root = linked @ weight, np.arange(len(sets))
    while True:  # labels fall to the smallest row of each tree
        near = np.where(linked, root[None, :], len(sets)).min(axis=1)
        step = np.minimum(root, near)
        step = step[step]
        if (step == root).all():
            break
        root = step
    some = linked.any(axis=1)
    node = frame["node"].to_numpy()
    return pd.DataFrame({"node": node[some], "links": links[some].astype("int64"), "root": node[root[some]]})


def join(
    docs: DataFrame, size: int = SIZE, threshold: float = THRESHOLD, recall: float = RECALL, root: str | None = None
) -> DataFrame:
    """``doc_id, text_hash, class_id, n_links, kept`` per row.

    The class is that of linked rows, ``n_links`` counts the rows linked with this one directly; ``kept`` marks the rows
    that stand for their class: its smallest id, of several texts of that id the one of the smallest hash.
    """
    spark = docs.sparkSession
    root = root or scratch(spark, "ngram-join")
    bands, rows = banding(threshold, recall)
    signed = stored(signatures(docs, size, bands, rows), root, "signed")
    nodes = signed.where("node IS NOT NULL").groupBy("node").agg(
        F.count(F.lit(1)).alias("weight"),
        F.min("doc_id").alias("low"),
        # one row stands for the text of the set: the one of the smallest id, ids that are null last
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash", "n_bytes", "bands")).alias("one"),
    )
    nodes = stored(
        nodes.select("node", "weight", "low", "one.doc_id", "one.text_hash", "one.n_bytes", "one.bands"), root, "nodes"
    )

    spread = nodes.select("node", F.posexplode("bands").alias("band", "hash"))
    buckets = spread.groupBy("band", "hash").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 1")
    star = stored(spread.join(buckets, ["band", "hash"]), root, "star")
    near = components(star.select(F.col("node").alias("a"), F.col("hub").alias("b")), root, "near")

    member = star.join(near, "node")
    whole = near.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    parts = member.groupBy("component").agg(F.sum("m").alias("cost"))
    way = stored(
        whole.join(parts, "component").select("component", (F.col("n") * F.col("n") <= F.col("cost")).alias("whole")),
        root,
        "way",
    )
    grouped = near.join(way.where("whole"), "component").select(
        F.col("component").alias("gid"), F.lit(-1).alias("band"), "node"
    ).union(
        member.join(way.where("NOT whole"), "component").select(
            F.encode(F.concat_ws(":", "band", "hash"), "utf-8").alias("gid"), "band", "node"
        )
    )
    kept = nodes.select("node", "weight", "doc_id", "text_hash", "n_bytes", "bands")
    grouped = stored(grouped.join(kept, "node"), root, "grouped")
    sizes = grouped.groupBy("gid").agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("size"))
    sizes = sizes.select(
        "gid", F.ceil(F.greatest(F.col("n") / BLOCK_NODES, F.col("size") / BLOCK_BYTES)).cast("int").alias("blocks")
    )
    # a table of its own, so that the join below can split a group that holds very many rows
    sizes = stored(sizes, root, "sizes")
    dealt = grouped.join(sizes, "gid").withColumn("block", F.pmod(F.xxhash64("node", "gid"), "blocks").cast("int"))
    text = docs.select(
        "doc_id", F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text")
    )
    dealt = dealt.alias("d").join(
        text.alias("t"),
        F.expr("d.doc_id <=> t.doc_id AND d.text_hash = t.text_hash"),
    ).select("node", "weight", "gid", "band", "block", "blocks", F.expr("CASE WHEN band >= 0 THEN bands END").alias("bands"), "text")
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "node", "weight", "gid", "band", "block", "bands", "text",
        F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"),
    )
    verified = stored(
        pairs.groupBy("gid", "left", "right").applyInPandas(
            lambda frame: _verify(frame, size, threshold), "node BINARY, links LONG, root BINARY"
        ),
        root,
        "verified",
    )
    trees = components(verified.select(F.col("node").alias("a"), F.col("root").alias("b")), root, "linked")

    linked = verified.groupBy("node").agg(F.sum("links").alias("links"))
    facts = nodes.select("node", "weight", "low", "text_hash").join(linked, "node", "left").join(trees, "node", "left")
    facts = stored(
        facts.select("node", "weight", "low", "text_hash", "links", F.coalesce("component", "node").alias("component")), root, "facts"
    )
    names = facts.groupBy("component").agg(
        F.min(F.struct(F.col("low").isNull().alias("none"), F.col("low").alias("id"), F.col("text_hash").alias("hash"))).alias("first")
    )
    facts = facts.join(names, "component").select(
        "node", "first", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    alone = F.col("node").isNull()
    return signed.join(facts, "node", "left").select(
        "doc_id",
        "text_hash",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (alone | F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("text_hash") == F.col("first.hash"))).alias("kept"),
    )


def one_per_class(docs: DataFrame, size: int = SIZE, threshold: float = THRESHOLD, root: str | None = None) -> DataFrame:
    """``docs`` with one row of each class, all its columns kept; rows without words all stay."""
    root = root or scratch(docs.sparkSession, "ngram-join")
    found = join(docs, size, threshold, root=root).where("kept")
    kept = stored(
        found.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.count(F.lit(1)).alias("__n")),
        root,
        "kept",
    )
    text = F.col("text").cast("string")
    # Equal ids with equal texts are one row too many where the text has words.
    rows = docs.withColumn("__text_hash", F.xxhash64(text)).join(
        kept.select("__id", "__hash"), F.expr("doc_id <=> __id AND __text_hash = __hash"), "left_semi"
    )
    if not kept.where("__n > 1").isEmpty():
        worded = F.coalesce(F.octet_length(F.regexp_replace(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "")), F.lit(0)) > 0
        rows = rows.where(worded).dropDuplicates(["doc_id", "__text_hash"]).unionByName(rows.where(~worded))
    return rows.drop("__text_hash")
