"""Near-duplicate vectors by product quantisation: inverted lists, residual codes, exact rerank.

1. Vectors of one label and length are compared, at unit length. Vectors of equal direction are one *node* with a count.
2. A coarse quantiser and codebooks for ``SUBSPACES`` parts of the residuals are trained on a sample of at most
   ``TRAIN_ROWS`` nodes. The number of lists grows with the table, one for ``PER_LIST`` nodes of the largest label; beyond
   ``LEVEL`` lists the quantiser has two levels, centroids and centroids of what these leave. Every node is indexed: its
   list, its codes, and the length of what the codes lose.
3. A query reads its own list and every list whose border with it, on either level, is nearer than ``slack`` times the
   greatest distance a link can have. Slack 1 can miss nothing; by default it is ``DEVIATIONS`` standard deviations of a
   shift of that length in a random direction, and recall is measured on planted links. A pair is found if either side
   reads the other's list.
4. Distances come from tables of the query's residual against the codebooks. A candidate goes on if its distance is
   within the limit plus the length its codes lose, so the tables lose no link; the exact cosine in double precision
   decides. Lists are compared some thousand rows at a time, short ones together, long ones in pairs of blocks; link
   counts and a spanning forest leave a task, no pairs.

Defined cases: a vector that is null, zero, or holds null or non-finite parts, and one without a label, links with
nothing and is its own component. Vectors of different lengths do not link. Rows may repeat; a component is named by its
smallest ``vec_id``; null ids are ignored in that. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidegauge.llm.common import scratch, stored
from tidegauge.llm.components import components

COSINE, TRAIN_ROWS, SUBSPACES, CODES = 0.93, 20_000, 8, 64
#: Nodes of the largest label to a list, lists of a level, standard deviations of the default slack.
PER_LIST, LEVEL, DEVIATIONS = 16, 1024, 1.25
#: Rows that are compared at a time, and pairs whose exact cosine is.
BLOCK, PAIRS = 2048, 1 << 16


def _means(points: np.ndarray, k: int, rng: np.random.Generator, turns: int = 8) -> np.ndarray:
    """Centroids by Lloyd's algorithm; an empty one moves to the point that is worst served."""
    centres = points[rng.permutation(len(points))[:k]].copy()
    for _ in range(turns):
        gap = (centres**2).sum(1)[None, :] - 2 * points @ centres.T
        own = gap.argmin(1)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        filled = counts > 0
        centres[filled] = sums[filled] / counts[filled, None]
        if not filled.all():
            worst = np.argsort(-gap.min(1))[: (~filled).sum()]
            centres[~filled][: len(worst)] = points[worst]
    return centres


def _gaps(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances to the centroids."""
    return (points**2).sum(1)[:, None] + (centres**2).sum(1)[None, :] - 2 * points @ centres.T


def _near(points: np.ndarray, centres: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid, and which ones have a border with it that is at most ``reach`` away; itself included."""
    gaps = _gaps(points, centres)
    home, rows = gaps.argmin(1), np.arange(len(points))
    apart = np.sqrt(np.maximum(_gaps(centres, centres), 0))
    # distance to the plane between the home centroid and another one
    border = (gaps - gaps[rows, home][:, None]) / np.maximum(2 * apart[home], 1e-12)
    near = border <= reach
    near[rows, home] = True
    return home, near


class Index:
    """Centroids and codebooks for one vector length."""

    def __init__(self, sample: np.ndarray, lists: int, cosine: float, slack: float | None, seed: int = 3, level: int = LEVEL):
        rng = np.random.default_rng(seed)
        self.dim = sample.shape[1]
        self.centres = _means(sample, min(lists, level, len(sample)), rng)
        rest = sample - self.centres[_gaps(sample, self.centres).argmin(1)]
        fine = min(-(-lists // len(self.centres)), level, len(sample))
        self.fine = _means(rest, fine, rng) if fine > 1 else np.zeros((1, self.dim))
        rest -= self.fine[_gaps(rest, self.fine).argmin(1)]
        self.parts = np.array_split(np.arange(self.dim), min(SUBSPACES, self.dim))
        self.books = [_means(rest[:, part], min(CODES, len(sample)), rng) for part in self.parts]
        self.limit = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-6
        self.slack = min(1.0, DEVIATIONS / np.sqrt(self.dim)) if slack is None else slack

    def centre(self, cell: np.ndarray) -> np.ndarray:
        """The point a list lies round."""
        return self.centres[cell // len(self.fine)] + self.fine[cell % len(self.fine)]

    def encode(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Home list, codes, length that the codes lose, and the other lists to read."""
        reach, size = self.slack * self.limit, len(self.fine)
        first, near = _near(points, self.centres, reach)
        row, coarse = np.nonzero(near)
        at_home = first[row] == coarse
        if size == 1:
            home, cells, owner = first, coarse, row
        else:
            second, closer = _near(points[row] - self.centres[coarse], self.fine, reach)
            home = np.zeros(len(points), np.int64)
            home[row[at_home]] = first[row[at_home]] * size + second[at_home]
            pair, fine = np.nonzero(closer)
            cells, owner = coarse[pair] * size + fine, row[pair]
        other = cells != home[owner]
        cells, owner = cells[other], owner[other]
        cuts = np.searchsorted(owner, np.arange(1, len(points)))
        rest = points - self.centre(home)
        codes, lost = np.zeros((len(points), len(self.books)), np.uint8), np.zeros(len(points))
        for m, (part, book) in enumerate(zip(self.parts, self.books)):
            codes[:, m] = ((book**2).sum(1)[None, :] - 2 * rest[:, part] @ book.T).argmin(1)
            lost += ((rest[:, part] - book[codes[:, m]]) ** 2).sum(1)
        return home, codes, np.sqrt(lost), np.split(cells, cuts)

    def table_distances(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Distance of each query to each coded entry of a list, summed from per-query tables."""
        rest, total = queries - self.centre(cell), np.zeros((len(queries), len(codes)))
        for m, (part, book) in enumerate(zip(self.parts, self.books)):
            own = rest[:, part]
            table = (own**2).sum(1)[:, None] + (book**2).sum(1)[None, :] - 2 * own @ book.T
            total += table[:, codes[:, m]]
        return np.sqrt(np.maximum(total, 0))


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _nodes(vectors: DataFrame) -> DataFrame:
    """One row per distinct vector of a label, with its row count and smallest id; unusable vectors are left out."""
    x = F.col("embedding").cast("array<double>")
    kind = vectors.schema["embedding"].dataType.simpleString()
    exact = kind if kind in ("array<float>", "array<double>") else "array<double>"
    # equal directions: the parts as shares of the largest one
    top = F.array_max(F.transform(x, F.abs))
    usable = (
        F.col("label").isNotNull()
        & (F.size(x) > 0)
        & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & (top > 0)
    )
    rows = vectors.where(usable).select(
        "vec_id",
        F.col("label").cast("string").alias("label"),
        F.transform(x, lambda v: v / top + 0.0).alias("scaled"),
        F.col("embedding").cast(exact).alias("x"),
    )
    key = F.unhex(F.md5(F.concat_ws("|", F.col("label"), F.array_join(F.col("scaled"), ",")).cast("binary")))
    return rows.select("vec_id", key.alias("node"), "label", "x")


def _compare(frame: pd.DataFrame, indexes: dict[int, Index], cosine: float) -> pd.DataFrame:
    """Links of some blocks of queries with the entries of their lists."""
    index = indexes[int(frame["dim"].iloc[0])]
    x, is_entry = _unit(frame["x"].tolist()), frame["entry"].to_numpy()
    node, weight, home = frame["node"].to_numpy(), frame["weight"].to_numpy(), frame["home"].to_numpy()
    cell, near = frame["cell"].to_numpy(), frame["near"].to_numpy()
    codes, lost = frame["codes"].to_numpy(), frame["lost"].to_numpy()
    lists = frame.groupby(["label", "cell"], sort=False).ngroup().to_numpy()
    order = np.argsort(lists, kind="stable")
    found = []
    for rows in np.split(order, np.flatnonzero(np.diff(lists[order])) + 1):
        e, q = rows[is_entry[rows]], rows[~is_entry[rows]]
        if not len(e) or not len(q):
            continue
        own_codes = np.frombuffer(b"".join(codes[e]), np.uint8).reshape(len(e), -1)
        maybe = index.table_distances(x[q], int(cell[e[0]]), own_codes) <= index.limit + lost[e][None, :] + 1e-6
        at_q, at_e = np.split(np.unique(np.concatenate((node[q], node[e])), return_inverse=True)[1], [len(q)])
        maybe &= at_q[:, None] != at_e[None, :]
        a, b = np.nonzero(maybe)
        exact = [
            np.einsum("ij,ij->i", x[q[a[k : k + PAIRS]]], x[e[b[k : k + PAIRS]]]) >= cosine for k in range(0, len(a), PAIRS)
        ]
        if not exact or not (exact := np.concatenate(exact)).any():
            continue
        a, b = a[exact], b[exact]
        # A pair whose two lists read each other is met twice: each node then counts the other as a query. If only this
        # side reads the other's list, both are counted here.
        base = len(index.centres) * len(index.fine)
        reads = np.concatenate([k * base + near[j] for k, j in enumerate(e)])
        alone = (home[q][a] != cell[e[0]]) & ~np.isin(b * base + home[q][a], reads)
        size = int(max(at_q.max(), at_e.max())) + 1
        links = np.bincount(at_q[a], weight[e][b], size) + np.bincount(at_e[b[alone]], weight[q][a[alone]], size)
        root = np.arange(size)
        while True:
            low = np.minimum(root[at_q[a]], root[at_e[b]])
            step = root.copy()
            np.minimum.at(step, at_q[a], low)
            np.minimum.at(step, at_e[b], low)
            step = step[step]
            if (step == root).all():
                break
            root = step
        names = np.empty(size, object)
        names[at_q], names[at_e] = node[q], node[e]
        touched = np.unique(np.concatenate((at_q[a], at_e[b])))
        found.append(pd.DataFrame({"node": names[touched], "links": links[touched].astype("int64"), "root": names[root[touched]]}))
    return pd.concat(found) if found else pd.DataFrame({"node": [], "links": [], "root": []})


def near_duplicates(
    vectors: DataFrame, cosine: float = COSINE, lists: int | None = None, slack: float | None = None, root: str | None = None
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row."""
    spark = vectors.sparkSession
    root = root or scratch(spark, "pq")
    named = stored(_nodes(vectors), root, "rows")
    nodes = named.groupBy("node", "label").agg(
        F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("low"), F.first("x").alias("x")
    )
    nodes = stored(nodes.withColumn("dim", F.size("x")), root, "nodes")

    indexes: dict[int, Index] = {}
    largest = nodes.groupBy("dim", "label").count().groupBy("dim").agg(F.max("count").alias("most"))
    for row in largest.collect():  # one row per vector length
        dim = row["dim"]
        sample = nodes.where(F.col("dim") == dim).orderBy(F.xxhash64("node"), "node").limit(TRAIN_ROWS).select("x")
        wanted = lists or -(-row["most"] // PER_LIST)
        indexes[dim] = Index(_unit([r["x"] for r in sample.collect()]), wanted, cosine, slack)
    if not indexes:
        return vectors.select(
            "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
        )
    shared = spark.sparkContext.broadcast(indexes)

    kind = nodes.schema["x"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                own = batch.slice(start, 2048).to_pandas()
                for dim, part in own.groupby("dim"):
                    home, codes, lost, near = shared.value[dim].encode(_unit(part["x"].tolist()))
                    out = part[["node", "label", "weight", "dim", "x"]].assign(
                        home=home, codes=[c.tobytes() for c in codes], lost=lost, near=near
                    )
                    yield pa.RecordBatch.from_pandas(out, preserve_index=False)

    coded = stored(
        nodes.select("node", "label", "weight", "dim", "x").mapInArrow(
            encode,
            f"node BINARY, label STRING, weight LONG, dim INT, x {kind}, home LONG, codes BINARY, lost DOUBLE, near ARRAY<LONG>",
        ),
        root,
        "coded",
    )
    cells = ["label", "dim", "cell"]
    entries = coded.withColumn("cell", F.col("home"))
    queries = coded.withColumn("cell", F.explode(F.concat(F.array("home"), "near")))
    blocks = lambda df, name: df.groupBy(*cells).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    # a list that only queries or only entries have needs no comparison, and one lone node neither
    sizes = (
        blocks(entries, "entry_blocks")
        .join(blocks(queries, "query_blocks"), cells)
        .join(queries.groupBy(*cells).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), cells)
    )
    sizes = stored(sizes, root, "sizes")
    # Short lists share a task: as many bins as keep their rows near BLOCK.
    total = sizes.agg(F.sum("n")).first()[0] or 1
    parts = F.lit(max(1, -(-total // BLOCK)))
    only = lambda entry, wanted, name: (F.col(name) if entry == wanted else F.lit(None).cast(coded.schema[name].dataType)).alias(name)
    deal = lambda df, own, other, entry: df.join(sizes.drop("n"), cells).select(
        *cells, F.lit(entry).alias("entry"), "node", "weight", "x", "home",
        only(entry, True, "codes"), only(entry, True, "lost"), only(entry, True, "near"),
        F.pmod(F.xxhash64("label", "cell"), parts).alias("bin"),
        F.pmod(F.xxhash64("node"), f"{own}_blocks").cast("int").alias(f"{own}_block"),
        F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)).alias(f"{other}_block"),
    )
    dealt = deal(entries, "entry", "query", True).unionByName(deal(queries, "query", "entry", False))
    verified = stored(
        dealt.groupBy("dim", "bin", "entry_block", "query_block").applyInPandas(
            lambda frame: _compare(frame, shared.value, cosine), "node BINARY, links LONG, root BINARY"
        ),
        root,
        "verified",
    )
    trees = components(verified.select(F.col("node").alias("a"), F.col("root").alias("b")), root, "linked")
    linked = verified.groupBy("node").agg(F.sum("links").alias("links"))
    facts = nodes.select("node", "weight", "low").join(linked, "node", "left").join(trees, "node", "left")
    facts = stored(
        facts.select("node", "weight", "low", "links", F.coalesce("component", "node").alias("component")), root, "facts"
    )
    names = facts.groupBy("component").agg(F.min("low").alias("component_id"))
    facts = facts.join(names, "component").select(
        "node", "component_id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    found = named.select("vec_id", "node").join(facts, "node").select("vec_id", "n_links", "component_id")
    others = (
        vectors.select("vec_id")
        .groupBy("vec_id").agg(F.count(F.lit(1)).alias("all"))
        .join(named.groupBy(F.col("vec_id").alias("v")).agg(F.count(F.lit(1)).alias("used")), F.expr("vec_id <=> v"), "left")
        .select("vec_id", F.explode(F.array_repeat(F.lit(0).cast("long"), (F.col("all") - F.coalesce("used", F.lit(0))).cast("int"))).alias("n_links"))
        .select("vec_id", "n_links", F.col("vec_id").alias("component_id"))
    )
    return found.unionByName(others).select(
        "vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept")
    )
