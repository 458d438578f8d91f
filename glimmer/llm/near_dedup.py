"""N-gram Jaccard join by multiple-global-order filtering.

Documents with the same set of shingles are one node. Two nodes of Jaccard similarity t or more share a token among
the first n - ceil(t n) + 1 of each set, whatever the global order of tokens. Prefixes are taken under two
orders, both rare tokens first (a count sketch of fixed size over all documents gives each token's class) and
then by two unrelated hashes. Candidates must share a prefix token under both orders: each order's pairs
are found on their own, the two filters are intersected on pairs of ids, and only what is left is verified, on
whole texts.

Large groups of near copies would make all their pairs rows. So nodes that share a minimum hash with many others
form clusters, which are cut into blocks. A block is compared in one task, through an inverted list. Then the blocks
meet a few members of the cluster's largest part: what reaches them is connected with it and needs no pairs of its own.
Only the rest meets the others, block by block. Candidate pairs are formed across clusters only, so no link is lost
and no task gathers a whole cluster.

A set is known by 128 bits; its node is the number of the first row that holds it.

Null or blank text has an empty set, is linked with nothing and is its own component. Null doc_ids take part as
rows but cannot name a component unless all its ids are null. Repeated rows and copies fall into one node.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glimmer.llm.common import discard, give_back, new_path, numbered, pick_rows, prepare, small, stage
from glimmer.llm.shingles import forget, mix64, shingle_sets

#: Cells of the count sketch (its size does not grow with the corpus) and pieces in which it is added up.
SKETCH_CELLS, SKETCH_PIECES = 1 << 24, 128
#: A task sends its cells after this many documents, so that their 16 bits suffice (a cell that still ran over would only rank its tokens otherwise).
SKETCH_DOCS = 1 << 15
#: Minimum hashes per node; a value that at least CLUSTER nodes share makes them a cluster, compared in blocks of BLOCK nodes.
KEYS, CLUSTER, BLOCK = 8, 32, 512
#: Bits of a prefix token that are dropped: 48 travel, and two tokens that agree in them only add a candidate.
TOKEN_SHIFT = np.uint64(16)
ORDER_SEEDS = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))
#: Members of a cluster's largest part that every block of the cluster meets.
HUBS = 16


def prefix_size(n: int, percent: int) -> int:
    """Leading tokens of a set of n that must hold a common one with any set of Jaccard percent/100 or more."""
    return n - -(-percent * n // 100) + 1


def document_counts(docs: DataFrame, size: int) -> np.ndarray:
    """Class (floor of log2) of each sketch cell: how many documents hold a shingle that falls there."""

    prepare(docs.sparkSession)

    def count(batches):
        cells, held = np.zeros(SKETCH_CELLS, np.uint16), 0

        def sent():
            parts = np.split(cells, SKETCH_PIECES)
            live = [k for k, p in enumerate(parts) if p.any()]
            # counts are small: byte planes (all low bytes first) pack far better than whole words
            planes = [zlib.compress(parts[k].view(np.uint8).reshape(-1, 2).T.tobytes(), 1) for k in live]
            return pa.RecordBatch.from_arrays([pa.array(live, pa.int32()), pa.array(planes, pa.binary())], ["piece", "cells"])

        for rb in batches:
            texts = rb.column(0).to_pylist()
            for i in range(0, len(texts), 256):
                np.add.at(cells, (np.concatenate(shingle_sets(texts[i : i + 256], size)) & np.uint64(SKETCH_CELLS - 1)).astype(np.int64), np.uint16(1))
            held += len(texts)
            give_back()
            if held >= SKETCH_DOCS:
                yield sent()
                cells[:], held = 0, 0
        yield sent()
        forget()

    def add(key, table):
        total = np.zeros(SKETCH_CELLS // SKETCH_PIECES, np.uint64)
        for x in table.column("cells"):
            planes = np.frombuffer(zlib.decompress(x.as_py()), np.uint8).reshape(2, -1)
            total += np.ascontiguousarray(planes.T).view(np.uint16)[:, 0]
        classes = np.log2(np.maximum(total, 1).astype(np.float64)).astype(np.uint8)
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "classes": pa.array([classes.tobytes()], pa.binary())})

    rows = docs.select("text").mapInArrow(count, "piece int, cells binary").groupBy("piece").applyInArrow(add, "piece int, classes binary").collect()  # SKETCH_PIECES rows
    out = np.zeros(SKETCH_CELLS, np.uint8)
    step = SKETCH_CELLS // SKETCH_PIECES
    for r in rows:
        out[r["piece"] * step : (r["piece"] + 1) * step] = np.frombuffer(r["classes"], np.uint8)
    return out


def name_of(s: np.ndarray) -> tuple[int, int]:
    """Name of a set: two 64-bit hashes of it."""
    h = mix64(s + ORDER_SEEDS[0]) + mix64(s ^ ORDER_SEEDS[1]) * np.uint64(3)
    sums = np.array([np.sum(h, dtype=np.uint64), np.sum(mix64(h ^ ORDER_SEEDS[0]), dtype=np.uint64)], np.uint64) + np.uint64(len(s))
    return tuple(mix64(sums).astype(np.int64).tolist())


def nodes_table(docs: DataFrame, size: int, percent: int, classes: np.ndarray) -> DataFrame:
    """Per document: doc_id, row, n, name (two longs), keys (minimum hashes), one array of prefix tokens per order."""
    told = docs.sparkSession.sparkContext.broadcast(zlib.compress(classes.tobytes(), 1))
    kept: dict[str, np.ndarray] = {}

    def sets(batches):
        if "classes" not in kept:
            kept["classes"] = np.frombuffer(zlib.decompress(told.value), np.uint8)
        rank = kept["classes"]
        for rb in batches:
            ids, rows, texts = rb.column(0), rb.column(1), rb.column(2).to_pylist()
            n, name, keys, pre = [], ([], []), [], ([], [])
            for i in range(0, len(texts), 256):
                for s in shingle_sets(texts[i : i + 256], size):
                    n.append(len(s))
                    if not len(s):
                        keys.append(None)
                        for p in (*name, *pre):
                            p.append(None)
                        continue
                    for p, h in zip(name, name_of(s), strict=True):
                        p.append(h)
                    keys.append(np.array([int(mix64(s + np.uint64(k + 1)).min()) >> 4 << 3 | k for k in range(KEYS)], np.int64))
                    common, p = rank[(s & np.uint64(SKETCH_CELLS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(58), prefix_size(len(s), percent)
                    for k, seed in enumerate(ORDER_SEEDS):
                        order = common | (mix64(s ^ seed) >> np.uint64(6))
                        first = np.argpartition(order, p - 1)[:p] if p < len(s) else slice(None)
                        pre[k].append((s[first] >> TOKEN_SHIFT).view(np.int64))
            kinds = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, rows, pa.array(n, pa.int64()), *(pa.array(h, pa.int64()) for h in name), pa.array(keys, kinds), pa.array(pre[0], kinds), pa.array(pre[1], kinds)], ["doc_id", "row", "n", "name", "name2", "keys", "first", "second"])
            give_back()
        forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "row", "text").mapInArrow(sets, "doc_id long, row long, n long, name long, name2 long, keys array<long>, first array<long>, second array<long>")


def verify(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets have Jaccard percent/100 or more; a node is the row of one of its texts; staged."""
    wanted = stage(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "near-wanted")
    texts = pick_rows(docs, "row", wanted).select(F.col("row").alias("node"), "text")
    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")

    def test(batches):
        held = (None, None, None)
        for rb in batches:
            a, b = rb.column(0).to_pylist(), rb.column(1).to_pylist()
            ta, tb = rb.column(2).to_pylist(), rb.column(3).to_pylist()
            good = []
            for i in range(0, len(a), 64):
                right = shingle_sets(tb[i : i + 64], size)
                for k, y in enumerate(right, i):
                    if held[0] != a[k] or held[2] != ta[k]:
                        held = (a[k], shingle_sets([ta[k]], size)[0], ta[k])
                    x = held[1]
                    common = np.intersect1d(x, y, assume_unique=True).size
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        good.append(k)
            yield rb.select([0, 1]).take(pa.array(good, pa.int64()))
            give_back()
        forget()

    return stage(both.select("a", "b", "text_a", "text_b").mapInArrow(test, "a long, b long"), "near-links")


def clusters(nodes: DataFrame) -> DataFrame:
    """(node, label) of the nodes that share a minimum hash with at least CLUSTER nodes; staged.

    A node goes by its most common hash; two hashes that mostly occur together are one label.
    """
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    big = stage(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= CLUSTER), "near-keys")
    own = stage(keyed.join(small(big), "key"), "near-keyed")
    top = own.groupBy("node").agg(F.max(F.struct("count", "key")).alias("t")).select("node", F.col("t.key").alias("a"), F.col("t.count").alias("count_a"))
    top = stage(top, "near-top")
    ties = own.join(top, "node").where(F.col("key") != F.col("a")).groupBy("a", F.col("key").alias("b")).agg(F.count(F.lit(1)).alias("both"), F.first("count_a").alias("count_a"), F.first("count").alias("count_b"))
    ties = stage(ties.where(2 * F.col("both") >= F.least("count_a", "count_b")).select("a", "b"), "near-ties")
    if ties.isEmpty():
        return top.select("node", F.col("a").alias("label"))
    roots = connected(ties).select(F.col("node").alias("a"), "root")
    return stage(top.join(small(roots), "a", "left").select("node", F.coalesce("root", "a").alias("label")), "near-labels")


def forest(sets: list[np.ndarray], others: list[np.ndarray] | None, percent: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Links of a spanning forest of the similar pairs between two lists of sets, or within one, and the root of each; positions run on into ``others``."""
    right = sets if others is None else others
    shift = 0 if others is None else len(sets)
    sizes = np.array([len(x) for x in right])
    tokens = np.concatenate(right)
    by = np.argsort(tokens, kind="stable")
    owner = np.repeat(np.arange(len(right)), sizes)[by]
    tokens = tokens[by]
    parent = list(range(len(sets) + (0 if others is None else len(others))))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i, x in enumerate(sets):
        lo, hi = np.searchsorted(tokens, x), np.searchsorted(tokens, x, side="right")
        n = hi - lo
        stop = np.cumsum(n)
        common = np.bincount(owner[np.repeat(lo - (stop - n), n) + np.arange(int(stop[-1]))], minlength=len(right))
        for j in np.flatnonzero(100 * common >= percent * (len(x) + sizes - common)).tolist():
            a, b = top(i), top(j + shift)
            if a != b:
                parent[b] = a
                out.append((i, j + shift))
    return out, [top(i) for i in range(len(parent))]


def within_clusters(label: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) that connect what is similar inside each cluster; staged.

    Texts travel once to their block and, in clusters of several blocks, once to the hubs. The rest that reaches no hub (r of
    m members) meets every block: about (r^2 + 2 r (m - r)) / BLOCK texts more.
    """
    spark = docs.sparkSession
    sizes = stage(label.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "near-sizes")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    members = stage(label.join(small(sizes), "label").select(F.col("node").alias("row"), "label", own.alias("own"), "blocks"), "near-members")
    path = new_path(spark, "near-held")
    texts = pick_rows(docs, "row", members.select("row")).join(small(members), "row").select("label", "own", "blocks", F.col("row").alias("node"), "text")
    held = stage(texts, "near-held", codec="zstd", path=path)

    def settle(key, rows):
        """The parts of a block."""
        nodes = rows.column("node").to_numpy()
        _, tops = forest(shingle_sets(rows.column("text").to_pylist(), size), None, percent)
        forget()
        give_back()
        return pa.table({"label": rows.column("label"), "node": rows.column("node"), "top": pa.array(nodes[tops], pa.int64())})

    tops = stage(held.groupBy("label", "own").applyInArrow(settle, "label long, node long, top long"), "near-tops")
    links = tops.where(F.col("node") != F.col("top")).select(F.col("node").alias("a"), F.col("top").alias("b"))
    wide = sizes.where("blocks > 1")
    if not wide.isEmpty():
        links = links.unionByName(_between_blocks(held.where("blocks > 1"), stage(tops.join(small(wide), "label"), "near-parts"), size, percent))
    links = stage(links, "near-early")
    discard(spark, path)
    return links


def _between_blocks(held: DataFrame, parts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) that connect the parts of each cluster of several blocks; held: the texts, parts: label, node, top, blocks; staged."""
    largest = parts.groupBy("label", "top").agg(F.count(F.lit(1)).alias("n")).groupBy("label").agg(F.max_by("top", F.struct("n", "top")).alias("top"))
    own = parts.join(small(stage(largest, "near-largest")), ["label", "top"])  # a part lies in one block, so its list is bounded
    hubs = own.groupBy("label").agg(F.slice(F.array_sort(F.collect_list("node")), 1, HUBS).alias("hubs"))
    hubs = stage(hubs.select(F.explode("hubs").alias("node")), "near-hubs")
    sent = held.join(small(hubs), "node", "left_semi").select("label", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own"), "node", "text", F.lit(True).alias("hub"))

    def reach(key, rows):
        """Links of a block's members to the hubs: at least one for each that has any."""
        rows = rows.sort_by([("hub", "ascending")])
        node, texts, hub = (rows.column(c).to_pylist() for c in ("node", "text", "hub"))
        sets, n = shingle_sets(texts, size), hub.count(False)
        found, _ = forest(sets[:n], sets[n:], percent) if n else ([], [])
        forget()
        give_back()
        return pa.table({"a": pa.array([node[i] for i, _ in found], pa.int64()), "b": pa.array([node[j] for _, j in found], pa.int64())})

    blocks = held.select("label", "own", "node", "text", F.lit(False).alias("hub")).unionByName(sent)
    reached = stage(blocks.groupBy("label", "own").applyInArrow(reach, "a long, b long"), "near-reached")
    main = stage(reached.join(parts, F.col("a") == F.col("node")).select("top").distinct().withColumn("main", F.lit(True)), "near-main")
    placed = stage(parts.join(small(main), "top", "left").select("label", "node", F.coalesce("main", F.lit(False)).alias("main")), "near-placed")
    cells = lambda c: F.ceil(F.count_if(c) / BLOCK).cast("int")
    counts = stage(placed.groupBy("label").agg(cells(F.col("main")).alias("mains"), cells(~F.col("main")).alias("rests")).where("rests > 0"), "near-cells")
    if counts.isEmpty():
        return reached
    at = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    cell = F.when(F.col("main"), at("mains")).otherwise(F.col("mains") + at("rests"))
    meets = F.sequence(F.when(F.col("main"), F.col("mains")).otherwise(F.lit(0)), F.col("mains") + F.col("rests") - 1)
    plan = stage(placed.join(small(counts), "label").select("node", cell.alias("own"), meets.alias("meets")), "near-plan")
    texts = held.select("label", "node", "text").join(small(plan), "node").select("label", "node", "own", "text", F.explode("meets").alias("met"))
    texts = texts.select("label", F.least("own", "met").alias("lo"), F.greatest("own", "met").alias("hi"), "own", "node", "text")

    def link(key, rows):
        """A spanning forest of the links between two cells, or within one."""
        lo, hi = key[1].as_py(), key[2].as_py()
        own, node, texts = (rows.column(c).to_pylist() for c in ("own", "node", "text"))
        sides: dict[int, dict[int, np.ndarray]] = {lo: {}, hi: {}}
        for i, s in enumerate(shingle_sets(texts, size)):
            sides[own[i]][node[i]] = s
        left, right = sides[lo], sides[hi]
        found = []
        if left and right:
            found, _ = forest(list(left.values()), None if lo == hi else list(right.values()), percent)
        at = list(left) + ([] if lo == hi else list(right))
        forget()
        give_back()
        return pa.table({"a": pa.array([at[i] for i, _ in found], pa.int64()), "b": pa.array([at[j] for _, j in found], pa.int64())})

    return reached.unionByName(stage(texts.groupBy("label", "lo", "hi").applyInArrow(link, "a long, b long"), "near-inside"))


def _met(named: DataFrame, prefix: str, percent: int, path: str) -> DataFrame:
    """Pairs (a, b) of nodes of different groups that share a token of column ``prefix`` and whose sizes allow the similarity; staged at ``path``."""
    posts = named.select("node", "n", "label", F.explode(prefix).alias("token"))
    w, group = Window.partitionBy("token"), F.coalesce("label", "node")
    shared = posts.withColumn("lo", F.min(group).over(w)).withColumn("hi", F.max(group).over(w)).where(F.col("lo") != F.col("hi"))
    posted = new_path(named.sparkSession, f"near-{prefix}")
    shared = stage(shared.select("token", "node", "n", group.alias("label")), f"near-{prefix}", path=posted)
    a, b = (shared.select("token", F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("label").alias(f"l_{x}")) for x in "ab")
    near = (F.col("a") < F.col("b")) & (F.col("l_a") != F.col("l_b")) & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    met = stage(a.join(b, "token").where(near).select("a", "b").distinct(), "near-met", path=path)
    discard(named.sparkSession, posted)
    return met


def candidates(nodes: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes of different groups that share prefix tokens under both orders and whose sizes allow the similarity; staged."""
    named = nodes.join(small(label), "node", "left")
    spark = nodes.sparkSession
    paths = [new_path(spark, "near-met") for _ in range(2)]
    first, second = (_met(named, prefix, percent, path) for prefix, path in zip(("first", "second"), paths, strict=True))
    pairs = stage(second.join(small(first), ["a", "b"], "left_semi"), "near-pairs")
    discard(spark, *paths)
    return pairs


def connected(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component of the links (a, b), by alternating large and small stars; staged.

    Each round rewrites the links in the shared folder; rounds grow with the logarithm of the components' size.
    """
    spark = links.sparkSession
    path = new_path(spark, "cc")
    edges = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("u") != F.col("v")).distinct(), "cc", path=path)
    before = None
    while True:
        paths = [path, new_path(spark, "cc"), new_path(spark, "cc")]
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        large = stage(large, "cc", path=paths[1])
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        follow = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(follow.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "cc", path=paths[2])
        discard(spark, *paths[:2])
        path = paths[2]
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def near_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links); percent: least Jaccard in hundredths."""
    docs = numbered(docs.select("doc_id", "text"), "near-input", "row")
    table = stage(nodes_table(docs, size, percent, document_counts(docs, size)), "near-nodes", codec="zstd")
    live = table.where(F.col("name").isNotNull())
    names = stage(live.groupBy("name", "name2").agg(F.min("doc_id").alias("doc_id"), F.min("row").alias("node"), F.count(F.lit(1)).alias("copies")), "near-names")
    copies = names.where(F.col("copies") > 1).select("name", "name2", "node", F.col("doc_id").alias("least"))
    told = small(copies.select("name", "name2", "node"))
    node = F.coalesce("node", "row").alias("node")
    one = live.join(told, ["name", "name2"], "left").where(F.col("node").isNull() | (F.col("row") == F.col("node"))).select(node, "n", "keys", "first", "second")
    names = names.select("node", "doc_id")
    label = clusters(one)
    early = within_clusters(label, docs, size, percent)
    late = verify(candidates(one, label, percent), docs, size, percent)
    roots = connected(early.unionByName(late))
    out = table.select("doc_id", "n", "row", "name", "name2").join(told, ["name", "name2"], "left").select("doc_id", "n", node)
    out = out.join(small(_components(names, copies, roots)), "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _components(names: DataFrame, copies: DataFrame, roots: DataFrame) -> DataFrame:
    """node -> component_id for every node with a link or a copy; staged."""
    placed = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).join(names, "node")
    least = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = stage(placed.select("node", "root").join(least, "root").select("node", "component_id"), "near-linked")
    alone = copies.select("node", F.col("least").alias("component_id")).join(linked, "node", "left_anti")
    return stage(linked.unionByName(alone), "near-components")
