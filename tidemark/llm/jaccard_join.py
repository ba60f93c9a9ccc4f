"""N-gram Jaccard self-join by prefix trees.

A document is the set of its distinct k-word shingles (64-bit hashes). All sets follow one global order: shingles
by a document-frequency sketch, rare first, then by hash. Two sets of similarity t share at least l shingles among
the first |x| - ceil(t |x|) + l of each, so only these prefixes are shuffled, and a set goes on only if at least l
of its prefix shingles stand in another set of fitting size. l is a twentieth of a set: a passage that many
documents share does not reach it. Documents with equal sets are one node.

Every shared prefix shingle is given to one group, and a node goes to the groups of all its shingles, so any two
similar nodes meet. A shingle's group is named by votes of the nodes that hold it, each for its most common shingle;
so the shingles of a family of near copies mostly have one group, and a node few. In each group the full sets form a
trie, common shingles first; each set walks it once: nodes below a shared path take the path's overlap, and subtrees
whose remaining lengths can't reach the needed overlap are left. Groups of too many shingles are split into chunks,
and each pair of chunks meets. A pair counts in the first group that both nodes have. No join makes rows of pairs:
joins make rows of nodes, and a group returns its nodes with their numbers of links and one edge each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window as W

from . import common as C

#: Counters of the frequency sketch (a fixed 8 MB on the driver and in each Python worker).
SKETCH_BITS, SKETCH_CHUNK = 20, 1 << 12
#: A shingle whose counter is above this many, and twice the mean counter, is taken as shared without looking for another set.
HOT = 1_000
#: Prefixes are longer by this percentage of a set, and as many more shingles must be shared.
EXTRA = 5
#: Shingles that one chunk of a group may hold.
GROUP_SHINGLES = 1_000_000
#: The key of rows whose doc_id is null: after all others.
NO_ID = (1 << 63) - 1


def shingles_of(data, at, k):
    """Shingle hashes of a piece's rows and how many lie before each row."""
    data = C.lower_ascii(data)
    s, e, first = C.spans(~C.SPACE[data], at)
    return C.shingle_hashes(C.span_hashes(data, s, e), first, k)


def sets_in(column, k: int):
    """The sorted shingle set of each text of an Arrow column."""
    data, at = C.utf8(column)
    for _, _, part, cut in C.pieces(data, at):
        h, before = shingles_of(part, cut, k)
        for x, y in zip(before[:-1], before[1:]):
            yield np.unique(h[x:y])


def sets_of(texts: list, k: int) -> list[np.ndarray]:
    return list(sets_in(pa.array(texts, pa.string()), k))


def node_of(u: np.ndarray) -> int:
    """A 64-bit name of a set, the same for equal sets only."""
    sums = np.array([C.mix(u).sum(), C.mix(u ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(), len(u)], np.uint64)
    return int(C.mix((C.mix(sums) * np.array([3, 5, 7], np.uint64)).sum(keepdims=True)).view(np.int64)[0])


def frequency_sketch(docs: DataFrame, text: str, k: int) -> np.ndarray:
    """How many shingles of all documents fall to each counter. Tasks' counters are added up in two rounds, each of few rows a group."""
    bits, width = SKETCH_BITS, SKETCH_CHUNK

    def count(batches):
        from pyspark import TaskContext

        total = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            data, at = C.utf8(batch.column(0))
            for _, _, part, cut in C.pieces(data, at):
                h, _ = shingles_of(part, cut, k)
                total += np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint32)
        rows = total.astype(np.uint64).reshape(-1, width)
        task = np.full(len(rows), TaskContext.get().partitionId(), np.int32)
        yield pa.RecordBatch.from_pydict({"chunk": np.arange(len(rows)), "part": task, "counts": pa.array([r.astype(np.uint32).tobytes() for r in rows], pa.binary())})

    def add(key, table):  # key: chunk, and the part in the first round
        total = np.zeros(width, np.uint64)
        for x in table.column("counts"):
            x = x.as_buffer()
            total += np.frombuffer(x, np.uint32 if len(x) == 4 * width else np.uint64)
        return pa.table({"chunk": [key[0].as_py()], "counts": pa.array([total.tobytes()], pa.binary())})

    parts = docs.select(text).mapInArrow(C.tidied(count), "chunk long, part int, counts binary")
    few = parts.groupBy("chunk", (F.col("part") / 64).cast("int").alias("of")).applyInArrow(add, "chunk long, counts binary")
    out = np.zeros((1 << bits) // width * width, np.uint64).reshape(-1, width)
    for row in few.groupBy("chunk").applyInArrow(add, "chunk long, counts binary").toLocalIterator():
        out[row["chunk"]] = np.frombuffer(row["counts"], np.uint64)
    return out.ravel()


def prefixes(docs: DataFrame, k: int, percent: int, sketch) -> DataFrame:
    """doc_id, n (set size), node (hash of the whole set, null if empty), prefix (its first shingles in the global order),
    cold (how many of them are not hot)."""
    bits = SKETCH_BITS

    def run(batches):
        order = sketch.value
        hot = max(HOT, 2 * float(order.mean()))
        for batch in batches:
            n, node, prefix, cold = [], [], [], []
            for u in sets_in(batch.column(1), k):
                m = len(u)
                n.append(m)
                p = m - (percent * m + 99) // 100 + 1 + m * EXTRA // 100
                rank = order[(u >> np.uint64(64 - bits)).astype(np.int64)]
                chosen = np.lexsort((u, rank))[:p]
                node.append(node_of(u) if m else None)
                prefix.append(u[chosen].view(np.int64) if m else None)
                cold.append(int((rank[chosen] <= hot).sum()))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n": pa.array(n, pa.int64()), "node": pa.array(node, pa.int64()), "prefix": pa.array(prefix, pa.list_(pa.int64())), "cold": pa.array(cold, pa.int32())})

    return docs.select("doc_id", "text").mapInArrow(C.tidied(run), "doc_id long, n long, node long, prefix array<long>, cold int")


class Trie:
    """Sets of token numbers in ascending order as a prefix tree, kept as arrays.

    The sets are sorted; each is stored from where it leaves the path of an earlier one (its parent), so a shared
    path is stored and compared once. Sets of one branching depth lie together and are handled together.
    """

    def __init__(self, sets: list[np.ndarray], vocabulary: int):
        n = len(sets)
        order = sorted(range(n), key=lambda i: sets[i].astype(">u4").tobytes())
        parent, shared, depth, stack = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64), []
        for j in range(n):
            if j:
                a, b = sets[order[j - 1]], sets[order[j]]
                m = min(len(a), len(b))
                differ = np.flatnonzero(a[:m] != b[:m])
                shared[j] = differ[0] if len(differ) else m
                while stack and shared[stack[-1]] >= shared[j]:
                    stack.pop()
                if stack:
                    parent[j], depth[j] = stack[-1], depth[stack[-1]] + 1
            stack.append(j)
        by_level = np.argsort(depth, kind="stable")
        place = np.empty(n, np.int64)
        place[by_level] = np.arange(n)
        self.of = np.array(order, np.int64)[by_level]
        self.parent = np.where(parent[by_level] >= 0, place[parent[by_level]], -1)
        self.shared = shared[by_level]
        self.size = np.array([len(sets[i]) for i in self.of], np.int64)
        own = [sets[i][k:] for i, k in zip(self.of, self.shared)]
        self.start = np.concatenate(([0], np.cumsum([len(x) for x in own]))).astype(np.int64)
        self.tokens = np.concatenate(own)
        self.edge = np.searchsorted(depth[by_level], np.arange(depth.max() + 2))
        # where a set leaves its parent, among the stored tokens
        self.leave = np.where(self.parent >= 0, self.start[self.parent] + self.shared - self.shared[self.parent], 0)
        self.least, self.most = self.size.copy(), self.size.copy()
        for x, y in list(zip(self.edge[:-1], self.edge[1:]))[:0:-1]:
            np.minimum.at(self.least, self.parent[x:y], self.least[x:y])
            np.maximum.at(self.most, self.parent[x:y], self.most[x:y])
        self.mark = np.zeros(vocabulary, bool)
        self.count = np.zeros(len(self.tokens) + 1, np.int64)

    def similar(self, probe: np.ndarray, percent: int) -> np.ndarray:
        """Which sets have 100 * intersection >= percent * union with the probe."""
        self.mark[probe] = True
        n, base, alive = len(probe), np.zeros(len(self.size), np.int64), np.zeros(len(self.size), bool)
        count, overlap = self.count, np.zeros(len(self.size), np.int64)
        for x, y in zip(self.edge[:-1], self.edge[1:]):
            up = self.parent[x:y]
            if x:
                base[x:y] = base[up] + count[self.leave[x:y]] - count[self.start[up]]
            best = base[x:y] + np.minimum(n - base[x:y], self.most[x:y] - self.shared[x:y])
            alive[x:y] = (best * (100 + percent) >= percent * (n + self.least[x:y])) & ((up < 0) | alive[up])
            live = np.flatnonzero(alive[x:y])
            if not len(live):
                break
            lo, hi = self.start[x + live[0]], self.start[x + live[-1] + 1]
            count[lo] = 0
            np.cumsum(self.mark[self.tokens[lo:hi]], out=count[lo + 1 : hi + 1])
            overlap[x + live] = base[x + live] + count[self.start[x + live + 1]] - count[self.start[x + live]]
        self.mark[probe] = False
        out = np.zeros(len(self.size), bool)
        out[self.of] = alive & (100 * overlap >= percent * (n + self.size - overlap))
        return out


def group_links(name: int, nodes: np.ndarray, sets: list, copies: np.ndarray, groups: list, percent: int, chunk: np.ndarray | None = None):
    """(node, other, links) of the nodes of a group, or of two chunks of it, that have links there: how many rows each is
    linked with, and the first node of its tree of links. Pairs that share an earlier group are left to it.
    """
    order = np.lexsort((nodes, [len(x) for x in sets]))
    nodes, copies, sets, groups = nodes[order], copies[order], [sets[i] for i in order], [groups[i] for i in order]
    chunk = chunk[order] if chunk is not None else None
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((values, -np.bincount(flat)))] = np.arange(len(values))
    numbered = [np.sort(rank[x]) for x in np.split(flat, np.cumsum([len(x) for x in sets])[:-1])]
    trie = Trie(numbered, len(values))
    # who else is in the earlier groups of a node
    held: dict[int, list] = {}
    for i, g in enumerate(groups):
        for x in g:
            if x >= name:
                break
            held.setdefault(x, []).append(i)
    held = {x: np.array(v) for x, v in held.items() if len(v) > 1}
    links, root = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
    for i, probe in enumerate(numbered):
        found = trie.similar(probe, percent)
        found[: i + 1] = False
        if chunk is not None:
            found &= chunk != chunk[i]
        for x in groups[i]:
            if x >= name:
                break
            if x in held:
                found[held[x]] = False
        j = np.flatnonzero(found)
        if len(j):
            links[i] += copies[j].sum()
            links[j] += copies[i]
            trees = np.unique(np.append(root[j], root[i]))
            if len(trees) > 1:
                root[np.isin(root, trees)] = trees[0]
    keep = links > 0
    return nodes[keep], nodes[root][keep], links[keep]


def links_of(placed: DataFrame, percent: int) -> DataFrame:
    """node, other, links of every group: `placed` has a row for each node in each pair of chunks of each of its groups."""
    schema = pa.schema([("node", pa.int64()), ("other", pa.int64()), ("links", pa.int64())])

    def one(table):
        whole = {c: table.column(c) for c in table.schema.names}
        node = whole["node"].to_numpy()
        # a row that repeats a doc_id and its text is the same node
        first = np.sort(np.unique(node, return_index=True)[1])
        if len(first) < 2:
            return None
        picked = {c: [x[int(i)] for i in first] for c, x in whole.items() if c in ("shingles", "groups")}
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in picked["shingles"]]
        pair = whole["ca"][0].as_py() != whole["cb"][0].as_py()
        chunk = whole["chunk"].to_numpy()[first] if pair else None
        return group_links(whole["name"][0].as_py(), node[first], sets, whole["copies"].to_numpy()[first], [x.as_py() for x in picked["groups"]], percent, chunk)

    def run(batches):
        held: list = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("name", "ca", "cb")])
            edge = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(0)))
            out = []
            for a, b in zip(edge, np.append(edge[1:], batch.num_rows)):
                key = tuple(keys[:, a])
                if held and key != last:
                    out.append(one(pa.Table.from_batches(held).combine_chunks()))
                    held = []
                last = key
                held.append(batch.slice(a, b - a))
            yield from made(out)
        if held:
            yield from made([one(pa.Table.from_batches(held).combine_chunks())])

    def made(out):
        out = [x for x in out if x is not None and len(x[0])]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out)], schema=schema)

    dealt = placed.repartition("name", "ca", "cb").sortWithinPartitions("name", "ca", "cb")
    return dealt.mapInArrow(C.tidied(run), "node long, other long, links long")


def group_names(shared: DataFrame, rounds: int = 2) -> DataFrame:
    """node, groups (ascending names): any two nodes with a common token have a common name. `shared` has token, node."""
    count = shared.groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    held = C.materialize(shared.join(C.by_shuffle(count), "token").select("token", "node", "c"), "held")
    vote = held.groupBy("node").agg(F.max_by("token", F.struct("c", "token")).alias("name"))
    for i in range(rounds):
        names = held.join(C.by_shuffle(vote), "node").groupBy("token", "name").agg(F.count(F.lit(1)).alias("v")).groupBy("token").agg(F.max_by("name", F.struct("v", "name")).alias("name"))
        if i < rounds - 1:
            vote = held.join(C.by_shuffle(names), "token").groupBy("node", "name").agg(F.count(F.lit(1)).alias("v")).groupBy("node").agg(F.max_by("name", F.struct("v", "name")).alias("name"))
    out = C.materialize(held.join(C.by_shuffle(names), "token").groupBy("node").agg(F.sort_array(F.collect_set("name")).alias("groups")), "groups")
    C.discard(held)
    return out


def classes(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, node) of every row of `docs` (doc_id, text), and (node, rep, copies, low, links) of every node."""
    spark = docs.sparkSession
    sketch = spark.sparkContext.broadcast(frequency_sketch(docs, "text", k))
    members = C.materialize(prefixes(docs, k, percent, sketch), "prefixes")
    nodes = C.materialize(members.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.count(F.lit(1)).alias("copies")), "nodes")
    # one row of each node goes on; 40 bits of a shingle name its bucket, and a bucket holds nodes of compatible sizes side by side
    one = members.join(C.by_shuffle(nodes.select("node", F.col("rep").alias("doc_id"))), ["node", "doc_id"], "left_semi")
    rows = one.select("node", F.col("n").cast("int").alias("n"), "cold", F.posexplode("prefix").alias("pos", "token")).select(F.col("token").bitwiseAND(F.lit((1 << 40) - 1)).alias("token"), "node", "n", (F.col("pos") >= F.col("cold")).alias("hot"))
    # a hot shingle's rows are spread: each stands alone in the window, and is kept
    by_size = W.partitionBy("token", F.when(F.col("hot"), F.col("node"))).orderBy("n")
    near = lambda other: F.col(other).isNotNull() & (100 * F.least("n", other) >= percent * F.greatest("n", other))
    beside = lambda x: x.select("token", "node", "n", "hot", F.lag("n").over(by_size).alias("less"), F.lead("n").over(by_size).alias("more")).filter(near("less") | near("more") | F.col("hot")).drop("less", "more")
    once = C.materialize(beside(rows).dropDuplicates(["token", "node"]), "shared")
    # a partner is smaller by `percent` at most, and shares as many shingles as its own prefix is longer by
    enough = once.groupBy("node", "n").count().filter(f"count >= 1 + (({percent} * n + 99) div 100) * {EXTRA} div 100").select("node")
    shared = C.materialize(beside(once.join(C.by_shuffle(enough), "node")).select("token", "node"), "shared")
    C.discard(once)
    named = group_names(shared)
    C.discard(shared)

    # how many chunks each group has
    mass = named.join(C.by_shuffle(nodes.select("node", "n")), "node").select(F.explode("groups").alias("name"), "n").groupBy("name").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("mass")).filter("c > 1")
    placed = named.select("node", F.explode("groups").alias("name")).join(C.by_shuffle(mass), "name").groupBy("node").agg(F.collect_list(F.struct("name", F.ceil(F.col("mass") / GROUP_SHINGLES).cast("int").alias("chunks"))).alias("in"))
    wanted = C.materialize(placed.join(C.by_shuffle(named), "node").join(C.by_shuffle(nodes), "node").select("node", F.col("rep").alias("doc_id"), "copies", "groups", "in"), "wanted")
    wide = C.fetch_by_id(docs, wanted, "doc_id").select("node", "copies", "groups", "in", "text")

    def as_sets(batches):
        for part in (batch.slice(lo, 1000) for batch in batches for lo in range(0, batch.num_rows, 1000)):
            sets = list(sets_in(part.column(4), k))
            # another text under a repeated doc_id is not this node's
            own = np.array([node_of(u) for u in sets], np.int64) == part.column(0).to_numpy()
            whole = pa.RecordBatch.from_arrays([*part.columns[:4], pa.array([u.tobytes() for u in sets], pa.binary())], names=["node", "copies", "groups", "in", "shingles"])
            yield whole.filter(pa.array(own))

    schema = "node long, copies long, groups array<long>, `in` array<struct<name:long,chunks:int>>, shingles binary"
    spread = wide.mapInArrow(C.tidied(as_sets), schema).select("node", "copies", "groups", "shingles", F.explode("in").alias("g")).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("g.chunks")).cast("int"))
    spread = spread.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("g.chunks") - 1))).selectExpr("node", "copies", "groups", "shingles", "chunk", "g.name as name", "least(chunk, with) as ca", "greatest(chunk, with) as cb")
    found = C.materialize(links_of(spread, percent), "links")

    # components carry the smallest doc_id of their nodes
    roots = C.connected_components(found, "node", "other")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    linked = nodes.select("node", "rep").join(C.by_shuffle(links), "node").join(C.by_shuffle(roots), "node")
    low = linked.groupBy("root").agg(F.min("rep").alias("low"))
    linked = linked.join(C.by_shuffle(low), "root").select("node", "root", "low", "links")
    table = nodes.select("node", "rep", "copies").join(C.by_shuffle(linked), "node", "left").selectExpr("node", "rep", "copies", "coalesce(root, node) as root", "coalesce(low, rep) as low", "coalesce(links, 0) + copies - 1 as links")
    return members.select("doc_id", "n", "node"), table


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text).cast("string").alias("text"))


def ngram_jaccard_join(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, n_links: one row per input row.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased. A row with 1 to k-1 words has its whole
    sequence as one shingle. Rows link when 100 * intersection >= percent * union; component_id is the smallest
    doc_id reachable, n_links the rows linked with (equal sets included). Null or wordless texts have n_shingles 0,
    link with nothing and are their own component. Repeated rows count as copies. Rows whose doc_id is null link like
    others; their component_id is null if it has no doc_id. Other columns are not read. An empty table gives an empty
    result. Shingles are compared by 64-bit hashes.
    """
    members, table = classes(_keyed(docs, doc_id, text), k, percent)
    return members.join(C.by_shuffle(table), "node", "left").selectExpr(f"nullif(doc_id, {NO_ID}) as doc_id", "n as n_shingles", f"nullif(coalesce(low, doc_id), {NO_ID}) as component_id", "coalesce(links, 0) as n_links")


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` that stay: of each component one row, one with its smallest doc_id, with all columns.

    Rows without words all stay. Rows are told apart by doc_id and shingle set, so another text under a doc_id of a
    near copy stays; of rows that repeat both, one stays.
    """
    where = docs.columns.index("text")
    keyed = docs.withColumn("_key", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    with C.tracked() as paths:
        members, table = classes(_keyed(docs, "doc_id", "text"), k, percent)
    first = table.groupBy("root").agg(F.min_by("node", F.struct("rep", "node")).alias("node"))
    kept = C.materialize(table.join(C.by_shuffle(first), "node", "left_semi").select("node", F.col("rep").alias("_key")), "kept")
    # a doc_id that stands once needs no look at its text
    seen = members.groupBy(F.col("doc_id").alias("_key")).agg(F.count(F.lit(1)).alias("times"), F.min("node").alias("node")).filter("node is not null")
    seen = C.materialize(seen.join(C.by_shuffle(kept.withColumn("stays", F.lit(True))), ["node", "_key"], "left").selectExpr("_key", "times", "stays is not null as stays"), "seen")
    C.discard_paths(docs.sparkSession, paths)
    gone, again = seen.filter("times = 1 and not stays").select("_key"), seen.filter("times > 1").select("_key")
    sure = _without(_without(keyed, gone), again).drop("_key")
    if again.isEmpty():
        return sure

    def name(batches):
        for batch in batches:
            node = [node_of(u) if len(u) else None for u in sets_in(batch.column(where).cast(pa.string()), k)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node, pa.int64())], names=[*batch.schema.names, "_node"])

    looked = keyed.join(again, "_key", "left_semi").select(*docs.columns, "_key")
    looked = looked.mapInArrow(C.tidied(name), StructType([*looked.schema.fields, StructField("_node", LongType())]))
    wordless = looked.filter("_node is null")
    ours = looked.join(kept.withColumnRenamed("node", "_node"), ["_node", "_key"], "left_semi").dropDuplicates(["_node", "_key"])
    return sure.unionByName(wordless.select(*docs.columns)).unionByName(ours.select(*docs.columns))


def _without(docs: DataFrame, keys: DataFrame, most: int = 200_000) -> DataFrame:
    """Anti-join on _key; the keys are broadcast only if they count at most `most`."""
    small = keys.limit(most + 1).count() <= most
    return docs.join(F.broadcast(keys) if small else keys, "_key", "left_anti")


def op2_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=90)
