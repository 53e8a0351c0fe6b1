"""Problem 2: parent-child links to full hierarchies.

Method: connected components are found, each is brought to one place, and an iterative depth-first traversal with node
colours gives paths, descendants and the cycles that back edges close.

Links are first contracted inside their document (bounded chunks of its rows), so that only links between documents take
part in the distributed component search. Components above ``max_component`` nodes are never brought to one task:
pointer doubling gives the same columns for them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.operators.graph import connected_components
from lexweave.session import materialize

#: Rows contracted at once, nodes that a component may have to be traversed in one task, and path cells of a batch of rows.
CHUNK_ROWS, MAX_COMPONENT, BATCH_CELLS = 200_000, 500_000, 500_000
TREE = "node_id string, parent_id string, root_id string, depth int, path array<string>, n_descendants bigint, fault string"


def links(nodes: DataFrame, node: str = "node_id", parent: str = "parent_id", document: str | None = "source_file") -> DataFrame:
    """(id, parent, doc, orphan), one row per trimmed node id. Null and blank ids are no nodes; a null or blank parent
    makes a root. Of repeated rows the smallest parent stands, a root only if all are. ``orphan``: no row has the parent."""
    trim = lambda c: F.nullif(F.regexp_replace(F.col(c), r"^\s+|\s+$", ""), F.lit(""))
    doc = F.col(document) if document and document in nodes.columns else F.lit(None).cast("string")
    one = nodes.select(trim(node).alias("id"), trim(parent).alias("parent"), doc.alias("doc")).where("id is not null")
    one = materialize(one.groupBy("id").agg(F.min("parent").alias("parent"), F.min("doc").alias("doc")))
    there = one.select(F.col("id").alias("parent"), F.lit(False).alias("orphan"))
    return one.join(there, "parent", "left").select("id", "parent", "doc", (F.col("parent").isNotNull() & F.col("orphan").isNull()).alias("orphan"))


def _contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over chunks of rows: (id, parent, orphan, head), head the chunk's smallest id tied to the row."""

    def flush(ids: list, parents: list, orphans: list) -> pa.RecordBatch:
        up: dict[str, str] = {i: i for i in ids}

        def top(x: str) -> str:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for i, p in zip(ids, parents):
            if p is not None and p in up:
                a, b = top(i), top(p)
                if a != b:
                    up[max(a, b)] = min(a, b)
        return pa.record_batch([pa.array(ids, pa.string()), pa.array(parents, pa.string()), pa.array(orphans, pa.bool_()), pa.array([top(i) for i in ids], pa.string())], names=["id", "parent", "orphan", "head"])

    ids, parents, orphans = [], [], []
    for b in batches:
        ids += b.column(0).to_pylist()
        parents += b.column(1).to_pylist()
        orphans += b.column(2).to_pylist()
        if len(ids) >= CHUNK_ROWS:
            yield flush(ids, parents, orphans)
            ids, parents, orphans = [], [], []
    if ids:
        yield flush(ids, parents, orphans)


def traverse(ids: list[str], parents: list[str | None], orphans: list[bool], paths: bool = True) -> Iterator[tuple]:
    """Rows of :data:`TREE` of one component, one after another: only the path of the node in hand exists, so a task holds
    numbers for its nodes and never a path for each. Without ``paths`` that column is null."""
    at = {i: k for k, i in enumerate(ids)}
    up = [at.get(p, -1) if p is not None and not o else -1 for p, o in zip(parents, orphans)]
    down: list[list[int]] = [[] for _ in ids]
    for k, p in enumerate(up):
        if p >= 0:
            down[p].append(k)
    white, grey, black = 0, 1, 2
    colour = [white] * len(ids)
    fault: list[str | None] = [None] * len(ids)
    count = [0] * len(ids)
    for start in (k for k, p in enumerate(up) if p < 0):
        order, depths, stack = [], [], [(start, 0)]
        while stack:
            k, depth = stack.pop()
            colour[k] = black
            order.append(k)
            depths.append(depth)
            stack += [(c, depth + 1) for c in down[k]]
        for k in reversed(order):
            if k != start:
                count[up[k]] += count[k] + 1
        if orphans[start]:
            for k in order:
                fault[k] = "lost"
                yield ids[k], parents[k], None, None, None, count[k], "lost"
            continue
        # In this order a node's ancestors are what is left of the path when it is cut to the node's depth.
        above: list[str] = []
        for k, depth in zip(order, depths):
            if paths:
                del above[depth:]
                above.append(ids[k])
            yield ids[k], parents[k], ids[start], depth, list(above) if paths else None, count[k], None
    # What no root reaches runs in circles: follow the links until a grey node closes a cycle.
    for start in range(len(ids)):
        walk, k = [], start
        while colour[k] == white:
            colour[k] = grey
            walk.append(k)
            k = up[k]
        if colour[k] == grey:
            cut = walk.index(k)
            for j in walk[cut:]:
                fault[j] = "on_cycle"
            walk, rest = walk[:cut], walk[cut:]
            for j in rest:
                colour[j] = black
        for j in walk:
            fault[j] = "under_cycle"
            colour[j] = black
    for i, p, f in zip(ids, parents, fault):
        if f in ("on_cycle", "under_cycle"):
            yield i, p, None, None, None, None, f


def _trees(batches: Iterable[pa.RecordBatch], paths: bool = True) -> Iterator[pa.RecordBatch]:
    """Rows sorted by component, traversed one component at a time."""
    names = ["node_id", "parent_id", "root_id", "depth", "path", "n_descendants", "fault"]
    types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.int64(), pa.string()]

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def components() -> Iterator[tuple[list, list, list]]:
        now, held = None, ([], [], [])
        for b in batches:
            for comp, i, p, o in zip(*(c.to_pylist() for c in b.columns)):
                if comp != now:
                    if held[0]:
                        yield held
                    now, held = comp, ([], [], [])
                held[0].append(i)
                held[1].append(p)
                held[2].append(o)
        if held[0]:
            yield held

    out, cells = [], 0
    for held in components():
        for row in traverse(*held, paths):
            out.append(row)
            cells += 8 + len(row[4] or ())
            if cells >= BATCH_CELLS:
                yield pack(out)
                out, cells = [], 0
    if out:
        yield pack(out)


def _doubling(rows: DataFrame) -> DataFrame:
    """The columns of :data:`TREE` for components too large for one task, by pointer doubling: a node's pointer is joined
    to its target's pointer, which doubles the distance; log2(depth) rounds."""
    n = rows.count()
    state = materialize(rows.select("id", "parent", "orphan", F.when(F.col("orphan") | F.col("parent").isNull(), F.col("id")).otherwise(F.col("parent")).alias("to"), F.when(F.col("orphan") | F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("dist"), (F.col("orphan") | F.col("parent").isNull()).alias("end"), F.coalesce("orphan", F.lit(False)).alias("lost")))
    steps = 1
    while steps < 2 * n and not state.where("not end").isEmpty():
        nxt = state.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("dist").alias("d2"), F.col("end").alias("e2"), F.col("lost").alias("l2"))
        state = materialize(
            state.join(nxt, "to").select("id", "parent", "orphan", F.col("to2").alias("to"), (F.col("dist") + F.when(F.col("end"), 0).otherwise(F.col("d2"))).alias("dist"), (F.col("end") | F.col("e2")).alias("end"), F.when(F.col("end"), F.col("lost")).otherwise(F.col("l2")).alias("lost"))
        )
        steps *= 2
    ring = state.where("not end").select(F.col("to").alias("id"), F.lit(True).alias("ring")).distinct()
    state = materialize(state.join(ring, "id", "left"))
    fault = F.when(F.col("ring"), "on_cycle").when(~F.col("end"), "under_cycle").when(F.col("lost"), "lost")
    state = state.withColumn("fault", fault)
    # Chains of the sound and lost nodes by doubling: from the node up to, and without, its pointer. A lost chain ends at an orphan.
    last = F.col("parent").isNull() | F.coalesce("orphan", F.lit(False))
    p = materialize(state.where("fault is null or fault = 'lost'").select("id", "parent", F.when(F.col("fault").isNull(), F.col("to")).alias("root_id"), F.when(last, F.col("id")).otherwise(F.col("parent")).alias("ptr"), F.array("id").alias("up"), last.alias("end")))
    while not p.where("not end").isEmpty():
        q = p.select(F.col("id").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("up").alias("up2"), F.col("end").alias("end2"))
        p = materialize(p.join(q, "ptr").select("id", "parent", "root_id", F.when(F.col("end"), F.col("ptr")).otherwise(F.col("ptr2")).alias("ptr"), F.when(F.col("end"), F.col("up")).otherwise(F.concat("up", "up2")).alias("up"), (F.col("end") | F.col("end2")).alias("end")))
    path = p.where("root_id is not null").select("id", "root_id", F.reverse("up").alias("path"))
    below = p.select(F.explode(F.slice("up", F.lit(2), F.size("up"))).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    out = state.select("id", "parent", "fault").join(path, "id", "left").join(below, "id", "left")
    return out.select(F.col("id").alias("node_id"), F.col("parent").alias("parent_id"), "root_id", (F.size("path") - 1).alias("depth"), "path", F.when(F.col("fault").isNull() | (F.col("fault") == "lost"), F.coalesce("n", F.lit(0))).alias("n_descendants"), "fault").withColumn("depth", F.when(F.col("fault").isNull(), F.col("depth")).cast("int"))


def hierarchy(nodes: DataFrame, node: str = "node_id", parent: str = "parent_id", document: str | None = "source_file", max_component: int = MAX_COMPONENT, paths: bool = True) -> DataFrame:
    """Every node with its parent, root, depth (0 for a root), path from the root, number of descendants and fault. Where no
    one asks for paths, ``paths=False`` leaves them null and spares their cells (the sum of all depths).

    fault is null for a node under a root, ``on_cycle`` if its links return to it, ``under_cycle`` if they enter a cycle
    that it is not on, ``lost`` if they end at an id that no row has; a faulty node has no root, depth or path. Columns
    of :data:`TREE`. An empty table gives none.
    """
    base = links(nodes, node, parent, document)
    # By ranges of (document, id): a document's rows lie together, and one with a third of all rows spreads over many tasks.
    near = base.repartitionByRange("doc", "id").sortWithinPartitions("doc", "id")
    local = materialize(near.select("id", "parent", "orphan").mapInArrow(_contract, "id string, parent string, orphan boolean, head string"))
    heads = local.select(F.col("id").alias("parent"), F.col("head").alias("phead"))
    across = local.where("parent is not null and not orphan").select("parent", "head").join(heads, "parent").where("head <> phead").select("head", "phead").distinct()
    comp = materialize(connected_components(across, "head", "phead"))
    tied = local.join(comp.select(F.col("node").alias("head"), "component"), "head", "left").select("id", "parent", "orphan", F.coalesce("component", "head").alias("component"))
    sizes = tied.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > max_component).select("component")
    big = materialize(sizes)
    small = tied if big.isEmpty() else tied.join(big, "component", "left_anti")
    trees = small.select("component", "id", "parent", "orphan").repartition("component").sortWithinPartitions("component", "id").mapInArrow(lambda it: _trees(it, paths), TREE)
    if not big.isEmpty():
        rest = _doubling(materialize(tied.join(big, "component").select("id", "parent", "orphan")))
        trees = trees.unionByName(rest if paths else rest.withColumn("path", F.lit(None).cast("array<string>")))
    return trees


def cycles(trees: DataFrame) -> DataFrame:
    """(cycle_id, node_id, position, next_id, closes): the circles that links run in. cycle_id is a circle's smallest node;
    position counts from it along the links, next_id is the parent, and ``closes`` marks the back edge, the link that leads
    from the last position to the first. Pointer doubling on the circles' own nodes."""
    ring = trees.where("fault = 'on_cycle'").select(F.col("node_id").alias("id"), F.col("parent_id").alias("next"))
    ring = materialize(ring)
    of = connected_components(ring, "id", "next").select(F.col("node").alias("id"), F.col("component").alias("cycle_id"))
    base = ring.join(of, "id")
    lengths = base.groupBy("cycle_id").agg(F.count("*").alias("n"))
    base = materialize(base.join(lengths, "cycle_id"))
    # The distance to the smallest node along the links; that node's own is 0.
    state = materialize(base.select("id", F.when(F.col("id") == F.col("cycle_id"), F.lit(None)).otherwise(F.col("next")).alias("ptr"), F.when(F.col("id") == F.col("cycle_id"), 0).otherwise(1).cast("long").alias("d")))
    while not state.where("ptr is not null").isEmpty():
        q = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("d").alias("d2"))
        state = materialize(state.join(q, "ptr", "left").select("id", F.col("ptr2").alias("ptr"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d")))
    out = base.join(state.select("id", "d"), "id").withColumn("position", F.when(F.col("d") == 0, 0).otherwise(F.col("n") - F.col("d")).cast("bigint"))
    return out.select("cycle_id", F.col("id").alias("node_id"), "position", F.col("next").alias("next_id"), (F.col("position") == F.col("n") - 1).alias("closes"))


def _chains(faulty: DataFrame) -> DataFrame:
    """(id, up) of nodes without a root: the node and the ancestors that its links reach, nearest first, each once, so a
    chain ends before a missing id and goes once round a cycle. By doubling; a chain that meets itself is whole."""
    p = materialize(faulty.select(F.col("node_id").alias("id"), F.col("parent_id").alias("ptr"), F.array("node_id").alias("up"), F.lit(False).alias("end")))
    while not p.where("not end").isEmpty():
        q = p.select(F.col("id").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("up").alias("up2"), F.col("end").alias("end2"))
        both = F.array_distinct(F.concat("up", "up2"))
        met = F.size(both) < F.size("up") + F.size("up2")
        live = p.where("not end").join(q, "ptr", "left").select("id", F.col("ptr2").alias("ptr"), F.coalesce(both, F.col("up")).alias("up"), F.coalesce(F.col("end2") | met, F.lit(True)).alias("end"))
        p = materialize(p.where("end").select("id", "ptr", "up", "end").unionByName(live))
    return p.select("id", "up")


def descendants(trees: DataFrame) -> DataFrame:
    """(node_id, descendant_id, distance) of every node and each node below it, as rows: no list of descendants need fit
    into a cell. Nodes without a root have theirs too: under a missing parent, below a cycle and round it, each node once at
    its least distance and none below itself."""
    at = trees.where("path is not null").select(F.posexplode("path").alias("pos", "node_id"), F.col("node_id").alias("descendant_id"), "depth")
    sound = at.where("pos < depth").select("node_id", "descendant_id", (F.col("depth") - F.col("pos")).alias("distance"))
    up = _chains(trees.where("fault is not null")).select(F.posexplode("up").alias("distance", "node_id"), F.col("id").alias("descendant_id"))
    return sound.unionByName(up.where("distance > 0").select("node_id", "descendant_id", "distance"))
