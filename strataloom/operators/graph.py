"""Link graphs: components, bounded cycles, neighbours, blast radius, broken links and orphans."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.session import saved


LOCAL_EDGES = 1 << 20  # of a graph or component in one task
EDGES_A_PART = 500  # of a component, for each task that lists its cycles
MARKS = 1 << 22  # bits of the table that names are looked up in: 65,536 rows at most


def merged(df: DataFrame) -> DataFrame:
    """df for a join inside a loop: as a small table it would be collected and sent out in every round, all through the driver."""
    return df.hint("merge")


def adjacency(edges: DataFrame) -> DataFrame:
    """Distinct sorted targets of each source; edges (src, dst)."""
    return edges.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("targets"))


def resolve_first(refs: DataFrame, candidates: Column, files: DataFrame) -> DataFrame:
    """Each reference with the first of its ordered candidate paths that is a file; refs has ref_id."""
    each = refs.select("ref_id", F.posexplode(candidates).alias("prio", "path"))
    found = each.join(files.select("path").distinct(), "path").groupBy("ref_id").agg(F.min_by("path", "prio").alias("resolved"))
    return refs.join(found, "ref_id", "left")


def import_candidates(base: Column, extensions: tuple[str, ...] = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".py")) -> Column:
    """base, base with each extension, then an index file in it."""
    return F.array(*(F.concat(base, F.lit(x)) for x in extensions), *(F.concat(base, F.lit("/index" + x)) for x in extensions[1:]))


def broken_links(links: DataFrame, files: DataFrame) -> DataFrame:
    return links.join(files.select(F.col("path").alias("target")).distinct(), "target", "left_anti")


def broken_anchors(links: DataFrame, anchors: DataFrame) -> DataFrame:
    """Links to a known file without the anchor; anchors (target, anchor)."""
    known = links.join(anchors.select("target").distinct(), "target", "left_semi")
    return known.join(anchors.select("target", "anchor").distinct(), ["target", "anchor"], "left_anti")


def orphans(files: DataFrame, links: DataFrame, protected: tuple[str, ...] = ("README.md", "index.md")) -> DataFrame:
    """Files that no other file links to, save protected names."""
    inbound = links.filter("src <> target").select(F.col("target").alias("path")).distinct()
    return files.join(inbound, "path", "left_anti").filter(~F.element_at(F.split("path", "/"), -1).isin(*protected))


def neighbours(edges: DataFrame, node, most: int = 40) -> DataFrame:
    """Outgoing and incoming neighbours, each cut to the first `most` by name."""
    out = edges.filter(F.col("src") == node).select(F.col("dst").alias("node"), F.lit("out").alias("direction")).distinct()
    into = edges.filter(F.col("dst") == node).select(F.col("src").alias("node"), F.lit("in").alias("direction")).distinct()
    both = out.unionByName(into)
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("direction").orderBy("node"))).filter(F.col("rank") <= most)


def blast_radius(imports: DataFrame, references: DataFrame, node) -> DataFrame:
    """Files one hop from a node, with the reasons."""
    a = imports.filter(F.col("dst") == node).select(F.col("src").alias("path"), F.lit("imports").alias("reason"))
    b = references.filter(F.col("dst") == node).select(F.col("src").alias("path"), F.lit("references").alias("reason"))
    return a.unionByName(b).filter(F.col("path") != node).groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


def core(edges: DataFrame) -> DataFrame:
    """Edges between nodes that have both incoming and outgoing ones, after as many rounds as it takes; all cycles are there."""
    e, n = saved(edges.select("src", "dst").distinct()), -1
    while (now := e.count()) != n:
        n = now
        inside = e.join(merged(e.select(F.col("dst").alias("src")).distinct()), "src", "left_semi")
        e = saved(inside.join(merged(inside.select(F.col("src").alias("dst")).distinct()), "dst", "left_semi").select("src", "dst"))
    return e


def grown_cycles(edges: DataFrame, longest: int | None = None) -> DataFrame:
    """cycles() for a component of any size: paths grow edge by edge over all tasks, only through nodes above their start.

    Paths that cannot close are grown too, so `longest` should be given.
    """
    e = core(edges)
    paths = e.filter("src < dst").select(F.array("src", "dst").alias("path"), F.col("dst").alias("at"))
    found = e.filter("src = dst").select(F.array("src").alias("cycle"))
    length = 1
    while longest is None or length < longest:
        step = saved(paths.join(merged(e.select(F.col("src").alias("at"), "dst")), "at").filter(F.col("dst") >= F.element_at("path", 1)))
        found = found.unionByName(step.filter(F.col("dst") == F.element_at("path", 1)).select(F.col("path").alias("cycle")))
        paths = step.filter((F.col("dst") > F.element_at("path", 1)) & ~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at"))
        length += 1
        if paths.isEmpty():
            break
    return found


def cycles_from(start, targets: dict, most: int):
    """Simple cycles of at most `most` edges whose smallest node is `start`, in a component's adjacency.

    A node that was left without a cycle is locked with the length of the path that failed, and is not entered again
    by a path as long; when a later search finds a way from it, it and those that wait for it are let in again. So no
    dead path is grown twice.
    """
    lock: dict = {}
    waits: dict = {}
    path, on_path = [start], {start}
    frames = [[start, iter(targets.get(start, ())), None]]  # node, targets left, edges to the start on the best way found

    def let_in(node, back: int) -> None:
        todo = [(node, back)]
        while todo:
            v, n = todo.pop()
            if lock.get(v, most + 1) < most - n + 1:
                lock[v] = most - n + 1
                todo += [(u, n + 1) for u in waits.get(v, ()) if u not in on_path]

    while frames:
        frame = frames[-1]
        node = frame[0]
        for target in frame[1]:
            if target == start:
                yield list(path)
                frame[2] = 1
            elif target > start and target not in on_path and len(path) < min(most, lock.get(target, most + 1)):
                lock[target] = len(path)
                path.append(target)
                on_path.add(target)
                frames.append([target, iter(targets.get(target, ())), None])
                break
        else:
            frames.pop()
            path.pop()
            on_path.discard(node)
            if frame[2] is None:
                for target in targets.get(node, ()):
                    waits.setdefault(target, set()).add(node)
            else:
                let_in(node, frame[2])
                if frames and (frames[-1][2] is None or frames[-1][2] > frame[2] + 1):
                    frames[-1][2] = frame[2] + 1


def cycles(edges: DataFrame, longest: int | None = None, most_edges: int = LOCAL_EDGES) -> DataFrame:
    """Simple cycles, each once, starting at its smallest node; of any length, or of at most `longest` edges.

    Cycles lie inside strong components. A component goes to several tasks, each with its edges and a part of its
    nodes as starts; one of more than `most_edges` edges is walked by paths that grow over all tasks. In a dense graph the
    number of cycles itself is exponential: there `longest` bounds the listing, and strong_components tells exactly
    who lies on a cycle at all.
    """
    e = saved(edges.select("src", "dst").distinct())
    of = saved(strong_components(e))
    a, b = of.select(F.col("node").alias("src"), "component"), of.select(F.col("node").alias("dst"), F.col("component").alias("other"))
    inside = saved(e.filter("src <> dst").join(merged(a), "src").join(merged(b), "dst").filter("component = other").select("component", "src", "dst"))
    cores = edges.sparkSession.sparkContext.defaultParallelism
    sizes = saved(inside.groupBy("component").agg(F.count("*").alias("n")))
    small = sizes.filter(F.col("n") <= most_edges).withColumn("parts", F.least(F.lit(cores), F.ceil(F.col("n") / EDGES_A_PART)).cast("int"))
    dealt = inside.join(merged(small), "component").select("component", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "parts", "src", "dst")
    kind = e.schema["src"].dataType.simpleString()

    def solve(table: pa.Table) -> pa.Table:
        part, parts = table.column("part")[0].as_py(), table.column("parts")[0].as_py()
        targets: dict = {}
        for x, y in zip(table.column("src").to_pylist(), table.column("dst").to_pylist()):
            targets.setdefault(x, []).append(y)
        nodes = sorted(targets)
        most = len(nodes) if longest is None else min(longest, len(nodes))
        found = [c for s in nodes[part::parts] for c in cycles_from(s, targets, most)]
        return pa.table({"cycle": pa.array(found, pa.list_(table.schema.field("src").type))})

    # by a number of partitions, since few edges can have many cycles: by their size they would all be put into one task
    dealt = dealt.repartition(4 * cores, "component", "part")
    found = dealt.groupBy("component", "part").applyInArrow(solve, f"cycle array<{kind}>")
    loops = e.filter("src = dst").select(F.array("src").alias("cycle"))
    found = found.unionByName(loops)
    large = sizes.filter(F.col("n") > most_edges).select("component")
    if not large.isEmpty():
        found = found.unionByName(grown_cycles(inside.join(large, "component").select("src", "dst"), longest))
    return found


def _spread(values: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, value) after the largest value has gone along all edges until nothing changes."""
    while True:
        sent = merged(values).join(edges, values.node == edges.src).select(F.col("dst").alias("node"), "value")
        grown = saved(values.unionByName(sent).groupBy("node").agg(F.max("value").alias("value")))
        if not grown.join(merged(values.withColumnRenamed("value", "was")), "node").filter("not (value <=> was)").head(1):
            return grown
        values = grown


def connected(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that links (a, b) lead to, in either direction; for nodes with a link.

    Each round takes the least label of the neighbours and then that label's own, so chains shrink by half or better.
    """
    both = saved(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        low = both.join(merged(labels.withColumnRenamed("node", "b")), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("low"))
        new = labels.join(merged(low), "node").select("node", F.col("component").alias("old"), F.least("component", "low").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        new = saved(new.join(merged(jump), "component", "left").select("node", "old", F.least("component", F.coalesce("next", "component")).alias("component")))
        labels = new.select("node", "component")
        if new.filter("old <> component").isEmpty():
            return labels


def components_of(targets: dict) -> dict:
    """node -> the largest node of its strong component, for nodes on cycles; one pass with an explicit stack."""
    order, low, out, stack, on_stack = {}, {}, {}, [], set()
    for root in targets:
        if root in order:
            continue
        frames = [(root, iter(targets[root]))]
        order[root] = low[root] = len(order)
        stack.append(root)
        on_stack.add(root)
        while frames:
            node, rest = frames[-1]
            for x in rest:
                if x not in order:
                    order[x] = low[x] = len(order)
                    stack.append(x)
                    on_stack.add(x)
                    frames.append((x, iter(targets.get(x, ()))))
                    break
                if x in on_stack:
                    low[node] = min(low[node], order[x])
            else:
                frames.pop()
                if frames:
                    low[frames[-1][0]] = min(low[frames[-1][0]], low[node])
                if low[node] == order[node]:
                    own = []
                    while not own or own[-1] != node:
                        own.append(stack.pop())
                        on_stack.discard(own[-1])
                    if len(own) > 1 or node in targets.get(node, ()):
                        out.update(dict.fromkeys(own, max(own)))
    return out


def strong_components(edges: DataFrame, most_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, component) of the nodes that lie on cycles; the component is its largest node.

    A graph of at most `most_edges` edges (16 MB of numbers) is one task's work. A larger one is coloured over all tasks:
    colours go forward from the largest node that reaches each; the nodes that go back to their colour's root inside the
    colour are its component. What is left is trimmed and coloured again, until it is small.
    """
    e, out = saved(edges.select("src", "dst").distinct()), None
    kind = e.schema["src"].dataType.simpleString()

    def solve(table: pa.Table) -> pa.Table:
        targets: dict = {}
        for x, y in zip(table.column("src").to_pylist(), table.column("dst").to_pylist()):
            targets.setdefault(x, []).append(y)
        found = components_of(targets)
        return pa.table({"node": pa.array(list(found), table.schema.field("src").type), "component": pa.array(list(found.values()), table.schema.field("src").type)})

    while e.count() > most_edges:
        e = core(e)
        if e.count() <= most_edges:
            break
        colours = _spread(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().withColumn("value", F.col("node")), e)
        a, b = colours.select(F.col("node").alias("src"), F.col("value").alias("va")), colours.select(F.col("node").alias("dst"), F.col("value").alias("vb"))
        inside = saved(e.join(merged(a), "src").join(merged(b), "dst").filter("va = vb").select("src", "dst"))
        back = inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        reached = _spread(colours.select("node", F.when(F.col("node") == F.col("value"), F.col("value")).alias("value")), back)
        done = saved(reached.filter("value is not null").withColumnRenamed("value", "component"))
        # a root without an edge inside its colour is no cycle
        done = saved(done.join(merged(inside.select(F.col("src").alias("node")).distinct()), "node", "left_semi"))
        out = done if out is None else out.unionByName(done)
        gone = reached.filter("value is not null").select("node")
        e = saved(e.join(merged(gone.withColumnRenamed("node", "src")), "src", "left_anti").join(merged(gone.withColumnRenamed("node", "dst")), "dst", "left_anti"))
    rest = e.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(solve, f"node {kind}, component {kind}")
    return rest if out is None else out.unionByName(rest)


def marked(tokens: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """tokens without most rows whose `name` is not in names, looked up by hash in a table of bits; none that is in them is lost.

    The table has a bound, so it can be broadcast, and only what it lets through is shuffled for the exact join.
    """
    hashed = F.pmod(F.xxhash64(name), F.lit(MARKS))
    bits = names.select(hashed.alias("h")).groupBy(F.shiftright("h", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(h % 64 AS INT))")).alias("bits"))
    rows = tokens.withColumn("h", hashed).alias("t")
    return rows.join(F.broadcast(bits), F.expr("shiftright(t.h, 6) = word AND (shiftright(bits, CAST(t.h % 64 AS INT)) & 1L) = 1L"), "left_semi").drop("h")


def references(tokens: DataFrame, symbols: DataFrame, per_symbol: int = 80) -> DataFrame:
    """Uses of symbols (symbol, path, line of definition) in tokens (token, path, line), without the definition, capped per symbol in order."""
    names = symbols.select(F.col("symbol").alias("token")).distinct()
    uses = marked(tokens, names, "token").join(names, "token")
    uses = uses.join(symbols.select(F.col("symbol").alias("token"), "path", "line"), ["token", "path", "line"], "left_anti").distinct()
    w = Window.partitionBy("token").orderBy("path", "line")
    return uses.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_symbol)


def find_symbol(symbols: DataFrame, name: str) -> DataFrame:
    """Scored search: equal, equal but for case, prefix, part; five more for functions."""
    s, low = F.col("symbol"), name.lower()
    score = F.when(s == name, 100).when(F.lower(s) == low, 70).when(F.lower(s).startswith(low), 20).when(F.lower(s).contains(low), 15)
    return symbols.withColumn("score", score + F.when(F.col("kind") == "function", 5).otherwise(0)).filter("score is not null").orderBy(F.desc("score"), "path", "line")
