"""MinHash near-dedup by a signature-coordinate inverted join.

1. A map over the texts gives each document's shingle count, a 128-bit digest of its shingle set and a
   signature of K minima, each as (coordinate, value) in one number. Documents with equal sets collapse to
   the smallest doc_id, so copies cost one row.
2. Each representative is posted under its K coordinate-value pairs. Two sets of Jaccard 0.8 agree in K *
   0.8 coordinates on average; pairs below `matches` agreements are out (for K = 64 and 36 the chance to
   miss a link is under 1 in 100,000). A pair with that many agreements meets in the K - matches + 1
   rarest pairs of each, so only this prefix is posted for joining, rarest first; pairs that one
   document alone has are never shuffled again. Frequent coordinate-values stay outside the prefixes.
3. Documents of one posting list are not paired all with all. A first round links each to the hub of
   its list, the document in the middle; linked documents share a component, and pairs inside a
   component are skipped from then on. The last round joins the documents of lists that still have
   several components, by the prefixes of their full shingle sets with places.
4. A pair is confirmed when 100 * intersection >= 80 * union of the full shingle sets.

Null and empty texts have an empty set and are linked with nothing; a text of fewer words than a shingle is
one shingle; rows that share a doc_id are one node, so what one of its texts is linked with, all are; a null
doc_id has a null component and links nothing. Repeated rows are repeated in the result, with the same values. An
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared as S
from .components import components

SHINGLE, SIMILARITY = 5, 80
COORDINATES, MATCHES = 64, 36
CHUNK = 1 << 20
_RNG = np.random.Generator(np.random.PCG64(7))
FACTORS = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * S.U64(2) + S.U64(1)
SHIFTS = _RNG.integers(1, 2**63, 256, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted by document, and where each document's begin."""
    lower = S.ASCII_LOWER[data]
    starts, ends, first = S.words(lower, offs, S.NOT_SPACE)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    found, doc = S.grams(S.span_hash(S.prefix_hash(lower), starts, ends), first, size)
    order = np.lexsort((found, doc))
    found, doc = found[order], doc[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
    found, doc = found[new], doc[new]
    return found, np.searchsorted(doc, np.arange(len(offs)))


def signatures(size: int, coordinates: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, offs, rows in S.chunks(batches, CHUNK):
            found, first = shingle_sets(data, offs, size)
            n = np.diff(first)
            full = np.flatnonzero(n)
            digest = np.zeros((2, len(n)), np.uint64)
            sig = np.zeros((len(full), coordinates), np.int64)
            if len(full):
                heads = first[:-1][full]
                digest[0, full] = np.add.reduceat(S.mix(found), heads)
                digest[1, full] = np.add.reduceat(S.mix(found * FACTORS[255] + S.U64(1)), heads)
                for i in range(coordinates):
                    least = np.minimum.reduceat(found * FACTORS[i] + SHIFTS[i], heads) >> S.U64(32)
                    sig[:, i] = (least | S.U64(i << 32)).view(np.int64)
            own = np.zeros(len(n) + 1, np.int32)
            own[1:] = np.cumsum(np.where(n > 0, coordinates, 0))
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("v"), pa.array(n), pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)), pa.ListArray.from_arrays(pa.array(own), pa.array(sig.ravel()))],
                names=["doc_id", "v", "n", "h1", "h2", "sig"],
            )

    return run


def full_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, offs, rows in S.chunks(batches, CHUNK):
            found, first = shingle_sets(data, offs, size)
            yield pa.RecordBatch.from_arrays([rows.column("rep"), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(found.view(np.int64)))], names=["rep", "shingles"])

    return run


def prefixes(reps: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """(token, rep, n, weight): each representative under the shared coordinate-values of its prefix.

    weight: how many others share its coordinate-values, all told; the middle of a group of copies has most.
    """
    posted = reps.select("rep", "n", F.explode("sig").alias("token"))
    common = posted.groupBy("token").agg(F.count("*").alias("times")).filter("times > 1")
    shared = posted.join(common, "token").groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("times", "token"))).alias("all"), F.sum("times").alias("weight"))
    alone = F.lit(coordinates) - F.size("all")
    keep = F.lit(coordinates - matches + 1) - alone
    return shared.filter(keep > 0).select("rep", "n", "weight", F.explode(F.slice("all", 1, keep)).alias("x")).select("x.token", "rep", "n", "weight")


def confirmed(pairs: DataFrame, sigs: DataFrame, sets: DataFrame, matches: int, similarity: int) -> DataFrame:
    """Of pairs (a, b) in components (own, other), those with enough agreeing coordinates and then enough in common."""
    side = lambda frame, key, column, alias: frame.select(F.col("rep").alias(key), F.col(column).alias(alias))
    near = pairs.join(side(sigs, "a", "sig", "sa"), "a").join(side(sigs, "b", "sig", "sb"), "b")
    near = near.filter(F.size(F.array_intersect("sa", "sb")) >= matches).drop("sa", "sb")
    near = near.join(side(sets, "a", "shingles", "sa"), "a").join(side(sets, "b", "shingles", "sb"), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return near.filter(100 * both >= similarity * (F.size("sa") + F.size("sb") - both)).select("own", "other")


def mixed(lists: DataFrame) -> DataFrame:
    """Lists with more than one component."""
    tokens = lists.groupBy("token").agg(F.min("own").alias("x"), F.max("own").alias("y")).filter("x <> y").select("token")
    return lists.join(tokens, "token")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (rep, own) after links (own, other) between components."""
    comp = components(links.select(F.col("own").alias("a"), F.col("other").alias("b")))
    return S.materialise(labels.join(comp, labels.own == comp.node, "left").select("rep", F.coalesce("component", "own").alias("own")))


def link(lists: DataFrame, sigs: DataFrame, sets: DataFrame, matches: int, similarity: int, hubs: int) -> DataFrame:
    """(rep, own): the component of every representative in a list."""
    labels = sigs.select("rep", F.col("rep").alias("own"))
    for turn in range(hubs):
        # a hub of each list: the one in the middle first, then by varying order
        first = F.col("weight") if turn == 0 else F.xxhash64("rep", F.lit(turn))
        now = lists.join(labels, "rep")
        hub = now.groupBy("token").agg(F.max(F.struct(first.alias("first"), "rep", "n", "own")).alias("hub")).select("token", F.col("hub.rep").alias("b"), F.col("hub.n").alias("nb"), F.col("hub.own").alias("other"))
        fits = 100 * F.least("n", "nb") >= similarity * F.greatest("n", "nb")
        pairs = now.join(hub, "token").filter((F.col("own") != F.col("other")) & fits).select(F.col("rep").alias("a"), "b", "own", "other").distinct()
        labels = merged(labels, S.materialise(confirmed(S.materialise(pairs), sigs, sets, matches, similarity)))
    # What is left: documents of lists with several components, joined by the rarest shingles of their full
    # sets. If the first shingle that two documents share, in the order of frequency, has place i in one, the
    # i - 1 before it are not shared; so both places must leave enough shingles for the similarity.
    left = S.materialise(mixed(lists.drop("weight").join(labels, "rep")).select("rep", "n", "own").distinct())
    shingles = sets.join(left.select("rep"), "rep", "left_semi").select("rep", F.explode("shingles").alias("shingle"))
    times = shingles.groupBy("shingle").agg(F.count("*").alias("times"))
    ordered = shingles.join(times, "shingle").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("times", "shingle"))).alias("all")).join(left, "rep")
    keep = F.col("n") - F.ceil(F.col("n") * similarity / 100) + 1
    rare = ordered.select("rep", "n", "own", F.posexplode(F.slice("all", F.lit(1), keep.cast("int"))).alias("i", "x")).filter("x.times > 1")
    rare = S.materialise(rare.select("x.shingle", "rep", "n", "own", (F.col("n") - F.col("i")).alias("rest")))
    right = rare.select("shingle", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("rest").alias("rest_b"), F.col("own").alias("other"))
    enough = (100 + similarity) * F.least("rest", "rest_b") >= similarity * (F.col("n") + F.col("nb"))
    pairs = rare.join(right, "shingle").filter((F.col("own") < F.col("other")) & enough).select(F.col("rep").alias("a"), "b", "own", "other").distinct()
    return merged(labels, S.materialise(confirmed(S.materialise(pairs), sigs, sets, matches, similarity)))


def same_document(base: DataFrame, groups: DataFrame) -> DataFrame:
    """(own, other): links between groups that hold texts of one doc_id; own is the least."""
    kind = F.struct("h1", "h2", "n")
    several = base.groupBy("doc_id").agg(F.min(kind).alias("x"), F.max(kind).alias("y")).filter("x <> y").select("doc_id")
    member = base.join(several, "doc_id").join(groups.select("h1", "h2", "n", "rep"), ["h1", "h2", "n"]).select("doc_id", "rep").distinct()
    member = S.materialise(member)
    least = member.groupBy("doc_id").agg(F.min("rep").alias("own"))
    return member.join(least, "doc_id").filter("rep <> own").select("own", F.col("rep").alias("other"))


def near_dedup(docs: DataFrame, shingle: int = SHINGLE, similarity: int = SIMILARITY, coordinates: int = COORDINATES, matches: int = MATCHES, hubs: int = 1) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each document."""
    rows = S.plain(docs).withColumn("v", F.xxhash64("text"))
    base = S.materialise(rows.mapInArrow(signatures(shingle, coordinates), "doc_id long, v long, n long, h1 long, h2 long, sig array<long>"))
    full = base.filter("n > 0 and doc_id is not null")
    # a group of equal sets has a number of its own: a doc_id can be the smallest of several groups
    one = F.struct("doc_id", "v")
    groups = full.groupBy("h1", "h2", "n").agg(F.min(one).alias("one"), F.min_by("sig", one).alias("sig"))
    groups = S.materialise(groups.withColumn("rep", F.monotonically_increasing_id()))
    lists = S.materialise(prefixes(groups, coordinates, matches))
    ids = S.materialise(lists.select("rep").distinct())
    sigs = S.materialise(groups.join(ids, "rep", "left_semi").select("rep", "sig", "one"))
    sets = rows.join(sigs.select("rep", "one.*"), ["doc_id", "v"]).mapInArrow(full_sets(shingle), "rep long, shingles array<long>")
    sets = S.materialise(sets.groupBy("rep").agg(F.first("shingles").alias("shingles")))  # repeated rows give a set twice
    comp = link(lists, sigs, sets, matches, similarity, hubs)
    labels = S.materialise(groups.select("rep", "one").join(comp, "rep", "left").select("rep", F.coalesce("own", "rep").alias("own"), F.col("one.doc_id").alias("least")))
    shared = same_document(full.drop("sig"), groups)
    own = labels.select("rep", F.col("own").alias("label"))
    shared = S.materialise(shared.join(own, shared.own == own.rep).select(F.col("label").alias("own"), "other"))
    shared = S.materialise(shared.join(own, shared.other == own.rep).select("own", F.col("label").alias("other")).filter("own <> other"))
    if not shared.isEmpty():
        labels = merged(labels.select("rep", "own"), shared).join(labels.select("rep", "least"), "rep")
    smallest = labels.groupBy("own").agg(F.min("least").alias("component"))
    final = groups.select("h1", "h2", "n", "rep").join(labels.select("rep", "own"), "rep").join(smallest, "own").select("h1", "h2", "n", "component")
    out = base.drop("sig", "v").join(final, ["h1", "h2", "n"], "left")
    smallest = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component")), F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), smallest.alias("component_id"), F.col("doc_id").eqNullSafe(smallest).alias("kept"))


def brute_force(docs: list[tuple], shingle: int = SHINGLE, similarity: int = SIMILARITY) -> list[tuple]:
    """The contract in plain Python, for tests."""
    import re

    def own(text: str | None) -> set:
        w = re.findall("[^\\x20\\x09-\\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set()

    sets = [own(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and (docs[i][0] == docs[j][0] or 100 * len(a & sets[j]) >= similarity * len(a | sets[j])):
                parent[root(i)] = root(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(s), least[root(i)], d == least[root(i)]) for i, ((d, _), s) in enumerate(zip(docs, sets))]
