"""Near-dedup by bottom-k sketches of one hash function.

A document's set of word shingles is hashed once (64 bits); its sketch is the K smallest values, all of
them where it has no more. Documents with equal sets are one class and go on as their smallest id. Two
sets of Jaccard similarity 0.8 or more share long runs of neighbours in the order of the hashes, so the
inverted lists hold runs of retained values: runs of 4, for sets of up to 15 also of 3, for sets of 4 and
5 also of 2. If no set is larger than K this is exact (a union of U values with at most U/5 that are not
shared has a shared run of at least (U - d)/(d + 1)); for larger ones the chance to miss a pair of
similarity 0.8 is about 0.8**K, 2e-8.

Short lists (up to SHORT members) give all their pairs. In a long list every member is paired with
one hub, the member that stands in most long lists. Once the links found so far are joined to components, the members
of lists that still hold several components are compared anew by prefix filtering, which is exact: their
shingles are put in order, rare ones first, and only the first fifth of a set opens lists. There,
members outside a list's largest component are paired with the members whose places in that order leave
enough in common, a growing number of them a round, until none is left. So a group of thousands of copies costs about a pair for each member, a passage that many
documents hold costs nothing, and no link between different components is lost: there is no cap.
Pairs of the first step pass a bound on sizes, then an estimate from the union's sketch (EASY standard
deviations below the threshold), all then the exact similarity of the full sets. Components come from alternating large and small
stars over written tables.

Defined cases: a null or blank text has no shingles, is linked with nothing and is kept; with fewer
words than a shingle the whole sequence is the one shingle; rows repeated with an id are one document,
linked as any of its texts is; a row with a null id is linked with nothing, has no component and is kept;
texts of any length are read whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._shared import erase, join_by_key, join_dealt, rows_of, small_batches, text_of, written
from ._vector import Words, chunks, mixed

K, SHORT, PERCENT, EASY = 80, 32, 80, 6.0
SLICE = 1000


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = Words(texts)
    n = len(w.begin)
    counts = np.bincount(w.doc, minlength=len(texts))
    weights = [np.uint64(0x9FB21C651E98DF25 + 2 * i * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF | 1) for i in range(width)]
    hashes = np.zeros(0, np.uint64)
    doc = np.zeros(0, np.int64)
    if n >= width:
        at = np.flatnonzero(w.doc[: n - width + 1] == w.doc[width - 1 :])
        h = np.zeros(len(at), np.uint64)
        for i, c in enumerate(weights):
            h += mixed(w.hash[at + i] * c)
        hashes, doc = mixed(h), w.doc[at]
    few = np.flatnonzero((counts > 0) & (counts < width))
    if len(few):
        first = np.cumsum(counts) - counts
        h = [mixed(np.array([sum((int(mixed(w.hash[first[d] + i : first[d] + i + 1] * weights[i])[0]) for i in range(counts[d])), int(counts[d])) & 0xFFFFFFFFFFFFFFFF], np.uint64))[0] for d in few]
        hashes, doc = np.concatenate([hashes, np.array(h, np.uint64)]), np.concatenate([doc, few])
    signed = hashes.view(np.int64)
    order = np.lexsort((signed, doc))
    signed, doc = signed[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (signed[1:] != signed[:-1]) | (doc[1:] != doc[:-1])
    signed, doc = signed[new], doc[new]
    return np.split(signed, np.cumsum(np.bincount(doc, minlength=len(texts)))[:-1])


def _grams(s: np.ndarray) -> np.ndarray:
    """The keys of a sketch: hashes of its runs."""
    n, out = len(s), []
    u = s.view(np.uint64)
    for r, low, high in ((4, 13, None), (3, 5, 15), (2, 4, 5)):
        if n >= low and (high is None or n <= high):
            h = np.full(n - r + 1, r, np.uint64)
            for i in range(r):
                h = mixed(h + u[i : n - r + 1 + i])
            out.append(h.view(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def sketches(docs: DataFrame, width: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n (shingles), print (of the whole set, null if empty) and sketch of every row."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            n, prints, some = [], [], []
            for part in chunks(b.column(1)):
                for s in shingle_sets(part, width):
                    n.append(len(s))
                    prints.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    some.append(s[:K].copy())  # a view would hold the whole chunk
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(some, pa.list_(pa.int64()))], names=["id", "n", "print", "sketch"])

    kind = docs.schema[key].dataType.simpleString()
    return small_batches(docs).select(F.col(key).alias("id"), text_of(text).alias("text")).mapInArrow(run, f"id {kind}, n long, print binary, sketch array<long>")


def _lists(classes: DataFrame) -> DataFrame:
    """(gram, id, n, size) of the lists that have two members at least."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                some = b.slice(at, SLICE)
                keys = [_grams(s) for s in _arrays(some.column(2))]
                which = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *keys])), some.column(0).take(which), some.column(1).take(which)], names=["gram", "id", "n"])

    grams = written(classes.select("id", "n", "sketch").mapInArrow(run, f"gram long, {_kind(classes)}, n long"), "grams")
    heads = written(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "heads", grams)
    lists = written(join_by_key(grams, heads, ["gram"], "size", rows_of(grams), "inner").select("gram", "id", "n", "size"), "lists", grams)
    erase(grams, heads)
    return lists


def _arrays(column) -> list[np.ndarray]:
    """The lists of an Arrow column, without a Python object for each number."""
    values, ends = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.offsets)
    return np.split(values, (ends[1:-1] - ends[0])) if len(column) else []


def _kind(df: DataFrame, c: str = "id") -> str:
    return f"id {df.schema[c].dataType.simpleString()}"


def _sizes_allow(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose similarity, estimated by the K smallest values of the union, may reach the threshold."""
    both = _with_both(pairs, classes.select("id", F.col("sketch").alias("s")))
    low = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, K)
    shared = F.size(F.array_intersect(F.array_intersect("sa", "sb"), low)) / F.size(low)
    p = percent / 100
    # where both sketches are whole sets the estimate is the similarity itself
    slack = F.when((F.size("sa") < K) & (F.size("sb") < K), 1e-9).otherwise(EASY * (p * (1 - p) / K) ** 0.5)
    return both.where(shared >= p - slack).select("a", "b")


def _with_both(pairs: DataFrame, sides: DataFrame) -> DataFrame:
    """pairs (a, b; a written table) with sa and sb, the arrays s of both ids; an end with many pairs is dealt out."""
    a = sides.select(F.col("id").alias("a"), F.col("s").alias("sa"))
    b = sides.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    return join_dealt(join_dealt(pairs, a, ["a"], ["b"]), b, ["b"], ["a"], pairs)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links among the pairs, by the exact similarity of the full sets."""
    shared = F.size(F.array_intersect("sa", "sb"))
    both = _with_both(pairs, sets.select("id", F.col("shingles").alias("s"))).withColumn("shared", shared)
    return both.where(F.col("shared") * 100 >= (F.size("sa") + F.size("sb") - F.col("shared")) * percent).select("a", "b").distinct()


def _full_sets(docs: DataFrame, ids: DataFrame, width: int, key: str, text: str) -> DataFrame:
    """(id, shingles) of these ids, a row for each different text."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for some in chunks(b.column(1), with_rows=True):
                rows, part = some
                yield pa.RecordBatch.from_arrays([b.column(0).slice(rows, len(part)), pa.array(shingle_sets(part, width), pa.list_(pa.int64()))], names=["id", "shingles"])

    rows = docs.select(F.col(key).alias("id"), text_of(text).alias("text"))
    near = rows.join(ids.hint("shuffle_hash"), "id", "left_semi")
    once = near.groupBy("id", F.md5("text").alias("own")).agg(F.first("text").alias("text")).select("id", "text")
    return once.mapInArrow(run, f"{_kind(rows)}, shingles array<long>").where(F.size("shingles") > 0)


def components(links: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(id, component) of every id in the links (a, b), of which of has about as many: the smallest id that it reaches."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges", of)
    mark = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    state = mark(edges)
    while state[0]:
        # large star: neighbours above a node meet its smallest neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("degree")), "least", edges)
        large = join_by_key(both, least, ["u"], "degree", 2 * state[0], "inner").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # small star: a node and its smaller neighbours meet the smallest of them
        down = written(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars", edges)
        below = written(down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree")), "least", down)
        small = join_by_key(down, below, ["u"], "degree", max(1, rows_of(down)), "inner").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(small.unionByName(below.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges", down)
        erase(edges, least, down, below)
        edges, before, state = after, state, mark(after)
        if before == state:
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _pairs_of(short: DataFrame, percent: int) -> DataFrame:
    left = short.select("gram", F.col("id").alias("b"), F.col("n").alias("n_b"))
    right = short.select("gram", F.col("id").alias("a"), F.col("n").alias("n_a"))
    return left.join(right, "gram").where((F.col("b") < F.col("a")) & _sizes_allow(F.col("n_a"), F.col("n_b"), percent)).select("a", "b")


def _placed(lists: DataFrame, comp: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """The entries of lists (or of a part of them) with their components."""
    return written(lists.select("gram", "id", "n", *(c for c in ("at",) if c in lists.columns)).join(comp, "id", "left").withColumn("component", F.coalesce("component", "id")), "placed", lists if hasattr(lists, "written_path") else of)


def _open_lists(placed: DataFrame) -> DataFrame:
    """The entries of lists whose members are of several components, with main (the largest) and outside (members of others)."""
    main = placed.groupBy("gram", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("gram").agg(F.max(F.struct("c", "component")).alias("main"), F.sum("c").alias("size"), F.count(F.lit(1)).alias("parts"))
    several = written(main.where("parts > 1").select("gram", F.col("main.component").alias("main"), "size", (F.col("size") - F.col("main.c")).alias("outside")), "several", placed)
    return join_by_key(placed, several, ["gram"], "size", rows_of(placed), "inner")


def _prefixes(sets: DataFrame, ids: DataFrame, percent: int) -> DataFrame:
    """(gram, id, n, at): the rarest shingles of these sets, of which two linked sets have one in common, and their places.

    All sets are put in one order, rare shingles first; if x and y are linked, the first |x| - ceil(0.8 |x|) + 1
    of x and as many of y (by its own size) share one. Passages that many documents hold come last, so they bring
    together only documents that hold little else.
    """
    some = sets.join(ids, "id", "left_semi")
    some = written(some.select("id", F.xxhash64("shingles").alias("own"), F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("gram")), "shingles")
    often = some.groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    # a shingle of very many of these sets is one row of often, and its rows of some are split by AQE
    ranked = some.join(often.hint("merge"), "gram").groupBy("id", "own", "n").agg(F.sort_array(F.collect_list(F.struct("often", "gram"))).alias("s"))
    length = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")
    out = ranked.select("id", "n", F.posexplode(F.slice("s", 1, length)).alias("at", "x")).where("x.often > 1").select("x.gram", "id", "n", "at")
    out = written(out, "prefixes", some)
    erase(some)
    return out


def _places_allow(n: Column, at: Column, n_h: Column, at_h: Column, percent: int) -> Column:
    """Whether sets that have their first common shingle at these places can be linked: they share no more than what follows in either.

    For a later common shingle this may say no to a pair that is linked, but not at its first.
    """
    return F.least(n - at, n_h - at_h) * (100 + percent) >= (n + n_h) * percent


def _joined(comp: DataFrame, found: DataFrame) -> DataFrame:
    """The components after further links, from the components of the components that these join."""
    end = lambda c: comp.select(F.col("id").alias(c), F.col("component").alias(f"c_{c}"))
    ends = found.join(end("a"), "a", "left").join(end("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    over = written(components(ends, found), "over", found).select(F.col("id").alias("component"), F.col("component").alias("top"))
    # ids that had no link are components of themselves
    alone = over.select(F.col("component").alias("id"), "component").join(comp, "id", "left_anti")
    return comp.unionByName(alone).join(over, "component", "left").select("id", F.coalesce("top", "component").alias("component"))


def _rounds(long: DataFrame, links: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The components, also by the links between members of a long list that its hub could not show."""
    comp = written(components(links, links), "components", links)
    left = written(_open_lists(_placed(long, comp, long)).select("id").distinct(), "open", long)
    if left.isEmpty():
        return comp
    prefixes = _prefixes(sets, left, percent)
    placed = _placed(prefixes, comp)
    erase(prefixes)
    hubs_at_once = 4
    while True:
        members = written(_open_lists(placed).select("gram", "id", "n", "at", "component", "main", "outside", "size"), "members", placed)
        if members.isEmpty():
            return comp
        few = (F.col("outside") <= hubs_at_once) | (F.col("size") <= SHORT)
        # whoever stands in most lists is likely to be what the others were copied from
        weight = members.groupBy("id").agg(F.sum("size").alias("weight"))
        outside = written(members.where("component <> main").join(weight, "id"), "outside", members)
        rank = F.row_number().over(W.partitionBy("gram").orderBy(F.col("weight").desc(), "id"))
        first = outside.where(~few).withColumn("rank", rank).where(F.col("rank") <= hubs_at_once).drop("rank")  # cut in the tasks before the shuffle
        hubs = first.unionByName(outside.where(few)).select("gram", F.col("id").alias("h"), F.col("n").alias("n_h"), F.col("at").alias("at_h"), F.col("component").alias("c_h"))
        hubs = written(hubs, "hubs", outside)
        other = (F.col("h") != F.col("id")) & (F.col("component") != F.col("c_h"))
        pairs = join_dealt(members, hubs, ["gram"], ["id"]).where(other & _places_allow(F.col("n"), F.col("at"), F.col("n_h"), F.col("at_h"), percent))
        pairs = written(pairs.select(F.greatest("h", "id").alias("a"), F.least("h", "id").alias("b")).distinct(), "pairs", members)
        found = written(_verified(pairs, sets, percent), "links", pairs)
        # a hub has met all members of its list; a list whose last outsiders were hubs is done
        rest = members.where(~few).select("gram", "id", "n", "at", "component").join(hubs.select("gram", F.col("h").alias("id")), ["gram", "id"], "left_anti")
        if found.isEmpty():
            after = written(rest, "placed", members)
        else:
            joined = written(_joined(comp, found), "components", comp)
            after = _placed(rest.drop("component"), joined, members)
            erase(comp)
            comp = joined
        erase(placed, members, outside, hubs, pairs, found)
        placed = after
        hubs_at_once *= 8


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = PERCENT) -> DataFrame:
    """One row for each row of docs: key, n_shingles, component_id and kept."""
    rows = written(sketches(docs, width, key, text), "sketches")
    named = rows.where(F.col("print").isNotNull() & F.col("id").isNotNull())
    groups = named.groupBy("print").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.count(F.lit(1)).alias("rows"), F.max("sketch").alias("sketch"))
    classes = written(groups, "classes")
    lists = _lists(classes)
    short = lists.where(F.col("size") <= SHORT)
    long = written(lists.where(F.col("size") > SHORT), "long", lists)
    weight = long.groupBy("id").agg(F.sum("size").alias("weight"))
    best = long.join(weight, "id").groupBy("gram").agg(F.max_by(F.struct(F.col("id").alias("hub"), F.col("n").alias("hub_n")), F.struct("weight", "id")).alias("h"), F.max("size").alias("members"))
    best = written(best.select("gram", "h.*", "members"), "best", long)
    met = join_by_key(long, best, ["gram"], "members", rows_of(long), "inner")
    hubs = met.where((F.col("id") != F.col("hub")) & _sizes_allow(F.col("n"), F.col("hub_n"), percent)).select(F.greatest("id", "hub").alias("a"), F.least("id", "hub").alias("b"))
    pairs = written(_pairs_of(short, percent).unionByName(hubs).distinct(), "pairs")
    near = written(_estimated(pairs, classes, percent), "near", pairs)
    erase(lists, best, pairs)
    ids = near.select(F.col("a").alias("id")).unionByName(near.select(F.col("b").alias("id"))).unionByName(long.select("id")).distinct()
    sets = written(_full_sets(docs, ids, width, key, text), "sets")
    links = written(_verified(near, sets, percent), "links", near)
    comp = _rounds(long, links, sets, percent)
    placed = classes.join(comp, "id", "left").select("print", F.coalesce("component", "id").alias("component_id"), "rows")
    total = classes.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    joined = join_by_key(named.drop("sketch"), placed, ["print"], "rows", total).select("id", "n", "component_id")
    alone = rows.where(F.col("print").isNull() | F.col("id").isNull()).select("id", "n", F.col("id").alias("component_id"))
    out = joined.unionByName(alone)
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
