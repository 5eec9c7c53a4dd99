"""Alignment cleaning.

The steps depend on each other in order and on column statistics of the whole gene. Those are summed first, and then
each row is cleaned alone, so that a gene of any depth is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqspark.functions import blosum
from seqspark.operators import intervals

GAP, STOP = ord("-"), ord("*")
INTRON_GAP_SHARE, INTRON_RESIDUES, BRIDGE, INTRON_NT = 0.95, 10, 8, 30
STOP_DEPTH, STOP_BAD, STOP_GOOD, STOP_OCCUPANCY = 40, 0.50, 0.60, 0.30
_AMINO = np.frombuffer(blosum.AMINO.encode(), np.uint8)
_INDEX = np.full(256, 20)
_INDEX[_AMINO] = np.arange(20)


@dataclass
class Options:
    ref_suffix: str = "."
    max_ref_gaps: float = 0.33
    min_ref_gap: int = 10
    anchor_run: int = 12
    tail_max: int = 25
    include_edge: bool = True
    edge_fraction: float = 0.5
    min_length: int = 10


@dataclass
class Culled:
    """What cleaning leaves of a record. Positions of drops, introns and exons count the residues of the original record."""

    seq: str | None = None
    drops: list[int] = field(default_factory=list)
    trim: tuple[int, int] | None = None
    introns: list[tuple[int, int]] = field(default_factory=list)
    exons: list[tuple[int, int]] = field(default_factory=list)


def runs(flags: np.ndarray) -> list[tuple[bool, int, int]]:
    """(value, start, end) of the runs of a boolean array."""
    if not len(flags):
        return []
    cuts = [0, *(np.flatnonzero(np.diff(flags.view(np.int8))) + 1).tolist(), len(flags)]
    return [(bool(flags[a]), a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


def block_start(filled: np.ndarray, ref_data: np.ndarray, o: Options) -> int:
    """Where the first real block begins: one with a long run, or with many residues, before a gap that references support."""
    at = total = best = 0
    second, most = 0, 0
    for full, a, b in [*runs(filled), (False, len(filled), len(filled))]:
        if full:
            total, best = total + b - a, max(best, b - a)
            continue
        last = a == len(filled)
        if not last and ref_data[a:b].sum() < o.min_ref_gap:
            continue
        if total:
            if best >= o.anchor_run or total > o.tail_max:
                return at
            if total > most:
                second, most = at, total
        if not last:
            at, total, best = b, 0, 0
    return second


def tail_end(filled: np.ndarray, ref_data: np.ndarray, start: int, o: Options) -> int:
    """Where a sparse tail begins: from the right, blocks of few residues behind gaps that references support."""
    end, total = len(filled), 0
    for full, a, b in reversed(runs(filled[start:])):
        if full:
            total += b - a
        elif ref_data[start + a : start + b].sum() >= o.min_ref_gap:
            if total > o.tail_max:
                break
            end, total = start + a, 0
    return end


def spliced(nt: str, first: int, count: int) -> bool:
    """Whether a block of residues reads, in some phase, from a donor GT or GC to an acceptor AG over 30 bases or more."""
    a, b = first * 3, (first + count) * 3
    nt = nt.upper()
    return b - a >= INTRON_NT and any(a + p + 1 < len(nt) and b + p <= len(nt) and nt[a + p : a + p + 2] in ("GT", "GC") and nt[b + p - 2 : b + p] == "AG" for p in range(3))


def intron_columns(row: np.ndarray, ref_gap: np.ndarray, nt: str | None, o: Options) -> np.ndarray:
    """The columns of insertions against the references that hold a stop or splice sites."""
    out = np.zeros(len(row), bool)
    full = row != GAP
    blocks: list[list[int]] = []
    for inside, a, b in runs(ref_gap & full):
        if inside:
            if blocks and full[blocks[-1][1] : a].sum() <= BRIDGE:
                blocks[-1][1] = b
            else:
                blocks.append([a, b])
    for a, b in blocks:
        n = int(full[a:b].sum())
        if n < INTRON_RESIDUES or ref_gap[a:b].sum() < o.min_ref_gap:
            continue
        stop = bool((row[a:b] == STOP).any())
        if not stop and not (nt is not None and spliced(nt, int(full[:a].sum()), n)):
            continue
        if (full[a:b] & ref_gap[a:b]).sum() / n >= 0.5:
            out[a:b] = True
    return out


def profile(counts: np.ndarray, n_refs: int) -> tuple[np.ndarray, np.ndarray]:
    """scores[column, residue] and the best of each column, of the references' residues in it; a best of 0 marks a column without a profile."""
    counts = counts.astype(float)
    total = counts.sum(1)
    used = (total > 0) & (total / max(1, n_refs) >= STOP_OCCUPANCY)
    matrix = blosum.matrix()[np.ix_(_AMINO, _AMINO)]
    scores = np.divide(counts @ matrix.T, total[:, None], out=np.zeros_like(counts), where=used[:, None])
    top = np.where(used, scores.max(1), 0)
    return scores, np.where(top > 0, top, 0)


def fragment_score(row: np.ndarray, scores: np.ndarray, top: np.ndarray, a: int, b: int) -> float:
    cols = np.arange(a, b)
    cols = cols[(row[a:b] != GAP) & (row[a:b] != STOP) & (top[a:b] > 0)]
    if not len(cols):
        return 0.0
    which = _INDEX[row[cols]]
    return float(np.where(which < 20, scores[cols, np.minimum(which, 19)], -4.0).sum() / top[cols].sum())


def stop_columns(row: np.ndarray, scores: np.ndarray, top: np.ndarray) -> np.ndarray:
    """The columns from a stop near an end out to that end, where that side fits badly and the other well."""
    out = np.zeros(len(row), bool)
    full = np.flatnonzero(row != GAP)
    if not len(full):
        return out
    a, b = int(full[0]), int(full[-1]) + 1
    residue = (row != GAP) & (row != STOP)
    for s in np.flatnonzero(row == STOP).tolist():
        left, right = int(residue[a:s].sum()), int(residue[s + 1 : b].sum())
        if left > STOP_DEPTH and right > STOP_DEPTH:
            continue
        by_left, by_right = fragment_score(row, scores, top, a, s), fragment_score(row, scores, top, s + 1, b)
        small, large = (by_right, by_left) if right <= left else (by_left, by_right)
        if small < STOP_BAD and large > STOP_GOOD:
            out[slice(s, b) if right <= left else slice(a, s + 1)] = True
    return out


def exon_parts(full: np.ndarray, gone: np.ndarray) -> list[tuple[int, int]]:
    """(first residue, residues) of what inner introns leave between them; residues at the ends that go too are left out."""
    ordinal = np.cumsum(full) - 1
    total = int(full.sum())
    lost = np.zeros(total, bool)
    lost[ordinal[full & gone]] = True
    kept = np.flatnonzero(~lost)
    if not len(kept):
        return []
    inner = []
    for inside, a, b in runs(gone):
        if inside and full[a:b].any():
            s = int(ordinal[a:b][full[a:b]][0])
            e = s + int(full[a:b].sum())
            if s > 0 and e < total:
                inner.append((s, e))
    at, end, out = int(kept[0]), int(kept[-1]) + 1, []
    if not inner:
        return [(at, end - at)]
    for s, e in sorted(inner):
        if s > at:
            out.append((at, s - at))
        at = e
    return [*out, (at, end - at)] if at < end else out


def normal(seq: str) -> str:
    return seq.replace(".", "-").replace(" ", "").upper()


def stacked(rows: list[str], width: int) -> np.ndarray:
    return np.frombuffer("".join(rows).encode("latin-1", "replace"), np.uint8).reshape(len(rows), width)


class Facts:
    """What the rows of a gene must know of all of its rows: counts of the references, and what earlier steps leave in the columns."""

    def __init__(self, width: int, n_refs: int, filled: np.ndarray, counts: np.ndarray, o: Options):
        self.width, self.n_refs, self.filled, self.counts = width, n_refs, filled, counts
        self.edge = np.zeros(width, bool)
        if o.include_edge and n_refs and width:
            good = np.flatnonzero(filled / n_refs >= o.edge_fraction)
            if len(good):
                self.edge[: good[0]] = self.edge[good[-1] + 1 :] = True
        self.ref_data = (1.0 - filled / n_refs) < o.max_ref_gaps if n_refs else np.zeros(width, bool)
        #: columns that some row has a residue in, after the masks and in the end; and whether any row is left
        self.present = (filled > 0) & ~self.edge
        self.last = self.present.copy()
        self.alive = n_refs > 0
        #: columns of which the references do not tell that; without any, the gene needs no look at its other rows
        self.open = ~self.edge & (filled == 0)

    def use(self, present: np.ndarray) -> None:
        """Once present is known: its columns, and the references' gaps and profile in them."""
        self.present = present
        self.place = np.flatnonzero(present)
        self.ref_gap = (self.n_refs - self.filled[self.place]) / self.n_refs >= INTRON_GAP_SHARE if self.n_refs else None
        self.profile = profile(self.counts[self.place], self.n_refs) if self.n_refs and len(self.place) else None


def reference_counts(refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(filled, counts): in each column the references with a symbol, and those with each of the 20 residues."""
    return (refs != GAP).sum(0), np.stack([(refs == a).sum(0) for a in _AMINO], 1)


def masks(table: np.ndarray, ref: np.ndarray, f: Facts, o: Options) -> np.ndarray:
    """The cells that edges, and in candidates odd starts and sparse tails, take."""
    out = np.tile(f.edge, (len(table), 1))
    for i in np.flatnonzero(~ref) if f.n_refs else ():
        mask = out[i]
        data = np.flatnonzero((table[i] != GAP) & ~f.edge)
        a, b = (int(data[0]), int(data[-1]) + 1) if len(data) else (0, 0)
        mask[:a] = mask[b:] = True
        left = block_start((table[i] != GAP) & ~mask, f.ref_data, o)
        right = tail_end((table[i] != GAP) & ~mask, f.ref_data, left, o)
        mask[a:left] = True
        mask[right:] = True
    return out


def cleaned(table: np.ndarray, mask: np.ndarray, ref: np.ndarray, nts: list[str | None] | None, f: Facts, o: Options) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(work, late, alive): rows in the present columns without introns and bad ends at stops, the cells that these took, in
    original columns, and the rows that are left."""
    work = np.where(mask, GAP, table).astype(np.uint8)[:, f.place]
    late = np.zeros(table.shape, bool)
    for i in np.flatnonzero(~ref) if f.n_refs else ():
        cols = intron_columns(work[i], f.ref_gap, nts[i] if nts else None, o)
        work[i, cols] = GAP
        late[i, f.place[cols]] = True
        if f.profile:
            cols = stop_columns(work[i], *f.profile)
            work[i, cols] = GAP
            late[i, f.place[cols]] = True
    alive = ref | ((work != GAP).sum(1) >= o.min_length) if o.min_length > 0 else np.ones(len(table), bool)
    return work, late, alive


def finished(table: np.ndarray, mask: np.ndarray, ref: np.ndarray, nts: list[str | None] | None, f: Facts, o: Options) -> list[Culled]:
    """The records, once the facts are whole."""
    out = [Culled() for _ in table]
    if not f.alive:
        return out
    work, late, alive = cleaned(table, mask, ref, nts, f, o)
    kept_columns = f.last[f.place]
    for i in range(len(table)):
        full = table[i] != GAP
        if alive[i]:
            out[i].seq = work[i, kept_columns].tobytes().decode("latin-1")
        if ref[i]:
            continue
        ordinal = np.cumsum(full) - 1
        removed = mask[i] | late[i] | ~f.last
        if alive[i]:
            out[i].drops = ordinal[full & removed].tolist()
            at_edge = removed & ~late[i]
            kept = np.flatnonzero(full & ~at_edge)
            if len(kept):
                trim = int((full & at_edge)[: kept[0]].sum()), int((full & at_edge)[kept[-1] + 1 :].sum())
                out[i].trim = trim if any(trim) else None
        if late[i].any():
            out[i].introns = [(int(full[:a].sum()), int(full[a:b].sum())) for inside, a, b in runs(late[i]) if inside and full[a:b].any()]
            exons = exon_parts(full, late[i])
            out[i].exons = exons if len(exons) > 1 else []
    return out


def cull_alignment(headers: list[str], seqs: list[str], nts: dict[str, str] | None = None, o: Options | None = None) -> list[Culled]:
    """The records of one gene, cleaned; those that are dropped have no seq."""
    o = o or Options()
    rows = [normal(s) for s in seqs]
    if len({len(r) for r in rows}) > 1:
        raise ValueError("alignment records not the same length")
    if not rows:
        return []
    table = stacked(rows, len(rows[0]))
    ref = np.array([h.endswith(o.ref_suffix) for h in headers])
    own = [nts.get(h) for h in headers] if nts else None
    f = Facts(table.shape[1], int(ref.sum()), *reference_counts(table[ref]), o)
    mask = masks(table, ref, f, o)
    f.use(((table != GAP) & ~mask).any(0))
    work, _, alive = cleaned(table, mask, ref, own, f, o)
    f.alive, f.last = bool(alive.any()), np.zeros(f.width, bool)
    f.last[f.place] = (work[alive] != GAP).any(0)
    return finished(table, mask, ref, own, f, o)


PAIRS = "array<struct<first:int,count:int>>"


#: Kinds of facts in a table (gene, kind, col, n): below 20 a residue of the references, then their symbols, their number (col 0),
#: rows (col 0), rows of a width (col is the width), rows with a residue in an open column after the masks and in the end, rows that are left.
FILLED, REFS, ROWS, WIDTH, PRESENT, LAST, ALIVE = range(20, 27)
FACTS = "array<struct<kind:int,col:int,n:long>>"
#: Rows of a gene for one group of the stream at most (about), cells of a table in memory, and counts that a task holds of several genes.
DEALT_ROWS, SLICE_CELLS, HELD_COUNTS = 20_000, 1 << 20, 1 << 21


def _told(facts: dict[int, tuple[np.ndarray, np.ndarray]], o: Options) -> Facts:
    """The facts of a gene from (cols, n) of each kind."""
    if len(facts[WIDTH][0]) > 1:
        raise ValueError("alignment records not the same length")
    width = int(facts[WIDTH][0][0])

    def per_column(kind: int) -> np.ndarray:
        out = np.zeros(width, np.int64)
        if kind in facts:
            out[facts[kind][0]] = facts[kind][1]
        return out

    f = Facts(width, int(facts[REFS][1][0]) if REFS in facts else 0, per_column(FILLED), np.stack([per_column(k) for k in range(20)], 1), o)
    f.last |= per_column(LAST) > 0
    f.alive |= ALIVE in facts
    f.use(f.present | (per_column(PRESENT) > 0))
    return f


def _counted(rows: DataFrame, kind: str, o: Options) -> DataFrame:
    """The facts that each row tells without the others', summed within a task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held: dict = {}

        def handed(schema: pa.Schema) -> pa.RecordBatch:
            genes, kinds, cols, ns = [], [], [], []
            for (gene, width), (n, n_refs, counts) in held.items():
                at, k = np.nonzero(counts)
                some = [(ROWS, 0, n), (WIDTH, width, n), *([(REFS, 0, n_refs)] if n_refs else []), *zip(k.tolist(), at.tolist(), counts[at, k].tolist(), strict=True)]
                genes += [gene] * len(some)
                for to, values in zip((kinds, cols, ns), zip(*some, strict=True), strict=True):
                    to += values
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(genes, schema.field(0).type), pa.array(kinds, pa.int32()), pa.array(cols, pa.int32()), pa.array(ns, pa.int64())], [schema.names[0], "kind", "col", "n"])

        schema = None
        for batch in batches:
            schema = batch.schema
            where: dict = {}
            refs = []
            for i, (gene, ref, seq) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                refs.append(normal(seq) if ref else None)
                where.setdefault((gene, len(refs[-1] if ref else normal(seq))), []).append(i)
            for key, at in where.items():
                mine = [refs[i] for i in at if refs[i] is not None]
                if key not in held:
                    held[key] = [0, 0, np.zeros((key[1], FILLED + 1), np.int64)]
                to = held[key]
                to[0] += len(at)
                to[1] += len(mine)
                step = max(1, SLICE_CELLS // max(1, key[1]))
                for i in range(0, len(mine), step):
                    filled, counts = reference_counts(stacked(mine[i : i + step], key[1]))
                    to[2][:, :20] += counts
                    to[2][:, FILLED] += filled
                if sum(c.size for _, _, c in held.values()) > HELD_COUNTS if len(held) > 64 else False:
                    yield handed(schema)
        if held:
            yield handed(schema)

    name = rows.columns[0]
    return rows.select(name, F.col("header").endswith(o.ref_suffix).alias("_ref"), "seq").mapInArrow(run, f"`{name}` {kind}, kind int, col int, n long")


def _join_groups(rows: DataFrame, other: DataFrame, group: str, how: str) -> DataFrame:
    """A join by the group, which may be null."""
    met = other.withColumnRenamed(group, "_group")
    return rows.join(met, F.col(group).eqNullSafe(F.col("_group")), how).drop("_group")


def _streamed(rows: DataFrame, facts: DataFrame, work: Callable, schema: str, o: Options) -> DataFrame:
    """work(facts, table, ref, nts, batch rows) over slices of the rows of each gene; a gene with many rows is dealt out.

    The facts of a gene come as one row before its rows, in each of the groups that it is dealt out to.
    """
    group, has_nt = rows.columns[0], "nt" in rows.columns
    per = facts.groupBy(group).agg(F.collect_list(F.struct("kind", "col", "n")).alias("facts"), F.sum(F.when(F.col("kind") == ROWS, F.col("n"))).alias("_n"))
    salts = F.ceil(F.col("_n") / DEALT_ROWS).cast("int")
    heads = per.select(group, F.explode(F.sequence(F.lit(0), salts - 1)).alias("_salt"), "facts")
    # only genes of many rows, so no more than the rows over DEALT_ROWS
    large = facts.where(F.col("kind") == ROWS).groupBy(group).agg(F.sum("n").alias("_n")).where(F.col("_n") > DEALT_ROWS).select(group, salts.alias("_salts"))
    dealt = _join_groups(rows, F.broadcast(large), group, "left").withColumn("_salt", F.pmod(F.xxhash64("ord", "header"), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    both = heads.unionByName(dealt, allowMissingColumns=True).repartition(group, "_salt").sortWithinPartitions(group, "_salt", F.col("facts").isNull(), "ord")
    texts = ["header", "seq", *(["nt"] if has_nt else [])]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        f = None
        for batch in batches:
            heads = np.flatnonzero(batch.column(2).is_valid())
            for a, b in zip([0, *heads.tolist()], [*heads.tolist(), batch.num_rows], strict=True):
                if a in heads:
                    told = batch.column(2)[a].values
                    kinds, cols, ns = (told.field(i).to_numpy() for i in range(3))
                    f = _told({k: (cols[kinds == k], ns[kinds == k]) for k in set(kinds.tolist())}, o)
                    a += 1
                step = max(1, SLICE_CELLS // max(1, f.width)) if f else 1
                for i in range(a, b, step):
                    part = batch.slice(i, min(step, b - i))
                    headers, seqs, *nts = (part.column(part.schema.get_field_index(c)).to_pylist() for c in texts)
                    ref = np.array([h.endswith(o.ref_suffix) for h in headers])
                    yield from work(f, stacked([normal(s) for s in seqs], f.width), ref, nts[0] if nts else None, part)

    return both.select(group, "ord", "facts", *texts).mapInArrow(run, schema)


def cull_columns(records: DataFrame, group: str = "gene", options: Options | None = None) -> DataFrame:
    """records (group, ord, header, seq and maybe nt) cleaned: group, ord, header, seq (null if dropped), drops, left_trim, right_trim, introns, exons.

    A gene's statistics are sums over its rows, so its rows are cleaned in many tasks, a slice at a time. Where the references have a
    symbol in each column that is no edge, they tell all; the candidates of other genes are read twice more for the columns that they fill.
    """
    o = options or Options()
    kind = records.schema[group].dataType.simpleString()
    rows = records.select(group, F.col("ord").cast("long").alias("ord"), "header", "seq", *(["nt"] if "nt" in records.columns else []))
    if "nt" in records.columns:  # of equal headers the last one's bases count for all
        rows = rows.withColumn("nt", F.last("nt").over(W.partitionBy(group, "header").orderBy("ord").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    cells = f"`{group}` {kind}, kind int, col int, n long"
    add = lambda *dfs: reduce(DataFrame.unionByName, dfs).groupBy(group, "kind", "col").agg(F.sum("n").alias("n"))

    def said(part: pa.RecordBatch, *columns: tuple[int, np.ndarray]) -> pa.RecordBatch:
        kinds, cols = (np.concatenate(x) for x in zip(*((np.full(len(c), k, np.int32), c.astype(np.int32)) for k, c in columns), strict=True))
        gene = pa.array([part.column(0)[0].as_py()] * len(cols), part.schema.field(0).type)
        return pa.RecordBatch.from_arrays([gene, pa.array(kinds), pa.array(cols), pa.array(np.ones(len(cols), np.int64))], [group, "kind", "col", "n"])

    def present(f: Facts, table: np.ndarray, ref: np.ndarray, nts: list | None, part: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        yield said(part, (PRESENT, np.flatnonzero(((table != GAP) & ~masks(table, ref, f, o)).any(0) & f.open)))

    def left(f: Facts, table: np.ndarray, ref: np.ndarray, nts: list | None, part: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        work, _, alive = cleaned(table, masks(table, ref, f, o), ref, nts, f, o)
        some = f.place[(work[alive] != GAP).any(0)]
        yield said(part, (LAST, some[f.open[some]]), (ALIVE, np.zeros(int(alive.any()), np.int32)))

    pairs = lambda xs: [{"first": a, "count": b} for a, b in xs]
    out = f"`{group}` {kind}, ord long, header string, seq string, drops array<int>, left_trim int, right_trim int, introns {PAIRS}, exons {PAIRS}"
    pair = pa.list_(pa.struct([("first", pa.int32()), ("count", pa.int32())]))

    def done(f: Facts, table: np.ndarray, ref: np.ndarray, nts: list | None, part: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        found = finished(table, masks(table, ref, f, o), ref, nts, f, o)
        own = [pa.array([c.seq for c in found], pa.string()), pa.array([c.drops for c in found], pa.list_(pa.int32()))]
        trims = [pa.array([c.trim[i] if c.trim else None for c in found], pa.int32()) for i in (0, 1)]
        parts = [pa.array([pairs(getattr(c, n)) for c in found], pair) for n in ("introns", "exons")]
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), *own, *trims, *parts], [group, "ord", "header", "seq", "drops", "left_trim", "right_trim", "introns", "exons"])

    # a few numbers for each column of a gene, read several times; lost blocks are counted again
    facts = add(_counted(rows, kind, o)).persist(StorageLevel.DISK_ONLY)
    if unsure := _unsure(facts, group, o):
        semi = lambda df: _join_groups(df, unsure, group, "left_semi")
        some = semi(rows)
        facts = add(facts, _streamed(some, semi(facts), present, cells, o))
        facts = add(facts, _streamed(some, semi(facts), left, cells, o))
    return _streamed(rows, facts, done, out, o)


def _unsure(facts: DataFrame, group: str, o: Options) -> DataFrame | None:
    """The genes with a column that is no edge and has no reference; None if that is no gene."""
    at = lambda k, v: F.max(F.when(F.col("kind") == k, F.col(v)))
    n = facts.groupBy(group).agg(at(WIDTH, "col").alias("w"), F.coalesce(at(REFS, "n"), F.lit(0)).alias("r"))
    good = facts.where(F.col("kind") == FILLED).join(n, group).groupBy(group, "w").agg(
        F.count(F.lit(1)).alias("filled"), F.min(F.when(F.col("n") / F.col("r") >= o.edge_fraction, F.col("col"))).alias("a"), F.max(F.when(F.col("n") / F.col("r") >= o.edge_fraction, F.col("col"))).alias("b"), F.sort_array(F.collect_list("col")).alias("cols")
    )
    a, b = (F.coalesce("a", F.lit(0)), F.coalesce("b", F.col("w") - 1)) if o.include_edge else (F.lit(0), F.col("w") - 1)
    sure = good.where(F.size(F.filter("cols", lambda c: (c >= a) & (c <= b))) == b - a + 1)
    rest = _join_groups(facts.select(group).distinct(), sure.select(group), group, "left_anti")
    return None if rest.isEmpty() else rest


def _segments(start: Column, end: Column, strand: Column, left: Column, introns: Column) -> Column:
    """The genomic stretches between introns (first residue, residues), from the low coordinate up."""

    @F.pandas_udf("array<struct<start:long,end:long>>")
    def cut(a: pd.Series, b: pd.Series, s: pd.Series, trim: pd.Series, xs: pd.Series) -> pd.Series:
        out = []
        for lo, hi, strand_, t, introns_ in zip(a, b, s, trim, xs, strict=True):
            if introns_ is None:
                out.append([(lo, hi)])
                continue
            # in bases from the 5' end, which on - is the high coordinate
            at, parts = 0, []
            for x in sorted(introns_, key=lambda x: x["first"]):
                first, count = x["first"] - t, x["count"]
                if first < 0:
                    first, count = 0, count + first
                if count > 0:
                    if first * 3 > at:
                        parts.append((at, first * 3 - 1))
                    at = (first + count) * 3
            if at <= hi - lo:
                parts.append((at, hi - lo))
            out.append(sorted((hi - y, hi - x) if strand_ == "-" else (lo + x, lo + y) for x, y in parts))
        return pd.Series([[{"start": int(x), "end": int(y)} for x, y in p if x <= y] for p in out])

    return cut(start, end, strand, left, introns)


def apply_gff_culls(rows: DataFrame, culls: DataFrame, introns: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Annotation rows (see sources.read_gff_rows) after trims, as (ord, part, line), and the names that another row covers.

    culls: gene, name, frame, left, right; null left drops the row. introns: gene, name, frame, introns. Trims are residues of
    three bases from the 5' end and the 3' end; a row that nothing is left of goes; introns cut a row into parts, which are
    named _E1, _E2 ... if they are several. Then rows within others of the same gene, scaffold and strand go.
    """
    key = lambda df, p: (rows["parent"] == df[f"{p}_gene"]) & (rows["name"] == df[f"{p}_name"]) & rows["frame"].eqNullSafe(df[f"{p}_frame"])
    named = lambda df, p, *cols: df.select(F.col("gene").alias(f"{p}_gene"), F.col("name").alias(f"{p}_name"), F.col("frame").alias(f"{p}_frame"), *cols)
    c = named(culls, "c", "left", "right", F.lit(True).alias("culled"))
    met = rows.join(c, key(c, "c"), "left")
    if introns is not None:
        i = named(introns, "i", "introns")
        met = met.join(i, key(i, "i"), "left")
    else:
        met = met.withColumn("introns", F.lit(None).cast(PAIRS))
    data = ~F.col("is_comment") & F.col("name").isNotNull() & F.col("parent").isNotNull()
    plain = met.where(~data).select("ord", F.lit(0).alias("part"), "line", *(F.lit(None).cast(t).alias(n) for n, t in (("gene", "string"), ("scaffold", "string"), ("strand", "string"), ("name", "string"), ("start", "long"), ("end", "long"))))
    left, right = F.coalesce("left", F.lit(0)) * 3, F.coalesce("right", F.lit(0)) * 3
    back = F.col("strand") == "-"
    kept = met.where(data & ~(F.coalesce("culled", F.lit(False)) & F.col("left").isNull()))
    kept = kept.withColumn("a", F.col("start") + F.when(back, right).otherwise(left)).withColumn("b", F.col("end") - F.when(back, left).otherwise(right)).where("a <= b")
    kept = kept.withColumn("parts", _segments(F.col("a"), F.col("b"), F.col("strand"), F.coalesce("left", F.lit(0)), F.col("introns")))
    cut = kept.select("*", F.size("parts").alias("n"), F.posexplode("parts").alias("part", "p"))
    old, new = F.concat(F.lit("Name="), F.col("name")), F.concat(F.lit("Name="), F.col("name"), F.lit("_E"), (F.col("part") + 1).cast("string"))
    attrs = F.when(F.col("n") > 1, F.replace(F.col("fields")[8], old, new)).otherwise(F.col("fields")[8])
    text = F.transform("fields", lambda x, i: F.when(i == 3, F.col("p.start").cast("string")).when(i == 4, F.col("p.end").cast("string")).when(i == 8, attrs).otherwise(x))
    lines = cut.select("ord", "part", F.array_join(text, "\t").alias("line"), F.col("parent").alias("gene"), "scaffold", "strand", F.when(F.col("n") > 1, F.concat("name", F.lit("_E"), (F.col("part") + 1).cast("string"))).otherwise(F.col("name")).alias("name"), F.col("p.start").alias("start"), F.col("p.end").alias("end"))
    marked = intervals.contained(lines, ["gene", "scaffold", "strand"])
    out = marked.where("NOT inside").select("ord", "part", "line").unionByName(plain.select("ord", "part", "line"))
    return out.orderBy("ord", "part"), marked.where("inside").select("name").distinct()
