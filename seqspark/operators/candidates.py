"""Post-processing of recovered candidates of one gene: who duplicates whom, who is a module, who replaces a native.

The decisions are greedy in score order, so a gene is read by one task, row by row; within it all
functions are plain and take rows in a fixed order (cluster key, then input order), never that of a hash map.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.functions import blosum
from seqspark.operators import intervals

MAX_CLAIMED = 8
MODULE_SIZE, MODULE_SMALLER, MODULE_LARGER, MODULE_BASES, MODULE_SPAN, MODULE_SCORE = 0.75, 0.80, 0.75, 30, 0.5, 0.85
SPLIT_SIZE, SPLIT_BASES, SPLIT_OVERLAP, SPLIT_LEAST = 0.75, 15, 0.80, 15
CROSS_SHARE, NATIVE_SHARE = 0.5, 0.80
SLOT_SHORT, SLOT_LONG, SLOT_IDENTITY = 0.8, 1.2, 0.25


@dataclass(frozen=True)
class Slot:
    """The place of a candidate that fills an isoform's slot: its node and the flanks around it."""

    node: str
    left: str
    right: str


@dataclass(frozen=True)
class Candidate:
    tag: str
    scaffold: str
    strand: str
    start: int
    end: int
    cols: frozenset[int]
    aa: str = ""
    full: float = 0.0
    covered: float = 0.0
    cluster: str = ""
    slot: Slot | None = None
    partner: str | None = None
    residues: int = field(default=-1)

    @property
    def size(self) -> int:
        return len(self.cols) if self.residues < 0 else self.residues

    @property
    def region(self) -> str:
        return f"{self.scaffold}:{self.start}-{self.end}({self.strand})"

    def same_locus(self, other: Candidate) -> bool:
        return (self.scaffold, self.strand) == (other.scaffold, other.strand)

    def common_bases(self, other: Candidate) -> int:
        return max(0, min(self.end, other.end) - max(self.start, other.start) + 1)

    def trimmed(self, left: int, right: int) -> Candidate:
        """Without so many residues at either end; left is the 5' end."""
        low, high = (right, left) if self.strand == "-" else (left, right)
        return replace(self, start=self.start + 3 * low, end=max(0, self.end - 3 * high)) if left or right else self


def residues_of(seq: str) -> int:
    return sum(c not in "-." for c in seq)


def classify(new: Candidate, old: Candidate) -> str:
    """How a candidate stands to an accepted one: duplicate, module, mono_break, genomic or independent."""
    shared = len(new.cols & old.cols)
    near = new.same_locus(old)
    touch = near and new.common_bases(old) > 0
    small, large = sorted((new.size, old.size))
    if shared > MAX_CLAIMED:
        module = (
            near
            and not touch
            and large > 0
            and small >= MODULE_SIZE * large
            and shared >= MODULE_SMALLER * small
            and shared >= MODULE_LARGER * large
            and abs(new.start - old.start) >= MODULE_BASES
            and (old.covered <= 0 or new.covered >= MODULE_SCORE * old.covered)
        )
        return "module" if module else "duplicate"
    if not near:
        return "independent"
    edges = [(min(c.cols, default=0), max(c.cols, default=0)) for c in (new, old)]
    (a, b), (x, y) = edges
    stacked = max(0, min(b, y) - max(a, x) + 1) / min(b - a + 1, y - x + 1) >= MODULE_SPAN
    if new.slot is None and not stacked:
        # along the strand, later on the genome must be later in the alignment
        genome = (new.start > old.start) - (new.start < old.start)
        columns = (a > x) - (a < x)
        if genome * columns * (1 if new.strand == "+" else -1) < 0:
            return "mono_break"
    return "genomic" if touch else "independent"


def dedup_group(group: Iterable[Candidate], module_type: Callable[[Candidate], str] = lambda c: "", scope: str = "") -> tuple[list[Candidate], list[str]]:
    """The accepted candidates, in score order, and a line for each decision against or about one."""
    accepted: list[Candidate] = []
    claimed: set[int] = set()
    log: list[str] = []
    for c in group:
        kinds = [classify(c, a) for a in accepted]
        first = lambda kind, kinds=kinds: accepted[kinds.index(kind)] if kind in kinds else None
        if bad := first("mono_break"):
            log.append(f"REJECTED {c.tag} reason=monotonicity_break partner={bad.tag} scope={scope} region={c.region}")
            continue
        if bad := first("genomic"):
            log.append(f"REJECTED {c.tag} reason=genomic_overlap partner={bad.tag} scope={scope} region={c.region}")
            continue
        if partner := first("module"):
            at = accepted.index(partner)
            accepted[at] = replace(partner, partner=c.tag)
            log.append(f"MODULE_DETECTED {c.tag} partner={partner.tag} type={module_type(c)} dist={abs(c.start - partner.start)}bp scope={scope} region={c.region}")
            c = replace(c, partner=partner.tag)
        elif (overlap := len(c.cols & claimed)) > min(MAX_CLAIMED, len(c.cols) * 0.5):
            log.append(f"REJECTED {c.tag} reason=slot_duplicate overlap={overlap} scope={scope} region={c.region}")
            continue
        accepted.append(c)
        claimed |= c.cols
    return accepted, log


def base_key(cluster: str) -> str:
    return cluster.rpartition("_")[0] if "_" in cluster else cluster


def cross_cluster_losers(cands: list[Candidate]) -> dict[int, int]:
    """Loser to winner, by place: of two on one locus that share half of the shorter's bases one goes; a base
    cluster wins over its isoforms, else the better score, then the longer, then the earlier."""
    order = sorted(range(len(cands)), key=lambda i: (cands[i].cluster, i))
    out: dict[int, int] = {}
    rank = lambda c: (c.full, residues_of(c.aa))
    for k, i in enumerate(order):
        for j in order[k + 1 :]:
            if i in out:
                break
            if j in out:
                continue
            a, b = cands[i], cands[j]
            shared = a.common_bases(b) if a.same_locus(b) else 0
            if not shared or shared < CROSS_SHARE * min(a.end + 1 - a.start, b.end + 1 - b.start):
                continue
            bases = ["_" not in c.cluster for c in (a, b)]
            if base_key(a.cluster) == base_key(b.cluster) and bases[0] != bases[1]:
                first = bases[0]
            else:
                first = rank(a) >= rank(b)
            out[j if first else i] = i if first else j
    return out


def slot_siblings(cluster: str, slot: Slot, clusters: dict[str, list[str]]) -> set[str]:
    """The tokens between a slot's flanks in any cluster of the same base, but its own node."""
    found: set[str] = set()
    for key, tokens in clusters.items():
        if base_key(key) == base_key(cluster) and slot.left in tokens and slot.right in tokens:
            lo, hi = sorted((tokens.index(slot.left), tokens.index(slot.right)))
            found.update(t for t in tokens[lo + 1 : hi] if t != slot.node)
    return found


def blosum_identity(a: str, b: str) -> float:
    """The share, of positions where both have one of the 20 residues, of pairs that score over 0."""
    at = blosum.scores()
    both = [(x, y) for x, y in zip(a.upper(), b.upper(), strict=False) if x in blosum.AMINO and y in blosum.AMINO]
    return sum(at[p] > 0 for p in both) / len(both) if both else 0.0


def kick_slot_candidates(cands: list[Candidate], seqs: dict[str, str], clusters: dict[str, list[str]]) -> tuple[list[Candidate], list[str]]:
    """Candidates of slots that are as long as the slot's siblings and like one of them; modules and others stay."""
    kept, log = [], []
    for c in cands:
        rest = sorted(t for t in slot_siblings(c.cluster, c.slot, clusters) if t in seqs) if c.slot and c.partner is None else []
        if not rest:
            kept.append(c)
            continue
        sizes, n = [residues_of(seqs[t]) for t in rest], residues_of(c.aa)
        if not SLOT_SHORT * min(sizes) <= n <= SLOT_LONG * max(sizes):
            log.append(f"REJECTED {c.tag} reason=imx_length cand_len={n} range=[{min(sizes)},{max(sizes)}] slot={c.slot.node} cluster={c.cluster} region={c.region}")
            continue
        alike = {t: blosum_identity(c.aa, seqs[t]) for t in rest}
        best = max(rest, key=lambda t: alike[t])
        if alike[best] < SLOT_IDENTITY:
            log.append(f"REJECTED {c.tag} reason=imx_similarity best_sim={alike[best] * 100:.1f}% thr=25.0% against={best if alike[best] else ''} slot={c.slot.node} cluster={c.cluster} region={c.region}")
            continue
        kept.append(c)
    return kept, log


def supersede_natives(found: DataFrame, natives: DataFrame, width: int = 20_000) -> DataFrame:
    """(name, tag, superseded): natives that a recovered candidate covers.

    found: tag, scaffold, strand, start, end, is_slot, ord. A slot's candidate replaces the native, the first one by ord only
    (superseded); an ordinary gap's candidate (tag GAP_...) has found the native again and is itself to be rejected, all of them.
    Natives named like recoveries do not count.
    """
    from pyspark.sql import Window as W

    n = natives.where(~F.col("name").rlike("^(FLANK_|GAP_)") & (F.col("end") >= F.col("start"))).select("name", "scaffold", "strand", F.col("start").alias("n_start"), F.col("end").alias("n_end"))
    pairs = intervals.overlap_join(found.where(F.col("is_slot") | F.col("tag").startswith("GAP_")), n, ["scaffold", "strand"], ("start", "end"), ("n_start", "n_end"), width)
    hits = pairs.where(intervals.covers(F.col("n_start"), F.col("n_end"), F.col("start"), F.col("end"), NATIVE_SHARE))
    first = F.row_number().over(W.partitionBy("name", "is_slot").orderBy("ord"))
    return hits.withColumn("k", first).where("NOT is_slot OR k = 1").select("name", "tag", F.col("is_slot").alias("superseded"))


def reference_letters(refs: list[str]) -> list[Counter]:
    """The symbols of each column within the references' spans."""
    out = [Counter() for _ in range(max(map(len, refs), default=0))]
    for r in refs:
        inner = r.strip("-")
        at = len(r) - len(r.lstrip("-")) if inner else 0
        for i, c in enumerate(inner):
            out[at + i][c] += 1
    return out


def calculate_split(a: str, b: str, start: int, end: int, columns: list[Counter]) -> int:
    """The column that best parts two rows over an overlap: a to its left, b from it on; of equals the last, of only bad ones the start."""
    if end <= start:
        return start
    letter = lambda s, i: s[i] if i < len(s) else "-"

    def worth(s: str) -> np.ndarray:
        cols = [(letter(s, i), columns[i] if i < len(columns) else Counter()) for i in range(start, end)]
        return np.array([(n[c] if c in n else -1) - (c == "-") for c, n in cols])

    left = np.concatenate(([0], np.cumsum(worth(a))))
    right = np.concatenate((np.cumsum(worth(b)[::-1])[::-1], [0]))
    total = left + right
    best = int(total.max())
    return start + int(np.flatnonzero(total == best)[-1]) if best >= -1 else start


def is_module_pair(a: str, b: str, place_a: tuple[str, int], place_b: tuple[str, int]) -> bool:
    """Whether two aligned rows of one scaffold (scaffold, position) fill the same columns from places apart."""
    if place_a[0] != place_b[0] or abs(place_a[1] - place_b[1]) < SPLIT_BASES:
        return False
    x, y = ({i for i, c in enumerate(s) if c != "-"} for s in (a, b))
    small, large = sorted((len(x), len(y)))
    return bool(small) and small / large >= SPLIT_SIZE and len(x & y) / small >= SPLIT_OVERLAP


def module_groups(members: list[tuple[str, str, tuple[str, int, str]]]) -> list[list[str]]:
    """Groups of two and more of (header, row, (scaffold, position, strand)) that module pairs join, in genomic order along the strand."""
    top = list(range(len(members)))

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for i, (_, a, p) in enumerate(members):
        for j in range(i + 1, len(members)):
            _, b, q = members[j]
            if is_module_pair(a, b, p[:2], q[:2]):
                top[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(members)):
        groups[find(i)].append(i)
    several = sorted((g for g in groups.values() if len(g) > 1), key=lambda g: g[0])
    back = [any(members[i][2][2] == "-" for i in g) for g in several]
    return [[members[i][0] for i in sorted(g, key=lambda i, s=-1 if m else 1: s * members[i][2][1])] for g, m in zip(several, back, strict=True)]


def apply_cull_trim(c: Candidate, drops: set[int]) -> Candidate:
    """The candidate's place without the dropped residues at its ends; as it was if nothing or all would go."""
    kept = [i for i in range(len(c.aa)) if i not in drops]
    if not kept:
        return c
    out = c.trimmed(kept[0], len(c.aa) - 1 - kept[-1])
    return out if out.start <= out.end else c


def apply_drop(row: str, cols: set[int], dropped: set[int], length: int) -> tuple[str, set[int]]:
    """The row with gaps in these columns, and the residues of the original (of a length, some dropped already) that go with them."""
    out = "".join("-" if i in cols else c for i, c in enumerate(row))
    kept = [i for i in range(length) if i not in dropped]
    full = [i for i, c in enumerate(row) if c not in "-."]
    gone = {kept[at] for c in cols if (at := bisect_left(full, c)) < len(full) and full[at] == c and at < len(kept)}
    return out, dropped | gone


#: Columns from 0 to this number are bits of a whole number, others members of a set.
BIT_COLUMNS = 1 << 16


def column_bits(cols: pa.ListArray) -> list[tuple[int, frozenset[int], int, int]]:
    """(bits, columns that are no bits, first, last) of each list of columns; a run of columns is cut from one number."""
    if cols.null_count or cols.flatten().null_count:
        raise ValueError("a candidate without columns")
    flat, ends = cols.flatten().to_numpy(), np.asarray(cols.offsets, np.int64)
    ends = ends - ends[0]
    steps = np.concatenate(([0], np.cumsum(np.diff(flat) != 1))) if len(flat) else np.zeros(1, np.int64)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if a == b:
            out.append((0, frozenset(), 0, 0))
            continue
        first, last = int(flat[a]), int(flat[b - 1])
        if 0 <= first and last < BIT_COLUMNS and steps[a] == steps[b - 1]:
            out.append((((1 << (b - a)) - 1) << first, frozenset(), first, last))
            continue
        some = set(flat[a:b].tolist())
        rest = frozenset(c for c in some if not 0 <= c < BIT_COLUMNS)
        out.append((sum(1 << c for c in some - rest), rest, min(some), max(some)))
    return out


class _Kept:
    """An accepted candidate of the group that is being read; row is its place in the batch, None if that has been handed on."""

    __slots__ = ("bits", "rest", "size", "first", "last", "locus", "start", "end", "covered", "tag", "partner", "row")


def _decide(c: _Kept, kept: list[_Kept], bits: int, rest: set[int]) -> bool:
    """Whether the next candidate is accepted; as dedup_group, which logs the reasons, decides. bits and rest are claimed columns."""
    partner = None
    for a in kept:
        shared = (c.bits & a.bits).bit_count() + (len(c.rest & a.rest) if c.rest and a.rest else 0)
        if c.locus != a.locus:
            continue
        touch = min(c.end, a.end) >= max(c.start, a.start)
        if shared > MAX_CLAIMED:
            if partner is None and not touch:
                small, large = (c.size, a.size) if c.size < a.size else (a.size, c.size)
                if (
                    small >= MODULE_SIZE * large
                    and shared >= MODULE_SMALLER * small
                    and shared >= MODULE_LARGER * large
                    and abs(c.start - a.start) >= MODULE_BASES
                    and (a.covered <= 0 or c.covered >= MODULE_SCORE * a.covered)
                ):
                    partner = a
            continue
        if touch:
            return False  # genomic or, if it breaks the order too, mono_break
        both = min(c.last, a.last) - max(c.first, a.first) + 1
        if max(0, both) / min(c.last - c.first + 1, a.last - a.first + 1) < MODULE_SPAN:
            genome = (c.start > a.start) - (c.start < a.start)
            columns = (c.first > a.first) - (c.first < a.first)
            if genome * columns * (1 if c.locus[1] == "+" else -1) < 0:
                return False
    if partner is not None:
        partner.partner, c.partner = c.tag, partner.tag
        return True
    return (c.bits & bits).bit_count() + len(c.rest & rest) <= min(MAX_CLAIMED, c.size * 0.5)


def dedup_candidates(cands: DataFrame, group: list[str]) -> DataFrame:
    """Candidates (group, tag, scaffold, strand, start, end, cols, aa, full, covered, cluster) with accepted and partner.

    Within each group the best full score comes first, of equals the earlier by ord.

    Groups are read one after the other from sorted partitions, many in a batch; a task holds a batch and the accepted
    candidates of one group.
    """
    n = len(group)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        key, kept, bits, rest, late = None, [], 0, set(), []
        names, types = [*group, "tag", "accepted", "partner"], None

        def close(partners: list) -> None:
            for a in kept:
                if a.row is None:
                    late.append((*key[1], a.tag, True, a.partner))
                else:
                    partners[a.row] = a.partner

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*late, strict=True), types, strict=True)], names)
            late.clear()
            return out

        for batch in batches:
            tags, (scaffolds, strands, starts, ends, covers) = batch.column(n), (batch.column(n + 1 + i).to_pylist() for i in range(5))
            types = [*batch.schema.types[: n + 1], pa.bool_(), pa.string()]
            accepted, partners, told = [False] * batch.num_rows, [None] * batch.num_rows, np.ones(batch.num_rows, bool)
            groups, names_of = zip(*(batch.column(i).to_pylist() for i in range(n)), strict=True), tags.to_pylist()
            for row, (g, cols) in enumerate(zip(groups, column_bits(batch.column(n + 6)), strict=True)):
                this = tuple("nan" if isinstance(v, float) and v != v else v for v in g)
                if key is None or key[0] != this:
                    if key is not None:
                        close(partners)
                    key, kept, bits, rest = (this, g), [], 0, set()
                c = _Kept()
                c.bits, c.rest, c.first, c.last = cols
                c.size, c.locus, c.start, c.end, c.covered = c.bits.bit_count() + len(c.rest), (scaffolds[row], strands[row]), starts[row], ends[row], covers[row]
                c.covered = float("nan") if c.covered is None else c.covered
                c.tag, c.partner, c.row = names_of[row], None, row
                if _decide(c, kept, bits, rest):
                    accepted[row] = True
                    kept.append(c)
                    bits |= c.bits
                    rest |= c.rest
            for a in kept:  # their partners may change with the next batch
                if a.row is not None:
                    told[a.row], a.row = False, None
            whole = [*batch.columns[: n + 1], pa.array(accepted, pa.bool_()), pa.array(partners, pa.string())]
            yield pa.RecordBatch.from_arrays(whole, names).filter(pa.array(told))
            if late:
                yield handed()
        if key is not None:
            close([])
            if late:
                yield handed()

    score = F.col("full")
    if cands.schema["full"].dataType.typeName() in ("double", "float"):
        score = F.when(~F.isnan("full"), score)  # after all numbers, as those without a score
    ordered = cands.withColumn("_full", score).repartition(*group).sortWithinPartitions(*group, F.col("_full").desc_nulls_last(), F.col("ord").asc_nulls_last())
    lean = ordered.select(*group, F.col("tag").cast("string"), "scaffold", "strand", F.col("start").cast("long"), F.col("end").cast("long"), F.col("covered").cast("double"), F.col("cols").cast("array<long>"))
    kinds = ", ".join(f"`{g}` {cands.schema[g].dataType.simpleString()}" for g in group)
    return lean.mapInArrow(run, f"{kinds}, tag string, accepted boolean, partner string")
