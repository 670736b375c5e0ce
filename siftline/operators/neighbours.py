"""Candidates of similar texts, by MinHash bands or by an exact prefix index, and their comparison.

A text is a set of shingle codes.  Both indexes give it keys, and similar texts share a key:

* bands: hashes of ``rows`` MinHash values each; a pair at the threshold shares one of ``bands`` with a known chance;
* exact: the rarest codes first.  Of ``n`` codes, two sets of Jaccard similarity ``t`` share one of the first
  ``n - ceil(t * n) + 1``, in any common order, so none is missed.  Frequencies come from a counting sketch of fixed size, which
  decides the order only; codes themselves are not shuffled.  The sketch has far more counters than common codes, so that
  rare codes are told from common ones: keys that many rows share by chance cost the most.

With a time window, keys are combined with the window's number and the next one, so only rows near in time meet.

Groups of a key are never paired when they are large.  Copies are one entry; near copies are compared with the least row of the
group; what is left of a large group is split by a further key of the same index (another band, or the next common code of
the prefix).  Only small groups are compared pair by pair.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import similarity
from siftline import session

#: So many rows of a group, besides those of its commonest label, are compared with all others; a split costs a row about three.
CROWD = 8
#: Splits by further bands, and the group size down to which rounds settle rows in order.
DEPTH, ROUND = 6, 64
#: Rows of a table of ids that is sent to all executors (16 MB), and keys of one with all keys of a row (13 MB).
FEW, FEW_KEYS = 1_000_000, 1_600_000
#: Rounds in which labels meet across edges.
HOOKS = 3
#: Times that rows of crowds are compared with one row of the commonest label there.
TURNS = 3
#: Counters of the frequency sketch (a power of two), of a byte each, and how many of them travel in a row.
COUNTERS, BLOCK = 1 << 24, 1 << 16


def cut_lineage(df: DataFrame) -> DataFrame:
    """A checkpoint under new column identities, which the metadata keep apart: the optimizer would otherwise take over
    constraints on columns of the tables that it comes from, and fail where these are joined or united again."""
    done = session.cut_lineage(df)
    return done.select(*[F.col(c).alias(c, metadata={"cut": True}) for c in done.columns])


def written(df: DataFrame) -> DataFrame:
    """A table in the shared folder.  Unlike a checkpoint it has the size of its files as its size; the planner's estimates for a
    table that is joined with itself in every round would otherwise grow without bound."""
    path = f"{session.ensure_checkpoint_dir(df.sparkSession)}/links-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class Index:
    """``same`` (id, rep_id): the first row of equal texts.  ``rows``: of these, ``id, keys, first`` (how many keys place the
    row), ``size, bits, time, accepted``.  ``groups``: id, key, at and the row's marks, for keys that several rows share.
    ``codes`` (id, codes) of the rows in groups."""

    same: DataFrame
    rows: DataFrame
    groups: DataFrame
    codes: DataFrame
    threshold: float
    window_us: int | None = None
    exact: bool = False
    steps: tuple[int, ...] = ()
    n_bits: int = similarity.BITS

    def fits(self, a: str, b: str) -> Column:
        """Necessary conditions on two aliased rows of a group."""
        t, x, y = self.threshold, (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
        made = [F.least(x("size"), y("size")) >= t * F.greatest(x("size"), y("size")) - 1e-9]
        if self.window_us is not None:
            made.append(F.abs(x("time") - y("time")) <= self.window_us)
        if self.exact:  # codes up to a shared one, it, and those after it
            most = F.least(x("at"), y("at")) + 1 + F.least(x("size") - x("at"), y("size") - y("at")) - 1
            made.append(most >= t / (1 + t) * (x("size") + y("size")) - 1e-9)
        else:
            rate, n = (1 - t) / 2, self.n_bits
            most = int(n * rate + 5 * math.sqrt(n * rate * (1 - rate)))  # refused at the threshold with a chance below 1e-6
            made.append(self.differences(a, b) <= most)
        return reduce(lambda p, q: p & q, made)

    def differences(self, a: str, b: str) -> Column:
        """How unlike two aliased rows look: differing signature bits, or the difference of their sizes."""
        x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
        if self.exact:
            return F.abs(x("size") - y("size"))
        return reduce(lambda p, q: p + q, [F.bit_count(F.get(x("bits"), F.lit(i)).bitwiseXOR(F.get(y("bits"), F.lit(i)))) for i in range(-(-self.n_bits // 64))])

    def enough(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a row for each key that two rows have in common, with their sizes ``m, n``) that share enough keys to be similar:
        of the common codes only those after the shorter one of the prefixes, in the common order, are no keys of both."""
        after = lambda size: F.ceil(self.threshold * size - 1e-9) - 1
        least = self.threshold / (1 + self.threshold) * (F.col("m") + F.col("n")) - F.greatest(after(F.col("m")), after(F.col("n")))
        return pairs.groupBy("id", "other", "m", "n").agg(F.count(F.lit(1)).alias("_keys")).where(F.col("_keys") >= least - 1e-9).select("id", "other")

    def split(self, groups: DataFrame, depth: int) -> DataFrame | None:
        """The rows of large groups under longer keys, or None if the index has none."""
        if depth >= (1 if self.exact else DEPTH):
            return None
        held = self.rows.select("id", "keys")
        few = held.agg(F.sum(F.size("keys")).alias("n")).where(F.col("n") > FEW_KEYS).isEmpty()  # rows of the exact index have any number of keys
        keyed = groups.join(F.broadcast(held) if few else held, "id")
        if self.exact:  # two similar sets also share a second code, in prefixes longer by one
            places = F.when(F.col("at") + 1 < F.size("keys"), F.sequence(F.col("at") + 1, F.size("keys") - 1)).otherwise(F.array().cast("array<int>"))
            more = F.transform(places, lambda i: F.struct(i.alias("at"), F.lit(0).alias("step")))
        else:
            more = F.array(*[F.struct(((F.col("at") + s) % F.size("keys")).cast("int").alias("at"), F.lit(s).alias("step")) for s in self.steps])
        made = keyed.withColumn("_more", F.explode(more)).withColumn("key", F.xxhash64("key", F.get("keys", F.col("_more.at")), F.col("_more.step")))
        return made.withColumn("at", F.col("_more.at")).select(*groups.columns)


def _shared(groups: DataFrame) -> DataFrame:
    """Rows of keys that more than one row has, with their number ``n``."""
    sizes = groups.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return cut_lineage(groups.drop("n").join(sizes, "key"))


def _frequencies(texts: DataFrame, shingle: int) -> np.ndarray:
    """How many texts hold a code, by the low bits of the code: COUNTERS bytes, which stop at 255, summed over tasks."""
    encode = similarity._encode  # the function alone travels: its module may hold what cannot be pickled
    session.bound_batches()

    def batch_of(place, counts):
        return pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([counts.tobytes()], pa.binary())], ["place", "counts"])

    def run(batches):
        counts = np.zeros(COUNTERS, np.uint8)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                places = encode(text, shingle) & (COUNTERS - 1)
                held = counts[places]
                counts[places] = held + (held < 255)
        for place, block in enumerate(counts.reshape(-1, BLOCK)):
            if block.any():
                yield batch_of(place, block)

    def add(batches):
        sums = {}
        for batch in batches:
            for place, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                more = np.frombuffer(counts, np.uint8)
                sums[place] = np.minimum(sums[place].astype(np.uint16) + more, 255).astype(np.uint8) if place in sums else more
        for place, counts in sums.items():
            yield batch_of(place, counts)

    counts, row = np.zeros((COUNTERS // BLOCK, BLOCK), np.uint8), "place int, counts binary"
    for held in texts.mapInArrow(run, row).repartition("place").mapInArrow(add, row).toLocalIterator():
        counts[held["place"]] = np.frombuffer(held["counts"], np.uint8)
    return counts.reshape(-1)


def build(
    df: DataFrame, ident: str, text: str, shingle: int, threshold: float, bands: int = 32, rows: int = 4, *,
    exact: bool = False, ts: str | None = None, window_seconds: int | None = None, accepted: Column | None = None, copy: Column | None = None,
) -> Index:
    """Index of the texts of ``df``.  Without ``copy``, rows of equal shingle sets are copies; with it, rows of equal ``copy`` keys."""
    if exact and threshold <= 0.5:
        raise ValueError("the exact index needs a threshold above 0.5")
    if window_seconds is not None and ts is None:
        raise ValueError("a window needs a time column")
    if exact:
        keys = similarity.prefix(shingle, threshold, _frequencies(df.select(text), shingle))
    else:
        keys = similarity.sketch(shingle, bands, rows)
    time = F.unix_micros(F.col(ts).cast("timestamp")) if ts is not None else F.lit(None).cast("long")
    sketches = cut_lineage(
        df.select(F.col(ident).alias("id"), keys(text).alias("s"), (F.lit(None).cast("string") if copy is None else copy.cast("string")).alias("_copy"), time.alias("time"),
                  F.coalesce(accepted, F.lit(False)).alias("accepted") if accepted is not None else F.lit(True).alias("accepted"))
        .select("id", "s.*", "_copy", "time", "accepted")
    )
    by = F.col("same") if copy is None else F.coalesce("_copy", F.hex("same"))
    sketches = sketches.withColumn("_by", by)
    same = cut_lineage(sketches.select("id", "_by").join(sketches.groupBy("_by").agg(F.min("id").alias("rep_id")), "_by").select("id", "rep_id"))
    kept = sketches.join(same.where("id = rep_id").select("id"), "id", "left_semi").select("id", "keys", "first", "size", "bits", "time", "accepted")
    window_us = None if window_seconds is None else window_seconds * 1_000_000

    def codes_of(ids: DataFrame) -> DataFrame:
        return df.select(F.col(ident).alias("id"), text).join(small(ids), "id", "left_semi").select("id", similarity.shingle_codes(shingle)(text).alias("codes"))

    return assemble(same, kept, codes_of, threshold, window_us, exact, steps(threshold, bands, rows))


def steps(threshold: float, bands: int, rows: int) -> tuple[int, ...]:
    """By how many places bands are combined to split groups: in so many ways that a pair at the threshold stays together in one."""
    ways = max(2, round(1 / threshold**rows))
    return tuple(1 + i * bands // ways for i in range(ways))


def small(ids: DataFrame, most: int = FEW) -> DataFrame:
    """Checkpointed ids, to be sent to all executors if there are few (16 MB), so that texts need not be shuffled to meet them."""
    return F.broadcast(ids) if ids.count() <= most else ids


def assemble(same: DataFrame, rows: DataFrame, codes_of: Callable[[DataFrame], DataFrame], threshold: float, window_us: int | None = None, exact: bool = False,
             ways: tuple[int, ...] = (), n_bits: int = similarity.BITS) -> Index:
    """Index of ``rows``; ``codes_of`` gives the codes of a (checkpointed) table of ids."""
    marks = [c for c in rows.columns if c not in ("keys", "first")]
    placed = rows.select(*marks, F.posexplode(F.slice("keys", F.lit(1), F.col("first"))).alias("at", "key"))
    if window_us is not None:
        number = F.floor(F.col("time") / window_us)
        placed = placed.withColumn("_window", F.explode(F.array(number, number + 1))).withColumn("key", F.xxhash64("key", "_window")).drop("_window")
    groups = _shared(placed)
    ids = cut_lineage(groups.select("id").distinct())
    return Index(same, cut_lineage(rows.join(ids, "id", "left_semi")), groups, cut_lineage(codes_of(ids)), threshold, window_us, exact, ways, n_bits)


def verified(index: Index, pairs: DataFrame) -> DataFrame:
    """``id, other, similarity`` of the pairs that reach the threshold."""
    mine = index.codes.select("id", F.col("codes").alias("_mine"))
    theirs = index.codes.select(F.col("id").alias("other"), F.col("codes").alias("_theirs"))
    apart = pairs.select("id", "other").distinct()
    if index.exact:  # codes are many for few bytes of pairs: the planner would compare all of them in a task or two
        tasks = max(session.TASKS * apart.sparkSession.sparkContext.defaultParallelism, int(apart.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        exact = apart.join(mine, "id").repartition(tasks, "other").join(theirs, "other")
    else:
        exact = apart.join(mine, "id").join(theirs, "other")
    return exact.select("id", "other", similarity.jaccard(F.col("_mine"), F.col("_theirs")).alias("similarity")).where(F.col("similarity") >= index.threshold)


def duplicates(index: Index) -> DataFrame:
    """Ids that repeat an earlier accepted row that is kept: one row of a group after the other, as if in order of id."""
    groups, found, depth = index.groups, None, 0
    while True:
        first = F.min(F.struct("id", "size", "bits", "time", "at")).alias("lead")
        leads = groups.where("accepted").groupBy("key").agg(first)
        offered = groups.join(leads, "key", "left")
        sure = cut_lineage(offered.groupBy("id", "accepted").agg(F.bool_and(F.col("lead").isNull() | (F.col("id") <= F.col("lead.id"))).alias("_sure")).where("_sure"))
        met = offered.alias("g").where((F.col("id") > F.col("lead.id")) & index.fits("g", "g.lead")).select("id", F.col("lead.id").alias("other"))
        met = met.join(sure.where("accepted").select(F.col("id").alias("other")), "other", "left_semi")
        gone = cut_lineage(verified(index, met).select("id").distinct())
        found = gone if found is None else found.union(gone)
        groups = _shared(cut_lineage(groups.join(sure, "id", "left_anti").join(gone, "id", "left_anti")))
        many = groups.where(F.col("n") > ROUND)
        if many.isEmpty():
            break
        finer = index.split(many, depth)
        if finer is not None:
            groups = _shared(groups.where(F.col("n") <= ROUND).unionByName(finer))
            depth += 1
        elif not index.exact:
            break
    a, b = groups.alias("a"), groups.alias("b")
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.id") > F.col("b.id")) & F.col("b.accepted") & index.fits("a", "b"))
    pairs = pairs.select(F.col("a.id").alias("id"), F.col("b.id").alias("other"), F.col("a.size").alias("m"), F.col("b.size").alias("n"))
    if index.exact and depth == 0:  # groups are whole: all keys that two rows have in common are among them
        pairs = index.enough(pairs)
    edges = cut_lineage(verified(index, pairs).select("id", "other"))
    while not edges.isEmpty():  # rows without an open earlier neighbour are kept, their neighbours repeat them
        waiting = edges.select(F.col("id").alias("other")).distinct()
        gone = cut_lineage(edges.join(waiting, "other", "left_anti").select("id").distinct())
        found = found.union(gone)
        edges = cut_lineage(edges.join(gone, "id", "left_anti").join(gone.select(F.col("id").alias("other")), "other", "left_anti").select("id", "other"))
    return cut_lineage(found.distinct())


def leaders(index: Index, found: DataFrame) -> DataFrame:
    """``id, leader_id, similarity`` of the rows ``found`` to repeat others: the smallest kept one among the similar earlier rows."""
    groups, depth, made = index.groups, 0, None
    crowd = ROUND if index.exact else CROWD  # a split of the exact index makes a key of each later code
    while True:
        mine = groups.join(found, "id", "left_semi")
        kept = groups.where("accepted").join(found, "id", "left_anti")
        sizes = kept.groupBy("key").agg(F.count(F.lit(1)).alias("_kept"))
        finer = None
        wide = cut_lineage(groups.join(mine.select("key").distinct(), "key", "left_semi").join(sizes.where(F.col("_kept") > crowd), "key").drop("_kept"))
        if not wide.isEmpty():
            finer = index.split(wide, depth)
        if finer is not None:
            kept = kept.join(sizes.where(F.col("_kept") <= crowd).select("key"), "key", "left_semi")
        a, b = mine.alias("a"), kept.alias("b")
        met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.id") > F.col("b.id")) & index.fits("a", "b"))
        met = met.select(F.col("a.id").alias("id"), F.col("b.id").alias("other"), F.col("a.size").alias("m"), F.col("b.size").alias("n"))
        if index.exact and depth == 0 and finer is None:
            met = index.enough(met)
        near = cut_lineage(verified(index, met))
        made = near if made is None else made.union(near)
        if finer is None:
            break
        groups, depth = _shared(finer), depth + 1
    return made.groupBy("id").agg(F.min("other").alias("leader_id"), F.min_by("similarity", "other").alias("similarity"))


def _labels(near: DataFrame) -> DataFrame:
    """``(id, label)``: rows that are linked, over one edge or several, have a label in common.  Labels spare comparisons only,
    so they need not be those of whole components after HOOKS rounds."""
    both = near.select("id", "other").union(near.select(F.col("other").alias("id"), F.col("id").alias("other")))
    labels = cut_lineage(both.groupBy("id").agg(F.least(F.first("id"), F.min("other")).alias("label")))
    few = labels.count() <= FEW
    sent = F.broadcast if few else (lambda df: df)

    def ahead(of: DataFrame) -> DataFrame:
        for _ in range(3):
            following = sent(of.select(F.col("id").alias("label"), F.col("label").alias("_next")))
            of = of.join(following, "label", "left").select("id", F.coalesce("_next", "label").alias("label"))
        return of

    labels = cut_lineage(ahead(labels))
    for _ in range(HOOKS):  # the least label across an edge goes to all rows of the larger one
        side = lambda name, value: sent(labels.select(F.col("id").alias(name), F.col("label").alias(value)))
        across = near.select("id", "other").join(side("id", "_a"), "id").join(side("other", "_b"), "other").where("_a <> _b")
        roots = cut_lineage(across.groupBy(F.greatest("_a", "_b").alias("id")).agg(F.min(F.least("_a", "_b")).alias("label")))
        if roots.isEmpty():
            break
        moved = ahead(roots).select(F.col("id").alias("label"), F.col("label").alias("_next"))
        labels = cut_lineage(labels.join(sent(moved), "label", "left").select("id", F.coalesce("_next", "label").alias("label")))
    return F.broadcast(labels) if few else labels


def _met_in_crowds(index: Index, groups: DataFrame, turn: int) -> DataFrame:
    """``(id, other)``: rows of ``groups`` (with labels) and, of rows of the commonest label of their groups, one for each group and
    in each turn another, the one that looks most alike."""
    marks = ("id", "size", "bits", "time", "at", "open")
    leads = groups.where("label = top").groupBy("key").agg(F.min_by(F.struct(*marks), F.xxhash64("id", F.lit(turn))).alias("lead"))
    met = groups.where("label <> top").join(leads, "key").alias("g").where(index.fits("g", "g.lead"))
    return met.groupBy("id").agg(F.min_by("lead.id", F.struct(index.differences("g", "g.lead"), "lead.id")).alias("other"))


def _that_can_match(index: Index, groups: DataFrame) -> DataFrame:
    """The rows of ``groups`` (with labels) that a row of another label among them can match, with the number of codes they can
    have in common with one (``open``): those that rows of another label have, too.  Near copies of one text that each differ
    from it in much need no keys then."""
    ids = small(cut_lineage(groups.select("id", "label").distinct()))
    codes = index.codes.join(ids, "id").select("id", "label", F.explode("codes").alias("code"))
    own = codes.groupBy("label", "code").agg(F.count(F.lit(1)).alias("n")).groupBy("code").agg(F.min("label").alias("label"), F.count(F.lit(1)).alias("labels")).where("labels = 1")
    closed = small(cut_lineage(codes.join(own.select("code", "label"), ["code", "label"]).groupBy("id").agg(F.count(F.lit(1)).alias("_own"))))
    held = groups.join(closed, "id", "left").withColumn("open", (F.col("size") - F.coalesce("_own", F.lit(0))).cast("int"))
    return held.where(F.col("open") >= index.threshold * F.col("size") - 1e-9).select(*groups.columns)


def linked(index: Index) -> DataFrame:
    """Edges ``(id, other)`` that connect the rows of ``index`` as all similar pairs would."""
    lead = F.min(F.struct("id", "size", "bits", "time", "at")).alias("lead")
    offered = index.groups.join(index.groups.groupBy("key").agg(lead), "key").alias("g")
    stars = offered.where((F.col("id") > F.col("lead.id")) & index.fits("g", "g.lead"))
    # of the leads of a row, the one that looks most alike and the least one join groups of near copies as well as all do
    far = index.differences("g", "g.lead")
    chosen = stars.groupBy("id").agg(F.array_distinct(F.array(F.min_by("lead.id", F.struct(far, "lead.id")), F.min("lead.id"))).alias("leads"))
    near = written(verified(index, chosen.select("id", F.explode("leads").alias("other"))).select("id", "other"))
    groups, depth, turn = index.groups.withColumn("open", F.col("size").cast("int")), 0, 0
    while True:
        groups = groups.join(_labels(near), "id", "left").withColumn("label", F.coalesce("label", "id"))
        # in a group, rows of its commonest label need not be compared with each other
        sizes = groups.groupBy("key", "label").agg(F.count(F.lit(1)).alias("_held"))
        tops = sizes.groupBy("key").agg(F.sum("_held").alias("n"), F.max(F.struct("_held", "label")).alias("top"))
        tops = tops.where(F.col("top._held") < F.col("n")).select("key", F.col("top.label").alias("top"), (F.col("n") - F.col("top._held")).alias("others"))
        groups = cut_lineage(groups.join(tops, "key"))
        many = groups.where(F.col("others") > CROWD)
        if turn < TURNS and not many.isEmpty():  # rows of crowds find their labels before the crowds are split
            near = written(near.union(verified(index, _met_in_crowds(index, many, turn)).select("id", "other")))
            groups, turn = groups.drop("label", "top", "others"), turn + 1
            continue
        finer = None
        if not many.isEmpty():
            finer = index.split((_that_can_match(index, many) if depth == 0 else many).drop("label", "top", "others"), depth)
        few = groups if finer is None else groups.where(F.col("others") <= CROWD)
        a, b = few.where("label <> top").alias("a"), few.alias("b")
        once = (F.col("b.label") == F.col("b.top")) | (F.col("a.id") > F.col("b.id"))
        shared = F.least("a.open", "b.open") >= index.threshold / (1 + index.threshold) * (F.col("a.size") + F.col("b.size")) - 1e-9
        met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.label") != F.col("b.label")) & once & shared & index.fits("a", "b"))
        late = verified(index, met.select(F.greatest("a.id", "b.id").alias("id"), F.least("a.id", "b.id").alias("other"))).select("id", "other")
        if finer is None and depth == 0:
            return near.union(late)
        near = written(near.union(late))
        if finer is None:
            return near
        groups, depth = cut_lineage(finer), depth + 1
