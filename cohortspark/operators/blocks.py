"""Batch search by blocks of whole accounts: what a great many saved filters find is counted block by block, and no pair becomes a row."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .batch import SLOTS, _fold, match_samples, working_parts
from .cohort import reported, reviewed_current

#: Profiles and requests that meet in one task, about; accounts are whole.
BLOCK, ASKED = 200_000, 50_000
#: Conditions whose rows a block holds at once.
MASKS = 600
METRICS, SETS, TEXTS = ("gpa", "mcat"), ("cycles", "sources", "outcomes"), ("school", "activity")
REPORTED = ("accepted", "rejected")


def account_rows(profiles: DataFrame, outcomes: DataFrame | None = None) -> DataFrame:
    """Reviewed current profiles with what a search reads: metrics as reported, texts folded, unconditional events of the own cycle; to be written.

    Without outcomes the profiles carry these `events` themselves, as structs of status and school.
    """
    rows = reviewed_current(profiles)
    if outcomes is not None:
        events = outcomes.where("conditional = 0").groupBy(F.col("profile_id").alias("_profile"), F.col("cycle").alias("_of")).agg(F.collect_set(F.struct("status", "school")).alias("events"))
        rows = rows.join(events, (rows["id"] == events["_profile"]) & (rows["cycle"] == events["_of"]), "left")
    activities = F.col("activities_json") if "activities_json" in profiles.columns else F.lit(None).cast("string")
    folded = F.transform("events", lambda e: F.struct(e["status"].alias("status"), _fold(e["school"]).alias("school")))
    return rows.select("account_id", "id", "cycle", "observed_at", "source", *[reported(c).cast("double").alias(c) for c in METRICS], _fold(activities).alias("activities"), folded.alias("events"))


def _filters(requests: DataFrame) -> DataFrame:
    """Requests with sets and texts as texts to be looked up, folded; an activity only where requests have one."""
    text = lambda c: _fold(F.col(c)) if c in requests.columns else F.lit(None).cast("string")
    bounds = [F.col(f"{c}_{end}").cast("double") for c in METRICS for end in ("min", "max")]
    return requests.select("request_id", *bounds, *[F.to_json(c).alias(c) for c in SETS], *[text(c).alias(c) for c in TEXTS], *[c for c in ("last",) if c in requests.columns])


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Numbers of a column's values, -1 for null, and the values."""
    coded = column.combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    return pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False), coded.dictionary


def _known(values: pa.Array, test: Callable) -> np.ndarray:
    """Whether each value meets a test; the last place is that of null, which meets none."""
    return np.array([*map(bool, test(values)), False])


class Block:
    """The profiles of some accounts, each account's in its order of rank, with a mask for every condition that was asked for."""

    def __init__(self, rows: pa.Table, cuts: list[tuple[str, str]]):
        rows = rows.sort_by([("account_id", "ascending"), ("cycle", "descending"), ("observed_at", "descending"), ("id", "ascending")])
        self.rows, self.n, self.masks = rows, rows.num_rows, {}
        self.account = _codes(rows["account_id"])[0]
        self.metric = {c: rows[c].to_numpy() for c in METRICS}
        self.coded = {c: _codes(rows[c]) for c in ("cycle", "source", "activities")}
        events = rows["events"].combine_chunks()
        events = events.combine_chunks() if isinstance(events, pa.ChunkedArray) else events
        flat = events.flatten()
        self.owner = np.repeat(np.arange(self.n), pc.fill_null(events.value_lengths(), 0).to_numpy(zero_copy_only=False))
        self.events = {c: _codes(pa.chunked_array([pc.struct_field(flat, c)])) for c in ("status", "school")}
        self.reported = self.event((json.dumps(REPORTED), None))
        told = np.stack([self.coded["cycle"][0], self.coded["source"][0], self.reported.astype(np.int64)], 1)
        self.groups, self.group = np.unique(told, axis=0, return_inverse=True) if self.n else (told, np.zeros(0, np.int64))
        self.group = self.group.reshape(-1)
        self.slot = self.slots(cuts)

    def slots(self, cuts: list[tuple[str, str]]) -> np.ndarray:
        """The part of the sample order (latest cycle, then id) in which each row lies: how many cuts come before it."""
        codes, values = self.coded["cycle"]
        slot, ids = np.full(self.n, len(cuts), np.int64), np.array(self.rows["id"].to_pylist(), dtype=str)
        for k, cycle in enumerate(values.to_pylist()):
            at = codes == k
            slot[at] = sum(c > cycle for c, _ in cuts) + np.searchsorted(np.array(sorted(i for c, i in cuts if c == cycle), dtype=str), ids[at])
        return slot

    def event(self, pair: tuple[str | None, str | None]) -> np.ndarray:
        """Profiles with one event of one of these statuses and a school that holds this text."""
        met = np.ones(len(self.owner), bool)
        for name, asked, test in (("status", pair[0], lambda v: np.isin(v.to_pylist(), json.loads(pair[0])) if len(v) else []), ("school", pair[1], lambda v: pc.match_substring(v, pair[1]).to_pylist())):
            if asked is not None:
                codes, values = self.events[name]
                met &= _known(values, test)[codes]
        mask = np.zeros(self.n, bool)
        mask[self.owner[met]] = True
        return mask

    def mask(self, kind: str, asked) -> np.ndarray:
        """The rows that meet one condition, found once."""
        if (kind, asked) not in self.masks:
            if kind == "event":
                found = self.event(asked)
            else:
                codes, values = self.coded[kind]
                test = (lambda v: pc.match_substring(v, asked).to_pylist()) if kind == "activities" else (lambda v: [x in wanted for x in v.to_pylist()])
                wanted = set() if kind == "activities" else set(json.loads(asked)) - {None}
                found = _known(values, test)[codes]
            self.hold((kind, asked), found)
        return self.masks[kind, asked]

    def hold(self, key: tuple, found: np.ndarray) -> None:
        if len(self.masks) >= MASKS:
            self.masks.clear()
        self.masks[key] = found

    def within(self, metric: str, low: float, high: float, asked: bool) -> np.ndarray | None:
        """The rows whose metric lies within bounds; None for all where no bound was given."""
        if not asked:
            return None
        key = (metric, low, high)
        if key not in self.masks:
            self.hold(key, (self.metric[metric] >= low) & (self.metric[metric] <= high))
        return self.masks[key]

    def matches(self, requests: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the request, its rows: of each account the best ranked that matches) for requests that find any."""
        if not self.n or not requests.num_rows:
            return
        bounds = []
        for c in METRICS:
            low, high = (requests[f"{c}_{end}"] for end in ("min", "max"))
            top = high.fill_null(np.inf).to_numpy()
            # NaN is above all numbers: nothing reaches it, everything stays below.
            bounds += [low.fill_null(-np.inf).to_numpy(), np.where(np.isnan(top), np.inf, top), (low.is_valid().to_numpy() | high.is_valid().to_numpy()).astype(float)]
        ranges, which = np.unique(np.stack(bounds, 1), axis=0, return_inverse=True)
        which = which.reshape(-1)
        coded = {c: _codes(requests[c]) for c in (*SETS, *TEXTS)}
        values = {c: [*v.to_pylist(), None] for c, (_, v) in coded.items()}
        asked = {c: x.tolist() for c, (x, _) in coded.items()}
        order = np.argsort(which, kind="stable")
        starts = np.searchsorted(which[order], np.arange(len(ranges) + 1))
        for k, (a, b, has_gpa, c, d, has_mcat) in enumerate(ranges):
            parts = [m for m in (self.within("gpa", a, b, bool(has_gpa)), self.within("mcat", c, d, bool(has_mcat))) if m is not None]
            rows = np.flatnonzero(parts[0] & parts[1]) if len(parts) == 2 else np.flatnonzero(parts[0]) if parts else np.arange(self.n)
            if not len(rows):
                continue
            for r in order[starts[k] : starts[k + 1]].tolist():
                found = rows
                cycles, sources, outcomes, school, activity = (values[c][asked[c][r]] for c in (*SETS, *TEXTS))
                for kind, want in (("cycle", cycles), ("source", sources), ("activities", activity), ("event", (outcomes, school))):
                    if want is not None and want != (None, None):
                        found = found[self.mask(kind, want)[found]]
                if len(found):
                    account = self.account[found]
                    yield r, found[np.concatenate(([True], account[1:] != account[:-1]))]


def _counted(rows: pa.Table, requests: pa.Table, cuts: list, limit: int) -> pa.Table:
    """Numbers of matches by source, cycle and reported outcome, and by part of the sample order as far as the limit reaches."""
    block = Block(rows, cuts)
    asked, group, n, whose, slots = [], [], [], [], []
    for r, found in block.matches(requests):
        counts = np.bincount(block.group[found])
        some = np.flatnonzero(counts)
        asked.append(np.full(len(some), r))
        group.append(some)
        n.append(counts[some])
        if limit:
            by = np.bincount(block.slot[found])
            slots.append(by[: np.searchsorted(np.cumsum(by), limit) + 1])
            whose.append(r)
    flat = lambda xs: np.concatenate(xs).astype(np.int64) if xs else np.zeros(0, np.int64)
    asked, group, n = map(flat, (asked, group, n))
    told = block.groups[group].reshape(-1, 3)
    name = lambda c, k: block.coded[c][1].take(pa.array(told[:, k], mask=told[:, k] < 0)).cast(pa.string())
    ids, none = requests["request_id"].combine_chunks(), len(whose)
    offsets = np.concatenate(([0], np.cumsum([len(s) for s in slots]))).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat(slots)))
    both = lambda a, b, kind: pa.chunked_array([a.cast(kind), b.cast(kind)], kind)
    nulls = lambda size: pa.nulls(size)
    return pa.table({
        "request_id": both(ids.take(pa.array(asked)), ids.take(pa.array(np.array(whose, np.int64))), ids.type),
        "source": both(name("source", 1), nulls(none), pa.string()),
        "cycle": both(name("cycle", 0), nulls(none), pa.string()),
        "reported": both(pa.array(told[:, 2] == 1), nulls(none), pa.bool_()),
        "n": both(pa.array(n), nulls(none), pa.int64()),
        "slots": both(nulls(len(n)), lists, pa.list_(pa.int64())),
    })


def _first(rows: pa.Table, requests: pa.Table, cuts: list) -> pa.Table:
    """The matches in the parts of the sample order up to each request's last."""
    block, last = Block(rows, cuts), requests["last"].to_numpy()
    asked, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for r, found in block.matches(requests):
        found = found[block.slot[found] <= last[r]]
        asked.append(np.full(len(found), r))
        at.append(found)
    at = pa.array(np.concatenate(at))
    return pa.table({"request_id": requests["request_id"].combine_chunks().take(pa.array(np.concatenate(asked)))} | {c: block.rows[c].take(at) for c in ("cycle", "id", *METRICS)})


def _met(requests: DataFrame, rows: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str, asked: int | None = None) -> DataFrame:
    """`work` on every block of accounts with every part of the requests (at most `asked`); both are dealt out, neither passes through the driver."""
    blocks = max(working_parts(rows.sparkSession), -(-rows.count() // BLOCK))
    parts = max(1, -(-(requests.count() if asked is None else asked) // ASKED))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    keys = ("_block", "_part")
    left = rows.withColumn("_block", place("account_id", blocks)).withColumn("_part", every(parts))
    right = _filters(requests).withColumn("_part", place("request_id", parts)).withColumn("_block", every(blocks))
    # The work lies in the pairs, not in the bytes, so the parts are not to be put together by their sizes.
    left, right = (df.repartition(blocks, *keys).groupBy(*keys) for df in (left, right))
    return left.cogroup(right).applyInArrow(lambda a, b: work(a.drop_columns(list(keys)), b.drop_columns(list(keys))), schema)


def cuts(rows: DataFrame) -> list[tuple[str, str]]:
    """(cycle, id) of SLOTS - 1 rows, which cut the sample order into about even parts; whichever they are, the parts follow the order."""
    known = rows.where("cycle IS NOT NULL AND id IS NOT NULL").select("cycle", "id")
    return [tuple(r) for r in known.orderBy(F.xxhash64("id"), "id").limit(SLOTS - 1).collect()]


def _kind(requests: DataFrame) -> str:
    return f"request_id {requests.schema['request_id'].dataType.simpleString()}"


def counted(requests: DataFrame, rows: DataFrame, limit: int = 0, at: list | None = None) -> DataFrame:
    """What requests find in account_rows, counted: rows of (request_id, source, cycle, reported, n), whose sums all counts are,
    and with a limit rows with `slots`, the numbers of matches in the first parts of the sample order; to be written.

    A block holds whole accounts, so that the best ranked match of an account is told within it.
    """
    at = at or []
    schema = f"{_kind(requests)}, source string, cycle string, reported boolean, n long, slots array<long>"
    return _met(requests, rows, lambda a, b: _counted(a, b, at, limit), schema)


def first_matches(requests: DataFrame, rows: DataFrame, found: DataFrame, limit: int, at: list) -> DataFrame:
    """(request_id, cycle, id, gpa, mcat, place) of the first `limit` matches of each request in sample order, from what `counted` found with the same cuts."""
    before: Column = F.coalesce(F.sum("n").over(W.partitionBy("request_id").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    slots = found.where("slots IS NOT NULL").select("request_id", F.posexplode("slots").alias("slot", "n")).where("n > 0")
    slots = slots.groupBy("request_id", "slot").agg(F.sum("n").alias("n")).withColumn("before", before)
    last = slots.where(F.col("before") < limit).groupBy("request_id").agg(F.max("slot").alias("last"))
    pairs = _met(requests.join(last, "request_id"), rows, lambda a, b: _first(a, b, at), f"{_kind(requests)}, cycle string, id string, gpa double, mcat double", requests.count())
    return match_samples(pairs, limit)
