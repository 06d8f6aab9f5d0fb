"""Processing only new or changed records.

Processed sequence numbers are kept as disjoint intervals per key. What a run may read is a
range of sequence numbers; the run handles that range minus the intervals already processed
(late commits fall into gaps of it) and commits the merged intervals together with its output.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codestrata.operators.bucketed import first_after, previous_row
from codestrata.session import checkpoint_folder, checkpointed

DAY = 86_400_000_000  # microseconds
FIRST = -(1 << 62)  # before every instant


def merge_intervals(intervals: DataFrame, keys: list[str], lo: str = "lo", hi: str = "hi", bucket: int | None = 1_000_000) -> DataFrame:
    """Merge half-open intervals [lo, hi) of numbers of each key into disjoint ones; touching ones are joined.

    Empty intervals (lo >= hi) and intervals with a null end are dropped. Exact duplicates count once. They are
    merged inside stretches of `bucket` numbers first, so that a hot key's many small intervals are many tasks;
    what is left of each stretch is merged across. bucket None leaves the stretches out, for keys of few intervals each.
    """
    clean = intervals.select(*keys, lo, hi).where(F.col(lo) < F.col(hi)).groupBy(*keys, lo).agg(F.max(hi).alias(hi))
    if bucket is None:
        return _islands(clean, keys, lo, hi)
    inside = _islands(clean.withColumn("__stretch", F.floor(F.col(lo) / bucket)), [*keys, "__stretch"], lo, hi)
    return _islands(inside.drop("__stretch"), keys, lo, hi)


def _islands(clean: DataFrame, keys: list[str], lo: str, hi: str) -> DataFrame:
    before = Window.partitionBy(*keys).orderBy(lo).rowsBetween(Window.unboundedPreceding, -1)
    running = Window.partitionBy(*keys).orderBy(lo)
    reach = F.max(hi).over(before)
    starts = clean.withColumn("__new", F.when(reach.isNull() | (F.col(lo) > reach), 1).otherwise(0))
    islands = starts.withColumn("__island", F.sum("__new").over(running))
    return islands.groupBy(*keys, "__island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("__island")


def subtract_intervals(available: DataFrame, processed: DataFrame, keys: list[str], lo: str = "lo", hi: str = "hi", bucket: int | None = 1_000_000) -> DataFrame:
    """The parts of `available` that `processed` does not cover, as disjoint half-open intervals.

    A sweep over the ends: +1/-1 events of both sides, one ordered pass per key. Either table may be empty.
    """
    def ends(df: DataFrame, a: int, p: int) -> DataFrame:
        merged = merge_intervals(df, keys, lo, hi, bucket)
        return merged.select(*keys, F.col(lo).alias("__at"), F.lit(a).alias("__a"), F.lit(p).alias("__p")).unionByName(
            merged.select(*keys, F.col(hi).alias("__at"), F.lit(-a).alias("__a"), F.lit(-p).alias("__p"))
        )

    events = ends(available, 1, 0).unionByName(ends(processed, 0, 1))
    steps = events.groupBy(*keys, "__at").agg(F.sum("__a").alias("__a"), F.sum("__p").alias("__p"))
    upto = Window.partitionBy(*keys).orderBy("__at")
    swept = steps.select(
        *keys,
        F.col("__at").alias(lo),
        F.lead("__at").over(upto).alias(hi),
        F.sum("__a").over(upto).alias("__in"),
        F.sum("__p").over(upto).alias("__done"),
    )
    return merge_intervals(swept.where("__in > 0 and __done = 0"), keys, lo, hi, bucket)


def successful_runs(runs: DataFrame, states: DataFrame) -> DataFrame:
    """Runs that left a state with a non-empty last_indexed_commit and tree_clean true, one row each."""
    good = states.where("last_indexed_commit <> '' and tree_clean").select("run_id").distinct()
    return (
        runs.where("run_id is not null and checkout_id is not null and started_at is not null")
        .select("run_id", "checkout_id", "started_at")
        .distinct()
        .join(good, "run_id", "left_semi")
    )


def run_gaps(runs: DataFrame) -> DataFrame:
    """(checkout_id, run_id, lo, hi): the numbers [lo, hi) that each successful run has to process, in microseconds.

    Available to a run is everything that arrived before its start. Processed are the ranges of the successful runs of
    the checkout before it, which merge into one interval up to the start before; available minus processed is the
    run's gap. Of runs with the same start the lowest run_id takes the gap, the others get none.
    """
    starts = checkpointed(runs.groupBy("checkout_id", F.unix_micros(F.col("started_at").cast("timestamp")).alias("hi")).agg(F.min("run_id").alias("run_id")))
    keys = ["checkout_id", "run_id"]
    available = starts.select(*keys, F.lit(FIRST).alias("lo"), "hi")
    month = F.floor(F.col("hi") / (30 * DAY))
    before = previous_row(starts, ["checkout_id"], ["hi"], month, ["hi"], "__before").where("__before is not null")
    processed = before.select(*keys, F.lit(FIRST).alias("lo"), F.col("__before.hi").alias("hi"))
    return subtract_intervals(available, processed, keys, bucket=None)  # one range a run on either side


def effective_changes(changes: DataFrame) -> DataFrame:
    """Queue rows that change something, in arrival order (arrived_at, then change_id).

    Re-deliveries (same checkout, path and non-null commit) count once, at their first arrival; a row
    whose content equals that of the counting row before it is dropped, a null content (deletion)
    being a value like any other. Rows without checkout_id or arrived_at can never be assigned and
    are dropped; a null path is a key of its own. Exact repeats of a row count once.
    """
    base = changes.where("checkout_id is not null and arrived_at is not null").select(
        "checkout_id", "path", "commit_sha", "content_sha", "arrived_at", "change_id"
    )
    arrival = F.struct("arrived_at", "change_id", "content_sha")
    # a row without commit is a group of its own: its key is its own id
    first = base.groupBy("checkout_id", "path", "commit_sha", F.when(F.col("commit_sha").isNull(), F.col("change_id")).alias("__own")).agg(
        F.min(arrival).alias("__first")
    )
    # cut here: the look-back below meets these rows twice
    rows = checkpointed(first.select("checkout_id", "path", "__first.*").withColumn("__there", F.lit(True)))
    seen = previous_row(rows, ["checkout_id", "path"], ["arrived_at", "change_id"], F.date_trunc("day", "arrived_at"), ["__there", "content_sha"], "__before")
    same = F.col("__before.__there").isNotNull() & F.col("content_sha").eqNullSafe(F.col("__before.content_sha"))
    return seen.where(~same).select("checkout_id", "path", "change_id", "content_sha", "arrived_at")


def in_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, values: list[str], width: int, out: str) -> DataFrame:
    """Add `out`, a struct of the `values` of the interval [lo, hi) that holds each point; null where none does.

    The intervals of a key must be disjoint. `width` is the stretch of numbers by which hot keys are split.
    """
    found = first_after(points, intervals.withColumn("__hi", F.col("hi")), keys, at, "__hi", ["__hi", "lo", *values], "__hit", lambda c: F.floor(c / width))
    inside = F.col("__hit").isNotNull() & (F.col("__hit.lo") <= F.col(at))
    return found.withColumn(out, F.when(inside, F.struct(*[F.col(f"__hit.{v}").alias(v) for v in values]))).drop("__hit")


def handled_per_run(changes: DataFrame, gaps: DataFrame) -> DataFrame:
    """(run_id, change_id): the effective changes whose arrival lies in a run's gap, every change exactly once."""
    points = effective_changes(changes).withColumn("__at", F.unix_micros(F.col("arrived_at").cast("timestamp")))
    found = in_intervals(points, gaps, ["checkout_id"], "__at", ["run_id"], DAY, "__gap")
    return found.where("__gap is not null").select(F.col("__gap.run_id").alias("run_id"), "change_id")


def changes_per_run(changes: DataFrame, runs: DataFrame, states: DataFrame, root: str | None = None) -> DataFrame:
    """(run_id, change_id): what each successful run has to handle, read back from a ledger that committed it.

    The ledger under `root` (by default a new one in the shared checkpoint folder) gets the output together with the
    processed intervals of each checkout, the merged gaps of its runs; gaps that it holds already are not handled again.
    """
    spark = changes.sparkSession
    ledger = IncrementalLedger(spark, root or f"{checkpoint_folder(spark)}/ledger-{uuid.uuid4().hex}", ["checkout_id"], "at")
    gaps = checkpointed(run_gaps(successful_runs(runs, states)))
    ledger.commit(handled_per_run(changes, ledger.open_gaps(gaps)), gaps.select("checkout_id", "lo", "hi"))
    return ledger.output()


class ConcurrentCommit(RuntimeError):
    """Another run committed the same ledger version first; plan again."""


class IncrementalLedger:
    """A ledger of processed sequence-number intervals, committed atomically with the output.

    Layout under `root`: output/<run>/ and intervals/<run>/ are written first; a run becomes
    visible only when manifest/<version>.json naming both is created. A run that dies before
    leaves unreferenced folders and no effect, so nothing is skipped and nothing repeated.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], seq: str, width: int = 1_000_000):
        """`width` is the stretch of sequence numbers of a key that one task may look up."""
        self.spark, self.root, self.keys, self.seq, self.width = spark, root.rstrip("/"), keys, seq, width
        self._jvm = spark.sparkContext._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def version(self) -> int:
        folder = self._path("manifest")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max([int(n[:-5]) for n in names if n.endswith(".json")], default=0)

    def _manifest(self, version: int) -> dict:
        if version == 0:
            return {"outputs": [], "intervals": None}
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.root}/manifest/{version}.json").collect()))

    def intervals(self, version: int | None = None) -> DataFrame | None:
        entry = self._manifest(self.version() if version is None else version)["intervals"]
        return self.spark.read.parquet(f"{self.root}/intervals/{entry}") if entry else None

    def output(self) -> DataFrame | None:
        done = self._manifest(self.version())["outputs"]
        return self.spark.read.parquet(*[f"{self.root}/output/{x}" for x in done]) if done else None

    def pending(self, rows: DataFrame) -> DataFrame:
        """Rows whose sequence number lies in no processed interval; rows without one are never pending."""
        rows = rows.where(F.col(self.seq).isNotNull())
        done = self.intervals()
        if done is None:
            return rows
        found = in_intervals(rows, done.withColumn("__there", F.lit(True)), self.keys, self.seq, ["__there"], self.width, "__hit")
        return found.where("__hit is null").drop("__hit")

    def open_gaps(self, ranges: DataFrame) -> DataFrame:
        """`ranges` (keys, lo, hi and more columns), each cut to what no processed interval covers."""
        done = self.intervals()
        if done is None:
            return ranges
        more = [c for c in ranges.columns if c not in (*self.keys, "lo", "hi")]
        ranges = checkpointed(ranges)
        covered = ranges.select(*self.keys, *more).join(done.select(*self.keys, "lo", "hi"), self.keys)
        return subtract_intervals(ranges, covered, [*self.keys, *more])

    def commit(self, output: DataFrame, handled: DataFrame) -> int:
        """Publish `output` and the intervals (keys, lo, hi) it covers; returns the new version."""
        base = self.version()
        run = uuid.uuid4().hex
        output.write.parquet(f"{self.root}/output/{run}")
        before = self.intervals(base)
        merged = merge_intervals(handled if before is None else before.unionByName(handled.select(before.columns)), self.keys)
        merged.write.parquet(f"{self.root}/intervals/{run}")
        entry = {"outputs": [*self._manifest(base)["outputs"], run], "intervals": run}
        self._fs.mkdirs(self._path("manifest"))
        final = self._path("manifest", f"{base + 1}.json")
        claim = self._path("manifest", f"{base + 1}.claim")
        try:  # creating without overwriting is atomic: of two writers of a version one fails here
            self._fs.create(claim, False).close()
        except Py4JJavaError as error:
            if self._fs.exists(final) or self._age(claim) < self.stale_ms:
                raise ConcurrentCommit(f"version {base + 1} of {self.root} is taken") from error
        staged = self._path("manifest", f".{run}.tmp")
        stream = self._fs.create(staged, False)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        if self._fs.exists(final) or not self._fs.rename(staged, final):
            self._fs.delete(staged, False)
            raise ConcurrentCommit(f"version {base + 1} of {self.root} exists already")
        return base + 1

    stale_ms = 600_000  # a claim without its manifest that is older than this was left by a writer that died

    def _age(self, path) -> float:
        return time.time() * 1000 - self._fs.getFileStatus(path).getModificationTime()
