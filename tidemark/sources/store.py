"""A store of summarised streams: Parquet tables in a folder that all machines share.

A version of the store is one small file that names the version, the registered
streams, the last streaming batch and the folders that hold the tables.  It is
written beside and put in place by a rename that fails where another writer was
first; until then nothing of an append can be seen, and a failed append leaves
folders that no version names.  Rows are kept in PARTS by stream: an append writes
the parts of its own streams anew and keeps the folders of all others.  Landmark
values are only ever added to.
"""

from __future__ import annotations

import json
import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import build, estimator
from ..operators.specs import Operator, parse_operator
from ..plans.layout import buffer_size, parse_decay
from . import streams as element_sources

PARTS = 64
#: Tables that an append writes anew for its streams, and their columns.
TABLES = {
    "windows": "stream_id long, cs long, ce long, ts long, te long, count long, sum long, max long, hll binary, kll binary",
    "sums": "stream_id long, n long, first_ts long, last_ts long, vs double, vss double, gss double",
    "cells": "stream_id long, cs long, row int, col long, n long",
    "bits": "stream_id long, cs long, bucket long, bitmap binary",
    "marks": "stream_id long, ts long, te long",
}
VALUES = "stream_id long, ts long, value long"
#: Kinds that windows always answer.
PLAIN = ("COUNT", "SUM", "MAX")
OPTIONS = "stream_id long, decay string, buffer long, kind_hll boolean, kind_kll boolean, depth int, width int, hashes int, bits int"


class StreamError(Exception):
    pass


def scratch(spark: SparkSession) -> str:
    """The folder for stores of queries: the one that the cluster shares; a local session without one has a folder of the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.master.startswith("local"):
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    if not found:
        raise StreamError("spark.checkpoint.dir must name a folder that driver and executors share")
    return found.rstrip("/")


class Store:
    """readonly: nothing is ever written, and a missing store is an error.  cache: tables that are read stay in memory until unload()."""

    def __init__(self, spark: SparkSession, path: str, readonly: bool = False, cache: bool = False):
        self.spark, self.path, self.readonly, self.cache = spark, path.rstrip("/"), readonly, cache
        self._unloaded: set[int] = set()
        self._cached: dict[tuple, DataFrame] = {}
        self._jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)
        if readonly and not self._fs.exists(self._at("log")):
            raise StreamError(f"there is no store in {path}")

    def _at(self, name: str):
        return self._jvm.Path(f"{self.path}/{name}" if name else self.path)

    def _writable(self) -> None:
        if self.readonly:
            raise StreamError("the store is read-only")

    # small files

    def _put(self, name: str, text: str, replace: bool) -> None:
        """A file that is there whole or not at all."""
        aside = self._at(f"tmp/{uuid.uuid4().hex}")
        out = self._fs.create(aside, True)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.mkdirs(self._at(name).getParent())
        rename = self._jvm.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE if replace else rename.NONE
        try:
            self._jvm.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(aside, self._at(name), how)
        except Exception as e:
            self._fs.delete(aside, False)
            if "FileAlreadyExists" in str(e):
                raise StreamError("another writer was first; try again") from None
            raise

    def _read(self, name: str) -> str | None:
        at = self._at(name)
        if not self._fs.exists(at):
            return None
        return "\n".join(r.value for r in self.spark.read.text(at.toString(), wholetext=True).collect())  # one small file

    def put_aux(self, key: str, value: str) -> None:
        self._writable()
        self._put(f"aux/{key}", value, True)

    def get_aux(self, key: str) -> str | None:
        return self._read(f"aux/{key}")

    # versions

    def _versions(self) -> list[int]:
        if not self._fs.exists(self._at("log")):
            return []
        return sorted(int(f.getPath().getName().split(".")[0]) for f in self._fs.listStatus(self._at("log")) if f.getPath().getName().endswith(".json"))

    def _state(self, version: int | None = None) -> dict:
        known = self._versions()
        if version is None:
            version = known[-1] if known else 0
        if version not in known:
            return {"version": 0, "batch": -1, "late": 0, "streams": {}, "tables": {t: {} for t in TABLES}, "values": []}
        return json.loads(self._read(f"log/{version:012d}.json"))

    def _commit(self, state: dict) -> None:
        self._put(f"log/{state['version'] + 1:012d}.json", json.dumps(state | {"version": state["version"] + 1}), False)
        self.unload_cache()

    def batch(self) -> int:
        """The number of the last streaming batch that is in the store."""
        return self._state()["batch"]

    def late(self) -> int:
        """Elements that streaming ingest left out since they were late."""
        return self._state()["late"]

    def vacuum(self, keep: int = 2) -> int:
        """Deletes versions but the last ones, and folders that none of these names; how many folders went."""
        self._writable()
        known = self._versions()
        live = set()
        for v in known[-keep:]:
            s = self._state(v)
            live |= {p.split("/part=")[0] for t in s["tables"].values() for p in t.values()} | set(s["values"])
        for v in known[:-keep]:
            self._fs.delete(self._at(f"log/{v:012d}.json"), False)
        gone = 0
        for name in (*TABLES, "values"):
            for f in self._fs.listStatus(self._at(name)) if self._fs.exists(self._at(name)) else []:
                if f"{name}/{f.getPath().getName()}" not in live:
                    self._fs.delete(f.getPath(), True)
                    gone += 1
        self._fs.delete(self._at("tmp"), True)
        return gone

    # streams

    def registry(self) -> dict[int, dict]:
        return {int(k): v for k, v in self._state()["streams"].items()}

    def register(self, stream_id: int, decay: str, operators: list[str], buffer: int = 0) -> bool:
        """False where the stream is there already.  buffer: elements of its two buffers, which are cut into windows when full or at a batch's end."""
        self._writable()
        parse_decay(decay)
        for o in operators:
            parse_operator(o)
        state = self._state()
        if str(stream_id) in state["streams"]:
            return False
        state["streams"][str(stream_id)] = {"decay": decay, "operators": operators, "buffer": buffer}
        self._commit(state)
        return True

    def set_buffer(self, stream_id: int, buffer: int) -> None:
        """0: elements that come later are windows of their own at once."""
        self._writable()
        state = self._state()
        self._known(state, stream_id)["buffer"] = buffer
        self._commit(state)

    @staticmethod
    def _known(state: dict, stream_id: int) -> dict:
        if str(stream_id) not in state["streams"]:
            raise StreamError(f"unknown stream {stream_id}")
        return state["streams"][str(stream_id)]

    def operator_index(self, stream_id: int, kind: str) -> int:
        kinds = [parse_operator(o).kind for o in self._known(self._state(), stream_id)["operators"]]
        if kind not in kinds:
            raise StreamError(f"stream {stream_id} has no {kind}")
        return kinds.index(kind)

    @staticmethod
    def _operators(stream: dict) -> dict[str, Operator]:
        return {o.kind: o for o in map(parse_operator, reversed(stream["operators"]))}

    def _options(self, state: dict) -> DataFrame:
        """A row for each stream; as the registry, it is as long as the streams are many."""
        rows = []
        for k, s in state["streams"].items():
            ops = self._operators(s)
            cms, bloom = ops["CMS"].params or build.CMS if "CMS" in ops else (None, None), ops["BLOOM"].params or build.BLOOM if "BLOOM" in ops else (None, None)
            size = buffer_size(parse_decay(s["decay"]), s["buffer"]) if s["buffer"] else 0
            rows.append((int(k), s["decay"], size, "DISTINCT" in ops, "FREQ" in ops, *cms, *bloom))
        return self.spark.createDataFrame(rows, OPTIONS)

    def unload(self, stream_id: int) -> None:
        """Queries of the stream fail until load()."""
        self._known(self._state(), stream_id)
        self._unloaded.add(stream_id)
        self.unload_cache()

    def load(self, stream_id: int) -> None:
        self._known(self._state(), stream_id)
        self._unloaded.discard(stream_id)

    def unload_cache(self) -> None:
        for frame in self._cached.values():
            frame.unpersist()
        self._cached = {}

    close = unload_cache

    # tables

    def table(self, name: str, state: dict | None = None) -> DataFrame:
        state = state or self._state()
        paths = state["values"] if name == "values" else sorted(state["tables"][name].values())
        schema = VALUES if name == "values" else TABLES[name]
        if not paths:
            return self.spark.createDataFrame([], schema)
        key = (name, *paths)
        if key in self._cached:
            return self._cached[key]
        frame = self.spark.read.schema(schema).parquet(*(f"{self.path}/{p}" for p in paths))
        if self.cache:
            self._cached[key] = frame = frame.persist()
        return frame

    def _write(self, state: dict, name: str, frame: DataFrame, buckets: list[int]) -> None:
        """The rows of some buckets, anew."""
        folder = f"{name}/v{state['version'] + 1}-{uuid.uuid4().hex}"
        kind = [c.split(" ")[0] for c in TABLES[name].split(", ")]
        frame.select(*kind, _part().alias("part")).repartition("part").sortWithinPartitions("stream_id", kind[1]).write.partitionBy("part").parquet(f"{self.path}/{folder}")
        made = {int(f.getPath().getName().split("=")[1]) for f in self._fs.listStatus(self._at(folder)) if "=" in f.getPath().getName()}
        for b in buckets:
            state["tables"][name].pop(str(b), None)
            if b in made:
                state["tables"][name][str(b)] = f"{folder}/part={b}"

    def _of(self, state: dict, name: str, buckets: list[int]) -> DataFrame:
        few = state | {"tables": state["tables"] | {name: {b: p for b, p in state["tables"][name].items() if int(b) in buckets}}}
        return self.table(name, few)

    # appending

    def append(self, elements: DataFrame, landmarks: DataFrame | None = None, batch: int | None = None, late: int = 0, equal: str = "error") -> None:
        """Adds elements of registered streams, later than all that are there.

        equal: what to do with several elements of a stream at one time.  error: raise;
        keep: all are elements, and some may be at the last time that is there.

        Elements with a true is_landmark take a place in their window and are kept as
        they are; landmarks (stream_id, ts, te; a null te has not ended) replaces the
        open landmark of a stream and adds to the others.  All or nothing is added.
        """
        self._writable()
        state = self._state()
        new = build.checked(elements, equal)
        new = self._materialised(new, state)
        sums = new.groupBy("stream_id").agg(F.count("*").alias("k"), F.min("ts").alias("first"), F.max("ts").alias("last"))
        options = self._options(state)
        if sums.join(options, "stream_id", "left_anti").limit(1).count():
            raise StreamError("unknown stream")
        touched = sums.select("stream_id") if landmarks is None else sums.select("stream_id").unionByName(landmarks.select(F.col("stream_id").cast("long")))
        buckets = sorted(r.b for r in touched.select(_part().alias("b")).distinct().collect())  # PARTS numbers at most
        if not buckets:
            if batch is not None or late:
                self._commit(state | {"batch": state["batch"] if batch is None else batch, "late": state["late"] + late})
            return
        had = {name: self._of(state, name, buckets) for name in TABLES}
        if sums.join(had["sums"], "stream_id").filter("first < last_ts" if equal == "keep" else "first <= last_ts").limit(1).count():
            raise StreamError("times must strictly increase in a stream")
        try:
            self._add(state, new, sums, options, had, buckets, landmarks)
        finally:
            self._fs.delete(self._jvm.Path(new.inputFiles()[0].rsplit("/", 1)[0]), True)
        self._commit(state | {"batch": state["batch"] if batch is None else batch, "late": state["late"] + late})

    def _materialised(self, new: DataFrame, state: dict) -> DataFrame:
        """The batch, written once for the tables that are made from it."""
        folder = f"{self.path}/tmp/batch-{uuid.uuid4().hex}"
        new.write.parquet(folder)
        return self.spark.read.schema(new.schema).parquet(folder)

    def _add(self, state, new, sums, options, had, buckets, landmarks) -> None:
        before = had["sums"].select("stream_id", F.col("n").alias("n0"))
        told = build.sliced(new)
        starts = build.slice_starts(told).join(before, "stream_id", "left").withColumn("shift", F.col("shift") + F.coalesce("n0", F.lit(0))).drop("n0")
        own = had["windows"].groupBy("stream_id").agg(F.collect_list(F.struct("cs", "ce")).alias("windows"))  # as many as the square root of the elements
        grown = sums.join(options, "stream_id").join(before, "stream_id", "left").join(own, "stream_id", "left")
        plan = build.extended(grown.select("stream_id", F.col("decay").alias("spec"), "buffer", F.coalesce("n0", F.lit(0)).alias("n"), F.col("k").alias("more"), "windows"))
        points = plan.select("stream_id", F.col("cs").alias("at"), F.struct("cs", "ce").alias("p"))
        moved = build.as_of(had["windows"].select("stream_id", F.col("cs").alias("at"), F.col("cs").alias("qid")), points).select("stream_id", F.col("qid").alias("cs"), F.col("p.cs").alias("to_cs"), F.col("p.ce").alias("to_ce"))
        place = lambda frame: frame.join(moved, ["stream_id", "cs"], "left").withColumn("cs", F.coalesce("to_cs", "cs"))
        members = build.placed(told, starts, plan).join(F.broadcast(options), "stream_id")  # as long as the registry
        some = members.withColumn("h", F.when(F.col("kind_hll"), F.col("value"))).withColumn("q", F.when(F.col("kind_kll"), F.col("value")))
        single = build.summarise(some, "h", "q")
        old = place(had["windows"]).withColumn("ce", F.coalesce("to_ce", "ce")).select(single.columns)
        self._write(state, "windows", build.merge_windows(old.unionByName(single)), buckets)
        kinds = {k for s in state["streams"].values() for k in self._operators(s)}
        if "CMS" in kinds:
            cells = build.cms_cells(members.filter("depth is not null"), "depth", "width").withColumn("row", F.col("row").cast("int"))
            cells = place(had["cells"]).select(cells.columns).unionByName(cells).groupBy("stream_id", "cs", "row", "col").agg(F.sum("n").alias("n"))
            self._write(state, "cells", cells, buckets)
        if "BLOOM" in kinds:
            bits = build.bloom_bits(members.filter("hashes is not null"), "hashes", "bits")
            bits = place(had["bits"]).select(bits.columns).unionByName(bits).groupBy("stream_id", "cs", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
            self._write(state, "bits", bits, buckets)
        self._write(state, "sums", self._sums(new, had["sums"]), buckets)
        if landmarks is not None:
            fresh = landmarks.select(F.col("stream_id").cast("long"), F.col("ts").cast("long"), F.col("te").cast("long"))
            done = had["marks"].join(fresh.select("stream_id").distinct().withColumn("fresh", F.lit(True)), "stream_id", "left").filter("te is not null or fresh is null").drop("fresh")
            self._write(state, "marks", done.unionByName(fresh), buckets)
        values = f"values/v{state['version'] + 1}-{uuid.uuid4().hex}"
        new.filter("is_landmark").select("stream_id", "ts", "value").write.parquet(f"{self.path}/{values}")
        state["values"].append(values)

    def _sums(self, new: DataFrame, old: DataFrame | None) -> DataFrame:
        s = build.stream_stats(new)
        vs = F.col("value_mean") * F.col("n")
        own = s.select("stream_id", "n", "first_ts", "last_ts", vs.alias("vs"), ((F.col("value_sd") ** 2) * (F.col("n") - 1) + vs * F.col("value_mean")).alias("vss"), ((F.col("gap_sd") ** 2) * F.greatest(F.col("n") - 2, F.lit(0)) + (F.col("gap_mean") ** 2) * (F.col("n") - 1)).alias("gss"))
        both = old.select(own.columns).withColumn("p", F.lit(0)).unionByName(own.withColumn("p", F.lit(1)))
        joint = (F.max(F.when(F.col("p") == 1, F.col("first_ts"))) - F.max(F.when(F.col("p") == 0, F.col("last_ts")))).cast("double")
        return both.groupBy("stream_id").agg(F.sum("n").alias("n"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("vs").alias("vs"), F.sum("vss").alias("vss"), (F.sum("gss") + F.coalesce(joint * joint, F.lit(0.0))).alias("gss"))

    def append_operations(self, operations: DataFrame, batch: int | None = None, late: int = 0) -> None:
        """Appends a stream of operations (stream_id, op, ts, value): elements, and starts and ends of landmarks.  A landmark that is open goes on in the next batch."""
        self._writable()
        known = self.table("marks").filter("te is null").select("stream_id", F.col("ts").alias("open_ts"))
        here = operations.groupBy(F.col("stream_id").cast("long").alias("stream_id")).agg(F.min("ts").alias("ts"))
        carried = here.join(known, "stream_id")
        start = carried.select("stream_id", F.lit("LANDMARK_START").alias("op"), F.least(F.col("ts") - 1, F.col("open_ts")).alias("ts"), F.lit(None).cast("long").alias("value"))
        told = operations.select(F.col("stream_id").cast("long"), "op", F.col("ts").cast("long"), F.col("value").cast("long")).unionByName(start)
        elements, marks = element_sources.from_operations(told)
        first = marks.join(carried.select("stream_id", "open_ts", F.least(F.col("ts") - 1, F.col("open_ts")).alias("ts")), ["stream_id", "ts"], "left")
        self.append(elements, first.select("stream_id", F.coalesce("open_ts", "ts").alias("ts"), "te"), batch, late)

    def append_now(self, values: DataFrame) -> None:
        """Appends (stream_id, value) at the time of the clock in milliseconds; of several values of a stream, each a millisecond later."""
        v = values.select(F.col("stream_id").cast("long"), F.col("value").cast("long"))
        order = Window.partitionBy("stream_id").orderBy("value")
        now = F.lit(int(time.time() * 1000))
        last = self.table("sums").select("stream_id", "last_ts")
        at = F.greatest(now, F.coalesce(F.col("last_ts") + 1, now)) + F.row_number().over(order) - 1
        self.append(v.join(last, "stream_id", "left").select("stream_id", at.alias("ts"), "value"))

    # reading

    def stats(self) -> DataFrame:
        s = self.table("sums")
        n, gaps = F.col("n"), F.col("n") - 1
        sd = lambda ss, total, k: F.when(k > 1, F.sqrt(F.greatest((ss - total * total / k) / (k - 1), F.lit(0.0)))).otherwise(0.0)
        span = (F.col("last_ts") - F.col("first_ts")).cast("double")
        out = s.withColumn("gap_mean", F.when(gaps > 0, span / gaps).otherwise(0.0)).withColumn("value_mean", F.col("vs") / n).withColumn("gap_sd", sd(F.col("gss"), span, gaps)).withColumn("value_sd", sd(F.col("vss"), F.col("vs"), n))
        cv = lambda a: F.when(F.col(f"{a}_mean") != 0, F.col(f"{a}_sd") / F.col(f"{a}_mean")).otherwise(0.0)
        return out.withColumn("gap_cv", cv("gap")).withColumn("value_cv", cv("value")).drop("vs", "vss", "gss")

    def _loaded(self, frame: DataFrame) -> DataFrame:
        return frame.filter(~F.col("stream_id").isin(*self._unloaded)) if self._unloaded else frame

    def windows(self) -> DataFrame:
        return self._loaded(self.table("windows"))

    def landmarks(self) -> DataFrame:
        """Landmark windows, te null where one has not ended, with the number and the values' sum of each."""
        end, v = F.coalesce("te", F.lit(estimator.END_OF_TIME)), self.table("values").select("stream_id", "ts", F.lit(1).cast("long").alias("n_values"), F.col("value").alias("sum_values"))
        m = build.running(self.table("marks").withColumn("qid", F.concat_ws(":", "stream_id", "ts", end)), {"b": end, "a": F.col("ts") - 1}, v, "n_values", "sum_values")
        inside = {c: F.coalesce(f"b.{c}", F.lit(0)) - F.coalesce(f"a.{c}", F.lit(0)) for c in ("n_values", "sum_values")}
        return self._loaded(m.select("stream_id", "ts", "te", *(x.alias(c) for c, x in inside.items())))

    def window_counts(self) -> DataFrame:
        marks = self.table("marks").groupBy("stream_id").agg(F.count("*").alias("n_landmarks"))
        return self.windows().groupBy("stream_id").agg(F.count("*").alias("n_windows")).join(marks, "stream_id", "left").fillna(0, ["n_landmarks"])

    def window(self, stream_id: int, cs: int) -> DataFrame:
        """One window by its first count, read from its stream's part alone."""
        state = self._state()
        part = self.spark.range(1).select(_part(F.lit(stream_id).cast("long")).alias("b")).first().b
        return self._of(state, "windows", [part]).filter((F.col("stream_id") == stream_id) & (F.col("cs") == cs))

    def _change_window(self, stream_id: int, cs: int, row: DataFrame | None) -> None:
        self._writable()
        state = self._state()
        self._known(state, stream_id)
        part = self.spark.range(1).select(_part(F.lit(stream_id).cast("long")).alias("b")).first().b
        rest = self._of(state, "windows", [part]).filter((F.col("stream_id") != stream_id) | (F.col("cs") != cs))
        self._write(state, "windows", rest if row is None else rest.unionByName(row.select(rest.columns)), [part])
        self._commit(state)

    def put_window(self, row: DataFrame) -> None:
        """Puts one window (all columns of windows()) in the place of the one with its stream and first count."""
        key = row.select("stream_id", "cs").first()
        self._change_window(key.stream_id, key.cs, row)

    def delete_window(self, stream_id: int, cs: int) -> None:
        self._change_window(stream_id, cs, None)

    def describe(self) -> DataFrame:
        """What the store holds: stream_id, kind (window or landmark), ts, te, cs, ce, count, sum, max."""
        none = F.lit(None).cast("long")
        w = self.windows().select("stream_id", F.lit("window").alias("kind"), "ts", "te", "cs", "ce", "count", "sum", "max")
        m = self.landmarks().select("stream_id", F.lit("landmark").alias("kind"), "ts", "te", none.alias("cs"), none.alias("ce"), F.col("n_values").alias("count"), F.col("sum_values").alias("sum"), none.alias("max"))
        return w.unionByName(m).orderBy("stream_id", "ts", "kind")

    def query(self, queries: DataFrame, kind: str, confidence: float = 0.95, **params) -> DataFrame:
        """Answers a table (qid, stream_id, l, r) of queries of one kind.

        COUNT, SUM, MEAN, RANGE (low, high): qid, result, ci_low, ci_high.  MAX: qid, result, certain.
        THRESHOLD (threshold): qid, above.  CMS and BLOOM ask for the queries' own ``value``:
        as COUNT; qid, found, error.  DISTINCT, QUANTILE (q): qid, result.  Landmarks are
        the store's own.  A stream that is not known, not loaded, or has not the operator, raises.
        """
        state = self._state()
        need = {"RANGE": "FREQ", "QUANTILE": "FREQ", "CMS": "CMS", "BLOOM": "BLOOM", "DISTINCT": "DISTINCT"}.get(kind)
        if need is None and kind not in (*PLAIN, "MEAN", "THRESHOLD"):
            raise StreamError(f"no such query: {kind}")
        good = [k for k, s in ((int(k), s) for k, s in state["streams"].items()) if k not in self._unloaded and (need is None or need in self._operators(s))]
        options = self._options(state)
        bad = queries.select("stream_id").distinct().join(self.spark.createDataFrame([(k,) for k in good], "stream_id long"), "stream_id", "left_anti").first()
        if bad:
            raise StreamError(f"stream {bad.stream_id} is not known, not loaded or has no {kind}")
        w, s, v, m = self.table("windows", state), self.stats(), self.table("values", state), self.table("marks", state)
        marked = {} if not state["tables"]["marks"] else {"landmarks": m}
        ones = lambda frame: frame.select("stream_id", "ts", F.lit(1).alias("s"))
        count = lambda q: estimator.estimate(q, w, s, "count", estimator.count_multiplier(), confidence, landmark_values=ones(v), **marked)
        total = lambda q: estimator.estimate(q, w, s, "sum", estimator.sum_multiplier(), confidence, landmark_values=v.select("stream_id", "ts", F.col("value").alias("s")), **marked)
        if kind == "COUNT":
            return count(queries)
        if kind == "SUM":
            return total(queries)
        if kind == "MEAN":
            return estimator.mean(count(queries), total(queries))
        if kind in ("MAX", "THRESHOLD"):
            top = estimator.interval_max(queries, w, s, v)
            return top if kind == "MAX" else top.select("qid", F.coalesce(F.col("result") > params["threshold"], F.lit(False)).alias("above"))
        if kind == "DISTINCT":
            return estimator.distinct_count(queries, w, s, v)
        if kind == "QUANTILE":
            return estimator.quantile(queries, w, s, params["q"], v)
        if kind == "RANGE":
            return estimator.range_frequency(queries, w, s, params["low"], params["high"], confidence, landmark_values=v, **marked)
        size = ("depth", "width") if kind == "CMS" else ("hashes", "bits")
        asked = queries.join(options.select("stream_id", *size), "stream_id")
        answers = []
        for one in options.select(*size).filter(F.col(size[0]).isNotNull()).distinct().collect():  # as many as different operators
            mine = asked.filter((F.col(size[0]) == one[0]) & (F.col(size[1]) == one[1])).drop(*size)
            if kind == "CMS":
                answers.append(estimator.frequency(mine, w, self.table("cells", state), s, *one, confidence, landmark_values=v, **marked))
            else:
                answers.append(estimator.membership(mine, w, self.table("bits", state), s, *one, v))
        return reduce(DataFrame.unionByName, answers)


def _part(stream_id: Column | None = None) -> Column:
    return F.pmod(F.xxhash64(F.col("stream_id") if stream_id is None else stream_id), F.lit(PARTS)).cast("int")
