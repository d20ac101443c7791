"""A versioned Parquet store: immutable versions, exclusive epochs, a cold tier (K-01 to K-13, S-01 to S-03, S-11).

A version of a table is one or more folders. ``_epoch-N.json`` names the folders of every table as of epoch N; it comes into
being whole and only once, by a rename that refuses to overwrite, so of two writers of one epoch one fails. Readers keep the
version they opened; nothing is overwritten in place. A table may be laid out in buckets of a column's hash, so that a change
of few ids writes few buckets, and may have a key: then parts appended to it are folded by the key on reading. Pointers and
lock are small files beside the data, handled through Hadoop's file system, so a store may lie on any file system the
cluster has whose rename is atomic.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from memloom.functions import vec

FORMAT_VERSION = 2
#: Bytes a file should have after compaction.
TARGET_BYTES = 128 * 1024 * 1024


class StaleEpoch(Exception):
    """The store moved on since it was read."""


class Locked(Exception):
    """Another writer holds the store."""


@dataclass
class Store:
    """A store at ``root`` (any URI Hadoop knows)."""

    spark: SparkSession
    root: str

    # -- files
    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _read_text(self, name: str) -> str | None:
        p, fs = self._fs(f"{self.root}/{name}")
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write_text(self, name: str, text: str, exclusive: bool = False) -> None:
        """Write a small file whole; with ``exclusive``, fail if it exists."""
        p, fs = self._fs(f"{self.root}/{name}.{uuid.uuid4().hex}")
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()
        jvm = self.spark._jvm.org.apache.hadoop.fs
        options = self.spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
        options[0] = jvm.Options.Rename.NONE if exclusive else jvm.Options.Rename.OVERWRITE
        context = jvm.FileContext.getFileContext(p.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(p, self._fs(f"{self.root}/{name}")[0], options)
        except Exception:
            fs.delete(p, False)
            raise

    # -- pointer
    def _epochs(self) -> list[int]:
        p, fs = self._fs(self.root)
        if not fs.exists(p):
            return []
        names = [x.getPath().getName() for x in fs.globStatus(self._fs(f"{self.root}/_epoch-*.json")[0])]
        return sorted(int(n[7:-5]) for n in names)

    def meta(self) -> dict:
        at = self._epochs()
        if not at:
            return {"format": FORMAT_VERSION, "epoch": 0, "tables": {}, "batches": {}, "layout": {}, "keys": {}, "schemas": {}}
        m = json.loads(self._read_text(f"_epoch-{at[-1]:012d}.json"))
        if m["format"] != FORMAT_VERSION:
            raise ValueError(f"a store of format {m['format']}, not {FORMAT_VERSION}")
        return m

    def _swing(self, before: dict, after: dict) -> int:
        """Make ``after`` the epoch that follows ``before``; refuses if another writer did so first."""
        n = before["epoch"] + 1
        if (now := self.epoch) != before["epoch"]:
            raise StaleEpoch(f"epoch {now}, expected {before['epoch']}")
        try:
            self._write_text(f"_epoch-{n:012d}.json", json.dumps(after | {"epoch": n}), exclusive=True)
        except Exception as e:
            raise StaleEpoch(f"epoch {n} was written by another") from e
        return n

    @property
    def epoch(self) -> int:
        at = self._epochs()
        return at[-1] if at else 0

    def exists(self, name: str) -> bool:
        return name in self.meta()["tables"]

    def parts(self, name: str) -> int:
        """Folders of a table that isn't laid out in buckets, 0 if there is none."""
        found = self.meta()["tables"].get(name, [])
        return len(found) if isinstance(found, list) else 1

    # -- reading
    def snapshot(self) -> "Snapshot":
        """What stands now, for reads that belong together and the write that follows from them."""
        return Snapshot(self, self.meta())

    def read(self, name: str) -> DataFrame:
        """S-01, S-03, K-04: the latest version of a table; unreadable files are passed over."""
        return self.snapshot().read(name)

    def partition(self, name: str, kern_id: str) -> DataFrame:
        """S-02: one partition's rows; of a table laid out by ``kern_id`` only its bucket is read."""
        return self.snapshot().partition(name, kern_id)

    def bucket_of(self, value: str, buckets: int) -> int:
        return self.spark.range(1).select(F.pmod(F.xxhash64(F.lit(value)), F.lit(buckets))).first()[0]

    # -- writing
    def commit(self, tables: dict[str, DataFrame], expected: int | None = None, partition_by: str | None = None, batch_id: str | None = None,
               append: bool | tuple[str, ...] = False, layout: dict[str, tuple[str, int]] | None = None, keys: dict[str, tuple[list[str], list[str]]] | None = None) -> int:
        """K-01, K-02: write new versions and the epoch that names them; refuses if the epoch isn't the expected one.

        ``expected`` is the epoch that was read; without it the epoch at the time of the call counts. ``append``: all tables, or those
        named, get a further part. ``layout`` gives tables buckets of a column; they keep it. ``keys`` gives tables a key and the columns
        by which the last row of a key is told. A batch id that was committed before is passed over, so a replayed
        micro-batch changes nothing.
        """
        before = self.meta()
        if expected is not None and before["epoch"] != expected:
            raise StaleEpoch(f"epoch {before['epoch']}, expected {expected}")
        if batch_id is not None and all(before["batches"].get(n) == batch_id for n in tables):
            return before["epoch"]
        laid, keyed, new = before["layout"] | {n: list(x) for n, x in (layout or {}).items()}, before["keys"] | {n: list(x) for n, x in (keys or {}).items()}, {}
        for name, df in tables.items():
            adds = append if isinstance(append, bool) else name in append
            held = before["tables"].get(name)
            if name in laid and laid[name][0] in df.columns and not adds:
                new[name] = self._write_buckets(name, df, before["epoch"] + 1, *laid[name])
                continue
            version = f"{name}/v{before['epoch'] + 1}-{uuid.uuid4().hex[:12]}"
            writer = df.write
            (writer.partitionBy(partition_by) if partition_by and partition_by in df.columns else writer).parquet(f"{self.root}/{version}")
            old = held if isinstance(held, list) else sorted({p for x in held.values() for p in x}) if held else []
            new[name] = [*old, version] if adds else [version]
        batches = before["batches"] | ({n: batch_id for n in tables} if batch_id is not None else {})
        kinds = {n: _fields(df, before["schemas"].get(n) if (append if isinstance(append, bool) else n in append) else None) for n, df in tables.items()}
        return self._swing(before, before | {"tables": before["tables"] | new, "batches": batches, "layout": laid, "keys": keyed, "schemas": before["schemas"] | kinds})

    def _write_buckets(self, name: str, df: DataFrame, epoch: int, column: str, buckets: int) -> dict[str, list[str]]:
        """Write ``df`` by buckets of a column; the folders of the buckets that have rows."""
        version = f"{name}/v{epoch}-{uuid.uuid4().hex[:12]}"
        at = df.withColumn("_bucket", F.pmod(F.xxhash64(F.col(column)), F.lit(buckets)).cast("int"))
        at.repartition(F.col("_bucket")).write.partitionBy("_bucket").parquet(f"{self.root}/{version}")
        found = self._fs(self.root)[1].globStatus(self._fs(f"{self.root}/{version}/_bucket=*")[0])
        return {x.getPath().getName().split("=")[1]: [f"{version}/{x.getPath().getName()}"] for x in found}

    def upsert(self, name: str, rows: DataFrame, key: str, delete: DataFrame | None = None, expected: int | None = None) -> int:
        """K-06: replace or add ``rows`` by their ``key`` and drop the keys of ``delete``. Of a table laid out by that key only the
        buckets concerned are read and written."""
        before = self.snapshot()
        if expected is not None and before.epoch != expected:
            raise StaleEpoch(f"epoch {before.epoch}, expected {expected}")
        ids = rows.select(key) if delete is None else rows.select(key).unionByName(delete.select(key))
        column, buckets = before.meta["layout"].get(name, [None, 0])
        held = before.meta["tables"].get(name)
        if column != key or not isinstance(held, dict):
            old = before.read(name).join(ids.distinct(), key, "left_anti") if held else rows.limit(0)
            return self.commit({name: old.unionByName(rows, allowMissingColumns=True)}, before.epoch)
        touched = [str(r[0]) for r in ids.select(F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int").alias("b")).distinct().collect()]  # at most the number of buckets
        paths = [p for b in touched for p in held.get(b, [])]
        new = before.open(paths, name).join(ids.distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True) if paths else rows
        fresh = self._write_buckets(name, new, before.epoch + 1, column, buckets)
        kept = {b: p for b, p in held.items() if b not in touched}
        kinds = before.meta["schemas"] | {name: _fields(rows, before.meta["schemas"].get(name))}
        return self._swing(before.meta, before.meta | {"tables": before.meta["tables"] | {name: kept | fresh}, "schemas": kinds})

    def replace(self, name: str, df: DataFrame, expected: int | None = None, batch_id: str | None = None) -> int:
        """K-01: a new version of one table; rows that aren't in it are gone."""
        return self.commit({name: df}, expected, batch_id=batch_id)

    def append(self, name: str, df: DataFrame, batch_id: str | None = None, expected: int | None = None) -> int:
        """K-07: add rows as a further part; of a table with a key the last row of each key is read."""
        return self.commit({name: df}, expected, batch_id=batch_id, append=True)

    def flush(self, name: str, build: Callable[[DataFrame | None], DataFrame], tries: int = 5) -> int:
        """K-03: build a version from what stands, and if the store moved on meanwhile, from what stands then."""
        for _ in range(tries):
            at = self.snapshot()
            try:
                return self.replace(name, build(at.read(name) if at.exists(name) else None), at.epoch)
            except StaleEpoch:
                continue
        raise StaleEpoch(f"gave up after {tries} tries")

    def upsert_partition(self, name: str, rows: DataFrame, kern_id: str) -> int:
        """K-06: the rows of one partition replaced; empty rows delete it. Of a table laid out by ``kern_id`` one bucket is written."""
        at = self.snapshot()
        column, buckets = at.meta["layout"].get(name, [None, 0])
        held = at.meta["tables"].get(name)
        stays = ~F.col("kern_id").eqNullSafe(F.lit(kern_id))
        if column != "kern_id" or not isinstance(held, dict):
            return self.flush(name, lambda old: rows if old is None else old.where(stays).unionByName(rows, allowMissingColumns=True))
        b = str(self.bucket_of(kern_id, buckets))
        others = at.open(held[b], name).where(stays) if b in held else rows.limit(0)
        fresh = self._write_buckets(name, others.unionByName(rows, allowMissingColumns=True), at.epoch + 1, column, buckets)
        kept = {k: v for k, v in held.items() if k != b}
        kinds = at.meta["schemas"] | {name: _fields(rows, at.meta["schemas"].get(name))}
        return self._swing(at.meta, at.meta | {"tables": at.meta["tables"] | {name: kept | fresh}, "schemas": kinds})

    def spill(self, rows: DataFrame, expected: int | None = None) -> int:
        """K-07: cold rows appended in one commit."""
        return self.append("cold_entities", rows, expected=expected)

    def cold(self) -> DataFrame:
        """S-03: the cold tier, the latest row of each id."""
        c = self.read("cold_entities")
        keep = [x for x in c.columns if x != "entity_id"]
        last = c.groupBy("entity_id").agg(F.max_by(F.struct(*keep), "spilled_at").alias("r"))
        return last.select("entity_id", "r.*")

    def compact(self, name: str, rows_per_file: int = 2_000_000) -> int:
        """K-09: one part of few, evenly filled files."""
        at = self.snapshot()
        df = at.read(name)
        return self.replace(name, df.repartition(max(1, -(-df.count() // rows_per_file))), at.epoch)

    def compress(self, name: str, column: str = "vector") -> int:
        """K-10: a version with int8 vectors in place of full ones; :func:`whole` restores them on reading."""
        at = self.snapshot()
        return self.replace(name, at.read(name).withColumn(f"{column}_int8", F.when(vec.usable(F.col(column)), vec.quantize_int8(F.col(column)))).drop(column), at.epoch)

    def register(self, other: "Store", merge: Callable[[DataFrame, DataFrame], DataFrame], name: str = "entities") -> int:
        """S-11, X-02: the union of another store's table and ours; refuses our own root and an empty store."""
        if other.root.rstrip("/") == self.root.rstrip("/"):
            raise ValueError("the same store")
        if not other.exists(name):
            raise ValueError("nothing to register")
        theirs = other.read(name)
        return self.flush(name, lambda ours: theirs if ours is None else merge(ours, theirs))

    def stamp(self, model: str, dim: int) -> str:
        """K-12: adopt the embedding model if there is none, else say whether it matches."""
        m = self.meta()
        if "embed" not in m:
            self._swing(m, m | {"embed": [model, dim]})
            return "adopted"
        return "match" if m["embed"] == [model, dim] else "mismatch"

    def vacuum(self, keep_epochs: int = 1) -> int:
        """Delete folders that none of the last ``keep_epochs`` epochs points at, and older epochs' files; how many folders."""
        at, n = self._epochs(), 0
        live = set()
        for e in at[-keep_epochs:]:
            for parts in json.loads(self._read_text(f"_epoch-{e:012d}.json"))["tables"].values():
                paths = parts if isinstance(parts, list) else [p for x in parts.values() for p in x]
                live |= {"/".join(p.split("/")[:2]) for p in paths}
        for name in self.meta()["tables"]:
            p, fs = self._fs(f"{self.root}/{name}")
            for status in fs.listStatus(p) if fs.exists(p) else []:
                if f"{name}/{status.getPath().getName()}" not in live:
                    n += fs.delete(status.getPath(), True)
        for e in at[:-keep_epochs]:
            p, fs = self._fs(f"{self.root}/_epoch-{e:012d}.json")
            fs.delete(p, False)
        return n

    # -- writer lock
    def lock(self, owner: str, stale_s: int = 3600) -> str:
        """K-13: hold the store for one writer; a lock not renewed for ``stale_s`` is taken over. Returns the token that renews it."""
        held = self._read_text("_lock")
        token = uuid.uuid4().hex
        mark = json.dumps({"owner": owner, "token": token, "at": time.time()})
        if held is None:
            try:
                self._write_text("_lock", mark, exclusive=True)
            except Exception as e:
                raise Locked("another writer") from e
        else:
            if time.time() - json.loads(held)["at"] <= stale_s:
                raise Locked(json.loads(held)["owner"])
            # of several who find it stale the one who removes it first goes on
            p, fs = self._fs(f"{self.root}/_lock")
            if self._read_text("_lock") != held or not fs.delete(p, False):
                raise Locked("another writer")
            return self.lock(owner, stale_s=3600)
        self._token = token
        return token

    def renew(self) -> None:
        """Heartbeat of the lock we hold; raises if it was taken over."""
        held = self._own_lock()
        self._write_text("_lock", json.dumps(held | {"at": time.time()}))

    def _own_lock(self) -> dict:
        held = json.loads(self._read_text("_lock") or "{}")
        if held.get("token") != getattr(self, "_token", None) or "token" not in held:
            raise Locked(held.get("owner", "nobody"))
        return held

    def unlock(self) -> None:
        """Give up the lock we hold; one that was taken over stays."""
        try:
            self._own_lock()
        except Locked:
            return
        p, fs = self._fs(f"{self.root}/_lock")
        fs.delete(p, False)


def _fields(df: DataFrame, before: dict | None = None) -> dict:
    """The schema of ``df``, and of fields that only an earlier part has."""
    kind = df.schema.jsonValue()
    for f in kind["fields"]:
        f["nullable"] = True
    known = {f["name"] for f in kind["fields"]}
    return kind | {"fields": kind["fields"] + [f for f in (before or {"fields": []})["fields"] if f["name"] not in known]}


@dataclass
class Snapshot:
    """The tables of a store as of one epoch."""

    store: Store
    meta: dict

    @property
    def epoch(self) -> int:
        return self.meta["epoch"]

    def exists(self, name: str) -> bool:
        return name in self.meta["tables"]

    def open(self, paths: list[str], name: str) -> DataFrame:
        """The folders of a table under its kept schema: no file is read to learn it, and a table may have no rows."""
        spark, kind = self.store.spark, StructType.fromJson(self.meta["schemas"][name])
        if not paths:
            return spark.createDataFrame([], kind)
        return spark.read.schema(kind).option("ignoreCorruptFiles", "true").parquet(*[f"{self.store.root}/{p}" for p in paths])

    def read(self, name: str) -> DataFrame:
        parts = self.meta["tables"][name]
        if isinstance(parts, dict):
            return self.open(sorted(p for x in parts.values() for p in x), name)
        df = self.open(parts, name)
        if name in self.meta["keys"] and len(parts) > 1:
            key, order = self.meta["keys"][name]
            rest = [c for c in df.columns if c not in key and c not in order]
            df = df.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("r")).select(*key, "r.*").select(df.columns)
        return df

    def partition(self, name: str, kern_id: str) -> DataFrame:
        column, buckets = self.meta["layout"].get(name, [None, 0])
        parts = self.meta["tables"][name]
        hit = F.col("kern_id") == kern_id
        if column != "kern_id" or not isinstance(parts, dict):
            return self.read(name).where(hit)
        own = parts.get(str(self.store.bucket_of(kern_id, buckets)))
        return self.open(own or [], name).where(hit)


def whole(df: DataFrame, column: str = "vector") -> DataFrame:
    """K-10: ``df`` with full vectors, restored from codes where only those were kept."""
    code = f"{column}_int8"
    if column in df.columns or code not in df.columns:
        return df
    return df.withColumn(column, F.when(F.col(code).isNotNull(), vec.dequantize_int8(F.col(code)))).drop(code)


def latest(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """The row of greatest ``order`` of each key."""
    keep = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*keep), order).alias("r")).select(key, "r.*")
