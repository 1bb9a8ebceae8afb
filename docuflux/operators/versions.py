"""Tables that change in place of a whole: a version names, for every bucket of every table, the folder
that holds it.

A change writes new folders for the buckets that it touches and then, in one rename, a manifest that
names them beside the untouched ones. Readers see the version before or the one after, never parts
of both; what a failed change has written is in no manifest. Of two changes made from the same
version one fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another change came first."""


def bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class Versions:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        path, files = self._path(*parts)
        return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []

    def number(self) -> int:
        """The newest version; 0 before the first."""
        return max((int(n[:-5]) for n in self._names("versions") if n.endswith(".json")), default=0)

    def manifest(self, number: int | None = None) -> dict:
        number = self.number() if number is None else number
        if not number:
            return {"version": 0, "tables": {}, "facts": {}}
        return json.loads(self.spark.read.text(f"{self.root}/versions/{number:09d}.json", wholetext=True).first()[0])

    def read(self, name: str, schema: str, buckets: list[int] | None = None, manifest: dict | None = None) -> DataFrame:
        """A table, or some of its buckets, as of a manifest (the newest if none is given)."""
        parts = (manifest or self.manifest())["tables"].get(name, {})
        paths = [f"{self.root}/{p}" for b, p in sorted(parts.items()) if buckets is None or int(b) in buckets]
        kind = T.StructType.fromDDL(schema)
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    def commit(self, base: dict, changes: dict[str, tuple[DataFrame | Callable[[dict, list[int]], DataFrame], list[int] | Callable[[dict], list[int]]]], facts: dict | Callable[[dict], dict]) -> dict:
        """The version after `base`: of each table the rows (with their `bucket`) that take the place of
        the named buckets. The tables are written first, then the manifest that swaps all of them. Rows, buckets
        and facts can be functions of the manifest as far as it is written, to be made from earlier tables (rows
        of its buckets, too); where such a function names none, nothing is written."""
        tables = {name: dict(parts) for name, parts in base["tables"].items()}
        for name, (rows, touched) in changes.items():
            if callable(touched) and not (touched := touched({"tables": tables})):
                continue
            rows = rows({"tables": tables}, touched) if callable(rows) else rows
            folder = f"{name}/{base['version'] + 1}-{uuid.uuid4().hex[:8]}"
            rows.write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
            parts = {k: v for k, v in tables.get(name, {}).items() if int(k) not in touched}
            written = {n.split("=")[1]: f"{folder}/{n}" for n in self._names(folder) if n.startswith("bucket=")}
            if stray := {int(b) for b in written} - set(touched):
                raise ValueError(f"rows of {name} in buckets that are not replaced: {sorted(stray)[:5]}")
            tables[name] = parts | written
        new = {"version": base["version"] + 1, "tables": tables, "facts": facts({"tables": tables}) if callable(facts) else facts}
        self._swap(new)
        return new

    def _swap(self, manifest: dict) -> None:
        ready, files = self._path("versions", f".{uuid.uuid4().hex}")
        out = files.create(ready, False)
        out.write(json.dumps(manifest).encode())
        out.close()
        target, _ = self._path("versions", f"{manifest['version']:09d}.json")
        if files.exists(target) or not files.rename(ready, target):
            files.delete(ready, False)
            raise Conflict(f"version {manifest['version']} exists")

    def vacuum(self, keep: int = 2) -> int:
        """Deletes folders that none of the newest `keep` versions names; their number. Not while a change is under way."""
        newest = self.number()
        kept = [self.manifest(n) for n in range(max(1, newest - keep + 1), newest + 1)]
        named = {p.rpartition("/")[0] for m in kept for parts in m["tables"].values() for p in parts.values()}
        gone = 0
        for name in {t for m in kept for t in m["tables"]}:
            for folder in self._names(name):
                if f"{name}/{folder}" not in named:
                    path, files = self._path(name, folder)
                    gone += bool(files.delete(path, True))
        return gone


def buckets_of(rows: DataFrame) -> list[int]:
    """The distinct buckets of rows: as many as a table has at most."""
    return sorted(r[0] for r in rows.select("bucket").distinct().collect())


# documents and their chunks ---------------------------------------------------------------------

CHUNKS, STATES = "doc_id long, place int, chunk_hash string, text string", "doc_id long, content_hash string, status string, n_chunks int"


def replace_documents(store: Versions, chunks: DataFrame, states: DataFrame) -> dict:
    """Puts whole documents in the place of those of the same id: their chunk sets (chunks: CHUNKS),
    content hashes and statuses (states: STATES, but for n_chunks) change at once. A document in
    `states` without chunks loses its own; chunks of documents that `states` lacks are left out.
    Documents of one content hash as before are left as they are."""
    base, spread = store.manifest(), lambda rows: rows.withColumn("bucket", bucket("doc_id", store.buckets))
    known = store.read("states", STATES, manifest=base)
    same = known.select("doc_id", F.col("content_hash").alias("_hash"), F.col("status").alias("_status"))
    # of rows that share an id the one of least hash counts
    one = states.groupBy("doc_id").agg(F.min(F.struct("content_hash", "status")).alias("s")).select("doc_id", "s.*")
    new = one.join(same, "doc_id", "left").filter(~(F.col("content_hash").eqNullSafe(F.col("_hash")) & F.col("status").eqNullSafe(F.col("_status")))).drop("_hash", "_status")
    own = chunks.join(new.select("doc_id"), "doc_id", "left_semi").select("doc_id", "place", "chunk_hash", "text")
    counts = own.groupBy("doc_id").agg(F.count("*").cast("int").alias("n_chunks"))
    state = new.join(counts, "doc_id", "left").select("doc_id", "content_hash", "status", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))
    touched = buckets_of(spread(new))
    if not touched:
        return base
    def kept(name: str, schema: str) -> DataFrame:
        return store.read(name, schema, touched, base).join(new.select("doc_id"), "doc_id", "left_anti")

    return store.commit(base, {"chunks": (spread(kept("chunks", CHUNKS).unionByName(own)), touched), "states": (spread(kept("states", STATES).unionByName(state)), touched)}, base["facts"])
