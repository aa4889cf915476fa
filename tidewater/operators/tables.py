"""Tables kept in hash buckets: a batch is added to the buckets in which its keys are new, rewrites those in which some are known, and no other.

A version of a table is one manifest: a small JSON file that names the folder of each bucket (or its folders, which hold
different keys), the last batch of each stream and the notes of the writer. A change writes new folders, then puts its manifest under
the next number by a rename that fails if the number is taken: a reader sees a version whole or not at all,
and of two writers at once one begins again from the other's version.

Cases: rows of one key in a batch count as if applied one by one; rows without a key are refused; an empty
batch gives no new version, unless it has a batch id or notes to remember; a batch id that is not above the stream's
last one changes nothing.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Parts of a bucket that may be dealt to tasks of their own; Spark joins those that are small.
SLICES = 64
#: Folders of a bucket; a batch that would bring more rewrites the bucket as one.
PARTS = 8


def parts(folders: str | list[str] | None) -> list[str]:
    """The folders of one bucket, as a manifest has them."""
    return folders if isinstance(folders, list) else [folders] if folders else []


class Conflict(RuntimeError):
    """Another writer has taken the next version."""


class Folder:
    """Files beside the tables, by Hadoop's file systems, so that any store that Spark reads will do."""

    def __init__(self, spark: SparkSession, root: str):
        self.root, self.gateway, self.jvm = root.rstrip("/"), spark.sparkContext._gateway, spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, name: str = "") -> list[str]:
        path = self._path(name)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def text(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str, replace: bool = False) -> bool:
        """Write a file whole under its name; False if there is one already and it may not be replaced."""
        held = f".{uuid.uuid4().hex}"
        stream = self.fs.create(self._path(held), False)
        try:
            stream.write(text.encode())
        finally:
            stream.close()
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.gateway.new_array(rename, int(replace))
        if replace:
            how[0] = rename.OVERWRITE
        files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        try:
            self.fs.mkdirs(self._path(name).getParent())
            files.rename(self._path(held), self._path(name), how)
            return True
        except Py4JJavaError as e:
            self.delete(held)
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                return False
            raise

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


class BucketedTable:
    """One table under a folder; `buckets` and `key` hold for its whole life."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType | str, buckets: int = 64, key: str = "id"):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key
        self.schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        self.folder = Folder(spark, root)
        self.buckets = self.manifest()["buckets"] if self.versions() else buckets

    def versions(self) -> list[int]:
        return [int(n.removeprefix("v").removesuffix(".json")) for n in self.folder.names("manifests") if n.startswith("v")]

    def version(self) -> int:
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "buckets": getattr(self, "buckets", 0), "folders": {}, "streams": {}, "notes": {}}
        return json.loads(self.folder.text(f"manifests/v{version:09d}.json"))

    def bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def dealt(self, rows: DataFrame):
        """Rows (with `bucket`) grouped by key after one shuffle by bucket and slice of the bucket: a task need not hold a whole bucket."""
        # another part of the hash than the one that gives the bucket
        sliced = rows.withColumn("slice", F.pmod(F.shiftright(F.xxhash64(self.key), 32), F.lit(SLICES)).cast("int"))
        return sliced.repartition("bucket", "slice").groupBy("bucket", "slice", self.key)

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """All rows of a version, or those of some buckets."""
        folders = self.manifest(version)["folders"]
        return self._of([f for b, held in folders.items() if buckets is None or int(b) in set(buckets) for f in parts(held)])

    def _of(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema).limit(0)  # plans see that it is empty
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{f}" for f in folders])

    def buckets_of(self, rows: DataFrame) -> list[int]:
        """The buckets in which the keys of some rows lie."""
        return sorted(r["b"] for r in rows.select(self.bucket().alias("b")).distinct().collect())  # at most a row for each bucket

    def meeting(self, rows: DataFrame, buckets: list[int], base: dict | None = None) -> list[int]:
        """Of some buckets, those in which the table holds keys of some rows; only keys are read."""
        folders = (base or self.manifest())["folders"]
        held = [f for b in buckets for f in parts(folders.get(str(b)))]
        return self.buckets_of(rows.select(self.key).join(self._of(held).select(self.key), self.key, "left_semi")) if held else []

    def touched(self, since: int, version: int | None = None) -> list[int]:
        """Buckets that differ between two versions; all of them where the older one is gone."""
        known = self._known(since)
        return sorted(int(b) for b, f in self.manifest(version)["folders"].items() if known.get(b) != f)

    def _known(self, since: int) -> dict:
        return self.manifest(since)["folders"] if not since or since in self.versions() else {}

    def written(self, since: int) -> DataFrame:
        """Rows of the folders that version `since` has not, among them all that are new or other than in it."""
        known = self._known(since)
        return self._of([f for b, held in self.manifest()["folders"].items() for f in parts(held) if f not in parts(known.get(b))])

    def changes(self, since: int) -> DataFrame:
        """Rows that are new or other than in version `since`: only folders that differ are read."""
        if since and since not in self.versions():
            raise ValueError(f"version {since} is gone")
        if not since:
            return self.read()
        known, now = self._known(since), self.manifest()["folders"]
        # a bucket that still has its folders has got new keys only
        grown = {b: [f for f in parts(held) if f not in parts(known.get(b))] for b, held in now.items() if set(parts(known.get(b))) <= set(parts(held))}
        added = self._of([f for new in grown.values() for f in new])
        rewritten = [b for b in now if b not in grown]
        if not rewritten:
            return added
        rows = self.read(buckets=[int(b) for b in rewritten])
        whole = F.struct(*[f.name for f in self.schema])
        old = self.read(since, [int(b) for b in rewritten]).select(self.key, whole.alias("_old"))
        return added.unionByName(rows.join(old, self.key, "left").where(~F.col("_old").eqNullSafe(whole)).select(*rows.columns))

    def upsert(self, batch: DataFrame, updates: list[str], seq: str = "seq", stream: str | None = None, batch_id: int | None = None, notes: dict | None = None, tries: int = 5, once: bool = False) -> int:
        """Lay a batch over the table: new keys are inserted, known ones change in `updates` only.

        The last row of a key (by seq) gives the updated columns; a new key's other columns come from its
        first row. With a stream and a batch id the batch takes effect once, however often it comes. `once` says that the batch
        holds each key once, as rows of another table do: they are then written where they are, without a shuffle.
        Returns the version that holds it.
        """
        for _ in range(tries):
            base = self.manifest()
            if stream is not None and batch_id is not None and base["streams"].get(stream, -1) >= batch_id:
                return base["version"]
            if (done := self._commit(base, self._rewrite(base, batch, updates, seq, once), stream, batch_id, notes)) is not None:
                return done
        raise Conflict(f"{self.root}: other writers came first {tries} times")

    def _rewrite(self, base: dict, batch: DataFrame, updates: list[str], seq: str, once: bool = False) -> dict[str, str | list[str]]:
        """Folders of the buckets that the batch touches.

        The batch is written once, after one shuffle by bucket and key (rows of one key meet before it, so that a key with many
        rows costs one row a task). That is all where its keys are new; buckets in which some are known are then rewritten.
        """
        fixed = [f.name for f in self.schema if f.name != self.key and f.name not in updates]
        pick = lambda names: F.struct(*names) if names else F.struct(F.lit(0).alias("_none"))
        scratch = f"data/{uuid.uuid4().hex}"
        dealt = batch.withColumn("bucket", self.bucket())
        value = F.col
        if not once:
            dealt = dealt.groupBy("bucket", self.key).agg(F.max_by(pick(updates), seq).alias("last"), F.min_by(pick(fixed), seq).alias("first"))
            value = lambda c: F.col(c) if c == self.key else F.col(f"last.{c}" if c in updates else f"first.{c}").alias(c)
        dealt.select("bucket", *[value(f.name) for f in self.schema]).write.partitionBy("bucket").parquet(f"{self.root}/{scratch}/rows")
        made = {n.removeprefix("bucket="): f"{scratch}/rows/{n}" for n in self.folder.names(f"{scratch}/rows") if n.startswith("bucket=")}
        keyless = made and not self._of(list(made.values())).where(F.col(self.key).isNull()).isEmpty()
        if keyless or not made:
            self.folder.delete(scratch)
        if keyless:
            raise ValueError(f"rows without {self.key}")
        held = {b: parts(base["folders"].get(b)) for b in made}
        known = {str(b) for b in self.meeting(self._of(list(made.values())), [int(b) for b in made], base)} | {b for b in made if len(held[b]) >= PARTS}
        merged = self._merged(base, {b: made[b] for b in known}, updates) if known else {}
        for b in known:
            self.folder.delete(made[b])
        if made and known == set(made):
            self.folder.delete(scratch)
        return merged | {b: [*held[b], f] if held[b] else f for b, f in made.items() if b not in known}

    def _merged(self, base: dict, made: dict[str, str], updates: list[str]) -> dict[str, str]:
        """New folders of buckets, with the rows of a written batch laid over those of the table."""
        others = [f.name for f in self.schema if f.name != self.key]
        side = lambda rows, name: rows.select(self.bucket().alias("bucket"), self.key, F.struct(*others).alias(name))
        old, new = side(self.read(base["version"], [int(b) for b in made]), "old"), side(self._of(list(made.values())), "new")
        both = old.unionByName(new, allowMissingColumns=True)
        # one shuffle: grouping by key within it and writing by bucket need no other
        dealt = self.dealt(both).agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("old", "new")])
        pick = lambda one, two, c: F.when(F.col(one).isNotNull(), F.col(f"{one}.{c}")).otherwise(F.col(f"{two}.{c}")).alias(c)
        value = lambda c: pick("new", "old", c) if c in updates else pick("old", "new", c)
        scratch = f"data/{uuid.uuid4().hex}"
        dealt.select("bucket", *[F.col(f.name) if f.name == self.key else value(f.name) for f in self.schema]).write.partitionBy("bucket").parquet(f"{self.root}/{scratch}/rows")
        return {b: f"{scratch}/rows/bucket={b}" for b in made}

    def _commit(self, base: dict, folders: dict[str, str | list[str]], stream: str | None, batch_id: int | None, notes: dict | None) -> int | None:
        if not folders and batch_id is None and not notes:
            return base["version"]
        version = base["version"] + 1
        streams = base["streams"] | ({stream: batch_id} if stream is not None and batch_id is not None else {})
        made = {"version": version, "buckets": self.buckets, "folders": base["folders"] | folders, "streams": streams, "notes": base["notes"] | (notes or {})}
        if self.folder.put(f"manifests/v{version:09d}.json", json.dumps(made)):
            return version
        held = {f for x in base["folders"].values() for f in parts(x)}
        for f in {f.split("/rows/")[0] for x in folders.values() for f in parts(x) if f not in held}:
            self.folder.delete(f)
        return None

    def vacuum(self, keep: int = 2) -> int:
        """Forget all but the newest `keep` versions and delete the folders that none of them names.

        Run it while nobody writes: folders of a change under way are not named yet. Returns how many went.
        """
        versions = sorted(self.versions())
        kept = versions[-max(1, keep) :]
        named = {f for v in kept for x in self.manifest(v)["folders"].values() for f in parts(x)}
        gone = 0
        for v in versions[: len(versions) - len(kept)]:
            self.folder.delete(f"manifests/v{v:09d}.json")
        for change in self.folder.names("data"):
            for bucket in self.folder.names(f"data/{change}/rows"):
                name = f"data/{change}/rows/{bucket}"
                if bucket.startswith("bucket=") and name not in named:
                    self.folder.delete(name)
                    gone += 1
            if not any(f.startswith(f"data/{change}/") for f in named):
                self.folder.delete(f"data/{change}")
        return gone
