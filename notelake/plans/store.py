"""Where derived tables are written: the shared folder, and generations that readers see whole."""

from __future__ import annotations

import re
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new path below ``spark.checkpoint.dir``, with its scheme.

    Where that is unset, a temporary folder takes its place, one for each application and on a local master alone;
    a cluster without the setting is an error, because its machines do not see each other's folders.
    """
    base, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = context.applicationId
        if app not in _folders:
            _folders[app] = "file://" + tempfile.mkdtemp(prefix="notelake-")
        base = _folders[app]
    path = context._jvm.org.apache.hadoop.fs.Path(base)  # a path without a scheme is one of Spark's default file system
    whole = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"{whole.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = shared_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass(order=True, frozen=True)
class Marker:
    """A version: its number, its folder, the last version that it replaces (-1: it is added), the source's version it was made from."""

    nth: int
    token: str
    upto: int
    covers: int

    @property
    def file(self) -> str:
        return f"{self.token}.{self.upto}.{self.covers}.marker"

    @classmethod
    def of(cls, folder: str, file: str) -> Marker:
        token, upto, covers, _ = file.split(".")
        return cls(int(folder.removeprefix("nth=")), token, int(upto), int(covers))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def current(parts: DataFrame, newest: DataFrame | None, key: str) -> DataFrame:
    """Of ``parts`` (rows with their _place) those that ``newest`` (see ``Store.newest``) leaves."""
    if newest is None:
        return parts.drop("_place")
    known = parts.join(newest, key, "left")
    return known.where((F.col("_place") == F.coalesce("_newest", F.lit(0))) & ~F.coalesce("_gone", F.lit(False))).drop("_place", "_newest", "_gone")


class Store:
    """Tables below one folder, each in generations. A reader gets the last generation that was published whole."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def publish(self, name: str, df: DataFrame, generation: str) -> str:
        """Writes a generation, then its marker: a table without a marker is not seen."""
        path = f"{self.root}/{name}/generation={generation}"
        df.write.mode("overwrite").parquet(path)
        self.spark.createDataFrame([(generation,)], "generation string").write.mode("append").json(f"{self.root}/_published/{name}")
        return path

    def generations(self, name: str) -> DataFrame:
        return self.spark.read.schema("generation string").json(f"{self.root}/_published/{name}")

    def read(self, name: str, generation: str) -> DataFrame:
        if not self.generations(name).where(f"generation = '{generation}'").limit(1).count():
            raise LookupError(f"{name} has no generation {generation}")
        return self.spark.read.parquet(f"{self.root}/{name}/generation={generation}")

    # Tables that grow: whole versions, and what is added and taken out after them. A write goes to a folder of its own, and
    # is seen once its marker has the next number. Two writers may try for the same number; the marker of one of them is
    # there, and the other takes the number after it: what it wrote stays as it is.

    def _path(self, *parts: str):
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return path.getFileSystem(context._jsc.hadoopConfiguration()), path

    def _markers(self, name: str) -> list[Marker]:
        """The published versions of ``name``, by number: what the names of their files say."""
        system, path = self._path("_versions", name, "nth=*", "*.marker")
        found = system.globStatus(path)
        return sorted(Marker.of(x.getPath().getParent().getName(), x.getPath().getName()) for x in (found or []))

    def last(self, name: str) -> int:
        """The number of the last published version; 0 without any."""
        return max((m.nth for m in self._markers(name)), default=0)

    def _publish(self, name: str, token: str, upto: int, covers: int) -> int:
        """Gives the version in folder ``token`` the next free number."""
        jvm = self.spark.sparkContext._jvm
        while True:
            marker = Marker(self.last(name) + 1, token, upto, covers)
            system, draft = self._path("_versions", name, f"_draft-{token}")
            system.mkdirs(draft)
            system.create(jvm.org.apache.hadoop.fs.Path(draft, marker.file), True).close()
            _, place = self._path("_versions", name, f"nth={marker.nth:012d}")
            if not system.exists(place):
                system.rename(draft, place)  # of two that do this one becomes the folder, the other goes inside it or fails
            if system.exists(jvm.org.apache.hadoop.fs.Path(place, marker.file)):
                return marker.nth
            for lost in (jvm.org.apache.hadoop.fs.Path(place, draft.getName()), draft):
                if system.exists(lost):
                    system.delete(lost, True)

    def append(self, name: str, df: DataFrame, whole: bool = False, gone: DataFrame | None = None, covers: int = 0, upto: int | None = None, beside: dict[str, DataFrame] | None = None) -> int:
        """Writes ``df`` (with the keys ``gone`` and the tables ``beside`` it) as what comes after the last version, or ``whole`` in place of the versions up to ``upto``.

        ``upto`` is the last version that was read to make a whole one, the last there is by default: what others add
        meanwhile comes after it. ``covers`` names the version of another table that this one was made from.
        """
        token = uuid.uuid4().hex
        replaced = (self.last(name) if upto is None else upto) if whole else -1
        df.write.parquet(f"{self.root}/{name}/{token}/rows")
        for part, rows in {**(beside or {}), **({} if gone is None else {"gone": gone})}.items():
            rows.write.parquet(f"{self.root}/{name}/{token}/{part}")
        return self._publish(name, token, replaced, covers)

    def versions(self, name: str) -> list[Marker]:
        """The whole version that counts and those added after it; the first addition stands for a whole one where there is none."""
        markers = self._markers(name)
        wholes = [m for m in markers if m.upto >= 0]
        if not wholes:
            return markers
        base = max(wholes, key=lambda m: (m.upto, m.nth))
        return [base, *(m for m in markers if m.upto < 0 and m.nth > base.upto)]

    def parts(self, name: str, part: str = "rows") -> DataFrame | None:
        """One of the tables of ``name`` over the versions that count, with the place of each; None where no version has it."""
        out = []
        for place, m in enumerate(self.versions(name)):
            system, path = self._path(name, m.token, part)
            if place == 0 and part == "rows" or system.exists(path):
                out.append(self.spark.read.parquet(f"{self.root}/{name}/{m.token}/{part}").withColumn("_place", F.lit(place)))
        return _union(out) if out else None

    def newest(self, name: str, key: str) -> DataFrame | None:
        """key, _newest, _gone: of the keys that were added or taken out after the whole version the last place that did.

        None without such. Nothing is gathered of the whole version's keys.
        """
        rows, gone = self.parts(name), self.parts(name, "gone")
        added = [rows.where("_place > 0").select(key, "_place", F.lit(False).alias("_out"))] if len(self.versions(name)) > 1 else []
        taken = [gone.select(key, "_place", F.lit(True).alias("_out"))] if gone is not None else []
        if not added and not taken:
            return None
        both = _union([*added, *taken]).groupBy(key).agg(F.max("_place").alias("_newest"), F.max(F.when(~F.col("_out"), F.col("_place"))).alias("_has"))
        # A version that takes a key out and has rows of it puts these in its place.
        return both.select(key, "_newest", (F.coalesce("_has", F.lit(-1)) < F.col("_newest")).alias("_gone"))

    def rows(self, name: str, key: str) -> DataFrame:
        """The table: of each key all rows of the last version that has it or took it out, from the whole version on."""
        if not self.versions(name):
            raise LookupError(f"{name} has no version yet")
        return current(self.parts(name), self.newest(name, key), key)

    def behind(self, name: str, source: str) -> bool:
        """Whether ``name`` lacks a version of ``source``: of what it was made from, or of what was added to that since."""
        made = self.versions(name)
        if not made:
            return True
        wanted = self._markers(source)
        base = made[0].covers if made[0].upto >= 0 else 0
        known = {m.covers for m in made}
        return any(m.nth > base and m.nth not in known and m.upto < 0 for m in wanted)

    def read_or_build(self, name: str, generation: str, build) -> DataFrame:
        """The generation if it is published, or else what ``build`` gives, published."""
        try:
            return self.read(name, generation)
        except Exception as missing:  # noqa: BLE001  no marker yet: Spark raises where the folder is absent
            if not isinstance(missing, LookupError) and "PATH_NOT_FOUND" not in str(missing):
                raise
            self.publish(name, build(), generation)
            return self.read(name, generation)
